"""Workbooks of records (.xls, BIFF8)."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from ..containers.cfb import CompoundFile
from . import escher, images
from .base import ConversionError, Image, Options, Page, Pages
from .numbers import formatted, general
from .sheets import Sheet

_ERRORS = {0: "#NULL!", 7: "#DIV/0!", 15: "#VALUE!", 23: "#REF!", 29: "#NAME?", 36: "#NUM!", 42: "#N/A"}


def rk(value: int) -> float:
    """A packed number: a 30-bit integer or the upper bits of a double, perhaps in hundredths."""
    number = float(value >> 2 if not value & 0x80000000 else (value >> 2) - (1 << 30)) if value & 2 else struct.unpack("<d", struct.pack("<Q", (value & 0xFFFFFFFC) << 32))[0]
    return number / 100 if value & 1 else number


class _Strings:
    """The bytes of a record and of those that continue it; a string may go on in the next with another width."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.part, self.at = parts, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while n > 0 and self.part < len(self.parts):
            piece = self.parts[self.part][self.at : self.at + n]
            out, n, self.at = out + piece, n - len(piece), self.at + len(piece)
            if n > 0:
                self.part, self.at = self.part + 1, 0
        return out

    def string(self) -> str:
        count, flags = struct.unpack("<HB", self.take(3).ljust(3, b"\0"))
        runs = struct.unpack("<H", self.take(2).ljust(2, b"\0"))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4).ljust(4, b"\0"))[0] if flags & 4 else 0
        out, wide = "", flags & 1
        while count > 0 and self.part < len(self.parts):
            room = len(self.parts[self.part]) - self.at
            n = min(count, room // (2 if wide else 1))
            raw = self.take(n * (2 if wide else 1))
            out += raw.decode("utf-16-le" if wide else "latin-1", "replace")
            count -= n
            if count:
                if self.part + 1 >= len(self.parts):
                    break
                self.part, self.at = self.part + 1, 1
                wide = self.parts[self.part][:1] == b"\1"
        self.take(4 * runs + extra)
        return out


class Workbook:
    def __init__(self, data: bytes):
        try:
            f = CompoundFile(data)
        except ValueError as e:
            raise ConversionError("cannot open workbook") from e
        self.raw = f.read("Workbook") or f.read("Book")
        if not self.raw:
            raise ConversionError("no workbook stream")
        self.strings: list[str] = []
        self.drawing = b""
        self.sheets: list[tuple[str, int]] = []
        self.fonts: list[tuple[bool, bool]] = []
        self.codes: dict[int, str] = {}
        self.styles: list[tuple[int, int]] = []
        self._globals()

    def _records(self, at: int) -> Iterator[tuple[int, bytes, int]]:
        while at + 4 <= len(self.raw):
            kind, size = struct.unpack_from("<HH", self.raw, at)
            yield kind, self.raw[at + 4 : at + 4 + size], at + 4 + size
            at += 4 + size

    def _continued(self, body: bytes, at: int) -> list[bytes]:
        parts = [body]
        for kind, more, _ in self._records(at):
            if kind != 0x3C:
                break
            parts.append(more)
        return parts

    def _globals(self) -> None:
        for kind, body, after in self._records(0):
            if kind == 0x0A:
                break
            if kind == 0x2F:
                raise ConversionError("document is encrypted")
            if kind == 0x85 and len(body) >= 8:
                count, wide = body[6], body[7] & 1
                self.sheets.append((body[8 : 8 + count * (1 + wide)].decode("utf-16-le" if wide else "latin-1", "replace"), struct.unpack_from("<I", body)[0]))
            elif kind == 0xFC:
                s = _Strings(self._continued(body, after))
                total = struct.unpack("<II", s.take(8).ljust(8, b"\0"))[1]
                while len(self.strings) < total and s.part < len(s.parts):
                    self.strings.append(s.string())
            elif kind == 0x31 and len(body) >= 8:
                self.fonts.append((struct.unpack_from("<H", body, 6)[0] >= 700, bool(body[2] & 2)))
            elif kind == 0x41E and len(body) >= 5:
                self.codes[struct.unpack_from("<H", body)[0]] = _Strings([body[2:]]).string()
            elif kind == 0xEB:
                self.drawing += body if not after else b"".join(self._continued(body, after))
            elif kind == 0xE0 and len(body) >= 4:
                self.styles.append(struct.unpack_from("<HH", body))

    def _shown(self, value: float, style: int) -> str:
        number = self.styles[style][1] if style < len(self.styles) else 0
        code = self.codes.get(number, "")
        if not number or code.lower() == "general":
            return general(value)
        return formatted(repr(value), number, code)

    def _font(self, style: int) -> tuple[bool, bool]:
        n = self.styles[style][0] if style < len(self.styles) else 0
        n -= n > 4  # font 4 does not exist
        return self.fonts[n] if n < len(self.fonts) else (False, False)

    def sheet(self, n: int) -> Sheet:
        name, at = self.sheets[n - 1]
        sheet, depth, waiting = Sheet(name or f"Sheet {n}"), 0, None
        put = lambda r, c, style, v: sheet.put(r, c, v, self._font(style)[0], "\\|")
        for kind, body, _ in self._records(at):
            depth += (kind == 0x809) - (kind == 0x0A)
            if depth <= 0:
                break
            if kind == 0x207 and waiting:
                put(*waiting, _Strings([body]).string())
                waiting = None
            if len(body) < 6 or depth > 1:
                continue
            row, column, style = struct.unpack_from("<HHH", body)
            if kind == 0xFD and len(body) >= 10:
                index = struct.unpack_from("<I", body, 6)[0]
                put(row, column, style, self.strings[index] if index < len(self.strings) else "")
            elif kind == 0x203 and len(body) >= 14:
                put(row, column, style, self._shown(struct.unpack_from("<d", body, 6)[0], style))
            elif kind == 0x27E and len(body) >= 10:
                put(row, column, style, self._shown(rk(struct.unpack_from("<I", body, 6)[0]), style))
            elif kind == 0xBD:
                for k, a in enumerate(range(4, len(body) - 7, 6)):
                    own, value = struct.unpack_from("<HI", body, a)
                    put(row, column + k, own, self._shown(rk(value), own))
            elif kind == 0x204:
                put(row, column, style, _Strings([body[6:]]).string())
            elif kind == 0x205 and len(body) >= 8:
                put(row, column, style, _ERRORS.get(body[6], "#ERR") if body[7] else "TRUE" if body[6] else "FALSE")
            elif kind == 0x06 and len(body) >= 14:
                if body[12:14] != b"\xff\xff":
                    put(row, column, style, self._shown(struct.unpack_from("<d", body, 6)[0], style))
                elif body[6] == 0:
                    waiting = (row, column, style)
                elif body[6] in (1, 2):
                    put(row, column, style, ("TRUE" if body[8] else "FALSE") if body[6] == 1 else _ERRORS.get(body[8], "#ERR"))
        return sheet


def _images(book: Workbook, options: Options) -> list[Image]:
    found = []
    for form, data in filter(None, escher.blips(book.drawing)) if options.images else ():
        image = Image(1, f"page1_img{len(found)}", form, data)
        image.width, image.height = images.dimensions(data)
        if images.wanted(image, options):
            found.append(image)
    return found


def pages(data: bytes, options: Options = Options()) -> Pages:
    """Sheets with cells. Pictures are dealt to them evenly in order: the records don't say which sheet shows one."""
    book = Workbook(data)
    sheets = [(n, s) for n in range(1, len(book.sheets) + 1) if (s := book.sheet(n)).cells]
    found = _images(book, options)
    share = -(-len(found) // len(sheets)) if sheets else 0
    for k, (n, sheet) in enumerate(sheets):
        page: Page = sheet.page(n, options)
        page.page_width, page.page_height, page.body_font_size = 612.0, 792.0, 10.0
        for image in found[k * share : (k + 1) * share]:
            image.page_number = n
            page.images.append(image)
            page.text += f"![{image.name}]({images.reference(image, options)})\n\n"
        yield page


def markdown(data: bytes, options: Options = Options()) -> str:
    return "\n".join(p.text for p in pages(data, options))
