"""Hangul documents of old (.hwp, version 3): paragraphs of 16-bit codes with controls of fixed framing."""

from __future__ import annotations

import struct
import zlib

from .base import ConversionError, Options, Page, Pages
from .markdown import SPACE, escape_cell, table

#: Sizes of the format's structures.
_HEAD, _INFO, _SUMMARY, _FONT, _STYLE, _CHAR, _PARA, _LINE, _CELL = 30, 128, 1008, 40, 20, 31, 187, 14, 27
#: Characters that a control counts for, where it isn't four.
_WORDS = {0: 1, 7: 42, 8: 48, 13: 1, 22: 12, 23: 5, 24: 3, 25: 3, 26: 123, 28: 32, 30: 2, 31: 2}
#: Controls of one size: bytes between the code and its repetition, then bytes after.
_FRAMES = {7: (80, 0), 14: (4, 84), 18: (4, 0), 19: (4, 0), 20: (4, 0), 21: (4, 0), 22: (20, 0), 24: (2, 0), 25: (2, 0), 26: (242, 0), 28: (60, 0)}
#: Controls with a list of paragraphs, by the bytes before it.
_LISTS = {15: 8, 16: 10, 17: 14}
_BULLETS = (0xA1E0, 0xA1DB, 0xA1DE, 0xA1E2, 0xA1E4, 0xA2B7, 0xA2B9)
DEPTH, MOST = 16, 256 << 20


def _ks(lead: int, trail: int) -> str:
    try:
        return bytes((lead, trail)).decode("cp949")
    except (UnicodeDecodeError, ValueError):
        return "�"


def character(code: int) -> str:
    """A code as text: ASCII, quotes, johab syllables, hanja by number, kana, symbols, bullets and lines."""
    if code < 0x80:
        return chr(code) if code >= 0x20 else ""
    if code in (0x81, 0x82, 0x83, 0x84):
        return '"' if code < 0x83 else "'"
    if code & 0x8000:
        return _johab(code)
    if code & 0x4000:
        row, column = divmod(code - 0x4000, 94)
        return _ks(0xCA + row, 0xA1 + column) if row < 52 else "�"
    low = code & 0xFF
    if code >> 8 == 0x1F:
        return _ks(0xAA + (low >= 0x60), low % 0x60 + 0xA0)
    if 0x3013 <= code < 0x3060:
        return "-" if (code - 0x3013) % 11 == 9 else "|" if (code - 0x3013) % 11 == 10 else "+"
    if 0x2F00 <= code < 0x2F70 and (code & 15) < 9:
        return _ks(*divmod(_BULLETS[(code >> 4) - 0x2F0] + ((code & 15) >= 6), 256))
    if 0x3400 <= code < 0x37C0:
        row, column = divmod(code - 0x3400, 0x60)
        return _ks(0xAC if row == 9 else 0xA1 + row, 0xA0 + column)
    return "한글과컴퓨터"[code - 0x37C0] if 0x37C0 <= code < 0x37C6 else "�"


def _johab(code: int) -> str:
    """Three five-bit parts: initial, medial, final; alone they are compatibility letters."""
    try:
        return code.to_bytes(2, "big").decode("johab")
    except UnicodeDecodeError:
        return "�"


class Reader:
    def __init__(self, data: bytes):
        if data[:22] != b"HWP Document File V3.0":
            raise ConversionError("unsupported HWP version (only 3.0x and 5.x)")
        info = data[_HEAD : _HEAD + _INFO]
        if len(info) < _INFO:
            raise ConversionError("corrupt HWP 3 document")
        if struct.unpack_from("<H", info, 0x60)[0]:
            raise ConversionError("document is password-protected")
        body = data[_HEAD + _INFO + _SUMMARY + struct.unpack_from("<H", info, 0x7E)[0] :]
        if info[0x7C]:
            try:
                body = zlib.decompressobj(-15).decompress(body, MOST)
            except zlib.error as e:
                raise ConversionError("compressed body is corrupt") from e
        self.data, self.at, self.out, self.para = body, 0, [], []
        for _ in range(7):
            self.skip(self.number(2) * _FONT)
        self.skip(self.number(2) * (_STYLE + _CHAR + _PARA))
        while self.at < len(self.data) and self.paragraph(0):
            self.flush()
        self.flush()

    def take(self, n: int) -> bytes:
        if n > len(self.data) - self.at:
            raise ConversionError("corrupt HWP 3 document: unexpected end")
        self.at += n
        return self.data[self.at - n : self.at]

    def skip(self, n: int) -> None:
        self.take(n)

    def number(self, n: int) -> int:
        return int.from_bytes(self.take(n), "little")

    def flush(self) -> None:
        text, self.para = "".join(self.para).strip(SPACE), []
        if text:
            self.out.append(text + "\n\n")

    def inner(self, depth: int) -> str:
        """The text of a list of paragraphs, each ending its line."""
        if depth >= DEPTH:
            raise ConversionError("corrupt HWP 3 document: nested too deeply")
        held, self.para = self.para, []
        while self.at < len(self.data) and self.paragraph(depth + 1):
            self.para.append("\n")
        text, self.para = "".join(self.para), held
        return text

    def aside(self, depth: int) -> None:
        text = self.inner(depth).strip(SPACE)
        if text:
            self.out.append(text + "\n\n")

    def paragraph(self, depth: int) -> bool:
        """Reads one; False at the empty one that ends a list."""
        shared, count, lines, shapes = struct.unpack("<BHHB6x", self.take(12))
        if not count:
            self.at = min(len(self.data), self.at + _CHAR + lines * _LINE)
            return False
        self.skip(_CHAR + (0 if shared else _PARA) + lines * _LINE)
        for _ in range(count if shapes else 0):
            if not self.number(1):
                self.skip(_CHAR)
        n = 0
        while n < count:
            code = self.number(2)
            if code > 31:
                self.para.append(character(code))
                n += 1
                continue
            n += _WORDS.get(code, 4)
            if code == 13:
                break
            self.control(code, depth)
        return True

    def repeated(self, code: int) -> None:
        if self.number(2) != code:
            raise ConversionError("corrupt HWP 3 document: control framing")

    def control(self, code: int, depth: int) -> None:
        if code in _FRAMES:
            inside, after = _FRAMES[code]
            self.skip(inside)
            self.repeated(code)
            self.skip(after)
        elif code in (30, 31):
            self.repeated(code)
            self.para.append(" ")
        elif code in _LISTS:
            self.skip(4)
            self.repeated(code)
            self.skip(_LISTS[code])
            self.aside(depth)
        elif code == 5:
            self.skip(6)
            self.field()
        elif code == 8:
            self.skip(80)
            year, month, _, day = struct.unpack("<4H4x", self.take(12))
            self.repeated(code)
            if 1900 <= year <= 2200 and 1 <= month <= 12 and 1 <= day <= 31:
                self.para.append(f"{year:04d}-{month:02d}-{day:02d}")
        elif code in (9, 10, 11):
            self.skip(4)
            self.repeated(code)
            if code == 9:
                self.para.append("\t")
            elif code == 10:
                self.box(depth)
            else:
                self.skip(int.from_bytes(self.take(348)[:4], "little"))
                self.aside(depth)
        elif code == 23:
            parts = struct.unpack("<3H", self.take(6))
            self.repeated(code)
            self.para += [character(c) for c in parts if c]
        else:
            size = self.number(4)
            self.repeated(code)
            self.skip(size)

    def field(self) -> None:
        self.skip(30)
        command, help_, shown, attached = struct.unpack("<4I", self.take(16))
        self.skip(command + help_)
        self.para += [character(self.number(2)) for _ in range(shown // 2)]
        self.skip((shown & 1) + attached)

    def box(self, depth: int) -> None:
        """A table of more than one cell by their places, or boxed text within the paragraph; then its caption."""
        kind, count = struct.unpack_from("<HH", self.take(84), 78)
        if not count:
            raise ConversionError("corrupt HWP 3 document: box without cells")
        places = [struct.unpack_from("<HH", self.take(_CELL), 4) for _ in range(count)]
        cells = [(y, x, self.inner(depth)) for x, y in places]
        if kind == 0 and count > 1:
            self.flush()
            rows: dict[int, list[str]] = {}
            for y, _, text in sorted(cells, key=lambda c: c[:2]):
                rows.setdefault(y, []).append(escape_cell(text))
            self.out.append(table(list(rows.values())) + "\n")
        else:
            texts = [t for _, _, text in cells if (t := text.strip(SPACE))]
            self.para.append((" " if self.para and texts else "") + " ".join(texts))
        self.aside(depth)


def markdown(data: bytes, options: Options = Options()) -> str:
    return "".join(Reader(data).out)


def pages(data: bytes, options: Options = Options()) -> Pages:
    yield Page(0, markdown(data, options))
