"""Workbooks of binary parts (.xlsb)."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from . import xml
from .base import ConversionError, Options, Pages
from .numbers import formatted
from .sheets import Sheet
from .xls import _ERRORS, rk


def records(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(type, body): the type in one or two bytes, the size in up to four, seven bits each."""
    at = 0
    while at < len(data):
        kind, at = data[at], at + 1
        if kind & 0x80:
            if at >= len(data):
                return
            kind, at = kind & 0x7F | (data[at] & 0x7F) << 7, at + 1
        size = 0
        for shift in range(0, 28, 7):
            if at >= len(data):
                return
            b, at = data[at], at + 1
            size |= (b & 0x7F) << shift
            if not b & 0x80:
                break
        yield kind, data[at : at + size]
        at += size


def wide(body: bytes, at: int) -> tuple[str, int]:
    if at + 4 > len(body):
        return "", len(body)
    n = struct.unpack_from("<I", body, at)[0]
    return body[at + 4 : at + 4 + 2 * n].decode("utf-16-le", "replace"), at + 4 + 2 * n


class Workbook:
    def __init__(self, data: bytes):
        self.z = xml.package(data)
        rels = xml.relationships(self.z, "xl/_rels/workbook.bin.rels")
        self.sheets, self.strings, self.codes, self.styles = [], [], {}, []
        raw = self.z.read("xl/workbook.bin")
        if not raw:
            raise ConversionError("no workbook")
        for kind, body in records(raw):
            if kind == 156 and len(body) > 12:
                rid, at = wide(body, 8)
                self.sheets.append((wide(body, at)[0], xml.resolved("xl", rels.get(rid, f"worksheets/sheet{len(self.sheets) + 1}.bin"))))
        self.strings = [wide(body, 1)[0] for kind, body in records(self.z.read("xl/sharedStrings.bin")) if kind == 19]
        cells = False
        for kind, body in records(self.z.read("xl/styles.bin")):
            if kind == 44 and len(body) > 2:
                self.codes[struct.unpack_from("<H", body)[0]] = wide(body, 2)[0]
            elif kind in (617, 618):
                cells = kind == 617
            elif kind == 47 and cells and len(body) >= 4:
                self.styles.append(struct.unpack_from("<H", body, 2)[0])

    def _shown(self, value: float, style: int) -> str:
        number = self.styles[style] if style < len(self.styles) else 0
        return formatted(f"{value:.15g}", number, self.codes.get(number, ""))

    def sheet(self, n: int) -> Sheet:
        name, part = self.sheets[n - 1]
        sheet, row = Sheet(name or f"Sheet {n}"), -1
        for kind, body in records(self.z.read(part)):
            if kind == 0 and len(body) >= 4:
                row = struct.unpack_from("<I", body)[0]
                continue
            if not 1 <= kind <= 11 or len(body) < 8:
                continue
            column, style = struct.unpack_from("<II", body)
            style &= 0xFFFFFF
            value = ""
            if kind == 2 and len(body) >= 12:
                value = self._shown(rk(struct.unpack_from("<I", body, 8)[0]), style)
            elif kind in (3, 11) and len(body) >= 9:
                value = _ERRORS.get(body[8], "#ERR")
            elif kind in (4, 10) and len(body) >= 9:
                value = "TRUE" if body[8] else "FALSE"
            elif kind in (5, 9) and len(body) >= 16:
                value = self._shown(struct.unpack_from("<d", body, 8)[0], style)
            elif kind in (6, 8):
                value = wide(body, 8)[0]
            elif kind == 7 and len(body) >= 12:
                index = struct.unpack_from("<I", body, 8)[0]
                value = self.strings[index] if index < len(self.strings) else ""
            sheet.put(row, column, value)
        return sheet


def pages(data: bytes, options: Options = Options()) -> Pages:
    book = Workbook(data)
    for n in range(1, len(book.sheets) + 1):
        if options.wants(n):
            yield book.sheet(n).page(n, options)


def markdown(data: bytes, options: Options = Options()) -> str:
    return "\n---\n\n".join(p.text for p in pages(data, options))
