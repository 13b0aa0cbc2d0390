"""Hangul documents (.hwp, version 5): records of sections, with tables, text boxes and notes."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

from ..containers.cfb import CompoundFile
from . import images
from .base import ConversionError, Image, Options, Page, Pages
from .package import emphasised

_BIN, _CHAR_SHAPE, _PARA_SHAPE = 0x12, 0x15, 0x19
_PARA, _TEXT, _SHAPES, _CONTROL, _LIST, _TABLE, _PICTURE = 0x42, 0x43, 0x44, 0x47, 0x48, 0x4D, 0x55
#: Controls that take eight characters; the others below 32 take one.
_WIDE = frozenset({1, 2, 3, 4, 5, 6, 7, 8, 9, 11, 12, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23})
MOST, DEPTH, MOST_CELLS = 256 << 20, 64, 1 << 20
BODY = 1000  # hundredths of a point


@dataclass
class Record:
    tag: int
    level: int
    data: bytes
    below: list[Record] = field(default_factory=list)


def records(raw: bytes) -> list[Record]:
    """The records of a stream as trees by level."""
    top, path, at = [], [], 0
    while at + 4 <= len(raw):
        head = struct.unpack_from("<I", raw, at)[0]
        tag, level, size, at = head & 0x3FF, head >> 10 & 0x3FF, head >> 20, at + 4
        if size == 0xFFF and at + 4 <= len(raw):
            size, at = struct.unpack_from("<I", raw, at)[0], at + 4
        r = Record(tag, level, raw[at : at + size])
        at += size
        while path and path[-1].level >= level:
            path.pop()
        (path[-1].below if path and len(path) < DEPTH else top).append(r)
        path.append(r)
    return top


class Hwp:
    def __init__(self, data: bytes, options: Options):
        self.options = options
        try:
            self.file = CompoundFile(data)
        except ValueError as e:
            raise ConversionError("cannot open HWP document") from e
        head = self.file.read("FileHeader")
        if head[:17] != b"HWP Document File" or len(head) < 40:
            raise ConversionError("not a valid HWP document")
        flags = struct.unpack_from("<I", head, 36)[0]
        if flags & 2:
            raise ConversionError("encrypted HWP documents are not supported")
        self.packed = bool(flags & 1)
        self.chars: list[tuple[int, bool, bool]] = []
        self.outlines: list[int] = []
        self.bins: list[str] = []
        for r in _flat(records(self._stream("DocInfo"))):
            if r.tag == _CHAR_SHAPE and len(r.data) >= 50:
                size, flags = struct.unpack_from("<iI", r.data, 42)
                self.chars.append((size, bool(flags & 2), bool(flags & 1)))
            elif r.tag == _PARA_SHAPE and len(r.data) >= 4:
                flags = struct.unpack_from("<I", r.data)[0]
                self.outlines.append((flags >> 25 & 7) + 1 if flags >> 23 & 3 == 1 else 0)
            elif r.tag == _BIN and len(r.data) >= 4:
                kind, ident = struct.unpack_from("<HH", r.data)
                size = struct.unpack_from("<H", r.data, 4)[0] if len(r.data) >= 6 else 0
                ext = r.data[6 : 6 + 2 * size].decode("utf-16-le", "replace")
                self.bins.append(f"BinData/BIN{ident:04X}.{ext}" if kind & 15 == 1 else "")

    def _stream(self, name: str) -> bytes:
        raw = self.file.read(name)
        if not self.packed or not raw:
            return raw
        d = zlib.decompressobj(-15)
        try:
            return d.decompress(raw, MOST)
        except zlib.error:
            return b""

    def sections(self) -> list[str]:
        found = [p for p in self.file.paths("BodyText/Section") if p[16:].isdigit()]
        return sorted(found, key=lambda p: int(p[16:]))

    def section(self, name: str, number: int) -> Page:
        page = Page(number, "", 595.28, 841.88, BODY / 100)
        edges: list[str] = []
        out = [self._paragraph(r, page, edges) for r in records(self._stream(name)) if r.tag == _PARA]
        page.text = "".join(edges) + "".join(out)
        return page

    def _paragraph(self, r: Record, page: Page, edges: list[str]) -> str:
        shape = struct.unpack_from("<H", r.data, 8)[0] if len(r.data) >= 10 else 0
        before, after = [], []
        for c in (x for x in r.below if x.tag == _CONTROL and len(x.data) >= 4):
            kind = c.data[3::-1]
            if kind == b"tbl ":
                before.append(self._table(c, page, edges))
            elif kind == b"gso ":
                before.append(self._shape(c, page, edges))
            elif kind in (b"head", b"foot"):
                edges += self._inner(c, page, edges)
            elif kind in (b"fn  ", b"en  "):
                after += self._inner(c, page, edges)
        raw = next((x.data for x in r.below if x.tag == _TEXT), b"")
        spans = next((x.data for x in r.below if x.tag == _SHAPES), b"")
        text, size = self._styled(raw, spans)
        level = self.outlines[shape] if shape < len(self.outlines) else 0
        if not level and text.strip():
            level = next((n for n, least in ((1, 2.0), (2, 1.6), (3, 1.3)) if size >= least * BODY), 0)
        if text.strip():
            plain = self._plain(raw).strip()
            before.append(f"{'#' * min(level, 6)} {plain}\n\n" if level else f"{text.strip()}\n\n")
        return "".join(before) + "".join(after)

    def _units(self, raw: bytes) -> list[str]:
        """One entry a character position; controls are empty, of wide ones seven more."""
        out, codes, at = [], struct.unpack(f"<{len(raw) // 2}H", raw[: len(raw) // 2 * 2]), 0
        while at < len(codes):
            c = codes[at]
            if c in _WIDE:
                out += ["\t" if c == 9 else "", *[""] * 7]
                at += 8
                continue
            if 0xD800 <= c < 0xDC00 and at + 1 < len(codes) and 0xDC00 <= codes[at + 1] < 0xE000:
                out += [chr(0x10000 + ((c - 0xD800) << 10) + codes[at + 1] - 0xDC00), ""]
                at += 2
                continue
            out.append("\n" if c in (10, 13) else chr(c) if c > 31 and not 0xD800 <= c < 0xE000 else "")
            at += 1
        return out

    def _plain(self, raw: bytes) -> str:
        return "".join(self._units(raw))

    def _styled(self, raw: bytes, spans: bytes) -> tuple[str, int]:
        """Text with emphasis, and the height that most of it has; of equals the smaller."""
        units, marks = self._units(raw), [struct.unpack_from("<II", spans, a) for a in range(0, len(spans) - 7, 8)]
        if not marks:
            return "".join(units), BODY
        runs, heights = [], {}
        for (a, shape), b in zip(marks, [m[0] for m in marks[1:]] + [len(units)], strict=True):
            size, bold, italic = self.chars[shape] if shape < len(self.chars) else (BODY, False, False)
            text = "".join(units[a:b])
            if text:
                end = text[len(text.rstrip("\n")) :]
                runs.append((text.rstrip("\n"), bold, italic))
                runs += [(end, False, False)] if end else []
                heights[size] = heights.get(size, 0) + len(text)
        return emphasised([x for x in runs if x[0]]), max(heights, key=lambda s: (heights[s], -s), default=BODY)

    def _inner(self, r: Record, page: Page, edges: list[str]) -> list[str]:
        """The paragraphs of lists within a control."""
        return [self._paragraph(x, page, edges) for x in r.below if x.tag == _PARA] + [t for x in r.below if x.tag not in (_PARA, _CONTROL) for t in self._inner(x, page, edges)]

    def _table(self, r: Record, page: Page, edges: list[str]) -> str:
        own = next((x for x in r.below if x.tag == _TABLE), None)
        rows, columns = struct.unpack_from("<HH", own.data, 4) if own and len(own.data) >= 8 else (0, 0)
        if rows * columns > MOST_CELLS:
            raise ConversionError(f"a table of {rows} x {columns} cells")
        grid = [[""] * columns for _ in range(rows)]
        place, cells = None, {}
        for x in r.below:
            if x.tag == _LIST:
                place = struct.unpack_from("<HH", x.data, 8) if len(x.data) >= 12 else None
                cells.setdefault(place, []).extend(self._paragraph(p, page, edges) for p in x.below if p.tag == _PARA)
            elif x.tag == _PARA and place:
                cells.setdefault(place, []).append(self._paragraph(x, page, edges))
        for at, texts in cells.items():
            if at and at[1] < len(grid) and at[0] < len(grid[0]):
                grid[at[1]][at[0]] = "<br>".join(t.strip().replace("\n", "<br>") for t in texts if t.strip()).replace("|", "\\|")
        return render_table(grid, page, self.options)

    def _shape(self, r: Record, page: Page, edges: list[str]) -> str:
        out = []
        for x in _flat(r.below):
            if x.tag == _PICTURE and len(x.data) >= 73 and self.options.images:
                n = struct.unpack_from("<H", x.data, 71)[0]
                out.append(self._image(n, page))
            elif x.tag == _LIST:
                out += [self._paragraph(p, page, edges) for p in x.below if p.tag == _PARA]
        return "".join(out) + "".join(self._paragraph(p, page, edges) for x in r.below for p in x.below if p.tag == _PARA and x.tag != _LIST)

    def _image(self, n: int, page: Page) -> str:
        name = self.bins[n - 1] if 0 < n <= len(self.bins) else ""
        data = self._stream(name) if name else b""
        if not data:
            return ""
        image = Image(page.page_number, f"page{page.page_number}_img{len(page.images)}", images.format_of_extension(images.extension(name)), data)
        image.width, image.height = images.dimensions(data)
        if not images.wanted(image, self.options):
            return ""
        page.images.append(image)
        return f"![{image.name}]({images.reference(image, self.options, images.extension(name))})\n\n"


def render_table(grid: list[list[str]], page: Page, options: Options) -> str:
    """Without empty columns at the end; nothing for an empty one or if tables aren't wanted."""
    from .markdown import table

    wide = max((n + 1 for row in grid for n, c in enumerate(row) if c), default=0)
    rows = [row[:wide] for row in grid]
    if not wide or not options.tables:
        return ""
    page.tables.append(rows)
    return table(rows) + "\n"


def _flat(found: list[Record]):
    for r in found:
        yield r
        yield from _flat(r.below)


def pages(data: bytes, options: Options = Options()) -> Pages:
    """Sections; `pages` selects them from 0."""
    doc = Hwp(data, options)
    for n, name in enumerate(doc.sections()):
        if options.wants(n):
            yield doc.section(name, n + 1)


def markdown(data: bytes, options: Options = Options()) -> str:
    return "\n".join(p.text for p in pages(data, options))
