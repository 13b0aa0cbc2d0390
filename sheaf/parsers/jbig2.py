"""Black and white pictures coded as JBIG2 (ITU-T T.88), as PDF files embed them: generic regions by
arithmetic coding or fax coding, and text of symbols by arithmetic coding. Refinements, halftones and Huffman codes are not
decoded."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

from . import ccitt

#: The probability of the less probable symbol, the states after a more and a less probable one, and whether
#: the latter exchanges the two.
STATES = [
    (0x5601, 1, 1, 1), (0x3401, 2, 6, 0), (0x1801, 3, 9, 0), (0x0AC1, 4, 12, 0), (0x0521, 5, 29, 0), (0x0221, 38, 33, 0), (0x5601, 7, 6, 1), (0x5401, 8, 14, 0),
    (0x4801, 9, 14, 0), (0x3801, 10, 14, 0), (0x3001, 11, 17, 0), (0x2401, 12, 18, 0), (0x1C01, 13, 20, 0), (0x1601, 29, 21, 0), (0x5601, 15, 14, 1), (0x5401, 16, 14, 0),
    (0x5101, 17, 15, 0), (0x4801, 18, 16, 0), (0x3801, 19, 17, 0), (0x3401, 20, 18, 0), (0x3001, 21, 19, 0), (0x2801, 22, 19, 0), (0x2401, 23, 20, 0), (0x2201, 24, 21, 0),
    (0x1C01, 25, 22, 0), (0x1801, 26, 23, 0), (0x1601, 27, 24, 0), (0x1401, 28, 25, 0), (0x1201, 29, 26, 0), (0x1101, 30, 27, 0), (0x0AC1, 31, 28, 0), (0x09C1, 32, 29, 0),
    (0x08A1, 33, 30, 0), (0x0521, 34, 31, 0), (0x0441, 35, 32, 0), (0x02A1, 36, 33, 0), (0x0221, 37, 34, 0), (0x0141, 38, 35, 0), (0x0111, 39, 36, 0), (0x0085, 40, 37, 0),
    (0x0049, 41, 38, 0), (0x0025, 42, 39, 0), (0x0015, 43, 40, 0), (0x0009, 44, 41, 0), (0x0005, 45, 42, 0), (0x0001, 45, 43, 0), (0x5601, 46, 46, 0),
]
#: The pixels (columns to the right, rows up) whose values choose a pixel's context, the highest bit first; None
#: is the next adaptive one. Then the context that says whether a row is like the one above it.
TEMPLATES = [
    ([None, (-1, 2), (0, 2), (1, 2), None, None, (-2, 1), (-1, 1), (0, 1), (1, 1), (2, 1), None, (-4, 0), (-3, 0), (-2, 0), (-1, 0)], (3, 2, 1, 0), 0x9B25),
    ([(-1, 2), (0, 2), (1, 2), (2, 2), (-2, 1), (-1, 1), (0, 1), (1, 1), (2, 1), None, (-3, 0), (-2, 0), (-1, 0)], (0,), 0x0795),
    ([(-1, 2), (0, 2), (1, 2), (-2, 1), (-1, 1), (0, 1), (1, 1), None, (-2, 0), (-1, 0)], (0,), 0x00E5),
    ([(-3, 1), (-2, 1), (-1, 1), (0, 1), (1, 1), None, (-4, 0), (-3, 0), (-2, 0), (-1, 0)], (0,), 0x0195),
]
MOST_PIXELS = 1 << 23
_SYMBOLS, _TEXT, _GENERIC, _PAGE = 0, (4, 6, 7), (36, 38, 39), 48
#: Symbols, and instances of them, at most.
MOST_SYMBOLS = 1 << 16
#: Bits and least value of the classes of whole numbers, each told by one more 1 before it.
CLASSES = [(2, 0), (4, 4), (6, 20), (8, 84), (12, 340), (32, 4436)]


class Unsupported(ValueError):
    """What this decoder doesn't know."""


class Arithmetic:
    """The adaptive binary decoder; a context is an index into a list of states, shifted by the likelier value."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0
        self.code, self.left, self.span = self._byte(0) << 16, 0, 0x8000
        self._more()
        self.code, self.left = self.code << 7, self.left - 7

    def _byte(self, at: int) -> int:
        return self.data[at] if at < len(self.data) else 0xFF

    def _more(self) -> None:
        following = self._byte(self.at + 1)
        if self._byte(self.at) == 0xFF and following > 0x8F:
            self.code, self.left = self.code + 0xFF00, 8
            return
        stuffed = self._byte(self.at) == 0xFF
        self.at += 1
        self.code, self.left = self.code + (following << (9 if stuffed else 8)), 7 if stuffed else 8

    def bit(self, contexts: list[int], context: int) -> int:
        held = contexts[context]
        state, value = held >> 1, held & 1
        part, after, unlikely, turned = STATES[state]
        self.span -= part
        if self.code >> 16 < part:
            likely, self.span = self.span < part, part
        else:
            self.code -= part << 16
            if self.span & 0x8000:
                return value
            likely = self.span >= part
        contexts[context] = after << 1 | value if likely else unlikely << 1 | (value ^ turned)
        while True:
            if not self.left:
                self._more()
            self.span, self.code, self.left = self.span << 1, (self.code << 1) & 0xFFFFFFFF, self.left - 1
            if self.span & 0x8000:
                return value if likely else 1 - value


class Numbers:
    """Whole numbers of the kinds that a segment has, each kind with contexts of its own; None ends a list."""

    def __init__(self, coder: Arithmetic):
        self.coder, self.contexts = coder, {}

    def _bits(self, kind: str, before: int, n: int) -> tuple[int, int]:
        contexts, value = self.contexts.setdefault(kind, [0] * 512), 0
        for _ in range(n):
            bit = self.coder.bit(contexts, before)
            value = value << 1 | bit
            before = before << 1 | bit if before < 256 else (before << 1 | bit) & 511 | 256
        return value, before

    def next(self, kind: str) -> int | None:
        sign, before = self._bits(kind, 1, 1)
        for bits, least in CLASSES:
            more = 0
            if bits < 32:
                more, before = self._bits(kind, before, 1)
            if not more:
                break
        value, _ = self._bits(kind, before, bits)
        value += least
        return value if not sign else -value if value else None

    def symbol(self, length: int) -> int:
        contexts, at = self.contexts.setdefault("symbol", [0] * (2 << length)), 1
        for _ in range(length):
            at = at << 1 | self.coder.bit(contexts, at)
        return at - (1 << length)


def places(template: int, adaptive: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The pixels of a context in order: (columns to the right, rows up)."""
    fixed, order, _ = TEMPLATES[template]
    own = iter(order)
    return [p or (adaptive[k][0], -adaptive[k][1]) for p, k in ((p, None if p else next(own)) for p in fixed)]


def generic(coder: Arithmetic, wide: int, high: int, template: int, adaptive: list[tuple[int, int]], typical: bool = False, contexts: list[int] | None = None) -> list[bytearray]:
    """Rows of one byte a pixel; with `typical`, a bit before each row says whether the kind of row changes."""
    contexts, around, like = contexts or [0] * (1 << 16), places(template, adaptive), 0
    rows: list[bytearray] = []
    margin = 130
    blank = bytearray(wide + 2 * margin)
    reach = max(up for _, up in around)
    held = [blank] * (reach + 1)
    for _ in range(high):
        if typical:
            like ^= coder.bit(contexts, TEMPLATES[template][2])
            if like:
                held = [held[0], *held[:-1]]
                rows.append(held[0])
                continue
        row = bytearray(wide + 2 * margin)
        held = [row, *held[:-1]]
        seen = [(held[up], margin + right) for right, up in around]
        for x in range(wide):
            context = 0
            for line, shift in seen:
                context = context << 1 | line[x + shift]
            if coder.bit(contexts, context):
                row[x + margin] = 1
        rows.append(row)
    return [r[margin : margin + wide] for r in rows]


@dataclass
class Segment:
    number: int
    kind: int
    referred: list[int]
    data: bytes


def segments(raw: bytes) -> Iterator[Segment]:
    at = 0
    while at + 11 <= len(raw):
        number, flags, count = struct.unpack_from(">IBB", raw, at)
        referred = count >> 5
        at += 6
        if referred == 7:
            referred = struct.unpack_from(">I", raw, at - 1)[0] & 0x1FFFFFFF
            at += 3 + (referred + 8) // 8
        width = 1 if number <= 256 else 2 if number <= 65536 else 4
        to = [int.from_bytes(raw[at + width * k : at + width * (k + 1)], "big") for k in range(min(referred, len(raw)))]
        at += referred * width + (4 if flags & 0x40 else 1)
        if at + 4 > len(raw):
            return
        (size,) = struct.unpack_from(">I", raw, at)
        at += 4
        size = len(raw) - at if size == 0xFFFFFFFF else size
        yield Segment(number, flags & 0x3F, to, raw[at : at + size])
        at += size


def _region(s: Segment) -> tuple[int, int, int, int, list[bytes]]:
    """x, y, the way to combine, and the rows of a generic region."""
    wide, high, x, y, how, flags = struct.unpack_from(">IIIIBB", s.data)
    if wide * high > MOST_PIXELS or wide > 1 << 16:
        raise Unsupported("large region")
    if flags & 1:
        raw, n = ccitt.decoded(s.data[18:], wide, high, -1, black_is_1=True)
        row = (wide + 7) // 8
        rows = [bytes(b >> (7 - i) & 1 for b in raw[k * row : (k + 1) * row] for i in range(8))[:wide] for k in range(n)]
        return x, y, how & 7, wide, rows + [bytes(wide)] * (high - n)
    template = flags >> 1 & 3
    adaptive, at = _adaptive(s.data, 18, template)
    return x, y, how & 7, wide, generic(Arithmetic(s.data[at:]), wide, high, template, adaptive, bool(flags & 8))


def _adaptive(data: bytes, at: int, template: int) -> tuple[list[tuple[int, int]], int]:
    """The adaptive pixels of a template (columns to the right, rows down), and where they end."""
    count = len(TEMPLATES[template][1])
    found = [struct.unpack_from(">bb", data, at + 2 * k) for k in range(count)]
    if any(down > 0 or down == 0 and right >= 0 for right, down in found):
        raise Unsupported("adaptive pixel")
    return found, at + 2 * count


Symbol = list  # rows of one byte a pixel


def _symbols(s: Segment, known: list[Symbol]) -> list[Symbol]:
    """The symbols that a dictionary exports, of those it was given and its own, by height then width."""
    (flags,) = struct.unpack_from(">H", s.data)
    if flags & 0x303:
        raise Unsupported("symbols by Huffman codes, refinement or contexts of others")
    template = flags >> 10 & 3
    adaptive, at = _adaptive(s.data, 2, template)
    _, count = struct.unpack_from(">II", s.data, at)
    if count > MOST_SYMBOLS:
        raise Unsupported("many symbols")
    coder, contexts, made, high, pixels = Arithmetic(s.data[at + 8 :]), [0] * (1 << 16), list(known), 0, 0
    numbers = Numbers(coder)
    while len(made) < len(known) + count:
        high, wide = high + (numbers.next("height") or 0), 0
        while (step := numbers.next("width")) is not None:
            wide += step
            pixels += wide * high
            if wide < 0 or high < 0 or pixels > MOST_PIXELS or len(made) >= len(known) + count:
                raise Unsupported("damaged symbols")
            made.append(generic(coder, wide, high, template, adaptive, contexts=contexts))
    out, at, kept = [], 0, False
    while at < len(made):
        run = numbers.next("export") or 0
        if run < 0 or not run and at and not kept:
            raise Unsupported("damaged exports")
        out += made[at : at + run] if kept else []
        at, kept = at + run, not kept
    return out


def _text(s: Segment, symbols: list[Symbol]) -> tuple[int, int, int, int, list[bytes]]:
    """A region of symbols, placed strip by strip: as _region."""
    wide, high, x, y, how, flags, count = struct.unpack_from(">IIIIBHI", s.data)
    if flags & 3 or wide * high > MOST_PIXELS or count > MOST_SYMBOLS:
        raise Unsupported("text by Huffman codes or refinement, or large")
    strip, corner, turned, mix = 1 << (flags >> 2 & 3), flags >> 4 & 3, flags >> 6 & 1, flags >> 7 & 3
    gap = (flags >> 10 & 31) - (32 if flags >> 14 & 1 else 0)
    length = max(0, (len(symbols) - 1).bit_length())
    numbers = Numbers(Arithmetic(s.data[23:]))
    page = [bytearray((b"\1" if flags >> 9 & 1 else b"\0") * wide) for _ in range(high)]
    top, first, done = -(numbers.next("strip") or 0) * strip, 0, 0
    right, low = corner in (2, 3), corner in (0, 2)
    while done < count:
        top += (numbers.next("strip") or 0) * strip
        first += numbers.next("first") or 0
        along = first
        while True:
            across = top + ((numbers.next("within") or 0) if strip > 1 else 0)
            k = numbers.symbol(length)
            if k >= len(symbols):
                raise Unsupported("damaged text")
            rows = symbols[k]
            w, h = len(rows[0]) if rows else 0, len(rows)
            size = h if turned else w
            ahead = low if turned else right  # the corner is at the symbol's far end
            along += size - 1 if ahead else 0
            px, py = (across, along) if turned else (along, across)
            px, py = px - (w - 1 if right else 0), py - (h - 1 if low else 0)
            for n, row in enumerate(rows):
                if 0 <= py + n < high and px < wide:
                    _put(page[py + n], max(px, 0), row[max(-px, 0) : wide - px], mix)
            along += 0 if ahead else size - 1
            done += 1
            step = numbers.next("next")
            if step is None or done > count:
                break
            along += step + gap
    return x, y, how & 7, wide, page


def decoded(raw: bytes, shared: bytes, wide: int, high: int) -> bytes:
    """Rows of one bit a pixel, 1 for black, each from a whole byte on. Unsupported for segments of other kinds."""
    if wide <= 0 or high <= 0 or wide * high > MOST_PIXELS:
        raise Unsupported("large page")
    page = [bytearray(wide) for _ in range(high)]
    dictionaries: dict[int, list[Symbol]] = {}
    try:
        for s in [*segments(shared), *segments(raw)]:
            if s.kind == _PAGE and len(s.data) >= 17 and s.data[16] & 4:
                page = [bytearray(b"\1" * wide) for _ in range(high)]
            elif s.kind == _SYMBOLS:
                dictionaries[s.number] = _symbols(s, [x for n in s.referred for x in dictionaries.get(n, [])])
            elif s.kind in _GENERIC or s.kind in _TEXT:
                x, y, how, own, rows = _region(s) if s.kind in _GENERIC else _text(s, [x for n in s.referred for x in dictionaries.get(n, [])])
                for n, row in enumerate(rows):
                    if y + n < high and x < wide:
                        _put(page[y + n], x, row[: wide - x], how)
            elif s.kind < _PAGE:
                raise Unsupported(f"segment {s.kind}")
    except (struct.error, IndexError) as e:
        raise Unsupported("damaged") from e
    spare = -wide % 8
    return b"".join((int(bytes(b + 48 for b in row), 2) << spare).to_bytes((wide + 7) // 8, "big") for row in page)


def _put(line: bytearray, x: int, row: bytes, how: int) -> None:
    """Combines by or, and, exclusive or, its opposite, or in place of what there is."""
    old, new = int.from_bytes(line[x : x + len(row)], "big"), int.from_bytes(row, "big")
    full = int.from_bytes(b"\1" * len(row), "big")
    made = (old | new, old & new, old ^ new, (old ^ new) ^ full, new)[min(how, 4)]
    line[x : x + len(row)] = made.to_bytes(len(row), "big")
