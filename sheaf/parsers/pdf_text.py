"""Text of PDF pages: fonts to characters, content operators to placed characters and rules, characters to lines."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter
from dataclasses import dataclass, field
from statistics import median_high

from .base import ConversionError
from .pdf_core import Document, Name, Reader, Ref, Stream, Word

#: Glyph names that aren't their letter.
_GLYPHS = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "quoteright": "’", "quoteleft": "‘",
    "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "minus": "−", "period": ".", "slash": "/", "colon": ":", "semicolon": ";",
    "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@", "bracketleft": "[", "backslash": "\\", "bracketright": "]", "asciicircum": "^", "underscore": "_",
    "grave": "`", "braceleft": "{", "bar": "|", "braceright": "}", "asciitilde": "~", "bullet": "•", "endash": "–", "emdash": "—", "quotedblleft": "“", "quotedblright": "”",
    "ellipsis": "…", "fi": "fi", "fl": "fl", "ff": "ff", "ffi": "ffi", "ffl": "ffl", "germandbls": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "oslash": "ø", "Oslash": "Ø",
    "copyright": "©", "registered": "®", "trademark": "™", "degree": "°", "section": "§", "paragraph": "¶", "Euro": "€", "sterling": "£", "yen": "¥", "multiply": "×", "divide": "÷",
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "dotlessi": "ı", "mu": "µ", "nbspace": " ",
}
_ACCENTS = {"acute": "́", "grave": "̀", "circumflex": "̂", "dieresis": "̈", "tilde": "̃", "ring": "̊", "cedilla": "̧", "caron": "̌", "breve": "̆", "ogonek": "̨", "macron": "̄"}
Matrix = tuple[float, float, float, float, float, float]
IDENTITY: Matrix = (1, 0, 0, 1, 0, 0)
MOST_CHARS, FORMS = 2_000_000, 12


def times(a: Matrix, b: Matrix) -> Matrix:
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def glyph_text(name: str) -> str:
    if name in _GLYPHS:
        return _GLYPHS[name]
    base = name.split(".")[0]
    if len(base) == 1:
        return base
    if m := re.fullmatch(r"uni([0-9A-Fa-f]{4})+|u([0-9A-Fa-f]{4,6})", base):
        digits = base[3:] if base.startswith("uni") else base[1:]
        codes = [int(digits[i : i + 4], 16) for i in range(0, len(digits), 4)] if base.startswith("uni") else [int(m[2], 16)]
        return "".join(chr(c) for c in codes if 0 < c < 0x110000 and not 0xD800 <= c < 0xE000)
    for accent, sign in _ACCENTS.items():
        if base.endswith(accent) and len(base) == len(accent) + 1:
            return unicodedata.normalize("NFC", base[0] + sign)
    return _GLYPHS.get(base, "")


class Font:
    def __init__(self, doc: Document, info: dict):
        self.doc, kind = doc, str(doc.get(info.get("Subtype")) or "")
        self.wide = kind == "Type0"
        below = doc.dict(doc.list(info.get("DescendantFonts"))[0]) if self.wide and doc.list(info.get("DescendantFonts")) else info
        name = str(doc.get(info.get("BaseFont")) or "")
        flags = int(doc.number(doc.dict(below.get("FontDescriptor")).get("Flags")))
        low = name.lower()
        self.bold = "bold" in low or "black" in low or "heavy" in low or bool(flags & 1 << 18)
        self.italic = "italic" in low or "oblique" in low or bool(flags & 64)
        self.scale = doc.number(doc.list(info.get("FontMatrix"))[0], 0.001) if kind == "Type3" and doc.list(info.get("FontMatrix")) else 0.001
        self.unicode: dict[int, str] = {}
        self.lengths = {2} if self.wide else {1}
        cmap = doc.get(info.get("ToUnicode"))
        if isinstance(cmap, Stream):
            self._cmap(doc.decoded(cmap))
        self.widths, self.default = self._wide_widths(below) if self.wide else self._widths(info, below)
        self.codes = {} if self.wide else self._encoding(info)
        self.utf16 = self.wide and "UCS2" in str(doc.get(info.get("Encoding")) or "")

    def _widths(self, info: dict, below: dict) -> tuple[dict[int, float], float]:
        first = int(self.doc.number(info.get("FirstChar")))
        found = {first + n: self.doc.number(w) for n, w in enumerate(self.doc.list(info.get("Widths")))}
        return found, self.doc.number(self.doc.dict(below.get("FontDescriptor")).get("MissingWidth")) or (500.0 if not found else 0.0)

    def _wide_widths(self, below: dict) -> tuple[dict[int, float], float]:
        found, items, at = {}, self.doc.list(below.get("W")), 0
        while at + 1 < len(items):
            first, second = int(self.doc.number(items[at])), self.doc.get(items[at + 1])
            if isinstance(second, list):
                found |= {first + n: self.doc.number(w) for n, w in enumerate(second)}
                at += 2
            elif at + 2 < len(items):
                found |= dict.fromkeys(range(first, min(int(self.doc.number(second)), first + 65535) + 1), self.doc.number(items[at + 2]))
                at += 3
            else:
                break
        return found, self.doc.number(below.get("DW"), 1000.0)

    def _encoding(self, info: dict) -> dict[int, str]:
        encoding = self.doc.get(info.get("Encoding"))
        base = str(encoding if isinstance(encoding, Name) else self.doc.get(self.doc.dict(encoding).get("BaseEncoding")) or "")
        table = {"MacRomanEncoding": "mac_roman"}.get(base, "cp1252")
        codes = {n: bytes([n]).decode(table, "ignore") for n in range(32, 256)}
        at = 0
        for x in self.doc.list(self.doc.dict(encoding).get("Differences")):
            x = self.doc.get(x)
            if isinstance(x, int):
                at = x
            elif isinstance(x, Name):
                if text := glyph_text(x):
                    codes[at] = text
                at += 1
        return codes

    def _cmap(self, raw: bytes) -> None:
        r, stack = Reader(raw), []
        text = lambda b: b.decode("utf-16-be", "ignore") if isinstance(b, bytes) else ""
        while (x := r.next()) is not None:
            if not isinstance(x, Word):
                stack.append(x)
                continue
            if x == "endcodespacerange":
                self.lengths = {len(b) for b in stack if isinstance(b, bytes)} or self.lengths
            elif x == "endbfchar":
                self.unicode |= {int.from_bytes(a, "big"): text(b) for a, b in zip(stack[::2], stack[1::2], strict=False) if isinstance(a, bytes)}
            elif x == "endbfrange":
                for a, b, to in zip(stack[::3], stack[1::3], stack[2::3], strict=False):
                    if not isinstance(a, bytes) or not isinstance(b, bytes):
                        continue
                    lo, hi = int.from_bytes(a, "big"), min(int.from_bytes(b, "big"), int.from_bytes(a, "big") + 65535)
                    for n in range(lo, hi + 1):
                        if isinstance(to, list):
                            self.unicode[n] = text(to[n - lo]) if n - lo < len(to) else ""
                        elif isinstance(to, bytes) and to:
                            last = int.from_bytes(to[-2:], "big") + n - lo
                            self.unicode[n] = text(to[:-2] + (last & 0xFFFF).to_bytes(2, "big"))
            stack = []

    def shown(self, raw: bytes):
        """(text, width in text space of size 1, whether a one-byte space) of each code."""
        step = 1 if self.lengths == {1} else 2
        if not self.wide:
            step = 1
        for a in range(0, len(raw) - step + 1, step):
            code = int.from_bytes(raw[a : a + step], "big")
            text = self.unicode.get(code)
            if text is None:
                text = (chr(code) if self.utf16 and 32 <= code and not 0xD800 <= code < 0xE000 else "") if self.wide else self.codes.get(code, "")
            yield text, self.widths.get(code, self.default) * self.scale, step == 1 and code == 32


@dataclass(slots=True)
class Char:
    text: str
    x: float
    y: float
    right: float
    size: float
    bold: bool
    italic: bool


@dataclass
class Line:
    text: str
    y: float
    left: float
    right: float
    size: float
    bold: bool
    italic: bool = False


@dataclass
class Content:
    chars: list[Char] = field(default_factory=list)
    rules: list[tuple[float, float, float, float]] = field(default_factory=list)  # x0, y0, x1, y1, thin
    images: list[tuple[dict, Stream, Matrix]] = field(default_factory=list)
    undecoded: int = 0


class Interpreter:
    """Runs content streams: the operators that place text, lines, rectangles, images and forms."""

    def __init__(self, doc: Document, fonts: dict):
        self.doc, self.fonts, self.out = doc, fonts, Content()

    def run(self, raw: bytes, resources: dict, ctm: Matrix = IDENTITY, depth: int = 0) -> None:
        s = {"ctm": ctm, "font": None, "size": 0.0, "char": 0.0, "word": 0.0, "scale": 1.0, "lead": 0.0, "rise": 0.0, "mode": 0}
        stack, args, tm, line, path, at = [], [], IDENTITY, IDENTITY, [], (0.0, 0.0)
        r = Reader(raw)
        while (x := r.next()) is not None:
            if len(self.out.chars) > MOST_CHARS:
                raise ConversionError(f"a page has more than {MOST_CHARS} characters")
            if not isinstance(x, Word):
                args.append(x)
                if len(args) > 4096:
                    args = args[-64:]
                continue
            n = [a if isinstance(a, (int, float)) else 0.0 for a in args]
            if x == "q":
                stack.append(dict(s))
            elif x == "Q":
                s = stack.pop() if stack else s
            elif x == "cm" and len(n) >= 6:
                s["ctm"] = times(tuple(n[-6:]), s["ctm"])
            elif x == "BT":
                tm = line = IDENTITY
            elif x == "Tf" and len(args) >= 2:
                s["font"], s["size"] = self._font(resources, args[-2]), n[-1]
            elif x in ("Td", "TD") and len(n) >= 2:
                if x == "TD":
                    s["lead"] = -n[-1]
                tm = line = times((1, 0, 0, 1, n[-2], n[-1]), line)
            elif x == "Tm" and len(n) >= 6:
                tm = line = tuple(n[-6:])
            elif x in ("T*", "'", '"'):
                if x == '"' and len(n) >= 3:
                    s["word"], s["char"] = n[-3], n[-2]
                tm = line = times((1, 0, 0, 1, 0, -s["lead"]), line)
                if x != "T*" and args and isinstance(args[-1], bytes):
                    tm = self._show(args[-1], s, tm)
            elif x in ("TL", "Tc", "Tw", "Ts", "Tr") and n:
                s[{"TL": "lead", "Tc": "char", "Tw": "word", "Ts": "rise", "Tr": "mode"}[x]] = n[-1]
            elif x == "Tz" and n:
                s["scale"] = n[-1] / 100
            elif x == "Tj" and args and isinstance(args[-1], bytes):
                tm = self._show(args[-1], s, tm)
            elif x == "TJ" and args and isinstance(args[-1], list):
                for a in args[-1]:
                    if isinstance(a, bytes):
                        tm = self._show(a, s, tm)
                    elif isinstance(a, (int, float)):
                        tm = times((1, 0, 0, 1, -a / 1000 * s["size"] * s["scale"], 0), tm)
            elif x == "m" and len(n) >= 2:
                at = (n[-2], n[-1])
            elif x == "l" and len(n) >= 2:
                path.append((*at, n[-2], n[-1]))
                at = (n[-2], n[-1])
            elif x == "re" and len(n) >= 4:
                a, b, w, h = n[-4:]
                thin = min(abs(w), abs(h)) < 3
                path += [(a, b + h / 2, a + w, b + h / 2) if abs(h) < 3 else (a + w / 2, b, a + w / 2, b + h)] if thin else [(a, b, a + w, b), (a, b + h, a + w, b + h), (a, b, a, b + h), (a + w, b, a + w, b + h)]
            elif x in ("S", "s", "f", "F", "f*", "B", "B*", "b", "b*", "n"):
                if x != "n":
                    self._rules(path, s["ctm"])
                path = []
            elif x == "Do" and args:
                self._object(resources, args[-1], s["ctm"], depth)
            elif x == "gs" and args:
                own = self.doc.dict(self.doc.dict(resources.get("ExtGState")).get(str(args[-1])))
                if (f := self.doc.list(own.get("Font"))) and len(f) == 2:
                    s["font"], s["size"] = self._load(f[0]), self.doc.number(f[1])
            elif x == "BI":
                end = re.compile(rb"[\s]EI(?=[\s]|\Z)").search(raw, r.at)
                r.at = end.end() if end else len(raw)
            args = []

    def _font(self, resources: dict, name) -> Font | None:
        return self._load(self.doc.dict(resources.get("Font")).get(str(name)))

    def _load(self, ref) -> Font | None:
        key = ref.number if isinstance(ref, Ref) else id(ref)
        if key not in self.fonts:
            info = self.doc.dict(ref)
            self.fonts[key] = Font(self.doc, info) if info else None
        return self.fonts[key]

    def _rules(self, path: list, ctm: Matrix) -> None:
        for x0, y0, x1, y1 in path:
            a, b = (x0 * ctm[0] + y0 * ctm[2] + ctm[4], x0 * ctm[1] + y0 * ctm[3] + ctm[5]), (x1 * ctm[0] + y1 * ctm[2] + ctm[4], x1 * ctm[1] + y1 * ctm[3] + ctm[5])
            if abs(a[0] - b[0]) < 1.5 or abs(a[1] - b[1]) < 1.5:
                self.out.rules.append((min(a[0], b[0]), min(a[1], b[1]), max(a[0], b[0]), max(a[1], b[1])))

    def _object(self, resources: dict, name, ctm: Matrix, depth: int) -> None:
        s = self.doc.get(self.doc.dict(resources.get("XObject")).get(str(name)))
        if not isinstance(s, Stream):
            return
        kind = str(self.doc.get(s.info.get("Subtype")))
        if kind == "Image":
            self.out.images.append((s.info, s, ctm))
        elif kind == "Form" and depth < FORMS:
            own = [self.doc.number(v) for v in self.doc.list(s.info.get("Matrix"))]
            self.run(self.doc.decoded(s), self.doc.dict(s.info.get("Resources")) or resources, times(tuple(own), ctm) if len(own) == 6 else ctm, depth + 1)

    def _show(self, raw: bytes, s: dict, tm: Matrix) -> Matrix:
        """Places the characters of a string: along it only the origin moves, by steps of the text's own axis."""
        font, size, scale = s["font"], s["size"], s["scale"]
        if not font:
            return tm
        axes = times(tm, s["ctm"])
        x, y = axes[4] + s["rise"] * axes[2], axes[5] + s["rise"] * axes[3]
        height = max(abs(size) * (axes[2] ** 2 + axes[3] ** 2) ** 0.5, 0.01)
        wide, moved, put = size * scale, 0.0, self.out.chars.append
        for text, width, space in font.shown(raw):
            if text:
                left = x + moved * axes[0]
                put(Char(text, left, y + moved * axes[1], left + width * wide * axes[0], height, font.bold, font.italic))
            else:
                self.out.undecoded += 1
            moved += width * wide + (s["char"] + (s["word"] if space else 0)) * scale
        return times((1, 0, 0, 1, moved, 0), tm)


def lines_of(chars: list[Char]) -> list[Line]:
    """Characters by height, then from left to right; a gap of a seventh of the size is a space. Two columns, if a page has
    them, are read one after the other between lines that span both."""
    chars = [c for c in chars if c.text.strip() or c.text == " "]
    if not chars:
        return []
    rows = _rows(chars)
    gutter = _gutter(rows)
    lines = []
    for row in rows:
        row.sort(key=lambda c: c.x)
        parts = [[c for c in row if c.x < gutter], [c for c in row if c.x >= gutter]] if gutter and _apart(row, gutter) else [row]
        lines += [_line(p) for p in parts if any(c.text.strip() for c in p)]
    return _by_column(lines, gutter) if gutter else lines


def _apart(row: list[Char], gutter: float) -> bool:
    left, right = [c.right for c in row if c.x < gutter], [c.x for c in row if c.x >= gutter]
    return bool(left and right) and min(right) - max(left) > 0.8 * row[0].size


def _gutter(rows: list[list[Char]]) -> float:
    """Where most rows leave a gap near the middle; 0 if they don't."""
    left, right = min(c.x for r in rows for c in r), max(c.right for r in rows for c in r)
    if right - left < 200 or len(rows) < 8:
        return 0.0
    bins, width = [0] * 200, (right - left) / 200
    for row in rows:
        covered = set()
        for c in row:
            if c.text.strip():
                covered.update(range(max(0, int((c.x - left) / width)), min(199, int((c.right - left) / width)) + 1))
        for b in covered:
            bins[b] += 1
    body = sorted(bins)[150]
    at = min(range(70, 131), key=lambda b: (bins[b], abs(b - 100)))
    return left + (at + 0.5) * width if body >= 6 and bins[at] <= 0.3 * body else 0.0


def _by_column(lines: list[Line], gutter: float) -> list[Line]:
    out: list[Line] = []
    band: list[Line] = []
    for line in [*lines, None]:
        if line is None or line.left < gutter < line.right:
            out += [x for x in band if x.left < gutter] + [x for x in band if x.left >= gutter]
            band = []
            if line:
                out.append(line)
        else:
            band.append(line)
    return out


def _line(row: list[Char]) -> Line:
    text, last = "", None
    for c in row:
        if last and c.x - last.right > 0.15 * c.size and not text.endswith(" ") and c.text != " ":
            text += " "
        if last and c.text == last.text and abs(c.x - last.x) < 0.1 * c.size and c.text.strip():
            continue  # shadows and fake bold
        text += c.text
        last = c
    marks = [c for c in row if c.text.strip()]
    size = Counter(round(c.size, 1) for c in marks).most_common(1)[0][0]
    return Line(re.sub(r" {2,}", " ", text).strip(), row[0].y, marks[0].x, marks[-1].right, size, sum(c.bold for c in marks) * 2 > len(marks), sum(c.italic for c in marks) * 2 > len(marks))


@dataclass
class Table:
    rows: list[list[str]]
    box: tuple[float, float, float, float]


def ruled_tables(rules: list[tuple[float, float, float, float]], chars: list[Char]) -> list[Table]:
    """Grids of horizontal and vertical rules that touch; cells get the characters within them."""
    flat = [r for r in rules if r[2] - r[0] >= 8 and r[3] - r[1] < 1.5]
    tall = [r for r in rules if r[3] - r[1] >= 5 and r[2] - r[0] < 1.5]
    if len(flat) < 2 or len(tall) < 2 or len(flat) * len(tall) > 4_000_000:
        return []
    groups = _touching(flat, tall)
    out = []
    for hs, vs in groups:
        ys, xs = _clustered([h[1] for h in hs])[::-1], _clustered([v[0] for v in vs])
        if len(ys) < 2 or len(xs) < 3 and len(ys) < 3 or len(xs) < 2:
            continue
        inside = [c for c in chars if xs[0] - 1 <= (c.x + c.right) / 2 <= xs[-1] + 1 and ys[-1] - 1 <= c.y + c.size * 0.3 <= ys[0] + 1]
        rows = []
        for top, low in zip(ys, ys[1:], strict=False):
            cells = [[c for c in inside if a <= (c.x + c.right) / 2 < b and low <= c.y + c.size * 0.3 < top] for a, b in zip(xs, xs[1:], strict=False)]
            rows.append([" ".join(x.text for x in lines_of(c)).replace("|", "\\|") for c in cells])
        if any(any(r) for r in rows):
            out.append(Table(rows, (xs[0], ys[-1], xs[-1], ys[0])))
    return out


def aligned_tables(chars: list[Char]) -> list[Table]:
    """Tables without rules: at least three rows that follow closely, of short cells whose left edges stand below each other
    in two columns or more. Lines that go on below cells, but not below the first, belong to their row. Pages of two text
    columns have none."""
    marks = [c for c in chars if c.text.strip()]
    if len(marks) < 12:
        return []
    rows = _rows(chars)
    split = [_cells(sorted(r, key=lambda c: c.x)) for r in rows]
    parted = [len(cells) for cells in split if len(cells) >= 2]
    if _gutter(rows) and (not parted or median_high(parted) == 2):  # rows of three cells aren't two columns of text
        return []
    out, block = [], []
    for cells in [*split, None]:
        if cells and block and _goes_on(block[-1], cells):
            block[-1] = _longer(block[-1], cells)
            continue
        if cells and len(cells) >= 2 and all(len(c[2]) <= 40 for c in cells) and (not block or _below(block[-1], cells)):
            block.append(cells)
            continue
        if len(block) >= 3:
            out.append(_aligned(block))
        block = [cells] if cells and len(cells) >= 2 and all(len(c[2]) <= 40 for c in cells) else []
    return [t for t in out if t]


def _rows(chars: list[Char]) -> list[list[Char]]:
    kept = [c for c in chars if c.text.strip() or c.text == " "]
    tolerance = 0.4 * median_high(c.size for c in kept)
    rows: list[list[Char]] = []
    for c in sorted(kept, key=lambda c: (-c.y, c.x)):
        if rows and abs(rows[-1][0].y - c.y) <= tolerance:
            rows[-1].append(c)
        else:
            rows.append([c])
    return rows


def _cells(row: list[Char]) -> list[tuple[float, float, str, list[Char]]]:
    """(left, right, text, characters) of parts with a wide gap between."""
    parts: list[list[Char]] = []
    for c in (c for c in row if c.text.strip()):
        if parts and c.x - parts[-1][-1].right <= 1.5 * c.size:
            parts[-1].append(c)
        else:
            parts.append([c])
    return [(p[0].x, p[-1].right, _line(p).text, p) for p in parts]


def _under(above: list, cells: list, factor: float) -> bool:
    """Whether a line is no further below a row's lowest one than so many sizes."""
    lowest, second = min((c for a in above for c in a[3]), key=lambda c: c.y), cells[0][3][0]
    return 0 < lowest.y - second.y <= factor * max(lowest.size, second.size)


def _goes_on(above: list, cells: list) -> bool:
    """Whether a line's cells stand below some of a row's, its first not among them, and close."""
    return len(cells) < len(above) and _under(above, cells, 1.3) and all(any(abs(a[0] - b[0]) < 4 for a in above[1:]) for b in cells)


def _longer(above: list, cells: list) -> list:
    """A row with a line of cells put to those above them."""
    out = list(above)
    for left, right, text, chars in cells:
        k = next(k for k, a in enumerate(above) if k and abs(a[0] - left) < 4)
        out[k] = (out[k][0], max(out[k][1], right), f"{out[k][2]} {text}", out[k][3] + chars)
    return out


def barred_tables(rules: list, chars: list[Char]) -> list[Table]:
    """Tables between rules that only run across: three or more of one left and right edge, none that stand up between them."""
    bars: dict[tuple, set[float]] = {}
    for x0, y0, x1, y1 in rules:
        if y1 - y0 < 1.5 and x1 - x0 > 60:
            bars.setdefault((round(x0 / 3), round(x1 / 3)), set()).add(round((y0 + y1) / 2, 1))
    out = []
    for (left, right), heights in bars.items():
        low, top = min(heights), max(heights)
        inside = [c for c in chars if 3 * left - 3 <= c.x <= 3 * right + 3 and low - 1 <= c.y <= top]
        if len(_clustered(list(heights))) < 3 or len([c for c in inside if c.text.strip()]) < 4:
            continue
        if any(x1 - x0 < 1.5 and 3 * left - 3 <= x0 <= 3 * right + 3 and y0 < top and y1 > low for x0, y0, x1, y1 in rules):
            continue
        rows: list = []
        for cells in (_cells(sorted(r, key=lambda c: c.x)) for r in _rows(inside)):
            if cells and rows and _goes_on(rows[-1], cells):
                rows[-1] = _longer(rows[-1], cells)
            elif cells:
                rows.append(cells)
        if len(rows) >= 2 and (made := _aligned(rows)):
            out.append(made)
    return out


def _below(above: list, cells: list) -> bool:
    near = _under(above, cells, 2.2)
    return near and sum(any(abs(a[0] - b[0]) < 4 or abs(a[1] - b[1]) < 4 for a in above) for b in cells) >= 2


def _aligned(block: list) -> Table | None:
    lefts = _clustered([c[0] for row in block for c in row])
    columns = [x for n, x in enumerate(lefts) if not n or x - lefts[n - 1] > 12]
    if not 2 <= len(columns) <= 40:
        return None
    rows = []
    for row in block:
        out = [""] * len(columns)
        for left, _, value, _ in row:
            n = max((k for k, x in enumerate(columns) if x <= left + 4), default=0)
            out[n] = f"{out[n]} {value}".strip().replace("|", "\\|")
        rows.append(out)
    if sum(c != "" for r in rows for c in r) < 0.6 * len(rows) * len(columns):
        return None
    every = [c for row in block for cell in row for c in cell[3]]
    return Table(rows, (min(c.x for c in every), min(c.y for c in every) - 1, max(c.right for c in every), max(c.y + c.size for c in every)))


def _touching(flat: list, tall: list) -> list[tuple[list, list]]:
    """Rules joined where one crosses or meets another."""
    root = list(range(len(flat) + len(tall)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    order = sorted(range(len(tall)), key=lambda j: tall[j][0])
    places = [tall[j][0] for j in order]
    for i, h in enumerate(flat):
        for j in order[bisect_left(places, h[0] - 2) : bisect_right(places, h[2] + 2)]:
            if tall[j][1] - 2 <= h[1] <= tall[j][3] + 2:
                root[top(i)] = top(len(flat) + j)
    groups: dict[int, tuple[list, list]] = {}
    for i, r in enumerate([*flat, *tall]):
        groups.setdefault(top(i), ([], []))[i >= len(flat)].append(r)
    return [g for g in groups.values() if len(g[0]) >= 2 and len(g[1]) >= 2]


def _clustered(values: list[float]) -> list[float]:
    out: list[float] = []
    for v in sorted(values):
        if not out or v - out[-1] > 3:
            out.append(v)
    return out
