"""Word documents of old (.doc): the piece table's text, fields, cells and breaks, to Markdown by the look of lines."""

from __future__ import annotations

import re
import struct
from bisect import bisect_right

from ..containers.cfb import CompoundFile
from . import escher, images
from .base import ConversionError, Image, Options, Page, Pages
from .markdown import capped_lines, table as markdown_table

_ITEM = re.compile(r"^(?:[•·▪‣◦●○■\-\*]\s+)(.*)$")
_ORDERED = re.compile(r"^(\d{1,3})[.)]\s+(.*)$")
_LINK = re.compile(r'HYPERLINK\s+"([^"]*)"')
MOST_TEXT = 1 << 28
#: Operations on characters and paragraphs that count here: bold, and the paragraph that ends a table's row.
_BOLD, _ROW_END = 0x0835, 0x2417
#: Places in the header of the tables that lead to the pages of character and paragraph formats.
_CHARACTERS, _PARAGRAPHS = 0xFA, 0x102
#: What text_of puts where bold begins and ends, and for the mark that ends a row.
BOLD, PLAIN, ROW = "\ue0b0", "\ue0b1", "\ue0b2"


def _formatted(word: bytes, table: bytes, where: int, operation: int) -> list[tuple[int, int]]:
    """Ranges of the stream's bytes whose format has an operation switched on, in order, touching ones as one.

    A table of places leads to pages of 512 bytes; a page has bounds, for each range between two of them where its format
    is (0: none), and in its last byte their number.
    """
    paragraphs = where == _PARAGRAPHS
    at, size = struct.unpack_from("<II", word, where)
    n = (size - 4) // 8
    if n <= 0 or at + size > len(table):
        return []
    found: list[tuple[int, int]] = []
    for number in struct.unpack_from(f"<{n}I", table, at + 4 * (n + 1)):
        page = word[(number & 0x3FFFFF) * 512 :][:512]
        count = page[511] if len(page) == 512 else 0
        step = 13 if paragraphs else 1
        if not count or 4 * (count + 1) + step * count > 511:
            continue
        bounds = struct.unpack_from(f"<{count + 1}I", page)
        for k in range(count):
            place = 2 * page[4 * (count + 1) + step * k]
            if not place or place >= 510:
                continue
            length, begin = page[place], place + 1
            if paragraphs:  # twice the length less one, or twice the next byte; then the style's number
                length, begin = (2 * length - 3, place + 3) if length else (2 * page[place + 1] - 2, place + 4)
            if _switched_on(page[begin : begin + max(0, length)], operation):
                found.append((bounds[k], bounds[k + 1]))
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _switched_on(raw: bytes, operation: int) -> bool:
    at = 0
    while at + 2 < len(raw):
        (own,) = struct.unpack_from("<H", raw, at)
        if own == operation:
            return raw[at + 2] != 0
        kind = own >> 13
        at += 2 + ((1, 1, 2, 4, 2, 2, 1 + raw[at + 2], 3)[kind])
    return False


def _marked(text: str, place: int, unit: int, bold: list[tuple[int, int]], ends: list[tuple[int, int]]) -> str:
    """A piece's text with marks, given where its first byte is and how many bytes a character has."""
    last, marks = place + unit * len(text), []
    for ranges, begin, stop in ((bold, BOLD, PLAIN), (ends, "", "")):
        k = max(0, bisect_right(ranges, (place, 1 << 62)) - 1)
        while k < len(ranges) and ranges[k][0] < last:
            a, b = (max(place, ranges[k][0]) - place) // unit, (min(last, ranges[k][1]) - place + unit - 1) // unit
            k += 1
            if a >= b:
                continue
            if begin:
                marks += [(a, 1, begin), (b, 0, stop)]
            else:
                text = text[:a] + text[a:b].replace("\x07", ROW) + text[b:]
    out, at = [], 0
    for where, _, mark in sorted(marks):
        out += [text[at:where], mark]
        at = where
    return "".join(out) + text[at:]


def text_of(data: bytes) -> str:
    """All characters in order, from one piece or many, with marks where bold begins and ends, and for ends of rows."""
    try:
        f = CompoundFile(data)
    except ValueError as e:
        raise ConversionError("cannot open document") from e
    word = f.read("WordDocument")
    if len(word) < 32:
        raise ConversionError("no document stream")
    magic, version, _, _, _, flags = struct.unpack_from("<HHHHHH", word)
    if magic not in (0xA5EC, 0xA5DC, 0xA59B):
        raise ConversionError("not a Word document")
    if flags & 0x100:
        raise ConversionError("document is encrypted")
    if version < 0xC1 or len(word) < 0x1AA:
        first, last = struct.unpack_from("<II", word, 24)
        return word[first : min(last, len(word))].decode("cp1252", "replace")
    table = f.read("1Table" if flags & 0x200 else "0Table")
    where, size = struct.unpack_from("<II", word, 0x1A2)
    pieces, at = table[where : where + size], 0
    while at < len(pieces) and pieces[at] == 1:
        at += 3 + struct.unpack_from("<H", pieces, at + 1)[0]
    if at + 5 > len(pieces) or pieces[at] != 2:
        first, last = struct.unpack_from("<II", word, 24)
        return word[first : min(last, len(word))].decode("cp1252", "replace")
    length = struct.unpack_from("<I", pieces, at + 1)[0]
    body = pieces[at + 5 : at + 5 + length]
    n, out, total = (len(body) - 4) // 12, [], 0
    ends = struct.unpack_from(f"<{n + 1}I", body)
    main = sum(struct.unpack_from("<6I", word, 0x4C)) if len(word) >= 0x64 else 0
    main = main if 0 < main < ends[-1] else ends[-1]
    bold, rows = _formatted(word, table, _CHARACTERS, _BOLD), _formatted(word, table, _PARAGRAPHS, _ROW_END)
    for k in range(n):
        place, count = struct.unpack_from("<I", body, 4 * (n + 1) + 8 * k + 2)[0], max(0, min(ends[k + 1], main) - ends[k])
        total += count
        if total > MOST_TEXT:
            raise ConversionError("document too large")
        if place & 0x40000000:
            a = (place & 0x3FFFFFFF) // 2
            out.append(_marked(word[a : a + count].decode("cp1252", "replace"), a, 1, bold, rows))
        else:
            out.append(_marked(word[place : place + 2 * count].decode("utf-16-le", "replace"), place, 2, bold, rows))
    return "".join(out)


def plain(raw: str) -> str:
    """Fields as their results (links keep their target), breaks as lines, bold between stars within a line or cell, other
    controls left out."""
    out: list[str] = []
    bold = shown_bold = False
    fields: list[list] = []  # [code, whether in the result, place where the result begins]
    for c in raw:
        if c == "\x13":
            fields.append([[], False, 0])
        elif c == "\x14" and fields:
            fields[-1][1], fields[-1][2] = True, len(out)
        elif c == "\x15" and fields:
            code, shown, at = fields.pop()
            m = _LINK.search("".join(code))
            if m and shown and not fields:
                label = "".join(out[at:]).strip()
                del out[at:]
                out.append(f"[{label}]({m[1]})" if label else m[1])
        elif fields and not fields[-1][1]:
            fields[-1][0].append(c)
        elif c in (BOLD, PLAIN):
            bold = c == BOLD
        elif c in "\r\x0b\n\x07" or c == ROW:
            out += ["**"] * shown_bold + ["\x07" if c == "\x07" else "\x06" if c == ROW else "\n"]
            shown_bold = False
        elif c == "\x0c":
            out.append("\n\x0c\n")
        elif c == "\x1e":
            out.append("-")
        elif c == "\t" or c >= " ":
            out += ["**"] * (bold != shown_bold) + [c]
            shown_bold = bold
    return "".join(out + ["**"] * shown_bold)


def rendered(text: str) -> tuple[str, list[list[list[str]]]]:
    """Lines as headings, items, tables and paragraphs. A heading is short, alone between blank lines, without a stop."""
    out, tables, page = ["--- Page 1 ---\n\n"], [], 1
    cells = re.split(r"((?:[^\x06\x07]*[\x06\x07])+)", text) if "\x07" in text else [text]
    for part in cells:
        if "\x07" in part:
            ended = re.split(r"[\x06\x07]", part)[:-1]
            marks, told = re.findall(r"[\x06\x07]", part), "\x06" in part
            before, _, first = ended[0].rpartition("\n")
            if before:
                out += _lines(before, page)
            rows, row = [], []
            for n, (cell, mark) in enumerate(zip(ended, marks, strict=True)):
                value = (first if not n else cell).strip().replace("\n", " ").replace("|", "/")
                # where the formats tell which mark ends a row, cells may be empty; else an empty one ends it
                if mark == "\x06" if told else not value and row and cell == "":
                    rows.append([*row, value] if told and value else row)
                    row = []
                else:
                    row.append(value)
            rows += [row] if row else []
            tables.append(rows)
            out.append("\n" + markdown_table(rows) + "\n")
        else:
            for k, piece in enumerate(part.split("\x0c")):
                if k:
                    page += 1
                    out.append(f"\n--- Page {page} ---\n\n")
                out += _lines(piece, page)
    return capped_lines("".join(out)).strip("\n") + "\n", tables


def _lines(text: str, page: int) -> list[str]:
    lines, out = [x.strip() for x in text.split("\n")], []
    for n, line in enumerate(lines):
        alone = (n == 0 or not lines[n - 1]) and (n + 1 == len(lines) or not lines[n + 1])
        if not line:
            continue
        if m := _ITEM.match(line):
            out.append(f"- {m[1]}\n")
        elif m := _ORDERED.match(line):
            out.append(f"{m[1]}. {m[2]}\n")
        elif alone and len(lines) > 1 and len(line.encode()) <= 80 and not re.search(r"[.;,]$", line) and n + 1 < len(lines):
            out.append(f"## {line}\n\n")
        else:
            out.append(f"{line}\n\n")
    return out


def pictures(data: bytes, options: Options) -> list[Image]:
    """Inline pictures of the data stream: a size, a head of 68 bytes, then drawing records."""
    raw, found, at = CompoundFile(data).read("Data"), [], 0
    while options.images and at + 68 <= len(raw):
        size, head = struct.unpack_from("<IH", raw, at)
        if size < 68 or at + size > len(raw):
            break
        a = at + head
        for kind, _, x, y in escher.records(raw, a, at + size):
            inner = next(escher.records(raw, x + 36, y), None) if kind == 0xF007 else None
            if inner and (got := escher.blip(raw, *inner)):
                image = Image(1, f"page1_img{len(found)}", *got)
                image.width, image.height = images.dimensions(image.data)
                if images.wanted(image, options):
                    found.append(image)
        at += size
    return found


def pages(data: bytes, options: Options = Options()) -> Pages:
    """One page; a picture's mark in the text gives way to its reference, others follow the text."""
    raw = text_of(data)
    found = pictures(data, options)
    refs = [f"![{i.name}]({images.reference(i, options)})" for i in found]
    marks = iter(refs[: raw.count("\x01")])
    text, tables = rendered(plain("".join(next(marks, "") if c == "\x01" else c for c in raw)))
    text += "".join(f"\n{r}\n" for r in refs[raw.count("\x01") :])
    yield Page(1, text, 612.0, 792.0, 12.0, tables if options.tables else [], found)


def markdown(data: bytes, options: Options = Options()) -> str:
    return next(pages(data, options)).text
