"""PDF documents to pages and Markdown: headings by the most common font size, tables, links, notes, bookmarks, attachments."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

from . import ccitt, images, jbig2, png
from .base import ConversionError, Image, Options, Page, Pages
from .markdown import padded_table
from .package import human_bytes, single_line
from .pdf_core import Document, Ref, Stream
from .pdf_images import Placed, stitched
from .pdf_text import Interpreter, Line, Table, aligned_tables, barred_tables, lines_of, ruled_tables

_NUMBER = re.compile(r"^(?:[-–—]\s*)?(?:\d{1,4}|[ivxlcdmIVXLCDM]{1,8}|[ⅰ-ⅿⅠ-Ⅿ]{1,6})(?:\s*[-–—])?$")
_SECTION = re.compile(r"^(\d+(?:\.\d+)*)\.?\s+\S")
PAGES_DEEP, OUTLINE_DEEP, MOST_NODES = 256, 20, 65536
_CODED = {"DCTDecode": "jpeg", "DCT": "jpeg", "JPXDecode": "jp2", "CCITTFaxDecode": "ccitt", "CCF": "ccitt", "JBIG2Decode": "jbig2"}


def _few(items, what: str):
    """The items; an error if a file has more of them than it may."""
    if len(items) > MOST_NODES:
        raise ConversionError(f"more than {MOST_NODES} {what}")
    return items


@dataclass
class Laid:
    """A page before it is rendered."""

    number: int
    width: float
    height: float
    lines: list[Line] = field(default_factory=list)
    tables: list[Table] = field(default_factory=list)
    images: list[Image] = field(default_factory=list)
    places: list[float] = field(default_factory=list)
    links: list[tuple[str, str]] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)
    undecoded: int = 0
    degraded: int = 0


class Pdf:
    def __init__(self, data: bytes, options: Options):
        self.doc, self.options, self.fonts = Document(data), options, {}
        self.pages = list(self._tree(self.doc.dict(self.doc.trailer.get("Root")).get("Pages")))
        if not self.pages:
            self.pages = [(d, Ref(n, 0), {}) for n in sorted(self.doc.at) if (d := self.doc.dict(Ref(n, 0))).get("Type") == "Page"]
        if not self.pages:
            raise ConversionError("no pages in document")

    def _tree(self, ref, above: dict | None = None, seen: frozenset = frozenset(), depth: int = 0) -> Iterator[tuple[dict, object, dict]]:
        node, key = self.doc.dict(ref), ref.number if isinstance(ref, Ref) else id(ref)
        if not node or key in seen or depth > PAGES_DEEP:
            return
        own = {**(above or {}), **{k: node[k] for k in ("MediaBox", "CropBox", "Rotate", "Resources") if k in node}}
        if "Kids" in node:
            for kid in self.doc.list(node["Kids"]):
                yield from self._tree(kid, own, seen | {key}, depth + 1)
        else:
            yield node, ref, own

    def wanted(self) -> list[int]:
        """Pages from 0 in the order asked for, all if none is."""
        return [p for p in self.options.pages if p < len(self.pages)] if self.options.pages else list(range(len(self.pages)))

    def laid(self, n: int) -> Laid:
        node, _, own = self.pages[n]
        box = [self.doc.number(v) for v in self.doc.list(own.get("MediaBox"))]
        box = box if len(box) == 4 else [0, 0, 612, 792]
        page = Laid(n + 1, abs(box[2] - box[0]), abs(box[3] - box[1]))
        if int(self.doc.number(own.get("Rotate"))) % 180:
            page.width, page.height = page.height, page.width
        parts = self.doc.get(node.get("Contents"))
        raw = b"\n".join(self.doc.decoded(s) for p in (parts if isinstance(parts, list) else [parts]) if isinstance(s := self.doc.get(p), Stream))
        run = Interpreter(self.doc, self.fonts)
        run.run(raw, self.doc.dict(own.get("Resources")))
        page.undecoded = run.out.undecoded
        if self.options.tables and not self.options.plain:
            page.tables = ruled_tables(run.out.rules, run.out.chars)
            page.tables += barred_tables(run.out.rules, [c for c in run.out.chars if not any(_inside(c, t) for t in page.tables)])
            page.tables += aligned_tables([c for c in run.out.chars if not any(_inside(c, t) for t in page.tables)] if page.tables else run.out.chars)
        free = [c for c in run.out.chars if not any(_inside(c, t) for t in page.tables)] if page.tables else run.out.chars
        page.lines = lines_of(free)
        if self.options.images:
            self._images(run.out.images, page)
        self._annotations(node, page)
        return page

    def _images(self, found: list, page: Laid) -> None:
        seen, read = set(), []
        for info, stream, ctm in found:
            if id(stream) in seen:
                continue
            seen.add(id(stream))
            wide, high = int(self.doc.number(info.get("Width"))), int(self.doc.number(info.get("Height")))
            names = self.doc.get(info.get("Filter"))
            last = str(self.doc.get((names if isinstance(names, list) else [names])[-1])) if names else ""
            data, kind = self.doc.decoded(stream), _CODED.get(last, "bin")
            if kind == "ccitt":
                data, kind = self._unfaxed(info, data, wide, high), "bin"
            elif kind == "jbig2" and (pixels := self._unjbigged(info, data, wide, high)):
                data, kind = pixels, "bin"
            samples = self._samples(info, data, wide, high) if kind == "bin" else None
            read.append((Placed(ctm, wide, high, *samples) if samples else None, Image(0, "", kind, data, wide, high), ctm))
        for picture, image, ctm in stitched(read):
            image.page_number, image.name = page.number - 1, f"page{page.number}_img{len(page.images)}"
            if not images.wanted(image, self.options):
                continue
            if picture and (made := png.encoded(picture.wide, picture.high, picture.channels, picture.samples)):
                image.data, image.format = made, "png"
            page.degraded += image.format in ("bin", "jbig2")
            if image.data:
                page.images.append(image)
                page.places.append(ctm[5])

    def _unjbigged(self, info: dict, data: bytes, wide: int, high: int) -> bytes:
        parms = self.doc.get(info.get("DecodeParms"))
        shared = self.doc.get(self.doc.dict(parms[-1] if isinstance(parms, list) and parms else parms).get("JBIG2Globals"))
        try:
            found = jbig2.decoded(data, self.doc.decoded(shared) if isinstance(shared, Stream) else b"", wide, high)
        except jbig2.Unsupported:
            return b""
        return found.translate(bytes(range(255, -1, -1)))  # a bit that is set is white in pictures of PDF files

    def _unfaxed(self, info: dict, data: bytes, wide: int, high: int) -> bytes:
        parms = self.doc.get(info.get("DecodeParms"))
        own = self.doc.dict(parms[-1] if isinstance(parms, list) and parms else parms)
        columns, truth = int(self.doc.number(own.get("Columns"), 1728)), lambda name: self.doc.get(own.get(name)) is True
        if not 0 < columns <= 1 << 16 or columns * high > png.MOST_PIXELS:
            return b""
        rows, n = ccitt.decoded(data, columns, high, int(self.doc.number(own.get("K"), 0)), truth("EncodedByteAlign"), truth("BlackIs1"))
        white = (b"\0" if truth("BlackIs1") else b"\xff") * ((columns + 7) // 8)
        return rows + white * (high - n)  # a damaged picture is white from there on

    def _samples(self, info: dict, data: bytes, wide: int, high: int) -> tuple[int, bytes] | None:
        """Channels (1 grey, 3 colours, 4 colours and alpha) and samples of a picture in grey, colours, print colours or a
        palette, with its soft mask; None for others."""
        bits = int(self.doc.number(info.get("BitsPerComponent"), 1 if self.doc.get(info.get("ImageMask")) else 8))
        space, palette = self.doc.get(info.get("ColorSpace")), b""
        if isinstance(space, list) and space and str(self.doc.get(space[0])) in ("Indexed", "I") and len(space) > 3:
            table = self.doc.get(space[3])
            palette = self.doc.decoded(table) if isinstance(table, Stream) else bytes(table or b"")
            space = self.doc.get(space[1])
            channels = 1
        else:
            channels = self._channels(space)
        if wide <= 0 or high <= 0 or wide * high > png.MOST_PIXELS or bits not in (1, 2, 4, 8, 16) or not channels:
            return None
        samples = data[::2] if bits == 16 else png.unpacked(data, wide * channels, high, bits)  # of 16 bits the upper ones
        if len(samples) < wide * high * channels:
            return None
        samples = samples[: wide * high * channels]
        flip = [self.doc.number(v) for v in self.doc.list(info.get("Decode"))][:2] == [1, 0]
        if palette:
            colours = self._channels(space)
            one = [_rgb(palette[colours * n : colours * (n + 1)].ljust(colours, b"\0")) for n in range(256)]
            channels, samples = 3, b"".join(map(one.__getitem__, samples))
        elif bits < 8:
            full = (1 << bits) - 1
            samples = samples.translate(bytes((255 * (full - v if flip else v) // full) & 255 for v in range(full + 1)) + bytes(255 - full))
        elif flip:
            samples = samples.translate(bytes(range(255, -1, -1)))
        if channels == 4:
            channels, samples = 3, b"".join(_rgb(samples[a : a + 4]) for a in range(0, 4 * wide * high, 4))
        elif isinstance(space, list) and str(self.doc.get(space[0])) == "Lab":
            samples = b"".join(_lab(*samples[a : a + 3]) for a in range(0, 3 * wide * high, 3))
        mask = self.doc.get(info.get("SMask"))
        return self._masked(mask, wide, high, channels, samples) if isinstance(mask, Stream) and "SMask" not in mask.info else (channels, samples)

    def _masked(self, mask: Stream, wide: int, high: int, channels: int, samples: bytes) -> tuple[int, bytes]:
        """With the soft mask as alpha, its pixels taken from the nearest place where sizes differ."""
        across, down = int(self.doc.number(mask.info.get("Width"))), int(self.doc.number(mask.info.get("Height")))
        found = self._samples(mask.info, self.doc.decoded(mask), across, down)
        if not found or found[0] != 1:
            return channels, samples
        alpha = found[1]
        if (across, down) != (wide, high):
            columns = [x * across // wide for x in range(wide)]
            alpha = b"".join(bytes(row[x] for x in columns) for row in (alpha[(y * down // high) * across :][:across] for y in range(high)))
        out = bytearray(4 * wide * high)
        for c in range(3):
            out[c::4] = samples[c::3] if channels == 3 else samples
        out[3::4] = alpha
        return 4, bytes(out)

    def _channels(self, space) -> int:
        """Samples a pixel of a colour space; 0 if it isn't known."""
        if isinstance(space, list) and space:
            kind = str(self.doc.get(space[0]))
            if kind == "ICCBased" and len(space) > 1:
                return int(self.doc.number(self.doc.dict(space[1]).get("N"), 3))
            return {"CalGray": 1, "CalRGB": 3, "Lab": 3}.get(kind, 0)
        return {"DeviceGray": 1, "G": 1, "DeviceRGB": 3, "RGB": 3, "DeviceCMYK": 4, "CMYK": 4, "None": 1}.get(str(space), 0)

    def _annotations(self, node: dict, page: Laid) -> None:
        for ref in _few(self.doc.list(node.get("Annots")), "annotations"):
            a = self.doc.dict(ref)
            kind, text = str(self.doc.get(a.get("Subtype"))), pdf_string(self.doc.get(a.get("Contents")))
            uri = self.doc.get(self.doc.dict(a.get("A")).get("URI"))
            if kind == "Link" and isinstance(uri, bytes):
                box = [self.doc.number(v) for v in self.doc.list(a.get("Rect"))]
                label = " ".join(x.text for x in page.lines if len(box) == 4 and box[1] - 2 <= x.y <= box[3] + 2 and x.left < box[2] and x.right > box[0]) if len(box) == 4 else ""
                page.links.append((single_line(text or label), uri.decode("utf-8", "replace")))
            elif kind in ("Text", "FreeText", "Highlight", "Underline", "StrikeOut", "Popup") and text.strip():
                page.notes.append(single_line(text))

    def bookmarks(self) -> list[tuple[int, str, int]]:
        """(depth, title, page from 1 or 0) of the outline."""
        at = {ref.number: n + 1 for n, (_, ref, _) in enumerate(self.pages) if isinstance(ref, Ref)}
        out, seen = [], set()

        def walk(ref, depth: int) -> None:
            while ref is not None and depth <= OUTLINE_DEEP:
                node, key = self.doc.dict(ref), ref.number if isinstance(ref, Ref) else id(ref)
                if not node or key in seen:
                    return
                seen.add(key)
                _few(seen, "bookmarks")
                target = self.doc.get(node.get("Dest")) or self.doc.get(self.doc.dict(node.get("A")).get("D"))
                first = target[0] if isinstance(target, list) and target else None
                title = single_line(pdf_string(self.doc.get(node.get("Title"))))
                if title:
                    out.append((depth, title, at.get(first.number, 0) if isinstance(first, Ref) else 0))
                walk(node.get("First"), depth + 1)
                ref = node.get("Next")

        walk(self.doc.dict(self.doc.dict(self.doc.trailer.get("Root")).get("Outlines")).get("First"), 0)
        return out

    def attachments(self) -> list[tuple[str, int, str]]:
        """(name, size, description) of embedded files, each once."""
        root = self.doc.dict(self.doc.dict(self.doc.trailer.get("Root")).get("Names")).get("EmbeddedFiles")
        out, seen, todo = [], set(), [root]
        while todo:
            _few(seen, "attachments")
            ref = todo.pop(0)
            node, key = self.doc.dict(ref), ref.number if isinstance(ref, Ref) else id(ref)
            if not node or key in seen:
                continue
            seen.add(key)
            todo += self.doc.list(node.get("Kids"))
            for spec in self.doc.list(node.get("Names"))[1::2]:
                own = self.doc.dict(spec)
                name = single_line(pdf_string(self.doc.get(own.get("UF")) or self.doc.get(own.get("F"))))
                file = self.doc.get(self.doc.dict(own.get("EF")).get("F"))
                if name and isinstance(file, Stream) and id(file) not in seen:
                    seen.add(id(file))
                    size = int(self.doc.number(self.doc.dict(file.info.get("Params")).get("Size"))) or len(self.doc.decoded(file))
                    out.append((name, size, single_line(pdf_string(self.doc.get(own.get("Desc"))))))
        return out


def _inside(c, t: Table) -> bool:
    return t.box[0] - 1 <= (c.x + c.right) / 2 <= t.box[2] + 1 and t.box[1] - 1 <= c.y + c.size * 0.3 <= t.box[3] + 1


def _lab(light: int, a: int, b: int) -> bytes:
    """Of CIE L*a*b* (scaled to bytes, a and b around 128) the sRGB colour."""
    y = (light / 2.55 + 16) / 116
    x, z = y + (a - 128) / 500, y - (b - 128) / 200
    x, y, z = (w * (t**3 if t > 6 / 29 else (t - 4 / 29) * 108 / 841) for t, w in ((x, 0.9505), (y, 1.0), (z, 1.089)))
    linear = (3.2406 * x - 1.5372 * y - 0.4986 * z, -0.9689 * x + 1.8758 * y + 0.0415 * z, 0.0557 * x - 0.204 * y + 1.057 * z)
    return bytes(min(255, max(0, round(255 * (12.92 * v if v <= 0.0031308 else 1.055 * v ** (1 / 2.4) - 0.055)))) for v in linear)


def _rgb(sample: bytes) -> bytes:
    """Grey, colours or print colours as three bytes."""
    if len(sample) == 4:
        rest = 255 - sample[3]
        return bytes((255 - c) * rest // 255 for c in sample[:3])
    return sample * 3 if len(sample) == 1 else sample[:3]


def pdf_string(raw) -> str:
    if not isinstance(raw, bytes):
        return ""
    if raw[:2] in (b"\xfe\xff", b"\xff\xfe"):
        return raw.decode("utf-16", "replace")
    return raw[3:].decode("utf-8", "replace") if raw[:3] == b"\xef\xbb\xbf" else raw.decode("cp1252", "replace")


def modal_size(pages: list[Laid]) -> float:
    """The size that most characters of all pages have; of equals the smaller."""
    counts: Counter = Counter()
    for p in pages:
        for line in p.lines:
            counts[line.size] += len(line.text)
    return max(counts, key=lambda s: (counts[s], -s)) if counts else 0.0


def heading_level(line: Line, body: float) -> int:
    ratio = line.size / body if body else 1.0
    level = next((n for n, least in ((1, 1.8), (2, 1.5), (3, 1.3)) if ratio >= least), 3 if line.bold and ratio >= 1.1 else 0)
    if not level and line.bold and len(line.text) <= 120 and (m := _SECTION.match(line.text)):
        return min(m[1].count(".") + 3, 6)
    return level


def rendered(page: Laid, body: float, options: Options) -> str:
    """Lines with tables and images where they stand; wrapped headings joined; page numbers at the foot left out."""
    lines = list(page.lines)
    if lines:
        low = min(x.y for x in lines)
        lines = [x for n, x in enumerate(lines) if not ((x.y == low or n >= len(lines) - 2) and _NUMBER.match(x.text))]
    inserts = [(t.box[3], "\n" + padded_table(t.rows) + "\n") for t in page.tables]
    inserts += [(y, f"![{i.name}]({images.reference(i, options)})\n\n") for y, i in zip(page.places, page.images, strict=True)]
    inserts.sort(key=lambda x: -x[0])
    out, last = [], None
    for line in lines:
        while inserts and inserts[0][0] > line.y:
            out.append(("insert", inserts.pop(0)[1]))
            last = None
        level = heading_level(line, body)
        gap = last.y - line.y if last else 0.0
        if level and last and out[-1][0] == level and last.bold == line.bold and 0 < gap <= 1.5 * line.size:
            out[-1] = (level, out[-1][1] + " " + line.text)
        elif level:
            out.append((level, line.text))
        elif last and out[-1][0] == "text" and 0 < gap <= 1.6 * line.size:
            out[-1] = ("text", out[-1][1] + "\n" + line.text)
        else:
            out.append(("text", line.text))
        last = line
    out += [("insert", t) for _, t in inserts]
    text = "".join(t if kind == "insert" else f"{'#' * kind} {t}\n\n" if isinstance(kind, int) else f"{t}\n\n" for kind, t in out)
    if page.undecoded:
        text += f"<!-- {page.undecoded} characters could not be decoded -->\n"
    if page.links:
        text += "\n**Links:**\n" + "".join(f"- [{t}]({u})\n" if t else f"- <{u}>\n" for t, u in dict.fromkeys(page.links))
    if page.notes:
        text += "\n**Notes:**\n" + "".join(f"> {n}\n\n" for n in page.notes)
    return text


def _laid(pdf: Pdf) -> tuple[list[Laid], float]:
    by = {n: pdf.laid(n) for n in dict.fromkeys(pdf.wanted())}
    return [by[n] for n in pdf.wanted()], modal_size(list(by.values()))


def pages(data: bytes, options: Options = Options()) -> Pages:
    found, body = _laid(Pdf(data, options))
    for p in found:
        yield Page(p.number, rendered(p, body, options), p.width, p.height, body, [t.rows for t in p.tables], p.images, p.degraded)


def markdown(data: bytes, options: Options = Options()) -> str:
    pdf = Pdf(data, options)
    found, body = _laid(pdf)
    shown = {p.number for p in found}
    marks = [(d, t, n) for d, t, n in pdf.bookmarks() if not n or n in shown]
    out = "## Table of Contents\n\n" + "".join(f"{'  ' * d}- {t}" + (f" *(p.{n})*" if n else "") + "\n" for d, t, n in marks) + "\n" if marks else ""
    if files := pdf.attachments():
        out += "## Attachments\n\n" + "".join(f"- {n} ({human_bytes(s)})" + (f" — {d}" if d else "") + "\n" for n, s, d in files) + "\n"
    return out + "\n".join(f"--- Page {p.number} ---\n\n{rendered(p, body, options)}" for p in found)
