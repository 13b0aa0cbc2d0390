"""Hangul documents of XML parts (.hwpx)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

from . import images, xml
from .base import ConversionError, Image, Options, Page, Pages
from .hwp import BODY, render_table
from .package import emphasised
from .xml import Node

DEPTH = 64


class Hwpx:
    def __init__(self, data: bytes, options: Options):
        self.z, self.options = xml.package(data), options
        if self.z.has("mimetype") and b"hwp+zip" not in self.z.read("mimetype"):
            raise ConversionError("not an HWPX document")
        head = xml.part(self.z, "Contents/header.xml")
        self.chars = {xml.attribute(c, "id"): (xml.number(xml.attribute(c, "height"), BODY), xml.child(c, "bold") is not None, xml.child(c, "italic") is not None) for c in xml.every(head, "charPr")}
        self.outlines = {}
        for p in xml.every(head, "paraPr"):
            h = next(xml.every(p, "heading"), None)
            if xml.attribute(h, "type") == "OUTLINE":
                self.outlines[xml.attribute(p, "id")] = xml.number(xml.attribute(h, "level")) + 1
        self.media = {xml.attribute(i, "id"): xml.attribute(i, "href") for i in xml.every(xml.part(self.z, "Contents/content.hpf"), "item")}

    def sections(self) -> list[str]:
        found = [(int(m[1]), n) for n in self.z.names("Contents/section") if (m := re.fullmatch(r"Contents/section(\d+)\.xml", n))]
        return [n for _, n in sorted(found)]

    def section(self, part: str, number: int) -> Page:
        page, edges = Page(number, "", 595.28, 841.88), []
        root = xml.part(self.z, part)
        heights = Counter(self.chars.get(xml.attribute(r, "charPrIDRef"), (BODY, False, False))[0] for r in xml.every(root, "run"))
        body = max(heights, key=lambda s: (heights[s], -s), default=BODY)
        page.body_font_size = body / 100
        out = [self._paragraph(p, page, body, edges) for p in (root if root is not None else ()) if xml.local(p) == "p"]
        page.text = "".join(edges) + "".join(out)
        return page

    def _paragraph(self, node: Node, page: Page, body: int, edges: list[str], depth: int = 0) -> str:
        if depth > DEPTH:
            return ""
        before, after, runs, sizes = [], [], [], Counter()
        for run in (x for x in node if xml.local(x) == "run"):
            size, bold, italic = self.chars.get(xml.attribute(run, "charPrIDRef"), (BODY, False, False))
            for x in run:
                kind = xml.local(x)
                if kind == "t":
                    text = "".join(_inline(x))
                    if text:
                        runs.append((text, bold, italic))
                        sizes[size] += len(text)
                elif kind == "tbl":
                    before.append(self._table(x, page, body, edges, depth))
                elif kind == "pic":
                    before.append(self._picture(x, page))
                elif kind == "ctrl":
                    for c in x:
                        texts = list(self._lists(c, page, body, edges, depth))
                        (edges if xml.local(c) in ("header", "footer") else after if xml.local(c) in ("footNote", "endNote") else before).extend(texts)
                else:
                    before += self._lists(x, page, body, edges, depth)
        level = self.outlines.get(xml.attribute(node, "paraPrIDRef"), 0)
        size = max(sizes, key=lambda s: (sizes[s], -s), default=body)
        if not level and body:
            level = next((n for n, least in ((1, 2.0), (2, 1.6), (3, 1.3)) if size >= least * body), 0)
        text = emphasised(runs, marks=not level).strip()
        mark = "\n" if xml.attribute(node, "pageBreak") == "1" else ""
        return mark + "".join(before) + (f"{'#' * min(level, 6)} {text}\n\n" if level and text else f"{text}\n\n" if text else "") + "".join(after)

    def _lists(self, node: Node, page: Page, body: int, edges: list[str], depth: int) -> Iterator[str]:
        for s in xml.every(node, "subList"):
            for p in s:
                if xml.local(p) == "p":
                    yield self._paragraph(p, page, body, edges, depth + 1)

    def _table(self, node: Node, page: Page, body: int, edges: list[str], depth: int) -> str:
        """Cells by their address; nested tables come after as text."""
        rows, columns = min(xml.number(xml.attribute(node, "rowCnt")), 65535), min(xml.number(xml.attribute(node, "colCnt")), 1024)
        grid = [[""] * columns for _ in range(rows)]
        for tr in (x for x in node if xml.local(x) == "tr"):
            for tc in (x for x in tr if xml.local(x) == "tc"):
                at = xml.child(tc, "cellAddr")
                r, c = xml.number(xml.attribute(at, "rowAddr"), -1), xml.number(xml.attribute(at, "colAddr"), -1)
                text = "<br>".join(t.strip().replace("\n", "<br>") for t in self._lists(tc, page, body, edges, depth) if t.strip())
                if 0 <= r < rows and 0 <= c < columns:
                    grid[r][c] = text.replace("|", "\\|")
        caption = "".join(self._lists(xml.child(node, "caption"), page, body, edges, depth)) if xml.child(node, "caption") is not None else ""
        return caption + render_table(grid, page, self.options)

    def _picture(self, node: Node, page: Page) -> str:
        part = self.media.get(xml.attribute(next(xml.every(node, "img"), None), "binaryItemIDRef"), "")
        e = self.z.by_name.get(part) or self.z.by_name.get(f"Contents/{part}")
        if not e or not self.options.images:
            return ""
        image = Image(page.page_number, f"page{page.page_number}_img{len(page.images)}", images.format_of_extension(images.extension(part)), self.z.read(e.name))
        image.width, image.height = images.dimensions(image.data)
        if not images.wanted(image, self.options):
            return ""
        page.images.append(image)
        return f"![{image.name}]({images.reference(image, self.options, images.extension(part))})\n\n"


def _inline(node: Node) -> Iterator[str]:
    yield node.text or ""
    for x in node:
        yield {"tab": "\t", "lineBreak": "\n", "nbSpace": " ", "fwSpace": " ", "hyphen": "-"}.get(xml.local(x), "")
        yield x.tail or ""


def pages(data: bytes, options: Options = Options()) -> Pages:
    """Sections; `pages` selects them from 0."""
    doc = Hwpx(data, options)
    for n, part in enumerate(doc.sections()):
        if options.wants(n):
            yield doc.section(part, n + 1)


def markdown(data: bytes, options: Options = Options()) -> str:
    return "\n".join(f"--- Page {p.page_number} ---\n\n{p.text}" for p in pages(data, options))
