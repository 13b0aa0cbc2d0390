"""Slide decks: shapes in tree order, one page a slide."""

from __future__ import annotations

import re
from collections.abc import Iterator

from . import xml
from .base import Options, Page, Pages
from .markdown import table as markdown_table
from .package import Media, attachments, emphasised
from .xml import Node

_FURNITURE = ("sldImg", "sldNum", "dt", "ftr")
_PROMPTS = ("", "title", "ctrTitle", "subTitle", "body", "pic", "chart", "tbl", "dgm", "media", "clipArt")


def paragraph(node: Node, marks: bool = True) -> str:
    """Runs by style; breaks are line feeds; fields are left out."""
    lines: list[list[tuple[str, bool, bool]]] = [[]]
    for x in node:
        kind = xml.local(x)
        if kind == "br":
            lines.append([])
        elif kind == "r" and (text := xml.joined(x, "t")):
            props = xml.child(x, "rPr")
            lines[-1].append((text, *(xml.attribute(props, k) not in ("", "0") for k in "bi")))
    return "\n".join(emphasised(line, marks) for line in lines)


def body_text(node: Node | None) -> str:
    return "\n".join(paragraph(p) for p in node if xml.local(p) == "p") if node is not None else ""


def _placeholder(shape: Node) -> Node | None:
    return xml.path(shape, "nvSpPr", "nvPr", "ph")


def _rows(tbl: Node) -> list[list[str]]:
    return [[" ".join(paragraph(p, marks=False) for p in xml.every(tc, "p")).replace("|", "/").replace("\n", " ") for tc in xml.every(tr, "tc")] for tr in xml.every(tbl, "tr")]


def _tree(root: Node | None) -> Node | None:
    return xml.path(root, "cSld", "spTree")


class Deck:
    def __init__(self, data: bytes, options: Options):
        self.z, self.options = xml.package(data), options
        self.media = Media(self.z, options)
        numbered = [(int(m[1]), n) for n in self.z.names("ppt/slides/slide") if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n))]
        self.slides = [n for _, n in sorted(numbered)]

    def _shapes(self, node: Node, rels: dict[str, str], depth: int = 0) -> Iterator[tuple[str, object]]:
        """(title|text|image|table, value) in tree order; of alternatives the choice."""
        if depth > xml.DEPTH:
            return
        for x in node:
            kind = xml.local(x)
            if kind in ("sp", "cxnSp"):
                text = body_text(xml.child(x, "txBody"))
                title = xml.attribute(_placeholder(x), "type") in ("title", "ctrTitle")
                if text:
                    yield ("title" if title else "text"), text
                yield from self._picture(x, rels)
                yield from (("table", rows) for t in xml.every(x, "tbl") if (rows := _rows(t)))
            elif kind == "pic":
                yield from self._picture(x, rels)
            elif kind == "graphicFrame":
                yield from (("table", rows) for t in xml.every(x, "tbl") if (rows := _rows(t)))
                for g in xml.every(x, "graphicData"):
                    for name, key, read in (("chart", "id", self._chart), ("relIds", "dm", self._diagram)):
                        target = rels.get(xml.attribute(xml.child(g, name), key), "")
                        if target and (text := read(xml.resolved("ppt/slides", target))):
                            yield "text", text
            elif kind in ("grpSp", "AlternateContent"):
                for inner in [x] if kind == "grpSp" else [c for c in x if xml.local(c) == "Choice"]:
                    yield from self._shapes(inner, rels, depth + 1)

    def _picture(self, node: Node, rels: dict[str, str]) -> Iterator[tuple[str, object]]:
        for b in xml.every(node, "blip"):
            target = rels.get(xml.attribute(b, "embed") or xml.attribute(b, "link"), "")
            if "media/" in target:
                yield "image", xml.resolved("ppt/slides", target)
            return

    def _chart(self, part: str) -> str:
        root = xml.part(self.z, part)
        title = xml.joined(next(xml.every(root, "title"), None), "t")
        cached = [t for c in xml.every(root, "strCache") for v in xml.every(c, "v") if (t := xml.text_of(v))]
        return "\n".join([*([f"**{title}**"] if title else []), *([", ".join(dict.fromkeys(cached))] if cached else [])])

    def _diagram(self, part: str) -> str:
        return "\n".join(t for p in xml.every(xml.part(self.z, part), "pt") if (t := xml.joined(p, "t").strip()))

    def _notes(self, rels: dict[str, str]) -> str:
        target = next((t for t in rels.values() if "notesSlide" in t), "")
        tree = _tree(xml.part(self.z, xml.resolved("ppt/slides", target))) if target else None
        found = [body_text(xml.child(s, "txBody")) for s in (tree if tree is not None else ()) if xml.local(s) == "sp" and xml.attribute(_placeholder(s), "type") not in _FURNITURE]
        return "\n".join(filter(None, found))

    def page(self, n: int) -> Page:
        part = self.slides[n - 1]
        rels = xml.relationships(self.z, part.replace("slides/", "slides/_rels/") + ".rels")
        tree = _tree(xml.part(self.z, part))
        title, out, page = "", [], Page(n, "", 720.0, 540.0)
        for kind, value in self._shapes(tree, rels) if tree is not None else ():
            if kind == "title":
                title = value
            elif kind == "text":
                out.append(f"{value}\n\n")
            elif kind == "table" and self.options.tables:
                page.tables.append(value)
                out.append("\n" + markdown_table(value) + "\n")
            elif kind == "image" and (got := self.media.image(value, n, len(page.images))):
                page.images.append(got[0])
                out.append(f"![{got[0].name}]({self.options.image_ref_prefix}{got[1]})\n\n")
        notes = self._notes(rels)
        page.text = f"--- Page {n} ---\n\n" + (f"# {title}\n\n" if title else "") + "".join(out) + (f"\n> **Notes:** {notes}\n\n" if notes else "")
        return page

    def layouts(self, body: str) -> str:
        """Text of masters and layouts that isn't a prompt and that no slide holds."""
        texts: dict[str, None] = {}
        for prefix in ("ppt/slideMasters/slideMaster", "ppt/slideLayouts/slideLayout"):
            for name in sorted(n for n in self.z.names(prefix) if n.endswith(".xml")):
                tree = _tree(xml.part(self.z, name))
                texts |= dict.fromkeys(_authored(tree)) if tree is not None else {}
        kept = [t for t in texts if t not in body]
        return "\n--- Slide Master / Layout ---\n\n" + "".join(f"{t}\n" for t in kept) if kept else ""


def _authored(node: Node, depth: int = 0) -> Iterator[str]:
    for x in node if depth <= xml.DEPTH else ():
        kind = xml.local(x)
        if kind in ("sp", "cxnSp"):
            mark = _placeholder(x)
            if (mark is None or xml.attribute(mark, "type") not in _PROMPTS) and (text := body_text(xml.child(x, "txBody"))):
                yield text
        elif kind in ("grpSp", "AlternateContent"):
            for inner in [x] if kind == "grpSp" else [c for c in x if xml.local(c) == "Choice"]:
                yield from _authored(inner, depth + 1)


def pages(data: bytes, options: Options = Options()) -> Pages:
    """Slides in the order of their numbers, then masters and layouts as a page of their own."""
    deck, texts = Deck(data, options), []
    for n in range(1, len(deck.slides) + 1):
        if options.wants(n):
            page = deck.page(n)
            texts.append(page.text)
            yield page
    extra = deck.layouts("\n".join(texts))
    if extra and options.wants(len(deck.slides) + 1):
        yield Page(len(deck.slides) + 1, extra, 720.0, 540.0)


def markdown(data: bytes, options: Options = Options()) -> str:
    deck = Deck(data, options)
    body = "\n".join(deck.page(n).text for n in range(1, len(deck.slides) + 1) if options.wants(n))
    extra = deck.layouts(body)
    return body + ("\n" if extra and body and not body.endswith("\n") else "") + extra + attachments(deck.z)
