"""Word documents: a body as a flat list of blocks, then rendered whole or page by page."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from . import xml
from .base import ConversionError, Options, Page, Pages
from .markdown import table as markdown_table
from .package import Media, attachments, emphasised
from .xml import Node

_NUMBERED = ("decimal", "upperRoman", "lowerRoman", "upperLetter", "lowerLetter", "decimalZero", "ordinal", "koreanDigital", "ganada", "chosung")


@dataclass
class Block:
    kind: str  # paragraph, table or break
    text: str = ""
    heading: int = 0
    #: (list id, level, whether it counts) of an item.
    item: tuple[int, int, bool] | None = None
    rows: list[list[str]] = field(default_factory=list)
    images: list[str] = field(default_factory=list)


class Document:
    def __init__(self, data: bytes, options: Options):
        self.options = options
        self.z = xml.package(data)
        self.styles = self._styles()
        self.formats = self._numbering()
        rels = "word/_rels/document.xml.rels"
        self.links = xml.relationships(self.z, rels, external=True)
        self.targets = xml.relationships(self.z, rels)
        self.media = Media(self.z, options)
        self.names = {e.name: n for n, e in enumerate(x for x in self.z.entries if x.name.startswith("word/media/"))}
        root = xml.part(self.z, "word/document.xml")
        body = xml.child(root, "body")
        if body is None:
            raise ConversionError("no document body")
        self.blocks = list(self._blocks(body))

    def _styles(self) -> dict[str, int]:
        """Heading levels by style: Title 1, Subtitle 2, else the outline level plus one."""
        found = {}
        for s in xml.every(xml.part(self.z, "word/styles.xml"), "style"):
            name, key = xml.attribute(xml.child(s, "name"), "val").lower(), xml.attribute(s, "styleId")
            outline = xml.attribute(xml.path(s, "pPr", "outlineLvl"), "val")
            if name in ("title", "subtitle"):
                found[key] = 1 if name == "title" else 2
            elif outline and 0 <= xml.number(outline, 9) < 9:
                found[key] = min(xml.number(outline) + 1, 6)
            elif name.startswith("heading ") and name[8:9].isdigit():
                found[key] = min(max(1, int(name[8])), 6)
        return found

    def _numbering(self) -> dict[int, dict[int, str]]:
        """Number formats by list id and level."""
        root = xml.part(self.z, "word/numbering.xml")
        abstract = {xml.number(xml.attribute(a, "abstractNumId"), -1): {xml.number(xml.attribute(v, "ilvl")): xml.attribute(xml.child(v, "numFmt"), "val") for v in xml.every(a, "lvl")} for a in xml.every(root, "abstractNum")}
        return {xml.number(xml.attribute(n, "numId"), -1): abstract.get(xml.number(xml.attribute(xml.child(n, "abstractNumId"), "val"), -1), {}) for n in xml.every(root, "num")}

    def _blocks(self, node: Node) -> Iterator[Block]:
        for x in node:
            kind = xml.local(x)
            if kind == "p":
                if _breaks_page(x):
                    yield Block("break")
                yield self._paragraph(x)
            elif kind == "tbl":
                yield self._table(x)
            elif kind in ("sdt", "AlternateContent"):
                inner = xml.child(x, "sdtContent" if kind == "sdt" else "Choice")
                if inner is not None:
                    yield from self._blocks(inner)

    def _paragraph(self, node: Node) -> Block:
        props = xml.child(node, "pPr")
        block = Block("paragraph", heading=self.styles.get(xml.attribute(xml.child(props, "pStyle"), "val"), 0), images=_blips(node)[:1])
        number = xml.child(props, "numPr")
        if number is not None and (key := xml.number(xml.attribute(xml.child(number, "numId"), "val"))) > 0:
            level = xml.number(xml.attribute(xml.child(number, "ilvl"), "val"))
            block.item = (key, level, self.formats.get(key, {}).get(level, "") in _NUMBERED)
        marks, runs = not block.heading, []
        for x in node:
            kind = xml.local(x)
            if kind == "r":
                runs.append(_run(x))
            elif kind == "hyperlink":
                text = emphasised([r for r in map(_run, (y for y in x if xml.local(y) == "r")) if r[0]], marks)
                target = self.links.get(xml.attribute(x, "id"), "")
                runs.append((f"[{text}]({target})" if target and text else text, False, False))
        block.text = emphasised([r for r in runs if r[0]], marks)
        return block

    def _table(self, node: Node) -> Block:
        block = Block("table")
        for tr in xml.every(node, "tr"):
            row = []
            for tc in xml.every(tr, "tc"):
                paragraphs = list(xml.every(tc, "p"))
                row.append(" ".join(xml.joined(p, "t") for p in paragraphs).replace("|", "/").replace("\n", " "))
                block.images += [r for p in paragraphs for r in _blips(p)[:1]]
            block.rows.append(row)
        return block

    def images(self) -> list:
        return [got[0] for part, n in self.names.items() if (got := self.media.image(part, 1, n))]

    def reference(self, rid: str) -> str:
        target = self.targets.get(rid)
        if not target:
            return ""
        part = xml.resolved("word", target)
        got = self.media.read.get(part) or (self.media.image(part, 1, self.names.get(part, 0)) if part in self.names else None)
        name = got[1] if got else part.rpartition("/")[2]
        return f"![{name.rpartition('.')[0] or name}]({self.options.image_ref_prefix}{name})\n\n"

    def notes(self) -> str:
        out = ""
        for part, kind, mark in (("word/footnotes.xml", "footnote", ""), ("word/endnotes.xml", "endnote", "e")):
            texts = [t for x in xml.every(xml.part(self.z, part), kind) if not xml.attribute(x, "type") and (t := xml.joined(x, "t").strip())]
            if texts:
                out += "\n" + "".join(f"[^{mark}{n}]: {t}\n" for n, t in enumerate(texts, 1))
        return out

    def margins(self, body: str) -> str:
        """Lines of headers and footers that the body doesn't hold, each once."""
        lines: dict[str, None] = {}
        for prefix in ("word/header", "word/footer"):
            for name in sorted(n for n in self.z.names(prefix) if n.endswith(".xml")):
                lines |= dict.fromkeys(t for p in xml.every(xml.part(self.z, name), "p") if (t := xml.joined(p, "t").strip()))
        kept = [x for x in lines if x not in body]
        return "\n--- Header / Footer ---\n\n" + "".join(f"{x}\n" for x in kept) if kept else ""


class Counters:
    """Numbers of list items: one counter a list and level; counting on a level starts the deeper ones anew."""

    def __init__(self):
        self.at: dict[tuple[int, int], int] = {}

    def next(self, key: int, level: int) -> int:
        self.at = {k: v for k, v in self.at.items() if k[0] != key or k[1] <= level}
        self.at[key, level] = self.at.get((key, level), 0) + 1
        return self.at[key, level]


def rendered(doc: Document, block: Block, counters: Counters) -> str:
    refs = "".join(map(doc.reference, block.images)) if doc.options.images else ""
    if block.kind == "table":
        return ("\n" + markdown_table(block.rows) + "\n" if doc.options.tables else "") + refs
    if not block.text:
        return refs
    number = f"{counters.next(*block.item[:2])}. " if block.item and block.item[2] else ""
    if block.heading:
        return f"{refs}{'#' * block.heading} {number}{block.text}\n\n"
    if block.item:
        return f"{refs}{'  ' * block.item[1]}{number or '- '}{block.text}\n"
    return f"{refs}{block.text}\n\n"


def _run(node: Node) -> tuple[str, bool, bool]:
    props = xml.child(node, "rPr")
    return xml.joined(node, "t"), xml.child(props, "b") is not None, xml.child(props, "i") is not None


def _breaks_page(node: Node) -> bool:
    if xml.path(node, "pPr", "pageBreakBefore") is not None:
        return True
    return any(xml.attribute(b, "type") == "page" for b in xml.every(node, "br")) or next(xml.every(node, "lastRenderedPageBreak"), None) is not None


def _blips(node: Node) -> list[str]:
    return [rid for b in xml.every(node, "blip") if (rid := xml.attribute(b, "embed") or xml.attribute(b, "link"))]


def markdown(data: bytes, options: Options = Options()) -> str:
    doc, counters, page = Document(data, options), Counters(), 1
    doc.images()
    out = ["--- Page 1 ---\n\n"]
    for block in doc.blocks:
        if block.kind == "break":
            page += 1
            out.append(f"\n--- Page {page} ---\n\n")
        else:
            out.append(rendered(doc, block, counters))
    body = "".join(out) + doc.notes()
    return body + doc.margins(body) + attachments(doc.z)


def pages(data: bytes, options: Options = Options()) -> Pages:
    """Pages as breaks part them; an empty one isn't given and has no number. Notes, margins and attachments end the last."""
    doc = Document(data, options)
    images, found = doc.images(), []
    parts: list[list[Block]] = [[]]
    for block in doc.blocks:
        if block.kind == "break":
            parts.append([])
        else:
            parts[-1].append(block)
    for part in parts:
        counters = Counters()
        text = "".join(rendered(doc, b, counters) for b in part)
        tables = [b.rows for b in part if b.kind == "table" and b.rows] if options.tables else []
        if text or tables:
            found.append(Page(len(found) + 1, text, tables=tables))
    if not found:
        found = [Page(1, "")]
    found[0].images = images
    found[-1].text += doc.notes()
    found[-1].text += doc.margins("".join(p.text for p in found)) + attachments(doc.z)
    for page in found:
        if options.wants(page.page_number) and (page.text or page.images):
            yield page
