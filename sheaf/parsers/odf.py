"""OpenDocument texts, sheets and slides."""

from __future__ import annotations

from . import xml
from .base import ConversionError, Options, Page, Pages
from .markdown import table as markdown_table
from .package import Media
from .xml import Node

COLUMNS, ROWS = 16384, 1 << 20


def paragraph(node: Node) -> str:
    """Text with line breaks, tabs as spaces, and as many spaces as `text:s` says."""
    out = [node.text or ""]
    for x in node:
        kind = xml.local(x)
        if kind == "line-break":
            out.append("\n")
        elif kind == "tab":
            out.append(" ")
        elif kind == "s":
            out.append(" " * min(max(1, xml.number(xml.attribute(x, "c"), 1)), COLUMNS))
        elif kind not in ("note", "annotation", "frame"):
            out.append(paragraph(x))
        out.append(x.tail or "")
    return "".join(out)


def _lines(node: Node | None) -> list[str]:
    return [t for p in xml.every(node, "p") if (t := paragraph(p).rstrip())]


def grid(node: Node) -> list[list[str]]:
    """Rows with repeats written out, without what is empty at the end of rows and of the table."""
    rows: list[list[str]] = []
    for tr in xml.every(node, "table-row"):
        row, empty = [], 0
        for cell in tr:
            kind = xml.local(cell)
            if kind not in ("table-cell", "covered-table-cell"):
                continue
            text = " ".join(map(paragraph, xml.every(cell, "p"))) if kind == "table-cell" else ""
            text = text.replace("|", "/").replace("\n", " ")
            times = min(max(1, xml.number(xml.attribute(cell, "number-columns-repeated"), 1)), COLUMNS)
            if not text:
                empty = min(empty + times, COLUMNS)
                continue
            row = (row + [""] * empty + [text] * times)[:COLUMNS]
            empty = 0
        times = min(max(1, xml.number(xml.attribute(tr, "number-rows-repeated"), 1)), ROWS)
        rows += [row] * (times if row else 1)
    while rows and not rows[-1]:
        rows.pop()
    return rows


def _images(body: Node, media: Media, page: int) -> tuple[list, str]:
    found, text = [], ""
    for x in xml.every(body, "image"):
        got = media.image(xml.attribute(x, "href").removeprefix("./"), page, len(found))
        if got:
            found.append(got[0])
            text += f"![{got[0].name}]({media.options.image_ref_prefix}{got[1]})\n\n"
    return found, text


def _text(body: Node, media: Media) -> Pages:
    out = []
    for x in body:
        kind = xml.local(x)
        if kind in ("h", "p"):
            if text := paragraph(x).rstrip():
                level = min(max(1, xml.number(xml.attribute(x, "outline-level"), 1)), 6)
                out.append(("#" * level + " " if kind == "h" else "") + text + "\n\n")
        elif kind == "list":
            out += [f"- {t}\n" for item in xml.every(x, "list-item") for t in _lines(item)] + ["\n"]
        elif kind == "table":
            out.append(markdown_table(grid(x)) + "\n")
    images, refs = _images(body, media, 1)
    yield Page(1, ("".join(out) + refs).rstrip(), images=images)


def _sheets(body: Node, media: Media) -> Pages:
    for n, x in enumerate((x for x in body if xml.local(x) == "table"), 1):
        rows = grid(x)
        text = f"## {xml.attribute(x, 'name') or f'Sheet {n}'}\n\n" + (markdown_table(rows) or "*Empty sheet*\n")
        yield Page(n, text.rstrip(), tables=[rows] if rows and media.options.tables else [])


def _frames(node: Node):
    for x in node:
        kind = xml.local(x)
        if kind == "frame":
            yield x
        elif kind != "notes":
            yield from _frames(x)


def _slides(body: Node, media: Media) -> Pages:
    for n, page in enumerate((x for x in body if xml.local(x) == "page"), 1):
        title, out = "", []
        for frame in _frames(page):
            text = "".join(f"{t}\n\n" for t in _lines(frame)) + "".join(markdown_table(grid(t)) + "\n" for t in xml.every(frame, "table"))
            if not title and text and xml.attribute(frame, "class") == "title":
                title = text.rstrip()
            else:
                out.append(text)
        images, refs = _images(page, media, n)
        notes = "\n".join(_lines(xml.child(page, "notes")))
        whole = (f"# {title}\n\n" if title else "") + "".join(out) + refs + (f"\n> **Notes:** {notes}\n" if notes else "")
        yield Page(n, whole.rstrip(), images=images)


def pages(data: bytes, options: Options = Options()) -> Pages:
    z = xml.package(data)
    body = xml.child(xml.part(z, "content.xml"), "body")
    if body is None:
        raise ConversionError("no document content")
    media = Media(z, options)
    for kind, read in (("text", _text), ("spreadsheet", _sheets), ("presentation", _slides)):
        if (found := xml.child(body, kind)) is not None:
            yield from read(found, media)
            return


def markdown(found: list[Page]) -> str:
    return "\n\n".join(p.text for p in found)
