"""Workbooks of XML parts (.xlsx): cells are pulled from a sheet's events, so a sheet is never a whole tree in memory."""

from __future__ import annotations

from . import xml
from .base import ConversionError, Options, Page, Pages
from .numbers import cell_reference, formatted
from .package import Media, attachments
from .sheets import Sheet
from .xml import Node


class Workbook:
    def __init__(self, data: bytes, options: Options):
        self.z, self.options = xml.package(data), options
        root = xml.part(self.z, "xl/workbook.xml")
        if root is None:
            raise ConversionError("no workbook")
        rels = xml.relationships(self.z, "xl/_rels/workbook.xml.rels")
        self.sheets = [(xml.attribute(s, "name"), xml.resolved("xl", rels.get(xml.attribute(s, "id"), f"worksheets/sheet{n}.xml"))) for n, s in enumerate(xml.every(root, "sheet"), 1)]
        self.strings = [_string(si) for si in xml.streamed(self.z, "xl/sharedStrings.xml", "si")]
        self.media = Media(self.z, options)
        self._styles()

    def _styles(self) -> None:
        root = xml.part(self.z, "xl/styles.xml")
        bold = [xml.child(f, "b") is not None for f in next(xml.every(root, "fonts"), None) or () if xml.local(f) == "font"]
        codes = {xml.number(xml.attribute(f, "numFmtId")): xml.attribute(f, "formatCode") for f in xml.every(root, "numFmt")}
        self.formats: list[tuple[int, str, bool]] = []
        for x in next(xml.every(root, "cellXfs"), None) or ():
            if xml.local(x) == "xf":
                number, font = xml.number(xml.attribute(x, "numFmtId")), xml.number(xml.attribute(x, "fontId"))
                self.formats.append((number, codes.get(number, ""), 0 <= font < len(bold) and bold[font]))

    def _value(self, cell: Node, style: int) -> str:
        kind, raw = xml.attribute(cell, "t"), xml.child(cell, "v")
        if kind == "inlineStr":
            return _string(xml.child(cell, "is"))
        text = xml.text_of(raw)
        if raw is None:
            return ""
        if kind == "s":
            index = xml.number(text, -1) if text else -1
            return self.strings[index] if 0 <= index < len(self.strings) else ""
        if kind == "b":
            return "TRUE" if text == "1" else "FALSE"
        if kind == "e" or not 0 <= style < len(self.formats):
            return text
        return formatted(text, *self.formats[style][:2])

    def sheet(self, n: int) -> Sheet:
        name, part = self.sheets[n - 1]
        sheet, notes = Sheet(name or f"Sheet {n}"), self.comments(part)
        for cell in xml.streamed(self.z, part, "c"):
            ref, style = xml.attribute(cell, "r"), xml.number(xml.attribute(cell, "s"), -1)
            column, row = cell_reference(ref)
            value, note = self._value(cell, style), notes.pop(ref, "")
            value = f"{value} [{note}]" if value and note else f"[{note}]" if note else value
            sheet.put(row, column, value, 0 <= style < len(self.formats) and self.formats[style][2])
        for ref, note in notes.items():
            column, row = cell_reference(ref)
            if (row, column) not in sheet.cells:
                sheet.put(row, column, f"[{note}]")
        return sheet

    def comments(self, part: str) -> dict[str, str]:
        """Notes by cell: `author: text`, replies after ` / `; a thread stands before a note of old."""
        folder, _, leaf = part.rpartition("/")
        found: dict[str, str] = {}
        threads: dict[str, list[str]] = {}
        people = {xml.attribute(p, "id"): xml.attribute(p, "displayName") for name in self.z.names("xl/persons/") for p in xml.every(xml.part(self.z, name), "person")}
        for target in xml.relationships(self.z, f"{folder}/_rels/{leaf}.rels").values():
            root = xml.part(self.z, xml.resolved(folder, target)) if "omment" in target else None
            authors = [xml.text_of(a) for a in xml.every(root, "author")]
            for c in xml.every(root, "comment"):
                who = xml.number(xml.attribute(c, "authorId"), -1)
                text, name = xml.joined(c, "t").strip(), authors[who] if 0 <= who < len(authors) else ""
                if text:
                    found[xml.attribute(c, "ref")] = f"{name}: {text}" if name and not name.startswith("tc=") else text
            for c in xml.every(root, "threadedComment"):
                text, name = xml.text_of(xml.child(c, "text")).strip(), people.get(xml.attribute(c, "personId"), "")
                if text:
                    threads.setdefault(xml.attribute(c, "ref"), []).append(f"{name}: {text}" if name else text)
        return found | {ref: " / ".join(texts) for ref, texts in threads.items()}

    def images(self) -> list[tuple]:
        """Images by sheet through drawings, then what is left of the media folder; numbers run across sheets."""
        found, number, seen = [], 0, set()
        for n, (_, part) in enumerate(self.sheets, 1):
            folder, _, leaf = part.rpartition("/")
            for target in xml.relationships(self.z, f"{folder}/_rels/{leaf}.rels").values():
                if "drawing" not in target.lower() or target.lower().endswith(".vml"):
                    continue
                drawing = xml.resolved(folder, target)
                at, _, name = drawing.rpartition("/")
                rels = xml.relationships(self.z, f"{at}/_rels/{name}.rels")
                for b in xml.every(xml.part(self.z, drawing), "blip"):
                    media = xml.resolved(at, rels.get(xml.attribute(b, "embed"), ""))
                    if media.startswith("xl/media/") and (got := self.media.image(media, n, number)):
                        found.append((n, *got))
                        number += 1
                    seen.add(media)
        for media in self.z.names("xl/media/"):
            if media not in seen and (got := self.media.image(media, 1, number)):
                found.append((1, *got))
                number += 1
        return found


def _string(node: Node | None) -> str:
    """Its own text if it has one, else those of its runs."""
    own = xml.child(node, "t")
    return xml.text_of(own) if own is not None else "".join(xml.text_of(t) for t in xml.every(node, "t"))


def pages(data: bytes, options: Options = Options()) -> Pages:
    book = Workbook(data, options)
    by_sheet: dict[int, list] = {}
    for n, image, _ in book.images():
        by_sheet.setdefault(n, []).append(image)
    wanted = [n for n in range(1, len(book.sheets) + 1) if options.wants(n)]
    for n in wanted:
        page: Page = book.sheet(n).page(n, options)
        page.images = by_sheet.get(n, [])
        if n == wanted[-1]:
            page.text += attachments(book.z)
        yield page


def markdown(data: bytes, options: Options = Options()) -> str:
    book = Workbook(data, options)
    sheets = [book.sheet(n).markdown() for n in range(1, len(book.sheets) + 1) if options.wants(n)]
    refs = "".join(f"![{image.name}]({options.image_ref_prefix}{reference})\n\n" for _, image, reference in book.images())
    return "\n".join(sheets) + refs + attachments(book.z)
