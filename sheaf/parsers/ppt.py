"""Slide decks of records (.ppt): slides in the order of the slide list, with their notes."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

from ..containers.cfb import CompoundFile
from . import escher, images
from .base import ConversionError, Image, Options, Page, Pages

_SLIDE, _NOTES, _LIST, _PERSIST = 0x03EE, 0x03F0, 0x0FF0, 0x03F3
_HEADER, _CHARS, _BYTES = 0x0F9F, 0x0FA0, 0x0FA8
_EDIT, _POINTERS = 0x0FF5, 0x1772
_TITLES = (0, 6)
DEPTH = 32


def records(data: bytes, a: int, b: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(type, version, instance, start, end) of the records between two places."""
    while a + 8 <= b:
        head, kind, size = struct.unpack_from("<HHI", data, a)
        end = a + 8 + size
        if end > b:
            return
        yield kind, head & 15, head >> 4, a + 8, end
        a = end


@dataclass
class Slide:
    title: str = ""
    lines: list[str] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)
    pictures: list[int] = field(default_factory=list)


def _clean(text: str) -> list[str]:
    return [line.strip() for line in text.replace("\x0b", "\n").replace("\r", "\n").split("\n") if line.strip() and line.strip() != "*"]


class Deck:
    def __init__(self, data: bytes):
        try:
            f = CompoundFile(data)
        except ValueError as e:
            raise ConversionError("cannot open presentation") from e
        self.data = f.read("PowerPoint Document")
        if not self.data:
            raise ConversionError("no presentation stream")
        self.pictures = self._store(f.read("Pictures"))
        self.at = self._pointers(f.read("Current User"))
        self.slides = list(self._listed()) or list(self._scanned())

    def _store(self, raw: bytes) -> dict[int, tuple[str, bytes]]:
        """Pictures by their number in the document's store, whose entries say where each begins."""
        at = {x - 8: escher.blip(raw, k, i, x, y) for k, i, x, y in escher.records(raw)}
        found, number, todo = {}, 0, [(0, len(self.data), 0)]
        while todo:
            a, b, depth = todo.pop()
            for k, version, _, x, y in records(self.data, a, b):
                if k == 0xF007:
                    number += 1
                    where = struct.unpack_from("<I", self.data, x + 28)[0] if y - x >= 32 else -1
                    if at.get(where):
                        found[number] = at[where]
                elif version == 15 and depth < 6 and k in (0x03E8, 0x040B, 0xF000, 0xF001):
                    todo.append((x, y, depth + 1))
        return found

    def _pointers(self, user: bytes) -> dict[int, int]:
        """Places of persistent objects, the newest of each."""
        found: dict[int, int] = {}
        edit = struct.unpack_from("<I", user, 16)[0] if len(user) >= 20 else 0
        seen: set[int] = set()
        while edit and edit not in seen and edit + 8 <= len(self.data):
            seen.add(edit)
            kind, size = struct.unpack_from("<HI", self.data, edit + 2)
            if kind != _EDIT or size < 16:
                break
            last, where = struct.unpack_from("<II", self.data, edit + 16)
            for k, _, _, a, b in records(self.data, where, len(self.data)):
                if k == _POINTERS:
                    while a + 4 <= b:
                        head = struct.unpack_from("<I", self.data, a)[0]
                        first, count = head & 0xFFFFF, head >> 20
                        for n in range(min(count, (b - a - 4) // 4)):
                            found.setdefault(first + n, struct.unpack_from("<I", self.data, a + 4 + 4 * n)[0])
                        a += 4 + 4 * count
                break
            edit = last
        return found

    def _texts(self, a: int, b: int, depth: int = 0) -> Iterator[tuple[int, str]]:
        """(kind of text, text) in order, from containers within each other."""
        kind = -1
        for k, version, _, x, y in records(self.data, a, b):
            if k == _HEADER and y - x >= 4:
                kind = struct.unpack_from("<I", self.data, x)[0]
            elif k == _CHARS:
                yield kind, self.data[x:y].decode("utf-16-le", "replace")
            elif k == _BYTES:
                yield kind, self.data[x:y].decode("latin-1")
            elif version == 15 and depth < DEPTH and k != _LIST:
                yield from self._texts(x, y, depth + 1)

    def _object(self, persist: int, wanted: int) -> tuple[int, int] | None:
        at = self.at.get(persist)
        found = next(records(self.data, at, len(self.data)), None) if at is not None else None
        return (found[3], found[4]) if found and found[0] == wanted else None

    def _listed(self) -> Iterator[Slide]:
        lists: dict[int, list[tuple[int, int, list]]] = {}
        for _, _, _, a, b in (r for r in records(self.data, 0, len(self.data)) if r[0] == 0x03E8):
            for k, _, instance, x, y in records(self.data, a, b):
                if k != _LIST:
                    continue
                own = lists.setdefault(instance, [])
                kind = -1
                for k2, _, _, x2, y2 in records(self.data, x, y):
                    if k2 == _PERSIST and y2 - x2 >= 16:
                        persist, _, _, ident = struct.unpack_from("<IIII", self.data, x2)
                        own.append((persist, ident, []))
                    elif k2 == _HEADER:
                        kind = struct.unpack_from("<I", self.data, x2)[0]
                    elif k2 in (_CHARS, _BYTES) and own:
                        own[-1][2].append((kind, self.data[x2:y2].decode("utf-16-le" if k2 == _CHARS else "latin-1", "replace")))
        notes: dict[int, list[str]] = {}
        for persist, _, _ in lists.get(2, []):
            if box := self._object(persist, _NOTES):
                owner = next((struct.unpack_from("<I", self.data, x)[0] for k, _, _, x, y in records(self.data, *box) if k == 0x03F1 and y - x >= 4), 0)
                notes[owner] = [line for _, text in self._texts(*box) for line in _clean(text)]
        for persist, ident, texts in lists.get(0, []):
            box = self._object(persist, _SLIDE)
            slide = _slide([*texts, *(t for t in (self._texts(*box) if box else ()) if t not in texts)], notes.get(ident, []))
            slide.pictures = escher.shown(self.data, *box) if box else []
            yield slide

    def _scanned(self) -> Iterator[Slide]:
        for k, _, _, a, b in records(self.data, 0, len(self.data)):
            if k == _SLIDE:
                slide = _slide(list(self._texts(a, b)), [])
                slide.pictures = escher.shown(self.data, a, b)
                yield slide


def _slide(texts: list[tuple[int, str]], notes: list[str]) -> Slide:
    slide = Slide(notes=notes)
    for kind, text in texts:
        lines = _clean(text)
        if kind in _TITLES and not slide.title and lines:
            slide.title = " ".join(lines)
        else:
            slide.lines += lines
    return slide


def rendered(slide: Slide, number: int, refs: str = "") -> str:
    lines = [f"- {x.lstrip('•').lstrip()}\n" if x.startswith("•") else f"{x}\n" for x in slide.lines]
    notes = "".join(("\n> **Notes:** " if not n else "> ") + x + "\n" for n, x in enumerate(slide.notes))
    return ("\n" if number > 1 else "") + f"--- Page {number} ---\n\n" + (f"# {slide.title}\n\n" if slide.title else "") + "".join(lines) + refs + notes + "\n"


def pages(data: bytes, options: Options = Options()) -> Pages:
    deck = Deck(data)
    for n, slide in enumerate(deck.slides, 1):
        if not options.wants(n):
            continue
        page, refs = Page(n, "", 720.0, 540.0, 24.0), ""
        for k in slide.pictures if options.images else ():
            if k in deck.pictures:
                image = Image(n, f"page{n}_img{len(page.images)}", *deck.pictures[k])
                image.width, image.height = images.dimensions(image.data)
                if images.wanted(image, options):
                    page.images.append(image)
                    refs += f"![{image.name}]({images.reference(image, options)})\n"
        page.text = rendered(slide, n, refs)
        yield page


def markdown(data: bytes, options: Options = Options()) -> str:
    return "".join(p.text for p in pages(data, options))
