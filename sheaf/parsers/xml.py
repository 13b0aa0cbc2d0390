"""Small helpers over ElementTree: local names, bounded depth, parts of packages."""

from __future__ import annotations

import xml.etree.ElementTree as ET
import xml.parsers.expat as expat
from collections.abc import Iterator

from ..containers.base import MemberError
from ..containers.zips import ZipFileReader
from .base import ConversionError

DEPTH = 256
Node = ET.Element


class _Bounded(ET.TreeBuilder):
    """Leaves out what is nested deeper than DEPTH."""

    def __init__(self):
        super().__init__()
        self.depth = 0

    def start(self, tag, attrs):
        self.depth += 1
        return super().start(tag, attrs) if self.depth <= DEPTH else None

    def end(self, tag):
        self.depth -= 1
        return super().end(tag) if self.depth < DEPTH else None

    def data(self, data):
        if self.depth <= DEPTH:
            super().data(data)


class _Seen(Exception):
    """What ends a look at the prolog."""


class Prolog:
    """Looks at what comes before the root element, which is where entities can be declared, however long that is."""

    def __init__(self):
        self.parser, self.declares, self.done = expat.ParserCreate(), False, False
        self.parser.EntityDeclHandler, self.parser.StartElementHandler = self._entity, self._element

    def _entity(self, *_) -> None:
        self.declares = True
        raise _Seen

    def _element(self, *_) -> None:
        raise _Seen

    def feed(self, data: bytes, last: bool = False) -> bool:
        """Whether an entity has been declared up to the end of data."""
        if not self.done:
            try:
                self.parser.Parse(data, last)
            except (_Seen, expat.ExpatError):
                self.done = True
        return self.declares


def declares_entities(data: bytes) -> bool:
    prolog = Prolog()
    for at in range(0, len(data), 1 << 16):
        prolog.feed(data[at : at + (1 << 16)], at + (1 << 16) >= len(data))
        if prolog.done:
            break
    return prolog.declares


def streamed(z: ZipFileReader, name: str, tag: str) -> Iterator[Node]:
    """Elements of one name as they end; what has been read is dropped, so memory doesn't grow with the part. Ends where the
    part isn't well-formed, declares entities or is nested too deeply; a part that can't be unpacked is an error."""
    entry = z.by_name.get(name)
    if not entry:
        return
    parser, prolog, path, inside = ET.XMLPullParser(("start", "end")), Prolog(), [], 0
    try:
        for data in z.parts(entry):
            if prolog.feed(data):
                return
            parser.feed(data)
            for event, node in parser.read_events():
                if event == "start":
                    path.append(node)
                    inside += local(node) == tag
                    if len(path) > DEPTH:
                        return
                    continue
                path.pop()
                if local(node) == tag:
                    inside -= 1
                    yield node
                if not inside and path:
                    path[-1].remove(node)
    except ET.ParseError:
        return
    except MemberError as e:
        raise ConversionError(f"cannot read {name}") from e


def parse(data: bytes) -> Node | None:
    """The root of an XML part; None if it is empty, not well-formed or declares entities."""
    if not data or declares_entities(data):
        return None
    try:
        return ET.fromstring(data, ET.XMLParser(target=_Bounded()))
    except ET.ParseError:
        return None


def package(data: bytes) -> ZipFileReader:
    try:
        return ZipFileReader(data)
    except ValueError as e:
        raise ConversionError("cannot open document package") from e


def part(z: ZipFileReader, name: str) -> Node | None:
    try:
        return parse(z.read(name))
    except MemberError:
        return None


def local(node: Node) -> str:
    return node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""


def child(node: Node | None, name: str) -> Node | None:
    return next((x for x in node if local(x) == name), None) if node is not None else None


def path(node: Node | None, *names: str) -> Node | None:
    for name in names:
        node = child(node, name)
    return node


def every(node: Node | None, name: str) -> Iterator[Node]:
    """Descendants of that local name in document order, without what stands in a Fallback."""
    if node is None:
        return
    todo = [iter(node)]
    while todo:
        x = next(todo[-1], None)
        if x is None:
            todo.pop()
            continue
        own = local(x)
        if own == "Fallback":
            continue
        if own == name:
            yield x
        todo.append(iter(x))


def attribute(node: Node | None, name: str) -> str:
    if node is None:
        return ""
    return next((v for k, v in node.attrib.items() if k.rpartition("}")[2] == name), "")


def number(text: str, default: int = 0) -> int:
    digits = text.strip()
    sign = digits[:1] in "+-" and digits[:1]
    digits = digits[1:] if sign else digits
    n = 0
    while n < len(digits) and digits[n] in "0123456789":
        n += 1
    return int((sign or "") + digits[:n]) if n else default


def text_of(node: Node | None) -> str:
    return "".join(node.itertext()) if node is not None else ""


def joined(node: Node | None, name: str) -> str:
    """The texts of all descendants of that name."""
    return "".join(map(text_of, every(node, name)))


def relationships(z: ZipFileReader, name: str, external: bool | None = None) -> dict[str, str]:
    """Targets by id; only external or only internal ones if asked for."""
    found = {}
    for r in every(part(z, name), "Relationship"):
        if external is None or external == (attribute(r, "TargetMode") == "External"):
            found[attribute(r, "Id")] = attribute(r, "Target")
    return found


def resolved(base: str, target: str) -> str:
    """A target relative to a part's folder, or absolute within the package."""
    parts = [] if target.startswith("/") else base.split("/")
    for x in target.split("/"):
        if x == "..":
            parts = parts[:-1]
        elif x not in ("", "."):
            parts.append(x)
    return "/".join(parts)
