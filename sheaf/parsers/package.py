"""What office packages share: styled runs, embedded parts, media."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import groupby

from ..containers.base import MemberError
from ..containers.zips import ZipFileReader
from . import images
from .base import Image, Options

_EMBEDDINGS = ("word/embeddings/", "xl/embeddings/", "ppt/embeddings/")
_SIGNS = {(False, False): "", (True, False): "**", (False, True): "*", (True, True): "***"}


def emphasised(runs: Iterable[tuple[str, bool, bool]], marks: bool = True) -> str:
    """Runs (text, bold, italic), neighbours of one style as one, between their signs."""
    out = []
    for style, same in groupby(runs, key=lambda r: (r[1], r[2])):
        sign = _SIGNS[style] if marks else ""
        out.append(sign + "".join(r[0] for r in same) + sign)
    return "".join(out)


def human_bytes(size: int) -> str:
    if size >= 1 << 20:
        return f"{size / (1 << 20):.1f} MB"
    return f"{size / 1024:.1f} KB" if size >= 1024 else f"{size} B"


def single_line(text: str) -> str:
    return "".join(" " if ord(c) < 32 or c == "\x7f" else c for c in text).strip(" \t\r\n")


def attachments(z: ZipFileReader) -> str:
    """A listing of embedded objects, direct children of the embeddings folders only."""
    lines = []
    for e in z.entries:
        for folder in _EMBEDDINGS:
            leaf = e.name.removeprefix(folder)
            if leaf != e.name and leaf and "/" not in leaf and (name := single_line(leaf)):
                lines.append(f"- {name}" + (f" ({human_bytes(e.size)})" if e.size else "") + "\n")
    return "\n## Attachments\n\n" + "".join(lines) + "\n" if lines else ""


class Media:
    """A package's images by part name, each read once; a repeat carries no bytes."""

    def __init__(self, z: ZipFileReader, options: Options):
        self.z, self.options, self.read = z, options, {}

    def image(self, part: str, page: int, number: int) -> tuple[Image, str] | None:
        """The image and its reference, or None if it is missing or too small."""
        e = self.z.by_name.get(part)
        if not e or not self.options.images:
            return None
        if part not in self.read:
            try:
                data = b"".join(self.z.parts(e))
            except MemberError:
                data = b""
            declared = images.extension(part)
            own = Image(page, f"page{page}_img{number}", images.format_of_extension(declared), data)
            own.width, own.height = images.dimensions(data)
            self.read[part] = (own, images.reference(own, Options(), declared)) if images.wanted(own, self.options) else None
            return self.read[part]
        known = self.read[part]
        if not known:
            return None
        first, reference = known
        return Image(page, f"page{page}_img{number}", first.format, b"", first.width, first.height), reference
