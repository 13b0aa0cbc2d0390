"""What parsers return, and their options. Parsers take bytes and import nothing of Spark."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field


class ConversionError(ValueError):
    """Content that can't be converted; it becomes a row's error, never a failed task."""


@dataclass(frozen=True)
class Options:
    """How to convert. `pages` selects by each format's own numbering; a size that isn't known passes `min_image_size`."""

    format: str = "markdown"
    pages: tuple[int, ...] = ()
    tables: bool = True
    images: bool = True
    min_image_size: int = 50
    image_ref_prefix: str = ""

    def __post_init__(self):
        if any(p < 0 for p in self.pages):
            raise ValueError("pages must not be negative")
        if self.format not in ("", "markdown", "text", "plaintext", "plain"):
            raise ValueError(f"unknown output format: {self.format}")

    @property
    def plain(self) -> bool:
        return self.format in ("text", "plaintext", "plain")

    def wants(self, page: int) -> bool:
        return not self.pages or page in self.pages


@dataclass
class Image:
    page_number: int
    name: str
    format: str = ""
    data: bytes = b""
    width: int = 0
    height: int = 0
    components: int = 0
    embedded_text: str = ""


@dataclass
class Page:
    page_number: int
    text: str
    page_width: float = 0.0
    page_height: float = 0.0
    body_font_size: float = 0.0
    tables: list[list[list[str]]] = field(default_factory=list)
    images: list[Image] = field(default_factory=list)
    degraded_images: int = 0


Pages = Iterator[Page]
