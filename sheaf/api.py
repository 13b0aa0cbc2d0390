"""The library's functions for single files and folders, under their familiar names and keywords."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

from . import formats
from .containers.walk import Limits, Result, Walk
from .operators import convert as _convert
from .parsers import images as _images
from .parsers.base import Image, Options, Page

__all__ = ["Image", "Limits", "Options", "Page", "Result", "convert", "convert_archive", "convert_bytes", "convert_chunks", "detect", "detect_bytes", "is_archive_file", "save_image", "stream_pages"]


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _made(format: str, pages: Sequence[int], tables: bool, images: bool, min_image_size: int, image_ref_prefix: str) -> Options:
    return Options(format, tuple(pages), tables, images, min_image_size, image_ref_prefix)


def detect_bytes(data: bytes, name_hint: str = "") -> dict[str, object]:
    name = formats.detect_bytes(data, name_hint)
    _, category, extension, mime, convertible = formats.BY_NAME.get(name, (name, "unknown", "", "", False))
    return {"format": name, "category": category, "extension": extension, "mime": mime, "convertible": convertible}


def detect(file_path: str) -> dict[str, object]:
    """The format of a file; one that can't be read is UNKNOWN or what its name says."""
    try:
        return detect_bytes(_read(file_path), file_path)
    except OSError:
        return detect_bytes(b"", file_path) if formats.name_extension(file_path) in formats.BY_EXTENSION else detect_bytes(b"\0", "")


def convert_bytes(data: bytes, name_hint: str = "", *, format: str = "markdown", pages: Sequence[int] = (), tables: bool = True, images: bool = True, min_image_size: int = 50, image_ref_prefix: str = "") -> str:
    return _convert.markdown(data, name_hint, _made(format, pages, tables, images, min_image_size, image_ref_prefix))


def convert(file_path: str, *, image_dir: str = "", **options) -> str:
    """A file as Markdown. With image_dir its images are written there, and references name the files written."""
    text = convert_bytes(_read(file_path), file_path, **options)
    if image_dir and options.get("images", True):
        prefix = options.get("image_ref_prefix", "")
        for page in stream_pages(file_path, **options):
            for image in page.images:
                if image.data:
                    name, saved = f"{image.name}.{_images.file_extension(image.format)}", save_image(image, image_dir)
                    text = text.replace(f"]({prefix}{name})", f"]({prefix}{saved})")
    return text


def save_image(image: Image, folder: str) -> str:
    """Writes an image without replacing a file: a name that is taken gets _1, _2, ...; returns the name written."""
    os.makedirs(folder, exist_ok=True)
    ext, n = _images.file_extension(image.format), 0
    while True:
        name = f"{image.name}{f'_{n}' if n else ''}.{ext}"
        try:
            with open(os.path.join(folder, name), "xb") as f:
                f.write(image.data)
        except FileExistsError:
            n += 1
            continue
        return name


def stream_pages(file_path: str, *, format: str = "markdown", pages: Sequence[int] = (), tables: bool = True, images: bool = True, min_image_size: int = 50, image_ref_prefix: str = "") -> Iterator[Page]:
    """Pages one by one as they are made."""
    return _convert.pages(_read(file_path), file_path, _made(format, pages, tables, images, min_image_size, image_ref_prefix))


def convert_chunks(file_path: str, **options) -> list[Page]:
    return list(stream_pages(file_path, **options))


def convert_archive(file_path: str, *, max_depth: int = 3, max_member_bytes: int = 512 << 20, max_total_bytes: int = 64 << 30, max_entries: int = 200_000, max_ratio: int = 10_000, include_unsupported: bool = False, format: str = "markdown", images: bool = True) -> Iterator[Result]:
    """Members of an archive, converted, nested ones too."""
    limits = Limits(max_depth, max_member_bytes, max_total_bytes, max_entries, max_ratio, include_unsupported)
    return Walk(limits, Options(format, images=images), _convert.markdown).run(_read(file_path), file_path)


def is_archive_file(file_path: str) -> bool:
    return formats.coarse_bytes(_read(file_path), file_path) in formats.ARCHIVES
