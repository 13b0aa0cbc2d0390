"""Image payloads: formats, extensions, sizes by their headers."""

from __future__ import annotations

import re
import struct

from .base import Image, Options

#: Formats of extensions.
_FORMATS = {".jpg": "jpeg", ".jpeg": "jpeg", ".png": "png", ".gif": "gif", ".bmp": "bmp", ".tiff": "tiff", ".tif": "tiff", ".emf": "emf", ".wmf": "wmf", ".svg": "svg"}


def extension(path: str) -> str:
    dot = path.rfind(".")
    return path[dot:].lower() if dot >= 0 else ""


def format_of_extension(ext: str) -> str:
    return _FORMATS.get(ext, "bin")


def file_extension(kind: str) -> str:
    return "jpg" if kind == "jpeg" else kind or "bin"


def extension_to_save(declared: str, kind: str) -> str:
    """A declared extension of up to 15 letters or digits is kept; others give way to the format's."""
    return declared if re.fullmatch(r"\.[A-Za-z0-9]{1,15}", declared) else "." + file_extension(kind)


def reference(image: Image, options: Options, declared: str = "") -> str:
    """The name in a Markdown reference."""
    return options.image_ref_prefix + image.name + extension_to_save(declared, image.format)


def wanted(image: Image, options: Options) -> bool:
    """Not when either side is known to be smaller than the least size."""
    return not any(0 < n < options.min_image_size for n in (image.width, image.height))


def dimensions(data: bytes) -> tuple[int, int]:
    """Width and height from a PNG, GIF, BMP or JPEG header; zeros if unknown."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:4] == b"GIF8" and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    if data[:2] == b"BM" and len(data) >= 26:
        wide, high = struct.unpack("<ii", data[18:26])
        return abs(wide), abs(high)
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 < len(data) and data[at] == 0xFF:
        if data[at + 1] in (0xC0, 0xC2):
            high, wide = struct.unpack(">HH", data[at + 5 : at + 9])
            return wide, high
        at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return 0, 0
