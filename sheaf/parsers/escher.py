"""Pictures within office drawings of old: records of blips, and which shapes show them."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

_KINDS = {0xF01A: "emf", 0xF01B: "wmf", 0xF01C: "pict", 0xF01D: "jpeg", 0xF01E: "png", 0xF01F: "bmp", 0xF029: "tiff", 0xF02A: "jpeg"}
#: Instances whose record holds a second digest.
_TWICE = {0x3D5, 0x217, 0x543, 0x46B, 0x6E3, 0x6E1, 0x7A9, 0x6E5}
DEPTH = 16


def records(data: bytes, a: int = 0, b: int | None = None) -> Iterator[tuple[int, int, int, int]]:
    """(type, instance, start, end) of records one after the other."""
    b = len(data) if b is None else b
    while a + 8 <= b:
        head, kind, size = struct.unpack_from("<HHI", data, a)
        if a + 8 + size > b:
            return
        yield kind, head >> 4, a + 8, a + 8 + size
        a += 8 + size


def blip(data: bytes, kind: int, instance: int, a: int, b: int) -> tuple[str, bytes] | None:
    """The format and bytes of one picture record; metafiles are inflated."""
    form = _KINDS.get(kind)
    if not form:
        return None
    a += 32 if instance in _TWICE else 16
    if form not in ("emf", "wmf", "pict"):
        return form, data[a + 1 : b]
    packed = a + 34 <= b and data[a + 32] == 0
    raw = data[a + 34 : b]
    try:
        return form, zlib.decompress(raw) if packed else raw
    except zlib.error:
        return None


def blips(data: bytes, a: int = 0, b: int | None = None, depth: int = 0) -> list[tuple[str, bytes] | None]:
    """Pictures in the order of the store's entries; an entry without one is None."""
    out: list[tuple[str, bytes] | None] = []
    for kind, instance, x, y in records(data, a, b):
        if kind in (0xF000, 0xF001) and depth < DEPTH:
            out += blips(data, x, y, depth + 1)
        elif kind == 0xF007:
            inner = next(records(data, x + 36, y), None)
            out.append(blip(data, *inner) if inner else None)
        elif kind in _KINDS:
            out.append(blip(data, kind, instance, x, y))
    return out


def shown(data: bytes, a: int, b: int, depth: int = 0) -> list[int]:
    """Numbers, from 1, of the store's pictures that shapes within a drawing show."""
    out = []
    for kind, instance, x, y in records(data, a, b):
        if kind == 0xF00B:
            for n in range(instance):
                if x + 6 * n + 6 <= y:
                    name, value = struct.unpack_from("<HI", data, x + 6 * n)
                    if name & 0x3FFF == 0x0104 and value:
                        out.append(value)
        elif depth < DEPTH and (kind in (0xF002, 0xF003, 0xF004) or kind < 0xF000 and data[x - 8] & 15 == 15):
            out += shown(data, x, y, depth + 1)
    return out
