"""Windows metafiles: text of EMF and WMF records in reading order, and their bitmaps."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from .base import ConversionError, Image, Options, Page, Pages

MOST_RECORDS, MOST_BYTES = 1 << 20, 64 << 20
_BITMAPS = {76: (84, 88), 77: (84, 88), 78: (92, 96), 79: (108, 112), 80: (48, 56), 81: (48, 56), 114: (84, 92), 116: (84, 92)}


def _emf(data: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    for _ in range(MOST_RECORDS):
        if at + 8 > len(data):
            return
        kind, size = struct.unpack_from("<II", data, at)
        if size < 8 or size % 4 or at + size > len(data):
            return
        yield kind, data[at : at + size]
        at += size
        if kind == 14:
            return


def emf_runs(data: bytes) -> list[tuple[int, int, str]]:
    """(y, x, text) of the records that write text."""
    out = []
    for kind, r in _emf(data[:MOST_BYTES]):
        if kind in (83, 84) and len(r) >= 56:
            x, y, count, offset = struct.unpack_from("<iiII", r, 36)
            out.append((y, x, _text(r, offset, count, kind == 84)))
        elif kind in (96, 97) and len(r) >= 36:
            count = struct.unpack_from("<I", r, 36)[0] if len(r) >= 40 else 0
            base = 40
            for k in range(min(count, (len(r) - base) // 40)):
                x, y, n, offset = struct.unpack_from("<iiII", r, base + 40 * k)
                out.append((y, x, _text(r, offset, n, kind == 97)))
        elif kind == 108 and len(r) >= 36:
            x, y, count, options = struct.unpack_from("<iiII", r, 8)
            at = 36 if options & 0x100 else 52
            wide = not options & 0x200
            out.append((y, x, _text(r, at, count, wide)))
    return [(y, x, t) for y, x, t in out if t.strip()]


def _text(r: bytes, at: int, count: int, wide: bool) -> str:
    size = count * (2 if wide else 1)
    if not 8 <= at <= len(r) or at + size > len(r):
        return ""
    return r[at : at + size].decode("utf-16-le" if wide else "cp1252", "replace").rstrip("\0")


def emf_bitmaps(data: bytes) -> list[bytes]:
    """Device independent bitmaps of the records that draw one, as BMP files."""
    out = []
    for kind, r in _emf(data[:MOST_BYTES]):
        places = _BITMAPS.get(kind)
        if places and len(r) >= places[1] + 8:
            head, head_size = struct.unpack_from("<II", r, places[0])
            bits, bits_size = struct.unpack_from("<II", r, places[0] + 8)
            if head_size >= 40 and bits_size and head + head_size <= len(r) and bits + bits_size <= len(r):
                out.append(b"BM" + struct.pack("<IHHI", 14 + head_size + bits_size, 0, 0, 14 + head_size) + r[head : head + head_size] + r[bits : bits + bits_size])
    return out


def _wmf(data: bytes) -> Iterator[tuple[int, bytes]]:
    at = 22 if data[:4] == b"\xd7\xcd\xc6\x9a" else 0
    if at + 18 > len(data):
        return
    at += 2 * struct.unpack_from("<H", data, at + 2)[0]
    for _ in range(MOST_RECORDS):
        if at + 6 > len(data):
            return
        words, kind = struct.unpack_from("<IH", data, at)
        if words < 3 or at + 2 * words > len(data):
            return
        yield kind, data[at + 6 : at + 2 * words]
        at += 2 * words
        if not kind:
            return


def wmf_runs(data: bytes) -> list[tuple[int, int, str]]:
    out = []
    for kind, r in _wmf(data[:MOST_BYTES]):
        if kind == 0x0521 and len(r) >= 2:
            n = struct.unpack_from("<H", r)[0]
            at = 2 + n + n % 2
            if at + 4 <= len(r):
                y, x = struct.unpack_from("<hh", r, at)
                out.append((y, x, r[2 : 2 + n].decode("cp1252", "replace")))
        elif kind == 0x0A32 and len(r) >= 8:
            y, x, n, options = struct.unpack_from("<hhHH", r)
            at = 16 if options & 6 else 8
            out.append((y, x, r[at : at + n].decode("cp1252", "replace")))
    return [(y, x, t) for y, x, t in out if t.strip()]


def reading_order(runs: list[tuple[int, int, str]]) -> str:
    """Runs of one height as a line from left to right, lines from the top."""
    lines: list[tuple[int, list[str]]] = []
    for y, _, text in sorted(runs, key=lambda r: (r[0], r[1])):
        if lines and abs(lines[-1][0] - y) <= 2:
            lines[-1][1].append(text)
        else:
            lines.append((y, [text]))
    return "\n".join(" ".join(parts) for _, parts in lines)


def text_of(data: bytes) -> str:
    return reading_order(emf_runs(data) if data[:4] == b"\1\0\0\0" else wmf_runs(data))


def pages(data: bytes, options: Options = Options()) -> Pages:
    emf = data[:4] == b"\1\0\0\0" and data[40:44] == b" EMF"
    if not emf and data[:4] != b"\xd7\xcd\xc6\x9a" and data[:2] not in (b"\1\0", b"\2\0"):
        raise ConversionError("not a metafile")
    from . import images, png

    found = []
    for n, bitmap in enumerate(emf_bitmaps(data) if emf and options.images else []):
        picture = png.of_bitmap(bitmap)
        image = Image(1, f"page1_img{n}", "png" if picture else "bmp", picture or bitmap)
        image.width, image.height = images.dimensions(image.data)
        if images.wanted(image, options):
            found.append(image)
    refs = "".join(f"\n![{i.name}]({images.reference(i, options)})\n" for i in found)
    text = text_of(data)
    yield Page(1, (text + "\n" if text else "") + refs, images=found)
