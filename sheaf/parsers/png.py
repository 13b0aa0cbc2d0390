"""PNG files from pixels and from device independent bitmaps."""

from __future__ import annotations

import struct
import zlib

MOST_PIXELS = 64 << 20


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encoded(width: int, height: int, channels: int, pixels: bytes) -> bytes:
    """Eight bits a channel: 1 grey, 3 colours, 4 colours and alpha. Empty if sizes don't fit."""
    row = width * channels
    if width <= 0 or height <= 0 or width * height > MOST_PIXELS or len(pixels) < row * height or channels not in (1, 3, 4):
        return b""
    lines = b"".join(b"\0" + pixels[a : a + row] for a in range(0, row * height, row))
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines, 6)) + _chunk(b"IEND", b"")


def unpacked(data: bytes, width: int, height: int, bits: int) -> bytes:
    """Samples of 1, 2, 4 or 8 bits as bytes; rows begin at whole bytes."""
    if bits == 8:
        return data
    row, per, mask = (width * bits + 7) // 8, 8 // bits, (1 << bits) - 1
    table = [bytes(b >> (8 - bits * (k + 1)) & mask for k in range(per)) for b in range(256)]
    return b"".join(b"".join(map(table.__getitem__, data[y * row : (y + 1) * row]))[:width] for y in range(height))


def of_bitmap(data: bytes) -> bytes:
    """A BMP file without compression, of 1, 4, 8, 24 or 32 bits; empty if it is of another kind."""
    if data[:2] != b"BM" or len(data) < 54:
        return b""
    at, size, width, high, _, bits, packing, _, _, _, used = struct.unpack_from("<IIiiHHIIiiI", data, 10)
    height, flipped = abs(high), high > 0
    if packing not in (0, 3) or bits not in (1, 4, 8, 24, 32) or width <= 0 or width * height > MOST_PIXELS:
        return b""
    row = (width * bits + 31) // 32 * 4
    lines = [data[at + y * row : at + (y + 1) * row] for y in range(height)]
    if not lines or len(lines[-1]) < (width * bits + 7) // 8:
        return b""
    if flipped:
        lines.reverse()
    if bits <= 8:
        count = used or 1 << bits
        palette = [data[14 + size + 4 * n : 17 + size + 4 * n][::-1].ljust(3, b"\0") for n in range(count)]
        palette += [b"\0\0\0"] * (256 - len(palette))
        return encoded(width, height, 3, b"".join(palette[i] for line in lines for i in unpacked(line, width, 1, bits)[:width]))
    step = bits // 8
    out = bytearray(3 * width * height)
    for y, line in enumerate(lines):
        for c in range(3):
            out[3 * width * y + c : 3 * width * (y + 1) : 3] = line[2 - c : step * width : step]
    return encoded(width, height, 3, bytes(out))
