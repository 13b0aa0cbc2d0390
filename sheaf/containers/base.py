"""What container readers yield: members whose content is decoded only when it is asked for."""

from __future__ import annotations

import bz2
import lzma
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

STEP = 1 << 16


class MemberError(ValueError):
    """One member can't be read; the walk goes on."""


@dataclass
class Member:
    """`size` is what the container declares; `packed` its compressed size (0: not known); `parts` decodes in pieces."""

    name: str
    size: int
    packed: int
    parts: Callable[[], Iterator[bytes]]
    encrypted: bool = False
    directory: bool = False
    #: Whether a zero size means that there is nothing to convert.
    skip_empty: bool = False


def legacy_name(raw: bytes) -> str:
    """UTF-8 if valid, else Korean; Windows separators turned."""
    try:
        name = raw.decode()
    except UnicodeDecodeError:
        name = raw.decode("cp949", "replace")
    return name.replace("\\", "/")


def stored(data: bytes) -> Iterator[bytes]:
    for a in range(0, len(data), STEP):
        yield bytes(data[a : a + STEP])


def _pumped(decoder, data: bytes, what: str) -> Iterator[bytes]:
    """Output piece by piece, so that a limit stops an expansion early."""
    try:
        out, at = b"", 0
        while not decoder.eof:
            if getattr(decoder, "needs_input", True):
                if at >= len(data):
                    break
                out = decoder.decompress(data[at : at + STEP], STEP)
                at += STEP
            else:
                out = decoder.decompress(b"", STEP)
            if out:
                yield out
    except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError) as e:
        raise MemberError(f"corrupt {what} data") from e
    if not decoder.eof and what != "lzma":
        raise MemberError(f"corrupt {what} data (unexpected end)")


def inflated(data: bytes, bits: int = -15) -> Iterator[bytes]:
    decoder = zlib.decompressobj(bits)
    rest = bytes(data)
    try:
        while rest and not decoder.eof:
            out = decoder.decompress(rest, STEP)
            rest = decoder.unconsumed_tail
            if out:
                yield out
        out = decoder.flush()
    except zlib.error as e:
        raise MemberError("corrupt deflate data") from e
    if out:
        yield out
    if not decoder.eof:
        raise MemberError("corrupt deflate data (unexpected end)")


def gunzipped(data: bytes) -> Iterator[bytes]:
    """All members of a gzip file, one after the other."""
    rest = data
    while rest[:2] == b"\x1f\x8b":
        decoder = zlib.decompressobj(31)
        try:
            while rest and not decoder.eof:
                out = decoder.decompress(rest, STEP)
                rest = decoder.unconsumed_tail or decoder.unused_data
                if out:
                    yield out
        except zlib.error as e:
            raise MemberError("corrupt gzip data") from e
        if not decoder.eof:
            raise MemberError("corrupt gzip data (unexpected end)")


def bunzipped(data: bytes) -> Iterator[bytes]:
    rest = data
    while rest[:3] == b"BZh":
        decoder = bz2.BZ2Decompressor()
        yield from _pumped(decoder, rest, "bzip2")
        rest = decoder.unused_data


def raw_lzma(data: bytes, filters: list[dict], size: int) -> Iterator[bytes]:
    decoder, left = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=filters), size
    for part in _pumped(decoder, data, "lzma"):
        yield part[:left]
        left -= len(part)
        if left <= 0:
            return


def checked(parts: Iterator[bytes], size: int, crc: int | None) -> Iterator[bytes]:
    """The same pieces; an error at the end if size or CRC-32 isn't as declared."""
    seen, own = 0, 0
    for part in parts:
        own, seen = zlib.crc32(part, own), seen + len(part)
        yield part
    if seen != size or crc is not None and own != crc:
        raise MemberError("member crc mismatch")


def failing(message: str) -> Callable[[], Iterator[bytes]]:
    def parts() -> Iterator[bytes]:
        raise MemberError(message)
        yield b""

    return parts
