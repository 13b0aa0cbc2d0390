"""Transfer codings as lenient as mail programs are."""

from __future__ import annotations

import base64
import re

_JUNK = re.compile(rb"[^A-Za-z0-9+/]")


def base64_bytes(data: bytes) -> bytes:
    """Up to the first `=`, whatever isn't of the alphabet skipped."""
    raw = _JUNK.sub(b"", data.split(b"=")[0])
    raw = raw[: len(raw) - (len(raw) % 4 == 1)]
    return base64.b64decode(raw + b"=" * (-len(raw) % 4))


def quoted_printable(data: bytes, underscores: bool = False) -> bytes:
    """Soft breaks joined, =XX decoded, anything else as it stands; in headers `_` is a space."""
    if underscores:
        data = data.replace(b"_", b" ")
    return re.sub(rb"=(?:\r\n|\n|([0-9A-Fa-f]{2}))", lambda m: bytes([int(m[1], 16)]) if m[1] else b"", data)


def hex_bytes(text: str) -> bytes:
    """Pairs of hex digits, whatever isn't one skipped."""
    raw = re.sub(r"[^0-9A-Fa-f]", "", text)
    return bytes.fromhex(raw[: len(raw) // 2 * 2])
