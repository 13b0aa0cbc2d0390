"""Tar files: ustar prefixes, GNU long names, pax paths, base-256 sizes."""

from __future__ import annotations

from collections.abc import Iterator

from .base import Member, legacy_name, stored

#: A long name or pax record beyond this is passed over.
MOST_RECORD = 1 << 20


def _number(raw: bytes) -> int:
    if raw[:1] and raw[0] & 0x80:
        return int.from_bytes(bytes([raw[0] & 0x7F]) + raw[1:], "big")
    text = raw.split(b"\0")[0].strip(b" ")
    return int(text, 8) if text and all(48 <= c < 56 for c in text) else 0


def _pax_path(record: bytes) -> bytes:
    at, found = 0, b""
    while at < len(record):
        size, _, _ = record[at:].partition(b" ")
        if not size.isdigit() or not int(size):
            break
        line = record[at : at + int(size)]
        key, _, value = line[len(size) + 1 :].partition(b"=")
        if key == b"path":
            found = value.rstrip(b"\n")
        at += int(size)
    return found


def members(data: bytes) -> Iterator[Member]:
    at, long_name = 0, b""
    while at + 512 <= len(data):
        head = data[at : at + 512]
        if not any(head):
            return
        size, kind = _number(head[124:136]), head[156:157]
        body = data[at + 512 : at + 512 + size]
        at += 512 + (size + 511) // 512 * 512
        if kind in (b"L", b"x", b"g", b"K"):
            if size <= MOST_RECORD and kind in (b"L", b"x"):
                long_name = body.split(b"\0")[0] if kind == b"L" else _pax_path(body) or long_name
            continue
        name = head[:100].split(b"\0")[0]
        prefix = head[345:500].split(b"\0")[0] if head[257:262] == b"ustar" else b""
        raw, long_name = long_name or (prefix + b"/" + name if prefix else name), b""
        if kind in (b"0", b"\0", b"7", b""):
            whole = len(body) == size
            yield Member(legacy_name(raw), size, 0, lambda b=body, w=whole: stored(b) if w else _cut(b), directory=raw.endswith(b"/"), skip_empty=True)


def _cut(body: bytes) -> Iterator[bytes]:
    from .base import MemberError

    yield from stored(body)
    raise MemberError("corrupt tar data (truncated)")
