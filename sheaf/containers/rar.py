"""RAR 4 and 5 archives: all headers, the content of stored members."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from .base import Member, MemberError, checked, failing, stored

MOST_NAME, MOST_HEADER = 4096, 2 << 20


def members(data: bytes) -> Iterator[Member]:
    """Raises MemberError when the headers themselves are encrypted."""
    yield from _five(data) if data[6:8] == b"\1\0" else _four(data)


def _member(name: str, size: int, body: bytes, packed: int, crc: int | None, stored_: bool, encrypted: bool, split: bool, directory: bool) -> Member:
    message = "encrypted member unsupported" if encrypted else "split member unsupported" if split else "" if stored_ else "rar-compressed member unsupported (store only)"
    parts = failing(message) if message else failing("truncated member data") if len(body) < packed else lambda: checked(stored(body), size, crc)
    return Member(name, size, packed, parts, encrypted, directory, True)


def _wide_name(raw: bytes) -> str:
    """A RAR 4 name: plain, or plain, NUL and a packed form of what differs from it in UTF-16."""
    plain, mark, packed = raw.partition(b"\0")
    if not mark or not packed:
        return raw.decode("utf-8", "replace")
    high, at, out, flags, bits = packed[0], 1, [], 0, 0
    while at < len(packed):
        if not bits:
            flags, bits, at = packed[at], 8, at + 1
            continue
        bits -= 2
        way = flags >> bits & 3
        if way < 2 and at < len(packed):
            out.append(packed[at] | (high << 8 if way else 0))
            at += 1
        elif way == 2 and at + 1 < len(packed):
            out.append(packed[at] | packed[at + 1] << 8)
            at += 2
        elif way == 3:
            count, at = packed[at], at + 1
            shift = packed[at] if count & 0x80 and at < len(packed) else None
            at += shift is not None
            for _ in range((count & 0x7F) + 2):
                c = plain[len(out)] if len(out) < len(plain) else 0
                out.append(c if shift is None else ((c + shift) & 0xFF) | high << 8)
        else:
            break
    return b"".join(struct.pack("<H", c) for c in out).decode("utf-16-le", "replace")


def _four(data: bytes) -> Iterator[Member]:
    at = 7
    if data[at + 2 : at + 3] != b"\x73":
        return
    if struct.unpack_from("<H", data, at + 3)[0] & 0x80:
        raise MemberError("encrypted archive headers unsupported")
    while at + 7 <= len(data):
        kind, flags, size = struct.unpack_from("<xxBHH", data, at)
        if kind == 0x7B or size < 7:
            return
        head, body_at = data[at : at + size], at + size
        if kind not in (0x74, 0x7A):
            at = body_at + (struct.unpack_from("<I", head, 7)[0] if flags & 0x8000 and size >= 11 else 0)
            continue
        if size < 32:
            return
        packed, plain, _, crc, _, _, method, names = struct.unpack_from("<IIBIIBBH", head, 7)
        at_name = 32
        if flags & 0x100:
            hi_packed, hi_plain = struct.unpack_from("<II", head, 32)
            packed, plain, at_name = packed | hi_packed << 32, plain | hi_plain << 32, 40
        if not 0 < names <= MOST_NAME or at_name + names > size:
            return
        raw = head[at_name : at_name + names]
        at = body_at + packed
        if kind == 0x74:
            from .base import legacy_name

            name = _wide_name(raw).replace("\\", "/") if flags & 0x200 else legacy_name(raw)
            yield _member(name, plain, data[body_at:at], packed, crc, method == 0x30, bool(flags & 4), bool(flags & 3), flags & 0xE0 == 0xE0)


def _vint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while at < len(raw) and shift < 64:
        value |= (raw[at] & 0x7F) << shift
        at += 1
        if not raw[at - 1] & 0x80:
            return value, at
        shift += 7
    raise MemberError("corrupt rar header")


def _five(data: bytes) -> Iterator[Member]:
    at = 8
    while at + 5 <= len(data):
        try:
            size, start = _vint(data, at + 4)
            head = data[start : start + size]
            if not 0 < size <= MOST_HEADER or len(head) < size or zlib.crc32(data[at + 4 : start + size]) != int.from_bytes(data[at : at + 4], "little"):
                return
            kind, p = _vint(head, 0)
            flags, p = _vint(head, p)
            extra, p = _vint(head, p) if flags & 1 else (0, p)
            packed, p = _vint(head, p) if flags & 2 else (0, p)
            body_at = start + size
            at = body_at + packed
            if kind == 4:
                raise PermissionError
            if kind == 5:
                return
            if kind != 2:
                continue
            own, p = _vint(head, p)
            plain, p = _vint(head, p)
            _, p = _vint(head, p)
            p += 4 * bool(own & 2)
            crc = int.from_bytes(head[p : p + 4], "little") if own & 4 else None
            p += 4 * bool(own & 4)
            packing, p = _vint(head, p)
            _, p = _vint(head, p)
            names, p = _vint(head, p)
            if not 0 < names <= min(MOST_NAME, size - p):
                return
            encrypted, e = False, size - extra
            while extra and e < size:
                length, q = _vint(head, e)
                encrypted |= _vint(head, q)[0] == 1
                e = q + length
            unknown = bool(own & 8)
            yield _member(head[p : p + names].decode("utf-8", "replace").replace("\\", "/"), packed if unknown else plain, data[body_at:at], packed, crc, packing >> 7 & 7 == 0, encrypted, bool(flags & 24), bool(own & 1))
        except PermissionError:
            raise MemberError("encrypted archive headers unsupported") from None
        except MemberError:
            return
