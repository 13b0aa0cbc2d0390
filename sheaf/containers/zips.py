"""Zip files by their central directory, zip64 included."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

from .base import Member, MemberError, inflated, stored

MOST_ENTRIES = 10_000_000


@dataclass
class Entry:
    name: str
    method: int
    encrypted: bool
    crc: int
    packed: int
    size: int
    offset: int


class ZipFileReader:
    """Entries in directory order; names are Korean unless they are UTF-8 or flagged so."""

    def __init__(self, data: bytes):
        self.data = data
        self.entries: list[Entry] = []
        end = data.rfind(b"PK\5\6", max(0, len(data) - 65557))
        if end < 0 or end + 22 > len(data):
            raise ValueError("no zip directory")
        count, size, at = struct.unpack_from("<HII", data, end + 10)
        if 0xFFFF == count or 0xFFFFFFFF in (size, at):
            count, at = self._zip64(end, count, at)
        if at > len(data):
            raise ValueError("zip directory out of bounds")
        for _ in range(min(count, MOST_ENTRIES)):
            if data[at : at + 4] != b"PK\1\2" or at + 46 > len(data):
                break
            flags, method = struct.unpack_from("<HH", data, at + 8)
            crc, packed, size, names, extras, comments = struct.unpack_from("<IIIHHH", data, at + 16)
            offset = struct.unpack_from("<I", data, at + 42)[0]
            raw, extra = data[at + 46 : at + 46 + names], data[at + 46 + names : at + 46 + names + extras]
            packed, size, offset = self._large(extra, packed, size, offset)
            self.entries.append(Entry(_name(raw, bool(flags & 0x800)), method, bool(flags & 1), crc, packed, size, offset))
            at += 46 + names + extras + comments
        self.by_name = {e.name: e for e in reversed(self.entries)}

    def _zip64(self, end: int, count: int, at: int) -> tuple[int, int]:
        if self.data[end - 20 : end - 16] == b"PK\6\7":
            where = struct.unpack_from("<Q", self.data, end - 12)[0]
            if self.data[where : where + 4] == b"PK\6\6" and where + 56 <= len(self.data):
                return struct.unpack_from("<Q", self.data, where + 32)[0], struct.unpack_from("<Q", self.data, where + 48)[0]
        return count, at

    @staticmethod
    def _large(extra: bytes, packed: int, size: int, offset: int) -> tuple[int, int, int]:
        values, at = [size, packed, offset], 0
        while at + 4 <= len(extra):
            kind, length = struct.unpack_from("<HH", extra, at)
            if kind == 1:
                field = extra[at + 4 : at + 4 + length]
                for n, v in enumerate(values):
                    if v == 0xFFFFFFFF and len(field) >= 8:
                        values[n], field = struct.unpack_from("<Q", field)[0], field[8:]
            at += 4 + length
        return values[1], values[0], values[2]

    def has(self, name: str) -> bool:
        return name in self.by_name

    def names(self, prefix: str = "") -> list[str]:
        return [e.name for e in self.entries if e.name.startswith(prefix)]

    def raw(self, e: Entry) -> bytes:
        head = self.data[e.offset : e.offset + 30]
        if len(head) < 30 or head[:4] != b"PK\3\4":
            raise MemberError("corrupt zip entry")
        names, extras = struct.unpack_from("<HH", head, 26)
        a = e.offset + 30 + names + extras
        return self.data[a : a + e.packed]

    def parts(self, e: Entry) -> Iterator[bytes]:
        if e.encrypted:
            raise MemberError("encrypted member unsupported")
        if e.method not in (0, 8):
            raise MemberError("unsupported compression method")
        raw = self.raw(e)
        if len(raw) < e.packed:
            raise MemberError("corrupt zip entry (truncated)")
        yield from stored(raw) if e.method == 0 else inflated(raw)

    def read(self, name: str, most: int = 1 << 30) -> bytes:
        """A part's content up to a size; empty if it isn't there."""
        e = self.by_name.get(name)
        if not e:
            return b""
        out = bytearray()
        for part in self.parts(e):
            out += part
            if len(out) > most:
                raise MemberError("part too large")
        return bytes(out)

    def members(self) -> Iterator[Member]:
        for e in self.entries:
            yield Member(e.name, e.size, e.packed, lambda e=e: self.parts(e), e.encrypted, not e.name or e.name.endswith("/"))


def _name(raw: bytes, utf8: bool) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return raw.decode("utf-8" if utf8 else "cp949", "replace")


