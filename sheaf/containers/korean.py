"""ALZ and EGG archives."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from .base import Member, MemberError, bunzipped, checked, failing, inflated, legacy_name, raw_lzma, stored

MOST_NAME = 4096


def alz_members(data: bytes) -> Iterator[Member]:
    """Local headers in sequence: `BLZ\\1`, name size, flags whose upper four bits are the width of the sizes, the data."""
    at = 8
    while data[at : at + 4] == b"BLZ\1" and at + 13 <= len(data):
        names, flags = struct.unpack_from("<H5xH", data, at + 4)
        at += 13
        encrypted, width = bool(flags & 1), flags >> 4 & 15
        if not 0 < names <= MOST_NAME or width not in (0, 1, 2, 4, 8):
            return
        method = crc = packed = size = 0
        if width:
            if at + 6 + 2 * width > len(data):
                return
            method, crc = struct.unpack_from("<HI", data, at)
            packed, size = (int.from_bytes(data[at + 6 + k * width : at + 6 + (k + 1) * width], "little") for k in (0, 1))
            at += 6 + 2 * width
        name, at = legacy_name(data[at : at + names]), at + names
        body = data[at + 12 * encrypted : at + 12 * encrypted + packed]
        at += packed + 12 * encrypted
        yield Member(name, size, packed, _alz_parts(body, method & 0xFF, size, crc, encrypted), encrypted, skip_empty=True)


def _alz_parts(body: bytes, method: int, size: int, crc: int, encrypted: bool):
    if encrypted:
        return failing("encrypted member unsupported")
    decoder = {0: stored, 1: bunzipped, 2: inflated}.get(method)
    if not decoder:
        return failing("unknown alz compression method")
    return lambda: checked(decoder(body), size, crc)


#: Signatures of EGG records.
EGG, END, FILE, NAME, BLOCK = 0x41474745, 0x08E28222, 0x0A8590E3, 0x0A8591AC, 0x02B50C13
ENCRYPT, SOLID, SPLIT, GLOBAL_ENCRYPT = 0x08D1470F, 0x24E5A060, 0x24F5A262, 0x08D144A8


class Egg:
    """Records one after the other: file headers with their extra fields, then blocks of data; in a solid archive all
    headers come first and one stream of blocks holds the files in order."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 14
        self.marks: set[int] = set()
        while (sig := self._sig()) != END:
            self.marks.add(sig)
            self._extra()

    def _take(self, size: int) -> bytes:
        if self.at + size > len(self.data):
            raise MemberError("truncated member data")
        self.at += size
        return self.data[self.at - size : self.at]

    def _sig(self) -> int:
        return int.from_bytes(self._take(4), "little")

    def _extra(self) -> tuple[int, bytes]:
        flag = self._take(1)[0]
        return flag, self._take(int.from_bytes(self._take(4 if flag & 1 else 2), "little"))

    def _name(self) -> tuple[str, bool]:
        flag, raw = self._extra()
        area = int.from_bytes(raw[:2], "little") if flag & 8 else 0
        raw = raw[2 * bool(flag & 8) + 4 * bool(flag & 16) :]
        if flag & 4:
            return "(encrypted name)", True
        return (raw.decode("cp949", "replace").replace("\\", "/") if area == 949 else legacy_name(raw)), False

    def members(self) -> Iterator[Member]:
        try:
            yield from self._solid() if SOLID in self.marks else self._each()
        except MemberError:
            return

    def _header(self) -> Member | None:
        """The next file's header; None where there is no more, with a block's signature left unread."""
        while (sig := self._sig()) != FILE:
            if sig in (END, EGG, SOLID, SPLIT):
                return None
            if sig == BLOCK:
                self.at -= 4
                return None
            self._extra()
        size, name, encrypted = struct.unpack("<4xQ", self._take(12))[0], "", False
        while (sig := self._sig()) != END:
            if sig == BLOCK:
                self.at -= 4
                break
            if sig == NAME:
                name, hidden = self._name()
                encrypted |= hidden
            else:
                encrypted |= sig == ENCRYPT
                self._extra()
        return Member(name, size, 0, failing("no member data"), encrypted or GLOBAL_ENCRYPT in self.marks, name.endswith("/"), True)

    def _each(self) -> Iterator[Member]:
        while m := self._header():
            blocks, left, broken = [], m.size, ""
            while left > 0 and not broken:
                try:
                    if self._sig() != BLOCK:
                        raise MemberError("corrupt egg block header")
                    block = self._block()
                    if block[1] > left:
                        raise MemberError("corrupt egg block (size overrun)")
                    blocks.append(block)
                    left -= block[1]
                except MemberError as e:
                    broken = str(e)
            m.packed = sum(len(b[3]) for b in blocks)
            message = "encrypted member unsupported" if m.encrypted else "split archive unsupported" if SPLIT in self.marks else broken
            m.parts = failing(message) if message else lambda b=blocks: _decoded(b)
            yield m
            if broken:
                return

    def _solid(self) -> Iterator[Member]:
        found = []
        while m := self._header():
            found.append(m)
        blocks = []
        while self._sig() == BLOCK:
            blocks.append(self._block())
            if self.at + 4 > len(self.data):
                break
        source = _Slices(_decoded(blocks))
        for m in found:
            m.parts = failing("encrypted member unsupported") if m.encrypted else lambda m=m: source.take(m.size)
            source.left = m.size
            yield m
            source.finish()

    def _block(self) -> tuple[int, int, int, bytes]:
        method, _, size, packed, crc = struct.unpack("<BBIII", self._take(14))
        while self._sig() != END:
            self._extra()
        return method, size, crc, self._take(packed)


def _decoded(blocks: list[tuple[int, int, int, bytes]]) -> Iterator[bytes]:
    for method, size, crc, body in blocks:
        if method == 3:
            raise MemberError("AZO-compressed member unsupported (proprietary codec)")
        if method == 4:
            parts = _egg_lzma(body, size)
        elif decoder := {0: stored, 1: inflated, 2: bunzipped}.get(method):
            parts = decoder(body)
        else:
            raise MemberError("unknown egg compression method")
        yield from checked(parts, size, crc)


def _egg_lzma(body: bytes, size: int) -> Iterator[bytes]:
    """Two bytes, the size of the properties, the properties, the stream."""
    import lzma

    if len(body) < 9 or int.from_bytes(body[2:4], "little") != 5:
        raise MemberError("unsupported lzma properties")
    mode, room = body[4], int.from_bytes(body[5:9], "little")
    lc, lp, pb = mode % 9, mode // 9 % 5, mode // 45
    if mode >= 225:
        raise MemberError("invalid lzma properties")
    return raw_lzma(body[9:], [{"id": lzma.FILTER_LZMA1, "dict_size": max(room, 4096), "lc": lc, "lp": lp, "pb": pb}], size)


class _Slices:
    """One stream handed out member by member; what a reader leaves unread of its member is passed over."""

    def __init__(self, parts: Iterator[bytes]):
        self.parts, self.rest, self.left = parts, b"", 0

    def take(self, size: int) -> Iterator[bytes]:
        self.left = size
        while self.left > 0:
            if not self.rest:
                self.rest = next(self.parts, b"")
                if not self.rest:
                    raise MemberError("truncated solid data")
            part, self.rest = self.rest[: self.left], self.rest[self.left :]
            self.left -= len(part)
            yield part

    def finish(self) -> None:
        try:
            for _ in self.take(self.left):
                pass
        except MemberError:
            self.left = 0
