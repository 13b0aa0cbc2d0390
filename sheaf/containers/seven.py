"""7z archives: headers, folders decoded by their coders, members cut from them. PPMd and encrypted folders are reported."""

from __future__ import annotations

import bz2
import io
import lzma
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from .base import Member, MemberError, failing

_FILTERS = {b"\x03\x01\x01": lzma.FILTER_LZMA1, b"\x21": lzma.FILTER_LZMA2, b"\x03": lzma.FILTER_DELTA, b"\x03\x03\x01\x03": lzma.FILTER_X86, b"\x04": lzma.FILTER_X86}
#: A folder that unpacks to more is reported before it is decoded.
MOST_FOLDER = 1 << 30


@dataclass
class Folder:
    coders: list[tuple[bytes, bytes]] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    crc: int | None = None
    files: list[int] = field(default_factory=list)
    simple: bool = True


class _Head:
    def __init__(self, raw: bytes):
        self.f = io.BytesIO(raw)

    def take(self, n: int) -> bytes:
        raw = self.f.read(n)
        if len(raw) < n:
            raise MemberError("corrupt 7z header")
        return raw

    def byte(self) -> int:
        return self.take(1)[0]

    def number(self) -> int:
        first, value = self.byte(), 0
        for n in range(8):
            if not first & 0x80 >> n:
                return value | (first & (0x7F >> n)) << 8 * n
            value |= self.byte() << 8 * n
        return value

    def flags(self, n: int) -> list[bool]:
        raw = self.take((n + 7) // 8)
        return [bool(raw[k // 8] & 0x80 >> k % 8) for k in range(n)]

    def some(self, n: int) -> list[bool]:
        return [True] * n if self.byte() else self.flags(n)

    def crcs(self, n: int) -> list[int | None]:
        return [int.from_bytes(self.take(4), "little") if d else None for d in self.some(n)]


class Archive:
    def __init__(self, data: bytes):
        self.data = data
        if len(data) < 32:
            raise MemberError("corrupt 7z archive")
        at, size, _ = struct.unpack_from("<QQI", data, 12)
        raw = data[32 + at : 32 + at + size]
        if len(raw) < size:
            raise MemberError("corrupt 7z archive (truncated)")
        self.folders: list[Folder] = []
        self.packed: list[int] = []
        self.start, self.entries = 32, []
        while raw and raw[0] == 0x17:
            head = _Head(raw[1:])
            self._streams(head)
            raw = self._decoded(0)
        if raw:
            head = _Head(raw)
            if head.byte() != 1:
                raise MemberError("corrupt 7z header")
            self._header(head)

    def _header(self, head: _Head) -> None:
        self.folders, self.packed, subs = [], [], ([], [])
        while kind := head.byte():
            if kind == 2:
                while head.byte():
                    head.take(head.number())
            elif kind == 4:
                subs = self._streams(head)
            elif kind == 5:
                self._files(head, *subs)
                return

    def _streams(self, head: _Head) -> tuple[list[list[int]], list[list[int | None]]]:
        self.folders, self.packed = [], []
        sizes: list[list[int]] = []
        crcs: list[list[int | None]] = []
        while kind := head.byte():
            if kind == 6:
                self.start, count = 32 + head.number(), head.number()
                while inner := head.byte():
                    if inner == 9:
                        self.packed = [head.number() for _ in range(count)]
                    elif inner == 10:
                        head.crcs(count)
            elif kind == 7:
                self._unpack(head)
            elif kind == 8:
                sizes, crcs = self._substreams(head)
        if not sizes:
            sizes, crcs = [[f.sizes[-1]] for f in self.folders], [[f.crc] for f in self.folders]
        return sizes, crcs

    def _unpack(self, head: _Head) -> None:
        if head.byte() != 11:
            raise MemberError("corrupt 7z header")
        count = head.number()
        if head.byte():
            raise MemberError("unsupported 7z header")
        outs = []
        for _ in range(min(count, 1 << 20)):
            folder, ins, total = Folder(), 0, 0
            for _ in range(head.number()):
                flag = head.byte()
                name = head.take(flag & 15)
                n_in, n_out = (head.number(), head.number()) if flag & 16 else (1, 1)
                folder.simple &= n_in == n_out == 1
                folder.coders.append((name, head.take(head.number()) if flag & 32 else b""))
                ins, total = ins + n_in, total + n_out
            for _ in range(total - 1):
                head.number(), head.number()
            if ins - (total - 1) > 1:
                for _ in range(ins - (total - 1)):
                    head.number()
            outs.append(total)
            self.folders.append(folder)
        while kind := head.byte():
            if kind == 12:
                for folder, n in zip(self.folders, outs, strict=True):
                    folder.sizes = [head.number() for _ in range(n)]
            elif kind == 10:
                for folder, crc in zip(self.folders, head.crcs(len(self.folders)), strict=True):
                    folder.crc = crc

    def _substreams(self, head: _Head) -> tuple[list[list[int]], list[list[int | None]]]:
        counts, kind = [1] * len(self.folders), head.byte()
        if kind == 13:
            counts = [head.number() for _ in self.folders]
            kind = head.byte()
        sizes = []
        for folder, n in zip(self.folders, counts, strict=True):
            own = [head.number() for _ in range(n - 1)] if kind == 9 else []
            sizes.append([*own, folder.sizes[0] - sum(own)] if n else [])
        if kind == 9:
            kind = head.byte()
        crcs = [[f.crc] if n == 1 and f.crc is not None else [None] * n for f, n in zip(self.folders, counts, strict=True)]
        while kind:
            if kind == 10:
                open_ = [(i, k) for i, (f, n) in enumerate(zip(self.folders, counts, strict=True)) for k in range(n) if n != 1 or f.crc is None]
                for (i, k), crc in zip(open_, head.crcs(len(open_)), strict=True):
                    crcs[i][k] = crc
            kind = head.byte()
        return sizes, crcs

    def _files(self, head: _Head, sizes: list, crcs: list) -> None:
        count = head.number()
        names, empty, dirs = [""] * count, [False] * count, []
        while kind := head.byte():
            size = head.number()
            own = _Head(head.take(size))
            if kind == 14:
                empty = own.flags(count)
            elif kind == 15:
                dirs = own.flags(sum(empty))
            elif kind == 17 and not own.byte():
                names = own.f.read().decode("utf-16-le", "replace").split("\0")[:count]
        flat = [(f, s, c) for f, (ss, cc) in enumerate(zip(sizes, crcs, strict=True)) for s, c in zip(ss, cc, strict=True)]
        flat_at, dir_at = iter(flat), iter(dirs)
        for name, nothing in zip(names, empty, strict=False):
            folder, size, crc = (-1, 0, None) if nothing else next(flat_at, (-1, 0, None))
            self.entries.append((name.replace("\\", "/"), folder, size, crc, nothing and not next(dir_at, False)))

    def _decoded(self, n: int) -> bytes:
        """A folder's whole output, through its coders from the last to the first."""
        folder = self.folders[n]
        if any(name.startswith(b"\x06\xf1\x07") for name, _ in folder.coders):
            raise MemberError("encrypted member unsupported")
        if not folder.simple or not folder.sizes:
            raise MemberError("unsupported 7z coder")
        if max(folder.sizes) > MOST_FOLDER:
            raise MemberError("unsupported 7z folder size")
        a = self.start + sum(self.packed[:n])
        raw = self.data[a : a + (self.packed[n] if n < len(self.packed) else 0)]
        try:
            for k, (name, props) in reversed(list(enumerate(folder.coders))):
                raw = _coded(name, props, raw, folder.sizes[k])
        except (lzma.LZMAError, zlib.error, OSError, EOFError, ValueError) as e:
            raise e if isinstance(e, MemberError) else MemberError("corrupt 7z data") from e
        return raw

    def members(self) -> Iterator[Member]:
        held, content, broken, at = -1, b"", "", 0
        for name, folder, size, crc, directory in self.entries:
            if folder < 0:
                yield Member(name, 0, 0, lambda: iter(()), directory=directory)
                continue
            if folder != held:
                held, at, broken = folder, 0, ""
                try:
                    content = self._decoded(folder)
                except MemberError as e:
                    content, broken = b"", str(e)
            body = content[at : at + size]
            at += size
            if not broken and (len(body) < size or crc is not None and zlib.crc32(body) != crc):
                yield Member(name, size, 0, failing("member crc mismatch"))
            else:
                yield Member(name, size, 0, failing(broken) if broken else lambda b=body: iter([b] if b else []), "encrypted" in broken)


def _coded(name: bytes, props: bytes, raw: bytes, size: int) -> bytes:
    if name == b"\0":
        return raw[:size]
    if name == b"\x04\x01\x08":
        return zlib.decompressobj(-15).decompress(raw, size)
    if name == b"\x04\x02\x02":
        return bz2.BZ2Decompressor().decompress(raw, size)
    kind = _FILTERS.get(name)
    if kind is None:
        raise MemberError("PPMd-compressed member unsupported" if name == b"\x03\x04\x01" else "unsupported 7z coder")
    if kind == lzma.FILTER_LZMA1:
        mode, room = props[0], int.from_bytes(props[1:5], "little")
        options = {"id": kind, "dict_size": max(room, 4096), "lc": mode % 9, "lp": mode // 9 % 5, "pb": mode // 45}
    elif kind == lzma.FILTER_LZMA2:
        b = props[0]
        options = {"id": kind, "dict_size": 0xFFFFFFFF if b == 40 else (2 | b & 1) << (b // 2 + 11)}
    else:
        options = {"id": kind} | ({"dist": props[0] + 1} if kind == lzma.FILTER_DELTA and props else {})
        if kind != lzma.FILTER_DELTA:
            # a branch filter needs a decoder behind it: stored LZMA2 chunks
            raw = b"".join(b"\x01" + struct.pack(">H", len(c) - 1) + c for c in (raw[i : i + 65536] for i in range(0, len(raw), 65536))) + b"\0"
            return lzma.decompress(raw, lzma.FORMAT_RAW, filters=[options, {"id": lzma.FILTER_LZMA2, "dict_size": 1 << 16}])[:size]
        raise MemberError("unsupported 7z coder")
    return lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[options]).decompress(raw, size)


def members(data: bytes) -> Iterator[Member]:
    try:
        archive = Archive(data)
    except MemberError:
        raise
    except (IndexError, OverflowError, ValueError, struct.error) as e:
        raise MemberError("corrupt 7z header") from e
    return archive.members()
