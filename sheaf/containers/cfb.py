"""Compound files (OLE): sector chains, the directory tree, streams by path."""

from __future__ import annotations

import struct

FREE = 0xFFFFFFFA
MOST_STREAM = 1 << 30


class CompoundFile:
    """Streams by path as in `BodyText/Section0`; names compare without regard to case. Loops in chains or the tree end them."""

    def __init__(self, data: bytes):
        if data[:8] != b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" or len(data) < 512:
            raise ValueError("not a compound file")
        self.data = data
        shift, mini = struct.unpack_from("<HH", data, 30)
        if not 7 <= shift <= 16 or not 2 <= mini <= 12:
            raise ValueError("unlikely sector size")
        self.size, self.mini = 1 << shift, 1 << mini
        fats, root, self.cutoff, mini_at, _, more_at, more = self._head()
        places = [x for x in struct.unpack_from("<109I", data, 76) if x < FREE]
        seen: set[int] = set()
        while more_at < FREE and more_at not in seen and len(seen) <= more:
            seen.add(more_at)
            sector = self._sector(more_at)
            values = struct.unpack(f"<{len(sector) // 4}I", sector[: len(sector) // 4 * 4])
            places += [x for x in values[:-1] if x < FREE]
            more_at = values[-1] if values else FREE
        self.fat: list[int] = []
        for x in places[: fats or len(places)]:
            s = self._sector(x)
            self.fat += struct.unpack(f"<{len(s) // 4}I", s[: len(s) // 4 * 4])
        raw = self._chain(root, MOST_STREAM)
        self.entries = [raw[a : a + 128] for a in range(0, len(raw) - 127, 128)]
        if not self.entries:
            raise ValueError("no directory")
        self.ministream = self._chain(struct.unpack_from("<I", self.entries[0], 116)[0], MOST_STREAM)
        s = self._chain(mini_at, MOST_STREAM)
        self.minifat = struct.unpack(f"<{len(s) // 4}I", s[: len(s) // 4 * 4])
        self.found: dict[str, int] = {}
        self.names: dict[str, str] = {}
        self._walk()

    def _head(self) -> tuple[int, int, int, int, int, int, int]:
        fats, root = struct.unpack_from("<II", self.data, 44)
        cutoff, mini_at, minis, more_at, more = struct.unpack_from("<IIIII", self.data, 56)
        return fats, root, cutoff, mini_at, minis, more_at, more

    def _sector(self, n: int) -> bytes:
        return self.data[(n + 1) * self.size : (n + 2) * self.size]

    def _chain(self, n: int, most: int) -> bytes:
        out, seen = [], set()
        while n < min(FREE, len(self.fat)) and n not in seen and len(seen) * self.size < most:
            seen.add(n)
            out.append(self._sector(n))
            n = self.fat[n]
        return b"".join(out)

    def _mini_chain(self, n: int, size: int) -> bytes:
        out, seen = [], set()
        while n < min(FREE, len(self.minifat)) and n not in seen and len(seen) * self.mini < size:
            seen.add(n)
            out.append(self.ministream[n * self.mini : (n + 1) * self.mini])
            n = self.minifat[n]
        return b"".join(out)[:size]

    def _walk(self) -> None:
        todo, seen = [(struct.unpack_from("<I", self.entries[0], 76)[0], "")], set()
        while todo:
            n, prefix = todo.pop()
            if n >= len(self.entries) or n in seen:
                continue
            seen.add(n)
            e = self.entries[n]
            size, kind = struct.unpack_from("<HB", e, 64)
            name = prefix + e[: max(0, min(size, 64) - 2)].decode("utf-16-le", "replace")
            left, right, child = struct.unpack_from("<III", e, 68)
            if kind == 2:
                self.found[name.lower()] = n
                self.names[name.lower()] = name
            elif kind == 1:
                self.names[name.lower() + "/"] = name + "/"
                todo.append((child, name + "/"))
            todo += [(left, prefix), (right, prefix)]

    def has(self, path: str) -> bool:
        return path.lower() in self.found

    def paths(self, prefix: str = "") -> list[str]:
        """Streams (and storages, with a slash at the end) whose path begins so."""
        return sorted(p for p in self.names.values() if p.lower().startswith(prefix.lower()))

    def read(self, path: str) -> bytes:
        """A stream's content; empty if it isn't there."""
        n = self.found.get(path.lower())
        if n is None:
            return b""
        start, size = struct.unpack_from("<II", self.entries[n], 116)
        return self._mini_chain(start, size) if size < self.cutoff else self._chain(start, size)[:size]
