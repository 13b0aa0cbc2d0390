"""What a worker process keeps of words it has seen, within a bound."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class Kept:
    """Token ids of words as packed bytes, in two generations: when the younger is full it becomes the older, whose words
    come back when they are met again. Holds at most `most` words besides the fixed ones."""

    def __init__(self, kind: str, most: int, fixed: dict[str, bytes] | None = None):
        self.kind, self.most, self.fixed = np.dtype(kind), most, fixed or {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def of(self, words: list[str], compute: Callable[[list[str]], list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words one after the other, and their number; compute gives those of words that aren't kept."""
        found = list(map(self.young.get, words))
        missing, back = [], {}
        fixed, old = self.fixed.get, self.old.get
        for i, x in enumerate(found):
            if x is None:
                w = words[i]
                x = fixed(w)
                if x is None and (x := old(w)) is not None:
                    back[w] = x
                if x is None:
                    missing.append(i)
                found[i] = x
        new = [words[i] for i in missing]
        for i, w, x in zip(missing, new, compute(new) if new else [], strict=True):
            found[i] = back[w] = x
        if len(self.young) + len(back) > self.most // 2:
            self.old, self.young = self.young, {}
        if len(back) <= self.most // 2:
            self.young.update(back)
        ids = np.frombuffer(b"".join(found), self.kind)
        return ids, np.fromiter(map(len, found), np.int64, len(found)) // self.kind.itemsize
