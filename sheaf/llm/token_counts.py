"""Token counts by byte-pair merging over a heap and a linked list; no identifiers are made."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, texts

#: The pattern by which byte-level BPE splits text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pieces of text whose counts a worker keeps; when full, the table starts anew.
KEPT = 150_000
#: Texts of so many characters are split piece by piece.
LONG = 1 << 20


@cache
def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


@cache
def counter(path: str) -> MergeCounter:
    """One per worker process, so that its pieces serve all of the worker's tasks."""
    return MergeCounter(path)


class MergeCounter:
    """Counts the tokens of a byte-level BPE vocabulary file (.json)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        if said["model"]["type"] != "BPE" or (said["pre_tokenizer"] or {}).get("type") != "ByteLevel" or said["normalizer"]:
            raise ValueError("only byte-level BPE files without a normalizer are counted")
        pairs = [tuple(x.split(" ") if isinstance(x, str) else x) for x in said["model"]["merges"]]
        symbols = {s: n for n, s in enumerate(dict.fromkeys([*byte_symbols(), *(a + b for a, b in pairs)]))}
        self.start = [symbols[s] for s in byte_symbols()]
        self.merges = {(symbols[a], symbols[b]): (rank, symbols[a + b]) for rank, (a, b) in enumerate(pairs)}
        specials = sorted((x["content"] for x in said["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.pattern = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def merged(self, piece: bytes) -> int:
        """Symbols left of one piece: its bytes less the merges made.

        The heap holds adjacent pairs as (rank, left position, left symbol, right symbol). Positions form a linked list;
        an entry whose symbols have changed since is stale and skipped.
        """
        symbol, size = [self.start[b] for b in piece], len(piece)
        after, before, merges = [*range(1, size), -1], [*range(-1, size - 1)], self.merges
        heap = [(m[0], i, a, b) for i, (a, b) in enumerate(zip(symbol, symbol[1:], strict=False)) if (m := merges.get((a, b)))]
        heapq.heapify(heap)
        made = 0
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != a or j < 0 or symbol[j] != b:
                continue
            made += 1
            new = merges[a, b][1]
            symbol[i], symbol[j] = new, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if m := merges.get((new, symbol[k])):
                    heapq.heappush(heap, (m[0], i, new, symbol[k]))
            h = before[i]
            if h >= 0 and (m := merges.get((symbol[h], new))):
                heapq.heappush(heap, (m[0], h, symbol[h], new))
        return size - made

    def count(self, text: str) -> int:
        """Tokens of a whole text; a special token's string in it counts one."""
        if self.special and (parts := self.special.split(text))[1:]:
            return len(parts) - 1 + sum(map(self._plain, parts))
        return self._plain(text)

    def _plain(self, text: str) -> int:
        known, total, new = self.known, 0, self._new
        # the pieces of a long text are never held together
        for piece in self.pattern.findall(text) if len(text) < LONG else (m[0] for m in self.pattern.finditer(text)):
            total += known.get(piece) or new(piece)
        return total

    def _new(self, piece: str) -> int:
        if len(self.known) >= KEPT:
            self.known.clear()
        n = self.merged(piece.encode("utf-8", "surrogatepass"))
        if len(piece) <= 64:
            self.known[piece] = n
        return n


def token_counts(docs: DataFrame, tokenizer: str, *, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text; no shuffle.

    A null text is the empty one: 0 bytes, 0 tokens. Repeated rows are counted each; an empty table gives no rows; other
    columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer).count
        for batch in pieces(batches):
            found = np.fromiter(map(count, batch.column(1).to_pylist()), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.binary_length(batch.column(1)).cast(pa.int64()), pa.array(found)], ["doc_id", "n_bytes", "n_tokens"])

    counted = texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
