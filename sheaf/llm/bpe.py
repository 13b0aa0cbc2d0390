"""Byte-level BPE: encoding by DuckDB recursive queries in each partition, decoding by ordered aggregation."""

from __future__ import annotations

import base64
import hashlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache
from itertools import batched

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import holding, pieces, ranges, texts
from .words import Kept

#: Words, and bytes, that one recursive query contracts; both bound its memory.
WORDS_AT_ONCE, BYTES_AT_ONCE = 20_000, 200_000

#: Longer words, in bytes, come in stretches of STRETCH bytes that share LAP bytes with the one before, so that the rounds of
#: a query don't grow with a word.
LONGEST, STRETCH, LAP = 400, 96, 32
#: Pieces of a text coded at a time.
PIECES = 400_000
#: Tokens that one query decodes.
DECODED = 100_000

#: Words whose tokens a worker keeps from earlier slices.
KEPT = 600_000

#: One row a token, that also holds the token behind it and the rank at which the two would merge. Each round contracts the
#: leftmost pair of least rank of every word, joins the two new pairs to the merge table, and lets words without a pair go.
ENCODE = """
WITH RECURSIVE step(word, pos, next_pos, token, next_token, key, fixed) AS (
    SELECT word, pos, next_pos, token, next_token, (rank::BIGINT << 32) + pos, false
    FROM (SELECT word, pos, token, lead(pos) OVER w AS next_pos, lead(token) OVER w AS next_token FROM symbols WINDOW w AS (PARTITION BY word ORDER BY pos)) AS s
    LEFT JOIN merges ON merges.pair = (s.token::BIGINT << 20) + s.next_token
  UNION ALL (
    WITH best AS (
        SELECT word, min(key) AS least FROM step WHERE NOT fixed GROUP BY word
    ), chosen AS (
        SELECT a.word, a.pos, a.next_pos, (best.least >> 32)::INTEGER AS rank, b.next_pos AS after_pos, b.next_token AS after_token
        FROM best JOIN step AS a ON a.word = best.word AND a.key = best.least JOIN step AS b ON b.word = a.word AND b.pos = a.next_pos
    ), moved AS (
        SELECT s.word, s.pos,
            CASE WHEN s.pos = c.pos THEN c.after_pos ELSE s.next_pos END AS next_pos,
            CASE WHEN s.pos = c.pos THEN c.rank ELSE s.token END AS token,
            CASE WHEN s.pos = c.pos THEN c.after_token WHEN s.next_pos = c.pos THEN c.rank ELSE s.next_token END AS next_token,
            c.word IS NULL AS fixed
        FROM step AS s LEFT JOIN chosen AS c ON c.word = s.word WHERE NOT s.fixed AND (c.word IS NULL OR s.pos <> c.next_pos)
    )
    SELECT m.word, m.pos, m.next_pos, m.token, m.next_token, (merges.rank::BIGINT << 32) + m.pos, m.fixed
    FROM moved AS m LEFT JOIN merges ON merges.pair = (m.token::BIGINT << 20) + m.next_token
  )
)
SELECT word, token FROM step WHERE fixed ORDER BY word, pos
"""

DECODE = """
SELECT codes.doc AS doc, string_agg(vocabulary.hex, '' ORDER BY codes.pos) AS hex
FROM codes JOIN vocabulary ON vocabulary.token = codes.token GROUP BY codes.doc ORDER BY codes.doc
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@cache
def engine(path: str, pattern: str) -> DuckBpe:
    """One per worker process, so that its tables serve all of the worker's tasks."""
    return DuckBpe(path, pattern)


class DuckBpe:
    """The ranks of a .tiktoken file as DuckDB tables, and queries over them."""

    def __init__(self, path: str, pattern: str, memory: str = "160MB"):
        ranks = read_ranks(path)
        self.pattern = regex.compile(pattern)
        self.bytes = np.array([ranks[bytes([n])] for n in range(256)], np.int32)
        self.kept = Kept("<i4", KEPT, {k.decode(): np.array(r, "<i4").tobytes() for k, r in ranks.items() if _is_text(k)})
        # in-memory: what would not fit is an error of the task, never a file on a local disk
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": memory, "temp_directory": ""})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        self.lengths[list(ranks.values())] = [len(k) for k in ranks]
        rows = [(ranks[k[:n]], ranks[k[n:]], r) for k, r in ranks.items() for n in range(1, len(k)) if k[:n] in ranks and k[n:] in ranks]
        self._put("merges", {"pair": pa.array([(x[0] << 20) + x[1] for x in rows], pa.int64()), "rank": pa.array([x[2] for x in rows], pa.int32())})
        self._put("vocabulary", {"token": pa.array(list(ranks.values()), pa.int32()), "hex": pa.array([k.hex() for k in ranks])})

    def _put(self, name: str, columns: dict[str, pa.Array]) -> None:
        self.db.register("arrow_rows", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM arrow_rows")
        self.db.unregister("arrow_rows")

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each word one word after the other, and their number. Words that are tokens themselves need no query."""
        return self.kept.of(words, self._new)

    def _new(self, words: list[str]) -> list[bytes]:
        raw = [w.encode() for w in words]
        short = iter(self._queried([x for x in raw if len(x) <= LONGEST]))
        return [next(short) if len(x) <= LONGEST else self._stretched(x) for x in raw]

    def _queried(self, raw: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        for part in _parts(raw):
            counts, tokens = self._contracted(part)
            all_, ends = tokens.astype("<i4").tobytes(), 4 * np.cumsum(counts)
            out += [all_[b - 4 * n : b] for b, n in zip(ends.tolist(), counts.tolist(), strict=True)]
        return out

    def _stretched(self, word: bytes) -> bytes:
        """The tokens of a long word from those of its stretches.

        Tokens are what contraction gives if and only if each two neighbours are what it gives for the two of them. So two
        overlapping parts that have a token in common join there. Where they have none (long tokens, or text that repeats,
        out of step), longer stretches go on from a token further back; from the word's start on one is right by itself.
        """
        ids, begins, end, size = array("i"), array("q"), 0, STRETCH
        while end < len(word):
            lap, joined = LAP * size // STRETCH, True
            first = begins[max(0, bisect_right(begins, end - lap) - 1)] if end else 0
            starts = range(first, max(first + 1, len(word) - lap), size - lap)[: max(1, 2 * BYTES_AT_ONCE // size)]
            for start, found in zip(starts, self._queried([word[s : s + size] for s in starts]), strict=True):
                joined = self._joined(ids, begins, start, np.frombuffer(found, "<i4"))
                if not joined:
                    break
                end = min(start + size, len(word))
            size = max(STRETCH, size // 4) if joined else 4 * size
        return np.array(ids, "<i4").tobytes()

    def _joined(self, ids: array, begins: array, start: int, found: np.ndarray) -> bool:
        """Whether the tokens from `start` on could be joined to those before, which then hold them."""
        places = start + np.cumsum(self.lengths[found]) - self.lengths[found]
        at, k = 0, 0
        if start:
            known = {(begins[n], ids[n]): n for n in range(bisect_left(begins, start), len(begins))}
            k = next((k for k, x in enumerate(zip(places.tolist(), found.tolist(), strict=True)) if x in known), -1)
            if k < 0:
                return False
            at = known[int(places[k]), int(found[k])]
        del ids[at:], begins[at:]
        ids.extend(found[k:].tolist())
        begins.extend(places[k:].tolist())
        return True

    def _contracted(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(x) for x in raw], np.int64)
        symbols = self.bytes[np.frombuffer(b"".join(raw), np.uint8)]
        self._put("symbols", {"word": pa.array(np.repeat(np.arange(len(raw), dtype=np.int32), lengths)), "pos": pa.array(ranges(np.zeros(len(raw), np.int64), lengths).astype(np.int32)), "token": pa.array(symbols)})
        found = self.db.sql(ENCODE).to_arrow_table()
        return np.bincount(np.asarray(found["word"]), minlength=len(raw)), np.asarray(found["token"])

    def encode(self, column: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one document after the other, and each document's number of ids. A long text's pieces come in parts."""
        parts, counts = [], np.zeros(len(column), np.int64)
        for docs, pieces in self._split(column):
            coded = pa.array(pieces, pa.string()).dictionary_encode()
            codes = np.asarray(coded.indices, dtype=np.int64)
            tokens, own = self.words(coded.dictionary.to_pylist())
            each = own[codes]
            parts.append(tokens[ranges((np.cumsum(own) - own)[codes], each)])
            before = np.append(0, np.cumsum(each))
            at = 0
            for d, n in docs:
                counts[d] += before[at + n] - before[at]
                at += n
        return np.concatenate([np.zeros(0, np.int32), *parts]), counts

    def _split(self, column: list[str]) -> Iterator[tuple[list[tuple[int, int]], list[str]]]:
        """Groups of up to about PIECES pieces, with how many of them each document has."""
        docs: list[tuple[int, int]] = []
        held: list[str] = []
        for d, text in enumerate(column):
            found = [self.pattern.findall(text)] if len(text) <= PIECES else batched((m[0] for m in self.pattern.finditer(text)), PIECES)
            for some in found:
                docs.append((d, len(some)))
                held += some
                if len(held) >= PIECES:
                    yield docs, held
                    docs, held = [], []
        yield docs, held

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of each document's ids, in order."""
        out: list[list[bytes]] = [[] for _ in counts]
        for doc, raw in self.decoded(ids, counts):
            out[doc].append(raw)
        return [b"".join(x) for x in out]

    def decoded(self, ids: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """The bytes of each document's ids in order, those of a long one in several parts: (document, bytes)."""
        ends = np.cumsum(counts)
        for a in range(0, len(ids), DECODED):
            b = min(a + DECODED, len(ids))
            first, last = np.searchsorted(ends, a, "right"), np.searchsorted(ends, b, "left")
            cuts = np.concatenate([[a], ends[first:last], [b]])
            docs = np.repeat(np.arange(first, last + 1, dtype=np.int32), np.diff(cuts))
            self._put("codes", {"doc": pa.array(docs), "pos": pa.array(np.arange(b - a, dtype=np.int64)), "token": pa.array(ids[a:b].astype(np.int32))})
            found = self.db.sql(DECODE).to_arrow_table()
            yield from zip(found["doc"].to_pylist(), map(bytes.fromhex, found["hex"].to_pylist()), strict=True)


def _parts(raw: list[bytes]) -> Iterator[list[bytes]]:
    """At most WORDS_AT_ONCE words and BYTES_AT_ONCE bytes a query, or one longer word."""
    part, size = [], 0
    for w in raw:
        if part and (len(part) >= WORDS_AT_ONCE or size + len(w) > BYTES_AT_ONCE):
            yield part
            part, size = [], 0
        part.append(w)
        size += len(w)
    if part:
        yield part


def _is_text(raw: bytes) -> bool:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


def encode(docs: DataFrame, ranks: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every whole text; no shuffle. A null text is the empty one and has no ids; equal
    rows are encoded each; an empty table gives no rows; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding("bpe", engine.cache_clear)
        db = engine(ranks, pattern)
        for batch in pieces(batches):
            ids, counts = db.encode(batch.column(1).to_pylist())
            offsets = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids))], ["doc_id", "ids"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, ranks: str, pattern: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the bytes of `ids` in order; null ids are none. Ids outside the vocabulary stand for nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding("bpe", engine.cache_clear)
        db = engine(ranks, pattern)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                lists = pc.fill_null(part.column(1), pa.scalar([], part.column(1).type))
                counts = np.asarray(pc.list_value_length(lists), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(db.decode(np.asarray(pc.list_flatten(lists)), counts), pa.binary())], ["doc_id", "bytes"])

    return tokens.selectExpr(f"cast(`{id_col}` AS long) doc_id", f"cast(`{ids_col}` AS array<int>) ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip_digest(docs: DataFrame, ranks: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every whole text, then decodes the ids: doc_id, n_tokens, ids_sha256, decoded_sha256. Nulls as in `encode`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding("bpe", engine.cache_clear)
        db = engine(ranks, pattern)
        for batch in pieces(batches, limit=3 << 20):
            ids, counts = db.encode(batch.column(1).to_pylist())
            raw, ends = ids.astype("<u4").tobytes(), 4 * np.cumsum(counts)
            decoded = [hashlib.sha256() for _ in counts]
            for doc, text in db.decoded(ids, counts):
                decoded[doc].update(text)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0),
                "n_tokens": pa.array(counts, pa.int64()),
                "ids_sha256": [hashlib.sha256(raw[b - 4 * n : b]).hexdigest() for b, n in zip(ends.tolist(), counts.tolist(), strict=True)],
                "decoded_sha256": [x.hexdigest() for x in decoded],
            })

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
