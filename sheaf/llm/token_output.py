"""Token ids as binary shards: each document is one zstandard frame under a shared dictionary, found by an offset index.

Shard file (little-endian):

    b"TIDZ" | u32 version | frames ... | index | header JSON | u64 index offset | u32 header length | b"TIDZ"

The index holds, per document in file order, doc_id i64, null-id flag u8, first-token position u64 (within the shard),
frame offset u64; each of the last two has one more entry for the end. The header names the width of an id in bytes,
the number of documents and the sha256 of the dictionary. One document is read with the footer and one frame only.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, pieces, ranges, scratch, texts, written
from .words import Kept

#: Fixed value: how a tokenizer's file says that small letters are made and then parted from signs by this pattern.
LOWERED = r"""{"type":"Lowercase"}]},"pre_tokenizer":{"type":"Sequence","pretokenizers":[{"type":"Split","pattern":{"Regex":"'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},"behavior":"Removed","invert":true}"""

MAGIC = b"TIDZ"
VERSION = 1


#: Words whose ids a worker keeps from earlier slices.
KEPT = 500_000


@cache
def encoder(path: str) -> WordwiseEncoder:
    """One per worker process, so that its words serve all of the worker's tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordwiseEncoder(path)


class WordwiseEncoder:
    """Encodes with the tokenizers library, each distinct run between spaces and line feeds once while a worker keeps it.

    Right for tokenizers whose pre-tokenizer never joins characters across such white space and drops it, and whose
    added tokens hold none, as `splits_at_spaces` tells; other tokenizers get whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocab = self.tokenizer.get_vocab_size()
        self.wordwise = splits_at_spaces(self.tokenizer)
        self.fine = self.wordwise and LOWERED in self.tokenizer.to_str()
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.kept = Kept("<u2" if self.vocab <= 1 << 16 else "<u4", KEPT)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one document after the other, and each document's number of ids."""
        if not self.wordwise:
            found = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(column.to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.uint32), *found]), np.array([len(x) for x in found], np.int64)
        at, codes, distinct = _dictionary(pc.split_pattern(pc.replace_substring(column.cast(pa.large_string()), "\n", " "), " "))
        parts_at, part_codes, parts = _dictionary(pc.split_pattern(self._parted(distinct), " "))
        flat, own = self.kept.of(parts.to_pylist(), self._new)
        flat, own = _gathered(flat, own, part_codes, parts_at)
        return _gathered(flat, own, codes, at)

    def _new(self, words: list[str]) -> list[bytes]:
        kind = "H" if self.vocab <= 1 << 16 else "I"
        return [array(kind, x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _parted(self, words: pa.Array) -> pa.Array:
        """Words in small letters with their signs set apart, as the tokenizer does anyway; not those with an added token."""
        if not self.fine:
            return words
        plain = pc.replace_substring_regex(pc.ascii_lower(words), r"([a-z])([!-&(-/:-@\[-`{-~])", r"\1 \2")
        for x in self.added:
            plain = pc.if_else(pc.match_substring(words, x, ignore_case=True), words, plain)
        return plain


def _dictionary(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Bounds of the lists, their values as codes, and what the codes stand for."""
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    return offsets - offsets[0], np.asarray(coded.indices, dtype=np.int64), coded.dictionary


def _gathered(flat: np.ndarray, own: np.ndarray, codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each list of codes one after the other, and their number; flat has those of each code, own their number."""
    each = own[codes]
    before = np.append(0, np.cumsum(each))
    return flat[ranges((np.cumsum(own) - own)[codes], each)], before[at[1:]] - before[at[:-1]]


def splits_at_spaces(tokenizer) -> bool:
    """Whether text parts between spaces and line feeds can be encoded apart: white space is always dropped."""
    said = json.loads(tokenizer.to_str())
    steps = (said.get("pre_tokenizer") or {}).get("pretokenizers", [])
    removed = any(x.get("type") == "Split" and x.get("behavior") == "Removed" and x.get("invert") and r"[^\s" in x["pattern"].get("Regex", "") for x in steps[:1])
    plain = all(not set(x["content"]) & set(" \n") and not x["lstrip"] and not x["rstrip"] and not x["single_word"] for x in said["added_tokens"])
    norm = said.get("normalizer") or {}
    known = {x.get("type") for x in norm.get("normalizers", [norm] if norm else [])} <= {"NFC", "Replace", "Lowercase"}
    return removed and plain and known and not said.get("post_processor")


def train_dictionary(docs: DataFrame, tokenizer: str, *, end_id: int, width: int, sample: int = 1024, longest: int = 65536, size: int = 65536) -> bytes:
    """A zstandard dictionary from the serialized ids of the `sample` documents of up to `longest` bytes whose id hashes lowest.

    The bound only affects how well frames compress, never what they hold. Without enough to learn from: no dictionary (b"").
    """
    short = docs.where(F.octet_length("text") <= longest)
    chosen = short.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = short.join(F.broadcast(chosen.distinct()), "doc_id").select("text").limit(2 * sample).collect()
    if not rows:
        return b""
    ids, counts = encoder(tokenizer).encode(pa.array([r.text for r in rows], pa.string()))
    kind = f"<u{width}"
    samples = [np.append(part, end_id).astype(kind).tobytes() for part in np.split(ids, np.cumsum(counts)[:-1])]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_shards(docs: DataFrame, tokenizer: str, path: str, *, end_id: int, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text", level: int = 3) -> list[dict]:
    """Encodes every whole text, appends end_id, and writes shards in ascending doc_id order below `path`.

    Returns the manifest, one entry per shard with its name, documents, tokens and `start`, the ids before it; it is
    also written as `manifest.json`. A null text is the empty one (its end id only); a null doc_id sorts first; equal
    doc_ids are documents of their own, the shorter first; an empty table gives shards without documents. Other columns
    are not read. Frames, not ids, are shuffled; a task that runs twice writes the same bytes over the same file.
    """
    spark = docs.sparkSession
    rows = texts(docs, id_col, text_col)
    width = 2 if max(encoder(tokenizer).vocab, end_id + 1) <= 1 << 16 else 4
    dictionary = train_dictionary(rows, tokenizer, end_id=end_id, width=width)
    fs, base = pafs.FileSystem.from_uri(path)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/dictionary.zstd") as out:
        out.write(dictionary)

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if known:
            known.precompute_compress(level=level)  # else it is prepared anew for every document
        packer = zstandard.ZstdCompressor(level=level, dict_data=known)
        for batch in pieces(batches):
            ids, counts = encode(batch.column(1))
            ends = np.cumsum(counts)
            packed = [packer.compress(np.append(ids[b - n : b], end_id).astype(f"<u{width}").tobytes()) for b, n in zip(ends.tolist(), counts.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts + 1, pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "n_tokens", "frame"])

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        name = f"shard-{number:06d}.tidz"
        fs, base = pafs.FileSystem.from_uri(path)
        ids, nulls, counts, sizes = [], [], [], []
        with fs.open_output_stream(f"{base}/.{name}.{attempt}") as out:
            out.write(MAGIC + np.uint32(VERSION).tobytes())
            for batch in batches:
                for frame in batch.column(2).to_pylist():
                    out.write(frame)
                    sizes.append(len(frame))
                nulls.append(np.asarray(pc.is_null(batch.column(0)).cast(pa.uint8())))
                ids.append(np.asarray(pc.fill_null(batch.column(0), 0)))
                counts.append(np.asarray(batch.column(1)))
            counts_ = np.concatenate([np.zeros(0, np.int64), *counts])
            starts, offsets = np.append(0, np.cumsum(counts_)), 8 + np.append(0, np.cumsum(np.array(sizes, np.int64)))
            for values, kind in ((np.concatenate([np.zeros(0, np.int64), *ids]), "<i8"), (np.concatenate([np.zeros(0, np.uint8), *nulls]), "u1"), (starts, "<u8"), (offsets, "<u8")):
                out.write(values.astype(kind).tobytes())
            header = json.dumps({"documents": len(sizes), "width": width, "dictionary_sha256": hashlib.sha256(dictionary).hexdigest()}).encode()
            out.write(header + np.array(offsets[-1], "<u8").tobytes() + np.array(len(header), "<u4").tobytes() + MAGIC)
        _move(fs, f"{base}/.{name}.{attempt}", f"{base}/{name}")
        yield pa.RecordBatch.from_pydict({"shard": pa.array([number], pa.int32()), "name": [name], "documents": [len(sizes)], "tokens": [int(starts[-1])]})

    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # written first: ranges are found by reading doc_id twice, which must not encode twice
    encoded = written(rows.mapInArrow(frames, "doc_id long, n_tokens long, frame binary"), "frames")
    spread = encoded.repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "n_tokens", "frame")
    manifest = sorted((r.asDict() for r in spread.mapInArrow(shard, "shard int, name string, documents long, tokens long").collect()), key=lambda x: x["shard"])
    discard(encoded)
    start = 0
    for x in manifest:
        x["start"] = start
        start += x["tokens"]
    with fs.open_output_stream(f"{base}/manifest.json") as out:
        out.write(json.dumps({"tokens": start, "dictionary_sha256": hashlib.sha256(dictionary).hexdigest(), "shards": manifest}).encode())
    return manifest


def _move(fs: pafs.FileSystem, a: str, b: str) -> None:
    try:
        fs.move(a, b)
    except OSError:  # file systems whose rename doesn't replace
        fs.delete_file(b)
        fs.move(a, b)


class Shard:
    """One shard file, opened for single documents or a scan."""

    def __init__(self, fs: pafs.FileSystem, path: str, dictionary: bytes):
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self._at(size - 16, 16)
        if tail[-4:] != MAGIC:
            raise ValueError(f"{path} is not a whole shard")
        index, length = int.from_bytes(tail[:8], "little"), int.from_bytes(tail[8:12], "little")
        header = json.loads(self._at(size - 16 - length, length))
        if header["dictionary_sha256"] != hashlib.sha256(dictionary).hexdigest():
            raise ValueError(f"{path} was written under another dictionary")
        raw, k = self._at(index, size - 16 - length - index), header["documents"]
        self.ids = np.frombuffer(raw, "<i8", k)
        self.null = np.frombuffer(raw, "u1", k, 8 * k).astype(bool)
        self.starts = np.frombuffer(raw, "<u8", k + 1, 9 * k).astype(np.int64)
        self.offsets = np.frombuffer(raw, "<u8", k + 1, 9 * k + 8 * (k + 1)).astype(np.int64)
        self.kind = f"<u{header['width']}"
        self.unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def _at(self, offset: int, size: int) -> bytes:
        return self.file.read_at(size, offset)

    def tokens(self, k: int) -> np.ndarray:
        """The ids of the k-th document of the shard; reads its frame only."""
        frame = self._at(int(self.offsets[k]), int(self.offsets[k + 1] - self.offsets[k]))
        return np.frombuffer(self.unpacker.decompress(frame), self.kind)

    def find(self, doc_id: int) -> list[int]:
        """Places of the documents of that id."""
        first = int(self.null.sum())
        a, b = np.searchsorted(self.ids[first:], [doc_id, doc_id + 1])
        return list(range(first + int(a), first + int(b)))


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, ids (array)."""
    return _read(spark, path, with_ids=True)


def _read(spark: SparkSession, path: str, with_ids: bool) -> DataFrame:
    fs, base = pafs.FileSystem.from_uri(path)
    with fs.open_input_stream(f"{base}/manifest.json") as f:
        count = len(json.loads(f.read())["shards"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(path)
        with fs.open_input_stream(f"{base}/manifest.json") as f:
            manifest = json.loads(f.read())["shards"]
        with fs.open_input_stream(f"{base}/dictionary.zstd") as f:
            dictionary = f.read()
        for number in (n for batch in batches for n in batch.column(0).to_pylist()):
            entry = manifest[number]
            s = Shard(fs, f"{base}/{entry['name']}", dictionary)
            step = 256
            for a in range(0, len(s.ids), step):
                rows = range(a, min(a + step, len(s.ids)))
                ids = [s.tokens(k).astype("<u4") for k in rows]
                out = {
                    "doc_id": pa.array(s.ids[a : a + step], pa.int64(), mask=s.null[a : a + step]),
                    "start": pa.array(entry["start"] + s.starts[a : a + len(ids)], pa.int64()),
                    "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                }
                if with_ids:
                    out["ids"] = pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(out)

    shape = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<bigint>" * with_ids
    return spark.range(0, count, 1, max(1, count)).mapInArrow(scan, shape)


def encoded_digest(docs: DataFrame, tokenizer: str, *, end_id: int = 2) -> DataFrame:
    """Writes the shards of all documents to the shared folder and returns, from the files: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = scratch(spark, "token-shards")
    write_shards(docs, tokenizer, path, end_id=end_id)
    return _read(spark, path, with_ids=False)
