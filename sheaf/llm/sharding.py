"""Shards of near equal bytes by best-fit-decreasing packing of indivisible groups."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written
from .components import bounded, joined

#: Texts of so large a part of all rows (one in ITEMS) that their shard is broadcast; they are at most as many.
ITEMS = 1 << 14


class _Node:
    __slots__ = ("high", "key", "left", "right")

    def __init__(self, key: tuple[int, int]):
        self.key, self.left, self.right, self.high = key, None, None, 1


class CapacityTree:
    """A height-balanced (AVL) tree of (remaining capacity, bin); finds the tightest bin that still holds a size."""

    def __init__(self):
        self.root: _Node | None = None

    def add(self, key: tuple[int, int]) -> None:
        self.root = self._add(self.root, key)

    def remove(self, key: tuple[int, int]) -> None:
        self.root = self._remove(self.root, key)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """The least (remaining, bin) with remaining >= size."""
        node, best = self.root, None
        while node:
            if node.key >= (size, -1):
                node, best = node.left, node.key
            else:
                node = node.right
        return best

    def _add(self, node: _Node | None, key: tuple[int, int]) -> _Node:
        if not node:
            return _Node(key)
        if key < node.key:
            node.left = self._add(node.left, key)
        else:
            node.right = self._add(node.right, key)
        return _even(node)

    def _remove(self, node: _Node | None, key: tuple[int, int]) -> _Node | None:
        if not node:
            return None
        if key < node.key:
            node.left = self._remove(node.left, key)
        elif key > node.key:
            node.right = self._remove(node.right, key)
        elif not node.left or not node.right:
            return node.left or node.right
        else:
            low = node.right
            while low.left:
                low = low.left
            node.key = low.key
            node.right = self._remove(node.right, low.key)
        return _even(node)


def _high(node: _Node | None) -> int:
    return node.high if node else 0


def _measured(node: _Node) -> _Node:
    node.high = 1 + max(_high(node.left), _high(node.right))
    return node


def _turned(node: _Node, up: str, down: str) -> _Node:
    """The child on side `up` becomes the root of this part."""
    top = getattr(node, up)
    setattr(node, up, getattr(top, down))
    setattr(top, down, _measured(node))
    return _measured(top)


def _even(node: _Node) -> _Node:
    _measured(node)
    for up, down in (("left", "right"), ("right", "left")):
        child = getattr(node, up)
        if _high(child) > _high(getattr(node, down)) + 1:
            if _high(getattr(child, down)) > _high(getattr(child, up)):
                setattr(node, up, _turned(child, down, up))
            return _turned(node, up, down)
    return node


Classes = list[tuple[int, int]]  # sizes, the largest first, and how many items have each


def best_fit_classes(classes: Classes, capacity: int) -> list[tuple[int, int]]:
    """Best-fit-decreasing of items by classes of one size: (bin, number of items) for each run of items, in their order.

    After an item the bin it went to is the tightest still, so it takes as many of that size as it holds: the same as one
    item at a time. An item larger than the capacity has a bin of its own, as it can't be divided.
    """
    bins, tree, out = 0, CapacityTree(), []
    for size, count in classes:
        while count:
            found = tree.tightest(size)
            if found:
                tree.remove(found)
                left, at = found
            else:
                left, at = capacity, bins
                bins += 1
            n = min(count, max(1, left // size))
            out.append((at, n))
            count -= n
            if left - n * size > 0:
                tree.add((left - n * size, at))
    return out


def shard_classes(classes: Classes, shards: int) -> list[tuple[int, int]]:
    """A shard for each item that exceeds the mean of what is left, then the others packed into the remaining shards."""
    left, alone, rest, out = sum(s * n for s, n in classes), 0, list(classes), []
    while rest and rest[0][0] * (shards - alone) > left:
        size, n = rest[0]
        out.append((alone, 1))
        alone, left = alone + 1, left - size
        rest[:1] = [(size, n - 1)] if n > 1 else []
    return out + [(alone + at, n) for at, n in _at_least_capacity(rest, shards - alone)]


def _at_least_capacity(classes: Classes, shards: int) -> list[tuple[int, int]]:
    """Best-fit-decreasing at the least capacity (to a 65536th) that needs no more than `shards` bins."""
    if not classes:
        return []
    largest = classes[0][0]
    low = max(largest, math.ceil(sum(s * n for s, n in classes) / shards))
    high = low + largest  # with that much to spare, an item that opens bin shards + 1 would find all others over their share
    best, step = None, max(1, low >> 16)
    while best is None:  # small items mostly need little more than the least
        tried = best_fit_classes(classes, min(low + step, high))
        if max(at for at, _ in tried) < shards or low + step >= high:
            best, high = tried, min(low + step, high)
        else:
            low, step = low + step + 1, 8 * step
    while high - low > low >> 16:
        mid = (low + high) // 2
        tried = best_fit_classes(classes, mid)
        if max(at for at, _ in tried) < shards:
            best, high = tried, mid
        else:
            low = mid + 1
    return best


def _each(sizes: list[int], pack, limit: int) -> list[int]:
    """What pack says of classes, for each item; equal sizes go in the given order."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    runs = pack(sorted(Counter(sizes).items(), reverse=True), limit)
    out = [0] * len(sizes)
    for i, at in zip(order, (at for at, n in runs for _ in range(n)), strict=True):
        out[i] = at
    return out


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item: largest first, each into the tightest bin that holds it, else a new one."""
    return _each(sizes, best_fit_classes, capacity)


def into_shards(sizes: list[int], shards: int) -> list[int]:
    """The shard of each item, by `shard_classes`."""
    return _each(sizes, shard_classes, shards)


@dataclass
class Packing:
    """doc_id, size, text_crc32 and shard of every document, and the number of shards."""

    rows: DataFrame
    shards: int


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, and the digest that equal texts share; a null text is empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.md5(text.cast("binary")).alias("digest"))


def pack(docs: DataFrame, *, shards: int | None = None, capacity: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> Packing:
    """Puts all documents into shards: as many as `shards`, near equal in bytes, or as few of `capacity` bytes as can be.

    Groups are documents of equal text and stay together; every group is packed by its size. The driver packs classes of
    groups of one size: D different sizes add up to D * D / 2 bytes at least, so it sees at most the square root of twice
    all bytes (245,000 numbers for 30 GB; texts of up to a megabyte have a million sizes at most, whatever their number).
    Then groups are numbered within their size and take the runs of their class in that order. Sizes are summed before
    they are shuffled, so a group with a third of all rows costs no more than another. Null texts count as empty, equal
    rows each count, an empty table has no rows; other columns are not read. A group over the capacity has its own shard.
    """
    base = written(sized(docs, id_col, text_col), "sizes")
    rows = base.count()
    groups = written(base.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")), "groups")
    classes = sorted(((r.bytes, r.n) for r in groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    runs = shard_classes(classes, shards) if shards else best_fit_classes(classes, capacity)
    of = written((_in_shards if shards else _in_bins)(_numbered(groups), classes, runs), "placed")
    common = F.col("n") * ITEMS >= max(1, rows)
    often, others = (of.where(c).select("digest", "shard") for c in (common, ~common))
    placed = base.join(F.broadcast(often), "digest").unionByName(base.join(F.broadcast(often.select("digest")), "digest", "left_anti").join(others, "digest"))
    return Packing(written(placed.select("doc_id", "size", "text_crc32", "shard"), "shards"), shards or max(1, 1 + max((at for at, _ in runs), default=0)))


def _numbered(groups: DataFrame, per_task: int = 4096) -> DataFrame:
    """Adds `place`: gapless from 0 within the groups of one size, without bringing those into one task."""
    blocks = max(1, math.ceil(groups.count() / per_task))
    dealt = groups.withColumn("block", F.pmod(F.xxhash64("digest"), F.lit(blocks)))
    before = Window.partitionBy("bytes").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("bytes", "block").agg(F.count(F.lit(1)).alias("of")).select("bytes", "block", F.coalesce(F.sum("of").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("bytes", "block").orderBy("digest")
    return dealt.withColumn("own", F.row_number().over(own) - 1).join(starts, ["bytes", "block"]).select("digest", "bytes", "n", (F.col("first") + F.col("own")).alias("place"))


def _in_shards(groups: DataFrame, classes: Classes, runs: list[tuple[int, int]]) -> DataFrame:
    """digest, n, shard: the group at a place of its class has the run of the class that holds this place. A class has few
    runs, as there are few shards."""
    left, starts, shards = iter(runs), [], []
    for _, count in classes:
        starts.append([])
        shards.append([])
        done = 0
        while done < count:
            shard, n = next(left)
            starts[-1].append(done)
            shards[-1].append(shard)
            done += n
    table = pa.table({"bytes": pa.array([s for s, _ in classes], pa.int64()), "starts": pa.array(starts, pa.list_(pa.int64())), "shards": pa.array(shards, pa.list_(pa.int32()))})
    per_size = groups.sparkSession.createDataFrame(table)
    at = F.size(F.filter("starts", lambda x: x <= F.col("place")))
    return joined(groups, per_size, "bytes", len(classes)).select("digest", "n", F.element_at("shards", at).alias("shard"))


def _in_bins(groups: DataFrame, classes: Classes, runs: list[tuple[int, int]]) -> DataFrame:
    """The same for any number of bins: the run that holds the group's place among all groups."""
    counts = np.array([n for _, n in classes], np.int64)
    sizes, firsts = np.array([s for s, _ in classes], np.int64)[::-1], (np.cumsum(counts) - counts)[::-1]
    shared = groups.sparkSession.sparkContext.broadcast((sizes, firsts, np.cumsum([n for _, n in runs], dtype=np.int64), np.array([at for at, _ in runs], np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, firsts, ends, shards = shared.value
        for batch in batches:
            at = firsts[np.searchsorted(sizes, np.asarray(batch.column(1)))] + np.asarray(batch.column(3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(shards[np.searchsorted(ends, at, "right")])], ["digest", "n", "shard"])

    return groups.mapInArrow(run, "digest string, n long, shard int")


def _blocked(rows: DataFrame, blocks: int) -> tuple[DataFrame, DataFrame]:
    """rows with their block, and the rows of each shard and block."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32", "deal"), F.lit(blocks)))
    return rows, written(rows.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n")), "blocks")


def slots(rows: DataFrame, per_task: int = 1024) -> DataFrame:
    """Adds `slot`: within each shard gapless from 0, without bringing a shard's rows into one task.

    Rows of a shard are numbered within blocks by hash of doc_id, of about `per_task` rows; blocks start after those before.
    A row that is repeated over `per_task` times is dealt over several blocks; its repetitions can't be told apart.
    """
    blocks = max(1, math.ceil(rows.count() / max(1, per_task)))
    rows, counts = _blocked(rows.withColumn("deal", F.lit(0).cast("long")), blocks)
    if (counts.agg(F.max("n")).first()[0] or 0) > 4 * per_task:
        key = ["doc_id", "size", "text_crc32"]
        repeated = rows.groupBy(key).agg(F.count(F.lit(1)).alias("times")).where(F.col("times") > per_task).select(*key, F.lit(True).alias("many"))
        same = reduce(Column.__and__, (F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in key))
        marked = rows.alias("r").join(bounded(repeated, "repeated").alias("s"), same, "left").select("r.*", "s.many")
        dealt = marked.withColumn("deal", F.when(F.col("many"), F.pmod(F.monotonically_increasing_id(), F.lit(blocks))).otherwise(0)).drop("many", "block")
        rows, counts = _blocked(written(dealt, "dealt"), blocks)
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("shard", "block").orderBy(F.col("doc_id").asc_nulls_first(), "size", "text_crc32")
    numbered = rows.withColumn("place", F.row_number().over(own) - 1)
    return numbered.join(starts, ["shard", "block"]).withColumn("slot", (F.col("first") + F.col("place")).cast("long")).drop("first", "place", "block", "deal")


def sharded(docs: DataFrame, shards: int = 16, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law is `bytes`) for all documents."""
    packed = pack(docs, shards=shards, id_col=id_col, text_col=text_col)
    return slots(packed.rows).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
