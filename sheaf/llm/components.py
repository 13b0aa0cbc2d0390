"""Connected components of links, by rounds of large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, files_for, written

#: Rows of two longs up to which a side is broadcast (1 MB of values); beyond it is written, so that its join is a plain one
#: of two shuffles, of which skewed partitions (a hub's rows) are split when they are read. A round has several broadcasts at
#: a time, and the driver holds each collected, hashed and in blocks, until its garbage is collected: at 2^19 rows hundreds
#: of MB of its heap.
BROADCAST_ROWS = 1 << 16


def bounded(side: DataFrame, what: str, at_most: int | None = None) -> DataFrame:
    """A side for a join, of no more than `at_most` rows where that is known: broadcast where it has turned out to be small."""
    side = written(side if at_most is None else side.coalesce(files_for(side.sparkSession, at_most)), what)
    return F.broadcast(side) if side.count() <= BROADCAST_ROWS else side


def joined(rows: DataFrame, per_key: DataFrame, key: str, at_most: int) -> DataFrame:
    """rows with what per_key, one row a key and no more than `at_most`, has for the key. A frequent key is no one task's."""
    return rows.join(F.broadcast(per_key) if at_most <= BROADCAST_ROWS else written(per_key, "per-key"), key)


def components(links: DataFrame) -> DataFrame:
    """links(a, b) of longs: node, root (the least node reachable) for every node that has a link.

    Each round joins every node's larger neighbours to the least of its neighbours, then its smaller ones; both only
    group and join by node, and rows never outnumber the links. Rounds grow with the logarithm of the longest chain.
    Minima are taken before they are shuffled, and joined so that a node with many links is split. Self links and
    repeated links don't matter; no links give no rows.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    count, seen = edges.count(), None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = joined(both.where("v > u"), least, "u", 2 * count).select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = joined(large, low, "u", count).select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        last, edges = edges, written(small.where("u <> v").distinct().coalesce(files_for(edges.sparkSession, count)), "stars")
        discard(last)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        seen, count = now, now[0]
