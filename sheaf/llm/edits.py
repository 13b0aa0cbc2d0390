"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests; DataFrame functions only.

A text's paragraphs are the parts between line feeds, cut at sentence ends. Its sketch has three tables; each paragraph
digest is in one cell of each table, and a cell holds the number, the sum by XOR, and the sum of checks of its digests.
Subtracting two sketches cell by cell leaves what differs, and peeling recovers it: a cell with one digest left gives that
digest away, which then goes from its other cells. The fingerprint is the sketch of the least size, and two fingerprints
are compared by subtracting and peeling them. What they are too small for is tried again with larger sketches.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import files_for, texts, written

#: Sweeps over the three tables before a sketch counts as too small, and the factor by which it then grows.
SWEEPS, GROWTH = 3, 8
#: Rows in a bucket of consecutive ids, and most buckets: their bounds are the only thing the driver sees.
BUCKET_ROWS, MOST_BUCKETS = 2000, 1 << 16
#: Rows whose sketches one task peels: the tables of its rounds are held at a time.
PEELED_ROWS = 750
#: Seeds of the cell in each table and of the check.
SEEDS, CHECK = (11, 12, 13), 29
#: Cells in each table of the fingerprint's sketch: enough for about 18 differing paragraphs.
SHOWN = 8


def paragraphs(text: Column) -> Column:
    """The distinct digests of a text's paragraphs; none for an empty text."""
    return F.array_distinct(F.transform(F.array_remove(F.split(text, r"[.!?]\s+|\n+"), ""), lambda p: F.xxhash64(p)))


def _placed(digests: Column) -> Column:
    """Each digest with its check and its cell in each table of the fingerprint's sketch."""
    return F.transform(digests, lambda d: F.struct(d.alias("digest"), _check(d).alias("check"), *(_place(t, d, F.lit(SHOWN)).alias(f"t{t}") for t in range(len(SEEDS)))))


def _sketch(placed: Column) -> Column:
    """The cells of the fingerprint's sketch, table after table: number, sum by XOR and sum of checks of their digests."""
    cell = lambda left, digest, checks: F.struct(left.alias("left"), digest.alias("digest"), checks.alias("checks"))
    none = cell(*(F.lit(0).cast("long"),) * 3)
    put = lambda t, c: lambda x, k: F.when(k[f"t{t}"] == c, cell(x["left"] + 1, x["digest"].bitwiseXOR(k["digest"]), x["checks"].bitwiseXOR(k["check"]))).otherwise(x)
    return F.array(*(F.aggregate(placed, none, put(t, c)) for t in range(len(SEEDS)) for c in range(SHOWN)))


def _less(a: str, b: str) -> Column:
    """One sketch less another of the same size."""
    return F.zip_with(a, b, lambda x, y: F.struct((x["left"] - y["left"]).alias("left"), x["digest"].bitwiseXOR(y["digest"]).alias("digest"), x["checks"].bitwiseXOR(y["checks"]).alias("checks")))


def _shown(count: Column, whole: Column, sketch: Column) -> Column:
    """The fingerprint as text: number of paragraphs, digest of the whole text, cells of each table, and the cells, each
    its number (8 hex digits), sum by XOR and sum of checks (16 each)."""
    padded = lambda x, n: F.lpad(F.hex(x), n, "0")
    cells = F.array_join(F.transform(sketch, lambda x: F.concat(padded(x["left"], 8), padded(x["digest"], 16), padded(x["checks"], 16))), "")
    return F.lower(F.concat_ws(":", count.cast("string"), padded(whole, 16), F.lit(str(SHOWN)), cells))


def _with_next(rows: DataFrame) -> DataFrame:
    """Adds next_text, that of the next row by ascending doc_id (after the last, the first), and rid, a number of its own.

    Rows are dealt to buckets of consecutive ids; the first row of a bucket is also a guest at the end of the one before.
    """
    known = rows.agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("ids"), F.min("doc_id").alias("least")).first()
    count = min(MOST_BUCKETS, max(1, math.ceil(known.n / BUCKET_ROWS)))
    found = rows.agg(F.percentile_approx("doc_id", [k / count for k in range(1, count)], 10 * count).alias("b")).first().b if count > 1 else []
    bounds = sorted({x for x in found or [] if x > known.least})
    step = max(1, math.isqrt(len(bounds)))
    longs = lambda x: F.expr(f"cast(split('{','.join(map(str, x))}', ',') AS array<bigint>)") if x else F.expr("cast(array() AS array<bigint>)")
    at = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    coarse = F.size(F.filter(longs(bounds[::step]), lambda b: b <= at))
    near = F.slice(longs(bounds), F.greatest((F.col("coarse") - 1) * step + 1, F.lit(1)), F.when(F.col("coarse") == 0, 0).otherwise(step))
    dealt = rows.withColumn("tie", F.xxhash64("text")).withColumn("coarse", coarse).withColumn("near", near)
    dealt = dealt.withColumn("bucket", F.greatest(F.col("coarse") - 1, F.lit(0)) * step + F.size(F.filter("near", lambda b: b <= at)))
    first = F.col("doc_id").isNull() if known.ids < known.n else F.col("doc_id") == known.least
    place = lambda bucket, guest: F.array(F.struct(bucket.cast("int").alias("bucket"), F.lit(guest).alias("guest")))
    none = F.expr("cast(array() AS array<struct<bucket:int,guest:int>>)")
    places = F.concat(place(F.col("bucket"), 0), F.when(F.array_contains("near", F.col("doc_id")), place(F.col("bucket") - 1, 1)).otherwise(none), F.when(first, place(F.lit(len(bounds)), 2)).otherwise(none))
    placed = dealt.select("doc_id", "text", "tie", F.explode(F.coalesce(places, place(F.col("bucket"), 0))).alias("p")).select("doc_id", "text", "tie", "p.bucket", "p.guest")
    order = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").asc_nulls_first(), "tie", "text")
    led = placed.withColumn("next_text", F.lead("text").over(order)).withColumn("rid", F.shiftleft(F.col("bucket").cast("long"), 40) + F.row_number().over(order))
    return led.where("guest = 0").select("rid", "doc_id", "text", "next_text")


def _size(a: str, b: str, attempt: int) -> Column:
    """Cells of each table in the attempts after the fingerprints: a power of two over half the digests, larger each time."""
    wanted = F.greatest((F.col(a) + F.col(b)) * 0.55, F.lit(2.0 * SHOWN))
    return F.pow(F.lit(2), F.ceil(F.log2(wanted))).cast("int") * GROWTH ** (attempt - 1)


def _place(table: int, digest: Column, cells: Column) -> Column:
    return F.pmod(F.xxhash64(digest, F.lit(SEEDS[table])), cells).cast("int")


def _cell(table: int, digest: Column) -> Column:
    return F.lit(table) * F.col("cells") + _place(table, digest, F.col("cells"))


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(CHECK))


def _versions_of(rows: DataFrame) -> DataFrame:
    """Adds sa, se and sn, the sketches that the fingerprints of the text, the edited text and the next text are."""
    at = {"a": (F.lit(1), F.col("na")), "e": (F.col("na") + 1, F.col("ne")), "n": (F.col("na") + F.col("ne") + 1, F.col("nn"))}
    placed = rows.select("*", *(_placed(F.slice("digests", *at[v])).alias(f"p{v}") for v in at))
    return placed.select(*rows.columns, *(_sketch(F.col(f"p{v}")).alias(f"s{v}") for v in at))


def _subtracted(rows: DataFrame) -> DataFrame:
    """The fingerprints' sketches of text and edited text, and of text and next text, subtracted: one row a cell that isn't empty."""
    pairs = F.array(*(F.struct(F.lit(pair).alias("pair"), _less("sa", other).alias("left")) for pair, other in enumerate(("se", "sn"))))
    each = _versions_of(rows).select("rid", F.inline(pairs)).select("rid", "pair", F.posexplode("left").alias("cell", "x"))
    return each.select("rid", "pair", F.lit(SHOWN).alias("cells"), F.col("cell").cast("long").alias("cell"), F.lit(0).cast("long").alias("found"), "x.left", "x.digest", "x.checks").where("left <> 0 OR digest <> 0 OR checks <> 0")


def _sketched(rows: DataFrame, attempt: int) -> DataFrame:
    """The subtracted sketches of (text, edited) and (text, next) for rows(rid, digests, na, ne, nn): one row a cell."""
    sized = rows.select("rid", "na", "ne", "digests", _size("na", "ne", attempt).alias("s0"), _size("na", "nn", attempt).alias("s1"))
    each = sized.select("rid", "na", "ne", "s0", "s1", F.posexplode("digests").alias("pos", "digest"))
    entry = lambda pair, table, sign: F.struct(F.lit(pair).alias("pair"), F.lit(table).alias("t"), F.lit(sign).alias("sign"))
    of = lambda *pairs: F.array(*(entry(pair, t, sign) for pair, sign in pairs for t in range(len(SEEDS))))
    kind = F.when(F.col("pos") < F.col("na"), of((0, 1), (1, 1))).when(F.col("pos") < F.col("na") + F.col("ne"), of((0, -1))).otherwise(of((1, -1)))
    put = each.select("rid", "digest", "s0", "s1", F.explode(kind).alias("e")).select("rid", "digest", F.col("e.pair").alias("pair"), F.col("e.t").alias("t"), F.col("e.sign").alias("sign"), F.when(F.col("e.pair") == 0, F.col("s0")).otherwise(F.col("s1")).alias("cells"))
    seed = reduce(lambda c, t: c.when(F.col("t") == t, F.lit(SEEDS[t])), range(1, len(SEEDS)), F.when(F.col("t") == 0, F.lit(SEEDS[0])))
    cell = F.col("t") * F.col("cells") + F.pmod(F.xxhash64("digest", seed), F.col("cells"))
    return _merged(put.select("rid", "pair", "cells", cell.alias("cell"), F.lit(0).cast("long").alias("found"), F.col("sign").cast("long").alias("left"), "digest", _check(F.col("digest")).alias("checks")))


def _merged(rows: DataFrame) -> DataFrame:
    """Cells by sum; those that have come out empty go. Needs no exchange after the first deal by rid."""
    out = rows.groupBy("rid", "pair", "cells", "cell", "found").agg(F.sum("left").alias("left"), F.expr("bit_xor(digest)").alias("digest"), F.expr("bit_xor(checks)").alias("checks"))
    return out.where("left <> 0 OR digest <> 0 OR checks <> 0")


def _peel(rows: DataFrame, keep: bool) -> DataFrame:
    """Rounds of peeling, one table at a time: within a table a digest is in one cell, so none is taken out twice.

    Recovered digests become rows of cell -1: each with its digest in `found` and 1 or -1 in `left`, if they are to be
    kept; else one row a pair, with their number in `left`.
    """
    for step in range(SWEEPS * len(SEEDS)):
        t, d = step % len(SEEDS), F.col("digest")
        pure = (F.abs("left") == 1) & (F.col("cell") == _cell(t, d)) & (F.col("checks") == _check(d))
        row = lambda cell, found, left, digest, checks: F.struct(cell.cast("long").alias("cell"), found.alias("found"), left.alias("left"), digest.alias("digest"), checks.alias("checks"))
        zero = F.lit(0).cast("long")
        away = [row(_cell(o, d), zero, -F.col("left"), d, F.col("checks")) for o in range(len(SEEDS)) if o != t]
        split = F.when(pure, F.array(*away, row(F.lit(-1), d if keep else zero, F.col("left") if keep else F.lit(1).cast("long"), zero, zero))).otherwise(F.array(row(F.col("cell"), F.col("found"), F.col("left"), d, F.col("checks"))))
        rows = _merged(rows.select("rid", "pair", "cells", F.inline(split)))
    return rows


def _differences(rows: DataFrame, keep: bool = False) -> DataFrame:
    """What the versions of rows(rid, na, ne, nn, digests) differ in, by as many attempts as it takes.

    Per rid and pair the number of differing digests; or, to keep them, each digest, with side 1 if only the text has it
    and -1 if only the other version.
    """
    spark, done, attempt, rest = rows.sparkSession, [], 0, rows
    while True:
        left = rest.count()
        count, files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(left / PEELED_ROWS)), files_for(spark, 2 * left)
        dealt = rest.repartition(count, "rid")
        peel = _peel(_sketched(dealt, attempt) if attempt else _subtracted(dealt), keep)
        if keep:
            state = written(peel.select("rid", "pair", "cell", "found", "left"), f"peeled-{attempt}")
            stuck = written(state.where("cell <> -1").select("rid").distinct().coalesce(files), "stuck")
            done.append(state.where("cell = -1").join(stuck, "rid", "left_anti").select("rid", "pair", F.col("found").alias("digest"), F.col("left").cast("int").alias("side")))
        else:
            tally = peel.groupBy("rid", "pair").agg(F.coalesce(F.sum(F.when(F.col("cell") == -1, F.col("left"))), F.lit(0)).alias("differing"), F.count(F.when(F.col("cell") != -1, 1)).alias("stuck"))
            tally = written(tally.repartition(files), f"peeled-{attempt}")
            stuck = written(tally.where("stuck > 0").select("rid").distinct().coalesce(files), "stuck")
            done.append(tally.join(stuck, "rid", "left_anti").select("rid", "pair", "differing"))
        if stuck.isEmpty():
            return reduce(DataFrame.union, done)
        rest, attempt = rows.join(stuck, "rid", "left_semi"), attempt + 1


def _versions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per document what describes it, and the paragraph digests of its text (na), its edited text (ne) and the next (nn)."""
    led = _with_next(texts(docs, id_col, text_col))
    chars = F.char_length("text")
    half = F.floor(chars / 2).cast("int")
    edited = led.select("rid", "doc_id", "text", "next_text", chars.alias("n_chars"), F.concat(F.substring("text", F.lit(1), chars - half), F.substring("next_text", F.lit(1), half)).alias("edited"))
    sets = edited.select("rid", "doc_id", "n_chars", "text", "edited", paragraphs(F.col("text")).alias("a"), paragraphs(F.col("edited")).alias("e"), paragraphs(F.col("next_text")).alias("n"))
    return sets.select(
        "rid", "doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.xxhash64("text").alias("whole"), F.xxhash64("edited").alias("edited_whole"),
        F.size("a").alias("na"), F.size("e").alias("ne"), F.size("n").alias("nn"), F.concat("a", "e", "n").alias("digests"),
    )


def paragraph_differences(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, other (edited or next), digest, side: the paragraph digests by which each text differs from those versions,
    recovered from subtracted sketches; side 1 if only the text has it. Nulls and ties as in `edit_fingerprints`."""
    table = written(_versions(docs, id_col, text_col), "paragraphs")
    found = _differences(table.select("rid", "na", "ne", "nn", "digests"), keep=True)
    return found.join(table.select("rid", "doc_id"), "rid").select("doc_id", F.when(F.col("pair") == 0, "edited").otherwise("next").alias("other"), "digest", "side")


def edit_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every whole text.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document by ascending doc_id, after the last the first. A fingerprint is a sketch (see `_shown`). `near_*` is 1 less
    the differing paragraph digests, recovered by subtracting and peeling two fingerprints (larger sketches where they are
    too small), over the paragraphs of both: 1 for equal sets, and for two texts without a paragraph.

    A null text is the empty one; a null doc_id sorts first; rows of one id are ordered by their text and each have a
    result; a single document is its own next; an empty table gives no rows; other columns are not read.
    """
    table = written(_versions(docs, id_col, text_col), "paragraphs")
    found = _differences(table.select("rid", "na", "ne", "nn", "digests"))
    wide = found.groupBy("rid").agg(F.max(F.when(F.col("pair") == 0, F.col("differing"))).alias("d0"), F.max(F.when(F.col("pair") == 1, F.col("differing"))).alias("d1"))
    near = lambda d, n: F.when(F.col("na") + F.col(n) == 0, 1.0).otherwise(1 - F.coalesce(F.col(d), F.lit(0)) / (F.col("na") + F.col(n)))
    both = _versions_of(table.join(wide, "rid", "left"))
    return both.select(
        "doc_id", "n_chars", "edited_sha256", _shown(F.col("na"), F.col("whole"), F.col("sa")).alias("fingerprint"), _shown(F.col("ne"), F.col("edited_whole"), F.col("se")).alias("edited_fingerprint"),
        near("d0", "ne").alias("near_edited"), near("d1", "nn").alias("near_next"),
    )
