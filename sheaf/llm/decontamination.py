"""Benchmark decontamination by template windows: typed placeholders, a hash join, and consistent slots."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import coded, holding, pieces, texts, written

#: Words in a window.
WORDS = 5
#: Share of an item's windows that a document must hold.
SHARE = 0.8
#: Literal words that a window needs for its placeholders to be placeholders; others are compared by all their words.
LITERAL = 2
#: Benchmark windows up to this number and these bytes of slot values are broadcast; more are shuffled.
BROADCAST_WINDOWS, BROADCAST_BYTES = 100_000, 16 << 20
#: Bits of the filter by which documents drop windows that no item has; its size is fixed between these powers of two.
FILTER_BITS = (16, 27)

NUMBER, UNIT, NAME = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
#: Units stand for a placeholder right after a number.
UNITS = frozenset(
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometers kilometres "
    "mg g kg t lb lbs oz gram grams kilogram kilograms ton tons pound pounds ounce ounces ml cl l liter liters litre litres "
    "gallon gallons s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months "
    "year years % percent usd eur dollar dollars euro euros cent cents degrees celsius fahrenheit kb mb gb tb".split()
)
_NUMBER = regex.compile(r"[-+$€£]?\p{N}[\p{N}.,:/]*(\p{L}+|%)?")
_EDGE = r"[^\p{L}\p{N}]"
_TRIM = regex.compile(rf"^{_EDGE}+|{_EDGE}+$")


def _kind(run: str) -> tuple[int, int, str, int]:
    """Hash of the canonical word (0: nothing to compare), flags, the word, and its own hash. Flags: 1 number, 2 can be a
    unit, 4 can be a name (a capital, then small letters), 8 ends a sentence."""
    last = run[-1:]
    if run.isalnum():  # most are, up to a sign
        word, ends = run, 0
    elif last in ".,;" and run[:-1].isalnum():
        word, ends = run[:-1], 8 if last == "." else 0
    else:
        word, ends = _TRIM.sub("", run), 8 if run.rstrip("\"')]}»”")[-1:] in ".!?:" else 0
    if not word:
        return 0, ends | (2 if run.strip(".,;") in UNITS else 0), run, 0
    low = word.lower()
    digest = xxhash.xxh64_intdigest(low.encode("utf-8", "surrogatepass"), 5) or 1
    if not word[0].isalpha() and (m := _NUMBER.fullmatch(word)) and (not m[1] or m[1].lower() in UNITS):
        return int(NUMBER), ends | 1, low, digest
    name = 4 if len(word) > 1 and word[0].isupper() and word[1:].islower() else 0
    return digest, ends | (2 if low in UNITS else 0) | name, low, digest


class Templates:
    """All windows of a slice of texts: hashes, and the slot values of windows asked for."""

    def __init__(self, column: pa.Array):
        counts, codes, runs = coded(column)
        kinds = [_kind(x) for x in runs]
        hashes = np.array([k[0] for k in kinds], np.uint64)[codes] if runs else np.zeros(0, np.uint64)
        flags = np.array([k[1] for k in kinds], np.uint8)[codes] if runs else np.zeros(0, np.uint8)
        exact = np.array([k[3] for k in kinds], np.uint64)[codes] if runs else np.zeros(0, np.uint64)
        doc = np.repeat(np.arange(len(counts)), counts)
        first = np.diff(doc, prepend=-1) > 0
        before = np.where(first, np.uint8(8), np.roll(flags, 1))  # a text begins like a sentence
        unit = (flags & 2 > 0) & (before & 1 > 0) & ~first
        name = (flags & 4 > 0) & (before & 8 == 0) & ~unit
        plain = np.where(unit, UNIT, hashes)
        hashes = np.where(name, NAME, plain)
        kept = np.flatnonzero(hashes)
        self.words, self.codes = [k[2] for k in kinds], codes[kept]
        self.hashes, self.plain, self.exact, self.doc = hashes[kept], plain[kept], exact[kept], doc[kept]
        self.slot, self.value = np.isin(self.hashes, (NUMBER, UNIT, NAME)), np.isin(self.plain, (NUMBER, UNIT))
        self.named = np.concatenate([[0], np.cumsum(self.hashes == NAME)])
        self.literal, self.literal_plain = (np.concatenate([[0], np.cumsum(~x)]) for x in (self.slot, self.value))
        self.counts = np.bincount(self.doc, minlength=len(counts))
        self.starts = np.cumsum(self.counts) - self.counts

    def windows(self, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of the first word, hash, and whether it is a template, of every window of so many words within one text.

        Windows of fewer than LITERAL literal words say too little as templates: their hash is that of their words.
        """
        n = len(self.hashes) - words + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
        places = np.flatnonzero(self.doc[:n] == self.doc[words - 1 :])
        strong = (self.literal[words:] - self.literal[:n])[places] >= LITERAL
        found = _hashed(self.hashes, None, words, n)[places]
        found[~strong] = ~_hashed(self.exact, places[~strong], words, int((~strong).sum()))
        return places, found, strong

    def plain_windows(self, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of templates with a name, whose names are taken as lower-cased words."""
        n = len(self.hashes) - words + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        places = np.flatnonzero((self.doc[:n] == self.doc[words - 1 :]) & (self.named[words:] > self.named[:n]) & (self.literal_plain[words:] - self.literal_plain[:n] >= LITERAL))
        return places, _hashed(self.plain, places, words, len(places))

    def slots(self, place: int, words: int, plain: bool = False) -> list[str]:
        """The values that placeholders of a window stand for, in order; none where it isn't a template."""
        if not plain and self.literal[place + words] - self.literal[place] < LITERAL:
            return []
        slot = self.value if plain else self.slot
        return [self.words[self.codes[k]] for k in range(place, place + words) if slot[k]]


def _hashed(hashes: np.ndarray, places: np.ndarray | None, words: int, n: int) -> np.ndarray:
    at = np.full(n, words, np.uint64)
    for k in range(words):
        at = (at ^ (hashes[k : n + k] if places is None else hashes[places + k])) * np.uint64(0xD6E8FEB86659FD93)
        at ^= at >> np.uint64(29)
    return at


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        found = Templates(batch.column(1))
        rows: list[tuple] = []
        for n, words in enumerate(np.minimum(found.counts, WORDS).tolist()):
            if words:
                own = Templates(batch.column(1).slice(n, 1))
                places, hashes, strong = own.windows(words)
                if 2 * strong.sum() >= len(places):  # else all count, and those that aren't templates only match as they are
                    places, hashes = places[strong], hashes[strong]
                template = dict(zip(places.tolist(), hashes.tolist(), strict=True))
                for plain, found_ in enumerate((template.items(), zip(*(x.tolist() for x in own.plain_windows(words)), strict=True))):
                    rows += [(batch.column(0)[n].as_py(), words, h, template[p], own.slots(p, words, bool(plain)), p) for p, h in found_ if p in template]
        signed = lambda k: pa.array(np.array([r[k] for r in rows], np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), signed(2), signed(3),
            pa.array([r[4] for r in rows], pa.list_(pa.string())), pa.array([r[5] for r in rows], pa.int32()),
        ], ["item_id", "words", "window", "own", "item_slots", "item_place"])


def _bitmap(windows: DataFrame, bits: int) -> np.ndarray:
    """A bit for each low part of a window's hash that some item has; at most 2^bits bits reach the driver."""
    low = F.col("window").bitwiseAND((1 << bits) - 1)
    rows = windows.select(low.alias("v")).selectExpr("bitmap_bucket_number(v) b", "bitmap_bit_position(v) p").groupBy("b").agg(F.expr("bitmap_construct_agg(p) m")).collect()
    out = np.zeros(1 << bits, bool)
    for r in rows:
        a = (r.b - 1) * 32768  # bucket n has the values up to n * 32768
        part = np.unpackbits(np.frombuffer(bytes(r.m), np.uint8), bitorder="little")
        # the value v has bucket 1 + (v - 1) // 32768 and position (v - 1) % 32768; 0 has bucket 0
        where = np.flatnonzero(part) + a + 1 if r.b else 0 - np.flatnonzero(part)
        out[where[(where >= 0) & (where < len(out))]] = True
    return np.packbits(out, bitorder="little")


def _best_occurrence(rows: pa.Table) -> pa.Table:
    """Of one text and item: the most windows that one occurrence's slot values let count, its slots and consistency.

    An occurrence is a run of windows at one offset in the text; its values decide, and those that it lacks (a word was put
    in or left out) come from windows up to an item's length around. Windows there that agree count with it.
    """
    offsets: dict[int, list[tuple]] = {}
    last = 0
    for r in rows.select(["own", "item_slots", "doc_slots", "item_places", "doc_places"]).to_pylist():
        hit = (r["own"], tuple(zip(r["item_slots"], r["doc_slots"], strict=False)))
        last = max(last, *r["item_places"])
        for d in r["doc_places"]:
            for i in r["item_places"]:
                offsets.setdefault(d - i, []).append(hit)
    best, slots, consistency = 0, 0, 1.0
    order, reach = sorted(offsets), last + WORDS
    for k in sorted(order, key=lambda k: (-len({h[0] for h in offsets[k]}), k)):
        near = order[bisect_left(order, k - reach) : bisect_right(order, k + reach)]
        if len({h[0] for n in near for h in offsets[n]}) <= best:
            continue
        own, around = _votes(offsets[k]), _votes(h for n in near for h in offsets[n])
        mapping = _one_to_one({i: max((n, d) for d, n in votes.items()) for i, votes in (around | own).items()})
        agreed = {o for n in near for o, pairs in offsets[n] if all(mapping[i] == d for i, d in pairs)}
        if len(agreed) > best:
            every = sum(sum(v.values()) for v in own.values())
            best, slots = len(agreed), len(mapping)
            consistency = sum(v.get(mapping[i], 0) for i, v in own.items()) / every if every else 1.0
    return pa.table({
        "d": rows.column("doc_id").slice(0, 1), "i": rows.column("item_id").slice(0, 1), "best_windows": pa.array([best], pa.int32()),
        "best_slots": pa.array([slots], pa.int32()), "best_consistency": pa.array([consistency], pa.float64()),
    })


def _one_to_one(best: dict[str, tuple[int, str]]) -> dict[str, str | None]:
    """The value each item value goes with: of several that would share one the most voted has it, the others none."""
    out: dict[str, str | None] = {}
    taken: set[str] = set()
    for i, (_, d) in sorted(best.items(), key=lambda x: (-x[1][0], x[0])):
        out[i] = None if d in taken else d
        taken.add(d)
    return out


def _votes(hits: Iterable[tuple]) -> dict[str, Counter]:
    out: dict[str, Counter] = {}
    for _, pairs in hits:
        for i, d in pairs:
            out.setdefault(i, Counter())[d] += 1
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, *, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Pairs of a document and a benchmark item it holds: doc_id, item_id, item_windows, matched_windows, coverage, slots, consistency.

    Numbers, units after them and names (a capital within a sentence) are placeholders, so a question asked again with
    other ones still matches; punctuation and case don't count: windows with names also match by the names' lower-cased
    words. A window counts as matched if each of its slot values goes with the value that the item's value most often has
    in this document, or in one occurrence of the item there if more windows count so; two values never go with the same
    one. Windows of fewer than two literal words aren't templates and don't count; where most of an item's are such, they
    do, and match by all their words. `coverage` is matched over all
    distinct windows of the item and at least `share`; `consistency` the share of slots that agree.

    Items shorter than a window are one window; items without a word match nothing. Null texts are empty; null ids are
    kept and treated as one id; repeated rows of an id count once; empty tables give no rows; other columns are not
    read. Document windows that no item has are dropped by a bitmap of bounded size where they are read, each kept one
    counts once per document.
    """
    spark = docs.sparkSession
    items = texts(benchmark, item_col, item_text_col).withColumnRenamed("doc_id", "item_id")
    windows = items.mapInArrow(_item_windows, "item_id long, words int, window long, own long, item_slots array<string>, item_place int")
    windows = written(windows.groupBy("item_id", "words", "window", "own", "item_slots").agg(F.collect_set("item_place").alias("item_places")), "item-windows")
    known, weight = windows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.array_join("item_slots", ""))), F.lit(0))).first()
    lengths = sorted(r.words for r in windows.select("words").distinct().collect())
    bits = min(max(FILTER_BITS[0], math.ceil(math.log2(max(1, known) * 16))), FILTER_BITS[1])
    shared = spark.sparkContext.broadcast(_bitmap(windows, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding("decontamination")
        bitmap, mask = shared.value, np.uint64((1 << bits) - 1)
        for batch in pieces(batches):
            found = Templates(batch.column(1))
            rows: dict[tuple, list[int]] = {}
            for words in lengths:
                for plain, (places, hashes) in enumerate((found.windows(words)[:2], found.plain_windows(words))):
                    low = (hashes & mask).astype(np.int64)
                    hit = np.flatnonzero(bitmap[low >> 3] >> (low & 7).astype(np.uint8) & 1)
                    for p, h in zip(places[hit].tolist(), hashes[hit].tolist(), strict=True):
                        n = int(found.doc[p])
                        rows.setdefault((n, h, tuple(found.slots(p, words, bool(plain)))), []).append(p - int(found.starts[n]))
            copies = {n: xxhash.xxh64_intdigest(batch.column(1)[n].as_buffer()) for n in {r[0] for r in rows}}
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())),
                pa.array(np.array([r[1] for r in rows], np.uint64).view(np.int64)), pa.array([list(r[2]) for r in rows], pa.list_(pa.string())),
                pa.array(np.array([copies[r[0]] for r in rows], np.uint64).view(np.int64)), pa.array(list(rows.values()), pa.list_(pa.int32())),
            ], ["doc_id", "window", "doc_slots", "copy", "doc_places"])

    seen = texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, window long, doc_slots array<string>, copy long, doc_places array<int>")
    side = windows.select("item_id", "window", "own", "item_slots", "item_places")
    pairs = written(seen.join(F.broadcast(side) if known <= BROADCAST_WINDOWS and weight <= BROADCAST_BYTES else side, "window"), "window-pairs")
    slot = pairs.select("doc_id", "item_id", (F.col("window") == F.col("own")).alias("whole"), F.explode(F.arrays_zip("item_slots", "doc_slots")).alias("s")).select("doc_id", "item_id", "whole", F.col("s.item_slots").alias("is"), F.col("s.doc_slots").alias("ds"))
    votes = slot.groupBy("doc_id", "item_id", "is", "ds").agg(F.count(F.lit(1)).alias("any"), F.count_if("whole").alias("whole"))
    # windows that match by their names' words were counted already if they match by the template too
    most = lambda n: F.struct(F.max(F.struct(F.col(n).alias("n"), "ds")).alias("best"), F.sum(n).alias("all"))
    chosen = votes.groupBy("doc_id", "item_id", "is").agg(most("whole").alias("w"), most("any").alias("a")).select("doc_id", "item_id", "is", F.when(F.col("w.all") > 0, F.col("w")).otherwise(F.col("a")).alias("v")).select("doc_id", "item_id", "is", "v.best", "v.all")
    per = chosen.groupBy("doc_id", "item_id").agg(
        F.collect_list(F.struct("is", F.col("best.ds").alias("ds"), F.col("best.n").alias("n"))).alias("all"),  # an item's slot values
        (F.sum("best.n") / F.sum("all")).alias("consistency"), F.count(F.lit(1)).alias("slots"),
    )
    # one to one: of item values that would go with one value the most voted does; no value of a document is "\0"
    ahead = lambda x: lambda y: (y["ds"] == x["ds"]) & ((y["n"] > x["n"]) | (y["n"] == x["n"]) & (y["is"] < x["is"]))
    per = per.withColumn("mapping", F.map_from_entries(F.transform("all", lambda x: F.struct(x["is"], F.when(F.exists("all", ahead(x)), "\0").otherwise(x["ds"]))))).drop("all")
    p, q = pairs.alias("p"), per.alias("q")
    agreed = F.coalesce(F.forall(F.arrays_zip("item_slots", "doc_slots"), lambda s: F.element_at("mapping", s["item_slots"]) == s["doc_slots"]), F.lit(True))
    joined = p.join(q, F.expr("p.doc_id <=> q.doc_id AND p.item_id <=> q.item_id"), "left").select("p.doc_id", "p.item_id", "p.own", agreed.alias("agreed"), F.coalesce("q.slots", F.lit(0)).alias("slots"), F.coalesce("q.consistency", F.lit(1.0)).alias("consistency"))
    matched = joined.groupBy("doc_id", "item_id").agg(
        F.countDistinct(F.when(F.col("agreed"), F.col("own"))).alias("matched_windows"), F.countDistinct("own").alias("met"),
        F.max("slots").alias("slots"), F.max("consistency").alias("consistency"),
    )
    sizes = windows.groupBy("item_id").agg(F.countDistinct("own").alias("item_windows")).withColumnRenamed("item_id", "own_id")
    out = written(matched.join(sizes, F.expr("item_id <=> own_id")).where(F.col("met") / F.col("item_windows") >= share), "matched")
    # where windows disagree, an occurrence of its own may hold more than the whole document's votes let count
    mixed = out.where("matched_windows < met").select(F.col("doc_id").alias("d"), F.col("item_id").alias("i"))
    single = pairs.join(mixed, F.expr("doc_id <=> d AND item_id <=> i")).drop("d", "i")
    found = single.groupBy("doc_id", "item_id", "copy").applyInArrow(_best_occurrence, "d long, i long, best_windows int, best_slots int, best_consistency double")
    best = found.groupBy("d", "i").agg(F.max(F.struct("best_windows", "best_consistency", "best_slots")).alias("best")).select("d", "i", "best.*")
    better = F.coalesce(F.col("best_windows") > F.col("matched_windows"), F.lit(False))
    pick = lambda a, b: F.when(better, F.col(b)).otherwise(F.col(a)).alias(a)
    out = out.join(best, F.expr("doc_id <=> d AND item_id <=> i"), "left").select(
        "doc_id", "item_id", "item_windows", pick("matched_windows", "best_windows").cast("long").alias("matched_windows"), pick("slots", "best_slots"), pick("consistency", "best_consistency"),
    )
    out = out.select("doc_id", "item_id", "item_windows", "matched_windows", (F.col("matched_windows") / F.col("item_windows")).alias("coverage"), F.col("slots").cast("int").alias("slots"), "consistency")
    return out.where(F.col("coverage") >= share)


def clean(docs: DataFrame, benchmark: DataFrame, *, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents (all columns) that hold no benchmark item. Documents without an id stay."""
    found = contaminated(docs, benchmark, share=share, id_col=id_col, text_col=text_col).select(F.col("doc_id").alias("__held")).distinct()
    return docs.join(found, docs[id_col] == found["__held"], "left_anti")
