from __future__ import annotations

import os
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sheaf.llm import components as linking
from sheaf.llm import edits, sharding, simhash
from sheaf.llm.components import components, joined

from .conftest import by_id


def plain_fingerprint(text: str) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=100, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("aB \n\t\x0b\x1c\x85")), max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("stretch", [1, 9])
def test_fingerprint_in_stretches(monkeypatch, stretch):
    monkeypatch.setattr(simhash, "STRETCH", stretch)
    for text in ["", " ", "a", "a b", "a b c", "One two  three\nfour five six seven", "longword " * 9, " x"]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_fingerprint_is_sparks_hash(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("one two three")).alias("h")).first()
    assert simhash.fingerprint("one two three") == row.h % (1 << 64)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, (1 << 64) - 1), st.lists(st.integers(0, 63), max_size=2, unique=True))
def test_anchors_cover(x, bits):
    y = x
    for b in bits:
        y ^= 1 << b
    for parts in (simhash.PARTS, simhash.MORE_PARTS):
        rows, at, spent = simhash.anchors(np.array([x, y], np.uint64), 2, parts)
        home = at[(rows == 0) & (spent == 0)]
        assert len(home) == 1 and home[0] in at[rows == 1]
        assert home.tolist() == simhash.anchors(np.array([x], np.uint64), 0, parts)[1].tolist()
        assert len(set(at[rows == 1].tolist())) == (rows == 1).sum()


@pytest.mark.parametrize("many", [simhash.MANY, 1])
def test_near_links_by_brute_force(spark, many):
    rng = random.Random(3)
    values = {rng.getrandbits(64) for _ in range(150)}
    for v in list(values)[:60]:
        values.add(v ^ 1 << rng.randrange(64))
        values.add(v ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
        values.add(v ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = {tuple(r) for r in simhash.near_links(spark.createDataFrame([(v,) for v in signed], "fp long"), many=many).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert got == want and want


def roots(nodes, links):
    at = {n: n for n in nodes}

    def top(n):
        while at[n] != n:
            n = at[n]
        return n

    for a, b in links:
        x, y = sorted((top(a), top(b)))
        at[y] = x
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("broadcast", [1 << 19, 0])
def test_components(spark, monkeypatch, broadcast):
    monkeypatch.setattr("sheaf.llm.components.BROADCAST_ROWS", broadcast)
    rng = random.Random(5)
    links = [(500, n) for n in range(501, 700)] + [(n, n + 1) for n in range(40)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(30)] + [(7, 7), (300, 301), (301, 300)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect())
    linked = {n for a, b in links if a != b for n in (a, b)}
    assert got == {n: r for n, r in roots(linked, [x for x in links if x[0] != x[1]]).items()}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize(("at_most", "broadcast"), [(1 << 16, True), (1 << 17, False)])
def test_driver_holds_small_sides_only(spark, at_most, broadcast):
    """What is broadcast has 2^16 rows at most: a round has several such sides, all of which the driver holds."""
    side = spark.range(10).select(F.col("id").alias("u"), F.lit(1).alias("m"))
    plan = joined(spark.range(10).select(F.col("id").alias("u")), side, "u", at_most)._jdf.queryExecution().optimizedPlan().toString()
    assert ("broadcast" in plan) is broadcast


def test_near_duplicates(docs, rows, empty):
    got = simhash.near_duplicates(docs).collect()
    prints = [(i, plain_fingerprint(t or "")) for i, t in rows]
    assert sorted((str(r.doc_id), r.fp % (1 << 64)) for r in got) == sorted((str(i), f) for i, f in prints)
    distinct = {f for _, f in prints}
    of = roots(distinct, [(a, b) for a in distinct for b in distinct if a < b and (a ^ b).bit_count() <= 2])
    least = {}
    for i, f in prints:
        if i is not None:
            least[of[f]] = min(least.get(of[f], i), i)
    assert {(str(r.doc_id), r.component_id) for r in got} == {(str(i), least.get(of[f])) for i, f in prints}
    assert simhash.near_duplicates(empty).count() == 0


def test_survivors(docs):
    kept = [r.doc_id for r in simhash.survivors(docs).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [1, 2, None, 8, 8, 9, 10, 12]))
    assert simhash.survivors(docs).columns == docs.columns


def test_distinct_documents(docs, empty):
    kept = [r.doc_id for r in simhash.distinct_documents(docs).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [1, 2, None, 8, 8, 9, 10, 12]))
    assert simhash.distinct_documents(docs).columns == docs.columns and simhash.distinct_documents(empty).count() == 0


@pytest.fixture
def many_partitions(spark):
    """Shuffles in 24 partitions, which nothing makes fewer; joins that nothing but a hint broadcasts."""
    conf = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def files_written(monkeypatch, module):
    """Fills with (what, number of files) of the tables that the module writes."""
    found = []

    def spy(df, what, write=module.written):
        out = write(df, what)
        found.append((what.split("-")[0], len([x for x in os.listdir(out._written_at.removeprefix("file://")) if x.startswith("part-")])))
        return out

    monkeypatch.setattr(module, "written", spy)
    return found


@pytest.mark.parametrize("broadcast", [1 << 16, 0])
def test_distinct_documents_leave_texts_where_they_are(spark, docs, many_partitions, monkeypatch, capsys, broadcast):
    """What goes is broadcast, in few files; texts are only shuffled where more goes. Either way the same stay."""
    monkeypatch.setattr(linking, "BROADCAST_ROWS", broadcast)
    written = files_written(monkeypatch, linking)
    out = simhash.distinct_documents(docs)
    out.explain("formatted")
    assert ("SortMergeJoin" in capsys.readouterr().out) == (not broadcast)
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(map(str, [1, 2, None, 8, 8, 9, 10, 12]))
    assert {w for w, _ in written} >= {"gone", "stars"} and all(n <= 4 for w, n in written if w in ("gone", "stars"))


def test_rounds_write_few_files(spark, many_partitions, monkeypatch):
    links = spark.range(400).select(F.col("id").alias("a"), (F.col("id") + 1 + F.col("id") % 2).alias("b"))
    written = files_written(monkeypatch, linking)
    found = {r.node: r.root for r in linking.components(links).collect()}
    assert found == {k: v for k, v in roots(range(402), [(i, i + 1 + i % 2) for i in range(400)]).items() if k in found} and len(found) >= 401
    assert len([w for w, _ in written if w == "stars"]) > 1 and all(n <= 4 for w, n in written if w == "stars")


def test_wide_fingerprint():
    words = [f"w{n}" for n in range(400)]
    one, same, near, other = (simhash.wide_fingerprint(" ".join(x)) for x in (words, [*words, *words[:10], *words[5:15]], [*words[:200], "x", *words[200:]], words[::-1]))
    apart = lambda x, y: sum((a ^ b).bit_count() for a, b in zip(x, y, strict=True))
    assert simhash.wide_fingerprint("") == simhash.wide_fingerprint(" \n") == (0,) * 4 and simhash.wide_fingerprint("a B") == simhash.wide_fingerprint("A  b") != (0,) * 4
    assert apart(one, same) <= 24 and apart(one, near) <= 24 and apart(one, other) > 80


@pytest.mark.parametrize("size", [1, 40, 600])
def test_joined_at_anchor_by_brute_force(size):
    """Links join what all links of up to so many bits join, with one of each lot."""
    rng = np.random.default_rng(size)
    base = rng.integers(0, 1 << 63, (max(1, size // 8), 4), dtype=np.uint64)
    prints = base[rng.integers(0, len(base), size)]
    for _ in range(9):  # chains of neighbours, too
        prints[np.arange(size), rng.integers(0, 4, size)] ^= np.uint64(1) << rng.integers(0, 64, size).astype(np.uint64)
    links, first = simhash.joined_at_anchor(np.arange(100, 100 + size), prints, 12)
    near = [(i, j) for i in range(size) for j in range(i) if sum(int(a).bit_count() for a in prints[i] ^ prints[j]) <= 12]
    want, got = roots(range(size), near), roots(range(100, 100 + size), links)
    assert {k - 100: v - 100 for k, v in got.items()} == want
    assert len(first) == len(set(want.values())) and len({want[i] for i in first}) == len(first)


@pytest.mark.parametrize("at_once", [1 << 17, 5])
def test_wide_links_at_full_anchors(spark, monkeypatch, at_once):
    """Copies with few bits changed are one group, also where an anchor's fingerprints are dealt over several tasks."""
    monkeypatch.setattr(simhash, "MOST_AT_ONCE", at_once)
    rng = random.Random(8)
    rows = []
    for n in range(6):
        own = [rng.getrandbits(64) for _ in range(4)]
        rows += [(100 * n + k, *(f ^ (1 << rng.randrange(64)) for f in own)) for k in range(60)]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    nodes = spark.createDataFrame([(n, *map(signed, prints)) for n, *prints in rows], "node long, f0 long, f1 long, f2 long, f3 long")
    found = roots([n for n, *_ in rows], [tuple(r) for r in simhash.wide_links(nodes).collect()])
    assert set(found.values()) == {100 * n for n in range(6)}


def at_the_threshold(rng, size, far):
    """Fingerprints of which many have another that differs from them in exactly `far` bits, and some near copies."""
    base = rng.integers(0, 1 << 63, (size // 3, 4), dtype=np.uint64)
    other, copies = base.copy(), base[rng.integers(0, 3, size // 3)]
    for row in other:
        for bit in rng.permutation(256)[:far].tolist():
            row[bit // 64] ^= np.uint64(1 << bit % 64)
    copies[np.arange(len(copies)), rng.integers(0, 4, len(copies))] ^= np.uint64(1) << rng.integers(0, 64, len(copies)).astype(np.uint64)
    return np.unique(np.concatenate([base, other, copies]), axis=0)


def lots_by_brute_force(prints, threshold):
    apart = np.bitwise_count(prints[:, None] ^ prints).sum(2, dtype=np.int64)
    return roots(range(len(prints)), [(int(i), int(j)) for i, j in np.argwhere(apart <= threshold) if i < j])


@pytest.mark.parametrize("run", [64, 2])
def test_lots_leave_out_no_link(monkeypatch, run):
    monkeypatch.setattr(simhash, "RUN", run)
    prints = at_the_threshold(np.random.default_rng(run), 900, simhash.WIDE)
    assert dict(enumerate(simhash.lots(prints, simhash.WIDE).tolist())) == lots_by_brute_force(prints, simhash.WIDE)
    assert simhash.lots(prints[:0], simhash.WIDE).tolist() == []


def test_masks_by_brute_force():
    """Any five bits are outside one of the masks, which have 16 bits each but for one."""
    assert sorted(int(m).bit_count() for m in simhash.MASKS) == [16] * 62 + [32]
    masks, rng = np.array(simhash.MASKS), random.Random(4)
    for _ in range(3000):
        bits = sum(1 << b for b in rng.sample(range(32), 5))
        assert (masks & np.uint32(bits) == 0).any()


@pytest.mark.parametrize(("at_once", "few"), [(1 << 20, 0), (1 << 20, 1 << 12), (400, 0), (150, 100)])
def test_wide_links_leave_out_no_pair(spark, monkeypatch, at_once, few):
    """Pairs that differ in as many bits as the threshold allows are all linked, in one block or several."""
    monkeypatch.setattr(simhash, "MOST_AT_ONCE", at_once)
    monkeypatch.setattr(simhash, "FEW_PRINTS", few)
    prints = at_the_threshold(np.random.default_rng(3), 450, simhash.WIDE)
    nodes = spark.createDataFrame([(n, *x) for n, x in enumerate(prints.view(np.int64).tolist())], "node long, f0 long, f1 long, f2 long, f3 long")
    found = roots(range(len(prints)), [tuple(r) for r in simhash.wide_links(nodes).collect()])
    assert found == lots_by_brute_force(prints, simhash.WIDE)


def paragraphs(text):
    return {p for p in re.split(r"[.!?]\s+|\n+", text) if p}


def test_edit_fingerprints(spark, docs, rows, empty):
    import hashlib

    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    want = []
    for n, (i, t) in enumerate(ordered):
        nxt, half = ordered[(n + 1) % len(ordered)][1], len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        a, e, b = paragraphs(t), paragraphs(edited), paragraphs(nxt)
        near = lambda x, y: 1 - len(x ^ y) / (len(x) + len(y)) if x or y else 1.0
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(near(a, e), 9), round(near(a, b), 9)))
    for frame in (docs, docs.repartition(1)):
        found = by_id(edits.edit_fingerprints(frame))
        assert sorted(((r[0], r[1], r[2], round(r[5], 9), round(r[6], 9)) for r in found), key=str) == sorted(want, key=str)
    by_text = {}
    texts = {i: t for i, t in ordered}
    for r in found:
        by_text.setdefault(texts[r[0]], set()).add(r[3])
    assert all(len(v) == 1 for v in by_text.values())
    assert edits.edit_fingerprints(empty).count() == 0


def peeled(a: str, b: str, cell_of, check_of) -> set[int] | None:
    """What two fingerprints differ in, by subtracting and peeling their cells; None if they are too small."""
    cells = lambda x: [(int(x[i : i + 8], 16), int(x[i + 8 : i + 24], 16), int(x[i + 24 : i + 40], 16)) for i in range(0, len(x), 40)]
    left = [[n - m, x ^ y, c ^ d] for (n, x, c), (m, y, d) in zip(cells(a.split(":")[3]), cells(b.split(":")[3]), strict=True)]
    found: set[int] = set()
    while pure := [(k, x) for k, (n, x, c) in enumerate(left) if abs(n) == 1 and check_of.get(x) == c]:
        k, x = pure[0]
        sign, c = left[k][0], left[k][2]
        found ^= {x}
        for t in range(3):
            at = left[8 * t + cell_of[x][t]]
            at[0], at[1], at[2] = at[0] - sign, at[1] ^ x, at[2] ^ c
    return found if all(cell == [0, 0, 0] for cell in left) else None


def test_likeness_is_that_of_the_fingerprints(spark):
    """near_next can be had from the two returned fingerprints alone, where these are large enough."""
    rng = random.Random(6)
    texts = [". ".join(f"s{rng.randrange(300)} w" for _ in range(rng.choice([0, 1, 4, 8, 60]))) for _ in range(60)]
    rows = sorted(edits.edit_fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    every = sorted({p for t in texts for p in paragraphs(t)})
    table = spark.createDataFrame([(p,) for p in every], "p string").select("p", F.xxhash64("p").alias("h"))
    unsigned = lambda x: x % (1 << 64)
    known = table.select("p", "h", F.xxhash64("h", F.lit(29)).alias("check"), *(F.pmod(F.xxhash64("h", F.lit(s)), F.lit(8)).alias(f"t{n}") for n, s in enumerate((11, 12, 13)))).collect()
    check_of, cell_of = {unsigned(r.h): unsigned(r.check) for r in known}, {unsigned(r.h): (r.t0, r.t1, r.t2) for r in known}
    digest = {r.p: unsigned(r.h) for r in known}
    enough = 0
    for n, r in enumerate(rows):
        a, b = paragraphs(texts[n]), paragraphs(texts[(n + 1) % len(texts)])
        found = peeled(r.fingerprint, rows[(n + 1) % len(rows)].fingerprint, cell_of, check_of)
        assert found is None or found == {digest[p] for p in a ^ b}
        enough += found is not None
        assert r.near_next == pytest.approx(1 - len(a ^ b) / (len(a) + len(b)) if a or b else 1.0)
        assert r.fingerprint.startswith(f"{len(a)}:")
    assert enough > 20


def test_next_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(edits, "BUCKET_ROWS", 7)
    ids = random.Random(2).sample(range(10_000), 100)
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string").repartition(5)
    order = sorted(ids)
    got = {r.doc_id: r.next_text for r in edits._with_next(df).collect()}
    assert got == {i: f"t{order[(n + 1) % len(order)]}" for n, i in enumerate(order)}


def test_larger_sketches_and_digests(spark):
    rng = random.Random(4)
    many = [(n, ". ".join(f"s{rng.randrange(4000)} w" for _ in range(rng.choice([1, 3, 40, 400])))) for n in range(60)]
    df = spark.createDataFrame(many, "doc_id long, text string")
    found = {(r.doc_id, r.other, r.digest, r.side) for r in edits.paragraph_differences(df).collect()}
    table = {r.p: r.h for r in spark.createDataFrame([(p,) for _, t in many for p in paragraphs(t)], "p string").select("p", F.xxhash64("p").alias("h")).collect()}
    want = set()
    for n, (i, t) in enumerate(many):
        a, b = paragraphs(t), paragraphs(many[(n + 1) % len(many)][1])
        want |= {(i, "next", table[p], 1) for p in a - b} | {(i, "next", table[p], -1) for p in b - a}
    assert {x for x in found if x[1] == "next"} == want


def test_edits_write_few_files(spark, many_partitions, monkeypatch):
    """Each attempt's tallies are few rows, and so are their files, however many tasks peel."""
    rng = random.Random(4)
    many = [(n, ". ".join(f"s{rng.randrange(4000)} w" for _ in range(rng.choice([1, 3, 40])))) for n in range(200)]
    written = files_written(monkeypatch, edits)
    found = edits.edit_fingerprints(spark.createDataFrame(many, "doc_id long, text string"))
    near = {r.doc_id: r.near_next for r in found.collect()}
    for n, (i, t) in enumerate(many):
        a, b = paragraphs(t), paragraphs(many[(n + 1) % len(many)][1])
        assert near[i] == pytest.approx(1 - len(a ^ b) / (len(a) + len(b)))
    assert len([w for w, _ in written if w == "peeled"]) > 1 and all(n <= 4 for w, n in written if w in ("peeled", "stuck"))


def test_no_python_on_executors(docs, capsys):
    edits.edit_fingerprints(docs).explain("formatted")
    shown = capsys.readouterr().out
    assert "Python" not in shown and "Arrow" not in shown and "Pandas" not in shown


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60), st.integers(50, 120))
def test_best_fit_decreasing(sizes, capacity):
    placed = sharding.best_fit_decreasing(sizes, capacity)
    left, want = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [(room, b) for b, room in enumerate(left) if room >= sizes[i]]
        if fits:
            b = min(fits)[1]
        else:
            b = len(left)
            left.append(capacity)
        left[b] -= sizes[i]
        want[i] = b
    assert placed == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 1000), max_size=80), st.integers(1, 9))
def test_into_shards(sizes, shards):
    placed = sharding.into_shards(sizes, shards)
    bins = Counter()
    for s, b in zip(sizes, placed, strict=True):
        bins[b] += s
    assert all(0 <= b < shards for b in placed)
    if sizes:
        assert max(bins.values()) <= max(max(sizes), -(-sum(sizes) // shards)) + max(sizes)


def test_tree_stays_level():
    tree, rng, keys = sharding.CapacityTree(), random.Random(1), []
    for n in range(2000):
        if keys and rng.random() < 0.4:
            k = keys.pop(rng.randrange(len(keys)))
            tree.remove(k)
        else:
            keys.append((rng.randrange(1000), n))
            tree.add(keys[-1])
        want = min((k for k in keys if k[0] >= 500), default=None)
        assert tree.tightest(500) == want
    assert tree.root.high <= 2 * max(1, len(keys)).bit_length()


def test_sharded(docs, rows, empty):
    import zlib

    found = [r.asDict() for r in sharding.sharded(docs, 4).collect()]
    assert len(found) == len(rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in found) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    by_shard, by_text = {}, {}
    for r in found:
        by_shard.setdefault(r["shard"], []).append(r["slot"])
        by_text.setdefault(r["text_crc32"], set()).add(r["shard"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert all(len(s) == 1 for s in by_text.values())
    assert sharding.sharded(empty, 4).count() == 0


def test_near_equal_shards(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 40 == 0, "copy " * 5).otherwise(F.repeat(F.col("id").cast("string"), (F.col("id") % 9 + 1).cast("int"))).alias("text"))
    sizes = [r.b for r in sharding.sharded(df, 16).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 16 and max(sizes) < 1.02 * sum(sizes) / 16


@pytest.mark.parametrize("part", [3, 8, 12])
def test_large_group_leaves_no_shard_empty(part):
    sizes = [1000] * 3000
    sizes.append(sum(sizes) // (part - 1))
    bins = Counter()
    for s, b in zip(sizes, sharding.into_shards(sizes, 16), strict=True):
        bins[b] += s
    loads = sorted(bins.values())
    assert len(loads) == 16 and loads[-1] == sizes[-1] and loads[-2] <= 1.02 * loads[0]


def test_fixed_capacity(spark):
    df = spark.range(200).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), F.col("id").cast("int")).alias("text"))
    packed = sharding.pack(df, capacity=1000)
    loads = [r.b for r in packed.rows.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert max(loads) <= 1000 and len(loads) == packed.shards <= sum(loads) // 1000 + 2


def test_fixed_capacity_below_a_parcel(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ITEMS", 1 << 10)
    text = F.when(F.col("id") % 60 == 0, "the same").otherwise(F.concat(F.col("id").cast("string"), F.repeat(F.lit("x"), (F.col("id") % 150).cast("int"))))
    packed = sharding.pack(spark.range(6000).select(F.col("id").alias("doc_id"), text.alias("text")), capacity=900)
    rows = packed.rows.collect()
    loads, of = Counter(), {}
    for r in rows:
        loads[r.shard] += r.size
        of.setdefault((r.size, r.text_crc32), set()).add(r.shard)
    assert len(rows) == 6000 and {len(s) for s in of.values()} == {1}
    assert max(loads.values()) <= 900 and set(loads) == set(range(packed.shards))
    assert packed.shards <= 1.05 * sum(loads.values()) / 900 + 2


def test_every_group_is_packed_by_its_size(spark):
    """Any number of groups is packed as one list of items would be; results don't depend on the partitions."""
    text = F.concat(F.col("id").cast("string"), F.repeat(F.lit("y"), (F.col("id") % 37).cast("int")))
    df = spark.range(5000).select(F.col("id").alias("doc_id"), text.alias("text"))
    found = [sorted((r.shard, r["size"]) for r in sharding.pack(df.repartition(n), shards=7).rows.collect()) for n in (1, 5)]
    sizes = sorted((s for _, s in found[0]), reverse=True)
    assert found[0] == found[1] == sorted(zip(sharding.into_shards(sizes, 7), sizes, strict=True))


def test_slots_of_a_row_repeated_often(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit(2).alias("size"), F.lit(5).alias("text_crc32"), (F.col("id") % 2).alias("shard"))
    found = sharding.slots(df, per_task=100).groupBy("shard").agg(F.sort_array(F.collect_list("slot")).alias("s"), F.count_if(F.col("doc_id") == 7).alias("n")).collect()
    assert [r.s for r in found] == [list(range(1500))] * 2 and [r.n for r in found] == [500 + (r.shard == 1) for r in found]


def test_fixed_capacity_of_nothing(empty):
    assert sharding.pack(empty, capacity=10).rows.count() == 0
