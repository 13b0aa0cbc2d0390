from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sheaf.llm import decontamination, licenses, quality
from sheaf.llm.common import table

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model(spark):
    return quality.train(table(spark, SF, "documents"), table(spark, SF, "labels"))


def test_held_out_accuracy(spark, model):
    scores = quality.scored(table(spark, SF, "documents"), model).join(table(spark, SF, "labels").select("doc_id", "quality"), "doc_id").where("held_out").collect()
    assert len(scores) > 500
    assert sum(r.predicted == r.quality for r in scores) / len(scores) > 0.98
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in scores)
    # calibrated: the mean score is near the share of good documents
    assert abs(np.mean([r.score for r in scores]) - np.mean([r.quality for r in scores])) < 0.03


def test_scores_of_awkward_rows(docs, rows, empty, model):
    found = quality.scored(docs, model).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(i) for i, _ in rows)
    by = {}
    for r in found:
        by.setdefault(r.doc_id, set()).add(round(r.score, 12))
        assert r.predicted == int(r.score >= 0.7)
    assert by[2] == by[3] and len(by[8]) == 1 and by[1] == by[5]
    assert quality.scored(empty, model).count() == 0
    kept = quality.accepted(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.score >= 0.7 for r in found)


def test_labels_of_held_out_rows_are_not_used(spark):
    docs = table(spark, SF, "documents").limit(300)
    labels = table(spark, SF, "labels")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.train(docs, x) for x in (labels, turned))
    assert np.array_equal(a.network.w1, b.network.w1) and np.array_equal(a.vectors, b.vectors)


def test_training_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.train(docs, none)
    assert all(0 <= r.score <= 1 for r in quality.scored(docs, model).collect())


def test_word_vectors_by_brute_force():
    texts = ["a b a c", "b b", "", "C a"]
    got = quality.word_vectors(pa.array(texts))
    index, context = quality.index_vectors(), np.zeros((quality.ROWS, quality.DIM))
    for t in texts:
        rows = [quality._row(w) for x in t.split() for w in quality._parts(x)]
        for i, r in enumerate(rows):
            for j in range(max(0, i - quality.WINDOW), min(len(rows), i + quality.WINDOW + 1)):
                if j != i:
                    context[r] += index[rows[j]]
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    assert np.allclose(got, index / np.sqrt(quality.NONZERO) + context / np.maximum(norm, 1e-9), atol=1e-5)


def test_vectors_of_all_documents(spark, docs, rows, empty):
    """Over any partitions those of one column of all texts; a fit leaves out no labelled text for its length."""
    want = quality.word_vectors(pa.array([t or "" for _, t in rows]))
    for n in (1, 5):
        assert np.array_equal(quality.corpus_vectors(docs.repartition(n)), want)
    assert np.array_equal(quality.corpus_vectors(empty), quality.vectors_of(np.zeros((quality.ROWS, quality.DIM), np.int64)))
    many = spark.createDataFrame([(n, ("good words of a text " if n % 2 else "x9 %% x9 ") * 4000) for n in range(40)], "doc_id long, text string")
    model = quality.train(many, many.selectExpr("doc_id", "cast(doc_id % 2 AS int) quality"))
    assert all(r.predicted == r.doc_id % 2 for r in quality.scored(many, model).collect())


def test_score_by_brute_force(spark, model):
    """Scores from the features and the network's numbers by the definition."""
    net, rows = model.network, table(spark, "/root/testdata/sf0.001", "documents").collect()
    found = {r.doc_id: r.score for r in quality.scored(table(spark, "/root/testdata/sf0.001", "documents"), model).collect()}
    for r in rows[:60]:
        v = np.array([model.vectors[[quality._row(w) for w in quality._parts(x)]].astype(np.float64).mean(0) for x in (r.text or "").split()]).reshape(-1, quality.DIM)
        gap = ((v[1:] - v[:-1]) ** 2).sum(1)
        x = [*v.mean(0), *v.std(0), gap.mean() if len(gap) else 0, (gap == 0).mean() if len(gap) else 0] if len(v) else [0] * quality.FEATURES
        hidden = [np.tanh(sum((x[k] - net.centre[k]) / net.spread[k] * net.w1[k, j] for k in range(quality.FEATURES)) + net.b1[j]) for j in range(len(net.b1))]
        logit = (sum(h * w for h, w in zip(hidden, net.w2, strict=True)) + net.b2) / net.temperature
        assert found[r.doc_id] == pytest.approx(1 / (1 + np.exp(-np.clip(logit, -30, 30))), abs=1e-3)


def test_pooled_by_brute_force():
    vectors = quality.word_vectors(pa.array(["x y z"]))
    texts = ["x y. z x", "", "solo", "r r r"]
    got = quality.pooled(pa.array(texts), vectors)
    for g, t in zip(got, texts, strict=True):
        v = np.array([vectors[[quality._row(w) for w in quality._parts(x)]].mean(0) for x in t.split()])
        if not len(v):
            assert not g.any()
            continue
        gap = ((v[1:] - v[:-1]) ** 2).sum(1)
        want = [*v.mean(0), *v.std(0), gap.mean() if len(gap) else 0, (gap == 0).mean() if len(gap) else 0]
        assert np.allclose(g, want, atol=1e-4)


ITEMS = [
    (1, "Tom has 3 apples and 5 pears. How many pieces of fruit does Tom carry home after the market closes today?"),
    (2, "A train leaves the station at 90 km per hour while another train follows it along the same track later on."),
    (3, "short one"),
    (4, ""),
    (5, None),
    (6, "Wholly different words that occur nowhere else in this small collection of rows, I am quite sure of it."),
    (6, "Wholly different words that occur nowhere else in this small collection of rows, I am quite sure of it."),
]
PAGES = [
    (10, "Before it. " + ITEMS[0][1] + " After it."),
    (11, "Ann has 7 apples and 9 pears. How many pieces of fruit does Ann carry home after the market closes today?"),
    (12, "Ann has 7 apples and 9 pears. How many pieces of grain do we ship abroad before the season ends for good?"),
    (13, "A train leaves the station at 120 km per hour while another train follows it along the same track later on."),
    (14, "It says: SHORT ONE, nothing more."),
    (15, ""), (16, None), (None, ITEMS[1][1]),
    (17, "a clean document about nothing in particular that shares no passage with any item at all in the list"),
    (17, "a clean document about nothing in particular that shares no passage with any item at all in the list"),
    (18, (ITEMS[5][1] + " ") * 300),
]


def test_contaminated(spark):
    docs = spark.createDataFrame([(i, t, "w", 1) for i, t in PAGES], "doc_id long, text string, window string, item_id int").repartition(3)
    bench = spark.createDataFrame([(i, t, 5) for i, t in ITEMS], "item_id long, text string, doc_id int")
    found = {(r.doc_id, r.item_id): r for r in decontamination.contaminated(docs, bench).collect()}
    assert set(found) == {(10, 1), (11, 1), (13, 2), (14, 3), (None, 2), (18, 6)}
    assert found[10, 1].coverage == 1.0 and found[11, 1].slots >= 2 and found[11, 1].consistency == 1.0
    clean = decontamination.clean(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(map(str, [12, 15, 16, 17, 17, None]))


def test_slots_must_agree(spark):
    item = "Mix 4 cups of flour with 4 cups of water and 4 cups of sugar, then wait 4 minutes and mix 4 times again."
    same, other = item.replace("4", "9"), item
    for n, new in enumerate(["1", "2", "3", "5", "6"]):
        other = other.replace("4", new, 1)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, same), (2, other)], "doc_id long, text string")
    assert [r.doc_id for r in decontamination.contaminated(docs, bench).collect()] == [1]


def test_other_occurrences_veto_no_copy(spark):
    item = "please move 3 of the 5 red boxes from shelf 8 to shelf 2 before noon because the truck leaves early"
    variant = "please move 9 of the 4 red boxes from shelf 1 to shelf 7 before noon because the truck leaves early"
    longer = item.replace("before noon", "right before noon") + " today and we want to have all of it on the road by then"
    table = " ".join(f"from shelf {n} to shelf {n + 1} before noon" for n in range(20, 60))
    docs = [(1, f"{item} {variant}"), (2, f"{variant} {item} {variant} {variant}"), (3, f"{table} {item} {table}"), (4, f"{table} please move on {table}"), (5, f"{variant} {item.replace('before', 'right before')}")]
    docs += [(6, f"{variant} {longer.replace('right ', '')} {variant} {longer}")]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    found = {r.doc_id: r.matched_windows for r in decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    # the table's own windows count too where they agree
    assert set(found) == {1, 2, 3, 5, 6} and found[1] == found[2] == found[3] == found[6] == 17


def test_windows_need_literal_words(spark):
    numbers, question = "12 15 18 21 24", "12 15 18 21 24 which number comes next in this series of sums"
    bench = spark.createDataFrame([(1, numbers), (2, question)], "item_id long, text string")
    docs = [(1, "the years 1 2 3 4 5 6 7 8 9 of it"), (2, "as in 12 15 18 21 24, and so on"), (3, "say 2 5 8 11 14 which number comes next in this series of sums"), (4, "11 11 11 11 11 which number comes first")]
    found = {(r.doc_id, r.item_id) for r in decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert found == {(2, 1), (3, 2)}


def test_values_go_one_to_one(spark):
    item = "first we give 3 coins to the baker and then 7 coins to the smith who owes 3 coins to the miller"
    docs = [(1, item.replace("3", "8").replace("7", "9")), (2, item.replace("3", "8").replace("7", "8"))]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    found = {r.doc_id: r.matched_windows for r in decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench, share=0.3).collect()}
    assert found[1] == 18 and found[2] < 18


def test_repeated_and_null_items_and_long_texts(spark):
    item = "please move 3 of the 5 red boxes from shelf 8 to shelf 2 before noon because the truck leaves early"
    bench = spark.createDataFrame([(1, item), (1, item), (None, item), (4, None), (None, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "some other words " * 100_000 + item + " and more" * 50_000), (2, "of the 5 red boxes from shelf 8 " * 20_000)], "doc_id long, text string")
    assert {(r.doc_id, r.item_id, r.coverage) for r in decontamination.contaminated(docs, bench).collect()} == {(1, 1, 1.0), (1, None, 1.0)}


def test_case_of_names_does_not_count(spark):
    item = "Yesterday afternoon old Marta walked slowly down to the harbour and bought 12 fresh herrings for her cat."
    bench = spark.createDataFrame([(1, item), (2, item.lower().replace("herrings", "mackerels"))], "item_id long, text string")
    docs = [(1, item.lower()), (2, item.upper()), (3, item.lower().replace("12", "15")), (4, item.replace("herrings", "mackerels"))]
    docs += [(5, item.replace("Marta", "Berta")), (6, "the old harbour master walked slowly home")]
    found = {(r.doc_id, r.item_id): r.coverage for r in decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert all(found[d, 1] == 1.0 for d in (1, 2, 3, 5)) and found[4, 2] == 1.0 and 6 not in {d for d, _ in found}


def test_no_items_or_documents(spark, empty):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame(PAGES, "doc_id long, text string")
    assert decontamination.contaminated(empty, bench).count() == 0
    assert decontamination.contaminated(docs, none).count() == 0
    assert decontamination.clean(docs, none).count() == len(PAGES)


def test_shuffled_as_broadcast(spark, monkeypatch):
    docs, bench = spark.createDataFrame(PAGES, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    before = sorted(map(str, decontamination.contaminated(docs, bench).collect()))
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", 0)
    assert sorted(map(str, decontamination.contaminated(docs, bench).collect())) == before


def test_passages_by_brute_force(spark):
    """Without slots coverage is the share of the item's distinct five-word windows that a document has."""
    rng = random.Random(7)
    word = lambda: rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split())
    items = [(n, " ".join(word() for _ in range(rng.choice([3, 5, 12, 30])))) for n in range(12)]
    docs = []
    for n in range(80):
        parts = [word() for _ in range(30)]
        if n % 2:
            own = rng.choice(items)[1].split()
            cut = rng.randrange(len(own) // 3 + 1)
            parts[10:10] = own[: len(own) - cut]
        docs.append((n, " ".join(parts)))
    windows = lambda t, k: {tuple(t[i : i + k]) for i in range(len(t) - k + 1)}
    want = set()
    for i, t in items:
        own = t.split()
        k = min(5, len(own))
        for d, x in docs:
            if len(windows(own, k) & windows(x.split(), k)) >= 0.8 * len(windows(own, k)):
                want.add((d, i))
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want and want


def brute_licenses(text: str, templates: dict[str, str], least: float) -> dict[str, float]:
    words, best = licenses.normalised(text), {}
    pairs = list(zip(words, words[1:], strict=False))
    for name, t in templates.items():
        own = licenses.normalised(t)
        wanted = Counter(zip(own, own[1:], strict=False))
        n = sum(wanted.values())
        top = 0.0
        for i in range(len(pairs)):
            for j in range(i + 1, len(pairs) + 1):
                shared = sum((Counter(pairs[i:j]) & wanted).values())
                top = max(top, 2 * shared / (n + j - i))
        if n and top >= least:
            best[name] = top
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("licensed under the apache license version 2 0 released mit x y".split()), max_size=25))
def test_license_parts_by_brute_force(words):
    templates = {"a": licenses.TEMPLATES["Apache-2.0"], "m": licenses.TEMPLATES["MIT"]}
    for name in templates:
        one = {name: templates[name]}
        want = brute_licenses(" ".join(words), one, 0.8)
        found = {}
        for _, n, dice, _, _ in licenses.Scanner(one, 0.8).scan(pa.array([" ".join(words)])):
            found[n] = max(found.get(n, 0), dice)
        assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-12 for k in want)


def test_licenses(spark, docs, empty):
    texts = [(1, "Intro. Licensed under the Apache License, version 2.0! Rest of it."), (2, "This work is licensed under the GNU General Public Licence, version 3."), (3, "licensed"), (4, "x " * 4000 + licenses.TEMPLATES["MIT-terms"] + " y" * 4000)]
    found = {(r.doc_id, r.license): r for r in licenses.licenses(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert set(found) == {(1, "Apache-2.0"), (2, "GPL-3.0"), (4, "MIT-terms")}
    assert found[1, "Apache-2.0"].first_word == 1 and found[4, "MIT-terms"].dice == 1.0
    assert [(r.doc_id, r.license) for r in licenses.licenses(docs).collect()] == [(12, "Apache-2.0")]
    assert licenses.licenses(empty).count() == 0


def test_whole_texts_and_repeated_notices(spark):
    """Whole texts of licences, also with some words changed, are found as such; many notices take no square of their number."""
    import time

    every = licenses.templates()
    rng = random.Random(9)
    changed = " ".join(w if rng.random() > 0.02 else "word" for w in every["GPL-3.0-text"].split())
    docs = [(1, "About. " + every["Apache-2.0-text"] + " The end."), (2, changed), (3, every["MPL-2.0-text"] + "\n\n" + every["LGPL-2.1-text"])]
    found = {(r.doc_id, r.license) for r in licenses.licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found == {(1, "Apache-2.0-text"), (2, "GPL-3.0-text"), (3, "MPL-2.0-text"), (3, "LGPL-2.1-text")}
    scanner = licenses.Scanner(every, 0.8)
    start = time.time()
    assert len(scanner.scan(pa.array(["All rights reserved. " * 50_000]))) == 50_000
    assert time.time() - start < 5


def test_size_bounds():
    low, high = licenses.size_bounds(10, 0.8)
    assert 2 * low / (10 + low) >= 0.8 > 2 * (low - 1) / (10 + low - 1)
    assert 20 / (10 + high) >= 0.8 > 20 / (11 + high)
