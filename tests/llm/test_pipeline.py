from __future__ import annotations

import re

import numpy as np
import pytest

import corpus_pipeline
from sheaf.llm import quality, queries, simhash
from sheaf.llm.common import table

from .test_similarity import roots

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents after each stage."""
    docs, found = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        path = f"file://{tmp_path_factory.mktemp(name)}/out"
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        found.append(docs)
    return found


def test_columns(spark, stages):
    assert all(s.columns == table(spark, SF, "documents").columns for s in stages[:-1])


def test_rejected_by_the_classifier(spark, stages):
    docs = table(spark, SF, "documents")
    scores = quality.scored(docs, quality.train(docs, table(spark, SF, "labels")))
    assert {r.doc_id for r in stages[0].collect()} == {r.doc_id for r in scores.where("predicted = 1").collect()}


def five_words(text):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").split()
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or {" ".join(words)}


def test_one_of_each_group(spark):
    """Over documents: equal ones are one, of pairs of five-word similarity 0.8 or more one goes, and whatever goes has one
    left that is linked to it by what the fingerprints of all pairs say."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    kept = {r.doc_id for r in corpus_pipeline.without_near_copies(spark, docs, SF).collect()}
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    prints = np.array([simhash.wide_fingerprint(t) for _, t in rows], np.uint64)
    near = [(i, i + 1 + int(j)) for i in range(len(rows)) for j in np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]).sum(1) <= simhash.WIDE)]
    of = roots(range(len(rows)), near)
    assert {rows[k][0] for k in set(of.values())} <= kept  # the least of each group
    by_text, sets = {}, [five_words(t) for _, t in rows]
    for i, t in rows:
        by_text.setdefault(" ".join(t.lower().split()), []).append(i)
    assert all(len(kept & set(ids)) <= 1 and (min(ids) in kept or len(kept & set(ids)) == 0) for ids in by_text.values())
    similar = [(i, j) for i, j in near if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert similar and sum(rows[j][0] not in kept for _, j in similar) >= 0.9 * len(similar)
    # documents that are like no other by a third stay
    alone = [i for i in range(len(rows)) if all(len(sets[i] & s) <= len(sets[i] | s) / 3 for k, s in enumerate(sets) if k != i)]
    assert len(alone) > 500 and all(rows[i][0] in kept for i in alone)


def test_no_benchmark_passage_left(spark, stages):
    items = [r.text for r in table(spark, SF, "benchmark").collect()]
    before, after = ({r.doc_id: r.text for r in s.collect()} for s in stages[1:3])
    assert {i for i, t in before.items() if not any(x in t for x in items)} <= set(after)
    assert not any(x in t for t in after.values() for x in items)


def test_tokens_of_what_is_left(stages):
    assert {r.doc_id for r in stages[3].collect()} == {r.doc_id for r in stages[2].collect()}


def test_run_is_the_stages(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, stages[-1].collect()))


def test_awkward_rows(spark, docs, empty):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() <= docs.count(), name
        assert stage(spark, empty, SF).count() == 0, name


def test_all_registered():
    names = queries.queries()
    assert [int(n[2:].split("_")[0]) for n in names if n.startswith("op")] == list(range(1, 11))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
