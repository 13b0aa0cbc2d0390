from __future__ import annotations

import base64
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sheaf.llm import bpe, token_counts, token_output
from sheaf.llm.queries import split_pattern, tokenizer

from .conftest import by_id

TEXTS = st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("aeé   \n\t\x01\u00a0\u3000.,'%ABC12<|endoftext|>")), max_size=80), max_size=6)


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=split_pattern(), mergeable_ranks=bpe.read_ranks(tokenizer("byte_bpe_50k.tiktoken")), special_tokens={})


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_wordwise_ids_are_the_librarys(texts):
    e = token_output.encoder(tokenizer("word_bpe_49k.json"))
    assert e.wordwise and e.fine
    ids, counts = e.encode(pa.array(texts, pa.string()))
    want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [len(x) for x in want] == counts.tolist()
    assert [i for x in want for i in x] == ids.tolist()


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_counts_are_the_librarys(texts):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    want = [len(x.ids) for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [token_counts.counter(path).count(t) for t in texts] == want


@settings(max_examples=150, deadline=None)
@given(texts=TEXTS)
def test_bpe_ids_are_the_librarys(texts, tiktoken_encoding):
    db = bpe.engine(tokenizer("byte_bpe_50k.tiktoken"), split_pattern())
    ids, counts = db.encode(texts)
    want = [tiktoken_encoding.encode_ordinary(t) for t in texts]
    assert [len(x) for x in want] == counts.tolist()
    assert [i for x in want for i in x] == ids.tolist()
    assert db.decode(ids, counts) == [t.encode() for t in texts]


def test_kept_words_within_bound():
    from sheaf.llm.words import Kept

    kept = Kept("<u2", 10)
    for n in range(40):
        words = [str(n), str(n + 1), "same"]
        ids, sizes = kept.of(words, lambda new: [np.array([len(w)] * len(w), "<u2").tobytes() for w in new])
        assert sizes.tolist() == [len(w) for w in words]
        assert ids.tolist() == [len(w) for w in words for _ in w]
        assert len(kept.young) + len(kept.old) <= 10


def test_token_counts(docs, rows, empty):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    want = sorted(((i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    got = by_id(token_counts.token_counts(docs, path, limit=512))
    assert [r[:3] for r in got] == want
    assert all(r[3] == (r[2] > 512) for r in got)
    assert token_counts.token_counts(empty, path).count() == 0


def test_round_trip_digest(docs, rows, empty, tiktoken_encoding):
    got = by_id(bpe.round_trip_digest(docs, tokenizer("byte_bpe_50k.tiktoken"), split_pattern()))
    want = []
    for i, x in rows:
        ids = tiktoken_encoding.encode_ordinary(x or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest()))
    assert got == sorted(want, key=lambda r: (r[0] is not None, r[0] or 0, str(r)))
    assert bpe.round_trip_digest(empty, tokenizer("byte_bpe_50k.tiktoken"), split_pattern()).count() == 0


def test_encode_then_decode(docs, rows):
    path = tokenizer("byte_bpe_50k.tiktoken")
    got = bpe.decode(bpe.encode(docs, path, split_pattern()), path, split_pattern()).collect()
    assert sorted((str(r[0]), bytes(r[1])) for r in got) == sorted((str(i), (x or "").encode()) for i, x in rows)


def test_shards(spark, docs, rows, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    base = f"file://{tmp_path}/shards"
    manifest = token_output.write_shards(docs, path, base, end_id=2, shards=3)
    t = Tokenizer.from_file(path)
    got = [r.asDict() for r in token_output.read_shards(spark, base).collect()]
    got.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    start = 0
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
        options = [[*t.encode(x or "", add_special_tokens=False).ids, 2] for i, x in rows if i == r["doc_id"]]
        assert r["ids"] in options and len(r["ids"]) == r["n_tokens"]
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    assert sum(m["tokens"] for m in manifest) == start


def test_one_document_of_a_shard(docs, tmp_path):
    import pyarrow.fs as pafs

    base = f"file://{tmp_path}/shards"
    manifest = token_output.write_shards(docs, tokenizer("word_bpe_49k.json"), base, end_id=2, shards=2)
    fs, root = pafs.FileSystem.from_uri(base)
    dictionary = fs.open_input_stream(f"{root}/dictionary.zstd").read()
    found = []
    for m in manifest:
        shard = token_output.Shard(fs, f"{root}/{m['name']}", dictionary)
        found += [(m["name"], shard.tokens(k).tolist()) for k in shard.find(8)]
    assert len(found) == 2 and found[0][1] == found[1][1] and found[0][1][-1] == 2
    if dictionary:
        with pytest.raises(ValueError, match="another dictionary"):
            token_output.Shard(fs, f"{root}/{manifest[0]['name']}", b"other")


def test_no_documents(spark, empty, tmp_path):
    base = f"file://{tmp_path}/none"
    token_output.write_shards(empty, tokenizer("word_bpe_49k.json"), base, end_id=2, shards=2)
    assert token_output.read_shards(spark, base).count() == 0


def test_same_ids_over_any_partitions(spark):
    random.seed(1)
    many = [(i, " ".join(random.choice(["the", "Of,", "naïve", "x1", "%%"]) for _ in range(i % 40))) for i in range(300)]
    path = tokenizer("byte_bpe_50k.json")
    one, several = (by_id(token_counts.token_counts(spark.createDataFrame(many, "doc_id long, text string").repartition(n), path)) for n in (1, 7))
    assert one == several


def test_long_words_in_stretches(tiktoken_encoding):
    """Random, repeating (in step with stretches or not) and mixed words of any length, against the library."""
    rnd = random.Random(1)
    texts = [
        base64.b64encode(rnd.randbytes(9000)).decode(), "".join(rnd.choice("abcdefghijklmnop") for _ in range(20000)), "a" * 30000, "abc" * 9000, "abcdefg" * 3000,
        "".join(chr(rnd.randrange(0x4E00, 0x9FA5)) for _ in range(9000)), "=" * 5001, " " * 7000 + "x", "thequickbrownfox" * 900, "".join(rnd.choice(["the", "of", "ing", "abc", "aaaa", "xyz"]) for _ in range(9000)),
    ]
    db = bpe.engine(tokenizer("byte_bpe_50k.tiktoken"), split_pattern())
    for text in texts:
        ids, counts = db.encode([text])
        assert ids.tolist() == tiktoken_encoding.encode_ordinary(text)
        assert db.decode(ids, counts) == [text.encode()]


def test_dense_texts_of_a_slice_and_a_long_text(spark, tiktoken_encoding):
    """More tokens in one slice than one query decodes, in many texts and in one."""
    rnd = random.Random(2)
    texts = ["".join(chr(rnd.randrange(0x4E00, 0x9FA5)) for _ in range(1400)) for _ in range(700)]
    texts.append(" ".join(rnd.choice(["plain", "words", "of", "a", "very", "long", "text"]) for _ in range(1_500_000)))
    got = by_id(bpe.round_trip_digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), tokenizer("byte_bpe_50k.tiktoken"), split_pattern()))
    assert [r[3] for r in got] == [hashlib.sha256(x.encode()).hexdigest() for x in texts]
    for n in (0, 699, 700):
        ids = tiktoken_encoding.encode_ordinary(texts[n])
        assert got[n][1:3] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())


def test_long_words_and_texts(monkeypatch, tiktoken_encoding):
    random.seed(3)
    texts = ["ab" * 3000, "".join(random.choice("abcde") for _ in range(5000)), "x  " * 30, "日本" * 700 + " and words, " * 50]
    db = bpe.engine(tokenizer("byte_bpe_50k.tiktoken"), split_pattern())
    want = [tiktoken_encoding.encode_ordinary(t) for t in texts]
    for limit in (bpe.PIECES, 7):
        monkeypatch.setattr(bpe, "PIECES", limit)
        ids, counts = db.encode(texts)
        assert [len(x) for x in want] == counts.tolist() and [i for x in want for i in x] == ids.tolist()
    monkeypatch.setattr(bpe, "LONGEST", 3)
    fresh = bpe.DuckBpe(tokenizer("byte_bpe_50k.tiktoken"), split_pattern())
    assert fresh.encode(texts)[0].tolist() == [i for x in want for i in x]
    counter = token_counts.counter(tokenizer("byte_bpe_50k.json"))
    before = [counter.count(t) for t in texts]
    monkeypatch.setattr(token_counts, "LONG", 5)
    assert [counter.count(t) for t in texts] == before
