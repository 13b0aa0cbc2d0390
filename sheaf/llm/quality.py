"""A quality classifier: random-indexing word vectors, pooled per document, and a two-layer network."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import coded, holding, id_remainder, pieces, ranges, texts

DIM = 64
FEATURES = 2 * DIM + 2
#: Rows of the table of word vectors; words share rows by hash, so its 4 MB don't grow with the corpus.
ROWS = 1 << 14
#: Places of an index vector that aren't zero.
NONZERO = 6
#: Neighbours on each side that make a word's context.
WINDOW = 2
#: A word is a run of letters, of digits, or of other signs; letters also say how they are written.
WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*|\p{N}+|[^\s\p{L}\p{N}]{1,4}")


def _parts(token: str) -> list[str]:
    """The words of a run without white space: letters in lower case followed by how they are written."""
    if token.isalpha():  # most are, up to a sign
        return _letters(token)
    if token[-1:] in ".,;:!?" and token[:-1].isalpha():
        return [*_letters(token[:-1]), token[-1]]
    out = []
    for x in WORDS.findall(token):
        if x[0].isalpha():
            out += _letters(x)
        else:
            out.append("\0digits" if x[0].isnumeric() else x)
    return out or ["\0none"]


def _letters(x: str) -> list[str]:
    if x[0].isupper():
        return [x.lower(), "\0upper" if len(x) > 1 and x.isupper() else "\0capital"]
    return [x.lower(), "\0upper"] if len(x) > 1 and x.isupper() else [x.lower()]


def _row(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 3) % ROWS


def index_vectors() -> np.ndarray:
    """The sparse ternary index vector of each row, from a fixed seed."""
    rng = np.random.default_rng(20)
    out = np.zeros((ROWS, DIM), np.float32)
    places = np.argsort(rng.random((ROWS, DIM)), axis=1)[:, :NONZERO]
    np.put_along_axis(out, places, rng.choice(np.array([-1, 1], np.float32), (ROWS, NONZERO)), 1)
    return out


def _flat(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The rows of the words of each run one run after the other, and their number."""
    parts = [[_row(w) for w in _parts(x)] for x in names]
    return np.array([r for x in parts for r in x], np.int64), np.array([len(x) for x in parts], np.int64)


def contexts(column: pa.Array, context: np.ndarray) -> None:
    """Adds to each row's context the index vectors of its neighbours in the texts, as whole numbers, whose sums are exact."""
    places, signs = _sparse_index()
    counts, codes, names = coded(column)
    flat, lengths = _flat(names)
    each = lengths[codes]
    rows = flat[ranges((np.cumsum(lengths) - lengths)[codes], each)]
    doc = np.repeat(np.repeat(np.arange(len(counts)), counts), each)
    for step in range(1, WINDOW + 1):
        same = doc[step:] == doc[:-step]
        a, b = rows[step:][same], rows[:-step][same]
        for x, y in ((a, b), (b, a)):
            for lo in range(0, len(x), 1 << 18):
                at = x[lo : lo + (1 << 18), None] * DIM + places[y[lo : lo + (1 << 18)]]
                context += np.bincount(at.ravel(), signs[y[lo : lo + (1 << 18)]].ravel(), ROWS * DIM).astype(np.int64).reshape(ROWS, DIM)


@cache
def _sparse_index() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of what isn't zero in each index vector."""
    index = index_vectors()
    places = np.nonzero(index)[1].reshape(ROWS, NONZERO)
    return places, np.take_along_axis(index, places, 1).astype(np.float64)


def vectors_of(context: np.ndarray) -> np.ndarray:
    """Word vectors: each row's context at unit length, and its own index vector, so that words without a context differ too."""
    norm = np.linalg.norm(context.astype(np.float64), axis=1, keepdims=True)
    return (index_vectors() / np.sqrt(NONZERO) + context / np.maximum(norm, 1e-9)).astype(np.float32)


def word_vectors(column: pa.Array) -> np.ndarray:
    """Random indexing over the texts of one column."""
    context = np.zeros((ROWS, DIM), np.int64)
    contexts(column, context)
    return vectors_of(context)


def corpus_vectors(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Random indexing over all texts: every task sums the contexts of its documents, then they are summed by row. What
    reaches the driver has the size of the table of vectors."""
    columns = [f"c{k}" for k in range(DIM)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding("quality")
        context = np.zeros((ROWS, DIM), np.int64)
        for batch in pieces(batches):
            contexts(batch.column(1), context)
        met = np.flatnonzero(context.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), *(pa.array(context[met, k]) for k in range(DIM))], ["row", *columns])

    summed = texts(docs, id_col, text_col).mapInArrow(run, "row int, " + ", ".join(f"{c} long" for c in columns)).groupBy("row").agg(*(F.sum(c).alias(c) for c in columns)).toArrow()
    context, at = np.zeros((ROWS, DIM), np.int64), np.asarray(summed["row"])
    for k, c in enumerate(columns):
        context[at, k] = np.asarray(summed[c])
    return vectors_of(context)


def run_vectors(names: list[str], vectors: np.ndarray) -> np.ndarray:
    """The mean vector of the words of each run."""
    if not names:
        return np.zeros((0, DIM), np.float32)
    flat, lengths = _flat(names)
    table = np.empty((len(names), DIM), np.float32)
    starts = np.cumsum(lengths) - lengths
    for a in range(0, len(names), 1 << 14):
        b = min(a + (1 << 14), len(names))
        last = starts[b] if b < len(names) else len(flat)
        table[a:b] = np.add.reduceat(vectors[flat[starts[a] : last]], starts[a:b] - starts[a])
    table /= lengths[:, None].astype(np.float32)
    return table


def pooled(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """A document's features: mean and deviation of the vectors of all its runs, the mean squared distance of neighbouring
    vectors and the share of neighbours at no distance; zeros without a run."""
    counts, codes, names = coded(column)
    table = run_vectors(names, vectors)
    out = np.zeros((len(counts), FEATURES), np.float32)
    ends = np.cumsum(counts)
    for d in np.flatnonzero(counts):
        total, square, apart, alike = np.zeros(DIM, np.float64), np.zeros(DIM, np.float64), 0.0, 0
        for a in range(ends[d] - counts[d], ends[d], 1 << 15):
            x = table[codes[a : min(a + (1 << 15) + 1, ends[d])]]
            gap = x[1:] - x[:-1]
            gap = np.einsum("ij,ij->i", gap, gap)
            apart, alike, x = apart + gap.sum(), alike + np.count_nonzero(gap == 0), x[: 1 << 15]
            total += x.sum(0)
            square += np.einsum("ij,ij->j", x, x)
        mean, pairs = total / counts[d], max(1, counts[d] - 1)
        out[d, :DIM], out[d, DIM : 2 * DIM], out[d, 2 * DIM :] = mean, np.sqrt(np.maximum(square / counts[d] - mean * mean, 0)), (apart / pairs, alike / pairs)
    return out


@dataclass
class Network:
    """Two layers on standardised features; `temperature` divides the logit."""

    centre: np.ndarray
    spread: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.centre) / self.spread @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, seed: int = 5) -> Network:
    """Adam on the log loss over four fifths of the rows; the temperature is what suits the other fifth best.

    Rows of one label only give a network that always says that label; no rows one that says a half.
    """
    x, rng = x.astype(np.float64), np.random.default_rng(seed)
    if not len(x):
        x, y = np.zeros((1, FEATURES)), np.array([0.5])
    order = rng.permutation(len(x))
    test, train = order[: len(x) // 5], order[len(x) // 5 :]
    centre, spread = x[train].mean(0), x[train].std(0) + 1e-3
    z, t = (x[train] - centre) / spread, y[train].astype(np.float64)
    p = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.array(np.log((t.sum() + 0.5) / (len(t) - t.sum() + 0.5)))]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(z)), max(1, len(z) // 64)):
            h = np.tanh(z[part] @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - t[part]) / len(part)
            back = np.outer(d, p[2]) * (1 - h * h)
            step += 1
            for k, g in enumerate((z[part].T @ back + 1e-4 * p[0], back.sum(0), h.T @ d + 1e-4 * p[2], d.sum())):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - 0.003 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net = Network(centre, spread, p[0], p[1], p[2], float(p[3]))
    if len(test) >= 20:
        at, want = net.logits(x[test]), y[test]
        loss = lambda t: np.logaddexp(0, np.where(want == 1, -at, at) / t).mean()
        net.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return net


@dataclass
class Model:
    vectors: np.ndarray
    network: Network


def train(docs: DataFrame, labels: DataFrame, *, sample: int = 4000, target: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Word vectors from all documents, and a network fitted on labelled ones whose crc32(doc_id as text) mod 4 is not 2: on
    the `sample` whose ids hash lowest, of any length. Tasks pool their features, so `sample` rows of FEATURES numbers reach
    the driver. Labels that are null or not 0 or 1, and labels whose document is missing, don't count; of an id's repeated
    rows, one counts."""
    vectors = corpus_vectors(docs, id_col=id_col, text_col=text_col)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("label")).where("label IN (0, 1)")
    known = known.where(id_remainder(F.col("doc_id"), 4) != 2)
    own = texts(docs, id_col, text_col)
    picked = own.select("doc_id").join(known, "doc_id").groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pooled(batch.column(2), shared.value).tolist(), pa.list_(pa.float32()))], ["doc_id", "label", "x"])

    one = own.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("label").alias("label"), F.min("text").alias("text"))
    rows = one.mapInArrow(run, "doc_id long, label int, x array<float>").orderBy("doc_id").collect()
    return Model(vectors, fit(np.array([r.x for r in rows], np.float32).reshape(-1, FEATURES), np.array([r.label for r in rows], np.float64)))


def scored(docs: DataFrame, model: Model, *, accept: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (1 from `accept` on) of every whole text.

    Scored from the text alone, without a shuffle; the model is of fixed size. A null text is scored as the empty one,
    which has a score like any other; repeated rows are scored each; an empty table gives no rows; other columns are
    not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding("quality")
        model = shared.value
        for batch in pieces(batches):
            score = model.network.scores(pooled(batch.column(1), model.vectors))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    out = texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (id_remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model, *, accept: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents (all columns) that the classifier doesn't reject, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding("quality")
        model = shared.value
        for batch in pieces(batches, column=text_col):
            text = pc.fill_null(batch.column(names.index(text_col)), "")
            yield batch.filter(pa.array(model.network.scores(pooled(text, model.vectors)) >= accept))

    return docs.mapInArrow(run, docs.schema)
