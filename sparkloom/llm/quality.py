"""Quality: a generalised additive model with pairwise interactions over text statistics.

Each feature is cut into at most BINS quantile bins. Boosting goes round the features; each step fits a
shallow regression tree over one feature's bins to the gradient and adds it to that feature's lookup
table. The pairs whose joint bins explain most of what is left then get tables of their own, grown by
trees of one cut in each feature. A score is a sum of table entries, looked up for whole batches.

Bound: at most SAMPLE labelled rows of each class (smallest hash of doc_id first) are fitted, as rows of
FEATURES numbers; each text's numbers cover all of it.

Cases: null and empty texts have all features 0 and a score like any other; labels other than 0 and 1
and labels without a document are not learned from; no labels: every score is 0.5; repeated rows are
scored each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .kernel import LOWER, blocks, column, per_text, runs, word_hashes, words
from .langid import held_out
from .toxicity import labelled_sample

SAMPLE = 6000  # rows of each class
BINS, ROUNDS, RATE, LEAVES, PAIRS, PAIR_ROUNDS, SMOOTH = 32, 60, 0.15, 4, 6, 20, 4.0

_CLASSES = {
    "upper": [*range(0x41, 0x5B)],
    "digit": [*range(0x30, 0x3A)],
    "mark": [ord(c) for c in ".,;:?"],
    "bang": [ord("!")],
    "symbol": [ord(c) for c in "#$%&*@^~+=<>\\"],
    "bar": [ord(c) for c in "|{}[]_"],
    "quote": [ord(c) for c in "\"'()-/"],
    "wide": [*range(0x80, 0x100)],
    "space": [0x20, *range(0x09, 0x0E)],
    "control": [*range(0x00, 0x09), *range(0x0E, 0x20), 0x7F],
}
FEATURES = ("log_bytes", "log_words", "word_length", "words_distinct", "lines_distinct", "line_words", "sentence_words", "word_most", *_CLASSES)


def _distinct(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: its distinct values and how often the most frequent comes."""
    n = np.zeros(len(first) - 1)
    most = np.zeros(len(first) - 1)
    for i in range(len(n)):
        if first[i + 1] > first[i]:
            s = np.sort(h[first[i] : first[i + 1]])
            cut = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1], [True])))
            n[i], most[i] = len(cut) - 1, np.diff(cut).max()
    return n, most


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """FEATURES of each text of a block."""
    size = np.maximum(np.diff(offsets), 1).astype(float)
    low = LOWER[data]
    start, end, first = words(data, offsets)
    count = np.diff(first).astype(float)
    many = np.maximum(count, 1)
    distinct, most = _distinct(word_hashes(low, start, end), first)
    ls, le, lf = runs(data != 0x0A, offsets)
    lines = np.maximum(np.diff(lf).astype(float), 1)
    line_distinct, _ = _distinct(word_hashes(low, ls, le), lf)
    stops = np.isin(data, np.frombuffer(b".!?", np.uint8))
    sums = lambda mask: per_text(np.add, mask.astype(np.int64), offsets, 0).astype(float)
    out = [np.log1p(np.diff(offsets)), np.log1p(count), per_text(np.add, end - start, first, 0) / many, distinct / many, line_distinct / lines, count / lines, count / np.maximum(sums(stops), 1), most / many]
    for members in _CLASSES.values():
        table = np.zeros(256, bool)
        table[members] = True
        out.append(sums(table[data]) / size)
    return np.stack(out, axis=1)


def _grow(grad: np.ndarray, hess: np.ndarray, leaves: int) -> np.ndarray:
    """A regression tree over ordered bins: the step of each bin. grad, hess: their sums by bin."""
    step = np.zeros(len(grad))
    parts = [(0, len(grad))]
    value = lambda g, h: g * g / (h + SMOOTH)

    def best(lo: int, hi: int) -> tuple[float, int]:
        g, h = np.cumsum(grad[lo:hi]), np.cumsum(hess[lo:hi])
        if hi - lo < 2:
            return 0.0, lo
        gain = value(g[:-1], h[:-1]) + value(g[-1] - g[:-1], h[-1] - h[:-1]) - value(g[-1], h[-1])
        at = int(np.argmax(gain))
        return float(gain[at]), lo + at + 1

    while len(parts) < leaves:
        gains = [best(*p) for p in parts]
        k = int(np.argmax([x[0] for x in gains]))
        if gains[k][0] <= 1e-9:
            break
        lo, hi = parts.pop(k)
        parts += [(lo, gains[k][1]), (gains[k][1], hi)]
    for lo, hi in parts:
        step[lo:hi] = -grad[lo:hi].sum() / (hess[lo:hi].sum() + SMOOTH)
    return step


def _quarter(grad: np.ndarray, hess: np.ndarray) -> tuple[float, np.ndarray]:
    """The best tree with one cut in each of two features, from sums by joint bin: gain and steps."""
    g, h = grad.cumsum(0).cumsum(1), hess.cumsum(0).cumsum(1)
    total_g, total_h = g[-1, -1], h[-1, -1]
    a, b = g[:-1, :-1], h[:-1, :-1]
    quarters = [(a, b), (g[:-1, -1:] - a, h[:-1, -1:] - b), (g[-1:, :-1] - a, h[-1:, :-1] - b)]
    quarters.append((total_g - sum(x for x, _ in quarters), total_h - sum(x for _, x in quarters)))
    gain = sum(x * x / (y + SMOOTH) for x, y in quarters) - total_g**2 / (total_h + SMOOTH)
    if not gain.size:
        return 0.0, np.zeros_like(grad)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    step = np.zeros_like(grad)
    for (x, y), rows, cols in zip(quarters, (slice(None, i + 1), slice(None, i + 1), slice(i + 1, None), slice(i + 1, None)), (slice(None, j + 1), slice(j + 1, None)) * 2, strict=True):
        step[rows, cols] = -x[i, j] / (y[i, j] + SMOOTH)
    return float(gain[i, j]), step


@dataclass
class Model:
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]
    bias: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(x), self.bias)
        for j, t in enumerate(self.tables):
            z += t[b[:, j]]
        for i, j, t in self.pairs:
            z += t[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def train(x: np.ndarray, y: np.ndarray, share: float | None = None) -> Model:
    """share: of label 1 where classes were sampled unevenly; the score then holds for that share."""
    prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    weight = np.ones(len(y)) if share is None or not 0 < share < 1 else np.where(y == 1, share / prior, (1 - share) / (1 - prior))
    p0 = np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    m = Model(cuts, [np.zeros(len(c) + 1) for c in cuts], [], float(np.log(p0 / (1 - p0))))
    b = m.bins(x)
    z = np.full(len(x), m.bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return weight * (p - y), weight * p * (1 - p)

    for _ in range(ROUNDS):
        for j, t in enumerate(m.tables):
            g, h = slopes()
            step = RATE * _grow(np.bincount(b[:, j], g, len(t)), np.bincount(b[:, j], h, len(t)), LEAVES)
            t += step
            z += step[b[:, j]]

    def joint(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        shape = (len(m.tables[i]), len(m.tables[j]))
        at = b[:, i] * shape[1] + b[:, j]
        g, h = slopes()
        return np.bincount(at, g, shape[0] * shape[1]).reshape(shape), np.bincount(at, h, shape[0] * shape[1]).reshape(shape)

    gains = sorted(((_quarter(*joint(i, j))[0], i, j) for i in range(len(cuts)) for j in range(i)), reverse=True)
    m.pairs = [(i, j, np.zeros((len(m.tables[i]), len(m.tables[j])))) for _, i, j in gains[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, t in m.pairs:
            step = RATE * _quarter(*joint(i, j))[1]
            t += step
            z += step[b[:, i], b[:, j]]
    return m


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [statistics(data, offsets) for _, _, data, offsets in blocks(column(batch, "text"))]
        if got:
            x = np.concatenate(got)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "y"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "y", "x"])


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model from docs (doc_id, text) and labels (doc_id, quality); None if no labelled document is there."""
    common.tune(docs.sparkSession)
    got = labelled_sample(docs, labels, "quality", SAMPLE).select("doc_id", "y", "text").mapInArrow(common.freeing(_rows), "doc_id long, y int, x binary").collect()
    if not got:
        return None
    share = labels.filter("quality IN (0, 1)").agg(F.avg("quality")).first()[0]
    got = sorted(got, key=lambda r: (r.doc_id, r.y, bytes(r.x)))
    return train(np.stack([np.frombuffer(r.x) for r in got]), np.array([r.y for r in got], float), share)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    common.tune(spark)
    shared = spark.sparkContext.broadcast(model)  # FEATURES x BINS numbers and PAIRS x BINS x BINS

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            out = np.full(batch.num_rows, 0.5)
            if m:
                for lo, hi, data, offsets in blocks(column(batch, "text"), 1 << 20):
                    out[lo:hi] = m.score(statistics(data, offsets))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(out)], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(common.freeing(score), "doc_id long, score double")


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = predict(docs, fit(docs, labels.filter(~held_out("doc_id", 3, 1))))
    return got.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
