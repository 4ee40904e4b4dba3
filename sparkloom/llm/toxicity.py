"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of letters and digits (ASCII in lower case, non-ASCII bytes as they are). Features of a
text are the set of its hashed words, neighbouring pairs and pairs that skip one word. FTRL's
per-coordinate rates and L1 term leave few non-zero weights, and those pairs of (feature, weight) are
what is broadcast. Features are 32-bit hashes; training numbers those that the bounded sample holds, so
that the model's size is bounded by the sample, and scoring first asks a table of 2**BITS bits.

Bound: at most SAMPLE labelled documents of each class (smallest hash of doc_id first, of rows that repeat
a doc_id one) with together SAMPLE_BYTES of text are fitted. A text's features are found over all of it.
Features of fewer than MIN_DOCS of these documents are left out: what only one text has tells nothing about
others. Label 1 weighs POSITIVE times as much as label 0.

Cases: a null or empty text has the score of the bias alone; labels other than 0 and 1 and labels
without a document are not learned from; a document labelled 0 and 1 counts as either; a document of
several rows is learned from by one; no labels: every score is 0; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .kernel import LOWER, U64, blocks, column, inside, mix, runs, word_hashes
from .langid import held_out

BITS = 22
SAMPLE, SAMPLE_BYTES = 4000, 32 << 20  # of each class
EPOCHS, ALPHA, BETA, L1, L2, MIN_DOCS, POSITIVE = 10, 10.0, 1.0, 20.0, 1.0, 5, 4.0

WORD = np.zeros(256, bool)
for _a, _b in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    WORD[_a : _b + 1] = True


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features (with repeats) of a block's texts and the text of each."""
    low = LOWER[data]
    start, end, first = runs(WORD[data], offsets)
    h = word_hashes(low, start, end)
    out, owner = [h], [np.repeat(np.arange(len(first) - 1), np.diff(first))]
    for k in (2, 3):
        at, base = inside(first, k)
        out.append(mix(h[at] * U64(0x9FB21C651E98DF25) + h[at + k - 1] + U64(k)))
        owner.append(np.repeat(np.arange(len(base) - 1), np.diff(base)))
    return (np.concatenate(out) >> U64(32)).astype(np.uint32), np.concatenate(owner)


@dataclass
class Model:
    index: np.ndarray
    weight: np.ndarray
    bias: float

    def bitmap(self) -> np.ndarray:
        table = np.zeros(1 << BITS, bool)
        table[self.index >> np.uint32(32 - BITS)] = True
        return table

    def scores(self, table: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        feature, owner = features(data, offsets)
        z = np.full(len(offsets) - 1, self.bias)
        hit = np.flatnonzero(table[feature >> np.uint32(32 - BITS)])
        pair = np.unique(owner[hit].astype(np.int64) << 32 | feature[hit])
        feature, owner = (pair & 0xFFFFFFFF).astype(np.uint32), pair >> 32
        if len(pair) and len(self.index):
            at = np.minimum(np.searchsorted(self.index, feature), len(self.index) - 1)
            np.add.at(z, owner, np.where(self.index[at] == feature, self.weight[at], 0.0).astype(np.float64))
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def train(rows: list[np.ndarray], y: np.ndarray, seed: int = 11) -> Model:
    """FTRL-proximal over texts as sets of features; the bias has no L1 term. rows is emptied: the features are held once."""
    cut = np.concatenate(([0], np.cumsum([len(f) for f in rows]))).astype(np.int64)
    flat = np.zeros(cut[-1], np.uint32)
    for i in range(len(rows)):
        flat[cut[i] : cut[i + 1]], rows[i] = rows[i], None
    names, many = np.unique(flat, return_counts=True)
    names = names[many >= MIN_DOCS]
    for i in range(len(rows)):
        f = flat[cut[i] : cut[i + 1]]
        at = np.minimum(np.searchsorted(names, f), max(len(names) - 1, 0))
        rows[i] = at[names[at] == f].astype(np.int32) if len(names) else np.zeros(0, np.int32)
    del flat
    n, z = np.zeros(len(names)), np.zeros(len(names))
    n0 = z0 = 0.0
    rng = np.random.default_rng(seed)

    def weight(zi, ni, l1):
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            f = rows[i]
            w, w0 = weight(z[f], n[f], L1), float(weight(np.array(z0), np.array(n0), 0.0))
            g = 1 / (1 + np.exp(-np.clip(w.sum() + w0, -50, 50))) - y[i]
            g *= POSITIVE if y[i] else 1.0
            sigma = (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / ALPHA
            z[f] += g - sigma * w
            n[f] += g * g
            s0 = (np.sqrt(n0 + g * g) - np.sqrt(n0)) / ALPHA
            z0 += g - s0 * w0
            n0 += g * g
    index = np.flatnonzero(np.abs(z) > L1)
    return Model(names[index], weight(z[index], n[index], L1).astype(np.float32), float(weight(np.array(z0), np.array(n0), 0.0)))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for lo, hi, data, offsets in blocks(column(batch, "text")):
            feature, owner = features(data, offsets)
            order = np.argsort(owner, kind="stable")
            cut = np.searchsorted(owner[order], np.arange(hi - lo + 1))
            out += [np.unique(feature[order[cut[i] : cut[i + 1]]]).tobytes() for i in range(hi - lo)]
        if out:
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "y"), pa.array(out, pa.binary())], names=["doc_id", "y", "features"])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, n: int, most_bytes: int | None = None) -> DataFrame:
    """doc_id, text, y of at most n labelled documents of each class, with together most_bytes (SAMPLE_BYTES) of text. Their ids (at most 2n) go through the driver."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("h", F.xxhash64("text"))
    picked: list[tuple[int, int, int]] = []
    for y in (0, 1):
        mine = labels.filter(F.col(label).cast("int") == y).select(F.col("doc_id").cast("long").alias("doc_id"))
        left = SAMPLE_BYTES if most_bytes is None else most_bytes
        for r in common.sample(mine.join(texts.select("doc_id", "h", F.octet_length("text").alias("size")), "doc_id"), n, mine.count()):
            if r["size"] <= left:
                left -= r["size"]
                picked.append((r["doc_id"], r["h"], y))
    few = spark.createDataFrame(picked, "doc_id long, h long, y int")
    texts = texts.filter(F.col("doc_id").isin(sorted({r[0] for r in picked}))) if picked else texts.limit(0)
    return texts.join(F.broadcast(few), ["doc_id", "h"]).dropDuplicates(["doc_id", "y"]).select("doc_id", "text", "y")  # at most 2n triples of numbers


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model from docs (doc_id, text) and labels (doc_id, toxic); None if no labelled document is there."""
    common.tune(docs.sparkSession)
    rows = labelled_sample(docs, labels, "toxic", SAMPLE).select("doc_id", "y", "text").mapInArrow(common.freeing(_sets), "doc_id long, y int, features binary")
    with common.scope():
        got = [(r.doc_id, r.y, bytes(r.features)) for r in common.materialize(rows, "features").toLocalIterator()]  # one part at a time through the driver's heap
    if not got:
        return None
    got.sort()
    y, sets = np.array([r[1] for r in got], float), [np.frombuffer(r[2], np.uint32) for r in got]
    del got
    return train(sets, y)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    common.tune(spark)
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        table = m.bitmap() if m else None
        for batch in batches:
            out = np.zeros(batch.num_rows)
            if m:
                for lo, hi, data, offsets in blocks(column(batch, "text"), 1 << 18):
                    out[lo:hi] = m.scores(table, data, offsets)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "text"), pa.array(out)], names=[*(x for x in batch.schema.names if x != "text"), "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(common.freeing(score), "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model | None, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose score is below threshold. Scores in place: nothing is shuffled."""
    spark = docs.sparkSession
    common.tune(spark)
    shared = spark.sparkContext.broadcast(model)

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        table = m.bitmap() if m else None
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            if m:
                for lo, hi, data, offsets in blocks(column(batch, "text"), 1 << 18):
                    keep[lo:hi] = m.scores(table, data, offsets) < threshold
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(common.freeing(drop), docs.schema)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = predict(docs, fit(docs, labels.filter(~held_out("doc_id", 5, 0))))
    return got.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
