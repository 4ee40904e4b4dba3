"""Language identification: averaged hashed subword embeddings under a linear softmax, trained by SGD in numpy.

Subwords are the byte 2-, 3- and 4-grams of a text's words (ASCII letters in lower case, one border mark
on either side), hashed into BUCKETS rows. A text is the mean of its subwords' embeddings. For scoring,
embedding and softmax collapse into one table of logits per bucket, which is what is sent to executors
(BUCKETS x languages floats: its size does not depend on the data). Confidence is calibrated by one
temperature, fitted on rows kept out of training, and texts below the calibrated threshold are marked
as rejected.

Bound: SAMPLE labelled documents (those with the smallest hash of doc_id, of rows that repeat one a single
one) with together SAMPLE_BYTES of text are fitted, of which every eighth only calibrates.

Cases: a null text or one without any letter is `und` with score 0 and rejected; rows with a null lang
are scored but not learned from; no labelled rows at all: every text is `und`; very long texts are read
whole, in blocks; repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .kernel import LOWER, blocks, column, per_text

BUCKETS, DIM, ORDERS = 1 << 15, 8, (2, 3, 4)
SAMPLE, SAMPLE_BYTES = 2000, 32 << 20
STEPS, BATCH, RATE, RATE_OUT, RATE_BIAS = 400, 32, 300.0, 2.0, 0.05
TARGET = 0.99  # accuracy wanted among texts that are not rejected
UND = "und"

#: Bytes of words: ASCII letters and all of non-ASCII UTF-8; others are borders.
LETTER = np.zeros(256, bool)
LETTER[ord("a") : ord("z") + 1] = LETTER[0x80:] = True


def subwords(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order: the bucket of each subword of a block's texts, and each text's first one."""
    lower = LOWER[data]
    # every text gets a border before its first byte, the last one another after it
    shift = np.repeat(np.arange(1, len(offsets)), np.diff(offsets))
    code = np.zeros(len(data) + len(offsets), np.uint32)
    code[np.arange(len(data)) + shift] = np.where(LETTER[lower], lower, 0)
    text_at = np.append(offsets[:-1] + np.arange(len(offsets) - 1), len(code))
    letter = code > 0
    got = []
    value, keep = code, None
    for k in range(2, max(ORDERS) + 1):
        n = len(code) - k + 1
        value = value[:-1] * np.uint32(257) + code[k - 1 :]
        # no border strictly inside, and at least one letter
        keep = letter[:n] | letter[1:] if k == 2 else letter[1 : n + 1] if k == 3 else keep[:-1] & letter[k - 2 : n + k - 2]
        if k in ORDERS:
            where = np.flatnonzero(keep)
            h = (value[where] + np.uint32(k)) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x85EBCA77)
            got.append(((h >> np.uint32(33 - BUCKETS.bit_length())).astype(np.int32), np.searchsorted(where, text_at)))
    return got


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, langs = column(batch, "doc_id"), column(batch, "lang")
        out = []
        for lo, hi, data, offsets in blocks(column(batch, "text")):
            got = subwords(data, offsets)
            for i in range(hi - lo):
                u, c = np.unique(np.concatenate([b[f[i] : f[i + 1]] for b, f in got]), return_counts=True)
                out.append((u.astype(np.int32).tobytes(), (c / max(1, c.sum())).astype(np.float32).tobytes()))
        if out:
            yield pa.RecordBatch.from_arrays([ids, langs, pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())], names=["doc_id", "lang", "bucket", "share"])


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray  # BUCKETS x labels: mean over a text's subwords gives its logits
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def logits(self, parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.zeros((len(parts[0][1]) - 1, len(self.labels)), np.float64)
        n = np.maximum(sum(np.diff(first) for _, first in parts), 1)
        for bucket, first in parts:
            for j in range(len(self.labels)):
                out[:, j] += per_text(np.add, self.table[j][bucket], first, 0.0)
        return out / n[:, None] + self.bias

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def threshold(best: np.ndarray, right: np.ndarray) -> float:
    """The least score from which on TARGET of the rows are right; infinite, so that all are rejected, if there is none."""
    order = np.argsort(-best)
    ends = np.append(np.diff(best[order]) < 0, True)  # equal scores are taken or left together
    good = np.flatnonzero((np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= TARGET) & ends)
    return float(best[order[good[-1]]]) if len(good) else np.inf


def train(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, labels: list[str], seed: int = 7) -> Model:
    """SGD on embeddings and softmax weights; then temperature and threshold from the kept-out eighth."""
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 1 / DIM, (BUCKETS, DIM))
    out = np.zeros((DIM, len(labels)))
    bias = np.zeros(len(labels))
    held = np.arange(len(bags)) % 8 == 7 if len(bags) >= 80 else np.zeros(len(bags), bool)
    fit = np.flatnonzero(~held)
    order = np.concatenate([rng.permutation(fit) for _ in range(STEPS * BATCH // max(1, len(fit)) + 1)])
    for step in range(STEPS):
        part = order[step * BATCH : (step + 1) * BATCH]
        rate = RATE * (1 - step / STEPS)
        sizes = np.array([len(bags[i][0]) for i in part])
        idx = np.concatenate([bags[i][0] for i in part])
        share = np.concatenate([bags[i][1] for i in part])
        first = np.concatenate(([0], np.cumsum(sizes)))
        picked = emb[idx] * share[:, None]
        hidden = np.stack([per_text(np.add, picked[:, d], first, 0.0) for d in range(DIM)], axis=1)
        error = _softmax(hidden @ out + bias)
        error[np.arange(len(part)), y[part]] -= 1
        error /= len(part)
        back = error @ out.T
        out -= RATE_OUT * hidden.T @ error
        bias -= RATE_BIAS * error.sum(axis=0)
        for d in range(DIM):
            emb[:, d] -= rate * np.bincount(idx, np.repeat(back[:, d], sizes) * share, BUCKETS)
    model = Model(labels, np.ascontiguousarray((emb @ out).T.astype(np.float32)), bias)
    check = np.flatnonzero(held) if held.any() else fit
    if len(check):
        z = np.stack([np.array([(model.table[j][bags[i][0]] * bags[i][1]).sum() for j in range(len(labels))]) + bias for i in check])
        grid = np.geomspace(0.05, 20, 60)
        nll = [-np.log(_softmax(z / t)[np.arange(len(check)), y[check]] + 1e-12).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(nll))])
        p = _softmax(z / model.temperature)
        model.reject_below = threshold(p.max(axis=1), p.argmax(axis=1) == y[check])
    return model


def fit(labelled: DataFrame) -> Model | None:
    """A model from labelled rows (doc_id, text, lang); None if there are none."""
    common.tune(labelled.sparkSession)
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    rows = rows.withColumn("h", F.xxhash64("text"))
    picked, left = [], SAMPLE_BYTES
    for r in common.sample(rows.select("doc_id", "h", "lang", F.octet_length("text").alias("size")), SAMPLE, labelled.filter("lang IS NOT NULL").count()):
        if r["size"] <= left:
            left -= r["size"]
            picked.append((r["doc_id"], r["h"], r["lang"]))
    if not picked:
        return None
    few = F.broadcast(labelled.sparkSession.createDataFrame(picked, "doc_id long, h long, lang string"))  # at most SAMPLE rows
    chosen = rows.filter(F.col("doc_id").isin([r[0] for r in picked])).join(few, ["doc_id", "h", "lang"]).dropDuplicates(["doc_id"])
    got = chosen.select("doc_id", "lang", "text").mapInArrow(common.freeing(_bags), "doc_id long, lang string, bucket binary, share binary").collect()
    got = sorted(got, key=lambda r: (r.doc_id, r.lang, bytes(r.bucket)))
    labels = sorted({r.lang for r in got})
    bags = [(np.frombuffer(r.bucket, np.int32), np.frombuffer(r.share, np.float32)) for r in got]
    return train(bags, np.array([labels.index(r.lang) for r in got]), labels)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score and rejected for every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    common.tune(spark)
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            known = np.array(column(batch, "has_letter").to_pylist(), bool)
            best, conf = np.zeros(len(known), np.int64), np.zeros(len(known))
            if m is None:
                known[:] = False
            else:
                for lo, hi, data, offsets in blocks(column(batch, "text"), 1 << 20):
                    p = m.probabilities(m.logits(subwords(data, offsets)))
                    best[lo:hi], conf[lo:hi] = p.argmax(axis=1), p.max(axis=1)
            names = [m.labels[b] if k else UND for b, k in zip(best, known, strict=True)]
            conf = np.where(known, np.clip(conf, 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(names, pa.string()), pa.array(conf), pa.array(conf < m.reject_below if m else ~known)], names=["doc_id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("has_letter", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return rows.mapInArrow(common.freeing(score), "doc_id long, lang_pred string, score double, rejected boolean")


def held_out(doc_id, mod: int, rest: int):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod == rest, F.lit(False))


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.filter(~held_out("doc_id", 4, 2)).select("doc_id", "text", "lang"))
    got = predict(docs.select("doc_id", "text"), model)
    return got.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "rejected")


