"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text's paragraphs are its pieces between sentence or line ends, long ones cut every PIECE bytes from
their start, as a set of 64-bit digests. A sketch has three tables of `size` cells (a power of two); each
digest is added to one cell of each: a count, the xor of digests and the xor of their checks. Two
versions' sketches subtract cell by cell, a larger one being folded to the smaller's size, and peeling
cells that hold one digest recovers those that differ. Where peeling gets stuck, both are built again,
larger, until it does not. With d digests recovered of n1 + n2, likeness is (n1 + n2 - d) / (n1 + n2 + d),
the Jaccard similarity of the two sets.

Order and neighbours: documents are dealt by ranges of doc_id and sorted there; the first of each range
also goes to the end of the range before. A doc_id (or null) with the rows of several ranges has borders
inside, by a hash of the text and, for equal rows, a number of their own. Only borders and the first keys of
ranges reach the driver, a few for each partition.

Cases: a null or empty text has no pieces (likeness 1 to another such, 0 to others); null doc_ids come
last; rows with the same doc_id are each other's next, ordered by text (those of an id with the rows of several
ranges by a hash of it); a single row is its own next; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .kernel import U64, blocks, column, mix, runs, word_hashes

PIECE = 64
RANGES = 4  # for each partition
LAST = (1 << 63) - 1  # the key of a null doc_id
_CELL = np.dtype([("count", "u1"), ("key", "<u8"), ("check", "<u4")])
_STOP = np.zeros(256, bool)
_STOP[[0x0A, ord("."), ord("!"), ord("?")]] = True


def digests(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct paragraph digests of each text, end to end, and each text's first."""
    out: list[np.ndarray] = []
    for _, _, data, offsets in blocks(pa.array(texts, pa.large_binary())):
        stop = _STOP[data]
        last = np.zeros(len(data) + 1, bool)  # a piece ends before these bytes: after a run of stops
        last[1:-1] = stop[:-1] & ~stop[1:]
        start, end, _ = runs(np.ones(len(data), bool), offsets)
        cut = np.union1d(start, np.flatnonzero(last))
        cut = np.union1d(cut, end)
        begin = cut[:-1] if len(cut) else cut
        size = np.diff(cut) if len(cut) else cut
        many = (size + PIECE - 1) // PIECE
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        s = np.repeat(begin, many) + at * PIECE
        e = np.minimum(s + PIECE, np.repeat(begin + size, many))
        h = word_hashes(data, s, e)
        first = np.searchsorted(s, offsets)
        out += [np.unique(h[first[i] : first[i + 1]]) for i in range(len(offsets) - 1)]
    base = np.concatenate(([0], np.cumsum([len(x) for x in out]))).astype(np.int64)
    return (np.concatenate(out) if out else np.zeros(0, U64)), base


def power_of_two(n: np.ndarray) -> np.ndarray:
    return 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64)


def sizes(n: np.ndarray) -> np.ndarray:
    """Cells in each table of a fingerprint of n digests: enough for a quarter of them replaced."""
    return np.maximum(8, power_of_two(n * 0.35))


def _check(key: np.ndarray) -> np.ndarray:
    return mix(key ^ U64(0xA0761D6478BD642F)) & U64(0xFFFFFFFF)


def _places(key: np.ndarray, size: np.ndarray, base: np.ndarray) -> list[np.ndarray]:
    h = mix(key)
    return [base + t * size + ((h >> U64(21 * t)) & (size - 1).astype(U64)).astype(np.int64) for t in range(3)]


class Cells:
    """Sketches of several texts end to end. size: cells in each table of each."""

    def __init__(self, size: np.ndarray) -> None:
        self.size = size.astype(np.int64)
        self.base = np.concatenate(([0], np.cumsum(3 * self.size)))
        n = int(self.base[-1])
        self.count, self.key, self.check = np.zeros(n, np.int64), np.zeros(n, U64), np.zeros(n, U64)

    def add(self, key: np.ndarray, owner: np.ndarray, sign) -> None:
        check = _check(key)
        for at in _places(key, self.size[owner], self.base[owner]):
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.key, at, key)
            np.bitwise_xor.at(self.check, at, check)

    def peel(self) -> tuple[np.ndarray, np.ndarray]:
        """Digests recovered of each sketch, and whether nothing is left of it. Empties the cells."""
        found = np.zeros(len(self.size), np.int64)
        look = np.arange(len(self.count))
        while len(look):
            look = look[(np.abs(self.count[look]) == 1)]
            look = look[_check(self.key[look]) == self.check[look]]
            if not len(look):
                break
            owner = np.searchsorted(self.base, look, "right") - 1
            _, one = np.unique(np.stack([owner.astype(U64), self.key[look]]), axis=1, return_index=True)
            owner, key, sign = owner[one], self.key[look[one]], self.count[look[one]]
            np.add.at(found, owner, 1)
            self.add(key, owner, -sign)
            look = np.unique(np.concatenate(_places(key, self.size[owner], self.base[owner])))
        left = (self.count != 0) | (self.key != 0)
        stuck = np.zeros(len(self.size), bool)
        stuck[np.searchsorted(self.base, np.flatnonzero(left), "right") - 1] = True
        return found, ~stuck


def build(keys: np.ndarray, base: np.ndarray) -> list[str]:
    """Fingerprints: the number of digests, the size, and the cells in base64."""
    n = np.diff(base)
    cells = Cells(sizes(n))
    cells.add(keys, np.repeat(np.arange(len(n)), n), 1)
    raw = np.empty(len(cells.count), _CELL)
    raw["count"], raw["key"], raw["check"] = cells.count & 0xFF, cells.key, cells.check
    return [f"{k}.{s}.{base64.b64encode(raw[a:b].tobytes()).decode()}" for k, s, a, b in zip(n, cells.size, cells.base[:-1], cells.base[1:], strict=True)]


def _gather(keys: np.ndarray, base: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(base)[rows]
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(base[:-1][rows], n)
    return keys[at], np.repeat(np.arange(len(rows)), n)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Of the texts of a to those of b, one by one: peel the difference of their sketches, larger ones where that fails."""
    n1, n2 = np.diff(a[1]), np.diff(b[1])
    size = np.minimum(sizes(n1), sizes(n2))
    out = np.ones(len(n1))
    rows = np.flatnonzero(n1 + n2 > 0)
    while len(rows):
        cells = Cells(size[rows])
        for part, sign in ((a, 1), (b, -1)):
            cells.add(*_gather(*part, rows), sign)
        d, good = cells.peel()
        done = rows[good]
        out[done] = (n1[done] + n2[done] - d[good]) / (n1[done] + n2[done] + d[good])
        rows = rows[~good]
        size[rows] = np.maximum(2 * size[rows], power_of_two((n1[rows] + n2[rows]) * 0.45))
    return out


def compare(x: str, y: str) -> float | None:
    """Likeness from two fingerprints alone; None where peeling gets stuck and larger ones are needed."""
    sides = []
    for s in (x, y):
        n, size, cells = s.split(".", 2)
        sides.append((int(n), int(size), np.frombuffer(base64.b64decode(cells), _CELL)))
    size = min(sides[0][1], sides[1][1])
    got = Cells(np.array([size]))
    for (_, own, cells), sign in zip(sides, (1, -1), strict=True):
        fold = cells.reshape(3, own // size, size)
        got.count += sign * fold["count"].astype(np.int64).sum(axis=1).ravel()
        got.key ^= np.bitwise_xor.reduce(fold["key"], axis=1).ravel()
        got.check ^= np.bitwise_xor.reduce(fold["check"], axis=1).ravel().astype(U64)
    got.count = ((got.count + 128) % 256) - 128  # counts are kept modulo 256
    d, good = got.peel()
    n = sides[0][0] + sides[1][0]
    return (1.0 if not n else float((n - d[0]) / (n + d[0]))) if good[0] else None


def edited(text: str, after: str) -> str:
    """text with its last quarter of code points replaced by the first as many of after."""
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


_POINT = np.dtype([("h", "<i8"), ("salt", "<i8")])


class Borders:
    """Where ranges of (key, h, salt) begin: at these keys, and inside hot keys at points (h, salt)."""

    def __init__(self, keys: list[int], inner: dict[int, list[tuple[int, int]]]) -> None:
        self.inner = {k: np.array(sorted(p), _POINT) for k, p in inner.items()}
        self.keys = np.sort(np.array([*keys, *(k for k, p in inner.items() for _ in p)], np.int64))

    def place(self, key: np.ndarray, h: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """The range of each row: how many begin at it or before."""
        part = np.searchsorted(self.keys, key, "right")
        for k, points in self.inner.items():
            at = np.flatnonzero(key == k)
            if len(at):
                own = np.empty(len(at), _POINT)
                own["h"], own["salt"] = h[at], salt[at]
                part[at] -= len(points) - np.searchsorted(points, own, "right")
        return part


def _deal(borders: Borders, firsts: dict[int, tuple], before: dict[int, int]):
    """Adds the range of each row; the first row of a range goes to the range before as well."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, h, salt = (column(batch, c).to_numpy(zero_copy_only=False) for c in ("key", "h", "salt"))
            part = borders.place(key, h, salt)
            ghost = np.array([i for i, (p, *point) in enumerate(zip(part.tolist(), key.tolist(), h.tolist(), salt.tolist(), strict=True)) if firsts.get(p) == tuple(point)], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(np.zeros(len(part), bool)), *batch.columns], names=["part", "ghost", *batch.schema.names])
            if len(ghost):
                copy = batch.take(pa.array(ghost))
                yield pa.RecordBatch.from_arrays([pa.array([before[p] for p in part[ghost].tolist()], pa.int32()), pa.array(np.ones(len(ghost), bool)), *copy.columns], names=["part", "ghost", *copy.schema.names])

    return deal


def _results(pairs: list[tuple]) -> pa.RecordBatch:
    """pairs: (doc_id, text, text of the next)."""
    texts = [t.encode() for _, t, _ in pairs]
    changed = [edited(t, u).encode() for _, t, u in pairs]
    own, new, nxt = digests(texts), digests(changed), digests([u.encode() for _, _, u in pairs])
    cols = [[p[0] for p in pairs], [len(p[1]) for p in pairs], [hashlib.sha256(x).hexdigest() for x in changed], build(*own), build(*new), likeness(own, new), likeness(own, nxt)]
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None  # (part, doc_id, text) that waits for its next
    pairs: list[tuple] = []
    size = 0
    for batch in batches:
        for part, ghost, doc, text in zip(*(column(batch, c).to_pylist() for c in ("part", "ghost", "doc_id", "text")), strict=True):
            if held is not None:
                pairs.append((held[1], held[2], text))
                size += len(held[2])
            held = None if ghost else (part, doc, text)
            if size > 1 << 20 or len(pairs) >= 1000:
                yield _results(pairs)
                pairs, size = [], 0
    if pairs:
        yield _results(pairs)


def next_to_each(docs: DataFrame) -> DataFrame:
    """part, ghost, doc_id, text: ranges of documents in order, each followed by the first row of the range after it
    (the last range: by the first row of all) as a ghost."""
    spark = docs.sparkSession
    common.tune(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    n = common.partitions(spark)
    ranges = RANGES * n
    share = min(1.0, 16 * ranges / max(1, rows.select("key").count()))
    some = sorted(r["key"] for r in rows.select("key").sample(share, 5).collect())  # some 16 for each range
    cuts = Counter(some[len(some) * i // ranges] for i in range(1, ranges)) if some else Counter()
    hot = [k for k, times in cuts.items() if times > 1]  # at most as many as there are ranges
    zero = F.lit(0).cast("long")
    of_hot = lambda c: F.when(F.col("key").isin(hot), c).otherwise(zero) if hot else zero
    rows = rows.withColumn("h", of_hot(F.xxhash64("text"))).withColumn("salt", of_hot(F.xxhash64(F.monotonically_increasing_id())))
    inner: dict[int, list[tuple[int, int]]] = {}
    if hot:
        found = rows.filter(F.col("key").isin(hot)).select("key", "h", "salt")
        points: dict[int, list[tuple[int, int]]] = {}
        for r in found.sample(share, 7).collect():
            points.setdefault(r["key"], []).append((r["h"], r["salt"]))
        for k, own in points.items():
            own.sort()
            inner[k] = sorted({own[len(own) * i // cuts[k]] for i in range(1, cuts[k])})
    borders = Borders([*cuts], inner)
    shared = spark.sparkContext.broadcast(borders)  # RANGES for each partition

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, h, salt = (column(batch, c).to_numpy(zero_copy_only=False) for c in ("key", "h", "salt"))
            part = shared.value.place(key, h, salt)
            order = np.lexsort((salt, h, key, part))
            one = order[np.flatnonzero(np.diff(part[order], prepend=-1))] if len(order) else order
            yield pa.RecordBatch.from_arrays([pa.array(part[one], pa.int32()), pa.array(key[one]), pa.array(h[one]), pa.array(salt[one])], names=["part", "key", "h", "salt"])

    found = rows.select("key", "h", "salt").mapInArrow(common.freeing(place), "part int, key long, h long, salt long")
    found = found.groupBy("part").agg(F.min(F.struct("key", "h", "salt")).alias("first")).collect()  # one row for each range
    firsts = {r["part"]: tuple(r["first"]) for r in found}
    order = sorted(firsts)
    before = {p: order[i - 1] for i, p in enumerate(order)}
    dealt = rows.mapInArrow(common.freeing(_deal(borders, firsts, before)), "part int, ghost boolean, key long, doc_id long, text string, h long, salt long")
    return dealt.repartition(n, "part").sortWithinPartitions("part", "ghost", "key", "h", "salt", "text").drop("key", "h", "salt")


def _first_ghosts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that share the smallest doc_id of a range all came as ghosts: only the first of them is the next."""
    last = None
    for batch in batches:
        part, ghost = column(batch, "part").to_pylist(), column(batch, "ghost").to_pylist()
        keep = []
        for p, g in zip(part, ghost, strict=True):
            keep.append(not g or last != (p, True))
            last = (p, g)
        yield batch.filter(pa.array(keep, pa.bool_()))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of docs (doc_id, text) and of their edited texts, with likeness to the edited and the next text."""
    rows = next_to_each(docs)
    return rows.mapInArrow(lambda batches: _walk(_first_ghosts(batches)), SCHEMA)


def op6_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
