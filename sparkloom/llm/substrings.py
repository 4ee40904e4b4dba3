"""Exact substring dedup by fixed-block anchors.

Every text is cut into non-overlapping reference blocks of BLOCK words; a window of WINDOW >= 2 * BLOCK - 1
words that occurs twice holds a whole reference block of its earlier occurrence. So: index the reference
blocks, probe the index with every rolling BLOCK-word window, and look only at the WINDOW-word windows
around hits. Equal ones are ordered by (doc_id, start); each but the first is a repeat, and overlapping
repeats make up the maximal repeated runs.

Layout: documents are packed into chunks (compressed texts of about chunk_bytes each), shuffled and written
once, as a table bucketed by chunk. A chunk sends each distinct hash once to the bucket of that hash, packed
with the others of that bucket, so a passage that a third of all documents share costs one entry a chunk.
Buckets answer per chunk with the hashes that were hit (then: that are not first there), and the answers join
the chunks where they lie. Nothing is broadcast or collected but one count, from which the number of buckets
follows, so that a bucket holds about BUCKET_WORDS hashes at every size.

Probe hashes have enough bits for the input's words, so that false hits stay rare; they cost a look at a
window and nothing else. Windows are compared by 128 bits, of hashes that are not linear in the text: among
the 1.5e13 windows of 100 TB, any two different ones meet with a probability of about 3e-13.

Cases: a null text has no words; texts with fewer words than WINDOW lose nothing; rows that repeat a
doc_id are ordered by chunk and place; null doc_ids come last; a text of any length is one document in
one chunk; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .kernel import U64, blocks, column, inside, join, window_hashes, word_hashes, words

WINDOW, BLOCK = 20, 10
LAST = (1 << 63) - 1
BUCKET_WORDS = 2_000_000  # distinct hashes that a bucket holds in memory, at most about this many
MIN_BUCKETS, MOST_PARTS = 64, 100_000  # the latter is Spark's limit on the buckets of a table
CHUNK = "chunk long, n_words long, payload binary"
ANSWER = "chunk long, payload binary"


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned integers, byte plane by byte plane, compressed."""
    raw = b"".join(np.array([len(a), a.itemsize], "<u4").tobytes() + np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    out, at = [], 0
    while at < len(raw):
        n, width = np.frombuffer(raw, "<u4", 2, at)
        n, width = int(n), int(width)
        planes = np.frombuffer(raw, np.uint8, n * width, at + 8).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(f"<u{width}") if n else np.zeros(0, f"<u{width}"))
        at += 8 + n * width
    return out


def _packed_sorted(values: np.ndarray) -> np.ndarray:
    """Differences of a sorted array, which pack smaller."""
    return np.diff(values, prepend=values.dtype.type(0))


def _chunker(limit: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seq = TaskContext.get().partitionId() << 32, 0
        ids: list[int] = []
        parts: list[bytes] = []
        lengths: list[np.ndarray] = []
        size = n_words = 0

        def flush() -> pa.RecordBatch:
            payload = zstandard.ZstdCompressor(level=1).compress(np.array([len(ids)], "<i8").tobytes() + np.array(ids, "<i8").tobytes() + np.concatenate(lengths).astype("<i8").tobytes() + b"".join(parts))
            return pa.RecordBatch.from_arrays([pa.array([base + seq], pa.int64()), pa.array([n_words], pa.int64()), pa.array([payload], pa.binary())], names=["chunk", "n_words", "payload"])

        for batch in batches:
            key = column(batch, "key").to_pylist()
            for lo, hi, data, offsets in blocks(column(batch, "text"), limit):
                ids += key[lo:hi]
                parts.append(data.tobytes())
                lengths.append(np.diff(offsets))
                size += len(data)
                n_words += len(words(data, offsets)[0])
                if size >= limit:
                    yield flush()
                    seq, ids, parts, lengths, size, n_words = seq + 1, [], [], [], 0, 0
        if ids:
            yield flush()

    return pack


def chunks(docs: DataFrame, chunk_bytes: int) -> tuple[DataFrame, int]:
    """The documents (doc_id, text) as a table of chunks, bucketed by chunk, and in how many parts."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("key"), F.col("text").cast("string").alias("text"))
    n, name = min(common.partitions(spark), MOST_PARTS), f"sparkloom_{uuid.uuid4().hex}"
    packed = rows.mapInArrow(common.freeing(_chunker(chunk_bytes)), CHUNK).repartition(n, "chunk")
    packed.write.format("parquet").bucketBy(n, "chunk").option("path", common.fresh_path(spark, "chunks")).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its name alone goes: the folder is not the catalogue's
    return table, n


class _Chunk:
    def __init__(self, payload: bytes) -> None:
        raw = zstandard.ZstdDecompressor().decompress(payload, max_output_size=0)
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        self.ids = np.frombuffer(raw, "<i8", n, 8)
        self.offsets = np.concatenate(([0], np.cumsum(np.frombuffer(raw, "<i8", n, 8 + 8 * n))))
        self.data = np.frombuffer(raw, np.uint8, offset=8 + 16 * n)
        self.start, self.end, self.first = words(self.data, self.offsets)

    def windows(self, *seeds: int) -> tuple[np.ndarray, ...]:
        """First word of each window of WINDOW words of one document, and its hashes, one for each seed."""
        at, _ = inside(self.first, WINDOW)
        got = word_hashes(self.data, self.start, self.end, *seeds)
        return at, *(window_hashes(h, WINDOW)[at] for h in (got if len(seeds) > 1 else [got]))

    def probes(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word of each window of BLOCK words of one document, bits of its hash, and whether it is a reference block."""
        at, _ = inside(self.first, BLOCK)
        h = window_hashes(word_hashes(self.data, self.start, self.end), BLOCK)[at]
        return at, h >> U64(64 - bits), (at - self.first[self.owner(at)]) % BLOCK == 0

    def owner(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, "right") - 1


def _distinct(h: np.ndarray, flag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values; whether any has the flag; how often each comes."""
    both = np.sort(h << U64(1) | flag.astype(U64))
    v = both >> U64(1)
    cut = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1]))) if len(v) else np.zeros(0, np.int64)
    ends = np.append(cut[1:], len(v)) if len(v) else cut
    return v[cut], (both[ends - 1] & U64(1)).astype(bool) if len(v) else np.zeros(0, bool), ends - cut


def _in_sorted(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return among[at] == values


def _in_pairs(one: np.ndarray, two: np.ndarray, among: np.ndarray, with_: np.ndarray) -> np.ndarray:
    """Whether (one, two) is among the pairs (among, with_), which are sorted."""
    out = np.zeros(len(one), bool)
    at = np.searchsorted(among, one)
    live = np.arange(len(one))
    while len(live):
        live = live[at[live] < len(among)]
        live = live[among[at[live]] == one[live]]
        hit = with_[at[live]] == two[live]
        out[live[hit]] = True
        live = live[~hit]
        at[live] += 1
    return out


def _bucketed(chunk: int, bucket: np.ndarray, make, names=("bucket", "chunk", "payload")) -> pa.RecordBatch | None:
    """One packed row for each bucket of sorted bucket numbers."""
    if not len(bucket):
        return None
    cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    ends = np.append(cut[1:], len(bucket))
    return pa.RecordBatch.from_arrays([pa.array(bucket[cut].astype(np.int32)), pa.array(np.full(len(cut), chunk, np.int64)), pa.array([make(a, b) for a, b in zip(cut, ends, strict=True)], pa.binary())], names=list(names))


def _prober(bits: int, top: int):
    """Each chunk's distinct rolling windows, by bucket: hash with the flag of a reference block below it."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, payload in zip(column(batch, "chunk").to_pylist(), column(batch, "payload"), strict=True):
                _, h, block = _Chunk(payload.as_py()).probes(bits)
                v, flag, _ = _distinct(h, block)
                rest = (v & U64((1 << (bits - top)) - 1)) << U64(1) | flag.astype(U64)
                rest = rest.astype(np.uint32) if bits - top < 32 else rest
                out = _bucketed(chunk, v >> U64(bits - top), lambda a, b, rest=rest: _pack(_packed_sorted(rest[a:b])))
                if out:
                    yield out

    return probe


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[int], list[bytes]]]:
    """Rows sorted by their first column, group by group."""
    now, chunk, payload = None, [], []
    for batch in batches:
        for k, c, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if k != now:
                if chunk:
                    yield now, chunk, payload
                now, chunk, payload = k, [], []
            chunk.append(c)
            payload.append(p.as_py())
    if chunk:
        yield now, chunk, payload


def _answers(chunk_ids: list[int], who: np.ndarray, *values: np.ndarray) -> pa.RecordBatch | None:
    """For each chunk the values (sorted already) that are its own; the first ones as differences."""
    if not len(who):
        return None
    order = np.argsort(who, kind="stable")
    who, values = who[order], [v[order] for v in values]
    cut = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1])))
    ends = np.append(cut[1:], len(who))
    packed = [_pack(_packed_sorted(values[0][a:b]), *(v[a:b] for v in values[1:])) for a, b in zip(cut, ends, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([chunk_ids[i] for i in who[cut]], pa.int64()), pa.array(packed, pa.binary())], names=["chunk", "payload"])


def _hits(bits: int, top: int):
    """In each bucket: hashes of a reference block in one chunk and of any window in another, told to all chunks that have them."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, chunk, payload in _groups(batches):
            parts = [np.cumsum(_unpack(p)[0].astype(U64), dtype=U64) for p in payload]
            who = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
            both = np.concatenate(parts)
            order = np.argsort(both, kind="stable")
            both, who = both[order], who[order]
            v = both >> U64(1)
            cut = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
            n = np.diff(np.append(cut, len(v)))
            flagged = np.logical_or.reduceat((both & U64(1)).astype(bool), cut)
            hit = np.repeat((n > 1) & flagged, n)
            out = _answers(chunk, who[hit], v[hit] | U64(bucket) << U64(bits - top))
            if out:
                yield out

    return find


def _with_answers(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[int, _Chunk, list[np.ndarray]]]:
    """Chunks with all their answers, of width arrays each: put together and sorted."""
    for batch in batches:
        for chunk, payload, answers in zip(column(batch, "chunk").to_pylist(), column(batch, "payload"), column(batch, "answers"), strict=True):
            parts = [_unpack(a) for a in answers.as_py() or []]
            got = [np.concatenate([np.cumsum(p[0], dtype=U64) if i == 0 else p[i] for p in parts]) if parts else np.zeros(0, U64) for i in range(width)]
            order = np.lexsort(got[::-1])
            yield chunk, _Chunk(payload.as_py()), [x[order] for x in got]


def _extender(bits: int, top: int):
    """Around hits: the distinct WINDOW-word windows of each chunk, with the smallest doc_id that has them."""

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, c, (told,) in _with_answers(batches, 1):
            at, h, block = c.probes(bits)
            v, flag, n = _distinct(h, block)
            here = v[flag & (n > 1)]
            hit = np.zeros(len(c.start) + 1, np.int64)
            hit[at + 1] = _in_sorted(h, told) | _in_sorted(h, here)
            seen = np.concatenate((np.cumsum(hit), np.full(WINDOW, hit.sum())))
            if not seen[-1]:
                continue
            wide, w, x = c.windows(0, 1)
            near = seen[wide + WINDOW - BLOCK + 1] > seen[wide]
            wide, w, x = wide[near], w[near], x[near]
            doc = c.ids[c.owner(wide)]
            order = np.lexsort((doc, x, w))
            w, x, doc = w[order], x[order], doc[order].astype(U64)
            one = np.flatnonzero(np.concatenate(([True], (w[1:] != w[:-1]) | (x[1:] != x[:-1])))) if len(w) else np.zeros(0, np.int64)
            w, x, doc = w[one], x[one], doc[one]
            out = _bucketed(chunk, w >> U64(64 - top), lambda a, b, w=w, x=x, doc=doc: _pack(_packed_sorted(w[a:b]), x[a:b], doc[a:b]))
            if out:
                yield out

    return extend


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In each bucket: windows of several chunks, told to all of these but the one with the first occurrence."""
    for _, chunk, payload in _groups(batches):
        parts = [_unpack(p) for p in payload]
        w = np.concatenate([np.cumsum(p[0], dtype=U64) for p in parts])
        x, doc = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
        who = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        order = np.lexsort((np.array(chunk)[who], doc, x, w))
        w, x, who = w[order], x[order], who[order]
        late = np.concatenate(([False], (w[1:] == w[:-1]) & (x[1:] == x[:-1])))
        out = _answers(chunk, who[late], w[late], x[late])
        if out:
            yield out


RESULT = "doc_id long, n_words long, n_removed long, kept string"


def _remover(with_text: bool):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, c, (late, late_x) in _with_answers(batches, 2):
            at, w, x = c.windows(0, 1)
            # all occurrences here but the first by (doc_id, place), which is late only if told so
            place = np.argsort(c.ids, kind="stable")
            rank = np.empty(len(place), np.int64)
            rank[place] = np.arange(len(place))
            repeat = _in_pairs(w, x, late, late_x)
            if len(at):
                order = np.lexsort((at, rank[c.owner(at)], x, w))
                s, t = w[order], x[order]
                repeat[order[1:]] |= (s[1:] == s[:-1]) & (t[1:] == t[:-1])
            depth = np.zeros(len(c.start) + WINDOW + 1, np.int64)
            np.add.at(depth, at[repeat], 1)
            np.add.at(depth, at[repeat] + WINDOW, -1)
            gone = np.cumsum(depth)[: len(c.start)] > 0
            before = np.concatenate(([0], np.cumsum(gone)))
            removed = before[c.first[1:]] - before[c.first[:-1]]
            raw = c.data.tobytes()
            kept = []
            for i in range(len(c.ids)):
                own = raw[c.offsets[i] : c.offsets[i + 1]].split()
                if removed[i]:
                    own = compress(own, (~gone[c.first[i] : c.first[i + 1]]).tolist())
                text = b" ".join(own)
                kept.append(text.decode("utf-8", "replace") if with_text else hashlib.sha256(text).hexdigest())
            ids = [None if x == LAST else x for x in c.ids.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.diff(c.first).astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return remove


def remove_repeats(docs: DataFrame, digest: bool = False, chunk_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by one space; with digest their SHA-256) of docs (doc_id, text)."""
    spark = docs.sparkSession
    common.tune(spark)
    table, parts = chunks(docs, chunk_bytes)
    total = table.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    bits = min(56, max(32, int(total).bit_length() + 10))
    n_buckets = max(MIN_BUCKETS, total // BUCKET_WORDS)
    top = int(n_buckets - 1).bit_length()
    n = max(common.partitions(spark), 8)
    texts = table.select("chunk", "payload")

    def by_bucket(rows: DataFrame) -> DataFrame:
        return rows.repartition(n, "bucket").sortWithinPartitions("bucket", "chunk")

    def meet(answers: DataFrame) -> DataFrame:
        """Only answers move: the chunks are dealt like this already."""
        own = answers.repartition(parts, "chunk").groupBy("chunk").agg(F.collect_list("payload").alias("answers"))
        return texts.join(own, "chunk", "left").select("chunk", "payload", "answers")

    row = "bucket int, chunk long, payload binary"
    hits = by_bucket(texts.mapInArrow(common.freeing(_prober(bits, top)), row)).mapInArrow(common.freeing(_hits(bits, top)), ANSWER)
    wide = meet(hits).mapInArrow(common.freeing(_extender(bits, top)), row)
    late = by_bucket(wide).mapInArrow(common.freeing(_later), ANSWER)
    return meet(late).mapInArrow(common.freeing(_remover(not digest)), RESULT)


def op10_substrings(spark, sf_dir: str) -> DataFrame:
    got = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), digest=True)
    return got.withColumnRenamed("kept", "kept_sha256")


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d) x),
late AS (SELECT doc_id, i FROM v QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM late),
t AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
left_ AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS s FROM t ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN left_ ON left_.doc_id = d.doc_id
"""
