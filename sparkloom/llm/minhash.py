"""Near-duplicates by b-bit MinHash, exact links and connected components.

A document's set is its distinct SHINGLE-word shingles (hashed to 64 bits; A-Z in lower case). Rows with
equal sets are one class, told by the sets' digests, and only classes go on. Each gets HASHES minima: bands
of ROWS of them give candidate buckets, and BITS low bits of each, packed, a signature. Within a bucket,
signatures are compared by counting equal fields; agreement by chance (2**-BITS) is taken out of the
estimate. Pairs estimated at LEAST or more are confirmed on full sets.

Not all pairs of a bucket are written. First, each bucket (in parts of at most PART rows and PART_BYTES of
sets, all tied to the bucket's first row) gives a maximum spanning forest of its estimates: confirmed links
of it make components. Then, in buckets that still hold several components, rows outside the bucket's
largest one are compared with all the others: by signatures alone at first, which are all that goes to the
bucket's other parts, and each pair is looked at in the first band that it has in common; where an estimate
is high enough, full sets follow, and only links that hold come out, one for each row and component. So any two candidates at 0.8 or more end in one component.

A pair at similarity 0.8 shares no band with probability (1 - 0.8**5)**25 = 5e-5, and its estimate falls
short of LEAST with a like one (four standard errors). Two different shingles of a pair of documents have
the same hash with a chance of 2**-64 each.

Cases: a null or empty text has no shingle and is linked with nothing; texts of fewer words than SHINGLE
have their whole sequence as one shingle; null doc_ids are kept, unlinked, component null; rows that
repeat a doc_id are one document, linked with whatever any of them is linked with; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components
from .kernel import LOWER, U64, blocks, column, inside, mix, per_text, window_hashes, word_hashes, words

HASHES, BANDS, ROWS, BITS = 128, 25, 5, 8
LEAST = 0.66
PART, PART_BYTES = 4096, 32 << 20
HOT = 500
BROADCAST = 16 << 20  # bytes of a table that is sent to all tasks, by its counted rows and their fixed width
BLOOM = 1 << 26  # bits at most: beyond it, documents are picked by a join on doc_id

_rng = np.random.default_rng(20)
_MUL = (_rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)

SIGNED = "doc_id long, n_shingles long, digest binary, signature binary, bands array<long>"


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes (with repeats) of a block's texts and each text's first."""
    low = LOWER[data]
    start, end, first = words(low, offsets)
    h = word_hashes(low, start, end)
    at, base = inside(first, k)
    got = window_hashes(h, k)[at] if len(at) else np.zeros(0, U64)
    n = np.diff(first)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        whole = np.array([window_hashes(h[first[i] : first[i + 1]], int(n[i]))[0] for i in short], U64)
        got = np.insert(got, base[short], whole)
        extra = np.zeros(len(n) + 1, np.int64)
        extra[short + 1] = 1
        base = base + np.cumsum(extra)
    return got, base


def _signer(k: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = column(batch, "doc_id")
            for lo, hi, data, offsets in blocks(column(batch, "text"), 1 << 18):
                got, base = shingles(data, offsets, k)
                n = hi - lo
                count, digest = np.zeros(n, np.int64), [b""] * n
                for i in range(n):
                    if base[i + 1] > base[i]:
                        u = np.unique(got[base[i] : base[i + 1]])
                        count[i], digest[i] = len(u), _digest(u)
                x = (got >> U64(32)).astype(np.uint32)
                minima = np.empty((n, HASHES), np.uint32)
                for j in range(HASHES):
                    minima[:, j] = per_text(np.minimum, x * _MUL[j] + _ADD[j], base, 0)
                fields = (mix(minima.astype(U64)) & U64((1 << BITS) - 1)).astype(np.uint8)
                bands = np.zeros((n, BANDS), U64)
                for r in range(ROWS):
                    bands = mix(bands * U64(0x9E3779B97F4A7C15) + minima[:, r : BANDS * ROWS : ROWS].astype(U64) + U64(1))
                bands = mix(bands + np.arange(BANDS, dtype=U64)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, n), pa.array(count), pa.array(digest, pa.binary()), pa.array([r.tobytes() for r in fields], pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(0, n * BANDS + 1, BANDS), pa.int32()), pa.array(bands.ravel()))],
                    names=["doc_id", "n_shingles", "digest", "signature", "bands"],
                )

    return sign


def estimate(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Similarity of one signature to many: the share of equal fields, less those equal by chance."""
    chance = 2.0**-BITS
    return ((many == one).mean(axis=1) - chance) / (1 - chance)


def _forest(ids: np.ndarray, sig: np.ndarray, least: float) -> Iterator[tuple[int, int]]:
    """Edges of estimate >= least of the maximum spanning tree (Prim, one vectorised step for each row)."""
    n = len(ids)
    best, link, out = np.full(n, -1.0), np.zeros(n, np.int64), np.ones(n, bool)
    now = 0
    for _ in range(n - 1):
        out[now] = False
        rest = np.flatnonzero(out)
        e = estimate(sig[now], sig[rest])
        up = e > best[rest]
        best[rest[up]], link[rest[up]] = e[up], now
        now = int(rest[np.argmax(best[rest])])
        if best[now] >= least:
            yield int(ids[link[now]]), int(ids[now])


def _lists(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of rows with the same lid, whole, as arrays."""
    now, rows = None, []
    for batch in batches:
        cols = [column(batch, c).to_pylist() for c in names]
        for lid, *row in zip(column(batch, "lid").to_pylist(), *cols, strict=True):
            if lid != now:
                if rows:
                    yield tuple(zip(*rows, strict=True))
                now, rows = lid, []
            rows.append(row)
    if rows:
        yield tuple(zip(*rows, strict=True))


def _signatures(raw) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)


def _pairs(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = np.array(edges, np.int64).reshape(-1, 2).T
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    edges: list[tuple[int, int]] = []
    for ids, sig in _lists(batches, ("id", "signature")):
        edges += _forest(np.array(ids), _signatures(sig), LEAST)
        if len(edges) > 20000:
            yield _pairs(edges)
            edges = []
    if edges:
        yield _pairs(edges)


def _alike(i: int, to: np.ndarray, comp: np.ndarray, sig: np.ndarray, mask: int) -> np.ndarray:
    """Of the rows `to` of a list those in other components than row i that are like enough by signature, and whose first band in common with it is the list's (mask: its bands)."""
    to = to[comp[to] != comp[i]]
    if len(to):
        to = to[estimate(sig[i], sig[to]) >= LEAST]
    if len(to):  # a band's minima are ROWS fields one after the other
        same = (sig[to, : BANDS * ROWS] == sig[i, : BANDS * ROWS]).reshape(len(to), BANDS, ROWS).all(axis=2)
        to = to[same.any(axis=1) & (mask >> same.argmax(axis=1) & 1 == 1)]
    return to


def _main(comp: np.ndarray):
    """The largest component of a list."""
    names, n = np.unique(comp, return_counts=True)
    return names[np.argmax(n)]


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each list, the rows outside its largest component (or sent along from other parts) whose signatures are like others' in other components, and those others: lid, id and near (false: one of those others)."""
    for lid, ids, comp, sig, guest, mask in _lists(batches, ("lid", "id", "comp", "signature", "guest", "mask")):
        comp, sig, guest = np.array(comp), _signatures(sig), np.array(guest)
        own = np.flatnonzero(~guest)
        if not len(own):
            continue
        main = _main(comp[own])
        near, met = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
        for i in np.flatnonzero(guest | (comp != main)):
            to = _alike(i, own if guest[i] else own[(comp[own] == main) | (own > i)], comp, sig, mask[0])
            near[i], met[to] = len(to) > 0, True
        out = np.flatnonzero(near | met)
        if len(out):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(out), lid[0])), pa.array([ids[i] for i in out], pa.int64()), pa.array(near[out])], names=["lid", "id", "near"])


def _across(num: int, den: int):
    """Links between components, of rows marked as `near`, on full sets, counted for all candidates at once. One link for each row and component."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges: list[tuple[int, int]] = []
        for ids, comp, sig, raw, guest, near, mask in _lists(batches, ("id", "comp", "signature", "members", "guest", "near", "mask")):
            ids, comp, sig, guest = np.array(ids), np.array(comp), _signatures(sig), np.array(guest)
            own = np.flatnonzero(~guest)
            if not len(own):
                continue
            size = np.array([len(x) // 8 for x in raw])
            first = np.concatenate(([0], np.cumsum(size)))
            values, sets = np.unique(np.frombuffer(b"".join(raw), "<u8"), return_inverse=True)
            sets, mark = sets.astype(np.int32 if len(values) < 1 << 31 else np.int64), np.zeros(len(values), np.int32)
            for i in np.flatnonzero(np.array(near)):
                to = _alike(i, own, comp, sig, mask[0])
                if not len(to):
                    continue
                mark[sets[first[i] : first[i + 1]]] = 1
                same = np.array([mark[sets[first[j] : first[j + 1]]].sum() for j in to]) if len(to) < 16 else np.add.reduceat(mark[sets], first[:-1])[to]
                mark[sets[first[i] : first[i + 1]]] = 0
                to = to[den * same >= num * (size[i] + size[to] - same)]
                _, one = np.unique(comp[to], return_index=True)
                edges += [(int(ids[i]), int(ids[j])) for j in to[one]]
            if len(edges) > 20000:
                yield _pairs(edges)
                edges = []
        if edges:
            yield _pairs(edges)

    return links


def _digest(u: np.ndarray) -> bytes:
    """Of a set: its size and two sums, 192 bits."""
    return np.array([len(u), mix(u).sum(dtype=U64), mix(u ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64)], "<u8").tobytes()


def _setter(k: int, shared):
    """doc_id, digest and sorted set of the documents that the filter (if there is one) passes."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[tuple] = set()  # equal rows of a task are given once
        for batch in batches:
            if shared is not None:
                bloom, slot = shared.value, column(batch, "slot").to_numpy(zero_copy_only=False)
                batch = batch.filter(pa.array((bloom[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1))
            for lo, hi, data, offsets in blocks(column(batch, "text"), 1 << 18):
                got, base = shingles(data, offsets, k)
                sets = [np.unique(got[base[i] : base[i + 1]]) for i in range(hi - lo)]
                ids = column(batch, "doc_id").slice(lo, hi - lo).to_pylist()
                new = [(*key, u.astype("<u8").tobytes()) for i, u in zip(ids, sets, strict=True) if (key := (i, _digest(u))) not in told and not told.add(key)]
                if new:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*new, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["rep", "digest", "members"])

    return make


def _confirmer(num: int, den: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(column(batch, "x"), column(batch, "y"), strict=True):
                u, v = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                at = np.minimum(np.searchsorted(v, u), max(len(v) - 1, 0))
                same = int((v[at] == u).sum()) if len(v) else 0
                keep.append(den * same >= num * (len(u) + len(v) - same))
            yield pa.RecordBatch.from_arrays([column(batch, "a"), column(batch, "b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return confirm


def _small(table: DataFrame, width: int, n: int | None = None) -> DataFrame:
    """A written table of rows of at most width bytes, to be broadcast if it is small: beside it, sets are not shuffled."""
    return F.broadcast(table) if (table.count() if n is None else n) * width <= BROADCAST else table


def _sets(ids: DataFrame, classes: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """id and members, the full set, of the classes in ids (id), from the texts of their smallest doc_ids.

    Texts are picked by a filter of 16 to 32 bits for each class, which is counted first, or, where that has more than BLOOM bits, by a join.
    """
    spark = docs.sparkSession
    wanted = common.materialize(ids.select("id").distinct().join(classes.select("id", "digest", "rep"), "id"), "wanted")
    many = wanted.count()
    bits = max(1 << 16, 1 << (16 * many).bit_length())
    if bits <= BLOOM:
        maps = wanted.select((F.pmod(F.xxhash64("rep"), F.lit(bits)) + 1).alias("slot")).groupBy(F.expr("bitmap_bucket_number(slot)").alias("n")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bits")).collect()
        bloom = np.zeros(bits >> 3, np.uint8)
        for r in maps:  # at most BLOOM / 32768 rows of 4 KB; slots and bucket numbers count from 1
            raw, at = np.frombuffer(bytes(r["bits"]), np.uint8), (r["n"] - 1) * 4096
            bloom[at : at + len(raw)] = raw[: len(bloom) - at]
        rows, shared = docs.withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.lit(bits))).filter("slot IS NOT NULL"), spark.sparkContext.broadcast(bloom)
    else:
        rows, shared = docs.join(wanted.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"), None
    made = common.materialize(rows.mapInArrow(common.freeing(_setter(k, shared)), "rep long, digest binary, members binary"), "sets")
    out = made.join(_small(wanted, 64, many), ["rep", "digest"]).select("id", "members")
    n = out.agg(F.count(F.lit(1)).alias("all"), F.count_distinct("id").alias("each")).first()
    return out if n["all"] == n["each"] else out.dropDuplicates(["id"])  # the sets are shuffled for that only if rows repeat


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Those of pairs (a, b) whose full sets are similar enough."""
    sets = _sets(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))), classes, docs, k)
    firsts, n = sets.select(F.col("id").alias("a"), F.col("members").alias("x")), pairs.count()
    if n * 32 <= BROADCAST:
        both = firsts.join(_small(pairs, 32, n), "a")
    else:  # a bucket's first row is in a pair with each other: its set goes to as many places as it has HOT pairs
        hot = common.materialize(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / HOT).cast("int").alias("copies")).filter("copies > 1"), "hot")
        hot = _small(hot, 32)
        pairs = pairs.join(hot, "a", "left").withColumn("copy", F.pmod(F.xxhash64("b"), F.coalesce("copies", F.lit(1))).cast("int"))
        firsts = firsts.join(hot, "a", "left").select("a", "x", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)).alias("copy"))
        both = pairs.join(firsts, ["a", "copy"])
    both = both.join(sets.select(F.col("id").alias("b"), F.col("members").alias("y")), "b")
    return common.materialize(both.select("a", "b", "x", "y").mapInArrow(common.freeing(_confirmer(num, den)), "a long, b long"), "confirmed")


def near_duplicates(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, part: int = PART) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for docs (doc_id, text); linked: den * intersection >= num * union."""
    spark = docs.sparkSession
    common.tune(spark)
    n = common.partitions(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with common.scope() as keep:  # all other tables go as soon as the groups are written
        signed = keep(common.materialize(docs.mapInArrow(common.freeing(_signer(shingle)), SIGNED), "signed"))
        known = signed.filter("doc_id IS NOT NULL AND n_shingles > 0")
        # equal digests have equal signatures and bands, so that any will do; the written numbers name classes from here on
        found = known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("size"), F.first("signature").alias("signature"), F.first("bands").alias("bands"))
        classes = common.materialize(found.withColumn("id", F.monotonically_increasing_id()), "classes")

        banded = classes.select("id", "size", F.posexplode("bands").alias("at", "band"))
        counts = banded.groupBy("band").agg(F.count(F.lit(1)).alias("c"), F.sum("size").alias("bytes")).filter("c > 1")
        counts = common.materialize(counts.select("band", "c", F.ceil(F.greatest(F.col("c") / part, F.col("bytes") * 8 / PART_BYTES)).alias("parts")), "bands")
        dealt = banded.join(counts, "band").withColumn("blk", F.pmod(F.xxhash64("id"), "parts"))
        listed = common.materialize(dealt.groupBy("band", "blk", "parts").agg(F.array_sort(F.collect_set("id")).alias("ids"), F.call_function("shiftleft", F.lit(1), F.min("at")).alias("mask")), "lists")  # at most about part ids each
        large = listed.filter("parts > 1")
        lists = listed.withColumn("lid", F.when(F.col("parts") > 1, F.xxhash64("band", "blk")).otherwise(F.xxhash64("ids")))
        lists = lists.groupBy("lid").agg(F.bit_or("mask").alias("mask"), *[F.min(c).alias(c) for c in ("band", "blk", "parts", "ids")])  # lists of the same ids are one, of several bands
        lists = common.materialize(lists.filter("size(ids) > 1 OR parts > 1").select("lid", "mask", "band", "blk", "parts", "ids"), "unique-lists")
        rows = lists.select("lid", "mask", "band", "blk", "parts", F.explode("ids").alias("id"))
        signatures = classes.select("id", "signature")
        grouped = rows.select("lid", "id").join(signatures, "id").repartition(n, "lid").sortWithinPartitions("lid", "id")
        trees = grouped.mapInArrow(common.freeing(_forests), "a long, b long")
        first = large.groupBy("band").agg(F.min(F.get("ids", F.lit(0))).alias("a"))
        tied = large.join(first, "band").select(F.col("a"), F.explode("ids").alias("b")).filter("a <> b")
        pairs = common.materialize(trees.union(tied).distinct(), "pairs")
        # rows of one doc_id are one document
        torn = known.groupBy("doc_id").agg(F.min("digest").alias("one"), F.max("digest").alias("last")).filter("one <> last").select("doc_id", "one")
        twice = known.select("doc_id", "digest").join(torn, "doc_id").filter("digest <> one").select("digest", "one").distinct()
        named = classes.select("id", "digest")
        same = twice.join(named, "digest").withColumnRenamed("id", "a").join(named.select(F.col("digest").alias("one"), F.col("id").alias("b")), "one").select("a", "b")
        links = common.materialize(_confirmed(pairs, classes, docs, shingle, num, den).union(same), "links")
        comp = components(links)

        state = rows.join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        state = common.materialize(state.join(signatures, "id"), "state")
        mixed = state.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("band")
        open_rows = common.materialize(state.join(common.materialize(mixed, "mixed"), "band"), "open")
        if open_rows.limit(1).count():
            hot = open_rows.filter("parts > 1")
            main = hot.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("m")).groupBy("band").agg(F.max_by("comp", F.struct("m", "comp")).alias("main"))
            others = large.select("band", F.col("blk").alias("to_blk"), F.xxhash64("band", "blk").alias("to_lid"))
            guests = hot.join(common.materialize(main, "main"), "band").filter("comp <> main").join(others, "band").filter("blk <> to_blk")
            compared = open_rows.select("lid", "mask", "id", "comp", "signature", F.lit(False).alias("guest")).unionByName(guests.select(F.col("to_lid").alias("lid"), "mask", "id", "comp", "signature", F.lit(True).alias("guest")))
            compared = common.materialize(compared, "compared")
            near = common.materialize(compared.repartition(n, "lid").sortWithinPartitions("lid", "id").mapInArrow(common.freeing(_near), "lid long, id long, near boolean"), "near")
            left = common.materialize(compared.join(near, ["lid", "id"]), "left")
            whole = _sets(left, classes, docs, shingle).join(_small(left, 256), "id")
            more = whole.repartition(n, "lid").sortWithinPartitions("lid", "id").mapInArrow(common.freeing(_across(num, den)), "a long, b long")
            comp = components(common.materialize(links.union(more).distinct(), "all-links"))

        placed = classes.select("id", "digest", "rep").join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        least = placed.groupBy("comp").agg(F.min("rep").alias("component_id"))
        groups = keep(common.materialize(placed.join(least, "comp").select("digest", "component_id"), "groups"))
    out = signed.select("doc_id", "n_shingles", "digest").join(groups, "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(component)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op3_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), shingle=4)


#: All pairs of documents that share a shingle, counted, and what is reachable over links: for small tables.
OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) < 4 THEN [array_to_string(w, ' ')][1:least(len(w), 1)] ELSE [array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)] END) AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS x FROM s),
k AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM k JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
r(id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT b, c FROM r JOIN sides ON id = a)
SELECT doc_id, n AS n_shingles, min(c) AS component_id, doc_id = min(c) AS kept FROM n JOIN r ON id = doc_id GROUP BY doc_id, n
"""
