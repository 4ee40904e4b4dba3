"""Session settings, shared storage and sampling used by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import fresh_path, materialize, scope, shared_dir  # noqa: F401


#: Bounds of one Arrow batch, in rows and bytes; texts can be very long.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(2 << 20)}


def tune(spark: SparkSession) -> None:
    """BATCHES for this session, where it has no setting of its own: results are lazy, so that the setting must outlast the call."""
    own = spark.conf.getAll
    for key, value in BATCHES.items():
        if key not in own:
            spark.conf.set(key, value)


def freeing(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """step, after which its worker gives unused memory back: workers are kept between tasks and stages, beside a heap of their executor's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from step(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
            if trim:
                trim(0)

    return run


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), value being evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sample(rows: DataFrame, n: int, total: int) -> list:
    """Of rows (doc_id, others) at most n, one for each doc_id (the least of its others): those with the smallest hash of it.

    total is about how many rows there are: from it follows a bound on the hash under which some 4 n are looked at. Where that
    leaves too few ids, because rows repeat theirs, the bound goes up until there are n or none is left out. Null ids are not taken.
    """
    rows = rows.filter("doc_id IS NOT NULL")
    at = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 62))
    share = 4 * n / max(total, 1)
    while True:
        part = rows if share >= 0.5 else rows.filter(at < F.lit(int(share * (1 << 62))))
        others = [c for c in rows.columns if c != "doc_id"]
        got = part.groupBy("doc_id").agg(F.min(F.struct(*others)).alias("_v")).select("doc_id", "_v.*").orderBy(at, "doc_id").limit(n).collect()
        if len(got) == n or share >= 0.5:
            return got
        share *= 8
