"""Shared storage for tables between jobs: where it is, who owns what is in it, and when that goes.

A folder belongs to the innermost `scope` in which it was named, and goes when that scope ends, unless it
is kept; outside of any scope, and if kept to the last, it goes when the Python process ends. A lost driver
leaves its folders under <checkpoint folder>/sparkloom.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}  # folders of local sessions without a checkpoint folder, by application
_Owned = list[tuple[str, Callable[[], None]]]
_last: _Owned = []  # what goes when the process ends
_open = threading.local()  # scopes of a thread


def _owner() -> _Owned:
    scopes = getattr(_open, "scopes", None)
    return scopes[-1] if scopes else _last


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. A local session without one gets a folder of this machine; a cluster without one is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors and the driver share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="sparkloom-")
        atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
    return f"file://{_local[app]}"


def _remover(spark: SparkSession, path: str) -> Callable[[], None]:
    def remove() -> None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)

    return remove


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder's path, owned by the innermost scope."""
    path = f"{shared_dir(spark)}/sparkloom/{name}-{uuid.uuid4().hex}"
    _owner().append((path, _remover(spark, path)))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and losing an executor loses nothing."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


@contextmanager
def scope() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Folders named inside go at the end, but those of materialized data frames that are handed to the function that this gives."""
    owned: _Owned = []
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._folder)
        return df

    if not hasattr(_open, "scopes"):
        _open.scopes = []
    _open.scopes.append(owned)
    try:
        yield keep
    finally:
        _open.scopes.pop()
        for path, remove in owned:
            if path in kept:
                _owner().append((path, remove))
            else:
                remove()


@atexit.register
def _clear() -> None:
    for _, remove in _last:
        try:
            remove()
        except Exception:  # the JVM may be gone first
            return
