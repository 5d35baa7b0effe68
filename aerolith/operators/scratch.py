"""Tables written to the cluster's shared folder, to cut lineage in loops."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_tables: dict[str, SparkSession] = {}
#: Paths written in the innermost :func:`settled` of this thread.
_mine: ContextVar[list | None] = ContextVar("_mine", default=None)
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock = threading.Lock()
_writing: dict[int, list] = {}


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Only a local master may do without: it gets a temporary folder, which all its tasks see."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="aerolith-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder; what is written there goes when the driver ends, or with the :func:`settled` around."""
    path = f"{shared_root(spark)}/aerolith-{uuid.uuid4().hex}"
    _tables[path] = spark
    if _mine.get() is not None:
        _mine.get().append(path)
    return path


@contextmanager
def _dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Drop the shuffle files of a write once it is done; the session's own setting is back when no thread writes any more."""
    key = id(spark._jsparkSession)
    with _lock:
        state = _writing.setdefault(key, [0, spark.conf.get(_CLEANUP, "false")])
        state[0] += 1
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            state[0] -= 1
            if not state[0]:
                spark.conf.set(_CLEANUP, _writing.pop(key)[1])


def written(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts lineage in a way that survives lost executors and keeps Parquet's column pruning.
    With its last column as ``by`` the files are parted by it, so that a filter on it reads only the rows it keeps.
    Empty tables keep their schema. The files go when the driver ends, or by :func:`release`.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    with _dropping_shuffles(spark):
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._aerolith_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables made by :func:`written` which nothing reads any more; others are left alone."""
    for df in tables:
        path = getattr(df, "_aerolith_path", None)
        if path in _tables:
            _delete(df.sparkSession, path)
            del _tables[path]


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """Write the result of ``make``, then delete every other table that this thread wrote on the way to it."""
    outer, mine = _mine.get(), []
    token = _mine.set(mine)
    try:
        out = written(make())
    finally:
        _mine.reset(token)
    for path in mine:
        if path != out._aerolith_path and path in _tables:
            _delete(_tables.pop(path), path)
    if outer is not None:
        outer.append(out._aerolith_path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for path, spark in _tables.items():
        try:
            _delete(spark, path)
        except Exception:  # the session has ended before us; its folder is the cluster's to clear
            return
