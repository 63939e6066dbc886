"""Tables that cut lineage, kept in the folder that the cluster names in spark.checkpoint.dir.

A table written here survives the loss of any executor, since driver and
executors share the folder.  Machine-local folders are used only under a
local master with the setting unset, as in tests.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import sys
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
#: Tables that no scope has; and those of the present scope.
_WRITTEN: list[str] = []
_SCOPE: ContextVar[list[str]] = ContextVar("scope", default=_WRITTEN)
_BATCH, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
#: A row group of a table is in memory whole, several times over, where it is written and read. Unless told to look sooner,
#: Parquet first looks at its size after a hundred rows, which may be blocks of several MB each.
_ROW_GROUPS = {"parquet.block.size": 16 << 20}
_ROW_GROUPS |= {f"parquet.{of}.size.row.check.min": 1 for of in ("block", "page")}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def named(name: str) -> Column:
    """The column of just that name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def session(df: DataFrame) -> SparkSession:
    """The session of ``df``, with Arrow batches of 16 MB at most unless the session says otherwise.

    Spark's default of 64 MB is held several times over, by the executor and its Python workers.
    """
    spark = df.sparkSession
    if spark.conf.get(_BATCH) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH, "16m")
    return spark


def tidied(run: Callable, encodes: bool = False) -> Callable:
    """``run`` over batches, after which the worker gives the memory back that its allocators keep.

    Workers outlive their tasks and serve the next stage.  What they remember of
    the pieces of texts stays as long as they run stages that encode.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not encodes and (tokens := sys.modules.get("millrace.llm.tokens")):
            tokens.release()
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    """Give the memory back that the allocators of this process keep."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only in the GNU C library
        ctypes.CDLL(None).malloc_trim(0)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if base:
        return f"{base.rstrip('/')}/millrace"
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = folder = tempfile.mkdtemp(prefix="millrace-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return "file://" + _LOCAL[context.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    """The path of a table that is yet to be written to the shared folder."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _SCOPE.get().append(path)
    return path


_WRITING: dict[str, list] = {}
_LOCK = threading.Lock()


@contextlib.contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of writes are dropped as they end; the setting comes back after the last of writes side by side."""
    key = str(spark._jsparkSession.sessionUUID())
    with _LOCK:
        now = _WRITING.setdefault(key, [0, spark.conf.get(_CLEANUP, "false")])
        now[0] += 1
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _LOCK:
            now[0] -= 1
            if not now[0]:
                spark.conf.set(_CLEANUP, _WRITING.pop(key)[1])


def write(df: DataFrame, name: str, codec: str = "zstd", by: str | None = None) -> str:
    """Write ``df`` to a new table in the shared folder, in one folder for each value of ``by``; its path.

    Shuffle files of the write are dropped as soon as it ends.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with _cleaning(spark):
        out = df.write.option("compression", codec).options(**_ROW_GROUPS)
        (out.partitionBy(by) if by else out).parquet(path)
    return path


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so later steps never recompute it."""
    return df.sparkSession.read.schema(df.schema).parquet(write(df, name, codec))


def materialize_alone(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """As ``materialize`` of what ``make`` gives; the tables that it writes on the way are deleted once that is written."""
    path = new_path(spark, name)
    with scope(spark), _cleaning(spark):
        df = make()
        df.write.option("compression", "zstd").parquet(path)
        schema = df.schema
    return spark.read.schema(schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a table, or a folder of it, that no step needs any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables made inside, by this thread, are deleted at the end; results that read them must be written by then."""
    own: list[str] = []
    token = _SCOPE.set(own)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        for path in own:
            delete(spark, path)


def release(spark: SparkSession) -> None:
    """Delete every scratch table made outside a scope; results that still read them must be written first."""
    while _WRITTEN:
        delete(spark, _WRITTEN.pop())


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
