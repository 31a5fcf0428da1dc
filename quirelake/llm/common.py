"""What the training-data operators share: input tables, staged intermediates, words."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_dir, workers_import

#: The blanks that separate words: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The folders of the staging scope that is open.
_scope: ContextVar[list[str] | None] = ContextVar("quirelake_staging", default=None)


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, which belongs to the staging scope that is open, if any."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if (paths := _scope.get()) is not None:
        paths.append(path)
    return path


@contextmanager
def staging(spark: SparkSession):
    """Delete at the end, also after a failure, what the block stages itself.

    Scopes nest, and each owns only what is staged directly in it. What is staged outside of any scope
    stays until the shared folder is cleaned, as a lazy result may still read it: a caller that has
    written such a result puts both into a scope. Yields the paths, for an owner who lets go earlier.
    """
    paths: list[str] = []
    token = _scope.set(paths)
    try:
        yield paths
    finally:
        _scope.reset(token)
        release(spark, paths)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete these staged tables, which nothing reads any more."""
    conf = spark._jsc.hadoopConfiguration()
    while paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(conf).delete(path, True)


def staged(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again.

    This cuts the lineage with a copy that outlives any executor, keeps what it cost from being
    paid twice, and gives the planner true sizes, so that small sides are broadcast by size.
    """
    path = shared_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a staged side, of a few numbers each, that may go to every executor.
BROADCAST_ROWS = 1_000_000


def sized(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A staged table of a few numbers a row, marked for broadcast where it has at most ``most`` rows.

    Beyond that it is joined by a shuffle, as any other.
    """
    return F.broadcast(df) if df.count() <= most else df


#: Bytes of a batch that Python gets at once; a longer row is a batch of its own.
BATCH_BYTES = 8 << 20


def arrow_map(df: DataFrame, function, schema) -> DataFrame:
    """``df.mapInArrow`` in batches of bounded bytes, so that long texts do not fill a worker.

    A worker serves many tasks; what one has freed goes back to the system before the next.
    """

    def mapped(batches):
        yield from function(batches)
        give_back()

    workers_import()
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key) in ("67108864b", "-1"):  # Spark's defaults; a bound that the session has set stands
        conf.set(key, str(BATCH_BYTES))
    return df.mapInArrow(mapped, schema)


def give_back() -> None:
    """Return freed memory to the system, where its allocators can."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library only
    if trim is not None:
        trim(0)


def bind(value: Column, body) -> Column:
    """``body`` of ``value`` with the value computed once per row.

    An expression that a lambda body repeats is computed again for each element; bound as a lambda
    variable it is not.
    """
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The maximal runs of characters other than the six blanks, in order."""
    return F.filter(F.split(text, BLANK_RUN), lambda w: w != "")


def fold(parts: list[Column], op) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = op(out, p)
    return out
