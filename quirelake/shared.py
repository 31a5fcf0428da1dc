"""What the driver and all executors have in common: a folder, and this package."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Only a local session without that setting gets a temporary folder; a cluster without it is an
    error, since its machines would each write to a disk of their own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="quirelake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def workers_import() -> None:
    """Let Python workers import this package from where the driver has it.

    A worker's search path is the environment's, which need not hold what the driver put on its own.
    """
    context, root = SparkContext._active_spark_context, str(Path(__file__).resolve().parents[1])
    paths = [p for p in context.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        context.environment["PYTHONPATH"] = os.pathsep.join([root, *paths])


#: Records whose rows one task takes: at least so many where the session has tasks to spare, at most so many.
FEW_RECORDS, MOST_RECORDS = 10_000, 100_000


def tasks(records: DataFrame, rows: int = 1) -> int:
    """How many tasks the rows of ``records`` are dealt to: those of the session, or more, so that none grows with the input.

    ``rows`` tells how many times more rows there are than where each record has some ten.
    """
    n = records.count() * rows
    return max(-(-n // MOST_RECORDS), min(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // FEW_RECORDS)), 1)


@contextmanager
def setting(spark: SparkSession, key: str, value: object):
    """The session with a setting, which afterwards is what it was."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(value))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def kept(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again.

    It is computed once, outlives executors, keeps numbers that its rows were given, and has a true size
    for the planner. The folder is the session's, to be cleaned with it.
    """
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
