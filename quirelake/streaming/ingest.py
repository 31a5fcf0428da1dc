"""New record files as a stream: normalized like a batch, and appended to the catalogue's tables.

The catalogue has no event time, so there is nothing to watermark; files are the unit, each is taken
once, and a batch that is run again replaces what it wrote before. The first record to name an identifier
stays: the stream keeps the identifiers in its state store, from which a batch looks up its own only, so
that its cost does not grow with what came before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import marc


def follow_json(spark: SparkSession, path: str, schema, files_a_batch: int = 100) -> DataFrame:
    """A stream of nested records from JSON lines that arrive under ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).json(path)


#: The state store that keeps identifiers on disk, and only writes what a batch adds.
ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def append_tables(records: DataFrame, target: str, checkpoint: str, countries: dict[str, str] | None = None, available_now: bool = True) -> StreamingQuery:
    """Normalize each batch of records and write its tables under ``target``, by batch.

    The checkpoint knows what ``target`` has, so a target that was written without it is refused.
    """
    spark = records.sparkSession
    if _exists(spark, f"{target}/records.parquet") and not _exists(spark, f"{checkpoint}/commits"):
        raise ValueError(f"{target} was written with another checkpoint")

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()  # of a batch's files, whose number is bounded
        try:
            tables = marc.flatten(marc.normalized(kept), countries)
            for name in sorted(tables, key=lambda t: t == "records"):
                tables[name].write.mode("overwrite").parquet(f"{target}/{name}.parquet/batch={number}")
        finally:
            kept.unpersist()

    before = {k: spark.conf.get(k, None) for k in ON_DISK}
    for k, v in ON_DISK.items():
        spark.conf.set(k, v)
    try:  # a query takes the settings as they are when it starts
        writer = records.dropDuplicates(["mms_id"]).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
