"""Tables that are changed by key: rows put, taken out or corrected, as versions that readers keep.

A table's rows are dealt by the hash of their key into buckets, each a folder of Parquet files. A change
reads and writes only the buckets that its keys fall into, as new folders, and then a manifest with the next
number, which says what folder each bucket is. A version is there once its manifest is whole, so a change
that fails leaves the last one as it was, readers of an earlier version are not disturbed, and of two
changes at once the second fails and can be tried again.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import MOST_RECORDS, kept, setting


class VersionedTable:
    """The table under ``path``, as a version (the last one by default) has it."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.version = self.versions()[-1] if version is None else version
        if self.version not in self.versions():
            raise ValueError(f"no version {self.version}")
        told = json.loads(spark.read.text(f"{self.path}/manifest/v{self.version}").first()[0])
        self.key, self.buckets, self.folders = told["key"], told["buckets"], {int(b): f for b, f in told["folders"].items()}
        self.schema, self.note = T.StructType.fromJson(told["schema"]), told.get("note", {})

    def versions(self) -> list[int]:
        """The versions whose manifest is whole."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        there = [s.getPath() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        whole = [p.getName() for p in there if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(m[1]) for n in whole if (m := re.fullmatch(r"v(\d+)", n)))

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: list[str], buckets: int = 64, note: dict | None = None, wide: bool = False) -> VersionedTable:
        """A new table; ``rows`` has each key once. A note is what the manifest says of the version besides."""
        new = cls.__new__(cls)
        new.spark, new.path, new.version, new.key, new.buckets, new.folders, new.schema, new.note = rows.sparkSession, path.rstrip("/"), 0, key, buckets, {}, rows.schema, {}
        return new._commit(rows, dict.fromkeys(range(buckets), -(-rows.count() // buckets)), note, wide)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def read(self, only: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        paths = sorted({f for b, f in self.folders.items() if only is None or b in only})
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{p}" for p in paths))

    def get(self, *key) -> DataFrame:
        """The row of a key, from its bucket alone."""
        one = self.spark.createDataFrame([key], T.StructType([self.schema[k] for k in self.key]))
        return self.read(self._touched(one)).join(one, self.key, "left_semi")

    def _touched(self, rows: DataFrame) -> dict[int, int]:
        """The buckets of some rows, with how many fall into each."""
        return dict(sorted(tuple(r) for r in rows.groupBy(self._bucket()).count().collect()))  # the number of buckets at most

    def _commit(self, rows: DataFrame | None, touched: dict[int, int], note: dict | None = None, wide: bool = False) -> VersionedTable:
        """A version with the rows of some buckets written anew; the large ones by several tasks, a file each.

        ``wide`` rows are written as they come, without a shuffle or sort: each task has a file open for each of
        its buckets.
        """
        name, folders = uuid.uuid4().hex, dict(self.folders)
        if touched:
            dealt = rows.select(*self.schema.names).withColumn("_bucket", self._bucket())
            if wide:
                with setting(self.spark, "spark.sql.maxConcurrentOutputFileWriters", len(touched)):
                    dealt.write.partitionBy("_bucket").option("compression", "zstd").parquet(f"{self.path}/{name}")
            else:
                n = sum(touched.values()) + (self.read(list(touched)).count() if self.folders else 0)
                shares = max(1, -(-n // (len(touched) * MOST_RECORDS)))
                dealt.repartition(len(touched) * shares, "_bucket", F.pmod(F.xxhash64(F.lit(0), *self.key), F.lit(shares))).write.partitionBy("_bucket").parquet(f"{self.path}/{name}")
            filled = {r[0] for r in self.spark.read.parquet(f"{self.path}/{name}").select("_bucket").distinct().collect()} if self._any(name) else set()
            for b in touched:
                folders.pop(b, None)
                if b in filled:
                    folders[b] = f"{name}/_bucket={b}"
        told = json.dumps({"key": self.key, "buckets": self.buckets, "folders": folders, "schema": json.loads(self.schema.json()), "note": self.note if note is None else note})
        self.spark.createDataFrame([(told,)], "value string").coalesce(1).write.text(f"{self.path}/manifest/v{self.version + 1}")
        return VersionedTable(self.spark, self.path, self.version + 1)

    def _any(self, name: str) -> bool:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return any(s.isDirectory() and s.getPath().getName().startswith("_bucket=") for s in folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(folder))

    def annotate(self, note: dict) -> VersionedTable:
        """The same rows as a version with another note."""
        return self._commit(None, {}, note)

    def held(self, keys: DataFrame) -> DataFrame:
        """The rows of these keys, from their buckets alone."""
        return self.read(self._touched(keys)).join(keys.select(*self.key), self.key, "left_semi")

    def split(self, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The rows of these keys (each once), and the other rows of their buckets, from one join that is stored.

        ``put`` and ``remove`` take the others as ``rest``, so that wide rows meet their keys once.
        """
        both = kept(self.read(self._touched(keys)).join(keys.select(*self.key, F.lit(True).alias("_hit")), self.key, "left"), "split")
        return both.where("_hit").select(*self.schema.names), both.where("_hit is null").select(*self.schema.names)

    def put(self, rows: DataFrame, note: dict | None = None, wide: bool = False, rest: DataFrame | None = None) -> VersionedTable:
        """The table with rows (each key once) added, or in the place of those with their key."""
        touched = self._touched(rows)
        if rest is None:
            rest = self.read(touched).join(rows.select(*self.key), self.key, "left_anti")
        return self._commit(rest.select(*self.schema.names).unionByName(rows.select(*self.schema.names)), touched, note, wide)

    def remove(self, keys: DataFrame, note: dict | None = None, wide: bool = False, rest: DataFrame | None = None) -> VersionedTable:
        """The table without the rows of these keys."""
        touched = self._touched(keys)
        if rest is None:
            rest = self.read(touched).join(keys.select(*self.key), self.key, "left_anti")
        return self._commit(rest, touched, note, wide)

    def correct(self, hit: Column, values: dict[str, Column]) -> VersionedTable:
        """The table with columns other than the key set anew where ``hit`` holds; only buckets with such rows change."""
        if set(values) & set(self.key):
            raise ValueError("a key is not corrected; take it out and put another")
        touched = self._touched(self.read().where(hit))
        hit = F.coalesce(hit, F.lit(False))
        return self._commit(self.read(touched).withColumns({c: F.when(hit, v.cast(self.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()}), touched)
