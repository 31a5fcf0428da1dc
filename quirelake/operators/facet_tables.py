"""Facet counts that are kept up to date batch by batch, without a recount.

What each record counts for is held in a table changed by key, as an array of (facet, value, n). A batch of
new or corrected records reads only the buckets that its records fall into, and leaves a small table of
signed sums: what the records counted for before with a minus, what they count for now with a plus. Such
sums merge by addition, so a facet's counts are the sum over the batches' tables, in any order, and
``compact`` makes one of them. The list of these tables is a part of the version's manifest, so members and
counts change at one moment: after a failed batch the last version is whole, and trying again counts
nothing twice.

Records count once for each value, rows once each for a band of confidence. Missing values don't count.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import kept, tasks
from ..sources.catalog import Catalog
from ..sources.versioned import VersionedTable
from .facets import ALIASES, FACETS, LATEST, band, facet_value

#: What every catalogue has besides its facets: its records, the years that its imprints begin and end in.
EVERY, FIRST, LAST, BANDS = "record", "first_year", "last_year", "publisher_confidence_band"
_DELTA = "value string, n long, facet string"


def members(cat: Catalog, facets: tuple[str, ...] = tuple(FACETS)) -> DataFrame:
    """(record_id, counts): each record once, with the facets' values that it counts for."""
    told: dict[str, list] = {"imprints": [(FIRST, F.col("date_start"), None), (LAST, F.col("date_end"), None)]}
    if "publisher_confidence" in cat.imprints.columns:
        told["imprints"].append((BANDS, band("publisher_confidence"), None))
    for f in facets:
        told.setdefault(FACETS[ALIASES.get(f, f)], []).append((f, *facet_value(ALIASES.get(f, f))))
    parts, names = [], [EVERY]
    for table, values in told.items():  # one pass over each table, whose rows are moved whole
        each = [(v if keep is None else F.when(keep, v)).cast("string") for _, v, keep in values]
        parts.append(getattr(cat, table).select("record_id", F.lit(len(names)).alias("first"), F.array(*each).alias("values")))
        names += [f for f, _, _ in values]
    parts.append(cat.records.select(F.col("id").alias("record_id"), F.lit(0).alias("first"), F.array(F.lit("")).alias("values")))
    moved = reduce(DataFrame.unionByName, parts).where("record_id is not null").repartition(tasks(cat.records), "record_id")
    facet = F.array(*map(F.lit, names))[F.col("first") + F.col("at")].alias("facet")
    rows = moved.select("record_id", "first", F.posexplode("values").alias("at", "value")).where("value is not null").select("record_id", facet, "value")
    n = F.when(F.col("facet") == BANDS, F.count("*")).otherwise(F.lit(1)).cast("long")
    one = rows.groupBy("record_id", "facet", "value").agg(n.alias("n"))
    return one.groupBy("record_id").agg(F.sort_array(F.collect_list(F.struct("facet", "value", "n"))).alias("counts")).where(F.exists("counts", lambda c: c["facet"] == EVERY))


def _signed(rows: DataFrame, sign: int) -> DataFrame:
    return rows.select(F.explode("counts").alias("c")).select("c.facet", "c.value", (F.col("c.n") * sign).alias("n"))


def _merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy("facet", "value").agg(F.sum("n").alias("n")).where("n != 0")


class FacetTables:
    """The counts under ``path``, as a version (the last one by default) has them."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.table = VersionedTable(spark, f"{self.path}/members", version)
        self.deltas, self.facets = self.table.note["deltas"], tuple(self.table.note["facets"])

    @classmethod
    def create(cls, cat: Catalog, path: str, facets: tuple[str, ...] = tuple(FACETS), buckets: int = 64) -> FacetTables:
        """Counts of a first batch of records."""
        spark, path, new = cat.records.sparkSession, path.rstrip("/"), kept(members(cat, facets), "members")
        delta = cls._write(_merged(_signed(new, 1)), path)
        VersionedTable.create(new, f"{path}/members", ["record_id"], buckets, {"deltas": [delta], "facets": list(facets)}, wide=True)
        return cls(spark, path)

    @staticmethod
    def _write(sums: DataFrame, path: str) -> str:
        name = uuid.uuid4().hex
        sums.repartition("facet", "value").sortWithinPartitions("facet", "value").write.partitionBy("facet").option("compression", "zstd").parquet(f"{path}/deltas/{name}")
        return name

    def _note(self, *deltas: str, keep: bool = True) -> dict:
        return {"deltas": [*(self.deltas if keep else []), *deltas], "facets": list(self.facets)}

    def put(self, cat: Catalog) -> FacetTables:
        """The counts with the records of ``cat``, whole, added or in the place of those with their id."""
        new = kept(members(cat, self.facets), "members")
        held, rest = self.table.split(new)
        delta = self._write(_merged(_signed(held, -1).unionByName(_signed(new, 1))), self.path)
        self.table.put(new, self._note(delta), wide=True, rest=rest)
        return FacetTables(self.spark, self.path)

    def remove(self, ids: DataFrame) -> FacetTables:
        """The counts without the records of ids(record_id); ids that are not there change nothing."""
        gone = kept(ids.select(F.col("record_id").cast(self.table.schema["record_id"].dataType).alias("record_id")).distinct(), "gone")
        held, rest = self.table.split(gone)
        delta = self._write(_merged(_signed(held, -1)), self.path)
        self.table.remove(gone, self._note(delta), wide=True, rest=rest)
        return FacetTables(self.spark, self.path)

    def compact(self) -> FacetTables:
        """The same counts as one table of sums; earlier versions keep theirs."""
        self.table.annotate(self._note(self._write(_merged(self._sums()), self.path), keep=False))
        return FacetTables(self.spark, self.path)

    def _sums(self) -> DataFrame:
        paths = [f"{self.path}/deltas/{d}" for d in self.deltas]
        return reduce(DataFrame.unionByName, [self.spark.read.schema(_DELTA).parquet(p) for p in paths])

    def counts(self, *facets: str) -> DataFrame:
        """(facet, value, count) of some facets, or of all; only their folders are read."""
        names, rows = [ALIASES.get(f, f) for f in facets], self._sums()
        if names:
            rows = rows.where(F.col("facet").isin(names))
        return _merged(rows).select("facet", "value", F.col("n").alias("count"))

    def overview(self) -> DataFrame:
        """One row: the records, the distinct values of each facet, earliest and latest year up to 2100."""
        year = F.when(F.col("facet").isin(FIRST, LAST), F.col("value").cast("int"))
        dated = lambda f: F.when((F.col("facet") == f) & (year <= LATEST), year)
        n = [F.count_if(F.col("facet") == f).alias(f) for f in self.facets]
        return self.counts().agg(F.coalesce(F.max(F.when(F.col("facet") == EVERY, F.col("count"))), F.lit(0)).alias("records"), *n, F.min(dated(FIRST)).alias("earliest"), F.max(dated(LAST)).alias("latest"))
