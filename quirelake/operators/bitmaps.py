"""A bitmap index of facets: all facets' counts under some filters from one pass over it.

Records are numbered, 64 to a word. The index has a row (facet, value, word, bits) for every word in which
a value has a record, and nothing for the others, so a rare value takes a few rows and a frequent one a bit
a record. Filters become one aggregate by word: each ORs the bits of the values that it takes, and NOT takes
them from the word of all records. The words that pass the filters are then joined to the rows of the facets
by word, where AND and a count of bits give each value's number of records: under all filters, or for a
facet of its own choice under all but its own. These are whole-number operations in generated code, and no
list of record ids is ever made.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.catalog import Catalog
from .facets import ALIASES, FACETS, facet_rows

#: The facet that every record has.
EVERY = "record"


@dataclass(frozen=True)
class Choice:
    """The records with a value of a facet, or without any such: equal to one of ``values`` (in any case), or
    holding ``part``."""

    facet: str
    values: tuple[str, ...] = ()
    part: str | None = None
    negate: bool = False

    @property
    def name(self) -> str:
        return ALIASES.get(self.facet, self.facet)

    def takes(self) -> Column:
        value = F.lower("value")
        hit = value.isin([v.lower() for v in self.values]) if self.part is None else value.contains(self.part.lower())
        return (F.col("facet") == self.name) & hit


class FacetIndex:
    """The index under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.numbers = spark.read.schema("record_id long, number long").parquet(f"{path}/numbers")
        self.words = spark.read.schema("value string, word long, bits long, facet string").parquet(f"{path}/words")

    @classmethod
    def build(cls, cat: Catalog, path: str, facets: tuple[str, ...] = tuple(FACETS)) -> FacetIndex:
        spark = cat.records.sparkSession
        cat.records.select(F.col("id").alias("record_id")).distinct().orderBy("record_id").withColumn("number", F.monotonically_increasing_id()).write.parquet(f"{path}/numbers")
        numbers = spark.read.schema("record_id long, number long").parquet(f"{path}/numbers")
        parts = [facet_rows(cat, f).where("value is not null").select(F.lit(f).alias("facet"), F.col("value").cast("string").alias("value"), "record_id") for f in facets]
        rows = reduce(DataFrame.unionByName, parts, numbers.select(F.lit(EVERY).alias("facet"), F.lit("").alias("value"), "record_id")).join(numbers, "record_id")
        bit = F.expr("shiftleft(1L, cast(number % 64 as int))")
        words = rows.groupBy("facet", "value", F.expr("number div 64").alias("word")).agg(F.bit_or(bit).alias("bits"))
        words.repartition("facet", F.expr("word div 4096")).sortWithinPartitions("facet", "value", "word").write.partitionBy("facet").option("compression", "zstd").parquet(f"{path}/words")
        return cls(spark, path)

    def _passed(self, choices: list[Choice]) -> DataFrame:
        """(word, b0, b1, ...): of each word of records, those that each choice lets pass."""
        hit = reduce(lambda a, b: a | b, [c.takes() for c in choices], F.col("facet") == EVERY)
        every = F.coalesce(F.bit_or(F.when(F.col("facet") == EVERY, F.col("bits"))), F.lit(0))
        taken = [F.coalesce(F.bit_or(F.when(c.takes(), F.col("bits"))), F.lit(0)) for c in choices]
        read = self.words.where(F.col("facet").isin(EVERY, *{c.name for c in choices}) & hit)
        return read.groupBy("word").agg(every.alias("every"), *[(every.bitwiseAND(F.bitwise_not(t)) if c.negate else t).alias(f"b{i}") for i, (c, t) in enumerate(zip(choices, taken, strict=True))])

    def counts(self, choices: list[Choice], facets: tuple[str, ...], own: bool = False) -> DataFrame:
        """(facet, value, count): the values of facets with their numbers of records under the choices.

        Without ``own``, a facet's own choices don't count for it, as it is to show what else could be chosen.
        """
        names = [ALIASES.get(f, f) for f in facets]
        both = lambda cs: reduce(lambda a, b: a.bitwiseAND(b), [F.col(f"b{i}") for i in cs], F.col("every"))
        under = {f: both([i for i, c in enumerate(choices) if own or c.name != f]) for f in names}
        which = reduce(lambda w, f: w.when(F.col("facet") == f, under[f]), names[1:], F.when(F.col("facet") == names[0], under[names[0]]))
        rows = self.words.where(F.col("facet").isin(names)).join(self._passed(choices), "word")
        counts = rows.groupBy("facet", "value").agg(F.sum(F.bit_count(F.col("bits").bitwiseAND(which))).cast("long").alias("count"))
        return counts.where("count > 0")

    def ids(self, choices: list[Choice]) -> DataFrame:
        """(record_id) under all choices."""
        bits = reduce(lambda a, b: a.bitwiseAND(b), [F.col(f"b{i}") for i in range(len(choices))], F.col("every"))
        passed = self._passed(choices).select("word", bits.alias("bits")).where("bits != 0")
        numbers = passed.select("word", "bits", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i")).where("getbit(bits, i) = 1").select(F.expr("word * 64 + i").alias("number"))
        return self.numbers.join(numbers, "number").select("record_id")
