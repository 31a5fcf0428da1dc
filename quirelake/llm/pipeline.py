"""From raw documents to packed sequences: the training-data operators as one pipeline.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs. All but the last return the columns of ``documents``. An empty table
gives an empty result; null and repeated rows are treated as each operator defines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import near_dups, packing, pii, quality_classifier, quality_rules
from .common import release, shared_path, staging, table
from .queries import PII_KEY

#: Documents that score less are rejected.
LEAST_SCORE = 0.3
#: SQL cannot express the trained classifier, MinHash, keyed surrogates or tokenization.
ORACLE_SQL = None


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the subword quality classifier, trained on the labelled ones, accepts."""
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.score(docs, model, "_score").where(F.col("_score") >= LEAST_SCORE).drop("_score")


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the adaptive quality rules keep."""
    return quality_rules.filter_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dups.deduplicate(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with surrogates for personal data and secrets, and their lengths anew."""
    replaced = pii.replace(docs, PII_KEY)
    n_chars = F.when(F.col("n_replaced") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return replaced.withColumn("n_chars", n_chars).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", classify),
    ("quality_rules", apply_rules),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", replace_personal_data),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table ``documents``.

    What a stage has staged goes once its result is written, and a result goes once the next one is.
    The last stage's result reads its own staged pieces, which belong to the caller's scope.
    """
    docs = table(spark, sf_dir, "documents")
    before: list[str] = []
    try:
        for name, stage in STAGES[:-1]:
            with staging(spark) as own:
                result = stage(spark, docs, sf_dir)
                path = shared_path(spark, name)
                result.write.option("compression", "zstd").parquet(path)
                own.remove(path)
            release(spark, before)
            before.append(path)
            docs = spark.read.schema(result.schema).parquet(path)
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        release(spark, before)
