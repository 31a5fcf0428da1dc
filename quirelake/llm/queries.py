"""The thin queries ``opN_<name>``: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, fingerprints, histogram_packing, lattice, near_dups, packing, pii, quality_classifier, quality_rules, url_reputation, warc, whitening
from .common import staged, table

URL_RULES = [url_reputation.Rule("block", "com", "en/"), url_reputation.Rule("allow", "example.com", "en/7"), url_reputation.Rule("allow", "net", "de/"), url_reputation.Rule("block", "example.net", "de/8"), url_reputation.Rule("block", "org", "es/")]


def op4_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_reputation.judge(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "labelled")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = staged(quality_rules.measures(table(spark, sf_dir, "documents"), ["doc_id", "lang", "source"]), "measures")
    return quality_rules.judge(measured).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"), min(buckets, 20000))


def held_out(of: int, at: int):
    """Whether a document's id leaves the remainder ``at`` of its crc32 by ``of``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % of == at


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"), "quality", ~held_out(5, 0))
    scored = quality_classifier.score(docs, model)
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


#: The surrogates' key. A deployment passes a secret of its own.
PII_KEY = b"a key for tests, not a secret one"


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op8_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lattice.score(table(spark, sf_dir, "documents"), ~held_out(7, 2))
    return scored.withColumn("held_out", held_out(7, 2)).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.group(table(spark, sf_dir, "documents"), k=4)


def op11_histogram_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_packing.pack_documents(table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
