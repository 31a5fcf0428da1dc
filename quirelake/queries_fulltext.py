"""Queries of the stored full-text index."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .operators import fulltext
from .plans import compile as compiler
from .plans.filters import Filter, QueryPlan
from .queries_catalog import _folded, _marked
from .registry import query
from .shared import kept, shared_dir
from .sources.driver_tables import catalog, with_sql

#: Postings in a bucket here, so that the given tables have several.
BUCKET_ROWS = 100_000


def _indexed(spark, d, only):
    """The catalogue with marked texts and an index of a field, written anew."""
    cat = catalog(spark, d)
    table = f"{only}s"
    setattr(cat, table, getattr(cat, table).withColumn("value", _marked(F.col("value"))))
    return fulltext.with_index(cat, fulltext.build(cat, f"{shared_dir(spark)}/fulltext-{uuid.uuid4().hex}", only, BUCKET_ROWS))


def _sought(name, field, filters, *conditions):
    where = " and ".join(f"{'not ' if c.startswith('not ') else ''}exists (select 1 from {field}s c where c.record_id = records.id and {_folded} {c.removeprefix('not ')})" for c in conditions)
    query(name, with_sql("records", f"{field}s") + f"select distinct mms_id from records where {where}")(lambda spark, d: compiler.ids(_indexed(spark, d, field), QueryPlan(filters)))


_sought("index_title_phrase", "title", [Filter("title", "CONTAINS", "Rệd wïdgét")], "like '% red widget %'")
_sought("index_title_prefix", "title", [Filter("title", "CONTAINS", "ring Οδ*"), Filter("title", "CONTAINS", "s*")], "like '% ring οδ%'", "like '% s%'")
_sought("index_subject_phrase", "subject", [Filter("subject", "CONTAINS", "ecónomy brand 17")], "like '% economy brand 17 %'")
_sought("index_subject_not_phrase", "subject", [Filter("subject", "CONTAINS", "economy", negate=True)], "not like '% economy %'")


@query("index_all_terms", with_sql("subjects") + f"select distinct record_id from subjects where {_folded} like '% economy %' and {_folded} like '% widget %' and {_folded} like '% 1%'")
def index_all_terms(spark, d):
    """Terms in any order, one of them a prefix."""
    return _indexed(spark, d, "subject").config["fulltext"].records("subject", "widget 1* Economy", phrase=False)


def _tokens(field: str) -> str:
    n = f"cast(sum(len(string_split(trim({_folded}), ' '))) as bigint)"
    return f"select '{field}' as field, count(*) as texts, count(*) as indexed, {n} as tokens, {n} as postings, cast(0 as bigint) as differing from {field}s"


@query("index_parity", with_sql("titles", "subjects") + f"{_tokens('title')} union all {_tokens('subject')}")
def index_parity(spark, d):
    """An index of all titles and subjects, every text of which is put together again."""
    cat = catalog(spark, d)
    for t in ("titles", "subjects"):
        setattr(cat, t, getattr(cat, t).withColumn("value", _marked(F.col("value"))))
    rows = kept(fulltext.texts(cat), "texts")  # the index is made of what it is held against
    return fulltext.FullText(spark, f"{shared_dir(spark)}/fulltext-{uuid.uuid4().hex}").change(rows, bucket_rows=BUCKET_ROWS).parity(rows)


_CHANGED = "case when record_id % 3 = 0 then 'a new sword ' || value else value end"


@query("index_after_changes", with_sql("titles") + f"select record_id, count(*) as rows from (select record_id, value, {_CHANGED} as now from titles where record_id % 5 <> 1) where ' ' || lower(now) || ' ' like '% red %' or now like 'a new sword %' group by 1")
def index_after_changes(spark, d):
    """Titles changed, then others taken out, then all segments made one: what is found is what is there."""
    rows = fulltext.texts(catalog(spark, d), "title")
    index = fulltext.FullText(spark, f"{shared_dir(spark)}/fulltext-{uuid.uuid4().hex}").change(rows, bucket_rows=BUCKET_ROWS)
    third = rows.where("record_id % 3 = 0")
    index = index.change(third.withColumn("text", F.concat(F.lit("a new sword "), "text")), gone=third, bucket_rows=BUCKET_ROWS)
    index = index.change(gone=rows.where("record_id % 5 = 1")).compact(BUCKET_ROWS)
    return index.rows("title", "red").union(index.rows("title", "new sword")).distinct().groupBy("record_id").agg(F.count("*").alias("rows"))
