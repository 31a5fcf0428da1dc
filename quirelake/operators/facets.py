"""Facets, counts and comparisons of a catalogue or a set of its records (``scope``: record ids)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..shared import tasks
from ..sources.catalog import Catalog

#: Each facet's table.
FACETS = {"publisher": "imprints", "place": "imprints", "country": "imprints", "language": "languages", "date_decade": "imprints", "date_century": "imprints", "subject": "subjects", "agent": "agents", "agent_role": "agents"}


def facet_value(name: str) -> tuple[Column, Column | None]:
    """A facet's value, and which rows of its table count (None: all)."""
    plain = {"publisher": "publisher_norm", "place": "place_norm", "country": "country_name"}
    match name:
        case "publisher" | "place" | "country":
            c = F.col(plain[name])
            return c, c.isNotNull() & (c != "")
        case "date_decade":
            return text.decade_label(F.col("date_start")), F.col("date_start").isNotNull()
        case "date_century":
            return text.century_label(F.col("date_start")), F.col("date_start").isNotNull()
        case "agent_role":
            return F.concat(F.col("agent_norm"), F.lit(" ("), F.col("role_norm"), F.lit(")")), F.col("role_norm").isNotNull()
        case "language":
            return F.col("code"), None
        case "subject":
            return F.col("value"), None
    return F.col("agent_norm"), None


#: Other names that plans use.
ALIASES = {"city": "place", "imprint_place": "place", "decade": "date_decade", "century": "date_decade", "date": "date_decade", "author": "agent", "printer": "agent", "topic": "subject"}
LATEST = 2100


def within(df: DataFrame, scope: DataFrame | None, key: str = "record_id") -> DataFrame:
    """The rows of ``df`` whose record is in scope(record_id)."""
    if scope is None:
        return df
    return df.join(scope.select(F.col("record_id").alias("_scope")), F.col(key) == F.col("_scope"), "left_semi")


def facet_rows(cat: Catalog, name: str, scope: DataFrame | None = None, guard: bool = False) -> DataFrame:
    """(value, record_id) of a facet."""
    name = ALIASES.get(name, name)
    value, keep = facet_value(name)
    df = within(getattr(cat, FACETS[name]), scope)
    df = df.where(keep) if keep is not None else df
    if guard and name.startswith("date_"):
        df = df.where(F.col("date_start") <= LATEST)
    return df.select(value.alias("value"), "record_id")


def facet(cat: Catalog, name: str, limit: int | None = None, scope: DataFrame | None = None, guard: bool = False) -> DataFrame:
    """(value, count) by the number of records; decades in their own order. ``guard`` drops dates after 2100."""
    out = facet_rows(cat, name, scope, guard).groupBy("value").agg(F.count_distinct("record_id").alias("count"))
    order = [F.asc_nulls_last("value")] if ALIASES.get(name, name) == "date_decade" else [F.desc("count"), F.asc_nulls_last("value")]
    return out.orderBy(*order).limit(limit) if limit else out


def facet_totals(cat: Catalog, name: str, limit: int, scope: DataFrame | None = None) -> DataFrame:
    """One row: distinct_values, truncated, total_records of a facet cut at ``limit``."""
    rows = facet_rows(cat, name, scope).where("value is not null")
    total = within(cat.records, scope, "id").agg(F.count("*").alias("total_records"))
    distinct = rows.agg(F.count_distinct("value").alias("distinct_values"))
    return distinct.crossJoin(F.broadcast(total)).select("distinct_values", (F.col("distinct_values") > limit).alias("truncated"), "total_records")  # one row each


def scalars(cat: Catalog, scope: DataFrame | None = None, publisher: str | None = None, place: str | None = None, country: str | None = None) -> DataFrame:
    """One row: earliest and latest year, and how many records have the values asked for."""
    im = within(cat.imprints, scope)
    same = lambda c, v: F.count_distinct(F.when(F.lower(c) == F.lit((v or "").lower()), F.col("record_id")))
    return im.agg(F.min("date_start").alias("earliest"), F.max("date_end").alias("latest"), same("publisher_norm", publisher).alias("count_publisher"), same("place_norm", place).alias("count_place"), same("country_name", country).alias("count_country"))


def compare(cat: Catalog, name: str, values: list[str], scope: DataFrame | None = None) -> DataFrame:
    """(value, count) for each value asked for, also those that no record has."""
    spark = cat.records.sparkSession
    asked = spark.createDataFrame([(v.lower(),) for v in dict.fromkeys(values)], "value string")
    hits = facet_rows(cat, name, scope).select(F.lower("value").alias("value"), "record_id").where(F.col("value").isin([v.lower() for v in values]))
    counts = hits.groupBy("value").agg(F.count_distinct("record_id").alias("count"))
    return asked.join(counts, "value", "left").select("value", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def members(cat: Catalog, name: str, values: list[str], scope: DataFrame | None = None) -> DataFrame:
    """(group, record_id): which records each compared value has."""
    return facet_rows(cat, name, scope).select(F.lower("value").alias("group"), "record_id").where(F.col("group").isin([v.lower() for v in values])).distinct()


def compare_dates(cat: Catalog, groups: DataFrame) -> DataFrame:
    """(group, count, earliest, latest)."""
    years = cat.imprints.groupBy("record_id").agg(F.min("date_start").alias("lo"), F.max("date_end").alias("hi"))
    return groups.join(years, "record_id", "left").groupBy("group").agg(F.count("*").alias("count"), F.min("lo").alias("earliest"), F.max("hi").alias("latest"))


def compare_facet(cat: Catalog, groups: DataFrame, name: str, top: int | None = None) -> DataFrame:
    """(group, value, count), the ``top`` values of each group."""
    from pyspark.sql import Window

    hits = facet_rows(cat, name).where("value is not null").join(groups, "record_id").groupBy("group", "value").agg(F.count_distinct("record_id").alias("count"))
    if top is None:
        return hits
    w = Window.partitionBy("group").orderBy(F.desc("count"), "value")
    return hits.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= top).drop("_n")


def compare_shared(cat: Catalog, groups: DataFrame, name: str, n_groups: int) -> DataFrame:
    """(value): what all compared groups have."""
    hits = facet_rows(cat, name).where("value is not null").join(groups, "record_id")
    return hits.groupBy("value").agg(F.count_distinct("group").alias("n")).where(F.col("n") == n_groups).select("value")


def overview(cat: Catalog) -> DataFrame:
    """One row: totals, and the span of years up to 2100."""
    one = lambda t, *aggs: t.agg(*aggs)
    parts = [
        one(cat.records, F.count("*").alias("records")),
        one(cat.imprints, F.count_distinct("publisher_norm").alias("publishers"), F.count_distinct("place_norm").alias("places"), F.min(F.when(F.col("date_start") <= LATEST, F.col("date_start"))).alias("earliest"), F.max(F.when(F.col("date_end") <= LATEST, F.col("date_end"))).alias("latest")),
        one(cat.agents, F.count_distinct("agent_norm").alias("agents")),
        one(cat.subjects, F.count_distinct("value").alias("subjects")),
        one(cat.languages, F.count_distinct("code").alias("languages")),
    ]
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)  # one row each


def overview_centuries(cat: Catalog) -> DataFrame:
    """(century, count) with the spoken endings."""
    dated = cat.imprints.where(F.col("date_start").isNotNull() & (F.col("date_start") <= LATEST))
    return dated.groupBy(text.century_label(F.col("date_start"), spoken=True).alias("century")).agg(F.count_distinct("record_id").alias("count"))


def histogram(cat: Catalog, name: str) -> DataFrame:
    """(value, decade, count): a facet by decades.

    Both sides are distinct and dealt by their record alike, so what meets is counted as it is.
    """
    n = tasks(cat.records)
    dealt = lambda df: df.repartition(n, "record_id").distinct()
    years = dealt(cat.imprints.where("date_start is not null").select("record_id", text.decade(F.col("date_start")).alias("decade")))
    return dealt(facet_rows(cat, name).where("value is not null")).join(years, "record_id").groupBy("value", "decade").agg(F.count("*").alias("count"))


def peak_decade(cat: Catalog, name: str) -> DataFrame:
    """(value, total, peak): the decade with most records, the earliest of equals."""
    h = histogram(cat, name)
    return h.groupBy("value").agg(F.sum("count").alias("total"), F.max_by("decade", F.struct("count", -F.col("decade"))).alias("peak"))


def refine(cat: Catalog, scope: DataFrame, name: str, op: str, value: str | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """scope(record_id) narrowed by one condition; a combination that is not known leaves it as it is.

    Years are held against the start only. Text is compared literally.
    """
    v = (value or "").strip().lower()
    column = {"publisher": ("imprints", "publisher_norm"), "imprint_place": ("imprints", "place_norm"), "place": ("imprints", "place_norm"), "agent": ("agents", "agent_norm"), "agent_norm": ("agents", "agent_norm"), "language": ("languages", "code"), "country": ("imprints", "country_name"), "subject": ("subjects", "value")}
    allowed = {"language": ("EQUALS",), "country": ("EQUALS",), "subject": ("CONTAINS",)}
    if name == "year" and op == "RANGE":
        hit = cat.imprints.where(F.col("date_start").between(start, end))
    elif name in column and op in allowed.get(name, ("EQUALS", "CONTAINS")):
        table, c = column[name]
        hit = getattr(cat, table).where(F.lower(c) == v if op == "EQUALS" else F.lower(c).contains(v))
    else:
        return scope
    return scope.join(hit.select(F.col("record_id").alias("_hit")), F.col("record_id") == F.col("_hit"), "left_semi")


def all_ids(cat: Catalog, filters: list[dict]) -> DataFrame:
    """(record_id) that meets every condition, each by any row of its own."""
    scope = cat.records.select(F.col("id").alias("record_id"))
    for f in filters:
        scope = refine(cat, scope, f["field"], f.get("op", "EQUALS"), f.get("value"), f.get("start"), f.get("end"))
    return scope


def subject_hints(cat: Catalog, limit: int = 100) -> DataFrame:
    """(value, count): the headings that occur most often, each occurrence counted."""
    return cat.subjects.where("value is not null").groupBy("value").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "value").limit(limit)


def methods(df: DataFrame, method: str) -> DataFrame:
    """(method, count, percentage) with the missing method as NULL."""
    total = df.agg(F.count("*").alias("_t"))
    out = df.groupBy(F.coalesce(F.col(method), F.lit("NULL")).alias("method")).agg(F.count("*").alias("count"))
    return out.crossJoin(F.broadcast(total)).select("method", "count", F.round(100.0 * F.col("count") / F.col("_t"), 2).alias("percentage"))  # one row


#: Bands of confidence: label, from, up to (the last includes its end).
BANDS = [("0.00-0.50", 0.0, 0.5), ("0.50-0.80", 0.5, 0.8), ("0.80-0.95", 0.8, 0.95), ("0.95-0.99", 0.95, 0.99), ("0.99-1.00", 0.99, 1.0)]


def band(confidence: str) -> Column:
    """The band of a confidence; a missing one is in the first."""
    c, label = F.coalesce(F.col(confidence), F.lit(0.0)), F.lit(BANDS[-1][0])
    for name, _, high in reversed(BANDS[:-1]):
        label = F.when(c < high, name).otherwise(label)
    return label


def bands(df: DataFrame, confidence: str) -> DataFrame:
    """(band, count) of all bands."""
    counts = df.groupBy(band(confidence).alias("band")).agg(F.count("*").alias("count"))
    every = df.sparkSession.createDataFrame([(b[0],) for b in BANDS], "band string")
    return every.join(counts, "band", "left").select("band", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def flagged(df: DataFrame, raw: str, norm: str, confidence: str, method: str, below: float = 0.8, limit: int = 100) -> DataFrame:
    """(raw, norm, confidence, method, frequency): the raw values with least confidence, most frequent first."""
    low = df.where(F.col(raw).isNotNull() & (F.coalesce(F.col(confidence), F.lit(0.0)) < below))
    out = low.groupBy(F.col(raw).alias("raw")).agg(F.min(norm).alias("norm"), F.min(confidence).alias("confidence"), F.min(method).alias("method"), F.count("*").alias("frequency"))
    return out.orderBy(F.desc("frequency"), "raw").limit(limit)


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, total, filled, missing) of columns."""
    counts = df.agg(F.count("*").alias("_t"), *[F.count(c).alias(c) for c in columns])
    told = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("n")) for c in columns])).alias("c")
    return counts.select("_t", told).select("c.field", F.col("_t").alias("total"), F.col("c.n").alias("filled"), (F.col("_t") - F.col("c.n")).alias("missing"))
