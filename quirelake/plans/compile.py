"""Filters into DataFrames: predicates on the joined rows, matching ids, rows with evidence.

Every child table is joined once, whatever the number of filters on it, so that filters on one table
hold for the same row of it. Filters on titles and subjects by content, and on extents, ask whether
any row of the record matches. A comparison with a missing value is neither true nor false, also
under negation.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import ArrayType, DataType, StringType, StructType

from ..functions import text
from ..shared import workers_import
from ..sources.catalog import Catalog
from .filters import Filter, QueryPlan, clean_phrase, normal_value

#: The column of each field that compares strings, with the table it belongs to.
STRING_COLUMNS = {
    "publisher": ("imprints", "publisher_norm"), "imprint_place": ("imprints", "place_norm"), "country": ("imprints", "country_name"),
    "language": ("languages", "language_code"), "title": ("titles", "title_value"), "subject": ("subjects", "subject_value"),
    "agent": ("agents", "agent_raw"), "agent_norm": ("agents", "agent_norm"), "agent_role": ("agents", "role_norm"), "agent_type": ("agents", "agent_type"),
}
#: What each joined table adds to a row.
EVIDENCE = {
    "imprints": ["date_start", "date_end", "date_label", "date_confidence", "place_norm", "place_display", "place_confidence", "publisher_norm", "publisher_display", "publisher_confidence", "country_name", "source_tags"],
    "languages": ["language_code", "language_source"],
    "titles": ["title_value", "title_type", "title_source"],
    "subjects": ["subject_value", "subject_source"],
    "agents": ["agent_raw", "agent_norm", "agent_confidence", "agent_type", "role_norm", "role_confidence", "provenance"],
}


def _child(cat: Catalog, table: str) -> DataFrame:
    t = getattr(cat, table)
    renamed = {"languages": {"code": "language_code", "source": "language_source"}, "titles": {"value": "title_value", "source": "title_source"}, "subjects": {"value": "subject_value", "source": "subject_source"}}
    t = t.withColumnsRenamed(renamed.get(table, {}))
    if table == "agents" and "provenance" in t.columns:
        t = t.withColumn("provenance", told_sources(t.schema["provenance"].dataType))
    return t.select("record_id", *[c for c in EVIDENCE[table] if c in t.columns])


def told_sources(kind: DataType) -> Column:
    """An agent's provenance as strings: ``100[0]$a``, or tag and occurrence of entries that have these apart.

    Entries are strings, or structs with a ``source`` that is either.
    """
    item = kind.elementType if isinstance(kind, ArrayType) else None
    if not isinstance(item, StructType):
        return F.col("provenance")
    inner = item["source"].dataType if "source" in item.names else item
    if not isinstance(inner, StructType):
        return F.transform("provenance", lambda p: p["source"])

    def told(p: Column) -> Column:
        s = p["source"] if inner is not item else p
        at = F.coalesce(s["occurrence"].cast("string"), F.lit("0")) if "occurrence" in inner.names else F.lit("0")
        return F.concat(s["tag"], F.lit("["), at, F.lit("]"))

    return F.transform("provenance", told)


def _compare(column: Column, f: Filter) -> Column:
    """A string filter on its column."""
    values = [normal_value(f.field, v) for v in f.values]
    if f.op == "EQUALS":
        return column == values[0]
    if f.op == "CONTAINS":
        return column.contains(values[0])
    return column.isin(*values)


def normal_values(values: DataFrame, name: str) -> DataFrame:
    """(_v) of values(value): the distinct forms that the field's column holds."""
    workers_import()

    @F.pandas_udf(StringType())
    def normal(v: pd.Series) -> pd.Series:
        return v.map(lambda x: normal_value(name, x))

    return values.select(normal("value").alias("_v")).distinct()


def is_existence(f: Filter) -> bool:
    return f.field == "physical_desc" or (f.field in ("title", "subject") and f.op == "CONTAINS")


def existence(cat: Catalog, f: Filter, values: DataFrame | None = None) -> DataFrame:
    """The record ids (one column) that have a row which the filter matches."""
    if f.field == "physical_desc" and values is not None:
        return cat.physical_descriptions.join(normal_values(values, f.field), F.lower("value").contains(F.col("_v")), "left_semi").select("record_id").distinct()
    if f.field == "physical_desc":
        hit = reduce(lambda a, b: a | b, [F.lower("value").contains(v.strip().lower()) for v in f.values])
        return cat.physical_descriptions.where(hit).select("record_id").distinct()
    phrase = clean_phrase(f.value)
    if (index := cat.config.get("fulltext")) is not None:
        return index.records(f.field, phrase)
    if f.field == "title":
        return cat.titles.where(text.matches(F.col("value"), phrase)).select("record_id").distinct()
    both = F.concat_ws(" ", "value", "value_he") if "value_he" in cat.subjects.columns else F.col("value")
    return cat.subjects.where(text.matches(both, phrase)).select("record_id").distinct()


def alias_hits(cat: Catalog, f: Filter, values: DataFrame | None = None) -> DataFrame:
    """The record ids with an agent whose authority has an alias that the filter matches."""
    alias = F.replace(F.col("alias_form_lower"), F.lit(","), F.lit(""))
    matched = cat.agent_aliases.where(_compare(alias, f)) if values is None else cat.agent_aliases.join(normal_values(values, f.field), alias == F.col("_v"), "left_semi")
    named = matched.select(F.col("authority_id").alias("_a")).distinct()
    uris = cat.agent_authorities.join(named, F.col("id") == F.col("_a")).select("authority_uri").where("authority_uri is not null").distinct()
    return cat.agents.join(uris, "authority_uri", "left_semi").select("record_id").distinct()


def predicate(f: Filter) -> Column:
    """The row predicate of a filter that is not one of existence, over the joined columns."""
    if f.field == "year":
        overlap = lambda a, b: (F.col("date_end") >= a) & (F.col("date_start") <= b)
        if f.op == "RANGE":
            return overlap(f.start, f.end)
        return reduce(lambda a, b: a | b, [overlap(int(v), int(v)) for v in f.values])
    return _compare(compared(f), f)


def compared(f: Filter) -> Column:
    """What a string filter compares its values with."""
    column = F.col(STRING_COLUMNS[f.field][1])
    column = column if f.field == "language" else F.lower(column)
    return F.replace(column, F.lit(","), F.lit("")) if f.field == "agent_norm" else column


def joined(cat: Catalog, filters: list[Filter], values: dict[tuple[str, str], DataFrame] | None = None) -> tuple[DataFrame, list[str]]:
    """Records with the child tables that the filters need, filtered; and the tables' names.

    Existence is joined as a flag under negation and as a semi join without; the alias way of an
    agent filter is a flag beside the direct comparison. ``values`` has a table (value) for each
    ``$step_N`` and field of a filter that names one as its value; it is joined, of whatever size.
    """
    told = lambda f: (values or {}).get((f.value, f.field)) if isinstance(f.value, str) and f.op == "IN" else None
    df = cat.records.select(F.col("id").alias("record_id"), "mms_id")
    tables: list[str] = []
    for i, f in enumerate(filters):
        if is_existence(f):
            df = df.join(existence(cat, f, told(f)), "record_id", "left_anti" if f.negate else "left_semi")
            continue
        table = "imprints" if f.field == "year" else STRING_COLUMNS[f.field][0]
        if table not in tables:
            tables.append(table)
    for table in sorted(tables, key=list(EVIDENCE).index):
        df = df.join(_child(cat, table), "record_id", "inner" if table == "imprints" else "left")
    for i, f in enumerate(filters):
        if is_existence(f):
            continue
        if (t := told(f)) is None:
            keep = predicate(f)
        else:
            df = df.join(normal_values(t, f.field).withColumn(f"_told_{i}", F.lit(True)), compared(f) == F.col("_v"), "left").drop("_v")
            keep = F.when(compared(f).isNotNull(), F.coalesce(F.col(f"_told_{i}"), F.lit(False)))
        if f.field == "agent_norm" and cat.has_aliases:
            flag = f"_alias_{i}"
            df = df.join(alias_hits(cat, f, t).withColumn(flag, F.lit(True)), "record_id", "left")
            keep = keep | F.coalesce(F.col(flag), F.lit(False))
        df = df.where(~keep if f.negate else keep)
        df = df.drop(f"_alias_{i}", f"_told_{i}")
    return df, tables


def ids(cat: Catalog, plan: QueryPlan, least_confidence: dict[str, float] | None = None, values: dict[tuple[str, str], DataFrame] | None = None) -> DataFrame:
    """The matching records' mms_id, each once; confidence columns of the joined rows can have a least value."""
    df, _ = joined(cat, plan.filters, values)
    for column, least in (least_confidence or {}).items():
        df = df.where(F.col(column) >= least)
    df = df.select("mms_id").distinct()
    return df.orderBy("mms_id").limit(plan.limit) if plan.limit else df


def _marc(c: str, default: str) -> Column:
    return F.coalesce(F.get(F.col(c), F.lit(0)), F.lit(default))


def evidence(f: Filter, columns: list[str]) -> Column:
    """struct<field, value, operator, matched_against, source, confidence> of a filter on a row."""

    def item(name: str, value: Column, operator: str, source: Column, confidence: str | None = None, against: str | None = None) -> Column:
        told = against if against is not None else ", ".join(f.values)
        conf = F.col(confidence).cast("double") if confidence and confidence in columns else F.lit(None).cast("double")
        return F.struct(F.lit(name).alias("field"), value.cast("string").alias("value"), F.lit(operator).alias("operator"), F.lit(told).alias("matched_against"), source.alias("source"), conf.alias("confidence"))

    have = lambda c, default: _marc(c, default) if c in columns else F.lit(default)
    tagged = lambda path, c, default="unknown": F.concat(F.lit(f"db.{path} (marc:"), have(c, default), F.lit(")"))
    equal = "=" if f.op == "EQUALS" else "LIKE"
    match f.field:
        case "publisher":
            return item("publisher_norm", F.col("publisher_norm"), equal, tagged("imprints.publisher_norm", "source_tags"), "publisher_confidence")
        case "imprint_place":
            return item("place_norm", F.col("place_norm"), equal, tagged("imprints.place_norm", "source_tags"), "place_confidence")
        case "year":
            span = F.when((F.col("date_start") != 0) & (F.col("date_end") != 0), F.concat_ws("-", "date_start", "date_end"))
            told = f"{f.start}-{f.end}" if f.op == "RANGE" else ", ".join(f.values)
            return item("date_range", span, "OVERLAPS", tagged("imprints.date_start/date_end", "source_tags"), "date_confidence", told)
        case "language":
            return item("language_code", F.col("language_code"), "=" if f.op == "EQUALS" else "IN", tagged("languages.code", "language_source"))
        case "title":
            return item("title_value", F.col("title_value") if "title_value" in columns else F.lit(None), "MATCH", F.lit("db.titles.value (full text)"))
        case "subject":
            value = F.coalesce("subject_value", F.lit(f.values[0])) if "subject_value" in columns else F.lit(f.values[0])
            return item("subject_value", value, "MATCH", F.lit("db.subjects (full text)"))
        case "agent":
            return item("agent_value", F.col("agent_raw"), "LIKE", tagged("agents.agent_raw", "provenance", "100|700"), "agent_confidence")
        case "agent_norm":
            return item("agent_norm", F.col("agent_norm"), equal, tagged("agents.agent_norm", "provenance"), "agent_confidence")
        case "agent_role":
            return item("role_norm", F.col("role_norm"), "=", tagged("agents.role_norm", "provenance"), "role_confidence")
        case "agent_type":
            return item("agent_type", F.col("agent_type"), "=", tagged("agents.agent_type", "provenance"))
    return item(f.field, F.lit("unknown"), "unknown", F.lit("unknown"))


def rationale(filters: list[Filter]) -> Column:
    """A line that tells why a row matched."""
    parts = []
    for f in filters:
        shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
        match f.field:
            case "publisher":
                parts.append(F.concat(F.lit("publisher_norm='"), shown("publisher_norm"), F.lit("'")))
            case "imprint_place":
                parts.append(F.concat(F.lit("place_norm='"), shown("place_norm"), F.lit("'")))
            case "year":
                parts.append(F.concat(F.lit("year_range="), shown("date_start"), F.lit("-"), shown("date_end"), F.lit(f" overlaps {f.start}-{f.end}")))
            case "language":
                parts.append(F.concat(F.lit("language="), shown("language_code")))
            case "title" | "subject":
                parts.append(F.lit(f"{f.field} matches '{f.value}'"))
            case "agent":
                parts.append(F.concat(F.lit("agent='"), shown("agent_raw"), F.lit("'")))
            case "agent_norm" | "agent_type":
                parts.append(F.concat(F.lit(f"{f.field}='"), shown(f.field), F.lit("'")))
            case "agent_role":
                parts.append(F.concat(F.lit("role_norm='"), shown("role_norm"), F.lit("'")))
    return F.concat_ws(" AND ", *parts) if parts else F.lit("matched")


def rows(cat: Catalog, plan: QueryPlan) -> DataFrame:
    """A row per record and distinct matching child row, with ``evidence`` and ``rationale``.

    A limit counts rows, as the total of rows does.
    """
    df, tables = joined(cat, plan.filters)
    have = [c for t in tables for c in EVIDENCE[t] if c in df.columns]
    df = df.select("mms_id", *have).distinct()
    told = F.array(*[evidence(f, have) for f in plan.filters]) if plan.filters else F.array()
    df = df.withColumns({"evidence": told, "rationale": rationale(plan.filters)})
    return df.orderBy("mms_id", *[c for c in have if dict(df.dtypes)[c] != "map"]).limit(plan.limit) if plan.limit else df
