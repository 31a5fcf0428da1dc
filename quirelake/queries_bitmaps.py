"""Queries of the bitmap index of facets, and of facets counted batch by batch."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .operators.bitmaps import Choice, FacetIndex
from .registry import query
from .shared import shared_dir
from .sources.driver_tables import catalog, with_sql

CHOICES = [Choice("country", ("Asia", "europe")), Choice("language", ("lat",), negate=True), Choice("publisher", part="00000")]
_HELD = {
    "country": "exists (select 1 from imprints x where x.record_id = r.id and x.country_name in ('asia', 'europe'))", "language": "not exists (select 1 from languages x where x.record_id = r.id and x.code = 'lat')",
    "publisher": "exists (select 1 from imprints x where x.record_id = r.id and x.publisher_norm like '%00000%')",
}
_VALUES = {"country": ("imprints", "country_name"), "language": ("languages", "code"), "publisher": ("imprints", "publisher_norm"), "place": ("imprints", "place_norm"), "agent": ("agents", "agent_norm")}


def _index(spark, d):
    return FacetIndex.build(catalog(spark, d), f"{shared_dir(spark)}/bitmaps-{uuid.uuid4().hex}", tuple(_VALUES))


def _sql(own: bool) -> str:
    parts = []
    for facet, (table, column) in _VALUES.items():
        held = " and ".join(h for f, h in _HELD.items() if own or f != facet)
        parts.append(f"select '{facet}' as facet, {column} as value, count(distinct r.id) as count from records r join {table} t on t.record_id = r.id where {column} is not null and {held} group by 2")
    return with_sql("records", "imprints", "languages", "agents") + " union all ".join(parts)


query("bitmap_facets_except_own", _sql(False))(lambda spark, d: _index(spark, d).counts(CHOICES, tuple(_VALUES)))
query("bitmap_facets_under_filters", _sql(True))(lambda spark, d: _index(spark, d).counts(CHOICES, tuple(_VALUES), own=True))
query("bitmap_ids", with_sql("records", "imprints", "languages") + f"select id as record_id from records r where {' and '.join(_HELD.values())}")(lambda spark, d: _index(spark, d).ids(CHOICES))


def _incremental(spark, d):
    """Counts after four batches, a correction of the records in German and a removal of those in Italian."""
    from .operators import facets
    from .operators.facet_tables import FacetTables
    from .sources.catalog import Catalog

    cat = catalog(spark, d)

    def part(ids):
        of = {t: facets.within(getattr(cat, t), ids) for t in ("imprints", "agents", "languages", "titles", "subjects", "notes", "physical_descriptions") if getattr(cat, t) is not None}
        return Catalog(**cat.__dict__ | of | {"records": facets.within(cat.records, ids, "id")})

    def batch(i):  # records are dealt by their number, so their rows in other tables are told by it, without a join
        of = lambda t, key="record_id": t.where(F.pmod(F.xxhash64(key), F.lit(4)) == i)
        return Catalog(**cat.__dict__ | {t: of(getattr(cat, t)) for t in ("imprints", "agents", "languages")} | {"records": of(cat.records, "id")})

    has = lambda code: cat.languages.where(F.col("code") == code).select("record_id").distinct()
    tables = FacetTables.create(batch(0), f"{shared_dir(spark)}/facets-{uuid.uuid4().hex}", tuple(_VALUES), 16)
    for i in (1, 2, 3):
        tables = tables.put(batch(i))
    mended = part(has("ger"))
    mended.imprints = mended.imprints.withColumns({"place_norm": F.concat(F.lit("in "), "place_norm"), "date_start": F.col("date_start") + 1})
    return tables.put(mended).remove(has("ita"))


def _recount(facet: str, table: str, value: str, n: str = "count(distinct t.record_id)") -> str:
    return f"select '{facet}' as facet, cast({value} as varchar) as value, {n} as count from {table} t join left_over r on r.id = t.record_id where {value} is not null group by 2"


_GERMAN = "t.record_id in (select record_id from languages where code = 'ger')"
_PLACE, _START = f"case when {_GERMAN} then concat('in ', place_norm) else place_norm end", f"case when {_GERMAN} then date_start + 1 else date_start end"
_LEFT = with_sql("records", "imprints", "languages", "agents") + ", left_over as (select id from records where id not in (select record_id from languages where code = 'ita')) "
_BAND = "case when coalesce(publisher_confidence, 0) < 0.5 then '0.00-0.50' when publisher_confidence < 0.8 then '0.50-0.80' when publisher_confidence < 0.95 then '0.80-0.95' when publisher_confidence < 0.99 then '0.95-0.99' else '0.99-1.00' end"
_COUNTED = {f: (t, _PLACE if c == "place_norm" else c) for f, (t, c) in _VALUES.items()} | {"first_year": ("imprints", _START), "last_year": ("imprints", "date_end")}
query(
    "incremental_facets",
    _LEFT + " union all ".join([_recount(f, *tc) for f, tc in _COUNTED.items()] + [_recount("publisher_confidence_band", "imprints", _BAND, "count(*)"), "select 'record', '', count(*) from left_over"]),
)(lambda spark, d: _incremental(spark, d).counts())
query(
    "incremental_overview",
    _LEFT + ", c as (" + " union all ".join(_recount(f, *tc) for f, tc in _COUNTED.items()) + ") select (select count(*) from left_over) as records, " + ", ".join(f"count(*) filter (facet = '{f}') as {f}" for f in _VALUES)
    + ", min(case when facet in ('first_year') then cast(value as integer) end) as earliest, max(case when facet = 'last_year' then cast(value as integer) end) as latest from c",
)(lambda spark, d: _incremental(spark, d).compact().overview())
