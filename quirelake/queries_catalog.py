"""Queries of filters, evidence, display, facets, comparison, samples and plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import display, enrichment, facets, resolve
from .plans import compile as compiler
from .plans.filters import Filter, QueryPlan
from .plans.steps import Executor, Step
from .registry import query
from .sources.driver_tables import catalog, with_sql

PRINTER = "supplier 000000003"
R = "select distinct mms_id from records join imprints i on i.record_id = records.id"


def _ids(name: str, filters: list[Filter], tables: tuple[str, ...], sql: str) -> None:
    query(name, with_sql(*tables) + sql)(lambda spark, d: compiler.ids(catalog(spark, d), QueryPlan(filters)))


_im = ("records", "imprints")
_ids("golden_publisher_year", [Filter("publisher", "EQUALS", "Supplier 000000003"), Filter("year", "RANGE", start=1597, end=1598)], _im, f"{R} where publisher_norm = '{PRINTER}' and date_end >= 1597 and date_start <= 1598")
_ids("filter_publisher_in", [Filter("publisher", "IN", ["[Supplier 000000003],", "SUPPLIER 000000008"])], _im, f"{R} where publisher_norm in ('supplier 000000003', 'supplier 000000008')")
_ids("filter_publisher_contains", [Filter("publisher", "CONTAINS", "00000001")], _im, f"{R} where publisher_norm like '%00000001%'")
_ids("filter_place_contains", [Filter("imprint_place", "CONTAINS", "NATION_")], _im, f"{R} where place_norm like '%nation\\_%' escape '\\'")
_ids("filter_place_in", [Filter("imprint_place", "IN", ["Nation_1", "[NATION_7]"])], _im, f"{R} where place_norm in ('nation_1', 'nation_7')")
_ids("filter_place_not", [Filter("imprint_place", "EQUALS", "nation_1", negate=True)], _im, f"{R} where not (place_norm = 'nation_1')")
_ids("filter_country_eq", [Filter("country", "EQUALS", "Africa")], _im, f"{R} where country_name = 'africa'")
_ids("filter_country_in", [Filter("country", "IN", ["Asia", "Europe"])], _im, f"{R} where country_name in ('asia', 'europe')")
_ids("filter_year_overlap", [Filter("year", "RANGE", start=1599, end=1600)], _im, f"{R} where date_end >= 1599 and date_start <= 1600")
_ids("filter_year_in", [Filter("year", "IN", ["1596", "1600"])], _im, f"{R} where (date_end >= 1596 and date_start <= 1596) or (date_end >= 1600 and date_start <= 1600)")
_ids("filter_year_not", [Filter("year", "RANGE", start=1596, end=1600, negate=True)], _im, f"{R} where not (date_end >= 1596 and date_start <= 1600)")
_la = ("records", "languages")
L = "select distinct mms_id from records left join languages l on l.record_id = records.id"
_ids("filter_language_eq", [Filter("language", "EQUALS", "HEB")], _la, f"{L} where code = 'heb'")
_ids("filter_language_in", [Filter("language", "IN", ["lat", "ger"])], _la, f"{L} where code in ('lat', 'ger')")
_ids("filter_language_contains", [Filter("language", "CONTAINS", "e")], _la, f"{L} where code like '%e%'")
_ids("filter_language_not", [Filter("language", "EQUALS", "eng", negate=True)], _la, f"{L} where not (code = 'eng')")
_ti = ("records", "titles")
T = "select distinct mms_id from records left join titles t on t.record_id = records.id"
EX = "select distinct mms_id from records where {} (select 1 from {} c where c.record_id = records.id and ({}))"
_ids("filter_title_eq", [Filter("title", "EQUALS", "Red Widget")], _ti, f"{T} where lower(value) = 'red widget'")
_ids("filter_title_in", [Filter("title", "IN", ["red widget", "small ring"])], _ti, f"{T} where lower(value) in ('red widget', 'small ring')")
#: Titles and headings as catalogues have them: marks in letters, after letters, other scripts and points.
_MARKED = "case record_id % 4 when 0 then replace(value, 'e', 'e' || chr(769)) when 1 then replace(value, 'e', 'ệ') when 2 then replace(replace(value, 'i', 'ï'), 's', 'ș') else concat(value, ' ΟΔΌΣ שָׁלוֹם') end"


def _marked(c):
    k = F.col("record_id") % 4
    return F.when(k == 0, F.replace(c, F.lit("e"), F.lit("e\u0301"))).when(k == 1, F.replace(c, F.lit("e"), F.lit("ệ"))).when(k == 2, F.replace(F.replace(c, F.lit("i"), F.lit("ï")), F.lit("s"), F.lit("ș"))).otherwise(F.concat(c, F.lit(" ΟΔΌΣ שָׁלוֹם")))


_folded = f"' ' || trim(regexp_replace(strip_accents(lower({_MARKED})), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' '"


def _text(name: str, table: str, filters: list[Filter], *conditions: str) -> None:
    """A full-text query over the marked texts; each condition is on their folded form."""
    where = " and ".join(f"{'not ' if c.startswith('not ') else ''}exists (select 1 from {table} c where c.record_id = records.id and {_folded} {c.removeprefix('not ')})" for c in conditions)

    def run(spark, d):
        cat = catalog(spark, d)
        setattr(cat, table, getattr(cat, table).withColumn("value", _marked(F.col("value"))))
        return compiler.ids(cat, QueryPlan(filters))

    query(name, with_sql("records", table) + f"select distinct mms_id from records where {where}")(run)


_text("filter_title_phrase", "titles", [Filter("title", "CONTAINS", "Réd wi*"), Filter("title", "CONTAINS", "widget")], "like '% red wi%'", "like '% widget %'")
_text("filter_title_scripts", "titles", [Filter("title", "CONTAINS", "widget οδος שלום")], "like '% widget οδοσ שלום %'")
_text("filter_title_marked_word", "titles", [Filter("title", "CONTAINS", "Rệd"), Filter("title", "CONTAINS", "wïdge\u0301t")], "like '% red %'", "like '% widget %'")
_su = ("records", "subjects")
S = "select distinct mms_id from records left join subjects s on s.record_id = records.id"
_ids("filter_subject_eq", [Filter("subject", "EQUALS", "ECONOMY -- Brand#2 -- small ring")], _su, f"{S} where lower(value) = 'economy -- brand#2 -- small ring'")
_text("filter_subject_phrase", "subjects", [Filter("subject", "CONTAINS", "ecónomy brand 17")], "like '% economy brand 17 %'")
_text("filter_subject_not_phrase", "subjects", [Filter("subject", "CONTAINS", "economy", negate=True)], "not like '% economy %'")
_pd = ("records", "physical_descriptions")
_ids("filter_physical_contains", [Filter("physical_desc", "CONTAINS", "ill. ; 11 cm")], _pd, EX.format("exists", "physical_descriptions", "lower(value) like '%ill. ; 11 cm%'"))
_ids("filter_physical_any_of", [Filter("physical_desc", "IN", ["10 cm", "21 cm"])], _pd, EX.format("exists", "physical_descriptions", "lower(value) like '%10 cm%' or lower(value) like '%21 cm%'"))
_ag = ("records", "agents")
AG = "select distinct mms_id from records left join agents a on a.record_id = records.id"
_al = (*_ag, "agent_authorities", "agent_aliases")
_alias = "exists (select 1 from agent_aliases al join agent_authorities aa on aa.id = al.authority_id join agents a2 on a2.authority_uri = aa.authority_uri where a2.record_id = records.id and replace(al.alias_form_lower, ',', '') {})"
_ids("filter_agent_alias_or", [Filter("agent_norm", "EQUALS", "Press, No 3")], _al, f"{AG} where replace(agent_norm, ',', '') = 'press no 3' or {_alias.format(chr(61) + ' ' + repr('press no 3'))}")
_ids("filter_agent_contains", [Filter("agent_norm", "CONTAINS", "house of nation_1")], _al, f"{AG} where replace(agent_norm, ',', '') like '%house of nation\\_1%' escape '\\' or {_alias.format('like ' + repr('%house of nation_1%'))}")
_ids("filter_agent_in", [Filter("agent_norm", "IN", ["supplier#000000005", "press no 6"])], _al, f"{AG} where replace(agent_norm, ',', '') in ('supplier#000000005', 'press no 6') or {_alias.format('in (' + repr('supplier#000000005') + ', ' + repr('press no 6') + ')')}")
_ids("filter_agent_not", [Filter("agent_norm", "EQUALS", "supplier#000000005", negate=True)], _al, f"{AG} where not (replace(agent_norm, ',', '') = 'supplier#000000005' or {_alias.format('= ' + repr('supplier#000000005'))})")
_ids("filter_agent_raw", [Filter("agent", "CONTAINS", "customer#00000001")], _ag, f"{AG} where lower(agent_raw) like '%customer#00000001%'")
_ids("filter_agent_role_not", [Filter("agent_role", "EQUALS", "printer", negate=True)], _ag, f"{AG} where not (role_norm = 'printer')")
_ids("filter_agent_type", [Filter("agent_type", "IN", ["meeting"])], _ag, f"{AG} where agent_type in ('meeting')")
_ids("filter_agent_role_same_row", [Filter("agent_role", "EQUALS", "printer"), Filter("agent_norm", "CONTAINS", "supplier#000000007"), Filter("agent_type", "EQUALS", "corporate")], _al, f"{AG} where role_norm = 'printer' and agent_type = 'corporate' and (replace(agent_norm, ',', '') like '%supplier#000000007%' or {_alias.format('like ' + repr('%supplier#000000007%'))})")
_ids("filter_triple_and", [Filter("publisher", "CONTAINS", "supplier 0"), Filter("imprint_place", "EQUALS", "nation_2"), Filter("year", "RANGE", start=1596, end=1597), Filter("language", "EQUALS", "heb")], (*_im, "languages"), "select distinct mms_id from records join imprints i on i.record_id = records.id left join languages l on l.record_id = records.id where publisher_norm like '%supplier 0%' and place_norm = 'nation_2' and date_end >= 1596 and date_start <= 1597 and code = 'heb'")

@query("rows_with_evidence", with_sql(*_im) + f"""select distinct mms_id, date_start, date_end, publisher_norm, publisher_confidence as confidence, 'date_range' as field,
    concat(cast(date_start as varchar), '-', cast(date_end as varchar)) as value,
    concat('publisher_norm=''', publisher_norm, ''' AND year_range=', cast(date_start as varchar), '-', cast(date_end as varchar), ' overlaps 1597-1598') as rationale
    from records join imprints i on i.record_id = records.id where publisher_norm like '%supplier%' and date_end >= 1597 and date_start <= 1598""")
def rows_with_evidence(spark, d):
    plan = QueryPlan([Filter("publisher", "CONTAINS", "Supplier"), Filter("year", "RANGE", start=1597, end=1598)])
    df = compiler.rows(catalog(spark, d), plan)
    return df.select("mms_id", "date_start", "date_end", "publisher_norm", F.col("evidence")[0]["confidence"].alias("confidence"), F.col("evidence")[1]["field"].alias("field"), F.col("evidence")[1]["value"].alias("value"), "rationale").distinct()


@query("refine_chain", with_sql("records", "imprints", "languages", "subjects") + """select id as record_id from records where
    exists (select 1 from imprints i where i.record_id = id and date_start between 1596 and 1599) and exists (select 1 from languages l where l.record_id = id and code = 'lat')
    and exists (select 1 from subjects s where s.record_id = id and lower(value) like '%economy%') and exists (select 1 from imprints i where i.record_id = id and country_name = 'asia')""")
def refine_chain(spark, d):
    cat = catalog(spark, d)
    return facets.all_ids(cat, [{"field": "year", "op": "RANGE", "start": 1596, "end": 1599}, {"field": "language", "value": "lat"}, {"field": "subject", "op": "CONTAINS", "value": "economy"}, {"field": "country", "value": "ASIA"}])


@query("display_info", with_sql("records", "imprints", "agents", "titles", "notes") + """select r.mms_id, t.title, a.author, i.date_start, i.place_norm, i.publisher, n.description from records r
    left join (select record_id, min(agent_raw) as author from agents where role_norm = 'author' group by 1) a on a.record_id = r.id
    left join (select record_id, date_start, place_norm, publisher_raw as publisher, row_number() over (partition by record_id order by occurrence, part, publisher_norm) as n from imprints) i on i.record_id = r.id and i.n = 1
    left join (select record_id, min(value) as title from titles group by 1) t on t.record_id = r.id
    left join (select record_id, value as description, row_number() over (partition by record_id order by case tag when '520' then 1 else 2 end) as n from notes) n on n.record_id = r.id and n.n = 1""")
def display_info(spark, d):
    cat = catalog(spark, d)
    cat.imprints = cat.imprints.withColumn("id", F.struct("part", "publisher_norm"))
    cat.titles = cat.titles.withColumn("id", F.col("value"))
    return display.display(cat).select("mms_id", "title", "author", "date_start", "place_norm", "publisher", "description")


@query("grounding_top30", with_sql("records", "imprints", "agents", "subjects") + """, f as (select id, mms_id from records where exists (select 1 from imprints i where i.record_id = id and place_norm = 'nation_3') order by mms_id limit 30)
    select f.mms_id, (select string_agg(distinct agent_norm, '; ' order by agent_norm) from agents a where a.record_id = f.id) as agents, (select count(distinct value) from subjects s where s.record_id = f.id) as n_subjects,
    concat('https://catalogue.example/', f.mms_id) as url from f""")
def grounding_top30(spark, d):
    cat = catalog(spark, d)
    scope = cat.imprints.where("place_norm = 'nation_3'").select("record_id").distinct()
    g = display.grounding(cat, scope, 30, "https://catalogue.example/")
    return g.select("mms_id", F.array_join("agents", "; ").alias("agents"), F.size("subjects").cast("long").alias("n_subjects"), "url")


_century = "concat(cast((date_start - 1) // 100 + 1 as varchar), 'th century')"
_FACETS = {
    "publisher": ("imprints", "publisher_norm", "publisher_norm <> ''"), "place": ("imprints", "place_norm", "place_norm <> ''"), "country": ("imprints", "country_name", "country_name <> ''"),
    "language": ("languages", "code", "true"), "date_decade": ("imprints", "concat(cast(date_start // 10 * 10 as varchar), 's')", "date_start is not null"), "date_century": ("imprints", _century, "date_start is not null"),
    "subject": ("subjects", "value", "true"), "agent": ("agents", "agent_norm", "true"), "agent_role": ("agents", "concat(agent_norm, ' (', role_norm, ')')", "role_norm is not null"),
}
for _name, (_t, _v, _w) in _FACETS.items():
    _order = "value" if _name == "date_decade" else "count desc, value"
    query(f"facet_{_name}", with_sql(_t) + f"select {_v} as value, count(distinct record_id) as count from {_t} where {_w} group by 1 order by {_order} limit 20")(lambda spark, d, n=_name: facets.facet(catalog(spark, d), n, 20))

_scope = "record_id in (select record_id from imprints where country_name = 'asia')"
query("facet_scoped", with_sql("imprints", "agents") + f"select agent_norm as value, count(distinct record_id) as count from agents where {_scope} group by 1 order by count desc, value limit 15")(lambda spark, d: facets.facet(c := catalog(spark, d), "author", 15, c.imprints.where("country_name = 'asia'").select("record_id").distinct()))
query("facet_guarded", with_sql("imprints") + f"select {_century} as value, count(distinct record_id) as count from imprints where date_start <= 2100 group by 1")(lambda spark, d: facets.facet(catalog(spark, d), "date_century", guard=True))
query("facet_distinct_truncated", with_sql("records", "imprints") + "select (select count(distinct publisher_norm) from imprints where publisher_norm <> '') as distinct_values, (select count(distinct publisher_norm) from imprints where publisher_norm <> '') > 10 as truncated, (select count(*) from records) as total_records")(lambda spark, d: facets.facet_totals(catalog(spark, d), "publisher", 10))
query("scalar_counts", with_sql("imprints") + f"select min(date_start) as earliest, max(date_end) as latest, count(distinct case when publisher_norm = '{PRINTER}' then record_id end) as count_publisher, count(distinct case when place_norm = 'nation_1' then record_id end) as count_place, count(distinct case when country_name = 'asia' then record_id end) as count_country from imprints")(lambda spark, d: facets.scalars(catalog(spark, d), None, PRINTER, "Nation_1", "ASIA"))
query("compare_values", with_sql("imprints") + "select v as value, count(distinct record_id) as count from (values ('nation_1'), ('nation_2'), ('nowhere')) x(v) left join imprints on place_norm = v group by 1")(lambda spark, d: facets.compare(catalog(spark, d), "place", ["NATION_1", "nation_2", "Nowhere"]))
_G = ", g as (select distinct place_norm as \"group\", record_id from imprints where place_norm in ('nation_1', 'nation_2')) "


def _groups(spark, d):
    cat = catalog(spark, d)
    return cat, facets.members(cat, "place", ["nation_1", "nation_2"])


query("compare_enhanced_dates", with_sql("imprints") + _G + 'select "group", count(distinct g.record_id) as count, min(date_start) as earliest, max(date_end) as latest from g left join imprints i on i.record_id = g.record_id group by 1')(lambda spark, d: facets.compare_dates(*_groups(spark, d)))
query("compare_enhanced_languages", with_sql("imprints", "languages") + _G + 'select "group", code as value, count(distinct g.record_id) as count from g join languages l on l.record_id = g.record_id group by 1, 2')(lambda spark, d: facets.compare_facet(*_groups(spark, d), "language"))
query("compare_enhanced_top_agents", with_sql("imprints", "agents") + _G + 'select "group", value, count from (select "group", agent_norm as value, count(distinct g.record_id) as count, row_number() over (partition by "group" order by count(distinct g.record_id) desc, agent_norm) as n from g join agents a on a.record_id = g.record_id group by 1, 2) where n <= 5')(lambda spark, d: facets.compare_facet(*_groups(spark, d), "agent", 5))
query("compare_enhanced_shared_agents", with_sql("imprints", "agents") + _G + 'select agent_norm as value from g join agents a on a.record_id = g.record_id group by 1 having count(distinct "group") = 2')(lambda spark, d: facets.compare_shared(*_groups(spark, d), "agent", 2))
query("compare_enhanced_shared_subjects", with_sql("imprints", "subjects") + _G + 'select value from g join subjects s on s.record_id = g.record_id group by 1 having count(distinct "group") = 2')(lambda spark, d: facets.compare_shared(*_groups(spark, d), "subject", 2))
query("overview_totals", with_sql("records", "imprints", "agents", "subjects", "languages") + "select (select count(*) from records) as records, (select count(distinct publisher_norm) from imprints) as publishers, (select count(distinct place_norm) from imprints) as places, (select min(date_start) from imprints where date_start <= 2100) as earliest, (select max(date_end) from imprints where date_end <= 2100) as latest, (select count(distinct agent_norm) from agents) as agents, (select count(distinct value) from subjects) as subjects, (select count(distinct code) from languages) as languages")(lambda spark, d: facets.overview(catalog(spark, d)))
query("overview_centuries", with_sql("imprints") + f"select {_century} as century, count(distinct record_id) as count from imprints where date_start <= 2100 group by 1")(lambda spark, d: facets.overview_centuries(catalog(spark, d)))
query("place_decade_hist", with_sql("imprints") + "select a.place_norm as value, b.d as decade, count(distinct a.record_id) as count from imprints a join (select distinct record_id, date_start // 10 * 10 as d from imprints where date_start is not null) b on b.record_id = a.record_id group by 1, 2")(lambda spark, d: facets.histogram(catalog(spark, d), "place"))
query("subject_peak_decade", with_sql("imprints", "subjects") + ", h as (select s.value, b.d, count(distinct s.record_id) as n from subjects s join (select distinct record_id, date_start // 10 * 10 as d from imprints where date_start is not null) b on b.record_id = s.record_id group by 1, 2) select value, cast(sum(n) as bigint) as total, cast(arg_max(d, n * 100000 - d) as integer) as peak from h group by 1")(lambda spark, d: facets.peak_decade(catalog(spark, d), "subject"))

_E = "select user_id, event_type, k, 1500 + k as birth from enrichment"


def _events(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_type", F.from_json("props", "k int")["k"].alias("k"))


query("json_century", with_sql("enrichment") + "select k // 10 + 1 as value, count(distinct user_id) as count from enrichment group by 1")(lambda spark, d: _events(spark, d).groupBy((F.floor(F.col("k") / 10) + 1).cast("int").alias("value")).agg(F.count_distinct("user_id").alias("count")))
query("json_membership", with_sql("enrichment") + "select user_id, count(*) as n from enrichment where k in (3, 5, 8) group by 1")(lambda spark, d: _events(spark, d).withColumn("all", F.array(F.lit(3), F.lit(5), F.lit(8))).where(F.expr("array_contains(all, k)")).groupBy("user_id").agg(F.count("*").alias("n")))


@query("facet_except_own", with_sql("enrichment") + "select 'type' as facet, event_type as value, count(distinct user_id) as count from enrichment where k >= 20 and k < 40 group by 2 union all select 'century', cast(k // 20 + 1 as varchar), count(distinct user_id) from enrichment where event_type = 'click' group by 2")
def facet_except_own(spark, d):
    e = _events(spark, d)
    of_type = e.where("k >= 20 and k < 40").groupBy(F.lit("type").alias("facet"), F.col("event_type").alias("value")).agg(F.count_distinct("user_id").alias("count"))
    of_century = e.where("event_type = 'click'").groupBy(F.lit("century").alias("facet"), (F.floor(F.col("k") / 20) + 1).cast("string").alias("value")).agg(F.count_distinct("user_id").alias("count"))
    return of_type.unionByName(of_century)


@query("entity_group_concat", with_sql("agents") + "select authority_uri as entity, min(agent_norm) as agent_norm, string_agg(distinct agent_raw, ',' order by agent_raw) as names, coalesce(string_agg(distinct role_norm, ',' order by role_norm), '') as roles, count(distinct record_id) as records from agents group by 1 order by records desc, entity limit 40")
def entity_group_concat(spark, d):
    cat = catalog(spark, d)
    uris = cat.agents.select("authority_uri").distinct()
    none = F.lit(None).cast("string")
    cat.authority_enrichment = uris.select("authority_uri", F.col("authority_uri").alias("wikidata_id"), none.alias("label"), none.alias("description"), none.alias("person_info"), none.alias("image_url"))
    return enrichment.grouped(cat, 40)


_years = "(select record_id, min(date_start) as y from imprints group by 1)"
query("sample_earliest", with_sql("records", "imprints") + f"select mms_id, y as date_start from records left join {_years} i on i.record_id = id order by y asc nulls last, mms_id limit 25")(lambda spark, d: display.earliest(catalog(spark, d), None, 25))
query("sample_diverse", with_sql("records", "imprints") + f"select mms_id, dec as decade from (select mms_id, cast(y // 10 * 10 as integer) as dec, row_number() over (partition by y // 10 order by mms_id) as n from records join {_years} i on i.record_id = id where y is not null) order by n, dec limit 25")(lambda spark, d: display.diverse(catalog(spark, d), None, 25))
query("sample_notable_scores", with_sql("records", "imprints") + f"select mms_id, round(0.25 * case when y is null then 0.3 when y < 1500 then 1.0 when y < 1600 then 1.0 - 0.15 * (y - 1500) / 100 else 0.85 - 0.45 * (y - 1600) / 200 end, 6) as score from records left join {_years} i on i.record_id = id")(lambda spark, d: _temporal(catalog(spark, d)))


def _temporal(cat):
    from .functions import scores

    y = cat.imprints.groupBy("record_id").agg(F.min("date_start").alias("y"))
    return cat.records.join(y, F.col("id") == F.col("record_id"), "left").select("mms_id", scores.base_score({"temporal": scores.temporal(F.col("y"))}).alias("score"))


@query("sample_notable")
def sample_notable(spark, d):
    """The greedy choice has no form in SQL: its tests hold it against a brute-force choice."""
    return spark.createDataFrame([(r["mms_id"], r["decade"], r["total"]) for r in display.notable(catalog(spark, d), None, 12)], "mms_id string, decade int, total double")


query("paged_browse", with_sql("records", "titles") + "select record_id, value from titles where lower(value) like '%ring%' order by record_id, value limit 20 offset 40")(lambda spark, d: display.browse(catalog(spark, d).titles.select("record_id", "value"), F.struct("record_id", "value"), "RING", 40, 20)[0])
query("table_sizes", with_sql("records", "imprints", "titles", "subjects", "agents") + "select 'records' as \"table\", count(*) as rows from records union all select 'imprints', count(*) from imprints union all select 'titles', count(*) from titles union all select 'subjects', count(*) from subjects union all select 'agents', count(*) from agents")(lambda spark, d: display.table_sizes(catalog(spark, d)).where(F.col("table").isin("records", "imprints", "titles", "subjects", "agents")).select("table", "rows"))


@query("full_record", with_sql("records", "imprints", "agents", "titles", "languages") + "select mms_id, (select string_agg(publisher_norm, ';' order by publisher_norm) from imprints where record_id = id) as publishers, (select string_agg(agent_norm, ';' order by agent_norm) from agents where record_id = id) as agents, (select string_agg(value, ';' order by value) from titles where record_id = id) as titles, coalesce((select string_agg(code, ';' order by code) from languages where record_id = id), '') as languages from records where mms_id = '0000000005'")
def full_record(spark, d):
    """One record by its identifier, with all its rows."""
    r = display.full_record(catalog(spark, d), "0000000005")
    of = lambda c, field: F.coalesce(F.array_join(F.array_sort(F.transform(c, lambda x: x[field])), ";"), F.lit("")).alias("publishers" if c == "imprints" else c)
    return r.select("mms_id", of("imprints", "publisher_norm"), of("agents", "agent_norm"), of("titles", "value"), of("languages", "code"))


@query("resolve_agent_ladder", with_sql("agents", "agent_authorities", "agent_aliases") + "select distinct agent_norm, 'alias_exact' as method, cast(0.95 as double) as confidence from agent_aliases al join agent_authorities aa on aa.id = al.authority_id join agents a on a.authority_uri = aa.authority_uri where alias_form_lower = 'press, no 4' union all select distinct agent_norm, 'canonical_exact', 0.90 from agent_authorities aa join agents a on a.authority_uri = aa.authority_uri where canonical_name_lower = 'supplier#000000006' union all select distinct agent_norm, 'alias_parts', 0.70 from agent_aliases al join agent_authorities aa on aa.id = al.authority_id join agents a on a.authority_uri = aa.authority_uri where alias_form_lower like '%house%' and alias_form_lower like '%nation%'")
def resolve_agent_ladder(spark, d):
    cat = catalog(spark, d)
    return resolve.agent(cat, "Press, No 4").unionByName(resolve.agent(cat, "SUPPLIER#000000006")).unionByName(resolve.agent(cat, "nation house"))


@query("resolve_publisher", with_sql("imprints", "publisher_authorities", "publisher_variants") + "select distinct publisher_norm, 'variant_exact' as method, cast(0.95 as double) as confidence from imprints join publisher_authorities on canonical_name_lower = publisher_norm join publisher_variants on authority_id = id where variant_form_lower = 'officina 4' union all select * from (select distinct publisher_norm, 'imprint_substring', 0.6 from imprints where publisher_norm like '%00000006%' order by 1 limit 12)")
def resolve_publisher(spark, d):
    cat = catalog(spark, d)
    return resolve.publisher(cat, "Officina 4").unionByName(resolve.publisher(cat, "00000006"))


_norm = "' ' || trim(regexp_replace(lower(value), '[^a-z0-9]+', ' ', 'g')) || ' '"
_relaxed = " union ".join(f"select mms_id from records where exists (select 1 from subjects c where c.record_id = records.id and {_norm} like '% {p} %') and exists (select 1 from imprints i where i.record_id = records.id and place_norm = 'nation_2')" for p in ("economy brand 17", "standard"))


@query("relax_or_union", with_sql("records", "imprints", "subjects") + _relaxed)
def relax_or_union(spark, d):
    """Two topics that no record has together: records with either."""
    steps = [Step("retrieve", {"filters": [{"field": "imprint_place", "op": "EQUALS", "value": "nation_2"}, {"field": "subject", "op": "CONTAINS", "value": "economy brand 17"}, {"field": "subject", "op": "CONTAINS", "value": "standard"}, {"field": "title", "op": "CONTAINS", "value": "no such title"}]})]
    return Executor(catalog(spark, d)).run(steps)[0].table


@query("selectivity_ceiling", with_sql("records", "agents") + "select probe, n from (select w as probe, count(distinct record_id) as n from (values ('customer#000000007'), ('customer')) x(w) join agents on agent_norm like concat('%', w, '%') group by 1) where n <= greatest(20, (select round(count(*) / 100.0) from records))")
def selectivity_ceiling(spark, d):
    cat = catalog(spark, d)
    probes = spark.createDataFrame([("customer#000000007",), ("customer",)], "probe string")
    hits = cat.agents.join(F.broadcast(probes), F.col("agent_norm").contains(F.col("probe"))).groupBy("probe").agg(F.count_distinct("record_id").alias("n"))  # two rows
    return hits.where(F.col("n") <= resolve.ceiling(cat.records.count()))


@query("plan_dag_scope_union", with_sql("records", "imprints") + "select place_norm as value, count(distinct record_id) as count from imprints where record_id in (select record_id from imprints where place_norm = 'nation_1' union select record_id from imprints where publisher_norm in (select distinct publisher_norm from imprints where publisher_norm = 'supplier 000000007')) and place_norm <> '' group by 1 order by count desc, value limit 10")
def plan_dag_scope_union(spark, d):
    steps = [
        Step("aggregate", {"field": "city", "limit": 10, "scope": "$step_1+$step_3"}),
        Step("retrieve", {"filters": [{"field": "imprint_place", "op": "EQUALS", "value": "nation_1"}]}),
        Step("resolve_publisher", {"name": "Officina 7"}),
        Step("retrieve", {"filters": [{"field": "publisher", "op": "IN", "value": "$step_2"}]}),
    ]
    return Executor(catalog(spark, d)).run(steps)[0].table


query("subject_hints", with_sql("subjects") + "select value, count(*) as count from subjects group by 1 order by count desc, value limit 100")(lambda spark, d: facets.subject_hints(catalog(spark, d)))
query("filter_min_confidence", with_sql("records", "imprints") + f"{R} where country_name = 'asia' and publisher_confidence >= 0.8")(lambda spark, d: compiler.ids(catalog(spark, d), QueryPlan([Filter("country", "EQUALS", "asia")]), {"publisher_confidence": 0.8}))


@query("hint_retry", with_sql("records", "subjects") + "select distinct mms_id from records join subjects on record_id = id where lower(value) = (select lower(value) from subjects group by value order by count(*) desc, value limit 1)")
def hint_retry(spark, d):
    """A subject that no record has, asked again with the commonest heading."""
    commonest = lambda filters, hints: [Filter("subject", "EQUALS", hints.first()["value"])]
    steps = [Step("retrieve", {"filters": [{"field": "subject", "op": "CONTAINS", "value": "quantum physics"}]})]
    return Executor(catalog(spark, d), hints=commonest).run(steps)[0].table


@query("auto_connections", with_sql("agents") + """, s as (select distinct record_id from agents where agent_norm = 'customer#000000000'),
    t as (select agent_norm from agents where record_id in (select record_id from s) group by 1 order by count(distinct record_id) desc, agent_norm limit 5)
    select a.agent_norm as a, b.agent_norm as b from agents a join agents b on a.record_id = b.record_id and a.agent_norm < b.agent_norm where a.agent_norm in (select * from t) and b.agent_norm in (select * from t) and a.role_norm is distinct from b.role_norm group by 1, 2 having count(distinct a.record_id) >= 2""")
def auto_connections(spark, d):
    executor = Executor(catalog(spark, d))
    done = executor.run([Step("retrieve", {"filters": [{"field": "agent_norm", "op": "EQUALS", "value": "customer#000000000"}]})])
    return executor.connect(done).table.select("a", "b")
