"""Queries of enrichment, names, nodes and an ingest, over what the driver's customers and suppliers give."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .functions import scores, text
from .operators import authority, display, enrichment, network, quality
from .registry import query
from .shared import shared_dir, tasks
from .sources import marc
from .sources.driver_tables import SQL, catalog, with_sql
from .sources.versioned import VersionedTable

#: Customers as enriched people with pages: born between 1500 and 1619 in their nation, sixty years old.
PEOPLE = {
    **SQL,
    "ae": "select concat('cus:', cast(c_custkey as varchar)) as authority_uri, concat('Q', cast(c_custkey as varchar)) as wikidata_id, concat('Label ', cast(c_custkey as varchar)) as label, cast(1500 + c_custkey % 120 as integer) as birth_year, cast(1560 + c_custkey % 120 as integer) as death_year, concat('Nation ', cast(c_nationkey as varchar)) as birth_place, lower(c_mktsegment) as occupation, lower(c_name) as agent_norm, c_custkey as k from customer",
    "used": "select distinct ae.* from ae join agents using (authority_uri)",
}


def with_people(*tables: str) -> str:
    return "with " + ",\n".join(f"{t} as ({PEOPLE[t]})" for t in tables) + "\n"


def people(spark, d):
    """The catalogue with authority_enrichment and wikipedia_cache of its customers."""
    cat = catalog(spark, d)
    c = spark.read.parquet(f"{d}/customer.parquet")
    k = F.col("c_custkey")
    id_ = k.cast("string")
    info = F.to_json(F.struct((1500 + k % 120).cast("int").alias("birth_year"), (1560 + k % 120).cast("int").alias("death_year"), F.concat(F.lit("Nation "), F.col("c_nationkey").cast("string")).alias("birth_place"), F.array(F.lower("c_mktsegment")).alias("occupations"), F.array(F.concat(F.lit("Label "), (k + 1).cast("string"))).alias("students")))
    none = F.lit(None).cast("string")
    cat.authority_enrichment = c.select(F.concat(F.lit("cus:"), id_).alias("authority_uri"), F.concat(F.lit("Q"), id_).alias("wikidata_id"), F.concat(F.lit("Label "), id_).alias("label"), none.alias("description"), info.alias("person_info"), none.alias("image_url"), F.concat(F.lit("https://w/Special:GoToLinkedPage/"), id_).alias("wikipedia_url"))
    title = lambda n: F.concat(F.lit("Page "), (k + n).cast("string"))
    cat.wikipedia_cache = c.select(F.concat(F.lit("Q"), id_).alias("wikidata_id"), title(0).alias("wikipedia_title"), F.lit("a long summary").alias("summary"), F.array(F.concat(F.lit("Guild "), (k % 40).cast("string")), F.lit("Living people"), F.concat((1500 + k % 120).cast("string"), F.lit(" births"))).alias("categories"), F.array(title(1)).alias("see_also_titles"), F.array(title(2), title(1)).alias("article_wikilinks"))
    return cat


def geocodes(spark):
    return spark.createDataFrame([(f"nation_{i}", float(i), float(-i)) for i in range(25) if i % 6], "place string, lat double, lon double")


query("people_of_agents", with_people("agents", "ae", "used") + "select agent_norm, label, birth_year, death_year, birth_place from used")(lambda spark, d: network.person(people(spark, d)).select("agent_norm", "label", "birth_year", "death_year", "birth_place"))
query("dq_lifespans", with_people("imprints", "agents", "ae", "records", "used") + "select distinct mms_id as subject, a.agent_norm as detail from used u join agents a using (authority_uri) join imprints i using (record_id) join records r on r.id = record_id where u.birth_year > i.date_start + 5")(lambda spark, d: quality.lifespans(people(spark, d)).select("subject", "detail"))
query("lifespan_overlap", with_people("agents", "ae", "used") + "select x.agent_norm as a, y.agent_norm as b from used x join used y on lower(x.birth_place) = lower(y.birth_place) and x.agent_norm < y.agent_norm where greatest(x.birth_year, y.birth_year) <= least(x.death_year, y.death_year)")(lambda spark, d: network.lifespan_overlap(network.person(people(spark, d))))
query("teacher_student", with_people("agents", "ae", "used") + "select x.agent_norm as source, y.agent_norm as target, 0.85::double as confidence from used x join used y on y.k = x.k + 1")(lambda spark, d: network.teacher_student(people(spark, d)).select("source", "target", "confidence"))
query("wiki_links", with_people("agents", "ae", "used") + """, ways as (select least(x.agent_norm, y.agent_norm) as source, greatest(x.agent_norm, y.agent_norm) as target, case when min(y.k - x.k) over () is not null then 'wikilink' end as type, 0.75::double as confidence from used x join used y on y.k = x.k + 1 or y.k = x.k + 2)
    select source, target, type, confidence from ways
    union all select x.agent_norm, y.agent_norm, 'category', 0.65 from used x join used y on x.k % 40 = y.k % 40 and x.agent_norm < y.agent_norm where x.k % 40 in (select k % 40 from used group by 1 having count(*) between 2 and 50)""")(lambda spark, d: network.wiki_links(people(spark, d)).select("source", "target", "type", "confidence"))
query("display_names", with_people("agents", "ae", "agent_authorities") + "select distinct a.agent_norm, coalesce(aa.canonical_name, ae.label, case when a.agent_norm like 'supplier%' then a.agent_raw end) as display_name from agents a left join agent_authorities aa using (authority_uri) left join ae using (authority_uri)")(lambda spark, d: network.display_names(people(spark, d)))


@query("resolve_names_ladder", with_people("agents", "ae", "used", "agent_authorities", "agent_aliases") + """, forms as (select agent_norm as name, agent_norm, 1 as rank from agents
    union all select alias_form_lower, agent_norm, 2 from agent_aliases al join agent_authorities aa on aa.id = al.authority_id join agents using (authority_uri) union all select lower(label), agent_norm, 3 from used)
    select name, arg_min(agent_norm, concat(cast(rank as varchar), agent_norm)) as agent_norm from forms group by 1""")
def resolve_names_ladder(spark, d):
    cat = people(spark, d)
    names = cat.agents.select("agent_norm").union(cat.agent_aliases.select("alias_form_lower")).union(network.person(cat).select(F.lower("label"))).toDF("name").distinct()
    return network.resolve_names(cat, names)


@query("loose_names", with_people("agents") + "select 'No 7 Customer#000000007 of old' as name, 'customer#000000007' as agent_norm where exists (select 1 from agents where agent_norm = 'customer#000000007') union all select '00005 supplier', min(agent_norm) from agents where agent_norm like '%00005%' and agent_norm like '%supplier%' having min(agent_norm) is not null")
def loose_names(spark, d):
    return network.loose_names(catalog(spark, d), ["No 7 Customer#000000007 of old", "00005 supplier", "nobody at all"])


_MODE = """place as (select agent_norm, place_norm from (select agent_norm, place_norm, row_number() over (partition by agent_norm order by count(*) desc, min(date_start) asc nulls last, place_norm) as n from (select distinct record_id, agent_norm from agents) a join imprints using (record_id) group by 1, 2)
    where n <= 10 and cast(replace(place_norm, 'nation_', '') as integer) % 6 <> 0 qualify row_number() over (partition by agent_norm order by n) = 1)"""
query("agent_nodes", with_people("agents", "imprints", "ae", "used") + f", {_MODE} select a.agent_norm, p.place_norm as place, count(distinct record_id) as record_count, any_value(u.birth_year) as birth_year from agents a join place p using (agent_norm) left join used u using (agent_norm) group by 1, 2")(lambda spark, d: network.nodes(people(spark, d), geocodes(spark)).select("agent_norm", "place", "record_count", "birth_year"))


@query("publisher_nodes", with_people("imprints", "publisher_authorities", "publisher_variants") + "select concat('pub:', canonical_name) as agent_norm, lower(n_name) as place, count(distinct record_id) as record_count from publisher_authorities p join (select id as i, canonical_name_lower as k from publisher_authorities union select authority_id, variant_form_lower from publisher_variants) x on x.i = p.id join imprints on publisher_norm = k join supplier on s_suppkey = p.id join nation on n_nationkey = s_nationkey where n_nationkey % 6 <> 0 group by 1, 2")
def publisher_nodes(spark, d):
    return network.publisher_nodes(catalog(spark, d), geocodes(spark)).select("agent_norm", "place", "record_count")


@query("agent_profiles", with_people("agents", "ae") + "select a.agent_norm, coalesce(any_value(label), any_value(agent_raw)) as label, any_value(ae.birth_year) as birth_year, any_value(ae.occupation) as occupations, 'https://www.wikidata.org/wiki/' || any_value(wikidata_id) as link, count(distinct record_id) as records from agents a left join ae using (authority_uri) group by 1")
def agent_profiles(spark, d):
    cat = people(spark, d)
    out = enrichment.profiles(cat, [], cat.agents.select("agent_norm").distinct())
    return out.select("agent_norm", "label", "birth_year", F.array_join("occupations", ",").alias("occupations"), F.get("links", F.lit(0))["url"].alias("link"), "records")


@query("chosen_profiles", with_people("records", "agents", "ae") + ", n as (select label, count(*) as n from (select distinct record_id, label from agents join ae using (authority_uri)) group by 1) select label from n where n >= 3 order by label limit 3")
def chosen_profiles(spark, d):
    cat = people(spark, d)
    out = enrichment.profiles(cat, [], cat.agents.select("agent_norm").distinct()).where("label like 'Label %'")
    mentions = cat.agents.join(cat.authority_enrichment.select("authority_uri", "label"), "authority_uri").select(F.col("record_id").alias("mms_id"), F.col("label").alias("name")).distinct()
    return display.chosen_profiles(out, mentions, "books of the sixteenth century").select("label")


@query("agent_details", with_people("agents") + ", s as (select distinct record_id, agent_norm from agents), n as (select b.agent_norm as o, count(distinct a.record_id) as n from s a join s b using (record_id) where a.agent_norm = 'supplier#000000003' and b.agent_norm <> a.agent_norm group by 1 having count(distinct a.record_id) >= 2) select 'supplier#000000003' as agent_norm, (select count(distinct record_id) from agents where agent_norm = 'supplier#000000003') as record_count, (select count(*) from n) as connections, (select string_agg(o, ',' order by o) from n) as names")
def agent_details(spark, d):
    cat = catalog(spark, d)
    nodes = cat.agents.groupBy("agent_norm").agg(F.count_distinct("record_id").alias("record_count")).withColumn("display_name", F.col("agent_norm"))
    out = network.agent_detail(cat, nodes, network.co_publication(cat), "supplier#000000003")
    return out.select("agent_norm", "record_count", F.size("connections").cast("long").alias("connections"), F.array_join("connections.agent_norm", ",").alias("names"))


@query("seed_authorities", with_people("agents", "ae") + ", a as (select label as canonical_name, 0.95::double as confidence, authority_uri from ae union all select distinct agent_norm, 0.80, authority_uri from agents where authority_uri not in (select authority_uri from ae)) select canonical_name, confidence, authority_uri from a")
def seed_authorities(spark, d):
    return authority.seed(people(spark, d))[0].select("canonical_name", "confidence", "authority_uri")


query("aliases_by_form", with_people("publisher_variants") + "select distinct authority_id from publisher_variants where variant_form_lower = 'officina 5'")(lambda spark, d: authority.by_form(catalog(spark, d).publisher_variants, " Officina 5"))


@query("alternate_script_names", "select s_suppkey as authority_id, concat('מדפיס ', cast(s_suppkey as varchar)) as name from supplier where s_suppkey % 10 <> 9 and s_suppkey % 2 = 0")
def alternate_script_names(spark, d):
    cat = catalog(spark, d)
    k = F.col("authority_id")
    turned = cat.agent_aliases.withColumn("alias_form", F.when(k % 2 == 0, F.concat(F.lit("מדפיס "), k.cast("string"))).otherwise(F.col("alias_form")))
    cat.agent_aliases = turned
    return network.alternate_script_name(cat)


@query("enrichment_gaps", with_people("agents", "ae") + "select count(distinct authority_uri) as used, count(distinct case when authority_uri in (select authority_uri from ae) then authority_uri end) as enriched from agents")
def enrichment_gaps(spark, d):
    return quality.enrichment_gaps(people(spark, d))


@query("cache_hits", "select user_id, max(value) as value from events where ts > timestamp '2024-01-15' and user_id = 17 and ts = (select max(ts) from events where user_id = 17) group by 1")
def cache_hits(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.lit("agent").alias("kind"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("key"), F.lit("s").alias("source"), "value", F.col("ts").alias("fetched_at"), (F.col("ts") + F.expr("interval 10 days")).alias("expires_at"))
    got = enrichment.cache_get(enrichment.cache_put(e.where("false"), e), "agent", " USER  17 ", F.lit("2024-01-25").cast("timestamp"))
    return got.select(F.lit(17).cast("long").alias("user_id"), "value")


query("place_frequency", "select lower(n_name) as place, count(*) as count from lineitem join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey group by 1")(lambda spark, d: quality.place_frequency(catalog(spark, d).imprints.withColumn("place_raw", F.concat(F.lit(" ["), "place_raw", F.lit("]")))))


@query("curation_reasons", "select p_partkey, concat('Published ', cast(1600 + p_size as varchar), '; printed in Small Town; subjects: ', p_type, ', ', p_brand, case when p_size % 2 = 0 then '; by Anna' else '' end, case when p_size % 3 = 0 then '; with maps/plates — strong visual teaching material' when p_size % 3 = 1 then '; illustrated' else '' end) as reason from part")
def curation_reasons(spark, d):
    p, n = spark.read.parquet(f"{d}/part.parquet"), F.col("p_size")
    extent = F.when(n % 3 == 0, "2 folded maps").when(n % 3 == 1, "ill.").otherwise("30 cm")
    return p.select("p_partkey", scores.significance((1600 + n).cast("int"), F.lit("small town"), F.array("p_type", "p_brand"), F.when(n % 2 == 0, "Anna"), extent).alias("reason"))


@query("names_match", "select c_custkey, c_custkey % 3 <> 2 as same from customer")
def names_match(spark, d):
    k = F.col("c_custkey")
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_name")
    given = F.when(k % 3 == 0, F.concat("c_name", F.lit(", Ünal"))).when(k % 3 == 1, F.concat(F.lit("ÜNAL  "), F.replace("c_name", F.lit("#"), F.lit(".")))).otherwise(F.lit("Somebody Else"))
    return c.select("c_custkey", text.names_match(given, F.concat(F.lit("Ünal "), F.replace("c_name", F.lit("#"), F.lit(" ")))).alias("same"))


@query("dq_place_checks", "with i as (select lpad(cast(l_orderkey as varchar), 10, '0') as mms_id, lower(n_name) as place, s_nationkey % 3 as code, n_nationkey as k from lineitem join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey) select 'place_country_mismatch' as \"check\", mms_id as subject, place as detail from i where k < 20 and code <> 0 union all select 'country_name_as_place', mms_id, place from i where k >= 22")
def dq_place_checks(spark, d):
    cat = catalog(spark, d)
    k = F.replace("place_norm", F.lit("nation_"), F.lit("")).cast("int")
    cat.imprints = cat.imprints.withColumn("country_code", F.concat(F.lit("C"), (k % 3).cast("string")))
    return quality.place_mismatches(cat, {f"nation_{i}": ["c0", "zz"] for i in range(20)}, [f"Nation_{i}" for i in range(22, 25)])


query("dq_fragmented", "with a as (select concat('u', cast(c_nationkey as varchar)) as u, c_name from customer join orders on o_custkey = c_custkey) select u as subject, cast(count(distinct c_name) as varchar) as detail from a group by 1 having count(distinct c_name) > 1")(lambda spark, d: _fragmented(spark, d))


def _fragmented(spark, d):
    cat = catalog(spark, d)
    c = spark.read.parquet(f"{d}/customer.parquet").join(spark.read.parquet(f"{d}/orders.parquet"), F.col("o_custkey") == F.col("c_custkey"))
    cat.agents = c.select(F.concat(F.lit("u"), F.col("c_nationkey").cast("string")).alias("authority_uri"), F.lower("c_name").alias("agent_norm"))
    return quality.fragmented_agents(cat).select("subject", "detail")


@query("dq_bare_names", "select concat('c', cast(c_custkey as varchar)) as subject, cast(count(*) as varchar) as detail from customer join orders on o_custkey = c_custkey where length(concat('c', cast(c_custkey as varchar))) < 4 group by 1")
def dq_bare_names(spark, d):
    cat = catalog(spark, d)
    o = spark.read.parquet(f"{d}/orders.parquet")
    cat.agents = o.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("agent_norm"), F.lit("personal").alias("agent_type"))
    return quality.bare_names(cat, 4).select("subject", "detail")


@query("dq_role_issues", "select case o_orderkey % 5 when 0 then 'trailing_period_unmapped' when 1 then 'hebrew_role_unmapped' when 2 then 'unmapped_relator_term' else 'missing_role' end as \"check\", count(*) as n from orders where o_orderkey % 5 < 4 group by 1")
def dq_role_issues(spark, d):
    cat, k = catalog(spark, d), F.col("o_orderkey")
    role = F.when(k % 5 == 0, "prtr.").when(k % 5 == 1, "מדפיס").when(k % 5 == 2, "dancer").when(k % 5 == 4, "printer")
    method = F.when(k % 5 < 3, "unmapped").when(k % 5 == 3, "missing_role").otherwise("relator_term")
    cat.agents = spark.read.parquet(f"{d}/orders.parquet").select(k.cast("string").alias("agent_norm"), role.alias("role_raw"), method.alias("role_method"))
    return quality.role_issues(cat).groupBy("check").agg(F.count("*").alias("n"))


query("dq_failed_dates", "select lpad(cast(l_orderkey as varchar), 10, '0') as subject, count(*) as n from lineitem where l_partkey % 17 = 0 group by 1")(lambda spark, d: _failed(catalog(spark, d)).groupBy("subject").agg(F.count("*").alias("n")))


def _failed(cat):
    cat.imprints = cat.imprints.withColumn("date_raw", F.lit("no year"))
    return quality.failed_dates(cat)


@query("renormalized_dates", "select l_orderkey as record_id, l_linenumber as occurrence from lineitem where l_partkey % 17 = 0 or l_linenumber % 2 = 0")
def renormalized_dates(spark, d):
    im = catalog(spark, d).imprints.withColumn("y", F.coalesce("date_start", F.lit(1600)))
    raw = F.when(F.col("occurrence") % 2 == 0, F.lit("[1234]")).otherwise(F.concat(F.lit("["), F.col("y").cast("string"), F.lit("]")))
    return quality.renormalized(im.withColumn("date_raw", raw)).select("record_id", "occurrence")


@query("place_gap_clusters", "with g as (select lower(n_name) as raw, n_nationkey as k, count(*) as f from customer join nation on n_nationkey = c_nationkey group by 1, 2) select case when k % 5 = 0 then 'near_match' when k % 5 = 1 then 'hebrew_script' else 'latin_script' end as cluster, count(*) as members, cast(sum(f) as bigint) as priority from g group by 1")
def place_gap_clusters(spark, d):
    n, c = spark.read.parquet(f"{d}/nation.parquet"), spark.read.parquet(f"{d}/customer.parquet")
    k = F.col("n_nationkey")
    raw = F.when(k % 5 == 1, F.concat(F.lit("ונציה "), k.cast("string"))).otherwise(F.lower("n_name"))
    gaps = c.join(n, F.col("c_nationkey") == k).groupBy(raw.alias("raw")).agg(F.count("*").alias("frequency"))
    return quality.place_clusters(gaps, n.where(k % 5 == 0).select(F.upper(F.replace("n_name", F.lit("_"), F.lit("."))).alias("key")))


@query("agent_gap_clusters", "select case c_custkey % 3 when 0 then 'ambiguous' when 1 then 'low_confidence' else 'other' end as cluster, count(*) as members, count(*) as priority from customer group by 1")
def agent_gap_clusters(spark, d):
    k = F.col("c_custkey")
    return quality.agent_clusters(spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_name").alias("raw"), F.lit(1).cast("long").alias("frequency"), F.when(k % 3 == 0, "ambiguous").otherwise("base_clean").alias("method"), F.when(k % 3 == 1, 0.3).otherwise(0.8).alias("confidence")))


@query("hebrew_coverage", "select round(100.0 * count(case when l_orderkey % 3 = 0 then 1 end) / count(*), 1) as rows, round(100.0 * count(distinct case when l_orderkey % 3 = 0 then v end) / count(distinct v), 1) as headings from (select distinct l_orderkey, concat(p_type, ' -- ', p_brand, ' -- ', p_name) as v from lineitem join part on p_partkey = l_partkey)")
def hebrew_coverage(spark, d):
    cat = catalog(spark, d)
    cat.subjects = cat.subjects.withColumn("value_he", F.when(F.col("record_id") % 3 == 0, "נושא"))
    return quality.hebrew_coverage(cat).select(F.col("rows").cast("double").alias("rows"), F.col("headings").cast("double").alias("headings"))


@query("repair_roles_and_places", "select 'roles' as what, count(*) as n from orders where o_orderkey % 2 = 0 union all select 'places', count(*) from lineitem join supplier on s_suppkey = l_suppkey where s_nationkey = 3 union all select 'merged', count(distinct c_nationkey) from customer join orders on o_custkey = c_custkey")
def repair_roles_and_places(spark, d):
    cat, o = catalog(spark, d), spark.read.parquet(f"{d}/orders.parquet")
    k = F.col("o_orderkey")
    roles = o.select(F.when(k % 2 == 0, "printer.").otherwise("dancer.").alias("role_raw"), F.lit("other").alias("role_norm"), F.lit(0.6).alias("role_confidence"), F.lit("unmapped").alias("role_method"))
    im = cat.imprints.withColumns({"country_code": F.lit("gw"), "place_confidence": F.lit(0.8), "place_method": F.lit("x")})
    moved = authority.replace_by_code(im, spark.createDataFrame([("nation_3", "gw", "frankfurt"), ("nation_4", "fr", "paris")], "place_norm string, country_code string, canonical string"))
    c = spark.read.parquet(f"{d}/customer.parquet").join(o, F.col("o_custkey") == F.col("c_custkey")).select(k.alias("record_id"), F.lower("c_name").alias("agent_norm"), F.concat(F.lit("u"), F.col("c_nationkey").cast("string")).alias("authority_uri"))
    n = lambda what, df: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    return n("roles", authority.trim_roles(roles).where("role_norm = 'printer'")).unionByName(n("places", moved.where("place_norm = 'frankfurt'"))).unionByName(n("merged", authority.merge_norms(c).select("agent_norm").distinct()))


@query("marc_ingest", """select lpad(cast(o_orderkey as varchar), 10, '0') as mms_id, concat('Title ', cast(o_orderkey as varchar), ' by the press') as title, cast(1500 + o_orderkey % 200 as integer) as date_start, 'year_bracketed' as date_method, case when o_orderkey % 3 = 0 then 'köln' else 'venice' end as place_norm,
    lower(c_name) as publisher_norm, case when o_orderkey % 2 = 0 then 'italy' end as country_name, 'author' as role, lower(concat('surname ', cast(c_custkey as varchar), ', anna')) as agent_norm, concat('Law -- History ', cast(o_orderkey % 9 as varchar)) as subject from orders join customer on c_custkey = o_custkey where o_orderkey % 7 <> 0""")
def marc_ingest(spark, d):
    """MARC files of a record for every order, written to the shared folder, into the catalogue's tables.

    Orders that 7 divides have no identifier and so no record.
    """
    o = spark.read.parquet(f"{d}/orders.parquet").join(spark.read.parquet(f"{d}/customer.parquet"), F.col("c_custkey") == F.col("o_custkey"))
    k = F.col("o_orderkey")
    o = o.repartition(tasks(spark.read.parquet(f"{d}/orders.parquet")), k)
    say = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs])
    control = lambda tag, v: F.struct(F.lit(tag).alias("_tag"), v.alias("_VALUE"))
    field = lambda tag, *subs: F.struct(F.lit(tag).alias("_tag"), F.lit(" ").alias("_ind1"), F.lit(" ").alias("_ind2"), F.array(*[F.struct(F.lit(code).alias("_code"), say(v).alias("_VALUE")) for code, v in subs]).alias("subfield"))
    number, fixed = control("001", F.lpad(k.cast("string"), 10, "0")), control("008", say("850101s1565    ", F.when(k % 2 == 0, "it").otherwise("gw"), "            000 0 heb d"))
    fields = F.array(
        field("100", ("a", say("Surname ", F.col("c_custkey"), ", Anna,"))), field("245", ("c", "by the press"), ("a", say("Title ", k))),
        field("260", ("a", say("[", F.when(k % 3 == 0, "Köln").otherwise("Venice"), "] :")), ("b", say(F.col("c_name"), ",")), ("c", say("[", 1500 + k % 200, "]"))),
        field("650", ("a", "Law"), ("x", say("History ", k % 9)), ("2", "lcsh")),
    )
    xml = o.select(F.lit("00000nam a2200000").alias("leader"), F.when(k % 7 != 0, F.array(number, fixed)).otherwise(F.array(fixed)).alias("controlfield"), fields.alias("datafield"))
    path = f"{shared_dir(spark)}/marc-{uuid.uuid4().hex}"
    # a file is one collection of ten thousand records at most
    xml.write.option("rootTag", 'collection xmlns="http://www.loc.gov/MARC21/slim"').option("rowTag", "record").option("indent", "").option("maxRecordsPerFile", 10_000).xml(f"{path}/xml")
    # the normalized records are written once and flattened into all tables from there
    marc.normalized(marc.canonical(marc.read_xml(spark, f"{path}/xml"))).write.parquet(f"{path}/records")
    t = marc.flatten(spark.read.parquet(f"{path}/records"), {"it": "italy"})
    one = lambda name, *cols: t[name].select("record_id", *cols)
    out = t["records"].select(F.col("id").alias("record_id"), "mms_id").join(one("titles", F.col("value").alias("title")), "record_id").join(one("imprints", "date_start", "date_method", "place_norm", "publisher_norm", "country_name"), "record_id")
    return out.join(one("agents", F.col("role_norm").alias("role"), "agent_norm"), "record_id").join(one("subjects", F.col("value").alias("subject")), "record_id").drop("record_id")


@query("authority_versions", with_sql("publisher_authorities") + """select id, case when id % 7 = 0 then 'Renamed ' || canonical_name else canonical_name end as canonical_name, case when type = 'unresearched' then 'private_press' else type end as type from publisher_authorities where id % 5 <> 0
    union all select -id, canonical_name, 'printing_house' from publisher_authorities where id % 11 = 0""")
def authority_versions(spark, d):
    """Authorities written, put, taken out and corrected, and read again from the last version."""
    rows = catalog(spark, d).publisher_authorities.select("id", "canonical_name", "type")
    path = f"{shared_dir(spark)}/authorities-{uuid.uuid4().hex}"
    table = VersionedTable.create(rows, path, ["id"], 16)
    renamed = rows.where("id % 7 = 0").withColumn("canonical_name", F.concat(F.lit("Renamed "), "canonical_name"))
    table = table.put(renamed).remove(rows.where("id % 5 = 0")).correct(F.col("type") == "unresearched", {"type": F.lit("private_press")})
    table.put(rows.where("id % 11 = 0").select((-F.col("id")).alias("id"), "canonical_name", F.lit("printing_house").alias("type")))
    return VersionedTable(spark, path).read()
