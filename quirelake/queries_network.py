"""Queries of the agent network."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import network
from .registry import query
from .shared import kept
from .sources.driver_tables import catalog, with_sql

_PAIRS = "select a.agent_norm as a, b.agent_norm as b, a.record_id, a.role_norm as ra, b.role_norm as rb from agents a join agents b on a.record_id = b.record_id and a.agent_norm < b.agent_norm"
_CO = with_sql("agents") + f", co as (select a as source, b as target, 'co_publication' as type, least(count(distinct record_id) / 5.0, 1.0) as confidence from ({_PAIRS}) group by 1, 2 having count(distinct record_id) >= 2)"
_BOTH = _CO + ", ways as (select source, target from co union select target, source from co)"

query("edges_co_publication", _CO + " select source, target, type, confidence from co")(lambda spark, d: network.co_publication(catalog(spark, d)).select("source", "target", "type", "confidence"))


@query("edges_same_record", with_sql("agents") + f"select a as source, b as target, cast(least(0.7 + 0.1 * count(distinct record_id), 1.0) as double) as confidence, case when (max(case when ra = 'printer' or rb = 'printer' then 1 else 0 end)) = 1 and max(case when ra = 'author' or rb = 'author' then 1 else 0 end) = 1 then 'printed for' else 'appeared together' end as relationship from ({_PAIRS}) group by 1, 2")
def edges_same_record(spark, d):
    return network.same_record(catalog(spark, d)).select("source", "target", F.round("confidence", 9).alias("confidence"), "relationship")


_ACT = with_sql("agents", "imprints") + ", act as (select agent_norm, place_norm as place, min(date_start) as lo, max(date_start) as hi from agents join imprints using (record_id) where date_start is not null group by 1, 2)"


@query("edges_same_place_period", _ACT + " select a.agent_norm as source, b.agent_norm as target, arg_min(concat(a.place, ': ', cast(greatest(a.lo, b.lo) as varchar), '-', cast(least(a.hi, b.hi) as varchar)), a.place) as evidence from act a join act b on a.place = b.place and a.agent_norm < b.agent_norm where least(a.hi, b.hi) - greatest(a.lo, b.lo) >= 6 group by 1, 2")
def edges_same_place_period(spark, d):
    return network.same_place_period(catalog(spark, d), 6).select("source", "target", "evidence")


def _edges(spark, d):
    return network.co_publication(catalog(spark, d))


query("degree", _CO + " select agent_norm, count(*) as degree from (select source as agent_norm from co union all select target from co) group by 1")(lambda spark, d: network.degrees(_edges(spark, d)))
query("edge_dedup", _CO + " select source, target, type, confidence from co")(lambda spark, d: network.merge_edges([e := kept(_edges(spark, d), "edges"), e.withColumn("confidence", F.lit(0.0))]).select("source", "target", "type", "confidence"))
query("orphan_cleanup", _CO + " select source, target from co where right(source, 1) <> '3' and right(target, 1) <> '3'")(lambda spark, d: network.drop_orphans(_edges(spark, d), catalog(spark, d).agents.where("right(agent_norm, 1) <> '3'")).select("source", "target"))


@query("node_mode_place", with_sql("agents", "imprints") + "select agent_norm, place from (select agent_norm, place_norm as place, row_number() over (partition by agent_norm order by count(*) desc, min(date_start) asc nulls last, place_norm) as n from (select distinct record_id, agent_norm from agents) a join imprints using (record_id) group by 1, 2) where n <= 10 and place not in ('nation_0', 'nation_5') qualify row_number() over (partition by agent_norm order by n) = 1")
def node_mode_place(spark, d):
    cat = catalog(spark, d)
    geo = spark.read.parquet(f"{d}/nation.parquet").select(F.lower("n_name").alias("place"), F.col("n_nationkey").cast("double").alias("lat"), F.lit(0.0).alias("lon")).where("lat not in (0, 5)")
    return network.place_mode(cat, geo).select("agent_norm", "place")


query("primary_role", with_sql("agents") + "select agent_norm, role_norm as primary_role from (select agent_norm, role_norm, row_number() over (partition by agent_norm order by count(*) desc, role_norm) as n from agents where role_norm is not null group by 1, 2) where n = 1")(lambda spark, d: network.primary_role(catalog(spark, d)))
query("map_top_nodes", _CO + " select agent_norm, count(*) as degree from (select source as agent_norm from co union all select target from co) group by 1 order by degree desc, agent_norm limit 30")(lambda spark, d: network.map_nodes(catalog(spark, d).agents.select("agent_norm").distinct(), _edges(spark, d), 30)[0].select("agent_norm", "degree"))
query("ego_one_hop", _BOTH + " select ways.target as neighbour, max(confidence) as confidence from ways join co on (co.source = ways.source and co.target = ways.target) or (co.source = ways.target and co.target = ways.source) where ways.source = 'supplier#000000003' group by 1 order by confidence desc, neighbour limit 40")(lambda spark, d: network.ego(_edges(spark, d), "supplier#000000003", 40).select("neighbour", "confidence"))
query("induced_edges", _CO + " select source as a, target as b, confidence from co where right(source, 1) < '5' and right(target, 1) < '5'")(lambda spark, d: network.induced(_edges(spark, d), catalog(spark, d).agents.where("right(agent_norm, 1) < '5'")).select("a", "b", "confidence"))
_HOPS = ", hop1 as (select target as x from ways where source = 'supplier#000000003'), hop2 as (select w.target as x from ways w join hop1 on w.source = hop1.x)"
query("k_hop_neighbours", _BOTH + _HOPS + " select x as agent_norm, cast(min(h) as integer) as hop from (select 'supplier#000000003' as x, 0 as h union all select x, 1 from hop1 union all select x, 2 from hop2) group by 1")(lambda spark, d: network.neighbourhood(_edges(spark, d), "supplier#000000003", 2))


@query("path_bfs", _BOTH + _HOPS + ", far as (select max(x) as x from (select x from hop2 except select x from hop1 except select 'supplier#000000003')) select case when x is null then 1 else 2 end as hops from far")
def path_bfs(spark, d):
    e = kept(_edges(spark, d).select("source", "target"), "edges")  # both searches read them
    last = lambda hop: F.max(F.when(F.col("hop") == hop, F.col("agent_norm")))
    far, near = network.neighbourhood(e, "supplier#000000003", 2, stored=True).agg(last(2), last(1)).first()
    return spark.createDataFrame([(len(network.path(e, "supplier#000000003", far or near, stored=True)),)], "hops int")


query("alias_search", with_sql("agents", "agent_authorities", "agent_aliases") + "select agent_norm, cast(min(via) as boolean) as via_alias, case when min(via) = 0 then null else min(alias_form) end as alias_form from (select distinct agent_norm, 0 as via, null as alias_form from agents where agent_norm like '%no 1%' union all select distinct a.agent_norm, 1, al.alias_form_lower from agent_aliases al join agent_authorities aa on aa.id = al.authority_id join agents a on a.authority_uri = aa.authority_uri where al.alias_form_lower like '%no 1%') group by 1 order by 2, 1 limit 20")(lambda spark, d: network.search(catalog(spark, d), "NO 1", 20))
_SPANS = """, x as (select id as i, canonical_name_lower as k from publisher_authorities union select authority_id, variant_form_lower from publisher_variants),
    n as (select agent_norm, record_id from agents union all select 'pub:' || canonical_name, record_id from publisher_authorities p join x on x.i = p.id join imprints on publisher_norm = k)
    select agent_norm, min(date_start) as "first", max(coalesce(date_end, date_start)) as "last" from n join imprints using (record_id) where date_start is not null group by 1"""
query("active_spans", with_sql("agents", "imprints", "publisher_authorities", "publisher_variants") + _SPANS)(lambda spark, d: network.spans(catalog(spark, d)))
query("place_details", with_sql("imprints") + 'select place_norm as place, count(distinct record_id) as records, min(date_start) as "first", max(date_start) as "last", count(distinct publisher_norm) as publishers from imprints group by 1')(lambda spark, d: network.place_details(catalog(spark, d)))


@query("topic_details", with_sql("imprints", "subjects") + ", t as (select distinct record_id, split_part(value, ' -- ', 1) as topic from subjects), y as (select record_id, min(date_start) // 10 * 10 as d from imprints where date_start is not null group by 1), c as (select topic, d, count(*) as n from t left join y using (record_id) group by 1, 2) select topic, cast(sum(n) as bigint) as records, cast(arg_max(d, n * 100000 - d) as integer) as peak from c group by 1")
def topic_details(spark, d):
    return network.topic_details(catalog(spark, d))


query("works_of_agent", with_sql("records", "agents", "imprints") + "select mms_id, y as year from records left join (select record_id, min(date_start) as y from imprints group by 1) i on i.record_id = id where id in (select record_id from agents where agent_norm = 'customer#000000007') order by y asc nulls last, mms_id limit 20")(lambda spark, d: network.works(catalog(spark, d), "customer#000000007").select("mms_id", "year"))
query("printed_by", with_sql("agents", "imprints", "publisher_authorities", "publisher_variants") + ", l as (select distinct id, canonical_name, record_id from (select id, canonical_name, canonical_name_lower as k from publisher_authorities union select authority_id, canonical_name, variant_form_lower from publisher_variants join publisher_authorities on id = authority_id) x join imprints on publisher_norm = k) select agent_norm as source, concat('pub:', canonical_name) as target, cast(least(0.7 + 0.1 * count(distinct l.record_id), 1.0) as double) as confidence from l join agents using (record_id) where role_norm = 'author' group by 1, 2")(lambda spark, d: network.printed_by(catalog(spark, d)).select("source", "target", F.round("confidence", 9).alias("confidence")))


_ASKED = "('supplier#000000013', 'supplier#000000065', 'supplier#000000053', 'customer#000000000', 'customer#000000001')"


@query("find_connections", with_sql("agents") + f"select a, b, 'co_publication' as relationship, cast(0.85 as double) as confidence from ({_PAIRS}) where a in {_ASKED} and b in {_ASKED} and ra is distinct from rb group by 1, 2 having count(distinct record_id) >= 2")
def find_connections(spark, d):
    return network.connections(catalog(spark, d), ["Press, No 13", "supplier#000000065", "Supplier#000000053", "customer#000000000", "Customer#000000001"])


@query("merge_duplicate_nodes", with_sql("agents") + ", n as (select agent_norm, substr(agent_norm, length(agent_norm) - 1) as w, count(distinct record_id) as c from agents group by 1) select w as wikidata_id, agent_norm from n qualify row_number() over (partition by w order by c desc, agent_norm) = 1")
def merge_duplicate_nodes(spark, d):
    n = catalog(spark, d).agents.groupBy("agent_norm").agg(F.count_distinct("record_id").alias("record_count")).withColumn("wikidata_id", F.expr("right(agent_norm, 2)"))
    kept, _ = network.merge_duplicates(n, spark.createDataFrame([], "source string, target string, type string, confidence double, evidence string"))
    return kept.select("wikidata_id", "agent_norm")


@query("community_facet", with_sql("agents") + ", c as (select distinct agent_norm, concat('cat ', cast(record_id % 40 as varchar)) as category from agents), p as (select category, count(*) as n from c group by 1 having count(*) >= 8 order by n desc, category limit 20) select agent_norm, category as community from c join p using (category) qualify row_number() over (partition by agent_norm order by n, category) = 1")
def community_facet(spark, d):
    cat = catalog(spark, d)
    own = cat.agents
    cat.wikipedia_cache = own.select(F.col("agent_norm").alias("wikidata_id"), F.concat(F.lit("cat "), (F.col("record_id") % 40).cast("string")).alias("c")).distinct().groupBy("wikidata_id").agg(F.collect_list("c").alias("categories"))
    return network.communities(cat, own.select("agent_norm", F.col("agent_norm").alias("wikidata_id")).distinct())
