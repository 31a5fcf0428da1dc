"""Queries of data quality, authorities and repairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import authority, facets, quality
from .registry import query
from .shared import kept
from .sources.driver_tables import catalog, with_sql

_D = with_sql("records", "imprints") + ", d as (select mms_id, i.* from imprints i join records r on r.id = i.record_id) "
query("dq_inversion", _D + "select 'impossible_inversion' as \"check\", mms_id as subject, concat(cast(date_end as varchar), ' < ', cast(date_start as varchar)) as detail from d where date_end < date_start")(lambda spark, d: quality.inversions(catalog(spark, d)))
query("dq_wide_range", _D + "select 'wide_date_range' as \"check\", mms_id as subject, cast(date_end - date_start as varchar) as detail from d where date_end - date_start > 100")(lambda spark, d: quality.wide_ranges(catalog(spark, d)))
query("dq_out_of_scope", _D + "select mms_id as subject, cast(date_start as varchar) as detail from d where date_start < 1596 or date_start > 1600")(lambda spark, d: _narrow(spark, d))


def _narrow(spark, d):
    cat = catalog(spark, d)
    cat.imprints = cat.imprints.withColumn("date_start", F.when(~F.col("date_start").between(1596, 1600), F.col("date_start") - 1000))
    return quality.out_of_scope(cat).select("subject", (F.col("detail").cast("int") + 1000).cast("string").alias("detail"))


query("dq_self_disagree", _D + "select mms_id as subject, cast(max(abs(g.date_start - n.date_start)) as varchar) as detail from d g join imprints n on g.record_id = n.record_id where g.date_method like '%gematria%' and n.date_method not like '%gematria%' and abs(g.date_start - n.date_start) > 5 group by 1")(lambda spark, d: quality.disagreements(catalog(spark, d)).select("subject", "detail"))
query("dq_missing_authority", with_sql("agents", "agent_authorities") + "select agent_norm as subject, cast(count(*) as varchar) as detail from agents where agent_norm not in (select canonical_name_lower from agent_authorities) group by 1")(lambda spark, d: quality.missing_authorities(catalog(spark, d)).select("subject", "detail"))
query("dq_type_conflict", with_sql("agents") + "select agent_norm as subject, cast(count(distinct agent_type) as varchar) as detail from agents group by 1 having count(distinct agent_type) > 1")(lambda spark, d: quality.type_conflicts(catalog(spark, d)).select("subject", "detail"))
query("dq_publisher_authority", with_sql("imprints", "publisher_variants") + "select publisher_norm as subject, cast(count(distinct record_id) as varchar) as detail from imprints where publisher_norm not in (select variant_form_lower from publisher_variants) group by 1 having count(distinct record_id) >= 3")(lambda spark, d: quality.publishers_without_authority(catalog(spark, d)).select("subject", "detail"))
query("dq_unresearched", with_sql("imprints", "publisher_authorities") + "select canonical_name as subject, cast(count(distinct record_id) as varchar) as detail from publisher_authorities join imprints on publisher_norm = canonical_name_lower where type = 'unresearched' group by 1")(lambda spark, d: _unresearched(catalog(spark, d)))


def _unresearched(cat):
    cat.publisher_variants = cat.publisher_authorities.select(F.col("id").alias("authority_id"), F.col("canonical_name_lower").alias("variant_form_lower"))
    return quality.unresearched_publishers(cat).select("subject", "detail")


query("dq_missing_role", with_sql("agents") + "select agent_norm as subject, count(*) as n from agents where role_norm is null or role_norm = '' group by 1")(lambda spark, d: quality.role_issues(_with_roles(catalog(spark, d))).where(F.col("check") == "missing_role").groupBy("subject").agg(F.count("*").alias("n")))


def _with_roles(cat):
    cat.agents = cat.agents.withColumns({"role_raw": F.col("role_norm"), "role_method": F.when(F.col("role_norm").isNull(), "missing_role").otherwise("relator_term")})
    return cat


_has = lambda t: f"exists (select 1 from {t} x where x.record_id = records.id)"
_kinds = ("titles", "imprints", "agents", "subjects", "languages")
query("dq_completeness", with_sql("records", *_kinds) + "select count(*) as records, " + ", ".join(f"sum(case when not {_has(k)} then 1 else 0 end)::bigint as without_{k}" for k in _kinds) + ", sum(case when " + " and ".join(_has(k) for k in _kinds) + " then 1 else 0 end)::bigint as complete from records")(lambda spark, d: quality.completeness(catalog(spark, d)))
query("dq_subject_gaps", with_sql("records", "subjects") + f"select sum(case when {_has('subjects')} then 1 else 0 end)::bigint as with_subjects, sum(case when not {_has('subjects')} then 1 else 0 end)::bigint as without_subjects from records")(lambda spark, d: _gaps(catalog(spark, d)))


def _gaps(cat):
    cat.subjects = cat.subjects.withColumn("value_he", F.lit(None).cast("string"))
    return quality.subject_gaps(cat).select("with_subjects", "without_subjects")


_bands = "case when coalesce(publisher_confidence, 0) < 0.5 then '0.00-0.50' when publisher_confidence < 0.8 then '0.50-0.80' when publisher_confidence < 0.95 then '0.80-0.95' when publisher_confidence < 0.99 then '0.95-0.99' else '0.99-1.00' end"
query("coverage_bands", with_sql("imprints") + f"select b as band, count(i.c) as count from (values ('0.00-0.50'), ('0.50-0.80'), ('0.80-0.95'), ('0.95-0.99'), ('0.99-1.00')) x(b) left join (select {_bands} as c from imprints) i on c = b group by 1")(lambda spark, d: facets.bands(catalog(spark, d).imprints, "publisher_confidence"))
query("method_pct", with_sql("imprints") + "select coalesce(date_method, 'NULL') as method, count(*) as count, round(100.0 * count(*) / (select count(*) from imprints), 2) as percentage from imprints group by 1")(lambda spark, d: facets.methods(catalog(spark, d).imprints, "date_method"))
query("flagged", with_sql("imprints") + "select publisher_raw as raw, min(publisher_norm) as norm, count(*) as frequency from imprints where coalesce(publisher_confidence, 0) < 0.5 group by 1 order by frequency desc, raw limit 40")(lambda spark, d: facets.flagged(catalog(spark, d).imprints, "publisher_raw", "publisher_norm", "publisher_confidence", "date_method", 0.5, 40).select("raw", "norm", "frequency"))
query("paged_issues", with_sql("records", "imprints") + ", d as (select mms_id, part, publisher_raw, occurrence, publisher_confidence from imprints i join records r on r.id = i.record_id where coalesce(publisher_confidence, 0) < 0.3) select distinct mms_id, part, publisher_raw from d order by mms_id, part, publisher_raw limit 25 offset 50")(lambda spark, d: _issues(catalog(spark, d)))


def _issues(cat):
    low = cat.imprints.where(F.coalesce("publisher_confidence", F.lit(0.0)) < 0.3).join(cat.records.select(F.col("id").alias("record_id"), "mms_id"), "record_id")
    return low.select("mms_id", "part", "publisher_raw").distinct().orderBy("mms_id", "part", "publisher_raw").offset(50).limit(25)


query("field_coverage", with_sql("imprints") + "select 'date_start' as field, count(*) as total, count(date_start) as filled, count(*) - count(date_start) as missing from imprints union all select 'date_end', count(*), count(date_end), count(*) - count(date_end) from imprints union all select 'publisher_confidence', count(*), count(publisher_confidence), count(*) - count(publisher_confidence) from imprints")(lambda spark, d: facets.coverage(catalog(spark, d).imprints, ["date_start", "date_end", "publisher_confidence"]))
query("gap_clusters", "with g as (select p_name as raw, count(*) as frequency, replace(p_name, ' ', '') as base from part group by 1) select case when frequency >= 5 then 'frequent_single' else 'single' end as cluster, count(*) as members, cast(sum(frequency) as bigint) as priority from g group by 1")(lambda spark, d: quality.publisher_clusters(spark.read.parquet(f"{d}/part.parquet").groupBy(F.col("p_name").alias("raw")).agg(F.count("*").alias("frequency"))))
query("date_gap_clusters", "with y as (select concat('ca. ', cast(year(l_shipdate) as varchar)) as raw, count(*) as frequency from lineitem group by 1) select 'circa' as cluster, count(*) as members, cast(sum(frequency) as bigint) as priority from y")(lambda spark, d: quality.date_clusters(spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.concat(F.lit("ca. "), F.year("l_shipdate").cast("string")).alias("raw")).agg(F.count("*").alias("frequency"))))


_NODES = ", nodes as (select agent_norm, count(distinct record_id) + (case when agent_norm like '%7' then 1 else 0 end) as record_count, case when agent_norm like '%3' then 0 else count(distinct record_id) end as connection_count from agents where agent_norm not like '%9' group by 1)"
_EDGES = ", pairs as (select a.agent_norm as source, b.agent_norm as target, count(distinct a.record_id) as n from agents a join agents b on a.record_id = b.record_id and a.agent_norm < b.agent_norm group by 1, 2 having count(distinct a.record_id) >= 2), edges as (select source, target from pairs)"
_BROKEN = {
    "orphan_imprints": "imprints where record_id not in (select id from records)", "orphan_agents": "agents where record_id not in (select id from records)", "orphan_notes": "notes where record_id not in (select id from records)",
    "mms_id_unique": "(select mms_id from records group by 1 having count(*) > 1)", "place_trimmed": "imprints where place_norm <> trim(place_norm)", "publisher_lower": "imprints where publisher_norm <> lower(publisher_norm)", "agent_type_known": "agents where agent_type not in ('personal', 'corporate', 'meeting')",
    "I1": "(select distinct agent_norm from agents join agent_authorities using (authority_uri) where agent_norm not in (select alias_form_lower from agent_aliases))",
    "I3": "agent_aliases where authority_id not in (select id from agent_authorities)", "I5": "agent_authorities where canonical_name_lower <> lower(canonical_name)", "A1": "(select alias_form_lower from agent_aliases group by 1 having count(*) > 1)",
    "P1": "publisher_variants where authority_id not in (select id from publisher_authorities)", "P3": "publisher_variants join publisher_authorities on canonical_name_lower = variant_form_lower and id <> authority_id",
    "P2": "(select publisher_norm from imprints group by 1 having count(distinct record_id) > 1) where publisher_norm not in (select canonical_name_lower from publisher_authorities union select variant_form_lower from publisher_variants)",
    "M2": "imprints where date_start > date_end", "N1": "edges where source not in (select agent_norm from nodes) or target not in (select agent_norm from nodes)", "N2": "nodes where agent_norm not in (select agent_norm from agents)",
    "N4": "nodes where connection_count <> (select count(*) from edges where source = agent_norm or target = agent_norm)", "N5": "nodes n where record_count <> (select count(distinct record_id) from agents a where a.agent_norm = n.agent_norm)", "N6self": "edges where source = target",
}


_BREAKS = with_sql("records", "imprints", "agents", "notes", "agent_authorities", "agent_aliases", "publisher_authorities", "publisher_variants") + _NODES.removeprefix(", ").join([", ", ""]) + _EDGES + " " + " union all ".join(f"select '{k}' as id, (select count(*) from {v}) as violations" for k, v in _BROKEN.items())


def _broken(spark, d):
    """A catalogue with a network whose nodes and counts break some invariants."""
    from .operators import network

    cat = catalog(spark, d)
    ends, n = F.col("agent_norm"), F.count_distinct("record_id")
    cat.network_edges = kept(network.co_publication(cat), "edges")  # a built network is read by its invariants, not derived for each
    cat.network_nodes = cat.agents.where(~ends.endswith("9")).groupBy("agent_norm").agg((n + F.when(F.max(ends).endswith("7"), 1).otherwise(0)).alias("record_count"), F.when(F.max(ends).endswith("3"), 0).otherwise(n).alias("connection_count")).withColumn("node_type", F.lit("person"))
    cat.network_nodes = kept(cat.network_nodes, "nodes")
    return cat


@query("invariant_violations", _BREAKS)
def invariant_violations(spark, d):
    """The invariants that SQL can check in so many words."""
    return quality.violations([i for i in quality.invariants(_broken(spark, d)) if i.id in _BROKEN])


@query("invariants_in_one_pass", _BREAKS)
def invariants_in_one_pass(spark, d):
    """The same, those of one key or one row from one pass over the tables."""
    from .operators import invariants

    return invariants.violations(_broken(spark, d)).where(F.col("id").isin(list(_BROKEN)))


@query("goldset_regression", with_sql("records", "imprints") + ", g as (select 'africa' as query, mms_id, id % 2 = 0 as wanted, exists (select 1 from imprints i where i.record_id = id and country_name = 'africa') as got from records) select query, cast(sum(case when wanted and not got then 1 else 0 end) as bigint) as missing, cast(sum(case when not wanted and got then 1 else 0 end) as bigint) as unexpected, sum(case when wanted <> got then 1 else 0 end) = 0 as passed from g group by 1")
def goldset_regression(spark, d):
    from .plans import compile as compiler
    from .plans.filters import Filter, QueryPlan

    cat = catalog(spark, d)
    found = compiler.ids(cat, QueryPlan([Filter("country", "EQUALS", "africa")])).withColumn("query", F.lit("africa"))
    gold = cat.records.select(F.lit("africa").alias("query"), "mms_id", (F.col("id") % 2 == 0).alias("wanted"))
    return quality.gold_set(found, gold)


query("label_stats", "select count(*) as total, cast(sum(case when quality = 1 then 1 else 0 end) as bigint) as positive, cast(sum(case when quality = 0 then 1 else 0 end) as bigint) as negative, round(avg(quality), 6) as share from labels")(lambda spark, d: quality.label_stats(spark.read.parquet(f"{d}/labels.parquet"), "quality"))
query("worst_queries", "select query, labels, bad from (select doc_id % 50 as query, count(*) as labels, cast(sum(case when quality = 0 then 1 else 0 end) as bigint) as bad from labels group by 1) order by bad desc, query limit 10")(lambda spark, d: quality.worst_queries(spark.read.parquet(f"{d}/labels.parquet").withColumn("q", F.col("doc_id") % 50), "q", "quality"))
query("correction_apply", with_sql("imprints") + "select record_id, part, case when publisher_raw = 'Supplier#000000004' then 'corrected' else publisher_norm end as publisher_norm, case when publisher_raw = 'Supplier#000000004' then 0.95 else publisher_confidence end as publisher_confidence from imprints")(lambda spark, d: authority.correct(catalog(spark, d).imprints.withColumn("publisher_method", F.lit(None).cast("string")), "publisher", "Supplier#000000004", "corrected").select("record_id", "part", "publisher_norm", "publisher_confidence"))


@query("corrections_batch", with_sql("imprints") + "select place_norm, count(*) as n from (select case when place_raw in ('NATION_1', 'NATION_2') then 'united' else place_norm end as place_norm from imprints) group by 1")
def corrections_batch(spark, d):
    im = catalog(spark, d).imprints.withColumns({"place_confidence": F.lit(0.8), "place_method": F.lit("x")})
    fixed = authority.corrections(im, "place", spark.createDataFrame([("NATION_1", "united"), ("NATION_2", "united")], "raw string, canonical string"))
    return fixed.groupBy("place_norm").agg(F.count("*").alias("n"))


@query("seed_aliases_first_wins", "with a as (select s_suppkey as authority_id, concat('nation ', cast(s_nationkey as varchar)) as alias_form from supplier union all select c_custkey, concat('nation ', cast(c_nationkey as varchar)) from customer) select alias_form, min(authority_id) as authority_id from a group by 1")
def seed_aliases_first_wins(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("authority_id"), F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")).alias("alias_form"))
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("authority_id"), F.concat(F.lit("nation "), F.col("c_nationkey").cast("string")).alias("alias_form"))
    both = s.unionByName(c).withColumns({"alias_type": F.lit("primary"), "rank": F.lit(0)})
    return authority.first_aliases(both).select("alias_form", "authority_id")


query("linked_imprints", with_sql("imprints", "publisher_authorities", "publisher_variants") + "select publisher, count(*) as imprints from (select distinct id as publisher, canonical_name_lower as k from publisher_authorities union select authority_id, variant_form_lower from publisher_variants) x join imprints on publisher_norm = k group by 1")(lambda spark, d: authority.linked_counts(catalog(spark, d)))
query("scope_flags", with_sql("imprints") + "select distinct record_id, 'modern' as flag from imprints where date_start + 355 > 1950")(lambda spark, d: _flags(catalog(spark, d)))


def _flags(cat):
    cat.imprints = cat.imprints.withColumn("date_start", F.col("date_start") + 355)
    return authority.scope_flags(cat)


@query("infer_roles", "select agent_norm, role from (select lower(c_name) as agent_norm, case c_mktsegment when 'MACHINERY' then 'printer' when 'HOUSEHOLD' then 'binder' end as role from customer) where role is not null")
def infer_roles(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.lower("c_name").alias("agent_norm"), F.col("c_mktsegment").alias("occupation"))
    direct = spark.createDataFrame([("machinery", "printer", 0.9), ("HOUSEHOLD", "binder", 0.8)], "occupation string, role string, confidence double")
    return authority.infer_roles(c, direct, ["printer", "binder"]).select("agent_norm", "role")


@query("cache_live", "select user_id, arg_max(value, ts) as value from events group by 1 having max(ts) > timestamp '2024-01-20'")
def cache_live(spark, d):
    from .operators import enrichment

    e = spark.read.parquet(f"{d}/events.parquet").select(F.lit("agent").alias("kind"), F.col("user_id").cast("string").alias("key"), F.lit("s").alias("source"), F.col("value").alias("value"), F.col("ts").alias("fetched_at"), (F.col("ts") + F.expr("interval 10 days")).alias("expires_at"))
    empty = e.where("false")
    live = enrichment.cache_sweep(enrichment.cache_put(empty, e), F.lit("2024-01-30").cast("timestamp"))
    return live.select(F.col("key").cast("long").alias("user_id"), "value")




@query("gold_export", "select doc_id % 40 as query, coalesce(string_agg(distinct case when quality = 1 then cast(doc_id as varchar) end, ',' order by case when quality = 1 then cast(doc_id as varchar) end), '') as includes, count(distinct case when quality = 0 then doc_id end) as n_excludes from labels group by 1")
def gold_export(spark, d):
    labels = spark.read.parquet(f"{d}/labels.parquet").select((F.col("doc_id") % 40).alias("q"), F.col("doc_id").cast("string").alias("r"), "quality")
    g = quality.export_gold(labels, "q", "r", "quality")
    return g.select("query", F.array_join("includes", ",").alias("includes"), F.size("excludes").cast("long").alias("n_excludes"))


@query("authority_put_remove", "select s_suppkey as id, case when s_suppkey % 2 = 0 then concat('new ', s_name) else s_name end as canonical_name from supplier where s_suppkey % 3 <> 0 and s_suppkey not in (1, 2)")
def authority_put_remove(spark, d):
    cat = catalog(spark, d)
    table = cat.publisher_authorities.select("id", "canonical_name")
    new = table.where("id % 2 = 0").withColumn("canonical_name", F.concat(F.lit("new "), "canonical_name"))
    return authority.remove(authority.put(table, new), cat.publisher_variants, [1, 2])[0]
