"""A catalogue over order tables: orders are records, their lines imprints, suppliers printers.

``SQL`` has the same derivation for another engine, a query per table, so that what the operators
give can be checked against plain SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import tasks
from .catalog import Catalog

#: Tables in plain SQL, each over the raw tables only.
SQL = {
    "records": "select o_orderkey as id, lpad(cast(o_orderkey as varchar), 10, '0') as mms_id, o_orderdate as created_at from orders",
    "imprints": """select l_orderkey as record_id, l_linenumber as occurrence, cast(l_partkey as bigint) as part,
        cast(case when l_partkey % 17 = 0 then null else year(l_shipdate) - 400 end as integer) as date_start,
        cast(case when l_partkey % 19 = 0 then null when l_partkey % 23 = 0 then year(l_shipdate) - 402 when l_partkey % 29 = 0 then year(l_shipdate) - 280 else year(l_shipdate) - 400 + l_linenumber % 3 end as integer) as date_end,
        case when l_partkey % 4 = 0 then 'year_exact' when l_partkey % 4 = 1 then 'year_range' when l_partkey % 4 = 2 then 'hebrew_gematria' end as date_method,
        n_name as place_raw, lower(n_name) as place_norm, s_name as publisher_raw, replace(lower(s_name), '#', ' ') as publisher_norm, lower(r_name) as country_name,
        case when l_partkey % 31 = 0 then null else l_discount * 10 end as publisher_confidence
        from lineitem join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey""",
    "agents": """select l_orderkey as record_id, lower(s_name) as agent_norm, s_name as agent_raw, 'printer' as role_norm, 'corporate' as agent_type, concat('sup:', cast(s_suppkey as varchar)) as authority_uri
        from lineitem join supplier on s_suppkey = l_suppkey group by l_orderkey, s_name, s_suppkey
        union all select o_orderkey, lower(c_name), c_name, case when o_orderkey % 13 = 0 then null else 'author' end, case when o_orderkey % 500 = 0 then 'meeting' else 'personal' end, concat('cus:', cast(c_custkey as varchar)) from orders join customer on c_custkey = o_custkey""",
    "subjects": "select distinct l_orderkey as record_id, concat(p_type, ' -- ', p_brand, ' -- ', p_name) as value from lineitem join part on p_partkey = l_partkey",
    "titles": "select distinct l_orderkey as record_id, p_name as value from lineitem join part on p_partkey = l_partkey",
    "languages": "select o_orderkey as record_id, case o_orderkey % 5 when 0 then 'heb' when 1 then 'lat' when 2 then 'ita' else 'eng' end as code from orders where o_orderkey % 11 <> 0 union all select o_orderkey, 'ger' from orders where o_orderkey % 7 = 0",
    "notes": "select o_orderkey as record_id, '500' as tag, o_orderpriority as value from orders where o_orderkey % 3 <> 0 union all select o_orderkey, '520', o_orderstatus from orders where o_orderkey % 2 = 0",
    "physical_descriptions": "select distinct l_orderkey as record_id, concat(p_name, ' : ill. ; ', cast(p_size as varchar), ' cm') as value from lineitem join part on p_partkey = l_partkey where p_partkey % 5 = 0",
    "agent_authorities": "select s_suppkey as id, s_name as canonical_name, lower(s_name) as canonical_name_lower, concat('sup:', cast(s_suppkey as varchar)) as authority_uri from supplier where s_suppkey % 10 <> 9",
    "agent_aliases": "select 2 * s_suppkey as id, s_suppkey as authority_id, concat('press, no ', cast(s_suppkey as varchar)) as alias_form_lower from supplier where s_suppkey % 10 <> 9 union all select 2 * s_suppkey + 1, s_suppkey, concat('house of ', lower(n_name)) from supplier join nation on n_nationkey = s_nationkey where s_suppkey % 20 = 1",
    "publisher_authorities": "select s_suppkey as id, s_name as canonical_name, replace(lower(s_name), '#', ' ') as canonical_name_lower, case when s_suppkey % 4 = 0 then 'unresearched' else 'printing_house' end as type from supplier where s_suppkey % 3 <> 0",
    "publisher_variants": "select s_suppkey as authority_id, concat('officina ', cast(s_suppkey as varchar)) as variant_form_lower from supplier where s_suppkey % 3 <> 0",
    "enrichment": "select user_id, event_type, cast(regexp_extract(props, '([0-9]+)', 1) as integer) as k from events",
}


def with_sql(*tables: str) -> str:
    """A WITH clause of the named tables."""
    return "with " + ",\n".join(f"{t} as ({SQL[t]})" for t in tables) + "\n"


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    raw = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
    s = raw["supplier"].join(raw["nation"], F.col("s_nationkey") == F.col("n_nationkey")).join(raw["region"], F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "s_name", "n_name", "r_name")
    line = raw["lineitem"].select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_discount", F.year("l_shipdate").alias("y"))
    p, y = F.col("l_partkey"), F.col("y")
    null = F.lit(None)
    imprints = line.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("l_orderkey").alias("record_id"), F.col("l_linenumber").alias("occurrence"), p.alias("id"), p.alias("part"),
        F.when(p % 17 == 0, null).otherwise(y - 400).cast("int").alias("date_start"),
        F.when(p % 19 == 0, null).when(p % 23 == 0, y - 402).when(p % 29 == 0, y - 280).otherwise(y - 400 + F.col("l_linenumber") % 3).cast("int").alias("date_end"),
        F.when(p % 4 == 0, "year_exact").when(p % 4 == 1, "year_range").when(p % 4 == 2, "hebrew_gematria").alias("date_method"),
        F.col("n_name").alias("place_raw"), F.lower("n_name").alias("place_norm"), F.col("s_name").alias("publisher_raw"), F.replace(F.lower("s_name"), F.lit("#"), F.lit(" ")).alias("publisher_norm"), F.lower("r_name").alias("country_name"),
        F.when(p % 31 == 0, null).otherwise(F.col("l_discount") * 10).alias("publisher_confidence"), F.array(F.lit("260")).alias("source_tags"), null.cast("string").alias("date_label"), F.col("n_name").alias("place_display"), F.col("s_name").alias("publisher_display"), null.cast("string").alias("date_raw"),
    )
    uri = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string")).alias("authority_uri")
    n = tasks(raw["orders"])  # what a record has once is found where its rows are
    makers = line.select("l_orderkey", "l_suppkey").repartition(n, "l_orderkey").distinct().join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_orderkey").alias("record_id"), F.lower("s_name").alias("agent_norm"), F.col("s_name").alias("agent_raw"), F.lit("printer").alias("role_norm"), F.lit("corporate").alias("agent_type"), uri("sup", "s_suppkey"), F.col("s_suppkey").alias("id"))
    o = F.col("o_orderkey")
    writers = raw["orders"].join(raw["customer"], F.col("o_custkey") == F.col("c_custkey")).select(o.alias("record_id"), F.lower("c_name").alias("agent_norm"), F.col("c_name").alias("agent_raw"), F.when(o % 13 != 0, "author").alias("role_norm"), F.when(o % 500 == 0, "meeting").otherwise("personal").alias("agent_type"), uri("cus", "c_custkey"), (-F.col("c_custkey")).alias("id"))
    parts = line.select("l_orderkey", "l_partkey").join(raw["part"], F.col("l_partkey") == F.col("p_partkey"))
    rid = F.col("l_orderkey").alias("record_id")

    def numbered(df):  # ids like those of a table that grows: a record's values by their order, next to each other
        each = df.repartition(n, "record_id").groupBy("record_id").agg(F.sort_array(F.collect_set(F.struct("value"))).alias("values"))
        return each.select("record_id", F.posexplode("values").alias("at", "v")).select("record_id", "v.value", (F.col("record_id") * 65536 + F.col("at")).alias("id"))

    code = F.when(o % 5 == 0, "heb").when(o % 5 == 1, "lat").when(o % 5 == 2, "ita").otherwise("eng")
    languages = raw["orders"].where(o % 11 != 0).select(o.alias("record_id"), code.alias("code"), F.lit(0).alias("id")).unionByName(raw["orders"].where(o % 7 == 0).select(o.alias("record_id"), F.lit("ger").alias("code"), F.lit(1).alias("id")))
    notes = raw["orders"].where(o % 3 != 0).select(o.alias("record_id"), F.lit("500").alias("tag"), F.col("o_orderpriority").alias("value"), F.lit(0).alias("id")).unionByName(raw["orders"].where(o % 2 == 0).select(o.alias("record_id"), F.lit("520").alias("tag"), F.col("o_orderstatus").alias("value"), F.lit(1).alias("id")))
    k = F.col("s_suppkey")
    known = s.where(k % 10 != 9)
    aliases = known.select((2 * k).alias("id"), k.alias("authority_id"), F.concat(F.lit("press, no "), k.cast("string")).alias("alias_form_lower")).unionByName(s.where(k % 20 == 1).select((2 * k + 1).alias("id"), k.alias("authority_id"), F.concat(F.lit("house of "), F.lower("n_name")).alias("alias_form_lower")))
    publishers = s.where(k % 3 != 0)
    return Catalog(
        records=raw["orders"].select(o.alias("id"), F.lpad(o.cast("string"), 10, "0").alias("mms_id"), F.col("o_orderdate").alias("created_at")),
        imprints=imprints,
        titles=numbered(parts.select(rid, F.col("p_name").alias("value"))).withColumns({"title_type": F.lit("main"), "source": F.array(F.lit("245$a"))}),
        subjects=numbered(parts.select(rid, F.concat_ws(" -- ", "p_type", "p_brand", "p_name").alias("value"))),
        agents=makers.unionByName(writers), languages=languages, notes=notes,
        physical_descriptions=numbered(parts.where(F.col("p_partkey") % 5 == 0).select(rid, F.concat(F.col("p_name"), F.lit(" : ill. ; "), F.col("p_size").cast("string"), F.lit(" cm")).alias("value"))),
        agent_authorities=known.select(k.alias("id"), F.col("s_name").alias("canonical_name"), F.lower("s_name").alias("canonical_name_lower"), uri("sup", "s_suppkey")),
        agent_aliases=aliases.withColumn("alias_form", F.col("alias_form_lower")),
        publisher_authorities=publishers.select(k.alias("id"), F.col("s_name").alias("canonical_name"), F.replace(F.lower("s_name"), F.lit("#"), F.lit(" ")).alias("canonical_name_lower"), F.when(k % 4 == 0, "unresearched").otherwise("printing_house").alias("type"), F.col("n_name").alias("location")),
        publisher_variants=publishers.select(k.alias("authority_id"), F.concat(F.lit("officina "), k.cast("string")).alias("variant_form_lower")),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph of suppliers that share orders, for queries on graphs."""
    from ..operators import network

    return network.co_publication(catalog(spark, sf_dir))
