"""What must not grow with the input: the work of one task, and how often tables are read."""

from __future__ import annotations

import os
from collections import Counter

from pyspark.sql import functions as F

from quirelake import queries_fulltext, queries_quality, shared
from quirelake.operators import facet_tables, facets, fulltext, network
from quirelake.sources import versioned
from quirelake.sources.driver_tables import catalog
from quirelake.sources.versioned import VersionedTable

D = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_tasks_grow_with_the_records(spark, monkeypatch):
    monkeypatch.setattr(shared, "MOST_RECORDS", 10)
    assert shared.tasks(spark.range(1001)) == 101 and shared.tasks(spark.range(0)) == 1
    pairs = network.co_publication(catalog(spark, D))
    assert "RepartitionByExpression [a" in plan(pairs).replace("a#", "a") and "count(distinct" not in plan(pairs)


def test_members_read_each_table_once(spark, tmp_path):
    cat = catalog(spark, D)
    for t in ("records", "imprints", "agents", "languages", "subjects"):
        getattr(cat, t).write.parquet(str(tmp_path / t))
        setattr(cat, t, spark.read.parquet(str(tmp_path / t)))
    got = facet_tables.members(cat)
    assert plan(got).count("Relation [") == 5
    counts = {(r["facet"], r["value"]): r["n"] for r in got.select(F.explode("counts").alias("c")).groupBy("c.facet", "c.value").agg(F.count("*").alias("n")).collect()}
    for f in ("publisher", "date_decade", "agent_role"):
        want = {(f, r["value"]): r["count"] for r in facets.facet(cat, f).collect() if r["value"] is not None}
        assert want and {k: v for k, v in counts.items() if k[0] == f} == want


def test_a_large_bucket_has_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versioned, "MOST_RECORDS", 20)
    rows = spark.range(400).select("id", (F.col("id") * 2).alias("v"))
    table = VersionedTable.create(rows, str(tmp_path / "t"), ["id"], 2).put(rows.where("id < 50").withColumn("v", F.lit(-1).cast("long")))
    files = Counter(os.path.dirname(f) for f in table.read().inputFiles())
    assert len(files) == 2 and min(files.values()) > 3
    assert {r["id"]: r["v"] for r in table.read().collect()} == {i: -1 if i < 50 else 2 * i for i in range(400)}


def test_a_segment_knows_its_postings(spark, tmp_path):
    texts = spark.createDataFrame([("title", 1, 1, " red  widget "), ("title", 2, 2, ""), ("title", 3, 3, "blue")], "field string, record_id long, row_id long, text string")
    index = fulltext.FullText(spark, str(tmp_path / "i")).change(texts, bucket_rows=2)
    assert [s["postings"] for s in index.segments] == [3] and index.compact().segments[0]["postings"] == 3
    assert [tuple(r) for r in index.parity(texts).collect()] == [("title", 2, 2, 3, 3, 0)]


def test_a_histogram_counts_what_is_distinct(spark):
    h = facets.histogram(catalog(spark, D), "place")
    assert "count(distinct" not in plan(h) and h.where("count < 1").isEmpty()


def test_a_network_is_stored_before_its_invariants(spark):
    cat = queries_quality._broken(spark, D)
    assert all("edges-" in f for f in cat.network_edges.inputFiles()) and cat.network_edges.inputFiles() and cat.network_nodes.inputFiles()


def test_degrees_read_the_edges_once(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "b"), ("c", "b")], "source string, target string")
    got = network.degrees(e)
    assert {r["agent_norm"]: r["degree"] for r in got.collect()} == {"a": 1, "b": 3, "c": 1} and "Union" not in plan(got)


def test_a_path_does_not_shuffle_all_edges(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "a"), ("c", "c")], "source string, target string")
    step = network._next(network._pairs(e, False), spark.createDataFrame([("b",)], "agent_norm string"))
    assert {tuple(r) for r in step.collect()} == {("a", "b"), ("c", "b")} and "Distinct" not in plan(step) and plan(step).count("Aggregate") == 1
    assert network.path(e, "a", "c", stored=True) == network.path(e, "a", "c") == [("a", "b"), ("b", "c")]


def test_orphans_are_dropped_in_tasks_by_the_edges(spark, monkeypatch):
    monkeypatch.setattr(shared, "MOST_RECORDS", 10)
    e = spark.range(95).selectExpr("concat('n', id) as source", "concat('n', id + 1) as target")
    got = network.drop_orphans(e, spark.range(2, 60).selectExpr("concat('n', id) as agent_norm"))
    assert plan(got).count("RepartitionByExpression [source") == 1 and plan(got).count("], 10") == 4
    assert {int(r["source"][1:]) for r in got.collect()} == set(range(2, 59))


def test_edges_are_merged_in_tasks_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(shared, "MOST_RECORDS", 10)
    e = spark.range(40).selectExpr("concat('n', id % 20) as source", "'x' as target", "'k' as type", "cast(id as string) as evidence", "1.0D as confidence")
    got = network.merge_edges([e, e.withColumn("confidence", F.lit(0.0))])
    assert plan(got).count("RepartitionByExpression") == 1 and plan(got).count("], 8") == 1
    assert {r["source"]: (r["evidence"], r["confidence"]) for r in got.collect()} == {f"n{i}": (min(str(i), str(i + 20)), 1.0) for i in range(20)}


def test_alike_spans_meet_as_arrays(spark, monkeypatch):
    """What is decided of spans is decided for those that are alike at once, and they are moved together."""
    spans = spark.range(600).selectExpr("'rome' as place", "concat('n', id) as agent", "1500 as lo", "1600 as hi", "if(id % 2 = 0, array(named_struct('place', 'acre', 'lo', 1500, 'hi', 1600)), array()) as before")
    monkeypatch.setattr(network, "BLOCK", 256)
    met = network._overlapping(spans, 10)
    assert met.count() == 12  # two arrays of each kind; those of even agents met before
    got = network.overlaps(spans, 10)
    assert got.count() == got.select("a", "b").distinct().count() == 600 * 599 // 2 - 300 * 299 // 2
    monkeypatch.setattr(network, "BLOCK", 7)
    assert network.overlaps(spans, 10, cell=40).exceptAll(got).isEmpty() and network.overlaps(spans, 10, cell=40).count() == got.count()


def test_contemporaries_meet_as_arrays(spark):
    people = spark.range(400).selectExpr("concat('p', id) as agent_norm", "'Rome' as birth_place", "1500 as birth_year", "1560 as death_year")
    pairs = network.lifespan_overlap(people)
    assert pairs.count() == 400 * 399 // 2 and pairs.where("a >= b").isEmpty()
    assert plan(pairs).count("Generate explode(xs") == plan(pairs).count("Generate explode(ys") == 1


def test_members_are_moved_as_rows_of_their_tables(spark):
    """A row's values are told apart after the shuffle, not one row each before it."""
    got = plan(facet_tables.members(catalog(spark, D)))
    assert got.index("Generate posexplode(values") < got.index("RepartitionByExpression [record_id")


def test_wide_rows_are_written_as_they_come(spark, tmp_path):
    rows = spark.range(400).select("id", (F.col("id") * 2).alias("v"))
    table = VersionedTable.create(rows, str(tmp_path / "t"), ["id"], 3, wide=True)
    was = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    table = table.put(rows.where("id < 50").withColumn("v", F.lit(-1).cast("long")), wide=True).remove(rows.where("id >= 390"), wide=True)
    assert {r["id"]: r["v"] for r in table.read().collect()} == {i: -1 if i < 50 else 2 * i for i in range(390)}
    with shared.setting(spark, "spark.sql.maxConcurrentOutputFileWriters", 3):
        assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "3"
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == was


def test_rows_of_a_record_have_ids_side_by_side(spark):
    """An index of texts holds an id for each token, so ids that are hashes would be most of it."""
    for t in ("titles", "subjects", "physical_descriptions"):
        rows = getattr(catalog(spark, D), t)
        n, ids, most, wrong = rows.agg(F.count("*"), F.count_distinct("id"), F.max(F.col("id") - F.col("record_id") * 65536), F.count_if(F.shiftright("id", 16) != F.col("record_id"))).first()
        assert n == ids == rows.select("record_id", "value").distinct().count() > 0 and most < 20 and wrong == 0


def test_parity_reads_the_texts_that_the_index_is_made_of(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(fulltext.FullText, "parity", lambda self, rows: seen.append(rows) or rows)
    queries_fulltext.index_parity(spark, D)
    assert all("/texts-" in f for f in seen[0].inputFiles()) and seen[0].inputFiles()


def test_wide_rows_meet_their_keys_once(spark, tmp_path):
    rows = spark.range(60).select("id", F.col("id").alias("v"))
    table = VersionedTable.create(rows, str(tmp_path / "t"), ["id"], 2, wide=True)
    held, rest = table.split(spark.createDataFrame([(3,), (7,), (99,), (None,)], "id long"))
    assert all("/split-" in f for d in (held, rest) for f in d.inputFiles()) and rest.inputFiles()
    assert sorted(r["id"] for r in held.collect()) == [3, 7] and rest.count() == 58
    assert table.remove(held, wide=True, rest=rest).read().count() == 58 and table.read().count() == 60
