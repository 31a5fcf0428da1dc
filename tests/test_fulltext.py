"""The stored full-text index against scans of the texts, and what of it a search reads."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quirelake.functions import text as text_functions
from quirelake.operators import fulltext, network

QUERIES = ["RÉD", "red wi*", "red red", "a b*", "שלום", "*", "no such", "re*d", "small ring of", "x-y"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    words = ["red", "réd", "small", "ring", "of", "widget", "widow", "שלום", "שָׁלוֹם", "οδός", "a", "b", "be", "x-y", "17", "!!", "ﬁn"]
    return [(f, i // 3, i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 8, 40])))) for f in ("title", "subject") for i in range(120)] + [("title", 900, 900, None), ("title", 901, 901, "שׁלום red red red")]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "field string, record_id long, row_id long, text string").cache()


def scan(frame, field, query, phrase):
    hit = text_functions.matches(F.coalesce("text", F.lit("")), query, phrase)
    return sorted(tuple(r) for r in frame.where((F.col("field") == field) & hit).select("record_id", "row_id").collect())


def test_searches_equal_scans(spark, frame, tmp_path):
    index = fulltext.FullText(spark, str(tmp_path / "i")).change(frame, bucket_rows=150)
    for query in QUERIES:
        for phrase in (True, False)[: 1 + (" " in query)]:
            for field in ("title", "subject")[: 1 + (query == "RÉD")]:
                assert sorted(tuple(r) for r in index.rows(field, query, phrase).collect()) == scan(frame, field, query, phrase), (query, phrase, field)
    got = {r["field"]: r for r in index.parity(frame).collect()}
    assert got["title"]["differing"] == got["subject"]["differing"] == 0 and got["title"]["tokens"] == got["title"]["postings"] > 100


def test_a_search_reads_its_buckets_alone(spark, frame, tmp_path):
    index = fulltext.FullText(spark, str(tmp_path / "i")).change(frame, bucket_rows=60)
    buckets = index.segments[0]["buckets"]
    assert len(buckets) > 10 and [b[1] for b in buckets] == sorted(b[1] for b in buckets)
    for query in ("small", "wid*", "red widget"):
        live = index.live("title", [t for run in fulltext.runs(query) for t in run])
        plan = live._sc._jvm.PythonSQLUtils.explainString(live._jdf.queryExecution(), "formatted")
        assert re.search(r"PartitionFilters: \[.*bucket", plan) and "token" in plan.split("PushedFilters")[1]
        named = re.search(r"PartitionFilters: \[.*?bucket#\d+ (?:IN \(([\d,]+)\)|= (\d+))", plan)
        assert len((named[1] or named[2]).split(",")) < len(buckets) / 2, query


def test_changes_come_in_segments(spark, frame, tmp_path):
    path = str(tmp_path / "i")
    first = fulltext.FullText(spark, path).change(frame, bucket_rows=150)
    some = frame.where("row_id % 4 = 0")
    new = some.withColumn("text", F.lit("entirely new"))
    second = first.change(new, gone=some)
    third = second.change(gone=frame.where("row_id % 4 = 1 and field = 'title'"))
    now = frame.where("row_id % 4 != 0").where("not (row_id % 4 = 1 and field = 'title')").unionByName(new)
    for index in (third, third.compact(), fulltext.FullText(spark, path)):
        for query in ("red", "entirely new", "small ring"):
            assert sorted(tuple(r) for r in index.rows("title", query).collect()) == scan(now, "title", query, True)
        assert all(r["differing"] == 0 for r in index.parity(now).collect())
    assert sorted(tuple(r) for r in first.rows("title", "red").collect()) == scan(frame, "title", "red", True)  # readers of an earlier version
    assert any(r["differing"] for r in first.parity(now).collect())
    spark.createDataFrame([("broken",)], "value string").write.text(f"{path}/manifest/v99")
    (tmp_path / "i" / "manifest" / "v99" / "_SUCCESS").unlink()
    assert fulltext.FullText(spark, path).version == 4  # a manifest that was not finished is not there


def test_an_empty_index(spark, frame, tmp_path):
    assert fulltext.FullText(spark, str(tmp_path / "none")).rows("title", "red").count() == 0
    index = fulltext.FullText(spark, str(tmp_path / "i")).change(frame.where("false"))
    assert index.rows("title", "red widget").count() == 0 and index.parity(frame.where("false")).count() == 0


@pytest.mark.parametrize("width, cell", [(10, 2000), (3, 4), (50, 1)])
def test_overlaps_equal_all_against_all(spark, width, cell):
    rng = random.Random(width)
    spans = [(rng.randrange(3), i, lo := rng.randint(-40, 60), lo + rng.choice([0, 3, 10, 30, 80])) for i in range(120)]
    got = [tuple(r) for r in network.overlaps(spark.createDataFrame(spans, "place long, agent long, lo int, hi int"), 5, width, cell).collect()]
    want = {(p, a, b, max(s, t), min(e, f)) for p, a, s, e in spans for q, b, t, f in spans if p == q and a < b and min(e, f) - max(s, t) >= 5}
    assert len(got) == len(set(got)) and set(got) == want



@pytest.mark.parametrize("cell", [8000, 3])
def test_contemporaries_of_a_crowded_place(spark, cell):
    """Cells meet each pair once, and a missing year is left to the other's."""
    rng = random.Random(cell)
    people = [(f"p{i:03}", rng.choice(["Rome", "rome", "Ulm", None]), rng.choice([None, rng.randrange(1500, 1600)]), rng.choice([None, rng.randrange(1560, 1650)])) for i in range(90)]
    got = [tuple(r) for r in network.lifespan_overlap(spark.createDataFrame(people, "agent_norm string, birth_place string, birth_year int, death_year int"), cell).collect()]
    of = lambda f, *ys: f([y for y in ys if y is not None], default=None)
    want = {(a, b) for a, p, ab, ad in people for b, q, bb, bd in people if a < b and p and q and p.lower() == q.lower() and (s := of(max, ab, bb)) is not None and (e := of(min, ad, bd)) is not None and s <= e}
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("cell", [2000, 3])
def test_pairs_of_an_earlier_place_are_left_out(spark, cell):
    """What is told of other places takes the place of bringing pairs together, which would move them all."""
    rng = random.Random(cell)
    spans = {(p, i): (lo := rng.randint(1500, 1560), lo + rng.choice([3, 10, 30])) for p in range(4) for i in range(40) if rng.random() < 0.7}
    rows = [(p, i, lo, hi, [(q, *spans[q, i]) for q in range(p) if (q, i) in spans]) for (p, i), (lo, hi) in spans.items()]
    found = network.overlaps(spark.createDataFrame(rows, "place long, agent long, lo int, hi int, before array<struct<place: long, lo: int, hi: int>>"), 5, 10, cell)
    want = {}
    for (p, a), (s, e) in sorted(spans.items()):
        for b in range(a + 1, 40):
            if (p, b) in spans and min(e, spans[p, b][1]) - max(s, spans[p, b][0]) >= 5:
                want.setdefault((a, b), (p, max(s, spans[p, b][0]), min(e, spans[p, b][1])))
    got = {(r["a"], r["b"]): (r["place"], r["s"], r["e"]) for r in found.collect()}
    assert found.count() == len(got) and got == want
