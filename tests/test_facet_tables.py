"""Facet counts kept batch by batch against recounts, and invariants in one pass against one join each."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quirelake.operators import invariants, quality
from quirelake.operators.facet_tables import FacetTables
from quirelake.sources.catalog import COLUMNS, Catalog


def catalogue(spark, books):
    """books: {id: (imprints of (place, start, end, confidence), languages)}"""
    empty = {t: spark.createDataFrame([], COLUMNS[t]) for t in ("titles", "subjects", "agents", "notes", "physical_descriptions")}
    im = [(i, *x) for i, (ims, _) in books.items() for x in ims]
    return Catalog(
        records=spark.createDataFrame([(i, f"m{i}") for i in books], "id long, mms_id string"),
        imprints=spark.createDataFrame(im, "record_id long, place_norm string, date_start int, date_end int, publisher_confidence double"),
        languages=spark.createDataFrame([(i, c) for i, (_, ls) in books.items() for c in ls], "record_id long, code string"), **empty,
    )


def recount(books):
    want = Counter()
    for ims, ls in books.values():
        want["record", ""] += 1
        for facet, values in (("place", [x[0] for x in ims if x[0]]), ("language", [c for c in ls if c is not None]), ("first_year", [x[1] for x in ims]), ("last_year", [x[2] for x in ims])):
            for v in {v for v in values if v is not None}:
                want[facet, str(v)] += 1
        for x in ims:
            want["publisher_confidence_band", next(n for n, high in (("0.00-0.50", 0.5), ("0.50-0.80", 0.8), ("0.80-0.95", 0.95), ("0.95-0.99", 0.99), ("0.99-1.00", 2)) if (x[3] or 0) < high)] += 1
    return dict(want)


def got(tables):
    return {(r["facet"], r["value"]): r["count"] for r in tables.counts().collect()}


def test_ten_batches_a_correction_and_removals(spark, tmp_path, monkeypatch):
    rng, path = random.Random(8), str(tmp_path / "f")
    book = lambda: ([(rng.choice(["venice", "rome", "", None]), rng.choice([None, 1500, 1550, 2300]), rng.choice([None, 1510, 2400]), rng.choice([None, 0.5, 0.97, 1.0])) for _ in range(rng.randint(0, 3))], [rng.choice(["heb", "lat", None]) for _ in range(rng.randint(0, 2))])
    all_books, tables = {}, None
    for b in range(10):
        new = {b * 7 + i: book() for i in range(9)}  # two of each batch are corrected by the next
        all_books |= new
        cat = catalogue(spark, new)
        tables = tables.put(cat) if tables else FacetTables.create(cat, path, ("place", "language"), 4)
    assert got(tables) == recount(all_books) and len(tables.deltas) == 10
    gone = spark.createDataFrame([(3,), (3,), (40,), (9_999,), (None,)], "record_id long")
    before, tables = tables, tables.remove(gone)
    for i in (3, 40):
        del all_books[i]
    assert got(tables) == recount(all_books)
    again = tables.remove(gone).put(catalogue(spark, {}))  # what is not there changes nothing
    assert got(again) == recount(all_books)
    small = again.compact()
    assert got(small) == recount(all_books) and len(small.deltas) == 1
    assert (3 in all_books) is False and got(before)["record", ""] == len(all_books) + 2  # an earlier version keeps its counts
    place = {r["value"]: r["count"] for r in small.counts("city").collect()}
    assert place == {v: n for (f, v), n in recount(all_books).items() if f == "place"}
    assert "facet" in small.counts("place")._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: ")[1].split("]")[0]
    o = small.overview().first()
    assert (o["records"], o["place"], o["earliest"], o["latest"]) == (len(all_books), 2, 1500, 1510)

    def fails(*_):
        raise OSError("full")

    with monkeypatch.context() as m:  # sums are there, but the manifest is not
        m.setattr("quirelake.sources.versioned.VersionedTable._commit", fails)
        with pytest.raises(OSError):
            small.put(catalogue(spark, {500: book()}))
    assert got(FacetTables(spark, path)) == recount(all_books)


def test_one_record_less_empties_its_values(spark, tmp_path):
    tables = FacetTables.create(catalogue(spark, {1: ([("venice", 1500, 1500, 1.0)], ["heb"])}), str(tmp_path / "f"), ("place", "language"), 2)
    tables = tables.remove(spark.createDataFrame([(1,)], "record_id long"))
    assert got(tables) == {} and got(tables.compact()) == {} and tables.overview().first()["records"] == 0


def test_one_pass_finds_what_joins_find(spark, tmp_path):
    books = {i: ([("venice ", 1500, 1400, 1.0)] if i % 2 else [("rome", 1500, 1500, 1.0)], ["heb"]) for i in range(20)}
    cat, make = catalogue(spark, books), spark.createDataFrame
    cat.records = cat.records.unionByName(make([(30, "m1"), (31, None), (32, None)], "id long, mms_id string"))
    names = F.when(F.col("record_id") < 6, "twice").when(F.col("record_id") < 9, "Known").when(F.col("record_id") == 9, "once")
    cat.imprints = cat.imprints.withColumn("publisher_norm", names).withColumn("record_id", F.when(F.col("record_id") != 19, F.col("record_id"))).withColumn("country_name", F.lit("x")).withColumn("country_code", F.lit(None).cast("string"))
    cat.languages = cat.languages.unionByName(make([(77, "x"), (77, "y")], "record_id long, code string"))
    cat.agents = make([(1, "a", "personal", 1.5), (99, "b", "ghost", None), (None, None, None, 0.5)], "record_id long, agent_norm string, agent_type string, agent_confidence double").withColumns({"authority_uri": F.lit("u"), "role_norm": F.lit(None).cast("string")})
    cat.agent_authorities = make([(1, "Ab", "ab", "u"), (2, "Cd", "CD", "v")], "id long, canonical_name string, canonical_name_lower string, authority_uri string")
    cat.agent_aliases = make([(1, 1, "A", "a"), (2, 9, "A", "a"), (3, None, "É", "É")], "id long, authority_id long, alias_form string, alias_form_lower string")
    cat.publisher_authorities = make([(1, "Known")], "id long, canonical_name_lower string")
    cat.publisher_variants = make([(1, "v", "v"), (2, "V", "v"), (1, "w", "Odd"), (1, "x", "Known")], "authority_id long, variant_form string, variant_form_lower string")
    cat.network_nodes = make([("a", "person"), ("zz", "person"), (None, "person"), ("pub:Known", "publisher"), ("pub:lost", "publisher")], "agent_norm string, node_type string")
    cat.network_edges = make([("a", "a", "t", 0.5), ("a", "zz", "t", 2.0)], "source string, target string, type string, confidence double")
    stored = {}
    for t, df in cat.__dict__.items():
        if hasattr(df, "columns"):
            df.write.parquet(str(tmp_path / t))
            stored[t] = spark.read.parquet(str(tmp_path / t))
    cat = Catalog(**cat.__dict__ | stored)
    want = {r["id"]: r["violations"] for r in quality.violations(quality.invariants(cat)).collect()}
    assert {r["id"]: r["violations"] for r in invariants.violations(cat).collect()} == want
    assert {"P2": 1, "P6": 1, "A1": 1, "mms_id_unique": 2, "orphan_languages": 2, "orphan_imprints": 1, "N3": 1, "variant_unique": 1}.items() <= want.items()
    once = invariants.once(cat)
    plan = once._jdf.queryExecution().optimizedPlan().toString()
    tables = {f.table for r in invariants.rules(cat) for f in (r.fact, *r.parents)}
    assert plan.count("Relation [") == len(tables) and "Join" not in plan
    assert once.count() == len(invariants.rules(cat)) >= 24 and invariants.once(cat, set()).count() == 0
