"""The bitmap index of facets against sets of record ids."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from quirelake.operators.bitmaps import Choice, FacetIndex
from quirelake.sources.catalog import COLUMNS, Catalog


def test_counts_equal_sets(spark, tmp_path):
    rng = random.Random(6)
    n = 500
    empty = {t: spark.createDataFrame([], COLUMNS[t]) for t in ("titles", "subjects", "agents", "notes", "physical_descriptions")}
    im = [(r, rng.choice(["Venice", "venice", "rome", None, ""]), rng.choice(["italy", None])) for r in range(n) for _ in range(rng.randint(0, 3))]
    la = [(r, rng.choice("abc")) for r in range(n) for _ in range(rng.randint(0, 2))]
    imprints = spark.createDataFrame(im, "record_id long, place_norm string, country_name string").withColumn("date_start", F.lit(None).cast("int"))
    cat = Catalog(records=spark.createDataFrame([(r * 7 - 900, f"m{r}") for r in range(n)], "id long, mms_id string").repartition(5), imprints=imprints.withColumn("record_id", F.col("record_id") * 7 - 900), languages=spark.createDataFrame([(r * 7 - 900, c) for r, c in la], "record_id long, code string"), **empty)
    have = defaultdict(set)
    for r, place, country in im:
        for facet, v in (("place", place), ("country", country)):
            if v:
                have[facet, v].add(r)
    for r, c in la:
        have["language", c].add(r)
    index = FacetIndex.build(cat, str(tmp_path / "i"), ("place", "country", "language"))
    every = set(range(n))

    def passes(c):
        hit = set().union(*(s for (f, v), s in have.items() if f == c.name and (v.lower() in c.values if c.part is None else c.part in v.lower())))
        return every - hit if c.negate else hit

    for choices in ([], [Choice("place", ("venice",))], [Choice("city", part="ven", negate=True), Choice("language", ("a", "b"))], [Choice("language", ("a",)), Choice("language", ("b",)), Choice("country", ("italy",))], [Choice("place", ("nowhere",))]):
        under = lambda cs: set.intersection(every, *map(passes, cs))
        assert {(r[0] + 900) // 7 for r in index.ids(choices).collect()} == under(choices)
        for own in (False, True):
            want = {(f, v): k for (f, v), s in have.items() if (k := len(s & under([c for c in choices if own or c.name != f])))}
            assert {(r["facet"], r["value"]): r["count"] for r in index.counts(choices, ("place", "country", "language"), own).collect()} == want
