"""Filters, plans, facets, display and resolution on a small catalogue of seven records."""

import decimal
import difflib
import itertools
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quirelake.functions import text as text_functions
from quirelake.operators import authority, display, enrichment, facets, network, quality, resolve
from quirelake.plans import compile as compiler
from quirelake.plans.filters import FIELDS, OPS, Filter, PlanError, QueryPlan, coerce, normal_value, warnings
from quirelake.plans.steps import Executor, Result, Step, order
from quirelake.sources import catalog as catalog_module
from quirelake.sources.catalog import Catalog, differences
from quirelake.sources.driver_tables import with_sql

KARO = "קארו, יוסף"


@pytest.fixture(scope="module")
def cat(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema).cache()
    ids = [(1, "990001234"), (2, "990005678"), (3, "990009999"), (4, "990111111"), (5, "990222222"), (6, "990333333"), (7, "990444444")]
    im = [(1, 1, 0, 1565, 1565, "venice", "bragadin", "italy"), (2, 2, 0, 1698, 1698, "amsterdam", "proops", "netherlands"), (3, 3, 0, 1520, 1523, "venice", "bomberg", "italy"), (4, 4, 0, 1714, None, "amsterdam", "visscher", "netherlands")]
    im = [(*x, 0.95, ["260"], None, x[5].title(), x[6].title(), x[6]) for x in im]
    return Catalog(
        records=make(ids, "id long, mms_id string"),
        imprints=make(im, "id long, record_id long, occurrence int, date_start int, date_end int, place_norm string, publisher_norm string, country_name string, publisher_confidence double, source_tags array<string>, date_label string, place_display string, publisher_display string, publisher_raw string"),
        titles=make([(1, 1, "main", "Shulchan Aruch", ["245$a"]), (2, 2, "main", "Beit Yosef", ["245$a"]), (3, 3, "main", "Talmud Bavli", ["245$a"]), (4, 4, "main", "Palaestina illustrata", ["245$a"])], "id long, record_id long, title_type string, value string, source array<string>"),
        subjects=make([(1, 1, "Jewish law", None), (2, 3, "Talmud", None), (3, 4, "Bible -- Geography -- Early works to 1800", None), (4, 5, "Art -- History", None), (5, 6, "Limited editions", None), (6, 7, "x", "הלכה")], "id long, record_id long, value string, value_he string"),
        agents=make([(1, 1, 0, KARO, KARO, "personal", "author", "u1"), (2, 1, 1, "Bomberg, Daniel", "bomberg, daniel", "personal", "printer", "u2"), (3, 2, 0, KARO, KARO, "personal", "author", "u1"), (4, 3, 0, "Bomberg, Daniel", "bomberg, daniel", "personal", "printer", "u2")], "id long, record_id long, agent_index int, agent_raw string, agent_norm string, agent_type string, role_norm string, authority_uri string"),
        languages=make([(1, 1, "heb", ["041[0]$a"]), (2, 2, "heb", ["041[0]$a"]), (3, 3, "heb", ["041[0]$a"]), (4, 4, "lat", ["041[0]$a"]), (5, 1, "lat", ["041[0]$a"])], "id long, record_id long, code string, source array<string>"),
        notes=make([(1, 1, "500", "a note"), (2, 1, "520", "an abstract")], "id long, record_id long, tag string, value string"),
        physical_descriptions=make([(1, 4, "2 v. : ill., 10 folded maps")], "id long, record_id long, value string"),
        agent_authorities=make([(1, "Karo, Joseph", "karo, joseph", "u1"), (2, "Bomberg, Daniel", "bomberg, daniel", "u2")], "id long, canonical_name string, canonical_name_lower string, authority_uri string"),
        agent_aliases=make([(1, 1, "Joseph Karo", "joseph karo"), (2, 1, "Caro, Joseph", "caro, joseph"), (3, 2, "Daniel Bomberg", "daniel bomberg")], "id long, authority_id long, alias_form string, alias_form_lower string"),
        publisher_authorities=make([(1, "Bragadin, Venice", "bragadin, venice", "printing_house", "Venice, Italy")], "id long, canonical_name string, canonical_name_lower string, type string, location string"),
        publisher_variants=make([(1, "bragadin"), (1, "giovanni di gara for bragadin")], "authority_id long, variant_form_lower string"),
        authority_enrichment=make([("u1", "Q1", "Joseph Karo", "a codifier", '{"birth_year": 1488, "death_year": 1575, "birth_place": "Toledo", "occupations": ["rabbi"], "students": ["Daniel Bomberg"]}', None, None), ("u2", "Q2", "Daniel Bomberg", None, '{"birth_year": 1483, "death_year": 1549, "birth_place": "Antwerp", "occupations": ["printer"]}', "img", None)], "authority_uri string, wikidata_id string, label string, description string, person_info string, image_url string, wikipedia_url string"),
    )


def ids(cat, *filters, limit=None):
    return sorted(r["mms_id"] for r in compiler.ids(cat, QueryPlan(list(filters), limit=limit)).collect())


A, B, C, D, E, G, H = "990001234", "990005678", "990009999", "990111111", "990222222", "990333333", "990444444"
MATRIX = [
    (Filter("publisher", "EQUALS", "Bragadin"), [A]), (Filter("publisher", "CONTAINS", "BO"), [C]), (Filter("publisher", "IN", ["proops", "[visscher],"]), [B, D]), (Filter("publisher", "EQUALS", "bragadin", negate=True), [B, C, D]),
    (Filter("imprint_place", "EQUALS", "VENICE"), [A, C]), (Filter("imprint_place", "CONTAINS", "dam"), [B, D]), (Filter("imprint_place", "IN", ["venice", "amsterdam"]), [A, B, C, D]),
    (Filter("country", "EQUALS", "Italy"), [A, C]), (Filter("country", "CONTAINS", "land"), [B, D]), (Filter("country", "IN", ["italy"], negate=True), [B, D]),
    (Filter("year", "RANGE", start=1522, end=1600), [A, C]), (Filter("year", "IN", ["1521", "1698"]), [B, C]), (Filter("year", "RANGE", start=1500, end=1600, negate=True), [B, D]),
    (Filter("language", "EQUALS", "HEB"), [A, B, C]), (Filter("language", "IN", ["lat"]), [A, D]), (Filter("language", "CONTAINS", "a"), [A, D]), (Filter("language", "EQUALS", "heb", negate=True), [A, D]),
    (Filter("title", "EQUALS", "beit yosef"), [B]), (Filter("title", "CONTAINS", "aruch"), [A]), (Filter("title", "IN", ["Talmud Bavli", "none"]), [C]), (Filter("title", "CONTAINS", "aruch", negate=True), [B, C, D, E, G, H]),
    (Filter("subject", "EQUALS", "jewish law"), [A]), (Filter("subject", "CONTAINS", "bible geography"), [D]), (Filter("subject", "CONTAINS", "edition"), []), (Filter("subject", "CONTAINS", "הלכה"), [H]), (Filter("subject", "IN", ["talmud", "limited editions"]), [C, G]),
    (Filter("physical_desc", "CONTAINS", "Maps"), [D]), (Filter("physical_desc", "IN", ["plates", "folded"]), [D]), (Filter("physical_desc", "CONTAINS", "maps", negate=True), [A, B, C, E, G, H]),
    (Filter("agent", "CONTAINS", "bomberg"), [A, C]), (Filter("agent_norm", "EQUALS", "Bomberg, Daniel"), [A, C]), (Filter("agent_norm", "EQUALS", "Joseph Karo"), [A, B]), (Filter("agent_norm", "CONTAINS", "caro"), [A, B]), (Filter("agent_norm", "IN", ["daniel bomberg", "nobody"]), [A, C]),
    (Filter("agent_role", "EQUALS", "printer"), [A, C]), (Filter("agent_role", "CONTAINS", "auth"), [A, B]), (Filter("agent_role", "EQUALS", "printer", negate=True), [A, B]), (Filter("agent_type", "EQUALS", "personal"), [A, B, C]), (Filter("agent_type", "IN", ["corporate"]), []), (Filter("agent_type", "CONTAINS", "person"), [A, B, C]), (Filter("agent_role", "IN", ["author", "binder"]), [A, B]),
]


@pytest.mark.parametrize("f, want", MATRIX, ids=[f"{f.field}-{f.op}-{f.negate}-{i}" for i, (f, _) in enumerate(MATRIX)])
def test_matrix(cat, f, want):
    assert ids(cat, f) == want


def test_all_cells_are_taken_or_refused():
    taken = {(f.field, f.op) for f, _ in MATRIX}
    for field in FIELDS:
        for op in OPS:
            if (field, op) in taken:
                continue
            with pytest.raises(PlanError):
                Filter(field, op, "x" if op != "IN" else ["x"], start=1, end=2)


def test_filters_on_one_table_hold_for_one_row(cat):
    assert ids(cat, Filter("agent_role", "EQUALS", "author"), Filter("agent_norm", "EQUALS", "bomberg, daniel")) == []
    # an alias holds for the record, whichever of its agents the row is about
    assert ids(cat, Filter("agent_role", "EQUALS", "author"), Filter("agent_norm", "CONTAINS", "bomberg")) == [A]
    assert ids(cat, Filter("agent_role", "EQUALS", "printer"), Filter("agent_norm", "CONTAINS", "bomberg"), Filter("year", "RANGE", start=1500, end=1530)) == [C]
    assert ids(cat) == [A, B, C, D, E, G, H] and ids(cat, limit=2) == [A, B]


def test_rows_have_evidence(cat):
    plan = QueryPlan([Filter("publisher", "EQUALS", "bragadin"), Filter("year", "RANGE", start=1500, end=1599), Filter("language", "IN", ["heb", "lat"])])
    rows = compiler.rows(cat, plan).collect()
    assert len(rows) == 2 and {r["mms_id"] for r in rows} == {A}
    e = rows[0]["evidence"]
    assert (e[0]["field"], e[0]["operator"], e[0]["source"], e[0]["confidence"]) == ("publisher_norm", "=", "db.imprints.publisher_norm (marc:260)", 0.95)
    assert e[1]["value"] == "1565-1565" and e[1]["matched_against"] == "1500-1599"
    assert rows[0]["rationale"].startswith("publisher_norm='bragadin' AND year_range=1565-1565 overlaps 1500-1599 AND language=")
    assert plan.hash == QueryPlan(plan.filters).hash


def test_evidence_tells_tag_and_occurrence(cat, spark):
    for kind, row in (("array<string>", "array('700[1]$a')"), ("array<struct<source:string>>", "array(named_struct('source', '700[1]'))"), ("array<struct<tag:string,occurrence:int>>", "array(named_struct('tag', '700', 'occurrence', 1))"), ("array<struct<source:struct<tag:string,occurrence:int>>>", "array(named_struct('source', named_struct('tag', '700', 'occurrence', 1)))")):
        own = Catalog(**cat.__dict__)
        own.agents = cat.agents.withColumn("provenance", F.expr(f"cast({row} as {kind})"))
        got = compiler.rows(own, QueryPlan([Filter("agent_type", "EQUALS", "personal")])).first()["evidence"][0]["source"]
        assert got.startswith("db.agents.agent_type (marc:700[1]"), kind


def test_coercion_and_validation():
    assert coerce({"field": "year", "op": "EQUALS", "value": "1565"}) == Filter("year", "RANGE", start=1565, end=1565)
    assert coerce({"field": "title", "op": "EQUALS", "value": ["a", " ", 3]}) == Filter("title", "IN", ["a", "3"])
    assert coerce({"field": "title", "op": "IN", "value": "a"}) == Filter("title", "IN", ["a"]) and coerce({"field": "title", "op": "EQUALS", "value": " "}) is None
    for bad in ({"op": "RANGE", "start": 1600, "end": 1500}, {"op": "IN", "value": ["x"]}, {"op": "RANGE"}):
        with pytest.raises(PlanError):
            Filter("year", **bad)
    with pytest.raises(PlanError):
        QueryPlan.from_dict({"filters": [], "colour": 1})
    assert normal_value("publisher", " [Proops], & Sons,") == "proops, sons" and normal_value("agent_norm", "Karo, Joseph.") == "karo joseph"
    assert len(warnings([Filter("year", "RANGE", start=1000, end=1900, confidence=0.5), Filter("title", "CONTAINS", "ab")])) == 3


def test_facets_and_comparison(cat):
    top = [(r["value"], r["count"]) for r in facets.facet(cat, "city", 5).collect()]
    assert top == [("amsterdam", 2), ("venice", 2)]
    assert [r["value"] for r in facets.facet(cat, "date_century").orderBy("value").collect()] == ["16th century", "17th century", "18th century"]
    groups = facets.members(cat, "place", ["Venice", "Amsterdam"])
    assert {(r["group"], r["count"], r["earliest"]) for r in facets.compare_dates(cat, groups).collect()} == {("venice", 2, 1520), ("amsterdam", 2, 1698)}
    assert [r["value"] for r in facets.compare_shared(cat, groups, "agent", 2).collect()] == [KARO]
    assert [(r["value"], r["count"]) for r in facets.compare(cat, "place", ["venice", "rome"]).orderBy("value").collect()] == [("rome", 0), ("venice", 2)]
    scope = cat.records.select(F.col("id").alias("record_id"))
    assert facets.refine(cat, scope, "year", "RANGE", start=1500, end=1600).count() == 2 and facets.refine(cat, scope, "year", "EQUALS", "1").count() == 7


def test_display_samples_and_records(cat):
    d = {r["mms_id"]: r for r in display.display(cat).collect()}
    assert (d[A]["title"], d[A]["author"], d[A]["description"], d[A]["subjects"]) == ("Shulchan Aruch", KARO, "an abstract", ["Jewish law"]) and d[E]["title"] is None
    assert [r["mms_id"] for r in display.earliest(cat, None, 5).collect()] == [C, A, B, D, E]
    assert [r["mms_id"] for r in display.diverse(cat, None, 3).collect()] == [C, A, B]
    g = display.grounding(cat, cat.records.select(F.col("id").alias("record_id")), 2).collect()
    assert [r["mms_id"] for r in g] == [A, B] and g[0]["notes"] == ["a note", "an abstract"]
    full = display.full_record(cat, A).first()
    assert len(full["languages"]) == 2 and display.full_record(cat, "none").count() == 0


def test_notable_equals_a_choice_over_everything(cat):
    rows = {r["mms_id"]: r for r in display.curation_scores(cat).withColumn("decade", F.floor(F.col("date_start") / 10) * 10).collect()}
    chosen, seen = [], {"decade": set(), "place_norm": set(), "language": set()}
    while len(chosen) < 4:
        worth = lambda r: r["score"] + 0.2 * sum(x for c, x in (("decade", 0.34), ("place_norm", 0.33), ("language", 0.33)) if r[c] and r[c] not in seen[c])
        best = min((r for m, r in rows.items() if m not in chosen), key=lambda r: (-worth(r), r["mms_id"]))
        chosen.append(best["mms_id"])
        for c in seen:
            seen[c].add(best[c])
    assert [r["mms_id"] for r in display.notable(cat, None, 4)] == chosen


def test_resolution(cat):
    assert [tuple(r) for r in resolve.agent(cat, "Joseph  Karo").collect()] == [(KARO, "alias_exact", 0.95)]
    assert resolve.agent(cat, "Karo, Joseph").first()["method"] == "canonical_exact" and resolve.agent(cat, "daniel").first()["method"] == "alias_parts" and resolve.agent(cat, "nobody").count() == 0
    assert resolve.publisher(cat, "Giovanni di Gara for Bragadin").first()["publisher_norm"] == "bragadin" and resolve.publisher(cat, "vissch").first()["method"] == "imprint_substring"
    assert resolve.stem_variants("old map") == ["old maps", "old mapes"] and resolve.stem_variants("churches") == ["church", "churche"]
    assert resolve.split_values(Filter("imprint_place", "EQUALS", "Venice, Rome")).value == ["Venice, Rome", "Venice", "Rome"]


def test_plans_of_steps(cat):
    steps = [
        Step("aggregate", {"field": "language", "scope": "$step_1+$step_2"}), Step("retrieve", {"filters": [{"field": "imprint_place", "op": "EQUALS", "value": "venice"}]}),
        Step("retrieve", {"filters": [{"field": "agent_norm", "op": "IN", "value": "$step_3"}]}), Step("resolve_agent", {"name": "Joseph Karo"}), Step("sample", {"scope": "$step_1", "n": 1}), Step("dance"),
        Step("find_connections", {"agents": ["$step_3", "Daniel Bomberg"]}), Step("enrich", {"agents": "$step_3"}), Step("retrieve", {"filters": []}), Step("aggregate", {"field": "colour"}),
    ]
    done = Executor(cat).run(steps)
    assert {(r["value"], r["count"]) for r in done[0].table.collect()} == {("heb", 3), ("lat", 1)}
    assert [r["mms_id"] for r in done[2].table.orderBy("mms_id").collect()] == [A, B] and [r["mms_id"] for r in done[4].table.collect()] == [C]
    assert done[5].status == "error" and done[8].status == "empty" and done[9].status == "empty"
    assert [r["relationship"] for r in done[6].table.collect()] == ["teacher_of"]
    profile = done[7].table.first()
    assert profile["birth_year"] == 1488 and profile["aliases"] == ["Caro, Joseph", "Joseph Karo"]
    for bad in ([Step("retrieve", {"scope": "$step_0"})], [Step("retrieve", {"scope": "$step_1"}), Step("retrieve", {"scope": "$step_0"})], [Step("retrieve", {"scope": "$step_9"})]):
        with pytest.raises(PlanError):
            order(bad)


def test_relaxation_and_recovery(cat):
    run = lambda fs, **k: Executor(cat, **k).run([Step("retrieve", {"filters": fs})])[0]
    loose = run([{"field": "publisher", "op": "EQUALS", "value": "brag"}])
    assert [r["mms_id"] for r in loose.table.collect()] == [A] and loose.notes
    either = run([{"field": "subject", "op": "CONTAINS", "value": "talmud"}, {"field": "subject", "op": "CONTAINS", "value": "jewish law"}])
    assert sorted(r["mms_id"] for r in either.table.collect()) == [A, C]
    concept = run([{"field": "subject", "op": "CONTAINS", "value": "holy land"}], concepts={"holy land": ["bible geography"]})
    assert [r["mms_id"] for r in concept.table.collect()] == [D]
    number = run([{"field": "subject", "op": "CONTAINS", "value": "limited edition"}])
    assert [r["mms_id"] for r in number.table.collect()] == [G]
    lost = Executor(cat).run([Step("resolve_publisher", {"name": "Zzz Visscher"}), Step("retrieve", {"filters": [{"field": "publisher", "op": "IN", "value": "$step_0"}]})])
    assert [r["mms_id"] for r in lost[1].table.collect()] == [D]


def test_network(cat):
    same = {(r["source"], r["target"]): r for r in network.same_record(cat).collect()}
    assert same[("bomberg, daniel", KARO)]["relationship"] == "printed for" and same[("bomberg, daniel", KARO)]["confidence"] == pytest.approx(0.8)
    taught = network.teacher_student(cat).collect()
    assert [(r["source"], r["target"]) for r in taught] == [(KARO, "bomberg, daniel")]
    assert {r["agent_norm"]: r["display_name"] for r in network.display_names(cat).collect()}[KARO] == "Karo, Joseph"
    assert network.printed_by(cat).first()["target"] == "pub:Bragadin, Venice"
    geo = cat.records.sparkSession.createDataFrame([("venice", 45.4, 12.3)], "place string, lat double, lon double")
    assert {r["agent_norm"] for r in network.nodes(cat, geo).collect()} == {KARO, "bomberg, daniel"} and network.publisher_nodes(cat, geo).count() == 1
    found = network.search(cat, "caro").collect()
    assert [(r["agent_norm"], r["via_alias"], r["alias_form"]) for r in found] == [(KARO, True, "Caro, Joseph")]


def test_paths_and_ego(spark):
    e = spark.createDataFrame([("a", "b", "x", 0.5, "r", True, "e"), ("b", "c", "x", 0.9, "r", True, "e"), ("c", "b", "y", 0.4, "r", True, "e"), ("c", "d", "x", 0.7, "r", True, "e"), ("z", "z", "x", 0.7, "r", True, "e")], "source string, target string, type string, confidence double, relationship string, bidirectional boolean, evidence string")
    assert network.path(e, "a", "d") == [("a", "b"), ("b", "c"), ("c", "d")] and network.path(e, "a", "d", 2) is None and network.path(e, "a", "z") is None
    assert {r["agent_norm"]: r["hop"] for r in network.neighbourhood(e, "a", 2).collect()} == {"a": 0, "b": 1, "c": 2}
    assert [(r["neighbour"], r["confidence"]) for r in network.ego(e, "c", 9).collect()] == [("b", 0.9), ("d", 0.7)]
    assert {r["agent_norm"]: r["degree"] for r in network.degrees(e).collect()}["z"] == 1
    top, inside = network.map_nodes(spark.createDataFrame([("a",), ("b",), ("c",)], "agent_norm string"), e, 2)
    assert [r["agent_norm"] for r in top.collect()] == ["b", "c"] and inside.count() == 2


def test_paths_equal_a_plain_search(spark):
    """Chains with stars on them, and a ladder with many equal ways."""
    rng = random.Random(9)
    pairs = [(f"c{i}", f"c{i + 1}") for i in range(9)] + [(f"c{i}", f"s{i}.{k}") for i in (2, 5, 9) for k in range(40)]
    pairs += [(f"l{i}{a}", f"l{i + 1}{b}") for i in range(6) for a in "zyx" for b in "xyz" if rng.random() < 0.7] + [("c9", "l0x"), ("q", "r")]
    e = spark.createDataFrame([(a, b, "x", 0.5, "r", True, "e") if rng.random() < 0.5 else (b, a, "x", 0.5, "r", True, "e") for a, b in pairs], "source string, target string, type string, confidence double, relationship string, bidirectional boolean, evidence string").cache()
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)

    def plain(source, target, most):
        parent, front = {source: None}, [source]
        for _ in range(most):
            nxt = {}
            for x in sorted(front):
                for y in near[x]:
                    if y not in parent:
                        nxt.setdefault(y, x)
            parent |= nxt
            front = list(nxt)
            if target in nxt:
                out, at = [], target
                while at != source:
                    out.append((parent[at], at))
                    at = parent[at]
                return out[::-1]
        return None

    for source, target, most in (("c0", "c6", 12), ("s2.7", "s5.3", 6), ("l0x", "l6y", 12), ("l6z", "l0z", 12), ("s5.1", "l3x", 12), ("c0", "c6", 5), ("c0", "r", 12), ("c1", "c2", 1)):
        assert network.path(e, source, target, most) == plain(source, target, most), (source, target)
    assert network.path(e, "c1", "c1") == []


def test_links_between_pages(cat, spark):
    cat = Catalog(**cat.__dict__)
    cat.wikipedia_cache = spark.createDataFrame([("Q1", "Joseph Karo", "long text", ["Kabbalists", "1488 births"], ["Daniel Bomberg"], []), ("Q2", "Daniel Bomberg", "s", ["Kabbalists"], [], ["Joseph Karo"])], "wikidata_id string, wikipedia_title string, summary string, categories array<string>, see_also_titles array<string>, article_wikilinks array<string>")
    got = {r["type"]: r for r in network.wiki_links(cat).collect()}
    assert got["wikilink"]["confidence"] == 0.90 and got["wikilink"]["bidirectional"] and got["category"]["evidence"] == "Kabbalists"


def test_enrichment(cat):
    f = enrichment.facets_except_own(cat, role="author", occupation="printer")
    assert {(r["value"], r["count"]) for r in f["role"].collect()} == {("printer", 1)} and {r["value"] for r in f["occupation"].collect()} == {"rabbi"}
    assert [r["entity"] for r in enrichment.grouped(cat, has_image=True).collect()] == ["Q2"] and enrichment.grouped(cat, century=15).count() == 2


def test_quality(cat):
    cat = Catalog(**cat.__dict__)
    code = F.when(F.col("place_norm") == "venice", "it").otherwise("ne")
    cat.imprints = cat.imprints.withColumns({"date_method": F.lit("year_exact"), "date_raw": F.lit("1565"), "country_code": code})
    cat.agents = cat.agents.withColumns({"role_raw": F.lit("prtr."), "role_method": F.lit("unmapped"), "agent_confidence": F.lit(0.8)})
    assert [(r["subject"], r["check"]) for r in quality.lifespans(cat).collect()] == []
    s = quality.dimensions(cat, {"venice": ["it", "vc"], "amsterdam": ["gw"]}, ["Italy"])
    assert s["place"] == 0.5 and s["role"] == 0.0 and 0 < s["overall"] < 1
    assert s["date"] == 1.0 and s["agent"] == 0.5 and quality.missing_authorities(cat).collect()[0]["subject"] == KARO
    unnamed = Catalog(**cat.__dict__ | {"imprints": cat.imprints.withColumn("country_name", F.lit(None).cast("string"))})
    assert [tuple(r) for r in quality.place_mismatches(unnamed, {}, []).collect()] == [("country_name_unpopulated", "ALL", "4")]
    assert quality.completeness(cat).first()["complete"] == 2
    broken = {r["id"]: r["violations"] for r in quality.violations(quality.invariants(cat)).collect() if r["violations"]}
    assert broken == {"I1": 2, "P2": 0} or broken == {"I1": 2}
    assert "imprints.place_raw is missing" in differences("imprints", cat.imprints)


def test_invariants_of_a_network(cat, spark):
    cat = Catalog(**cat.__dict__)
    frame = spark.createDataFrame
    cat.network_nodes = frame([("bomberg, daniel", "person", 1490, 2, 1, True, "Printers"), ("nobody", "person", None, 3, 0, False, None), ("pub:bragadin, venice", "publisher", None, 1, 0, False, None), ("pub:lost", "publisher", None, 1, 0, False, None)], "agent_norm string, node_type string, birth_year int, record_count long, connection_count long, has_wikipedia boolean, community string")
    cat.network_edges = frame([("bomberg, daniel", "gone", "x", 1.2), ("nobody", "nobody", "x", 0.5)], "source string, target string, type string, confidence double")
    cat.wikipedia_connections = frame([("bomberg, daniel", "nobody", "wikilink"), ("bomberg, daniel", "gone", "wikilink")], "source string, target string, type string")
    cat.wikipedia_cache = frame([("Q9", ["a"])], "wikidata_id string, categories array<string>")
    cat.record_scope_flags = frame([(1, "modern"), (99, "modern")], "record_id long, flag string")
    cat.agent_authorities = cat.agent_authorities.withColumn("wikidata_id", F.lit("Q1"))
    cat.agent_aliases = cat.agent_aliases.withColumn("alias_type", F.lit("primary")).unionByName(frame([(4, 2, "daniel", "daniel", "primary"), (5, 77, "Xyz", "xy", "primary")], "id long, authority_id long, alias_form string, alias_form_lower string, alias_type string"))
    cat.publisher_variants = frame([(1, "Bragadin", "bragadin"), (1, "B", "odd form"), (5, "lost", "lost"), (8, "Bragadin, Venice", "bragadin, venice")], "authority_id long, variant_form string, variant_form_lower string")
    cat.subjects = cat.subjects.unionByName(frame([(9, 7, "y", ""), (10, 7, "z", "\ufffd")], "id long, record_id long, value string, value_he string"))
    cat.imprints = cat.imprints.withColumns({"country_code": F.when(F.col("id") > 1, "xx"), "place_raw": F.col("place_norm"), "date_raw": F.when(F.col("id") != 2, "y")})
    got = {r["id"]: r["violations"] for r in quality.violations(quality.invariants(cat)).collect()}
    want = {"I1": 2, "I2": 1, "I3": 1, "I4": 1, "P1": 2, "P3": 1, "P6": 1, "N1": 1, "N2": 1, "N3": 1, "N4": 1, "N5": 1, "N6self": 1, "N6bounds": 1, "W1": 1, "E1": 1, "E2": 1, "E3": 1, "E4": 1, "S3mojibake": 1, "S3empty": 1, "M1": 1, "M3": 1, "R1": 1}
    assert {k: v for k, v in got.items() if v} == want and len(got) >= 34
    assert tuple(quality.hebrew_coverage(cat).first()) == (37.5, 37.5)


def test_repairs(cat, spark, tmp_path):
    agents = spark.createDataFrame([("printer.", "other", 0.6, "unmapped"), ("dancer.", "other", 0.6, "unmapped"), ("printer.", "author", 0.9, "x")], "role_raw string, role_norm string, role_confidence double, role_method string")
    assert [r["role_norm"] for r in authority.trim_roles(agents).collect()] == ["printer", "other", "author"]
    assert [r["scheme"] for r in authority.lower_schemes(spark.createDataFrame([("NLI",), ("lcsh",), (None,)], "scheme string"), "nli").collect()] == ["nli", "lcsh", None]
    (tmp_path / "codes.json").write_text('{"it": "italy", "ne#": "netherlands"}')
    codes = catalog_module.load_map(spark, str(tmp_path / "codes.json"))
    im = spark.createDataFrame([("IT", None), ("ne", None), ("zz", None), ("it", "kept")], "country_code string, country_name string")
    assert [r["country_name"] for r in authority.fill_countries(im, codes).collect()] == ["italy", "netherlands", None, "kept"]
    (tmp_path / "geo.json").write_text('{"venice": {"lat": 45.4, "lon": 12.3}}')
    assert catalog_module.load_map(spark, str(tmp_path / "geo.json"), "struct<lat:double,lon:double>").select("key", "value.lat").first()[1] == 45.4
    for kind, read in (("csv", lambda p: spark.read.option("header", True).option("escape", '"').csv(p)), ("jsonl", spark.read.json), ("parquet", spark.read.parquet)):
        catalog_module.export(cat.titles, str(tmp_path / kind), kind)
        assert read(str(tmp_path / kind)).where("value = 'Beit Yosef'").count() == 1
    with pytest.raises(ValueError, match="format"):
        catalog_module.export(cat.titles, str(tmp_path / "x"), "xlsx")


def test_names_by_parts_and_surnames(cat):
    got = {r["name"]: r["agent_norm"] for r in network.loose_names(cat, ["daniel bomberg", "Herr Bomberg of Antwerp", "nobody", ""]).collect()}
    assert got == {"daniel bomberg": "bomberg, daniel", "Herr Bomberg of Antwerp": "bomberg, daniel"}
    made = network.connections(cat, ["Herr Bomberg of Antwerp", "Joseph Karo"]).collect()
    assert {(r["a"], r["b"]) for r in made} == {("bomberg, daniel", KARO)}


def test_agent_detail(cat):
    nodes = cat.agents.groupBy("agent_norm").agg(F.count_distinct("record_id").alias("record_count")).withColumn("display_name", F.upper("agent_norm"))
    r = network.agent_detail(cat, nodes, network.same_record(cat), "bomberg, daniel").first()
    assert [(c["agent_norm"], c["relationship"]) for c in r["connections"]] == [(KARO, "printed for")] and r["links"][0]["label"] == "wikidata"
    assert network.agent_detail(cat, nodes, network.same_record(cat), "nobody").count() == 0


def test_chosen_profiles(spark):
    p = spark.createDataFrame([("Anna", ["Printer"], 3), ("Bert", None, 1), ("Cora", ["rabbi"], 9), ("Dora", ["author"], 1)], "label string, occupations array<string>, records int")
    m = spark.createDataFrame([(i, "CORA") for i in range(3)] + [(1, "Bert")], "mms_id int, name string")
    pick = lambda q, **k: [r["label"] for r in display.chosen_profiles(p, m, q, **k).collect()]
    assert pick("books") == ["Cora"] and pick("which printer?") == ["Cora", "Anna", "Dora"] and display.chosen_profiles(p, m.where("false"), "books").count() == 0
    assert pick("books", resolved=spark.createDataFrame([("bert",), ("nobody",)], "name string")) == ["Bert", "Cora"]


@pytest.mark.parametrize("text, query, hit", [
    ("București și Iași", "bucuresti", True), ("re\u0301cit de voyage", "récit", True), ("Người Việt Nam", "viet", True), ("Người Việt Nam", "Việt", True), ("ΟΔΌΣ ΤΩΝ ΘΕΏΝ", "οδός", True), ("Οδός", "ΟΔΟΣ", True),
    ("שָׁלוֹם עֲלֵיכֶם", "שלום", True), ("שלום", "שָׁלוֹם", True), ("الكِتَاب", "الكتاب", True), ("Łódź", "łodz", True), ("Йога", "иога", True), ("Ünïcode-Text", "unicode text", True), ("straße", "strase", False), ("viet", "vie", False), ("viet", "vie*", True),
])
def test_full_text_of_all_scripts(spark, text, query, hit):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.where(text_functions.matches(F.col("t"), query)).count() == hit


def test_fold_is_one_for_texts_and_queries(spark):
    import unicodedata

    every = [chr(c) for c in range(0x20, 0x2100) if unicodedata.category(chr(c))[0] in "LM"]
    # what is newer than the JVM's tables is no letter to it, and separates words on both sides
    every = [r[0] for r in spark.createDataFrame([(c,) for c in every], "c string").where(r"c rlike '\\p{L}|\\p{M}'").collect()]
    assert len(every) > 4000
    got = [r[0] for r in spark.createDataFrame([(f"x{c}y",) for c in every], "t string").coalesce(1).select(text_functions.fold(F.col("t"))).collect()]
    differ = [(c, g) for c, g in zip(every, got, strict=True) if g != text_functions.fold_text(f"x{c}y")]
    assert [c for c, _ in differ] in ([], ["\u1734"])  # a mark that versions of Unicode class differently


def test_fuzzy_links_of_turned_names(spark):
    left = spark.createDataFrame([("buxtorf, johann",), ("menasseh, ben israel",)], "name string")
    right = spark.createDataFrame([("Johann Buxtorf",), ("Ben Israel Menasseh",), ("Johann Sebastian Bach",)], "match string")
    got = {r["name"]: (r["match"], r["ratio"]) for r in authority.fuzzy_links(left, right).collect()}
    assert got == {"buxtorf, johann": ("Johann Buxtorf", 1.0), "menasseh, ben israel": ("Ben Israel Menasseh", 1.0)}


def test_save_and_load(cat, spark, tmp_path):
    cat.save(str(tmp_path / "c"))
    back = Catalog.load(spark, str(tmp_path / "c"))
    assert set(back.tables()) == set(cat.tables()) and ids(back, Filter("publisher", "EQUALS", "bragadin")) == [A]


def test_fuzzy_links_are_the_same_at_every_size(spark):
    names = [f"{a} smith london" for a in ("john", "mary", "peter", "aurelia")] + ["of", "smith"]
    matches = [f"{a} smith london" for a in ("jon", "marie", "petre", "johnny", "bartholomew")] + ["jo smith", "london", ""]
    words = lambda t: {w for w in t.split() if len(w) >= 3}
    want = {}
    for n in names:
        alike = [(-difflib.SequenceMatcher(None, n, m).ratio(), m) for m in matches if words(n) & words(m)]
        if alike and min(alike)[0] <= -0.8:
            want[n] = min(alike)[::-1]
    left, right = spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(m,) for m in matches], "match string")
    got = {r["name"]: (r["match"], -r["ratio"]) for r in authority.fuzzy_links(left, right).collect()}
    assert got == want and want["john smith london"][0] == "jon smith london"


@pytest.mark.parametrize("least", [0.7, 0.8, 0.95])
def test_no_alike_pair_is_lost(spark, least):
    rng = random.Random(int(100 * least))
    word = lambda: "".join(rng.choice("abcdeio") for _ in range(rng.randint(1, 8)))
    a = list({" ".join(word() for _ in range(rng.randint(1, 4))) for _ in range(150)} | {"aaaa", "a", "aaaaaaaaaaaa", "ab ab ab ab"})
    edit = lambda t: "".join(c for x in t if rng.random() > 0.1 for c in (x, rng.choice("ae"))[: 1 + (rng.random() < 0.1)])
    b = list({edit(t) for t in a for _ in range(2)} | {" ".join(reversed(t.split())) for t in a} | {"aaaaa", "a", ""})
    left, right = spark.createDataFrame([(t,) for t in a], "a string"), spark.createDataFrame([(t,) for t in b], "b string")
    rows = [tuple(r) for r in authority.alike(left, right, least).collect()]
    want = {(x, y) for x in a for y in b if difflib.SequenceMatcher(None, x, y).ratio() >= least}
    assert len(rows) == len(set(rows)) and want <= set(rows) and len(want) > 50


def test_names_of_one_word_meet_in_few_pairs(spark):
    rng = random.Random(4)
    names = lambda n, k: [(f"{''.join(rng.choice('abcdefghijklmnopqrstuvwxyz') for _ in range(12))} smith", k) for _ in range(n)]
    found = {}
    for n in (500, 2000):
        left, right = (spark.createDataFrame(names(n, k), f"{c} string, k int").drop("k") for k, c in ((0, "a"), (1, "b")))
        found[n] = authority.alike(left, right, 0.8).count()
    assert all(k * 1000 < n * n for n, k in found.items()), found  # some 3 in 10,000 pairs


def test_queries_over_the_whole_table(spark):
    import duckdb

    from quirelake.registry import ORACLES, QUERIES

    d, db = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        db.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    plain = lambda rows: sorted(repr(tuple(float(v) if isinstance(v, decimal.Decimal) else v for v in r)) for r in rows)
    for name in ("rows_with_evidence", "node_mode_place", "community_facet", "goldset_regression", "filter_title_scripts", "filter_title_marked_word", "invariant_violations"):
        got = QUERIES[name](spark, d)
        assert plain(got.collect()) == plain(db.execute(f"select {', '.join(got.columns)} from ({ORACLES[name]})").fetchall()), name

    act = defaultdict(dict)
    for agent, place, lo, hi in db.execute(with_sql("agents", "imprints") + "select agent_norm, place_norm, min(date_start), max(date_start) from agents join imprints using (record_id) where date_start is not null group by 1, 2").fetchall():
        act[place][agent] = lo, hi
    want = {}
    for place in sorted(act):
        for a, b in itertools.combinations(sorted(act[place]), 2):
            (la, ha), (lb, hb) = act[place][a], act[place][b]
            if min(ha, hb) - max(la, lb) >= 6:
                want.setdefault((a, b), f"{place}: {max(la, lb)}-{min(ha, hb)}")
    got = {(r["source"], r["target"]): r["evidence"] for r in QUERIES["edges_same_place_period"](spark, d).collect()}
    assert got == want and len({(a[:4], b[:4]) for a, b in got}) > 1


def test_steps_pass_on_all_they_resolved(spark, cat):
    n = 260
    made = Catalog(**cat.__dict__)
    made.records = spark.range(1, n + 1).select("id", F.concat(F.lit("99"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("mms_id"), F.lit(None).cast("string").alias("created_at"))
    agents = [(i, f"[Agent {i:04}]", f"agent, {i:04}", "u" + str(i), "author", "personal") for i in range(1, n)] + [(n, None, None, None, None, None)]
    made.agents = spark.createDataFrame(agents, "record_id long, agent_raw string, agent_norm string, authority_uri string, role_norm string, agent_type string")
    table = made.agents.where("agent_norm is not null and record_id > 5").select("agent_norm")
    run = Executor(made)
    run.handlers["resolve_agent"] = lambda params, done: Result("agents", table)
    found = lambda **k: [int(r["mms_id"][2:]) for r in run.run([Step("resolve_agent", {}), Step("retrieve", {"filters": [{"field": "agent_norm", "op": "IN", "value": "$step_0", **k}]})])[1].table.orderBy("mms_id").collect()]
    assert found() == list(range(6, n)) and found(negate=True) == list(range(1, 6))
    done = run.run([Step("resolve_agent", {}), Step("enrich", {"agents": ["$step_0", "agent, 0001", "agent, 0009"]})])
    assert sorted(int(r["agent_norm"][-4:]) for r in done[1].table.collect()) == [1, *range(6, n)] and {r["records"] for r in done[1].table.collect()} == {1}
