"""MARC XML into tables, as a batch and as a stream."""

from pyspark.sql import functions as F

from quirelake.sources import marc
from quirelake.sources.catalog import Catalog
from quirelake.streaming import ingest

XML = """<collection>
<record><controlfield tag="001">0007</controlfield><controlfield tag="008">850101s1565    it            000 0 heb d</controlfield>
<datafield tag="245" ind1="1" ind2="0"><subfield code="c">by K.</subfield><subfield code="b">part /</subfield><subfield code="a">Title :</subfield></datafield>
<datafield tag="264" ind1=" " ind2="1"><subfield code="a">Rome</subfield><subfield code="c">1600-1601</subfield></datafield>
<datafield tag="260" ind1=" " ind2=" "><subfield code="a">[Venice] :</subfield><subfield code="b">Bragadin,</subfield><subfield code="c">[1565]</subfield><subfield code="f">maker</subfield></datafield>
<datafield tag="260" ind1=" " ind2=" "><subfield code="c">MDLXI.</subfield></datafield>
<datafield tag="041" ind1=" " ind2=" "><subfield code="a">heb</subfield><subfield code="h">x</subfield><subfield code="a">lat</subfield></datafield>
<datafield tag="041" ind1=" " ind2=" "><subfield code="a">ger</subfield></datafield>
<datafield tag="651" ind1=" " ind2="0"><subfield code="a">Venice</subfield><subfield code="x">History</subfield><subfield code="x">Law</subfield><subfield code="2">lcsh</subfield><subfield code="0">uri</subfield></datafield>
<datafield tag="650" ind1=" " ind2="0"><subfield code="a">Printing</subfield></datafield>
<datafield tag="700" ind1="1" ind2=" "><subfield code="a">Bomberg, Daniel</subfield><subfield code="e">printer.</subfield><subfield code="4">prt</subfield></datafield>
<datafield tag="710" ind1="2" ind2=" "><subfield code="b">Press</subfield><subfield code="a">Oxford</subfield></datafield>
<datafield tag="100" ind1="1" ind2=" "><subfield code="a">Karo, Joseph,</subfield><subfield code="d">1488-1575</subfield></datafield>
<datafield tag="520" ind1=" " ind2=" "><subfield code="a">An abstract</subfield><subfield code="9">x</subfield></datafield>
<datafield tag="300" ind1=" " ind2=" "><subfield code="a">40 p. :</subfield><subfield code="b">ill.</subfield></datafield></record>
<record><datafield tag="245" ind1="0" ind2="0"><subfield code="a">No identifier</subfield></datafield></record>
<record><controlfield tag="001">8</controlfield><controlfield tag="008">short</controlfield></record>
</collection>"""


def read(spark, tmp_path):
    (tmp_path / "r.xml").write_text(XML, encoding="utf-8")
    return marc.read_xml(spark, str(tmp_path / "r.xml"))


def test_fields(spark, tmp_path):
    raw = read(spark, tmp_path)
    records = marc.canonical(raw, "r.xml").cache()
    got = {r["mms_id"]: r for r in records.collect()}
    assert set(got) == {"0007", "8"}
    r = got["0007"]
    assert r["title"]["value"] == "Title : part / by K." and r["title"]["source"] == ["245$a", "245$b", "245$c"]
    assert [(i["source_tags"], i["occurrence"], i["date"]["value"]) for i in r["imprints"]] == [(["260"], 0, "[1565]"), (["260"], 1, "MDLXI."), (["264"], 0, "1600-1601")]
    assert r["imprints"][0]["place"]["source"] == ["260[0]$a"] and r["imprints"][1]["place"] is None
    assert [x["value"] for x in r["languages"]] == ["heb", "lat"] and (r["language_fixed"], r["country_code_fixed"]) == ("heb", "it")
    assert [s["value"] for s in r["subjects"]] == ["Venice -- History -- Law", "Printing"] and r["subjects"][0]["parts"] == {"a": ["Venice"], "x": ["History", "Law"]} and r["subjects"][0]["authority_uri"] == "uri"
    assert [(a["name"], a["function"], a["role_source"], a["agent_type"], a["agent_index"]) for a in r["agents"]] == [("Karo, Joseph,", "author", "inferred_from_tag", "personal", 0), ("Bomberg, Daniel", "prt", "relator_code", "personal", 1), ("Oxford Press", None, "unknown", "corporate", 2)]
    assert r["notes"][0]["value"] == "An abstract" and got["8"]["imprints"] == [] and got["8"]["language_fixed"] is None
    rep = marc.report(raw, records).first()
    assert (rep["read"], rep["records"], rep["with_title"], rep["with_agents"]) == (3, 2, 1, 1)
    assert [x["mms_id"] for x in marc.lacking(records, "imprints").collect()] == ["8"]
    assert {x["field"]: x["count"] for x in marc.usage(raw).collect()}["260$c"] == 2


def test_tables(spark, tmp_path):
    records = marc.canonical(read(spark, tmp_path))
    places = spark.createDataFrame([("venice", "venezia")], "key string, canonical string")
    t = marc.flatten(marc.normalized(records, places=places), {"it": "italy"})
    im = t["imprints"].orderBy("source_tags", "occurrence").collect()
    assert [(r["date_start"], r["date_end"], r["date_method"], r["place_norm"], r["place_method"], r["publisher_norm"], r["country_name"]) for r in im] == [
        (1565, 1565, "year_bracketed", "venezia", "place_alias_map", "bragadin", "italy"), (1561, 1561, "roman_numeral", None, "missing", None, "italy"), (1600, 1601, "year_range", "rome", "place_casefold_strip", None, "italy")]
    ag = t["agents"].orderBy("agent_index").collect()
    assert [(r["agent_norm"], r["role_norm"], r["role_method"]) for r in ag] == [("karo, joseph", "author", "relator_term"), ("bomberg, daniel", "printer", "relator_code"), ("oxford press", "other", "missing_role")]
    assert t["records"].count() == 2 and t["languages"].count() == 2 and t["titles"].first()["title_type"] == "main"
    assert t["subjects"].join(t["records"], F.col("record_id") == t["records"]["id"], "left_anti").count() == 0


def test_stream(spark, tmp_path):
    records = marc.canonical(read(spark, tmp_path))
    records.write.json(str(tmp_path / "in"))
    q = ingest.append_tables(ingest.follow_json(spark, str(tmp_path / "in"), records.schema), str(tmp_path / "out"), str(tmp_path / "check"), {"it": "italy"})
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out/imprints.parquet")).count() == 3
    # the same records once more, in a new file, add nothing
    again = tmp_path / "in" / "again.json"
    again.write_text("".join(p.read_text() for p in (tmp_path / "in").glob("part-*.json")))
    q = ingest.append_tables(ingest.follow_json(spark, str(tmp_path / "in"), records.schema), str(tmp_path / "out"), str(tmp_path / "check"), {"it": "italy"})
    q.awaitTermination(120)
    cat = Catalog.load(spark, str(tmp_path / "out"))
    assert cat.imprints.count() == 3 and cat.records.count() == 2 and "batch" not in cat.records.columns


def test_batches_know_what_came_before(spark, tmp_path):
    """Files one by one, each with some records of earlier ones; then a restart, and files that come again."""
    import pytest

    record = marc.canonical(read(spark, tmp_path)).where("mms_id = '0007'").toJSON().first()
    source, target, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    (tmp_path / "in").mkdir()
    schema = marc.canonical(read(spark, tmp_path)).schema

    def add(n, ids):
        (tmp_path / "in" / f"{n:03}.json").write_text("\n".join(record.replace('"0007"', f'"{i}"') for i in ids))

    def run():
        q = ingest.append_tables(ingest.follow_json(spark, source, schema, 1), target, check)
        q.awaitTermination(240)
        return [p for p in q.recentProgress if p["numInputRows"]]

    for n in range(6):
        add(n, [f"r{k}" for k in range(3 * n, 3 * n + 5)])
    progress = run()
    assert [p["stateOperators"][0]["numRowsTotal"] for p in progress] == [5, 8, 11, 14, 17, 20]
    assert all("RocksDB" in str(p["stateOperators"][0]["customMetrics"]) or "rocksdb" in str(p["stateOperators"][0]["customMetrics"]) for p in progress)
    add(6, ["r0", "r19", "r20"])
    assert [p["stateOperators"][0]["numRowsUpdated"] for p in run()] == [1]
    got = spark.read.parquet(f"{target}/records.parquet")
    assert sorted(r["mms_id"] for r in got.collect()) == sorted(f"r{k}" for k in range(21))
    assert {r["batch"]: r["count"] for r in got.groupBy("batch").count().collect()} == {0: 5, 1: 3, 2: 3, 3: 3, 4: 3, 5: 3, 6: 1}
    assert "Parquet" not in str(spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""))
    with pytest.raises(ValueError):
        ingest.append_tables(ingest.follow_json(spark, source, schema), target, str(tmp_path / "other"))


def test_records_are_read_once_and_stay_in_place(spark, tmp_path):
    """XML is parsed once for all parts and their normal forms; two records of one identifier keep their own."""
    raw = read(spark, tmp_path)
    records = marc.normalized(marc.canonical(raw))
    text = records._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Relation [") == 1 and not any(x in text for x in ("Join", "Aggregate", "Repartition"))
    once = records.where("mms_id = '0007'").first()["m2"]
    assert [x["i"] for x in once["imprints_norm"]] == [0, 1, 2] and [x["agent_index"] for x in once["agents_norm"]] == [0, 1, 2]
    twice = marc.normalized(marc.canonical(raw.unionAll(raw))).where("mms_id = '0007'").collect()
    assert [r["m2"] for r in twice] == [once, once]
    assert records.where("mms_id = '8'").first()["m2"].asDict() == {"imprints_norm": None, "agents_norm": None}


def test_alias_maps_of_all_parts(spark, tmp_path):
    """Names meet their maps after NFKC, a map for each part; what no map knows is as without maps."""
    (tmp_path / "r.xml").write_text(XML.replace("Bragadin,", "\uff22ragadin,"), encoding="utf-8")
    records = marc.canonical(marc.read_xml(spark, str(tmp_path / "r.xml")))
    one = lambda key, to: spark.createDataFrame([(key, to)], "key string, canonical string")
    agents = spark.createDataFrame([("karo, joseph", "MAP", "karo", 0.9), ("oxford press", "AMBIGUOUS", None, None)], "key string, decision string, canonical string, confidence double")
    m2 = marc.normalized(records, one("venice", "venezia"), one("bragadin", "bragadini"), agents).where("mms_id = '0007'").first()["m2"]
    assert [(x["place"]["value"], x["publisher"]["value"], x["publisher"]["method"]) for x in m2["imprints_norm"]] == [("venezia", "bragadini", "publisher_alias_map"), (None, None, "missing"), ("rome", None, "missing")]
    assert [(x["agent"]["value"], x["agent"]["confidence"], x["agent"]["method"]) for x in m2["agents_norm"]] == [("karo", 0.9, "alias_map"), ("bomberg, daniel", 0.8, "base_clean"), ("ambiguous", 0.5, "ambiguous")]
    plain = marc.normalized(records).where("mms_id = '0007'").first()["m2"]["imprints_norm"][0]["publisher"]
    assert (plain["value"], plain["display"]) == ("bragadin", "Bragadin")


def test_settled_characters():
    """NFKC changes no text of them, since it changes no two side by side."""
    import re
    import unicodedata

    from quirelake.functions import text

    assert all(unicodedata.normalize("NFKC", t) == t for t in ("".join(a + b for b in text.SETTLED) for a in text.SETTLED))
    pattern = re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), text._UNSETTLED))
    settled = set(text.SETTLED)
    assert all((pattern.search(chr(i)) is None) == (chr(i) in settled) for i in range(0x3000) if not 0xD800 <= i < 0xE000)
