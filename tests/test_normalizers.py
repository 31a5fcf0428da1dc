"""Raw strings to values: dates, places, publishers, agents, roles, names."""

import pytest
from pyspark.sql import functions as F

from quirelake.functions import dates, names, scores, text

DATES = [
    ("1680", 1680, 1680, "1680", 0.99, "year_exact"), ("[1680]", 1680, 1680, "[1680]", 0.95, "year_bracketed"), ("c. 1680", 1675, 1685, "c. 1680", 0.90, "year_circa_pm5"), ("c1680", 1675, 1685, "c. 1680", 0.90, "year_circa_pm5"),
    ("1680-1685", 1680, 1685, "1680-1685", 0.90, "year_range"), ("1680/1685", 1680, 1685, "1680-1685", 0.90, "year_range"), ("[1611-1612]", 1611, 1612, "[1611-1612]", 0.90, "year_bracketed_range"), ("[1500/1599]", 1500, 1599, "[1500-1599]", 0.90, "year_bracketed_range"),
    ("MDCXI - MDCXII [1611-1612]", 1611, 1612, "[1611-1612]", 0.90, "year_bracketed_range"), ('תרס"א 1900-תרס"ה 1904', 1900, 1904, "1900-1904", 0.90, "year_embedded_range"), ("circa 1650-1660 printed", 1650, 1660, "1650-1660", 0.90, "year_embedded_range"),
    ("unknown date", None, None, "unknown date", 0.0, "unparsed"), (None, None, None, "", 0.0, "missing"), ("", None, None, "", 0.0, "missing"),
    ('תשל"ט', 1979, 1979, "1979", 0.90, "hebrew_gematria"), ('[תס"ט]', 1709, 1709, "1709", 0.92, "hebrew_gematria_bracketed"), ('תק"ח', 1748, 1748, "1748", 0.90, "hebrew_gematria"),
    ("[17--?]", 1700, 1799, "17xx", 0.80, "century_partial"), ("[19--]", 1900, 1999, "19xx", 0.80, "century_partial"), ("[19  ?]", 1900, 1999, "19xx", 0.80, "century_partial"), ("17 -", 1700, 1799, "17xx", 0.80, "century_partial"),
    ("163-?", 1630, 1639, "163x", 0.85, "decade_partial"), ("[192-?]", 1920, 1929, "192x", 0.85, "decade_partial"), ("198-", 1980, 1989, "198x", 0.85, "decade_partial"), ("[196-]-", 1960, 1969, "196x", 0.85, "decade_partial"), ("{193-?]", 1930, 1939, "193x", 0.85, "decade_partial"), ("178 -", 1780, 1789, "178x", 0.85, "decade_partial"),
    ("183 -183", 1830, 1839, "183x-183x", 0.85, "truncated_range"), ("182 -190", 1820, 1909, "182x-190x", 0.85, "truncated_range"),
    ("MDLXI.", 1561, 1561, "1561", 0.95, "roman_numeral"), ("M. DCCXXXI.", 1731, 1731, "1731", 0.95, "roman_numeral"), ("Anno MDCLXXXIII.", 1683, 1683, "1683", 0.95, "roman_numeral"), ("A. MDCCXIV.", 1714, 1714, "1714", 0.95, "roman_numeral"),
    ("18O7", 1807, 1807, "1807", 0.95, "ocr_typo_fix"), ("[?-192]", None, 1929, "?-1929", 0.80, "open_start_range"), ("[?-189]", None, 1899, "?-1899", 0.80, "open_start_range"), ("5568", 5568, 5568, "5568", 0.99, "year_exact"), ("anno 5568", 1808, 1808, "1808", 0.75, "hebrew_calendar_converted"),
]


def test_dates(spark):
    df = spark.createDataFrame([(i, d[0]) for i, d in enumerate(DATES)], "i int, raw string")
    got = {r["i"]: r["d"] for r in df.select("i", dates.normalize_date(F.col("raw")).alias("d")).collect()}
    for i, (raw, *want) in enumerate(DATES):
        assert [got[i][k] for k in ("start", "end", "label", "confidence", "method")] == want, raw


def one(spark, value, raw):
    return spark.createDataFrame([(raw,)], "raw string").select(value.alias("v")).first()["v"]


@pytest.mark.parametrize("raw, value, method", [("Venice :", "venice", "place_casefold_strip"), ("[Amsterdam]", "amsterdam", "place_casefold_strip"), ("ﬁrenze,", "firenze", "place_casefold_strip"), (None, None, "missing"), (" : ", None, "empty_after_cleaning")])
def test_places(spark, raw, value, method):
    v = one(spark, names.normalize_imprint_name(F.col("raw"), "place"), raw)
    assert (v["value"], v["method"]) == (value, method)


@pytest.mark.parametrize("raw, value", [("Manutius, Aldus, 1450?-1515", "manutius, aldus, 1450?-1515"), ("[Oxford University Press]", "oxford university press"), ("Elsevier, ", "elsevier"), ("Pagliarini,  Marco,", "pagliarini, marco")])
def test_agents(spark, raw, value):
    assert one(spark, names.normalize_agent(F.col("raw")), raw)["value"] == value


@pytest.mark.parametrize("raw, want", [("prt", ("printer", 0.99, "relator_code")), ("Printer of plates", ("printer_of_plates", 0.95, "relator_term")), ("tr.", ("translator", 0.95, "relator_term")), ("author", ("author", 0.95, "relator_term")), ("other", ("other", 0.6, "unmapped")), (None, ("other", 0.5, "missing_role"))])
def test_roles(spark, raw, want):
    v = one(spark, names.normalize_role(F.col("raw")), raw)
    assert (v["value"], v["confidence"], v["method"]) == want


@pytest.mark.parametrize("raw, want", [("דפוס bragadin", "latin"), ("דפוס ברגדין", "hebrew"), ("abאב", "hebrew"), ("دار", "arabic"), ("12 - ?", "empty"), (None, "empty"), ("Élzévir", "latin")])
def test_scripts(spark, raw, want):
    assert one(spark, text.script(F.col("raw")), raw) == want


@pytest.mark.parametrize("raw, want", [("[17--?]", "partial_century"), ("תשל\"ט", "hebrew_gematria"), ("Anno Domini", "latin_convention"), ("1500-99", "ambiguous_range"), ("ca. 1650", "circa"), (" ", "empty_missing"), ("unknown", "other_unparsed")])
def test_date_patterns(spark, raw, want):
    assert one(spark, dates.date_pattern(F.col("raw")), raw) == want


@pytest.mark.parametrize("heading, query, phrase, want", [
    ("Bible -- Geography -- Early works to 1800", "bible geography", True, True), ("Limited editions", "edition", True, False), ("Limited editions", "edition*", True, True),
    ("Prières & méditations", "PRIERES meditations", True, True), ("one two three", "three one", True, False), ("one two three", "three one", False, True), ("x", "...", True, False),
])
def test_full_text(spark, heading, query, phrase, want):
    assert one(spark, text.matches(F.col("raw"), query, phrase), heading) is want


def test_small_strings(spark):
    assert one(spark, text.title_case(F.col("raw")), "o'brien, 3rd duke") == "O'Brien, 3Rd Duke"
    assert one(spark, text.reorder_name(F.col("raw")), "Karo, Joseph") == "Joseph Karo"
    assert one(spark, text.reorder_name(F.col("raw")), "Joseph ben Karo") == "Karo, Joseph ben"
    assert one(spark, text.century_label(F.lit(2001)), "") == "21th century" and one(spark, text.century_label(F.lit(2001), True), "") == "21st century"
    assert one(spark, text.subject_root(F.col("raw")), "Jewish law -- History. ") == "Jewish law"
    assert one(spark, text.city(F.col("raw")), "Venice, Italy") == "venice"
    assert tuple(one(spark, dates.active_years(F.col("raw")), "fl. 1520-1550")) == (1520, 1550)
    assert tuple(one(spark, dates.active_years(F.col("raw")), "1483?-")) == (1483, None)


def test_scores(spark):
    assert one(spark, scores.temporal(F.lit(1450)), "") == 1.0 and one(spark, scores.temporal(F.lit(None).cast("int")), "") == 0.3
    assert one(spark, scores.temporal(F.lit(2500)), "") == 0.15
    assert one(spark, scores.visual(F.col("raw")), "2 v. : ill., 10 folded maps") == 1.0 and one(spark, scores.visual(F.col("raw")), "40 p. : ill.") == 0.6
