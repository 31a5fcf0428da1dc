"""Publication dates: an ordered chain of rules from a raw string to an interval of years.

Every rule is a Column that is a struct where it applies and null where it does not; the first that
is not null wins, so the order below is the meaning.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import UNICODE, strip

FIRST, LAST = 1000, 2100
#: Years between the Hebrew calendar and the Gregorian.
HEBREW_OFFSET = 3760

#: What the letters stand for.
HEBREW = {"א": 1, "ב": 2, "ג": 3, "ד": 4, "ה": 5, "ו": 6, "ז": 7, "ח": 8, "ט": 9, "י": 10, "כ": 20, "ך": 20, "ל": 30, "מ": 40, "ם": 40, "נ": 50, "ן": 50, "ס": 60, "ע": 70, "פ": 80, "ף": 80, "צ": 90, "ץ": 90, "ק": 100, "ר": 200, "ש": 300, "ת": 400}
ROMAN = {"M": 1000, "D": 500, "C": 100, "L": 50, "X": 10, "V": 5, "I": 1}
#: Dates that no rule reads, by their exact strings: (start, end, confidence, method).
EXACT = {
    "לא ח'ס'ר'ת' דבר [תרס\"ח-תרע\"א]": (1908, 1911, 0.90, "hebrew_chronogram"),
    "[והוא י'ש'פ'ו'ט' תבל' בצדק? תל\"ה?]": (1675, 1675, 0.85, "hebrew_chronogram"),
    "[הסכ' שע\"ה]": (1615, 1615, 0.85, "hebrew_date_abbrev"),
    "an. d[omi]ni M.D. XXVJ. Die. j. me[n]sis octobris.": (1526, 1526, 0.90, "roman_numeral_embedded"),
    "AC. M D C LXXX.[-M D C LXXXIII.]": (1680, 1683, 0.90, "roman_numeral_range"),
    "[?-192]": (None, 1929, 0.80, "open_start_range"),
    "[?-189]": (None, 1899, 0.80, "open_start_range"),
    "[-- ١٧]": (1700, 1799, 0.75, "arabic_numerals"),
}
_LETTERS = "".join(HEBREW)
_QUOTES = "\"'״׳"


def _sum_of(text: Column, values: dict[str, int]) -> Column:
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.aggregate(F.split(text, ""), F.lit(0), lambda t, x: t + F.coalesce(F.try_element_at(table, x), F.lit(0)))


def hebrew_year(text: Column) -> Column:
    """The year that Hebrew letters add up to, with the thousands that are left out."""
    total = _sum_of(text, HEBREW)
    return F.when(total > 0, F.when(total < 1000, total + 5000).otherwise(total))


def roman_year(text: Column) -> Column:
    """The year of a Roman numeral with dots and blanks between its letters, within 1000..2100."""
    bare = F.upper(F.regexp_replace(text, UNICODE + r"[.\s]", ""))
    table = F.create_map(*[F.lit(x) for kv in ROMAN.items() for x in kv])
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("after"))

    def step(acc: Column, letter: Column) -> Column:
        v = F.coalesce(F.try_element_at(table, letter), F.lit(0))
        return F.struct((acc["total"] + F.when(v < acc["after"], -v).otherwise(v)).alias("total"), v.alias("after"))

    total = F.aggregate(F.reverse(F.split(bare, "")), start, step, lambda acc: acc["total"])
    return F.when(bare.rlike("^[MDCLXVI]+$") & total.between(FIRST, LAST), total)


def _int(text: Column, pattern: str, group: int = 1) -> Column:
    found = F.regexp_extract(text, UNICODE + pattern, group)
    return F.when(found != "", found.cast("int"))


def _rule(when: Column, start: Column, end: Column, label: Column, confidence: float, method: str, warning: str = "") -> Column:
    warnings = F.array(F.lit(warning)) if warning else F.array().cast("array<string>")
    return F.when(when, F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), label.cast("string").alias("label"), F.lit(confidence).alias("confidence"), F.lit(method).alias("method"), warnings.alias("warnings")))


def _span(a: Column, b: Column, wrap: str = "%s-%s") -> Column:
    return F.format_string(wrap, a.cast("string"), b.cast("string"))


def normalize_date(raw: Column) -> Column:
    """struct<start, end, label, confidence, method, warnings> of a raw publication date."""
    t = strip(raw)
    within = lambda y: y.between(FIRST, LAST)
    null = F.lit(None).cast("int")
    exact, bracketed, circa = _int(t, r"^(\d{4})$"), _int(t, r"^\[(\d{4})\]$"), _int(t, r"(?i)^c\.?\s*(\d{4})$")
    dash = r"(\d{4})\s*[-/]\s*(\d{4})"
    a, b = (_int(t, f"^{dash}$", g) for g in (1, 2))
    ba, bb = (_int(t, rf"\[{dash}\]", g) for g in (1, 2))
    greg = _int(t, r"\[(?:i\.?e\.?\s*)?(\d{4})\]")
    ea, eb = (_int(t, dash, g) for g in (1, 2))
    years = F.filter(F.transform(F.regexp_extract_all(t, F.lit(UNICODE + r"(\d{4})"), 1), lambda y: y.cast("int")), within)
    low, high = F.array_min(years), F.array_max(years)
    single = F.get(years, F.lit(0))
    calendar = _int(t, r"(\d{4})") - HEBREW_OFFSET
    letters = lambda open_, close: F.regexp_extract(t, f"{open_}([{_LETTERS}][{_QUOTES}{_LETTERS}]{{1,8}})[{_QUOTES}]?{close}", 1)
    boxed, loose = hebrew_year(letters(r"\[", r"\]")), hebrew_year(letters(r"[\[\(]?", r"[\]\)]?"))
    century = _int(t, r"^[\[{]?(\d{2})\s*[-–_ ]{1,2}\s*[-–_?\x{a0} ]{0,2}\s*[\]})]?\s*[-–]?$")
    ten = _int(t, r"^[\[{]?(\d{3})\s*[-–_? ]*\s*[\]})]?\s*[-–]?$")
    t1, t2 = (_int(t, r"^(\d{3})\s*[-–]\s*(\d{3})$", g) for g in (1, 2))
    numeral = F.regexp_replace(strip(F.regexp_replace(t, UNICODE + r"(?i)^(?:Anno|A\.?|AC\.?)\s*", "")), r"\.+$", "")
    roman = F.when(F.upper(numeral).rlike("[MDCLXVI]{3,}"), roman_year(numeral))
    zeros = F.translate(t, "Oo", "00")
    ocr = F.when(zeros != t, _int(zeros, r"^(\d{4})$"))
    table = []
    for key, (s, e, conf, method) in EXACT.items():
        label = str(s or "?") if s == e else f"{s or '?'}-{e}"
        table.append(_rule(t == key, F.lit(s), F.lit(e), F.lit(label), conf, method, "direct_fix_applied"))
    d = lambda y: F.lpad(y.cast("string"), 3, "0")
    rules = [
        _rule(raw.isNull() | (raw == ""), null, null, F.lit(""), 0.0, "missing", "date_missing"),
        _rule(exact.isNotNull(), exact, exact, exact, 0.99, "year_exact"),
        _rule(bracketed.isNotNull(), bracketed, bracketed, F.format_string("[%s]", bracketed.cast("string")), 0.95, "year_bracketed"),
        _rule(circa.isNotNull(), circa - 5, circa + 5, F.format_string("c. %s", circa.cast("string")), 0.90, "year_circa_pm5"),
        _rule(a.isNotNull(), a, b, _span(a, b), 0.90, "year_range"),
        _rule(within(ba) & within(bb), ba, bb, _span(ba, bb, "[%s-%s]"), 0.90, "year_bracketed_range"),
        _rule(within(greg), greg, greg, greg, 0.90, "year_bracketed_gregorian"),
        _rule(within(ea) & within(eb), ea, eb, _span(ea, eb), 0.90, "year_embedded_range", "embedded_range_in_complex_string"),
        _rule((F.size(years) == 2) & (low != high), low, high, _span(low, high), 0.90, "year_embedded_range", "embedded_range_in_complex_string"),
        _rule(single.isNotNull(), single, single, single, 0.92, "year_embedded", "embedded_year_in_complex_string"),
        _rule((calendar >= 5000 - HEBREW_OFFSET) & within(calendar), calendar, calendar, calendar, 0.75, "hebrew_calendar_converted", "hebrew_calendar_date_auto_converted"),
        _rule(boxed.between(5000, 6000), boxed - HEBREW_OFFSET, boxed - HEBREW_OFFSET, boxed - HEBREW_OFFSET, 0.92, "hebrew_gematria_bracketed", "hebrew_letter_year_converted"),
        _rule(loose.between(5100, 6000), loose - HEBREW_OFFSET, loose - HEBREW_OFFSET, loose - HEBREW_OFFSET, 0.90, "hebrew_gematria", "hebrew_letter_year_converted"),
        *table,
        _rule(century.between(10, 21), century * 100, century * 100 + 99, F.format_string("%sxx", century.cast("string")), 0.80, "century_partial", "century_level_date"),
        _rule(ten.between(100, 210), ten * 10, ten * 10 + 9, F.format_string("%sx", d(ten)), 0.85, "decade_partial", "decade_level_date"),
        _rule(t1.between(100, 210) & t2.between(100, 210), t1 * 10, t2 * 10 + 9, F.format_string("%sx-%sx", d(t1), d(t2)), 0.85, "truncated_range", "truncated_range_date"),
        _rule(roman.isNotNull(), roman, roman, roman, 0.95, "roman_numeral", "roman_numeral_date"),
        _rule(within(ocr), ocr, ocr, ocr, 0.95, "ocr_typo_fix", "ocr_typo_corrected"),
        _rule(F.lit(True), null, null, t, 0.0, "unparsed", "date_unparsed"),
    ]
    return F.coalesce(*rules)


def date_pattern(raw: Column) -> Column:
    """The kind of a date string that was not parsed."""
    t = strip(F.coalesce(raw, F.lit("")))
    hebrew = F.length(F.regexp_replace(t, r"[^\x{0590}-\x{05FF}]", ""))
    return (
        F.when(t == "", "empty_missing")
        .when(t.rlike(UNICODE + r"\[?\d{2}[-–]{2}\??\]?"), "partial_century")
        .when(hebrew >= 2, "hebrew_gematria")
        .when(t.rlike(r"(?i)(?:anno|a\.d\.|m\.?d\.?c|mdcc|mdccc|mdxc|an\.|idib)"), "latin_convention")
        .when(t.rlike(UNICODE + r"(?i)(?:ca?\.\s*|circa\s+)\d{3,4}"), "circa")
        .when(t.rlike(UNICODE + r"\d{3,4}\s*[-–/]\s*\d{1,4}"), "ambiguous_range")
        .otherwise("other_unparsed")
    )


def active_years(text: Column) -> Column:
    """struct<start, end> of a span such as ``1500-1550``, ``fl. 1520`` or ``1483?-``."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(\d{4})"), 1), lambda y: y.cast("int"))
    first, second = F.get(found, F.lit(0)), F.get(found, F.lit(1))
    open_end = text.rlike(r"[-–]\s*$")
    return F.struct(first.alias("start"), F.coalesce(second, F.when(~open_end, first)).alias("end"))


def wikidata_year(text: Column) -> Column:
    """The year of a time such as ``+1488-00-00T00:00:00Z``, negative before our era."""
    found = F.regexp_extract(text, r"^([+-]?\d{1,6})-\d{2}-\d{2}", 1)
    return F.when(found != "", F.regexp_replace(found, r"^\+", "").cast("int"))


def wikidata_point(text: Column) -> Column:
    """struct<lat, lon> of ``Point(lon lat)``."""
    lon, lat = (F.regexp_extract(text, r"(?i)^Point\(\s*(-?[\d.]+)\s+(-?[\d.]+)\s*\)$", g) for g in (1, 2))
    return F.when(lon != "", F.struct(lat.cast("double").alias("lat"), lon.cast("double").alias("lon")))


def wikidata_id(uri: Column) -> Column:
    found = F.regexp_extract(uri, r"(?:^|/)(Q\d+)$", 1)
    return F.when(found != "", found)
