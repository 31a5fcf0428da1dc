"""Queries of the normalizers, over strings made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import dates, names, text
from .operators import authority
from .registry import query

_RAW = """with raw as (select distinct l_partkey, l_linenumber, cast(year(l_shipdate) - 400 as integer) as y from lineitem),
dates as (select y, l_linenumber as n, {} as raw from raw)
select raw, {} as "start", {} as "end", {} as label, cast({} as double) as confidence, '{}' as method from dates group by all"""


def _lines(spark, d):
    line = spark.read.parquet(f"{d}/lineitem.parquet")
    return line.select((F.year("l_shipdate") - 400).cast("int").alias("y"), F.col("l_linenumber").alias("n")).distinct()


def _date(name: str, raw, sql_raw: str, start: str, end: str, label: str, confidence: float, method: str) -> None:
    def run(spark, d):
        df = _lines(spark, d).select(raw(F.col("y").cast("string"), F.col("n")).alias("raw")).distinct()
        df = df.select("raw", dates.normalize_date(F.col("raw")).alias("d"))
        return df.select("raw", "d.start", "d.end", "d.label", "d.confidence", "d.method")

    sql = _RAW.format(sql_raw, start, end, label, confidence, method)
    query(f"normalize_date_{name}", sql)(run)


_y = "cast(y as varchar)"
_c = F.concat
_date("exact", lambda y, n: y, _y, "y", "y", _y, 0.99, "year_exact")
_date("bracket", lambda y, n: _c(F.lit("["), y, F.lit("]")), f"concat('[', {_y}, ']')", "y", "y", f"concat('[', {_y}, ']')", 0.95, "year_bracketed")
_date("circa", lambda y, n: _c(F.lit("C. "), y), f"concat('C. ', {_y})", "y - 5", "y + 5", f"concat('c. ', {_y})", 0.90, "year_circa_pm5")
_date("range", lambda y, n: _c(y, F.lit(" / "), (y.cast("int") + n).cast("string")), f"concat({_y}, ' / ', cast(y + n as varchar))", "y", "y + n", f"concat({_y}, '-', cast(y + n as varchar))", 0.90, "year_range")
_date("embedded", lambda y, n: _c(F.lit("printed in "), y, F.lit(" for the author")), f"concat('printed in ', {_y}, ' for the author')", "y", "y", _y, 0.92, "year_embedded")
_date("two_years", lambda y, n: _c(F.lit("tom. 1 "), y, F.lit(", tom. 2 "), (y.cast("int") + n).cast("string")), f"concat('tom. 1 ', {_y}, ', tom. 2 ', cast(y + n as varchar))", "y", "y + n", f"concat({_y}, '-', cast(y + n as varchar))", 0.90, "year_embedded_range")
_date("decade", lambda y, n: _c(F.lit("["), F.substring(y, 1, 3), F.lit("-?]")), f"concat('[', substr({_y}, 1, 3), '-?]')", "y // 10 * 10", "y // 10 * 10 + 9", f"concat(substr({_y}, 1, 3), 'x')", 0.85, "decade_partial")
_date("century", lambda y, n: _c(F.lit("["), F.substring(y, 1, 2), F.lit("--?]")), f"concat('[', substr({_y}, 1, 2), '--?]')", "y // 100 * 100", "y // 100 * 100 + 99", f"concat(substr({_y}, 1, 2), 'xx')", 0.80, "century_partial")
_date("truncated", lambda y, n: _c(F.substring(y, 1, 3), F.lit(" -"), (F.substring(y, 1, 3).cast("int") + n).cast("string")), f"concat(substr({_y}, 1, 3), ' -', cast(y // 10 + n as varchar))", "y // 10 * 10", "(y // 10 + n) * 10 + 9", f"concat(substr({_y}, 1, 3), 'x-', cast(y // 10 + n as varchar), 'x')", 0.85, "truncated_range")


@query("normalize_date_ocr", """with raw as (select distinct cast(year(l_shipdate) - 400 as integer) as y from lineitem)
select translate(cast(y as varchar), '0', 'O') as raw, y as "start", y as "end", cast(y as varchar) as label, cast(case when cast(y as varchar) like '%0%' then 0.95 else 0.99 end as double) as confidence, case when cast(y as varchar) like '%0%' then 'ocr_typo_fix' else 'year_exact' end as method from raw""")
def normalize_date_ocr(spark, d):
    df = _lines(spark, d).select(F.translate(F.col("y").cast("string"), "0", "O").alias("raw")).distinct()
    df = df.select("raw", dates.normalize_date(F.col("raw")).alias("d"))
    return df.select("raw", "d.start", "d.end", "d.label", "d.confidence", "d.method")


@query("normalize_roman", "with k as (select distinct 1500 + p_size as y, p_size from part) select y, cast(concat('MD', repeat('C', cast(p_size // 100 as integer)), case when (p_size % 100) // 10 = 4 then 'XL' when (p_size % 100) // 10 >= 5 then concat('L', repeat('X', cast((p_size % 100) // 10 - 5 as integer))) else repeat('X', cast((p_size % 100) // 10 as integer)) end, case when p_size % 10 = 9 then 'IX' when p_size % 10 = 4 then 'IV' when p_size % 10 >= 5 then concat('V', repeat('I', cast(p_size % 10 - 5 as integer))) else repeat('I', cast(p_size % 10 as integer)) end) as varchar) as raw, y as \"start\", case when y = 1500 then null else 'roman_numeral' end as method from k where p_size % 10 <> 0 or p_size >= 10")
def normalize_roman(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_size").alias("s")).distinct().where("s % 10 != 0 or s >= 10")
    tens, ones = F.floor(F.col("s") % 100 / 10).cast("int"), F.col("s") % 10
    t = F.when(tens == 4, "XL").when(tens >= 5, F.concat(F.lit("L"), F.repeat(F.lit("X"), tens - 5))).otherwise(F.repeat(F.lit("X"), tens))
    o = F.when(ones == 9, "IX").when(ones == 4, "IV").when(ones >= 5, F.concat(F.lit("V"), F.repeat(F.lit("I"), ones - 5))).otherwise(F.repeat(F.lit("I"), ones))
    df = p.select((F.col("s") + 1500).alias("y"), F.concat(F.lit("MD"), t, o).alias("raw"))
    return df.select("y", "raw", dates.normalize_date(F.col("raw")).alias("d")).select("y", "raw", F.col("d.start").alias("start"), F.col("d.method").alias("method"))


_HEBREW = [("hundreds", ["", "ק", "ר", "ש", "ת", "תק", "תר", "תש", "תת", "תתק"]), ("tens", ["", "י", "כ", "ל", "מ", "נ", "ס", "ע", "פ", "צ"]), ("ones", ["", "א", "ב", "ג", "ד", "ה", "ו", "ז", "ח", "ט"])]
_pick = lambda letters, at: "[" + ", ".join(f"'{x}'" for x in letters) + f"][{at} + 1]"


@query("normalize_gematria", f"with v as (select distinct cast(200 + p_partkey % 700 as bigint) as v from part), w as (select v, concat({_pick(_HEBREW[0][1], 'v // 100')}, case v % 100 when 15 then 'טו' when 16 then 'טז' else concat({_pick(_HEBREW[1][1], 'v // 10 % 10')}, {_pick(_HEBREW[2][1], 'v % 10')}) end) as letters from v) select concat('[', letters, ']') as raw, cast(v + 1240 as integer) as \"start\", 'hebrew_gematria_bracketed' as method from w where length(letters) > 1")
def normalize_gematria(spark, d):
    """Hebrew letters as years, for all numbers between 200 and 899 that the parts give."""
    v = F.col("v")
    at = lambda letters, n: F.get(F.array(*[F.lit(x) for x in letters]), n.cast("int"))
    low = F.when(v % 100 == 15, "טו").when(v % 100 == 16, "טז").otherwise(F.concat(at(_HEBREW[1][1], F.floor(v / 10) % 10), at(_HEBREW[2][1], v % 10)))
    df = spark.read.parquet(f"{d}/part.parquet").select((200 + F.col("p_partkey") % 700).alias("v")).distinct().select(F.concat(at(_HEBREW[0][1], F.floor(v / 100)), low).alias("letters")).where(F.length("letters") > 1)
    df = df.select(F.concat(F.lit("["), "letters", F.lit("]")).alias("raw"))
    return df.select("raw", dates.normalize_date(F.col("raw")).alias("d")).select("raw", "d.start", "d.method")


@query("normalize_place", "with x as (select concat(' [', n_name, '] : ') as raw, lower(n_name) as k, n_nationkey from nation) select raw, case when n_nationkey % 2 = 0 then concat('canon ', k) else k end as value, upper(k) as display, cast(case when n_nationkey % 2 = 0 then 0.95 else 0.8 end as double) as confidence, case when n_nationkey % 2 = 0 then 'place_alias_map' else 'place_casefold_strip' end as method from x union all select '', null, '', 0.0, 'missing' union all select ' : ', null, '', 0.0, 'empty_after_cleaning' union all select '[Ｖｅｎｅｚｉａ ﬁ] :', 'venezia fi', 'Venezia fi', 0.8, 'place_casefold_strip'")
def normalize_place(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    raw = n.select(F.concat(F.lit(" ["), "n_name", F.lit("] : ")).alias("raw")).unionByName(spark.createDataFrame([("",), (" : ",), ("[Ｖｅｎｅｚｉａ ﬁ] :",)], "raw string"))
    alias = n.where("n_nationkey % 2 = 0").select(F.lower("n_name").alias("key"), F.concat(F.lit("canon "), F.lower("n_name")).alias("canonical"))
    df = raw.join(alias, names.imprint_key(F.col("raw")) == F.col("key"), "left")
    return df.select("raw", names.normalize_imprint_name(F.col("raw"), "place", F.col("canonical")).alias("v")).select("raw", "v.*")


@query("normalize_publisher", "select concat(s_name, ' ;') as raw, lower(s_name) as value, s_name as display, cast(0.8 as double) as confidence, 'publisher_casefold_strip' as method from supplier")
def normalize_publisher(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet").select(F.concat("s_name", F.lit(" ;")).alias("raw"))
    return s.select("raw", names.normalize_imprint_name(F.col("raw"), "publisher").alias("v")).select("raw", "v.*")


@query("normalize_agent", "select concat('[', c_name, '  Junior., ]') as raw, case when c_custkey % 3 = 0 then 'mapped' when c_custkey % 3 = 1 then 'ambiguous' else concat(lower(c_name), ' junior') end as value, cast(case when c_custkey % 3 = 0 then 0.95 when c_custkey % 3 = 1 then 0.5 else 0.8 end as double) as confidence, case when c_custkey % 3 = 0 then 'alias_map' when c_custkey % 3 = 1 then 'ambiguous' else 'base_clean' end as method from customer")
def normalize_agent(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    raw = F.concat(F.lit("["), "c_name", F.lit("  Junior., ]"))
    alias = c.where("c_custkey % 3 < 2").select(F.concat(F.lower("c_name"), F.lit(" junior")).alias("key"), F.when(F.col("c_custkey") % 3 == 0, "MAP").otherwise("AMBIGUOUS").alias("decision"))
    df = c.select(raw.alias("raw")).join(alias, names.agent_key(F.col("raw")) == F.col("key"), "left")
    v = names.normalize_agent(F.col("raw"), F.col("decision"), F.lit("mapped"), F.lit(None).cast("double"))
    return df.select("raw", v.alias("v")).select("raw", "v.value", "v.confidence", "v.method")


_ROLES = [("prt", "printer", 0.99, "relator_code"), (" Printer of plates ", "printer_of_plates", 0.95, "relator_term"), ("impr.", "printer", 0.95, "relator_term"), ("", "other", 0.5, "missing_role"), ("dancer", "other", 0.6, "unmapped"), ("AUT", "author", 0.99, "relator_code")]


@query("role_map", "select c_custkey, value, cast(confidence as double) as confidence, method from customer join (values " + ", ".join(f"({i}, {x[1:]!r})".replace(", (", ", ").replace("))", ")") for i, x in enumerate(_ROLES)) + ") x(i, value, confidence, method) on i = c_custkey % 6")
def role_map(spark, d):
    raw = F.get(F.array(*[F.lit(x[0]) for x in _ROLES]), (F.col("c_custkey") % 6).cast("int"))
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", names.normalize_role(raw).alias("v")).select("c_custkey", "v.value", "v.confidence", "v.method")


_MIXED = "select doc_id, case doc_id % 5 when 0 then text when 1 then concat('שלום עולם ', substr(text, 1, 12)) when 2 then concat('مرحبا بكم ', substr(text, 1, 9)) when 3 then concat('אב בג ', substr(text, 1, 60)) else '12 -- 34' end as t from documents"
_count = lambda of: f"length(regexp_replace(t, '[^{of}]', '', 'g'))"


@query("detect_script", f"with m as ({_MIXED}), c as (select doc_id, {_count('\\x{0590}-\\x{05FF}')} as h, {_count('\\x{0600}-\\x{06FF}')} as a, length(regexp_replace(regexp_replace(t, '[\\x{{0590}}-\\x{{06FF}}]', '', 'g'), '[^\\p{{L}}]', '', 'g')) as n from m) select doc_id, case when t_null then 'empty' when h + a + n = 0 then 'empty' when h > a and h > n then 'hebrew' when a > h and a > n then 'arabic' when n > h and n > a then 'latin' when h > 0 and h >= a then 'hebrew' when a > 0 then 'arabic' else 'latin' end as script from (select c.*, m.t is null as t_null from c join m using (doc_id))")
def detect_script(spark, d):
    k, t = F.col("doc_id"), F.col("text")
    mixed = F.when(k % 5 == 0, t).when(k % 5 == 1, F.concat(F.lit("שלום עולם "), F.substring(t, 1, 12))).when(k % 5 == 2, F.concat(F.lit("مرحبا بكم "), F.substring(t, 1, 9))).when(k % 5 == 3, F.concat(F.lit("אב בג "), F.substring(t, 1, 60))).otherwise("12 -- 34")
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", text.script(mixed).alias("script"))


@query("date_pattern_class", "with y as (select distinct cast(year(l_shipdate) - 400 as varchar) as y from lineitem) select concat('ca. ', y) as raw, 'circa' as kind from y union all select concat(y, '-', '07'), 'ambiguous_range' from y union all select concat('[', substr(y, 1, 2), '--?]'), 'partial_century' from y group by 1 union all select concat('Anno ', y), 'latin_convention' from y union all select 'no date', 'other_unparsed' union all select '', 'empty_missing'")
def date_pattern_class(spark, d):
    y = _lines(spark, d).select(F.col("y").cast("string").alias("y")).distinct()
    made = [y.select(F.concat(F.lit("ca. "), "y").alias("raw")), y.select(F.concat("y", F.lit("-07")).alias("raw")), y.select(F.concat(F.lit("["), F.substring("y", 1, 2), F.lit("--?]")).alias("raw")).distinct(), y.select(F.concat(F.lit("Anno "), "y").alias("raw")), spark.createDataFrame([("no date",), ("",)], "raw string")]
    df = made[0]
    for m in made[1:]:
        df = df.unionByName(m)
    return df.select("raw", dates.date_pattern(F.col("raw")).alias("kind"))


@query("tidy_subject_root", "select distinct p_partkey, replace(rtrim(concat(p_type, ' -- ', p_brand, '. '), '. '), ' -- ', ' — ') as tidy, p_type as root from part")
def tidy_subject_root(spark, d):
    raw = F.concat("p_type", F.lit(" -- "), "p_brand", F.lit(". "))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", text.tidy_subject(raw).alias("tidy"), text.subject_root(raw).alias("root"))


@query("fuzzy_linkage")
def fuzzy_linkage(spark, d):
    """difflib's ratio has no form in SQL: its tests hold it against a brute-force comparison."""
    p = spark.read.parquet(f"{d}/part.parquet")
    left = p.select(F.concat("p_name", F.lit(" "), F.substring("p_brand", 7, 2)).alias("name")).distinct()
    return authority.fuzzy_links(left, p.select(F.col("p_name").alias("match")).distinct())


@query("wikidata_values", "select c_custkey, cast(1400 + c_custkey % 300 as integer) as year, cast(c_custkey % 90 as double) as lat, cast(-(c_custkey % 180) as double) as lon, concat('Q', cast(c_custkey + 1 as varchar)) as qid from customer")
def wikidata_values(spark, d):
    k = F.col("c_custkey")
    c = spark.read.parquet(f"{d}/customer.parquet")
    point = dates.wikidata_point(F.concat(F.lit("Point("), (-(k % 180)).cast("string"), F.lit(" "), (k % 90).cast("string"), F.lit(")")))
    c = c.select("c_custkey", dates.wikidata_year(F.concat(F.lit("+"), (1400 + k % 300).cast("string"), F.lit("-00-00T00:00:00Z"))).alias("year"), point.alias("p"), dates.wikidata_id(F.concat(F.lit("http://www.wikidata.org/entity/Q"), (k + 1).cast("string"))).alias("qid"))
    return c.select("c_custkey", "year", "p.lat", "p.lon", "qid")


@query("name_forms", "select c_custkey, concat('Anna Maria Lee', cast(c_custkey as varchar)) as turned, concat('Lee', cast(c_custkey as varchar), ', Anna Maria') as back, 1500 as \"start\", cast(1500 + c_custkey % 60 as integer) as \"end\" from customer")
def name_forms(spark, d):
    k = F.col("c_custkey").cast("string")
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.concat(F.lit("Lee"), k, F.lit(", Anna Maria")).alias("n"), dates.active_years(F.concat(F.lit("fl. 1500-"), (1500 + F.col("c_custkey") % 60).cast("string"))).alias("y"))
    return c.select("c_custkey", text.reorder_name(F.col("n")).alias("turned"), text.reorder_name(text.reorder_name(F.col("n"))).alias("back"), "y.start", "y.end")
