"""MARC XML into nested records whose every value names the fields it came from.

The schema is given, all strings: inferred types would change identifiers and drop fields. Each part
of a record, and its normal forms, are expressions over its arrays of fields, so a record is read in one
pass and no row is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..functions.dates import normalize_date
from ..functions.text import bound, nfkc_all
from ..shared import kept

RAW = "leader string, controlfield array<struct<_tag:string,_VALUE:string>>, datafield array<struct<_tag:string,_ind1:string,_ind2:string,subfield:array<struct<_code:string,_VALUE:string>>>>, _corrupt string"
SUBJECT_TAGS = ("600", "610", "630", "650", "651")
NOTE_TAGS = ("500", "501", "502", "504", "505", "520", "590")
#: The kind of agent by the last two digits of its tag, and the subfields that its name is made of.
AGENTS = {"00": ("personal", ("a",)), "10": ("corporate", ("a", "b")), "11": ("meeting", ("a", "c", "n"))}
INFERRED = {"100": "author", "110": "creator", "111": "creator"}


def read_xml(spark: SparkSession, path: str) -> DataFrame:
    """Raw records; a record that cannot be read has its text in ``_corrupt``."""
    return spark.read.schema(RAW).option("rowTag", "record").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").xml(path)


def _control(tag: str) -> Column:
    return F.get(F.filter("controlfield", lambda f: f["_tag"] == tag), F.lit(0))["_VALUE"]


def _every() -> Column:
    return F.coalesce(F.col("datafield"), F.array().cast("array<struct<_tag:string,_ind1:string,_ind2:string,subfield:array<struct<_code:string,_VALUE:string>>>>"))


def _in_order(*tags: str) -> Column:
    """The record's fields of the tags as they stand in it, each with ``occ``."""
    own = F.filter(_every(), lambda f: f["_tag"].isin(*tags))
    earlier = lambda o, f, i: F.size(F.filter(F.slice(o, F.lit(1), i), lambda g: g["_tag"] == f["_tag"]))
    return bound(own, lambda o: F.transform(o, lambda f, i: F.struct(f["_tag"].alias("tag"), earlier(o, f, i).alias("occ"), f["subfield"].alias("sub"))))


def _fields(*tags: str) -> Column:
    """The record's fields of the tags, tag by tag, each with ``occ``, its place among those of its tag."""
    every = _every()

    def own(tag: str) -> Column:
        return F.transform(F.filter(every, lambda f: f["_tag"] == tag), lambda f, i: F.struct(f["_tag"].alias("tag"), i.alias("occ"), f["subfield"].alias("sub")))

    return F.concat(*[own(t) for t in tags]) if len(tags) > 1 else own(tags[0])


def _any_of(tags: tuple[str, ...], values: Column, kind: str = "value:string,source:array<string>") -> Column:
    """``values``, which a record without fields of the tags has none of; functions on its arrays are not called then."""
    return F.when(F.arrays_overlap("datafield._tag", F.array(*[F.lit(t) for t in tags])), values).otherwise(F.array().cast(f"array<struct<{kind}>>"))


def _first(f: Column, code: str) -> Column:
    return F.get(F.filter(f["sub"], lambda s: s["_code"] == code), F.lit(0))["_VALUE"]


def _last(f: Column, code: str) -> Column:
    return F.try_element_at(F.filter(f["sub"], lambda s: s["_code"] == code), F.lit(-1))["_VALUE"]


def _ref(f: Column, code) -> Column:
    code = F.lit(code) if isinstance(code, str) else code
    return F.concat(f["tag"], F.lit("["), f["occ"].cast("string"), F.lit("]$"), code)


def _sourced(f: Column, code: str) -> Column:
    """struct<value, source> of a field's first subfield, null where there is none."""
    return bound(_first(f, code), lambda v: F.when(v.isNotNull(), F.struct(v.alias("value"), F.array(_ref(f, code)).alias("source"))))


def _joined(f: Column, keep, by: str = " ") -> Column:
    """struct<value, source> of the subfields that ``keep`` holds for, in their order."""
    return bound(F.filter(f["sub"], keep), lambda subs: F.struct(F.array_join(F.transform(subs, lambda s: s["_VALUE"]), by).alias("value"), F.transform(subs, lambda s: _ref(f, s["_code"])).alias("source")))


def _present(values: Column) -> Column:
    return F.filter(values, lambda x: x.isNotNull())


def _title(f: Column) -> Column:
    """Subfields a, then b, then c, whatever their order in the field."""

    def joined(f: Column, parts: Column) -> Column:
        text = F.trim(F.array_join(F.transform(parts, lambda s: s["_VALUE"]), " "))
        return F.when(F.size(parts) > 0, F.struct(text.alias("value"), F.array_distinct(F.transform(parts, lambda s: F.concat(f["tag"], F.lit("$"), s["_code"]))).alias("source")))

    of = lambda f, code: F.filter(f["sub"], lambda s: s["_code"] == code)
    return bound(f, lambda f: bound(F.concat(of(f, "a"), of(f, "b"), of(f, "c")), lambda parts: joined(f, parts)))


def _subject(f: Column) -> Column:
    def heading(shown: Column) -> Column:
        codes = F.array_distinct(F.transform(shown, lambda s: s["_code"]))
        parts = F.map_from_entries(F.transform(codes, lambda c: F.struct(c, F.transform(F.filter(shown, lambda s: s["_code"] == c), lambda s: s["_VALUE"]))))
        return F.struct(
            F.array_join(F.transform(shown, lambda s: s["_VALUE"]), " -- ").alias("value"), F.transform(shown, lambda s: _ref(f, s["_code"])).alias("source"),
            f["tag"].alias("source_tag"), _last(f, "2").alias("scheme"), _last(f, "9").alias("heading_lang"), _last(f, "0").alias("authority_uri"), parts.alias("parts"),
        )

    return bound(F.filter(f["sub"], lambda s: ~s["_code"].isin("2", "9", "0", "6", "8")), heading)


def _agent(f: Column) -> Column:
    kind, values, used = F.lit(None).cast("string"), F.array().cast("array<string>"), F.array().cast("array<string>")
    for ending, (label, codes) in AGENTS.items():
        own = f["tag"].endswith(ending)
        kind, values = F.when(own, label).otherwise(kind), F.when(own, _present(F.array(*[_first(f, c) for c in codes]))).otherwise(values)
        refs = _present(F.array(*[F.when(_first(f, c).isNotNull(), _ref(f, c)) for c in codes]))
        used = F.when(own, refs).otherwise(used)
    code, term = _first(f, "4"), _first(f, "e")
    inferred = F.try_element_at(F.create_map(*[F.lit(x) for kv in INFERRED.items() for x in kv]), f["tag"])
    source = F.when(code.isNotNull(), "relator_code").when(term.isNotNull(), "relator_term").when(inferred.isNotNull(), "inferred_from_tag").otherwise("unknown")
    return bound(values, lambda v: F.when(F.size(v) > 0, F.struct(
        F.array_join(v, " ").alias("name"), used.alias("source"), F.when(f["tag"].startswith("1"), "main").otherwise("added").alias("entry_role"),
        F.when(kind != "corporate", _first(f, "d")).alias("dates"), F.coalesce(code, term, inferred).alias("function"), source.alias("role_source"), kind.alias("agent_type"), _first(f, "0").alias("authority_uri"),
    )))


def _indexed(values: Column, name: str) -> Column:
    return F.transform(values, lambda x, i: x.withField(name, i))


def canonical(raw: DataFrame, source_file: str | None = None) -> DataFrame:
    """Nested records of raw ones; a record without an identifier is left out."""
    tags = lambda *ts: _fields(*ts)
    fixed = _control("008")
    imprints = F.transform(tags("260", "264"), lambda f: F.struct(_sourced(f, "a").alias("place"), _sourced(f, "b").alias("publisher"), _sourced(f, "c").alias("date"), _sourced(f, "f").alias("manufacturer"), F.array(f["tag"]).alias("source_tags"), f["occ"].alias("occurrence")))
    first041 = F.get(tags("041"), F.lit(0))
    languages = F.transform(F.filter(first041["sub"], lambda s: s["_code"] == "a"), lambda s: F.struct(s["_VALUE"].alias("value"), F.array(F.lit("041[0]$a")).alias("source")))
    drop = lambda *cs: lambda s: ~s["_code"].isin(*cs)
    some = lambda f: f["value"] != ""
    return raw.select(
        F.trim(_control("001")).alias("mms_id"), F.lit(source_file).alias("source_file"),
        _title(F.get(tags("245"), F.lit(0))).alias("title"),
        _any_of(("240",), F.transform(F.slice(tags("240"), 1, 1), lambda f: _joined(f, drop("0", "6", "8", "9")))).alias("uniform_titles"),
        _any_of(("246",), F.filter(F.transform(tags("246"), lambda f: _joined(f, drop("6", "8"))), some)).alias("variant_titles"),
        imprints.alias("imprints"), F.coalesce(_any_of(("041",), languages), F.array().cast("array<struct<value:string,source:array<string>>>")).alias("languages"),
        F.when(F.length(fixed) >= 38, F.nullif(F.trim(F.substring(fixed, 36, 3)), F.lit(""))).alias("language_fixed"),
        F.when(F.length(fixed) >= 18, F.nullif(F.trim(F.substring(fixed, 16, 3)), F.lit(""))).alias("country_code_fixed"),
        F.filter(F.transform(_in_order(*SUBJECT_TAGS), _subject), some).alias("subjects"),
        _indexed(_present(F.transform(tags("100", "110", "111", "700", "710", "711"), _agent)), "agent_index").alias("agents"),
        _any_of(NOTE_TAGS, F.filter(F.transform(_in_order(*NOTE_TAGS), lambda f: _joined(f, drop("2", "6", "8", "9")).withField("tag", f["tag"])), some), "value:string,source:array<string>,tag:string").alias("notes"),
        _any_of(("300",), F.filter(F.transform(tags("300"), lambda f: _joined(f, drop("6", "8"))), some)).alias("physical_description"),
        _any_of(("541",), F.filter(F.transform(tags("541"), lambda f: _joined(f, drop("6", "8"))), some)).alias("acquisition"),
    ).where("mms_id is not null and mms_id != ''")


def report(raw: DataFrame, records: DataFrame) -> DataFrame:
    """One row: records read, kept, unreadable, and how many have each part."""
    has = lambda c: F.count_if(F.size(c) > 0).alias(f"with_{c}")
    kept = records.agg(F.count("*").alias("records"), F.count("title").alias("with_title"), *[has(c) for c in ("imprints", "languages", "subjects", "agents", "notes")])
    read = raw.agg(F.count("*").alias("read"), F.count("_corrupt").alias("unreadable"), F.count("controlfield").alias("identified"))
    return read.crossJoin(F.broadcast(kept))  # one row each


def lacking(records: DataFrame, part: str, most: int = 10) -> DataFrame:
    """The first ids of records that lack a part."""
    empty = F.col(part).isNull() if part == "title" else F.size(part) == 0
    return records.where(empty).select("mms_id").orderBy("mms_id").limit(most)


def usage(raw: DataFrame) -> DataFrame:
    """(field, count): how often each subfield of each field occurs."""
    f = raw.select(F.explode("datafield").alias("f")).select("f._tag", F.explode("f.subfield").alias("s"))
    return f.groupBy(F.concat_ws("$", "_tag", "s._code").alias("field")).agg(F.count("*").alias("count"))


def normalized(records: DataFrame, places: DataFrame | None = None, publishers: DataFrame | None = None, agents: DataFrame | None = None, exact: bool = True) -> DataFrame:
    """``records`` with ``m2``: imprints_norm by position and agents_norm by agent_index.

    Alias maps are (key, canonical), of agents (key, decision, canonical, confidence); a name that its
    map knows takes the map's value. What was read is not changed. Records are read once and stay where
    they are; only with alias maps are they stored first, and the names that a map knows brought to them.
    """
    maps = {k: v for k, v in {"place": places, "publisher": publishers, "agent": agents}.items() if v is not None}
    out = kept(records, "marc") if maps else records
    imprinted = lambda part: F.transform("imprints", lambda x: names.bare_name(x[part]["value"]))
    bare = {"_place": imprinted("place"), "_publisher": imprinted("publisher"), "_agent": F.transform("agents", lambda x: names.bare_agent(x["name"]))}
    out = out.withColumns(bare).withColumns({c: nfkc_all(F.col(c), exact) for c in bare})
    key = {"place": F.lower, "publisher": F.lower, "agent": names.agent_form}
    tagged = lambda part, k: F.concat(F.lit(f"{part} "), k)
    if maps:
        empty = {c: F.lit(None).cast(t) for c, t in (("decision", "string"), ("confidence", "double"))}
        known = reduce(DataFrame.unionByName, [
            m.withColumns({c: v for c, v in empty.items() if c not in m.columns}).select(tagged(part, F.col("key")).alias("_k"), F.struct("decision", "canonical", F.col("confidence").cast("double").alias("confidence")).alias("v")) for part, m in maps.items()
        ]).groupBy("_k").agg(F.min("v").alias("v"))
        keys = lambda part: F.coalesce(F.transform(f"_{part}", lambda x: tagged(part, key[part](x))), F.array().cast("array<string>"))
        sought = F.concat(*[keys(part) for part in maps])
        hits = out.select("mms_id", F.explode(sought).alias("_k")).join(known, "_k").groupBy("mms_id").agg(F.map_from_entries(F.collect_set(F.struct("_k", "v"))).alias("_known"))
        out = out.join(hits, "mms_id", "left")
    found = lambda part, x: F.try_element_at("_known", tagged(part, key[part](x))) if part in maps else None

    def imprint(z: Column, i: Column) -> Column:
        def value(part: str) -> Column:
            hit = found(part, z[f"_{part}"])
            return names.imprint_value(z["imprints"][part]["value"], z[f"_{part}"], part, None if hit is None else hit["canonical"])

        return F.struct(i.alias("i"), normalize_date(z["imprints"]["date"]["value"]).alias("date"), value("place").alias("place"), value("publisher").alias("publisher"))

    def agent(z: Column) -> Column:
        hit = found("agent", z["_agent"])
        value = names.agent_value(z["agents"]["name"], names.agent_form(z["_agent"]), *(() if hit is None else (hit["decision"], hit["canonical"], hit["confidence"])))
        return F.struct(z["agents"]["agent_index"].alias("agent_index"), value.alias("agent"), names.normalize_role(z["agents"]["function"]).alias("role"))

    # the names are arguments of the zip: inside of its function they would be computed for each element
    parts = (F.when(F.size("imprints") > 0, F.transform(F.arrays_zip("imprints", "_place", "_publisher"), imprint)).alias("imprints_norm"), F.when(F.size("agents") > 0, F.transform(F.arrays_zip("agents", "_agent"), agent)).alias("agents_norm"))
    return out.select(*records.columns, F.struct(*parts).alias("m2"))


def flatten(records: DataFrame, countries: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """The catalogue's tables of normalized records; ids are hashes of the record and the place in it."""
    rid = F.xxhash64("mms_id")
    own = lambda *at: F.xxhash64("mms_id", *at)
    base = records.withColumn("record_id", rid)
    code = names.country_key(F.col("country_code_fixed"))
    country = F.try_element_at(F.create_map(*[F.lit(x) for kv in (countries or {"": ""}).items() for x in kv]), code)
    im = base.select("record_id", "mms_id", "country_code_fixed", F.posexplode("imprints").alias("i", "x"), "m2.imprints_norm")
    n = F.get("imprints_norm", F.col("i"))
    tables = {
        "records": base.select(F.col("record_id").alias("id"), "mms_id", "source_file"),
        "imprints": im.select(
            own(F.lit("i"), "i").alias("id"), "record_id", F.col("x.occurrence").cast("int").alias("occurrence"), F.col("x.date.value").alias("date_raw"), F.col("x.place.value").alias("place_raw"), F.col("x.publisher.value").alias("publisher_raw"), F.col("x.manufacturer.value").alias("manufacturer_raw"), "x.source_tags",
            n["date"]["start"].alias("date_start"), n["date"]["end"].alias("date_end"), n["date"]["label"].alias("date_label"), n["date"]["confidence"].alias("date_confidence"), n["date"]["method"].alias("date_method"),
            *[n[p][a].alias(f"{p}_{b}") for p in ("place", "publisher") for a, b in (("value", "norm"), ("display", "display"), ("confidence", "confidence"), ("method", "method"))],
            code.alias("country_code"), country.alias("country_name"),
        ),
    }
    titles = [base.where("title is not null").select("record_id", "mms_id", F.lit("main").alias("title_type"), F.lit(0).alias("i"), "title.value", "title.source")]
    titles += [base.select("record_id", "mms_id", F.lit(k).alias("title_type"), F.posexplode(f"{k}_titles").alias("i", "x")).select("record_id", "mms_id", "title_type", "i", "x.value", "x.source") for k in ("uniform", "variant")]
    tables["titles"] = reduce(DataFrame.unionByName, titles).select(own("title_type", "i").alias("id"), "record_id", "title_type", "value", "source")
    tables["subjects"] = base.select("record_id", "mms_id", F.posexplode("subjects").alias("i", "x")).select(own(F.lit("s"), "i").alias("id"), "record_id", "x.*", F.lit(None).cast("string").alias("value_he"))
    # an agent without a normal form falls back to its own in lower case
    found = F.get(F.filter(F.col("m2.agents_norm"), lambda a: a["agent_index"] == F.col("x.agent_index")), F.lit(0))
    ag = base.select("record_id", "mms_id", F.explode("agents").alias("x"), "m2").withColumn("n", found)
    tables["agents"] = ag.select(
        own(F.lit("a"), "x.agent_index").alias("id"), "record_id", F.col("x.agent_index").cast("int").alias("agent_index"), F.col("x.name").alias("agent_raw"), "x.agent_type", F.col("x.function").alias("role_raw"), "x.role_source", "x.authority_uri",
        F.coalesce("n.agent.value", F.lower("x.name")).alias("agent_norm"), F.coalesce("n.agent.confidence", F.lit(0.5)).alias("agent_confidence"), F.coalesce("n.agent.method", F.lit("fallback")).alias("agent_method"),
        F.coalesce("n.role.value", F.lit("other")).alias("role_norm"), F.coalesce("n.role.confidence", F.lit(0.5)).alias("role_confidence"), F.coalesce("n.role.method", F.lit("fallback")).alias("role_method"), F.transform("x.source", lambda s: F.substring_index(s, "$", 1)).alias("provenance"),
    )
    plain = {"languages": ("languages", {"value": "code"}), "notes": ("notes", {}), "physical_descriptions": ("physical_description", {})}
    for name, (part, renamed) in plain.items():
        tables[name] = base.select("record_id", "mms_id", F.posexplode(part).alias("i", "x")).select(own(F.lit(name), "i").alias("id"), "record_id", "x.*").withColumnsRenamed(renamed)
    return tables
