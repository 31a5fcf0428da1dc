"""Data quality: checks by dimension with scores, gaps, clusters of gaps, invariants, gold sets."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, names, text
from ..sources.catalog import PERSON, Catalog

#: The weights of the dimensions.
WEIGHTS = {"date": 0.20, "place": 0.20, "agent": 0.25, "publisher": 0.15, "role": 0.20}
EARLIEST, LATEST, WIDEST = 1400, 1950, 100


def _found(df: DataFrame, check: str, key: str, detail: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check"), F.col(key).cast("string").alias("subject"), detail.cast("string").alias("detail"))


def _dated(cat: Catalog) -> DataFrame:
    return cat.imprints.join(cat.records.select(F.col("id").alias("record_id"), "mms_id"), "record_id")


def inversions(cat: Catalog) -> DataFrame:
    return _found(_dated(cat).where("date_end < date_start"), "impossible_inversion", "mms_id", F.concat_ws(" < ", "date_end", "date_start"))


def out_of_scope(cat: Catalog) -> DataFrame:
    d = _dated(cat).where((F.col("date_start") < EARLIEST) | (F.col("date_start") > LATEST))
    return _found(d, "out_of_scope_date", "mms_id", F.col("date_start"))


def wide_ranges(cat: Catalog, widest: int = WIDEST) -> DataFrame:
    d = _dated(cat).where(F.col("date_end") - F.col("date_start") > widest)
    return _found(d, "wide_date_range", "mms_id", F.col("date_end") - F.col("date_start"))


def disagreements(cat: Catalog, method: str = "gematria", most: int = 5) -> DataFrame:
    """Records, once each, with a date by ``method`` further than ``most`` years from one by another."""
    d = _dated(cat).where("date_start is not null and date_method is not null and date_method != 'missing'")
    own = d.where(F.col("date_method").contains(method)).select("record_id", "mms_id", F.col("date_start").alias("a"))
    other = d.where(~F.col("date_method").contains(method)).select("record_id", F.col("date_start").alias("b"))
    far = own.join(other, "record_id").where(F.abs(F.col("a") - F.col("b")) > most).groupBy("mms_id").agg(F.max(F.abs(F.col("a") - F.col("b"))).alias("d"))
    return _found(far, f"{method}_disagreement", "mms_id", F.col("d"))


def failed_dates(cat: Catalog) -> DataFrame:
    return _found(_dated(cat).where("date_raw != '' and date_start is null"), "failed_date_parse", "mms_id", F.col("date_raw"))


def lifespans(cat: Catalog) -> DataFrame:
    """Agents, once for a record, born after it or, since 1700, dead for over a century before it."""
    ae = cat.authority_enrichment.select("authority_uri", F.from_json("person_info", PERSON).alias("p"))
    rows = _dated(cat).where("date_start is not null").select("record_id", "mms_id", "date_start").join(cat.agents.select("record_id", "agent_norm", "authority_uri"), "record_id").join(ae, "authority_uri")
    born = F.col("p.birth_year") > F.col("date_start") + 5
    dead = (F.col("p.death_year") >= 1700) & (F.col("date_start") - F.col("p.death_year") > 100)
    bad = rows.withColumn("check", F.when(born, "agent_born_after_publication").when(dead, "agent_died_long_before_publication")).where("check is not null")
    bad = bad.groupBy("mms_id", "agent_norm").agg(F.min("check").alias("check"))
    return bad.select("check", F.col("mms_id").alias("subject"), F.col("agent_norm").alias("detail"))


def place_mismatches(cat: Catalog, expected: dict[str, list[str]], countries: list[str]) -> DataFrame:
    """Imprints whose place lies in none of the countries of their code; countries as places; names not filled in.

    ``expected`` has the country codes that a place may have. The last check is of the table: one row
    where imprints have country codes and none has a country's name.
    """
    d = _dated(cat).where("place_norm is not null and place_norm != ''").withColumn("_p", F.lower(F.trim("place_norm")))
    known = F.create_map(*[x for k, v in expected.items() for x in (F.lit(k), F.array(*[F.lit(c) for c in v]))]) if expected else F.lit(None).cast("map<string,array<string>>")
    wrong = d.where("country_code is not null and country_code != ''").where(~F.array_contains(F.try_element_at(known, F.col("_p")), F.lower(F.trim("country_code"))))
    as_place = d.where(F.col("_p").isin([c.lower() for c in countries]))
    filled = cat.imprints.agg(F.count_if(F.coalesce("country_name", F.lit("")) != "").alias("names"), F.count_if(F.coalesce("country_code", F.lit("")) != "").alias("codes"))
    blank = filled.where("codes > 0 and names = 0").withColumn("mms_id", F.lit("ALL"))
    return reduce(DataFrame.unionByName, [_found(wrong, "place_country_mismatch", "mms_id", F.col("place_norm")), _found(as_place, "country_name_as_place", "mms_id", F.col("place_norm")), _found(blank, "country_name_unpopulated", "mms_id", F.col("codes"))])


def fragmented_agents(cat: Catalog) -> DataFrame:
    """Authority uris with more than one norm: forms of one agent that nothing brings together."""
    a = cat.agents.where("authority_uri is not null and authority_uri != ''").groupBy("authority_uri").agg(F.count_distinct("agent_norm").alias("n"))
    return _found(a.where("n > 1"), "multi_script_fragmentation", "authority_uri", F.col("n"))


def bare_names(cat: Catalog, most: int = 6) -> DataFrame:
    """Personal names of less than ``most`` characters without a surname's comma."""
    a = cat.agents.where((F.col("agent_type") == "personal") & ~F.col("agent_norm").contains(",") & (F.length("agent_norm") < most))
    return _found(a.groupBy("agent_norm").agg(F.count("*").alias("n")), "bare_first_name", "agent_norm", F.col("n"))


def missing_authorities(cat: Catalog) -> DataFrame:
    """Agents whose norm is no authority's name."""
    a = cat.agents.groupBy("agent_norm").agg(F.count("*").alias("n")).withColumn("_k", F.lower("agent_norm"))
    known = cat.agent_authorities.select(F.col("canonical_name_lower").alias("_k")).distinct()
    return _found(a.join(known, "_k", "left_anti"), "missing_authority_linkage", "agent_norm", F.col("n"))


def type_conflicts(cat: Catalog) -> DataFrame:
    a = cat.agents.groupBy("agent_norm").agg(F.count_distinct("agent_type").alias("n"))
    return _found(a.where("n > 1"), "agent_type_conflict", "agent_norm", F.col("n"))


def publishers_without_authority(cat: Catalog, least: int = 3) -> DataFrame:
    """Publishers of ``least`` records or more that are no authority's variant."""
    known = cat.publisher_variants.select(F.col("variant_form_lower").alias("_k")).distinct()
    p = cat.imprints.where("publisher_norm is not null and publisher_norm != ''").groupBy("publisher_norm").agg(F.count_distinct("record_id").alias("n")).where(F.col("n") >= least)
    return _found(p.withColumn("_k", F.lower("publisher_norm")).join(known, "_k", "left_anti"), "publisher_missing_authority", "publisher_norm", F.col("n"))


def unresearched_publishers(cat: Catalog) -> DataFrame:
    """Authorities not yet looked into (``type`` unresearched) that have records by a variant."""
    own = cat.publisher_authorities.where("type = 'unresearched'").select("id", "canonical_name")
    keys = own.join(cat.publisher_variants.select(F.col("authority_id").alias("id"), F.col("variant_form_lower").alias("_k")), "id")
    rows = cat.imprints.select(F.lower("publisher_norm").alias("_k"), "record_id").join(keys, "_k")
    return _found(rows.groupBy("id", "canonical_name").agg(F.count_distinct("record_id").alias("n")), "unresearched_authority", "canonical_name", F.col("n"))


def role_issues(cat: Catalog) -> DataFrame:
    """Roles that the map does not know - with a final stop, in Hebrew, or else - and agents without one."""
    raw = F.col("role_raw")
    lost = cat.agents.where("role_method = 'unmapped' and role_raw is not null")
    hebrew = raw.rlike(f"[{text.HEBREW}]")
    parts = [
        _found(lost.where(raw.endswith(".")), "trailing_period_unmapped", "agent_norm", raw),
        _found(lost.where(hebrew), "hebrew_role_unmapped", "agent_norm", raw),
        _found(lost.where(~raw.endswith(".") & ~hebrew), "unmapped_relator_term", "agent_norm", raw),
        _found(cat.agents.where("role_method = 'missing_role'"), "missing_role", "agent_norm", raw),
    ]
    return reduce(DataFrame.unionByName, parts)


def dimension_score(errors: int, total: int) -> float:
    return max(0.0, 1 - errors / total) if total else 1.0


def overall(scores: dict[str, float]) -> float:
    return sum(WEIGHTS[k] * v for k, v in scores.items())


def dimensions(cat: Catalog, expected: dict[str, list[str]] | None = None, countries: list[str] | None = None) -> dict[str, float]:
    """The score of each dimension and their weighted sum."""
    date = [inversions(cat), out_of_scope(cat), wide_ranges(cat), disagreements(cat), failed_dates(cat)]
    agent = [fragmented_agents(cat), bare_names(cat), type_conflicts(cat)]
    if cat.authority_enrichment is not None:
        date.append(lifespans(cat))
    if cat.agent_authorities is not None:
        agent.append(missing_authorities(cat))
    publisher = [publishers_without_authority(cat), unresearched_publishers(cat)] if cat.publisher_authorities is not None and cat.publisher_variants is not None else []
    parts = {"date": date, "place": [place_mismatches(cat, expected or {}, countries or [])] if expected or countries else [], "agent": agent, "publisher": publisher, "role": [role_issues(cat)]}
    filled = lambda t, c: F.count_if(F.coalesce(c, F.lit("")) != "") if t else F.count_distinct(F.nullif(F.col(c), F.lit("")))
    totals = {"date": ("imprints", F.count_distinct("record_id")), "place": ("imprints", filled(True, "place_norm")), "agent": ("agents", F.count_distinct("agent_norm")), "publisher": ("imprints", filled(False, "publisher_norm")), "role": ("agents", F.count("*"))}
    out = {}
    for k, dfs in parts.items():
        errors = reduce(DataFrame.unionByName, dfs).count() if dfs else 0
        table, total = totals[k]
        out[k] = dimension_score(errors, getattr(cat, table).agg(total).first()[0])
    return out | {"overall": overall(out)}


def completeness(cat: Catalog) -> DataFrame:
    """One row: how many records lack each kind of child row, and how many have all."""
    kinds = ("titles", "imprints", "agents", "subjects", "languages")
    df = cat.records.select(F.col("id").alias("record_id"))
    for k in kinds:
        df = df.join(getattr(cat, k).select("record_id").distinct().withColumn(k, F.lit(1)), "record_id", "left")
    have = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in kinds])
    return df.agg(F.count("*").alias("records"), *[F.count_if(F.col(k).isNull()).alias(f"without_{k}") for k in kinds], F.count_if(have).alias("complete"))


def subject_gaps(cat: Catalog) -> DataFrame:
    """One row: records with subjects, without, and subjects with a Hebrew form."""
    s = cat.subjects.groupBy("record_id").agg(F.count("*").alias("n"), F.count("value_he").alias("he"))
    df = cat.records.join(s, F.col("id") == F.col("record_id"), "left")
    return df.agg(F.count("n").alias("with_subjects"), F.count_if(F.col("n").isNull()).alias("without_subjects"), F.count_if(F.col("he") > 0).alias("with_hebrew"))


def enrichment_gaps(cat: Catalog) -> DataFrame:
    """One row: authority uris that agents use, and how many are enriched."""
    uris = cat.agents.where("authority_uri is not null").select("authority_uri").distinct()
    known = cat.authority_enrichment.select("authority_uri").distinct().withColumn("k", F.lit(1))
    return uris.join(known, "authority_uri", "left").agg(F.count("*").alias("used"), F.count("k").alias("enriched"))


def near_key(c: Column) -> Column:
    """What spellings of one value have in common: letters and digits only."""
    return F.regexp_replace(text.fold(c), r"[^\p{L}\p{N}]+", "")


def place_clusters(gaps: DataFrame, aliases: DataFrame) -> DataFrame:
    """gaps(raw, frequency) grouped: those near a known alias(key), else by script; most frequent first."""
    known = aliases.select(near_key(F.col("key")).alias("near")).distinct().withColumn("hit", F.lit(True))
    g = gaps.withColumn("near", near_key(F.col("raw"))).join(known, "near", "left")
    return _clusters(g.withColumn("cluster", F.when(F.col("hit"), "near_match").otherwise(F.concat(text.script(F.col("raw")), F.lit("_script")))))


def date_clusters(gaps: DataFrame) -> DataFrame:
    return _clusters(gaps.withColumn("cluster", dates.date_pattern(F.col("raw"))))


def publisher_clusters(gaps: DataFrame, singles: int = 5) -> DataFrame:
    """By the name without what comes after a comma; names alone in theirs as frequent or not."""
    g = gaps.withColumn("base", near_key(F.substring_index("raw", ",", 1)))
    n = g.groupBy("base").agg(F.count("*").alias("n"))
    g = g.join(n, "base").withColumn("cluster", F.when(F.col("n") > 1, F.concat(F.lit("variants_"), "base")).when(F.col("frequency") >= singles, "frequent_single").otherwise("single"))
    return _clusters(g)


def agent_clusters(gaps: DataFrame) -> DataFrame:
    """gaps(raw, frequency, method, confidence): ambiguous, low confidence, other."""
    return _clusters(gaps.withColumn("cluster", F.when(F.col("method") == "ambiguous", "ambiguous").when(F.col("confidence") < 0.5, "low_confidence").otherwise("other")))


def _clusters(g: DataFrame) -> DataFrame:
    """(cluster, members, priority): the priority is the sum of frequencies."""
    return g.groupBy("cluster").agg(F.count("*").alias("members"), F.sum("frequency").alias("priority")).orderBy(F.desc("priority"), "cluster")


@dataclass(frozen=True)
class Invariant:
    """A condition that no row of a catalogue may break."""

    id: str
    says: str
    violations: object  # Catalog -> DataFrame


def invariants(cat: Catalog) -> list[Invariant]:
    """The invariants of a built catalogue, as far as it has the tables and columns that they are about.

    Full text is matched in the tables' own texts, so nothing can be out of step with an index.
    """
    ids = cat.records.select(F.col("id").alias("record_id"))
    has = lambda t, *cs: getattr(cat, t) is not None and all(c in getattr(cat, t).columns for c in cs)
    twice = lambda t, *cs: getattr(cat, t).groupBy(*cs).count().where("count > 1")
    lacks = lambda a, b, on: a.join(b.distinct(), on, "left_anti")
    plain = lambda c: F.col(c).rlike("^[ -~]*$")
    out: list[Invariant] = []

    def add(name: str, says: str, found: DataFrame) -> None:
        out.append(Invariant(name, says, found))

    for t in ("imprints", "titles", "subjects", "agents", "languages", "notes", "physical_descriptions"):
        add(f"orphan_{t}", f"every row of {t} has a record", lacks(getattr(cat, t), ids, "record_id"))
    add("mms_id_unique", "a record has its own mms_id", twice("records", "mms_id"))
    if has("agents", "agent_confidence"):
        add("confidence_range", "confidences lie between 0 and 1", cat.agents.where("agent_confidence < 0 or agent_confidence > 1"))
    add("place_trimmed", "place keys have no outer blanks", cat.imprints.where("place_norm != trim(place_norm)"))
    add("publisher_lower", "publisher keys are lower case", cat.imprints.where("publisher_norm != lower(publisher_norm)"))
    add("agent_type_known", "agent types are known", cat.agents.where("agent_type not in ('personal', 'corporate', 'meeting')"))

    if cat.has_aliases:
        aliases, own = cat.agent_aliases, cat.agent_authorities
        form = aliases.select(F.col("alias_form_lower").alias("agent_norm"))
        linked = cat.agents.join(own.select("authority_uri").distinct(), "authority_uri", "left_semi").select("agent_norm", "authority_uri").distinct()
        add("I1", "an agent of an authority has its norm among the aliases", lacks(linked.select("agent_norm").distinct(), form, "agent_norm"))
        if has("agent_aliases", "alias_type"):
            parts = own.select(F.col("id").alias("authority_id"), "authority_uri").join(linked.where(F.col("agent_norm").contains(",")), "authority_uri")
            inside = F.concat(F.lit(","), F.replace("agent_norm", F.lit(", "), F.lit(",")), F.lit(",")).contains(F.concat(F.lit(","), "alias_form_lower", F.lit(",")))
            piece = aliases.where("alias_type = 'primary'").join(parts, "authority_id").where(inside & (F.col("alias_form_lower") != F.col("agent_norm")))
            whole = linked.select("authority_uri", F.col("agent_norm").alias("alias_form_lower"))
            add("I2", "no primary alias is a part of its authority's norm between commas", piece.join(whole, ["authority_uri", "alias_form_lower"], "left_anti").select("id").distinct())
        add("I3", "an alias has an authority", lacks(aliases, own.select(F.col("id").alias("authority_id")), "authority_id"))
        add("I4", "an ASCII alias is lower-cased as it is", aliases.where(plain("alias_form") & (F.col("alias_form_lower") != F.lower("alias_form"))))
        add("I5", "an ASCII name is lower-cased as it is", own.where(plain("canonical_name") & (F.col("canonical_name_lower") != F.lower("canonical_name"))))
        add("A1", "an alias has one authority", twice("agent_aliases", "alias_form_lower"))
    if cat.publisher_authorities is not None and cat.publisher_variants is not None:
        pubs, forms = cat.publisher_authorities, cat.publisher_variants
        add("P1", "a variant has an authority", lacks(forms, pubs.select(F.col("id").alias("authority_id")), "authority_id"))
        several = cat.imprints.where("publisher_norm is not null").groupBy("publisher_norm").agg(F.min("record_id").alias("low"), F.max("record_id").alias("high")).where("low < high").select("publisher_norm")
        known = pubs.select(F.col("canonical_name_lower").alias("publisher_norm")).unionByName(forms.select(F.col("variant_form_lower").alias("publisher_norm")))
        add("P2", "a publisher of several records is an authority's name or variant", lacks(several, known, "publisher_norm"))
        shadow = forms.join(pubs.select(F.col("canonical_name_lower").alias("variant_form_lower"), "id"), "variant_form_lower").where("id != authority_id")
        add("P3", "no variant is another authority's name", shadow)
        if has("publisher_variants", "variant_form"):
            odd = forms.where(F.col("variant_form_lower") != F.lower("variant_form"))
            add("P6", "a variant that is not its form in lower case is an imprint's publisher", lacks(odd, cat.imprints.select(F.col("publisher_norm").alias("variant_form_lower")), "variant_form_lower"))
        add("variant_unique", "a variant has one authority", twice("publisher_variants", "variant_form_lower"))
    if cat.network_nodes is not None and cat.network_edges is not None:
        _network_invariants(cat, add, has, lacks)
    if cat.agent_authorities is not None and cat.authority_enrichment is not None and has("agent_authorities", "wikidata_id"):
        both = cat.agent_authorities.select("authority_uri", F.col("wikidata_id").alias("x")).join(cat.authority_enrichment.select("authority_uri", F.col("wikidata_id").alias("y")), "authority_uri")
        add("E1", "an authority and its enrichment are the same item", both.where("x != y"))
    if has("subjects", "value_he"):
        add("S3mojibake", "no Hebrew heading holds a replacement character", cat.subjects.where(F.col("value_he").contains("\ufffd")))
        add("S3empty", "no Hebrew heading is empty", cat.subjects.where("value_he = ''"))
    if has("imprints", "place_raw", "publisher_raw", "date_raw"):
        add("M1", "a normalized value has a raw one", cat.imprints.where("(publisher_norm is not null and publisher_raw is null) or (place_norm is not null and place_raw is null) or ((date_start is not null or date_end is not null) and date_raw is null)"))
    add("M2", "a span does not end before it begins", cat.imprints.where("date_start > date_end"))
    if has("imprints", "country_code"):
        add("M3", "a country's name has a code", cat.imprints.where("country_name is not null and country_code is null"))
    if cat.record_scope_flags is not None:
        add("R1", "a scope flag has a record", lacks(cat.record_scope_flags, ids, "record_id"))
    return out


def _network_invariants(cat: Catalog, add, has, lacks) -> None:
    nodes, edges = cat.network_nodes, cat.network_edges
    norm = lambda c: nodes.select(F.col("agent_norm").alias(c))
    loose = lacks(edges, norm("source"), "source").select("source", "target", "type").unionByName(lacks(edges, norm("target"), "target").select("source", "target", "type"))
    add("N1", "both ends of an edge are nodes", loose.distinct())
    people = nodes.where("node_type = 'person'")
    add("N2", "a person's node is an agent", lacks(people, cat.agents.select("agent_norm"), "agent_norm"))
    if cat.publisher_authorities is not None:
        pubs = nodes.where("node_type = 'publisher'").withColumn("_k", F.substring("agent_norm", 5, 10_000))
        add("N3", "a publisher's node is an authority's name", lacks(pubs, cat.publisher_authorities.select(F.col("canonical_name_lower").alias("_k")), "_k"))
    if has("network_nodes", "connection_count"):
        ends = edges.select(F.col("source").alias("agent_norm")).unionByName(edges.where("source != target").select(F.col("target").alias("agent_norm"))).groupBy("agent_norm").agg(F.count("*").alias("n"))
        add("N4", "a node counts its edges", nodes.join(ends, "agent_norm", "left").where(F.col("connection_count") != F.coalesce("n", F.lit(0))))
    if has("network_nodes", "record_count"):
        n = cat.agents.groupBy("agent_norm").agg(F.count_distinct("record_id").alias("n"))
        add("N5", "a person's node counts its records", people.join(n, "agent_norm", "left").where(F.col("record_count") != F.coalesce("n", F.lit(0))))
    add("N6self", "no edge is a loop", edges.where("source = target"))
    add("N6bounds", "confidences of edges lie between 0 and 1", edges.where("confidence < 0 or confidence > 1"))
    if cat.wikipedia_connections is not None:
        inside = cat.wikipedia_connections.join(norm("source").distinct(), "source", "left_semi").join(norm("target").distinct(), "target", "left_semi")
        add("W1", "a connection of an encyclopedia between nodes is an edge", inside.join(edges.select("source", "target", "type").distinct(), ["source", "target", "type"], "left_anti"))
    if cat.authority_enrichment is not None:
        told = cat.agents.select("agent_norm", "authority_uri").distinct().join(cat.authority_enrichment.select("authority_uri", "wikidata_id", F.from_json("person_info", PERSON)["birth_year"].alias("birth_year")), "authority_uri")
        if has("network_nodes", "birth_year"):
            add("E2", "a person's birth is its enrichment's", people.where("birth_year is not null").join(told.select("agent_norm", "birth_year").distinct(), ["agent_norm", "birth_year"], "left_anti"))
        if cat.wikipedia_cache is not None:
            pages = told.join(cat.wikipedia_cache, "wikidata_id")
            if has("network_nodes", "has_wikipedia"):
                add("E3", "a node with a page has one in the cache", lacks(nodes.where("has_wikipedia"), pages.select("agent_norm"), "agent_norm"))
            if has("network_nodes", "community"):
                add("E4", "a person's community comes from a page's categories", lacks(people.where("community is not null"), pages.where("categories is not null").select("agent_norm"), "agent_norm"))


def hebrew_coverage(cat: Catalog) -> DataFrame:
    """One row: the percentage of subjects, and of distinct headings, that have a Hebrew form."""
    s = cat.subjects
    have = F.count_distinct(F.when(F.col("value_he").isNotNull(), F.col("value")))
    return s.agg(F.round(100 * F.count("value_he") / F.count("*"), 1).alias("rows"), F.round(100 * have / F.count_distinct("value"), 1).alias("headings"))


def violations(checks: list[Invariant]) -> DataFrame:
    """(id, violations) of the invariants."""
    parts = [c.violations.agg(F.count("*").alias("violations")).select(F.lit(c.id).alias("id"), "violations") for c in checks]
    return reduce(DataFrame.unionByName, parts)


def gold_set(found: DataFrame, gold: DataFrame) -> DataFrame:
    """found(query, mms_id) against gold(query, mms_id, wanted): (query, missing, unexpected, passed)."""
    got = found.select("query", "mms_id").distinct().withColumn("got", F.lit(True))
    j = gold.join(got, ["query", "mms_id"], "left")
    out = j.groupBy("query").agg(F.count_if(F.col("wanted") & F.col("got").isNull()).alias("missing"), F.count_if(~F.col("wanted") & F.col("got").isNotNull()).alias("unexpected"))
    return out.withColumn("passed", (F.col("missing") == 0) & (F.col("unexpected") == 0))


def label_stats(labels: DataFrame, label: str) -> DataFrame:
    """One row: how many labels there are of each value 0 and 1, and the share of 1."""
    c = F.col(label)
    return labels.agg(F.count("*").alias("total"), F.count_if(c == 1).alias("positive"), F.count_if(c == 0).alias("negative"), F.round(F.avg(c), 6).alias("share"))


def worst_queries(labels: DataFrame, query: str, label: str, limit: int = 10) -> DataFrame:
    """(query, labels, bad): the queries with most labels of 0."""
    out = labels.groupBy(F.col(query).alias("query")).agg(F.count("*").alias("labels"), F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("bad"))
    return out.orderBy(F.desc("bad"), "query").limit(limit)


def export_gold(labels: DataFrame, query: str, record: str, label: str) -> DataFrame:
    """(query, includes, excludes): the records that labels of 1 and 0 name, sorted."""
    of = lambda v: F.array_sort(F.collect_set(F.when(F.col(label) == v, F.col(record))))
    return labels.groupBy(F.col(query).alias("query")).agg(of(1).alias("includes"), of(0).alias("excludes"))


def renormalized(imprints: DataFrame) -> DataFrame:
    """Raw dates that are normalized again to something else than the table holds."""
    d = dates.normalize_date(F.col("date_raw"))
    return imprints.withColumn("_d", d).where(~F.col("_d.start").eqNullSafe(F.col("date_start")))


def place_frequency(imprints: DataFrame) -> DataFrame:
    """(place, count) by the simple key."""
    return imprints.where("place_raw is not null").groupBy(names.place_basic(F.col("place_raw")).alias("place")).agg(F.count("*").alias("count"))
