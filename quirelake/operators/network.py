"""The agent network: edges, nodes, communities, and queries on the graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..shared import kept, tasks
from ..sources.catalog import PERSON, Catalog, first_wins

#: Sources of edges in the order in which the first to name a pair and type is kept.
EDGE_ORDER = ("wiki", "teacher_student", "co_publication", "same_place_period", "same_record", "printed_by")
#: Pairs are only made within a record, a place and decade, or a category of at most so many agents.
MOST_PER_CATEGORY = 50
#: How categories begin that tell nothing about a person.
BROAD_CATEGORY = (
    r"(?i)^(Articles|All |CS1|Pages|Webarchive|Use |Short description|Living people|AC with|Wikipedia|Wikidata|Commons|"
    r"Harv and Sfn|Stub|Good articles|Featured articles|Spoken articles)"
)
#: Patterns of housekeeping categories, which never name a community.
HOUSEKEEPING = (
    r"^\d{3,4} births$", r"^\d{3,4} deaths$", r"^year of (birth|death)", r"^floruit", r"encyclop(a|æ)edia britannica", r"^coordinates on wikidata$", r"\bstubs?$",
    r"^articles ", r"^all .* articles", r"^wikipedia ", r"^pages ", r"^cs1[ :]", r"webarchive", r"^use (dmy|mdy) dates", r"needing translation", r"^commons category",
    r"^short description", r"different from wikidata$", r"^open library id", r"^source attribution$", r"with author abbreviations$", r"imslp links$",
    r"^webarchive template", r"^articles with", r"^biography with", r"^biography articles", r"^people with", r"signature$",
)
#: Agents of one place and time in a cell, two of which meet in one task, and of these in an array: the pairs of two arrays wait in memory.
CELL, BLOCK = 20_000, 64


def person(cat: Catalog) -> DataFrame:
    """(agent_norm, label, wikidata_id and the fields of person_info), a row per agent with enrichment."""
    ae = cat.authority_enrichment.select("authority_uri", "label", "wikidata_id", F.from_json("person_info", PERSON).alias("p"))
    agents = cat.agents.select("agent_norm", "authority_uri").where("agent_norm is not null").distinct()
    found = agents.join(ae, "authority_uri").select("agent_norm", "label", "wikidata_id", "p.*")
    return first_wins(found, ["agent_norm"], ["label", "wikidata_id"])


def _edge(df: DataFrame, kind: str, source: Column, target: Column, confidence: Column, relationship: Column, both: Column, evidence: Column) -> DataFrame:
    return df.select(source.alias("source"), target.alias("target"), F.lit(kind).alias("type"), confidence.cast("double").alias("confidence"), relationship.alias("relationship"), both.alias("bidirectional"), evidence.alias("evidence"))


def record_pairs(agents: DataFrame, n: int | None = None, roles: bool = True) -> DataFrame:
    """(record_id, a, b, ra, rb): the pairs of agents of one record, a before b, with their roles or without.

    A record's agents are few, so the equality on the record bounds the join. They are dealt to ``n`` tasks by
    their record, once for both sides.
    """
    of = ["role_norm"] if roles else []
    rows = agents.where("agent_norm is not null").select("record_id", "agent_norm", *of)
    rows = (rows.repartition(n, "record_id") if n else rows).distinct()
    side = lambda x: rows.select("record_id", F.col("agent_norm").alias(x), *[F.col(c).alias(f"r{x}") for c in of])
    return side("a").join(side("b"), "record_id").where("a < b")


def co_publication(cat: Catalog, least: int = 2) -> DataFrame:
    """Edges between agents that share ``least`` records or more.

    A record has a pair once, so its rows are its records. Few pairs meet twice in one task, so they are dealt
    to as many tasks as the records ask for and counted there, without a table of pairs in each task before.
    """
    n = tasks(cat.records)
    pairs = record_pairs(cat.agents, n, roles=False).select("a", "b").repartition(n, "a", "b").groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return _edge(pairs, "co_publication", F.col("a"), F.col("b"), F.least(F.col("n") / 5.0, F.lit(1.0)), F.concat(F.lit("co-published on "), "n", F.lit(" records")), F.lit(True), F.concat("n", F.lit(" shared records")))


#: The roles that name a relationship; all others are one.
TOLD_ROLES = ("translator", "author", "editor", "printer", "publisher", "curator")


def same_record_relationship(roles: Column) -> Column:
    has = lambda r: F.array_contains(roles, r)
    return (
        F.when(has("translator") & has("author"), "translated").when(has("editor") & has("author"), "edited")
        .when((has("printer") | has("publisher")) & has("author"), "printed for").when(has("curator") & has("author"), "compiled")
        .when((F.size(roles) == 1) & has("author"), "co-authored").otherwise("appeared together")
    )


def same_record(cat: Catalog, nodes: DataFrame | None = None) -> DataFrame:
    """Edges between agents of one record, named by their roles; the evidence is the first record."""
    agents = cat.agents if nodes is None else cat.agents.join(nodes.select("agent_norm").distinct(), "agent_norm", "left_semi")
    titles = cat.titles.where("title_type = 'main'").groupBy("record_id").agg(F.min_by("value", "id").alias("title"))
    n = tasks(cat.records)
    rows = record_pairs(agents, n).join(cat.records.select(F.col("id").alias("record_id"), "mms_id").repartition(n, "record_id"), "record_id").join(titles, "record_id", "left")
    one = lambda hit: F.bool_or(F.coalesce(hit("ra"), F.lit(False)) | F.coalesce(hit("rb"), F.lit(False)))
    told = [F.when(one(lambda c, r=r: F.col(c) == r), r) for r in TOLD_ROLES] + [F.when(one(lambda c: ~F.col(c).isin(*TOLD_ROLES)), "")]
    got = rows.repartition(n, "a", "b").groupBy("a", "b").agg(F.count_distinct("mms_id").alias("n"), F.array_compact(F.array(*told)).alias("roles"), F.min_by("title", F.struct(F.col("title").isNull(), "mms_id")).alias("t"), F.min("mms_id").alias("m"))
    rel = same_record_relationship(F.col("roles"))
    more = F.when(F.col("n") > 1, F.concat(F.lit(" and "), (F.col("n") - 1).cast("string"), F.lit(" more record"), F.when(F.col("n") > 2, "s").otherwise(""))).otherwise("")
    return _edge(got, "same_record", F.col("a"), F.col("b"), F.least(0.7 + 0.1 * F.col("n"), F.lit(1.0)), rel, F.lit(True), F.concat(rel, F.lit(" on “"), F.coalesce("t", "m"), F.lit("” ("), "m", F.lit(")"), more))


def activity(cat: Catalog) -> DataFrame:
    """(agent_norm, place, lo, hi): the years of an agent's imprints in a place, within its lifetime."""
    im = cat.imprints.where("place_norm is not null and date_start is not null and place_norm != '[sine loco]'")
    rows = cat.agents.where("agent_norm is not null").select("record_id", "agent_norm").join(im, "record_id")
    out = rows.groupBy("agent_norm", F.col("place_norm").alias("place")).agg(F.min("date_start").alias("lo"), F.max("date_start").alias("hi"))
    if cat.authority_enrichment is not None:
        life = person(cat).select("agent_norm", "birth_year", "death_year")
        out = out.join(life, "agent_norm", "left").select("agent_norm", "place", F.greatest("lo", "birth_year").alias("lo"), F.least("hi", "death_year").alias("hi"))
    return out.where("lo <= hi")


def cell_tasks(crowd: DataFrame) -> int:
    """Some tasks for each pair of cells, so that few share one; cells are small in bytes and large in pairs. Up to some thousands."""
    least = int(crowd.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(max(crowd.agg(F.sum(F.col("cells") * (F.col("cells") + 1) * 2)).first()[0] or 1, least), 5000)


def meetings(x: DataFrame, y: DataFrame, at: list[str], cell: int) -> DataFrame:
    """(at, xs and what they have, ys and what they have, tied): who meets whom in x(at, x, early, ...) and y(at, y, ...).

    An ``early`` x meets every y; the others are also among y, and of two such each meets the other once, but
    in one cell both ways round (``tied``). Both are dealt into cells by a hash: an x goes to the cells from its
    own on, a y to those up to its own, so half of all pairs of cells are enough. In a cell those that are alike
    are one row with an array, so what is decided by what they have is decided once for all of them, and a
    copy takes little more than its name.
    """
    crowd = x.groupBy(*at).agg(F.ceil(F.count("*") / cell).alias("cells"))  # every y that meets anyone is where an x is

    def blocks(side, who):
        alike = [c for c in side.columns if c not in at and c != who]
        rows = side.join(crowd, at).select(*at, "cells", F.pmod(F.xxhash64(who), F.col("cells")).alias("own"), *alike, who)
        all_ = rows.groupBy(*at, "cells", "own", *alike).agg(F.collect_list(who).alias("all"))
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("all") - 1) / BLOCK).cast("int")), lambda i: F.slice("all", i * BLOCK + 1, F.lit(BLOCK)))
        return all_.select(*at, "cells", "own", *alike, F.explode(cut).alias(f"{who}s"))

    zero, last = F.lit(0).cast("long"), F.col("cells") - 1
    spot = lambda i, j: F.struct(i.alias("cell"), j.alias("other"))
    onward = F.transform(F.sequence("own", last), lambda j: spot(F.col("own"), j))
    every = F.transform(F.sequence(zero, last), lambda j: spot(F.pmod(F.col("own"), j + 1), j))
    xs = blocks(x, "x").withColumn("spot", F.explode(F.when(F.col("early"), every).otherwise(onward)))
    xs = xs.withColumn("tied", ~F.col("early") & (F.col("spot.cell") == F.col("spot.other"))).select("*", "spot.*").drop("spot", "early", "own", "cells")
    ys = blocks(y, "y").withColumn("cell", F.explode(F.sequence(zero, "own"))).withColumnRenamed("own", "other").drop("cells")
    n, keys = cell_tasks(crowd), [*at, "cell", "other"]
    return xs.repartition(n, *keys).join(ys.repartition(n, *keys).hint("shuffle_hash"), keys)


def overlaps(spans: DataFrame, least: int, width: int = 10, cell: int = CELL) -> DataFrame:
    """(place, a, b, s, e): the pairs of spans(place, agent, lo, hi) that overlap for ``least`` years, a < b.

    Of two spans the later begins by the earlier's end less ``least``. So a span is dealt as an earlier one to
    every bucket of years in which such a later one can begin, as a later one to the bucket in which it does,
    and a pair meets once. The spans of a crowded place and bucket are dealt into cells, which meet in pairs.

    Spans may have ``before``, an array of (place, lo, hi) of the agent's in other places: a pair that overlaps
    in one of these as well is left out.
    """
    return _each(_overlapping(spans, least, width, cell), **{c: F.col(c) for c in ("place", "s", "e")}).select("place", "a", "b", "s", "e")


def _overlapping(spans: DataFrame, least: int, width: int = 10, cell: int = CELL) -> DataFrame:
    """(place, xs, ys, tied, s, e): the pairs of ``overlaps`` before each is a row."""
    more = ["before"] if "before" in spans.columns else []
    fit = spans.where(F.col("hi") - F.col("lo") >= least)
    bucket = lambda c: F.floor(F.col(c) / width)
    named = lambda x: [F.col("agent").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("lo", "hi", *more)]]
    later = fit.select("place", bucket("lo").alias("bucket"), *named("y"))
    earlier = fit.select("place", F.explode(F.sequence(bucket("lo"), F.floor((F.col("hi") - least) / width))).alias("bucket"), *named("x")).withColumn("early", F.col("bucket") > bucket("x_lo"))
    s, e = F.greatest("x_lo", "y_lo"), F.least("x_hi", "y_hi")
    same = (F.col("x_lo") == F.col("y_lo")) & (F.col("x_hi") == F.col("y_hi"))
    met = meetings(earlier, later, ["place", "bucket"], cell).where((e - s >= least) & (~F.col("tied") | (F.struct("y_lo", "y_hi") >= F.struct("x_lo", "x_hi"))))
    if more:
        both = lambda p, q: (p["place"] == q["place"]) & (F.greatest(p["lo"], q["lo"]) <= F.least(p["hi"], q["hi"]) - least)
        met = met.where(~F.exists("x_before", lambda p: F.exists("y_before", lambda q: both(p, q))))
    return met.select("place", "xs", "ys", (F.col("tied") & same).alias("tied"), s.alias("s"), e.alias("e"))


def _each(met: DataFrame, **more: Column) -> DataFrame:
    """(a, b and more): the pairs of (xs, ys, tied), the lesser name first; of tied ones those with x before y.

    ``more`` is told once for two arrays. That it is bound also keeps the pairs out of the join's generated
    code, which would hold in memory all that an array meets before it hands on the first.
    """
    once = [text.bound(c, lambda v: v).alias(n) for n, c in ({"tied": F.col("tied")} | more).items()]
    rows = met.select("xs", "ys", *once).select("ys", "tied", *more, F.explode("xs").alias("x"))
    rows = rows.select("x", "tied", *more, F.explode("ys").alias("y")).where(~F.col("tied") | (F.col("y") > F.col("x")))
    up = F.col("x") < F.col("y")
    return rows.select(F.when(up, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(up, F.col("y")).otherwise(F.col("x")).alias("b"), *more)


def same_place_period(cat: Catalog, least: int = 10) -> DataFrame:
    """Edges between agents active in one place for ``least`` years together; of several places the first.

    A span knows its agent's spans in earlier places, so a pair is left out where it meets in a later one, and
    pairs are never moved or brought together: what is shuffled are spans. There is an edge for each pair that
    overlaps, as many as a place's contemporaries squared: that is the result, not the way to it.
    """
    act = activity(cat).select("agent_norm", "place", F.col("lo").cast("int").alias("lo"), F.col("hi").cast("int").alias("hi")).where(F.col("hi") - F.col("lo") >= least)
    each = act.groupBy("agent_norm").agg(F.sort_array(F.collect_list(F.struct("place", "lo", "hi"))).alias("of"))  # a row for each place
    spans = each.select(F.col("agent_norm").alias("agent"), "of", F.explode("of").alias("x")).select("agent", "x.*", F.filter("of", lambda y: y["place"] < F.col("x.place")).alias("before"))
    years = F.concat("place", F.lit(": "), F.col("s").cast("string"), F.lit("-"), F.col("e").cast("string"))
    pairs = _each(_overlapping(kept(spans, "spans"), least), relationship=F.concat(F.lit("both active in "), "place"), evidence=years)
    return _edge(pairs, "same_place_period", F.col("a"), F.col("b"), F.lit(0.70), F.col("relationship"), F.lit(True), F.col("evidence"))


def lifespan_overlap(people: DataFrame, cell: int = CELL) -> DataFrame:
    """(a, b): people(agent_norm, birth_place, birth_year, death_year) born in one place who lived at one time.

    The people of a crowded place are dealt into cells, each pair of which is a task's work; what is moved are
    people, once for each cell of their place. There is a row for each pair of contemporaries, which is the result.
    """
    p = kept(people.where("birth_place is not null").select("agent_norm", F.lower("birth_place").alias("at"), "birth_year", "death_year"), "people")
    side = lambda x: p.select("at", F.col("agent_norm").alias(x), F.col("birth_year").alias(f"{x}_lo"), F.col("death_year").alias(f"{x}_hi"))
    of = lambda x: F.struct(f"{x}_lo", f"{x}_hi")
    met = meetings(side("x").withColumn("early", F.lit(False)), side("y"), ["at"], cell).where((F.greatest("x_lo", "y_lo") <= F.least("x_hi", "y_hi")) & (~F.col("tied") | (of("y") >= of("x"))))
    return _each(met.select("xs", "ys", (F.col("tied") & (of("x") == of("y"))).alias("tied")))


def resolve_names(cat: Catalog, names: DataFrame) -> DataFrame:
    """(name, agent_norm): which agent a name means - its own norm, an alias of its authority, a label."""
    norms = cat.agents.where("agent_norm is not null").select("agent_norm", "authority_uri").distinct()
    key = F.lower("name")
    direct = names.join(norms, key == F.col("agent_norm")).select("name", "agent_norm", F.lit(1).alias("rank"))
    ways = [direct]
    if cat.has_aliases:
        alias = cat.agent_aliases.join(cat.agent_authorities.select(F.col("id").alias("authority_id"), "authority_uri"), "authority_id").join(norms, "authority_uri")
        ways.append(names.join(alias, key == F.col("alias_form_lower")).select("name", "agent_norm", F.lit(2).alias("rank")))
    if cat.authority_enrichment is not None:
        labels = cat.authority_enrichment.select("authority_uri", "label").join(norms, "authority_uri")
        ways.append(names.join(labels, key == F.lower("label")).select("name", "agent_norm", F.lit(3).alias("rank")))
    return first_wins(reduce(DataFrame.unionByName, ways), ["name"], ["rank", "agent_norm"]).select("name", "agent_norm")


def loose_names(cat: Catalog, names: list[str]) -> DataFrame:
    """(name, agent_norm) of names that no form of an agent equals: all their parts in a norm, or its surname in them.

    The first agent by name. ``names`` are what a question asks for, so they go into the plan.
    """
    if len(names) > 50:
        raise ValueError("at most 50 names")
    norms = cat.agents.where("agent_norm is not null").select("agent_norm").distinct()
    surname = F.substring_index("agent_norm", ", ", 1)
    rungs = []
    for n in dict.fromkeys(names):
        parts = reduce(lambda a, b: a & b, [F.col("agent_norm").contains(w) for w in n.lower().split()], F.lit(bool(n.split())))
        rungs.append(F.struct(F.lit(n).alias("name"), F.when(parts, 1).when((surname != "") & F.lit(n.lower()).contains(surname), 2).alias("rank")))
    if not rungs:
        return norms.where("false").select(F.lit("").alias("name"), "agent_norm")
    found = norms.select("agent_norm", F.explode(F.filter(F.array(*rungs), lambda r: r["rank"].isNotNull())).alias("r"))
    return first_wins(found.select("r.name", "agent_norm", "r.rank"), ["name"], ["rank", "agent_norm"]).select("name", "agent_norm")


def teacher_student(cat: Catalog) -> DataFrame:
    """Edges from teachers to students, from either's list."""
    p = person(cat)
    taught = p.select(F.explode("teachers").alias("name"), F.col("agent_norm").alias("other"), F.lit("teacher").alias("side"))
    learnt = p.select(F.explode("students").alias("name"), F.col("agent_norm").alias("other"), F.lit("student").alias("side"))
    rows = taught.unionByName(learnt)
    rows = rows.join(resolve_names(cat, rows.select("name").distinct()), "name").where("agent_norm != other")
    teacher, student = (F.when(F.col("side") == s, F.col("agent_norm")).otherwise(F.col("other")) for s in ("teacher", "student"))
    out = _edge(rows, "teacher_student", teacher, student, F.lit(0.85), F.lit("teacher of"), F.lit(False), F.concat(F.lit("named as "), "side"))
    return first_wins(out, ["source", "target", "type"], ["evidence"])


def wiki_links(cat: Catalog) -> DataFrame:
    """Edges from encyclopedia pages: links in the text, see-also lists, and categories that few share."""
    qids = person(cat).where("wikidata_id is not null").select("agent_norm", "wikidata_id").distinct()
    pages = cat.wikipedia_cache.join(qids, "wikidata_id")
    titles = pages.select(F.col("wikipedia_title").alias("title"), F.col("agent_norm").alias("to")).distinct()
    ways = []
    for rank, column, kind, conf in ((1, "article_wikilinks", "wikilink", 0.75), (2, "see_also_titles", "see_also", 0.85)):
        out = pages.select("agent_norm", F.explode(column).alias("title")).join(titles, "title").where("agent_norm != to")
        out = out.select(F.least("agent_norm", "to").alias("a"), F.greatest("agent_norm", "to").alias("b"), (F.col("agent_norm") < F.col("to")).alias("up"), F.lit(kind).alias("kind"), F.lit(conf).alias("conf"), F.lit(rank).alias("rank"), "title")
        ways.append(out)
    direct = reduce(DataFrame.unionByName, ways).groupBy("a", "b").agg(F.bool_or("up").alias("up"), F.bool_or(~F.col("up")).alias("down"), F.min_by(F.struct("kind", "conf", "title"), F.struct("rank", "title")).alias("k"))
    both = F.col("up") & F.col("down")
    direct = direct.select(F.col("a").alias("source"), F.col("b").alias("target"), F.col("k.kind").alias("type"), F.when(both, 0.90).otherwise(F.col("k.conf")).alias("confidence"), F.col("k.kind").alias("relationship"), both.alias("bidirectional"), F.col("k.title").alias("evidence"))
    cats = pages.select("agent_norm", F.explode("categories").alias("category")).where(~F.col("category").rlike(BROAD_CATEGORY)).distinct()
    few = cats.groupBy("category").agg(F.count("*").alias("n")).where(F.col("n").between(2, MOST_PER_CATEGORY)).select("category")
    cats = cats.join(few, "category")
    a, b = cats.select("category", F.col("agent_norm").alias("a")), cats.select("category", F.col("agent_norm").alias("b"))
    shared = a.join(b, "category").where("a < b").groupBy("a", "b").agg(F.min("category").alias("c"), F.count("*").alias("n"))
    shared = _edge(shared, "category", F.col("a"), F.col("b"), F.lit(0.65), F.concat(F.lit("share "), "n", F.lit(" categories")), F.lit(True), F.col("c"))
    return direct.unionByName(shared)


def merge_edges(parts: list[DataFrame]) -> DataFrame:
    """The parts together; of equal (source, target, type) the first part's, by least evidence.

    They are stored, so that they are derived once and counted, and dealt to as many tasks as they ask for.
    """
    keys, ranked = ["source", "target", "type"], [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    rows = kept(reduce(DataFrame.unionByName, ranked), "parts")
    return first_wins(rows.repartition(tasks(rows), *keys), keys, ["_part", "evidence"]).drop("_part")


def display_names(cat: Catalog) -> DataFrame:
    """(agent_norm, display_name): the authority's name, the enrichment's label, or the norm in title case."""
    norms = cat.agents.where("agent_norm is not null").groupBy("agent_norm").agg(F.min("authority_uri").alias("authority_uri"))
    name = F.lit(None).cast("string")
    if cat.agent_authorities is not None:
        own = cat.agent_authorities.where("authority_uri is not null").groupBy("authority_uri").agg(F.min_by("canonical_name", "id").alias("canonical_name"))
        norms, name = norms.join(own, "authority_uri", "left"), F.col("canonical_name")
    label = F.lit(None).cast("string")
    if cat.authority_enrichment is not None:
        norms, label = norms.join(cat.authority_enrichment.groupBy("authority_uri").agg(F.min("label").alias("label")), "authority_uri", "left"), F.col("label")
    return norms.select("agent_norm", F.coalesce(name, label, text.title_case(F.col("agent_norm"))).alias("display_name"))


def place_mode(cat: Catalog, geocodes: DataFrame, most: int = 10) -> DataFrame:
    """(agent_norm, place, lat, lon): an agent's most frequent place that has coordinates.

    Places go by count, then the earliest year, then name; only the first ``most`` are looked at.
    """
    im = cat.imprints.where("place_norm is not null and place_norm != '[sine loco]'")
    rows = cat.agents.where("agent_norm is not null").select("record_id", "agent_norm").distinct().join(im, "record_id")
    counts = rows.groupBy("agent_norm", F.col("place_norm").alias("place")).agg(F.count("*").alias("n"), F.min("date_start").alias("first"))
    w = Window.partitionBy("agent_norm").orderBy(F.desc("n"), F.asc_nulls_last("first"), "place")
    top = counts.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    found = top.join(geocodes, "place")
    return first_wins(found, ["agent_norm"], ["_n"]).select("agent_norm", "place", "lat", "lon")


def primary_role(cat: Catalog) -> DataFrame:
    """(agent_norm, primary_role): the most frequent role, by name where equal."""
    counts = cat.agents.where("agent_norm is not null and role_norm is not null").groupBy("agent_norm", "role_norm").agg(F.count("*").alias("n"))
    return counts.groupBy("agent_norm").agg(F.min_by("role_norm", F.struct(-F.col("n"), "role_norm")).alias("primary_role"))


def nodes(cat: Catalog, geocodes: DataFrame) -> DataFrame:
    """Agents with coordinates: name, place, life, occupations, role and number of records."""
    counts = cat.agents.where("agent_norm is not null").groupBy("agent_norm").agg(F.count_distinct("record_id").alias("record_count"))
    out = counts.join(place_mode(cat, geocodes), "agent_norm").join(display_names(cat), "agent_norm").join(primary_role(cat), "agent_norm", "left")
    if cat.authority_enrichment is not None:
        out = out.join(person(cat).select("agent_norm", "wikidata_id", "birth_year", "death_year", "occupations"), "agent_norm", "left")
    return out.withColumn("node_type", F.lit("agent"))


def publisher_links(cat: Catalog) -> DataFrame:
    """(publisher id, record_id): the imprints whose publisher is an authority's name or variant."""
    keys = cat.publisher_authorities.select(F.col("id").alias("publisher"), F.col("canonical_name_lower").alias("key"))
    if cat.publisher_variants is not None:
        keys = keys.unionByName(cat.publisher_variants.select(F.col("authority_id").alias("publisher"), F.col("variant_form_lower").alias("key")))
    im = cat.imprints.select("record_id", F.lower("publisher_norm").alias("key"))
    return im.join(keys.distinct(), "key").select("publisher", "record_id").distinct()


def publisher_nodes(cat: Catalog, geocodes: DataFrame) -> DataFrame:
    counts = publisher_links(cat).groupBy("publisher").agg(F.count("*").alias("record_count"))
    at = cat.publisher_authorities.select("id", "canonical_name", text.city(F.col("location")).alias("place"))
    return at.join(counts, F.col("id") == F.col("publisher")).join(geocodes, "place").select(F.concat(F.lit("pub:"), "canonical_name").alias("agent_norm"), F.col("canonical_name").alias("display_name"), "place", "lat", "lon", "record_count", F.lit("publisher").alias("node_type"))


def printed_by(cat: Catalog) -> DataFrame:
    """Edges from authors to the publishers of their records."""
    rows = cat.agents.where("role_norm = 'author' and agent_norm is not null").select("agent_norm", "record_id").distinct()
    rows = rows.join(publisher_links(cat), "record_id").groupBy("agent_norm", "publisher").agg(F.count_distinct("record_id").alias("n"))
    rows = rows.join(cat.publisher_authorities.select(F.col("id").alias("publisher"), "canonical_name"), "publisher")
    return _edge(rows, "printed_by", F.col("agent_norm"), F.concat(F.lit("pub:"), "canonical_name"), F.least(0.7 + 0.1 * F.col("n"), F.lit(1.0)), F.lit("printed by"), F.lit(False), F.concat("n", F.lit(" records")))


def merge_duplicates(node_table: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes that share a wikidata_id as one, the one with most records; edges follow, loops go."""
    w = Window.partitionBy("wikidata_id").orderBy(F.desc("record_count"), "agent_norm")
    known = node_table.where("wikidata_id is not null")
    to = known.select(F.col("agent_norm").alias("old"), F.first("agent_norm").over(w).alias("new")).where("old != new")
    kept = node_table.join(to, F.col("agent_norm") == F.col("old"), "left_anti")
    a, b = to.select(F.col("old").alias("source"), F.col("new").alias("_s")), to.select(F.col("old").alias("target"), F.col("new").alias("_t"))
    moved = edges.join(a, "source", "left").join(b, "target", "left").withColumns({"source": F.coalesce("_s", "source"), "target": F.coalesce("_t", "target")}).drop("_s", "_t").where("source != target")
    return kept, first_wins(moved.withColumn("_c", -F.col("confidence")), ["source", "target", "type"], ["_c", "evidence"]).drop("_c")


def drop_orphans(edges: DataFrame, node_table: DataFrame) -> DataFrame:
    """The edges both of whose ends are nodes.

    Both are stored, so that they are derived once and counted. Edges are dealt by either end to as many tasks as
    they ask for; a task holds its nodes, and its edges pass by without being sorted.
    """
    edges, have = kept(edges, "edges"), kept(node_table.select("agent_norm").distinct(), "nodes")
    n = tasks(edges)
    for end in ("source", "target"):
        # nodes are distinct, so this is a semi join, but one that the optimizer does not move below the dealing
        edges = edges.repartition(n, end).join(have.repartition(n, "agent_norm").hint("shuffle_hash"), F.col(end) == F.col("agent_norm")).drop("agent_norm")
    return edges


def degrees(edges: DataFrame) -> DataFrame:
    """(agent_norm, degree): edges at each node; a loop counts once."""
    both = F.when(F.col("source") != F.col("target"), F.array("source", "target")).otherwise(F.array("source"))
    ends = edges.select(F.explode(both).alias("agent_norm"))  # one pass over the edges
    return ends.groupBy("agent_norm").agg(F.count("*").alias("degree"))


def communities(cat: Catalog, node_table: DataFrame, least: int = 8, most: int = 20) -> DataFrame:
    """(agent_norm, community): the rarest of a node's categories among the ``most`` widest with ``least`` nodes."""
    of = node_table.select("agent_norm", "wikidata_id").join(cat.wikipedia_cache.select("wikidata_id", F.explode("categories").alias("category")), "wikidata_id").where(~F.col("category").rlike("(?i)" + "|".join(HOUSEKEEPING))).select("agent_norm", "category").distinct()
    palette = of.groupBy("category").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "category").limit(most)
    return of.join(F.broadcast(palette), "category").groupBy("agent_norm").agg(F.min_by("category", F.struct("n", "category")).alias("community"))  # at most ``most`` rows


def spans(cat: Catalog) -> DataFrame:
    """(agent_norm, first, last): an agent's years; publishers as ``pub:`` nodes."""
    years = cat.imprints.where("date_start is not null").select("record_id", "date_start", F.coalesce("date_end", "date_start").alias("date_end"))
    rows = cat.agents.where("agent_norm is not null").select("agent_norm", "record_id")
    if cat.publisher_authorities is not None:
        rows = rows.unionByName(publisher_links(cat).join(cat.publisher_authorities.select(F.col("id").alias("publisher"), "canonical_name"), "publisher").select(F.concat(F.lit("pub:"), "canonical_name").alias("agent_norm"), "record_id"))
    return rows.join(years, "record_id").groupBy("agent_norm").agg(F.min("date_start").alias("first"), F.max("date_end").alias("last"))


def select_edges(edges: DataFrame, types: list[str] | None = None, least: float = 0.0) -> DataFrame:
    kept = edges.where(F.col("confidence") >= least)
    return kept.where(F.col("type").isin(types)) if types else kept


def map_nodes(node_table: DataFrame, edges: DataFrame, limit: int, types: list[str] | None = None, least: float = 0.0, among: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The ``limit`` nodes of most edges, and the edges between them; ``among``(agent_norm) narrows first."""
    table = node_table if among is None else node_table.join(among, "agent_norm", "left_semi")
    inside = drop_orphans(select_edges(edges, types, least), table)
    top = table.join(degrees(inside), "agent_norm").orderBy(F.desc("degree"), "agent_norm").limit(limit)
    few = F.broadcast(top.select("agent_norm"))  # at most ``limit`` rows
    return top, inside.join(few, F.col("source") == F.col("agent_norm"), "left_semi").join(few, F.col("target") == F.col("agent_norm"), "left_semi")


def best_edges(edges: DataFrame) -> DataFrame:
    """(a, b, type, confidence): of each unordered pair the edge of most confidence."""
    pair = edges.where("source != target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), "type", "confidence", "relationship")
    return first_wins(pair.withColumn("_c", -F.col("confidence")), ["a", "b"], ["_c", "type"]).drop("_c")


def ego(edges: DataFrame, agent: str, limit: int, types: list[str] | None = None, least: float = 0.0) -> DataFrame:
    """(neighbour, type, confidence): an agent's neighbours by confidence."""
    best = best_edges(select_edges(edges, types, least))
    near = best.where((F.col("a") == agent) | (F.col("b") == agent))
    other = F.when(F.col("a") == agent, F.col("b")).otherwise(F.col("a"))
    return near.select(other.alias("neighbour"), "type", "confidence").orderBy(F.desc("confidence"), "neighbour").limit(limit)


def induced(edges: DataFrame, members: DataFrame) -> DataFrame:
    """The best edges between members(agent_norm)."""
    best = best_edges(edges)
    have = members.select("agent_norm").distinct()
    return best.join(have, F.col("a") == F.col("agent_norm"), "left_semi").join(have, F.col("b") == F.col("agent_norm"), "left_semi")


def _pairs(edges: DataFrame, stored: bool) -> DataFrame:
    """(source, target) of the edges that are no loops, written once for the steps of a search unless they are ``stored``."""
    pairs = edges.where("source != target").select("source", "target")
    return pairs if stored else kept(pairs, "pairs")


def neighbourhood(edges: DataFrame, agent: str, hops: int, stored: bool = False) -> DataFrame:
    """(agent_norm, hop): all agents within ``hops`` edges, by the least number of them.

    A step reads the edges, written once, for those that have an end in its front.
    """
    pairs = _pairs(edges, stored)
    seen = front = edges.sparkSession.createDataFrame([(agent, 0)], "agent_norm string, hop int")
    for hop in range(1, hops + 1):
        at = front.select("agent_norm")
        ways = [pairs.join(at, F.col(x) == F.col("agent_norm"), "left_semi").select(F.col(y).alias("agent_norm")) for x, y in (("source", "target"), ("target", "source"))]
        front = kept(ways[0].unionByName(ways[1]).distinct().join(seen.select("agent_norm"), "agent_norm", "left_anti").withColumn("hop", F.lit(hop)), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def path(edges: DataFrame, source: str, target: str, most: int = 12, stored: bool = False) -> list[tuple[str, str]] | None:
    """The hops of a shortest path, or None where it is longer than ``most``; ties by the least name."""
    return _shortest(_pairs(edges, stored), source, target, most)


def _next(pairs: DataFrame, front: DataFrame) -> DataFrame:
    """(agent_norm, parent): the neighbours of a front, each with its least neighbour there.

    Edges are read as they lie, from either end, so that a step moves only those that its front touches.
    """
    at = lambda x, y: pairs.join(front.select(F.col("agent_norm").alias(x)), x).select(F.col(y).alias("agent_norm"), F.col(x).alias("parent"))
    return at("source", "target").unionByName(at("target", "source")).groupBy("agent_norm").agg(F.min("parent").alias("parent"))


def _shortest(pairs: DataFrame, source: str, target: str, most: int) -> list[tuple[str, str]] | None:
    """Fronts grow from both ends, the smaller first, a whole step at a time, until they meet.

    What is on a shortest path on the target's side is then found from where they met: the agents of its
    fronts that follow, step by step, each with its least predecessor. So the hops are those that a search
    from the source alone would give, and one join of all steps reads them.
    """
    if source == target:
        return []
    start = lambda a: pairs.sparkSession.createDataFrame([(a, None)], "agent_norm string, parent string")
    sides = ([start(source)], [start(target)])  # the fronts of each end, by step
    seen, sizes = [s[0].select("agent_norm") for s in sides], [1, 1]
    for _ in range(most):
        k = 0 if sizes[0] <= sizes[1] else 1
        front = kept(_next(pairs, sides[k][-1]).join(seen[k], "agent_norm", "left_anti"), "front")
        sizes[k] = front.count()
        if not sizes[k]:
            return None
        sides[k].append(front)
        seen[k] = seen[k].unionByName(front.select("agent_norm"))
        met = sides[0][-1].join(sides[1][-1].select("agent_norm"), "agent_norm", "left_semi")
        if not met.isEmpty():
            break
    else:
        return None
    steps = [*sides[0][1:-1], met] if len(sides[0]) > 1 else []
    at = met
    for front in sides[1][-2::-1]:
        at = kept(_next(pairs, at).join(front.select("agent_norm"), "agent_norm", "left_semi"), "way")
        steps.append(at)
    n = len(steps)
    trace = steps[-1].where(F.col("agent_norm") == target).select(F.col("agent_norm").alias(f"x{n}"), F.col("parent").alias(f"x{n - 1}"))
    for i in range(n - 1, 0, -1):
        trace = trace.join(steps[i - 1].select(F.col("agent_norm").alias(f"x{i}"), F.col("parent").alias(f"x{i - 1}")), f"x{i}")
    row = trace.first()
    return [(row[f"x{i}"], row[f"x{i + 1}"]) for i in range(n)]


def search(cat: Catalog, q: str, limit: int = 20) -> DataFrame:
    """(agent_norm, via_alias, alias_form): agents whose norm, or else an alias, holds the text."""
    needle = q.strip().lower()
    direct = cat.agents.where(F.lower("agent_norm").contains(needle)).select("agent_norm", F.lit(0).alias("via"), F.lit(None).cast("string").alias("alias_form"))
    ways = [direct.distinct()]
    if cat.has_aliases:
        alias = cat.agent_aliases.where(F.col("alias_form_lower").contains(needle)).join(cat.agent_authorities.select(F.col("id").alias("authority_id"), "authority_uri"), "authority_id")
        ways.append(cat.agents.join(alias, "authority_uri").select("agent_norm", F.lit(1).alias("via"), "alias_form").distinct())
    found = reduce(DataFrame.unionByName, ways).groupBy("agent_norm").agg(F.min(F.struct("via", "alias_form")).alias("m"))
    return found.select("agent_norm", (F.col("m.via") == 1).alias("via_alias"), "m.alias_form").orderBy("via_alias", "agent_norm").limit(limit)


def connections(cat: Catalog, names: list[str], most: int = 20) -> DataFrame:
    """(a, b, relationship, confidence): how the named agents are connected, one way a pair.

    Teaching goes before shared records of different roles, that before the same place and time, that
    before an encyclopedia's mention. Over 50 names have no connections.
    """
    spark = cat.records.sparkSession
    asked = spark.createDataFrame([(n,) for n in dict.fromkeys(names)], "name string")
    if len(set(names)) > 50:
        return spark.createDataFrame([], "a string, b string, relationship string, confidence double")
    known = resolve_names(cat, asked)
    lost = [r["name"] for r in asked.join(known, "name", "left_anti").collect()]  # of at most 50
    own = F.broadcast(known.unionByName(loose_names(cat, lost)).select("agent_norm").distinct())  # at most 50 rows
    agents = cat.agents.join(own, "agent_norm", "left_semi")
    rows = record_pairs(agents).where(~F.col("ra").eqNullSafe(F.col("rb"))).groupBy("a", "b").agg(F.count_distinct("record_id").alias("n")).where("n >= 2")
    ways = [rows.select("a", "b", F.lit("co_publication").alias("relationship"), F.lit(0.85).alias("confidence"), F.lit(2).alias("rank"))]
    if cat.authority_enrichment is not None:
        taught = teacher_student(cat).join(own, F.col("source") == F.col("agent_norm"), "left_semi").join(own, F.col("target") == F.col("agent_norm"), "left_semi")
        ways.append(taught.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), F.lit("teacher_of").alias("relationship"), F.lit(0.90).alias("confidence"), F.lit(1).alias("rank")))
        near = lifespan_overlap(person(cat).join(own, "agent_norm", "left_semi"))
        ways.append(near.select("a", "b", F.lit("same_place_period").alias("relationship"), F.lit(0.70).alias("confidence"), F.lit(3).alias("rank")))
        if cat.wikipedia_cache is not None:
            wiki = wiki_links(cat).where("type != 'category'").join(own, F.col("source") == F.col("agent_norm"), "left_semi").join(own, F.col("target") == F.col("agent_norm"), "left_semi")
            ways.append(wiki.select(F.col("source").alias("a"), F.col("target").alias("b"), F.lit("wikipedia_mention").alias("relationship"), "confidence", F.lit(4).alias("rank")))
    found = first_wins(reduce(DataFrame.unionByName, ways), ["a", "b"], ["rank", "relationship"])
    return found.orderBy("rank", F.desc("confidence"), "a", "b").limit(most).drop("rank")


def topic_details(cat: Catalog) -> DataFrame:
    """(topic, records, peak): subjects by the first part of their heading."""
    rows = cat.subjects.where("value is not null").select("record_id", text.subject_root(F.col("value")).alias("topic")).distinct()
    years = cat.imprints.where("date_start is not null").groupBy("record_id").agg(text.decade(F.min("date_start")).alias("decade"))
    counts = rows.join(years, "record_id", "left").groupBy("topic", "decade").agg(F.count("*").alias("n"))
    best = F.when(F.col("decade").isNotNull(), F.struct("n", -F.col("decade")))
    return counts.groupBy("topic").agg(F.sum("n").alias("records"), F.max_by("decade", best).alias("peak"))


def place_details(cat: Catalog, least: int = 1) -> DataFrame:
    """(place, records, first, last, publishers)."""
    im = cat.imprints.where("place_norm is not null and place_norm != '[sine loco]'")
    return im.groupBy(F.col("place_norm").alias("place")).agg(F.count_distinct("record_id").alias("records"), F.min("date_start").alias("first"), F.max("date_start").alias("last"), F.count_distinct("publisher_norm").alias("publishers")).where(F.col("records") >= least)


def works(cat: Catalog, agent: str, limit: int = 20) -> DataFrame:
    """(mms_id, title, year): an agent's records, the dated first."""
    own = cat.agents.where(F.col("agent_norm") == agent).select("record_id").distinct()
    title = cat.titles.where("title_type = 'main'").groupBy("record_id").agg(F.min_by("value", "id").alias("title"))
    year = cat.imprints.groupBy("record_id").agg(F.min("date_start").alias("year"))
    out = cat.records.select(F.col("id").alias("record_id"), "mms_id").join(own, "record_id", "left_semi").join(title, "record_id", "left").join(year, "record_id", "left")
    return out.select("mms_id", "title", "year").orderBy(F.asc_nulls_last("year"), "mms_id").limit(limit)


def alternate_script_name(cat: Catalog) -> DataFrame:
    """(authority_id, name): an authority's alias in a script other than its name's."""
    a = cat.agent_aliases.join(cat.agent_authorities.select(F.col("id").alias("authority_id"), text.script(F.col("canonical_name")).alias("own")), "authority_id")
    return a.where(text.script(F.col("alias_form")) != F.col("own")).groupBy("authority_id").agg(F.min_by("alias_form", "id").alias("name"))


def agent_detail(cat: Catalog, node_table: DataFrame, edges: DataFrame, agent: str) -> DataFrame:
    """One row of all that is known of a node: itself, another script's name, summary, links, connections.

    ``connections`` is array<struct<agent_norm, display_name, type, relationship, evidence, confidence>>,
    without shared categories. No row where there is no such node.
    """
    from . import enrichment

    own = node_table.where(F.col("agent_norm") == agent)
    other = F.when(F.col("source") == agent, F.col("target")).otherwise(F.col("source"))
    arcs = edges.where(((F.col("source") == agent) | (F.col("target") == agent)) & (F.col("type") != "category")).select(other.alias("agent_norm"), "type", "relationship", "evidence", "confidence")
    arcs = arcs.join(node_table.select("agent_norm", "display_name"), "agent_norm", "left").withColumn("display_name", F.coalesce("display_name", "agent_norm"))
    arc = F.struct("agent_norm", "display_name", "type", "relationship", "evidence", "confidence")
    arcs = arcs.agg(F.array_sort(F.collect_list(arc)).alias("connections"))
    out = own.join(F.broadcast(arcs))  # one row
    uri = cat.agents.where(F.col("agent_norm") == agent).agg(F.min("authority_uri").alias("_uri"))
    out = out.join(F.broadcast(uri))  # one row
    if cat.authority_enrichment is not None:
        ae = cat.authority_enrichment.groupBy(F.col("authority_uri").alias("_uri")).agg(F.min_by(F.struct("wikidata_id", "wikipedia_url"), F.struct("wikidata_id", "wikipedia_url")).alias("_e"))
        out = out.join(ae, "_uri", "left").withColumn("links", enrichment.links(F.col("_e.wikipedia_url"), {"wikidata": F.col("_e.wikidata_id")}))
        if cat.wikipedia_cache is not None:
            pages = cat.wikipedia_cache.groupBy(F.col("wikidata_id").alias("_q")).agg(F.max("summary").alias("summary"))
            out = out.join(pages, F.col("_e.wikidata_id") == F.col("_q"), "left").drop("_q")
    if cat.has_aliases:
        alt = alternate_script_name(cat).join(cat.agent_authorities.select(F.col("id").alias("authority_id"), F.col("authority_uri").alias("_uri")), "authority_id").groupBy("_uri").agg(F.min("name").alias("name_alt"))
        out = out.join(alt, "_uri", "left")
    return out.drop("_uri", "_e")
