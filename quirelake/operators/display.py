"""Records for display: one row each, samples of them, full lookup, pages of a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores, text
from ..sources.catalog import Catalog
from .facets import within


def first_rows(df: DataFrame, key: str, order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of every key in a total order."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def display(cat: Catalog, scope: DataFrame | None = None) -> DataFrame:
    """What a list of results shows of each record; where several rows could serve, the first by id."""
    records = within(cat.records, scope, "id").select(F.col("id").alias("record_id"), "mms_id")
    order = lambda t: F.struct(*[c for c in ("occurrence", "agent_index", "id") if c in t.columns])
    own = lambda t: within(t, scope)
    titles = own(cat.titles).where(F.coalesce(F.array_join("source", ",").contains("245"), F.col("title_type") == "main"))
    titles = titles.groupBy("record_id").agg(text.shorten(F.min_by("value", order(titles)), 100).alias("title"))
    authors = own(cat.agents).where(F.col("role_norm") == "author")
    authors = authors.groupBy("record_id").agg(text.shorten(F.min_by("agent_raw", order(authors)), 80).alias("author"))
    im = own(cat.imprints)
    shown = [c for c in ("date_start", "date_end", "place_norm", "place_raw", "publisher_raw") if c in im.columns]
    im = im.groupBy("record_id").agg(F.min_by(F.struct(*shown), order(im)).alias("i")).select("record_id", "i.*")
    if "publisher_raw" in shown:
        im = im.withColumn("publisher", text.shorten(F.col("publisher_raw"), 60)).drop("publisher_raw")
    subjects = first_rows(own(cat.subjects).where("value is not null"), "record_id", [F.col("id")], 3)
    subjects = subjects.groupBy("record_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "value"))), lambda s: text.shorten(s["value"], 50)).alias("subjects"))
    notes = own(cat.notes).where(F.col("tag").isin("520", "500") & (F.col("value") != ""))
    notes = notes.groupBy("record_id").agg(text.shorten(F.min_by("value", F.struct(F.when(F.col("tag") == "520", 1).otherwise(2), F.col("id"))), 200).alias("description"))
    return reduce(lambda a, b: a.join(b, "record_id", "left"), [titles, authors, im, subjects, notes], records)


def grounding(cat: Catalog, scope: DataFrame, most: int = 30, base_url: str = "") -> DataFrame:
    """Summaries of at most ``most`` records, the first by mms_id, for a narrator to draw on."""
    chosen = within(cat.records, scope, "id").orderBy("mms_id").limit(most).select(F.col("id").alias("record_id"), "mms_id")
    few = F.broadcast(chosen)  # at most ``most`` rows
    own = lambda t: t.join(few.select("record_id"), "record_id")
    main = own(cat.titles.where("title_type = 'main'"))
    title = main.groupBy("record_id").agg(F.min_by("value", "id").alias("title"))
    im = own(cat.imprints)
    im = im.groupBy("record_id").agg(F.min_by(F.struct(F.coalesce("date_label", F.col("date_start").cast("string")).alias("date"), F.coalesce("place_display", "place_norm").alias("place"), F.coalesce("publisher_display", "publisher_norm").alias("publisher")), F.struct("occurrence", "id")).alias("i")).select("record_id", "i.*")
    agents = own(cat.agents).groupBy("record_id").agg(F.array_sort(F.collect_set("agent_norm")).alias("agents"))
    subjects = own(cat.subjects).groupBy("record_id").agg(F.array_sort(F.collect_set("value")).alias("subjects"))
    notes = first_rows(own(cat.notes), "record_id", [F.when(F.col("tag") == "520", 0).otherwise(1), F.col("id")], 3)
    notes = notes.groupBy("record_id").agg(F.array_sort(F.collect_list(F.substring("value", 1, 200))).alias("notes"))
    out = reduce(lambda a, b: a.join(b, "record_id", "left"), [title, im, agents, subjects, notes], chosen)
    return out.withColumn("url", text.record_url(base_url, F.col("mms_id"))).drop("record_id").orderBy("mms_id")


def full_record(cat: Catalog, mms_id: str) -> DataFrame:
    """One row with a record and its child rows as arrays; none where there is no such record."""
    record = cat.records.where(F.col("mms_id") == mms_id)
    out = record
    for name in ("imprints", "titles", "subjects", "agents", "languages", "notes", "physical_descriptions"):
        t = getattr(cat, name)
        kids = t.join(F.broadcast(record.select(F.col("id").alias("record_id"))), "record_id").groupBy("record_id").agg(F.collect_list(F.struct(*[c for c in t.columns if c != "record_id"])).alias(name))
        out = out.join(kids, F.col("id") == F.col("record_id"), "left").drop("record_id")
    return out


def earliest(cat: Catalog, scope: DataFrame | None, n: int) -> DataFrame:
    """(mms_id, date_start): the n oldest records, those without a date last."""
    years = within(cat.imprints, scope).groupBy("record_id").agg(F.min("date_start").alias("date_start"))
    df = within(cat.records, scope, "id").join(years, F.col("id") == F.col("record_id"), "left").select("mms_id", "date_start")
    return df.orderBy(F.asc_nulls_last("date_start"), "mms_id").limit(n)


def diverse(cat: Catalog, scope: DataFrame | None, n: int) -> DataFrame:
    """(mms_id, decade): n records taken from the decades in turn; records without a date are left out.

    Of each decade only its first n records can be reached, so the window keeps no more.
    """
    years = within(cat.imprints, scope).where("date_start is not null").groupBy("record_id").agg(text.decade(F.min("date_start")).alias("decade"))
    df = cat.records.join(years, F.col("id") == F.col("record_id")).select("mms_id", "decade")
    w = Window.partitionBy("decade").orderBy("mms_id")
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).orderBy("_n", "decade").limit(n).drop("_n")


def curation_scores(cat: Catalog, scope: DataFrame | None = None) -> DataFrame:
    """display() with the record's language and extent, and ``score``: what it counts without diversity."""
    d = display(cat, scope)
    lang = within(cat.languages, scope).groupBy("record_id").agg(F.min_by("code", "id").alias("language"))
    extent = within(cat.physical_descriptions, scope).groupBy("record_id").agg(F.min_by("value", "id").alias("extent"))
    d = d.join(lang, "record_id", "left").join(extent, "record_id", "left")
    n = F.coalesce(F.size("subjects"), F.lit(0))
    n = F.when(F.col("subjects").isNull(), 0).otherwise(n)
    publisher = F.col("publisher") if "publisher" in d.columns else F.lit(None).cast("string")
    parts = {"temporal": scores.temporal(F.col("date_start")), "enrichment": scores.enrichment(n, publisher, F.col("author"), F.col("description"), F.col("title")), "subject_richness": scores.subject_richness(n), "visual": scores.visual(F.col("extent"))}
    return d.withColumn("score", scores.base_score(parts))


def notable(cat: Catalog, scope: DataFrame | None, n: int, weights: dict[str, float] = scores.WEIGHTS) -> list[dict]:
    """The n best records by score and by what they add to those chosen before, as rows.

    The bonus depends only on (decade, place, language), so of those that share these only the n
    best can be chosen: a window leaves them, and the choice goes through them in order of score. A
    record that scores less than the n-th best by more than the greatest bonus cannot be chosen either.
    """
    scored = curation_scores(cat, scope).withColumn("decade", text.decade(F.col("date_start")))
    least = scored.select("score").orderBy(F.desc("score")).limit(n).agg(F.min("score")).first()[0]
    scored = scored.where(F.col("score") >= F.lit(least) - weights["diversity"] - 1e-9)
    w = Window.partitionBy("decade", "place_norm", "language").orderBy(F.desc("score"), "mms_id")
    pool = scored.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).select("mms_id", "decade", "place_norm", "language", "score", "title")
    chosen: list[dict] = []
    seen: dict[str, set] = {"decade": set(), "place_norm": set(), "language": set()}
    worth = {"decade": 0.34, "place_norm": 0.33, "language": 0.33}
    best: dict[tuple, list] = {}
    for r in pool.orderBy(F.desc("score"), "mms_id").toLocalIterator(prefetchPartitions=True):
        best.setdefault((r["decade"], r["place_norm"], r["language"]), []).append(r)
    while len(chosen) < n and best:
        bonus = lambda r: sum(x for c, x in worth.items() if r[c] and r[c] not in seen[c])
        key = min(best, key=lambda k: (-(best[k][0]["score"] + weights["diversity"] * bonus(best[k][0])), best[k][0]["mms_id"]))
        r = best[key].pop(0)
        if not best[key]:
            del best[key]
        chosen.append(r.asDict() | {"total": round(r["score"] + weights["diversity"] * bonus(r), 6)})
        for c in seen:
            seen[c].add(r[c])
    return chosen


#: Words in a question that ask for agents by what they did.
ROLE_WORDS = ("printer", "publisher", "bookseller", "author", "editor", "translator", "compiler")


def chosen_profiles(profiles: DataFrame, mentions: DataFrame, question: str, resolved: DataFrame | None = None, most: int = 3) -> DataFrame:
    """At most ``most`` of profiles(label, occupations, records, ...) that an answer should tell of.

    Those that a step resolved or enriched, resolved(name); those in three records or more of
    mentions(mms_id, name); and where the question names what agents did, those who did it or whom it
    names. In this order, then by name. Without any of these none.
    """
    asked = question.lower()
    key = F.lower("label")
    often = mentions.groupBy(F.lower("name").alias("_k")).agg(F.count("*").alias("_n")).where("_n >= 3").select("_k", F.lit(1).alias("_rank"))
    ways = [often]
    if resolved is not None:
        ways.append(resolved.select(F.lower("name").alias("_k"), F.lit(0).alias("_rank")))
    told = reduce(DataFrame.unionByName, ways).groupBy("_k").agg(F.min("_rank").alias("_rank"))
    out = profiles.join(told, key == F.col("_k"), "left")
    if any(w in asked for w in ROLE_WORDS):
        did = F.exists(F.coalesce("occupations", F.array().cast("array<string>")), lambda o: reduce(lambda a, b: a | b, [F.lower(o).contains(w) for w in ROLE_WORDS]))
        out = out.withColumn("_rank", F.coalesce("_rank", F.when(did | F.lit(asked).contains(key), 2)))
    return out.where("_rank is not null").orderBy("_rank", "label").limit(most).drop("_k", "_rank")


def browse(df: DataFrame, order: str, search: str | None = None, offset: int = 0, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """(a page of the table's rows that hold ``search`` in any string column, how many such rows there are)."""
    if search:
        texts = [c for c, t in df.dtypes if t == "string"]
        df = df.where(reduce(lambda a, b: a | b, [F.lower(c).contains(search.lower()) for c in texts]))
    return df.orderBy(order).offset(offset).limit(limit), df.agg(F.count("*").alias("total"))


def table_sizes(cat: Catalog) -> DataFrame:
    """(table, rows, columns) of the catalogue's tables."""
    parts = [t.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows", F.array(*[F.lit(c) for c in t.columns]).alias("columns")) for name, t in cat.tables().items()]
    return reduce(DataFrame.unionByName, parts)
