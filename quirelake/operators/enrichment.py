"""What is known of agents beyond the catalogue: profiles, a cache with lifetimes, faceted search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sources.catalog import PERSON, Catalog, last_wins

LINKS = {"wikidata": "https://www.wikidata.org/wiki/", "viaf": "https://viaf.org/viaf/", "nli": "https://www.nli.org.il/en/authorities/"}


def repair_url(url: Column, wikidata_id: Column) -> Column:
    """A redirecting link replaced by one to the item."""
    return F.when(url.contains("Special:GoToLinkedPage"), F.concat(F.lit(LINKS["wikidata"]), wikidata_id)).otherwise(url)


def links(wikipedia: Column, ids: dict[str, Column]) -> Column:
    """array<struct<label, url>> of the links that there are."""
    made = [F.struct(F.lit("wikipedia").alias("label"), wikipedia.alias("url"))]
    made += [F.struct(F.lit(k).alias("label"), F.concat(F.lit(LINKS[k]), c).alias("url")) for k, c in ids.items()]
    return F.filter(F.array(*made), lambda x: x["url"].isNotNull())


def parsed(cat: Catalog) -> DataFrame:
    return cat.authority_enrichment.withColumn("person", F.from_json("person_info", PERSON))


def profiles(cat: Catalog, names: list[str], among: DataFrame | None = None) -> DataFrame:
    """(agent_norm, label, description, birth_year, death_year, occupations, aliases, links, records).

    Of the agents named, and of those in among(agent_norm).
    """
    wanted = [n.lower() for n in names]
    asked = cat.agents.where(F.col("agent_norm").isin(wanted))
    if among is not None:
        told = among.select(F.lower("agent_norm").alias("agent_norm")).where(~F.col("agent_norm").isin(wanted)).distinct()
        asked = asked.unionByName(cat.agents.join(told, "agent_norm", "left_semi"))
    own = asked.groupBy("agent_norm").agg(F.min("authority_uri").alias("authority_uri"), F.count_distinct("record_id").alias("records"))
    if cat.authority_enrichment is None:
        return own.select("agent_norm", text.title_case(F.col("agent_norm")).alias("label"), "records")
    ae = parsed(cat).select("authority_uri", "label", "description", "wikidata_id", "wikipedia_url", "person.*")
    out = own.join(ae, "authority_uri", "left")
    description = F.col("description")
    if cat.wikipedia_cache is not None:
        pages = cat.wikipedia_cache.groupBy("wikidata_id").agg(F.max("summary").alias("summary"))
        out = out.join(pages, "wikidata_id", "left")
        description = F.when(F.length("summary") > F.coalesce(F.length("description"), F.lit(0)), F.substring("summary", 1, 500)).otherwise(description)
    out = out.withColumn("description", description)
    if cat.has_aliases:
        a = cat.agent_aliases.join(cat.agent_authorities.select(F.col("id").alias("authority_id"), "authority_uri"), "authority_id").groupBy("authority_uri").agg(F.array_sort(F.collect_set("alias_form")).alias("aliases"))
        out = out.join(a, "authority_uri", "left")
    else:
        out = out.withColumn("aliases", F.array().cast("array<string>"))
    return out.select("agent_norm", F.coalesce("label", text.title_case(F.col("agent_norm"))).alias("label"), "description", "birth_year", "death_year", "occupations", "aliases", links(repair_url(F.col("wikipedia_url"), F.col("wikidata_id")), {"wikidata": F.col("wikidata_id")}).alias("links"), "records")


def where(search: str | None = None, role: str | None = None, occupation: str | None = None, century: int | None = None, has_bio: bool | None = None, has_image: bool | None = None) -> Column:
    """The condition of a faceted search over agents(agent_norm, label, description, role_norm, person, image_url)."""
    keep = F.lit(True)
    if search:
        q = search.lower()
        keep = keep & (F.lower("agent_norm").contains(q) | F.coalesce(F.lower("label").contains(q), F.lit(False)) | F.coalesce(F.lower("description").contains(q), F.lit(False)))
    if role == "(none)":
        keep = keep & (F.coalesce("role_norm", F.lit("")) == "")
    elif role:
        keep = keep & (F.col("role_norm") == role)
    if occupation:
        keep = keep & F.array_contains("person.occupations", occupation)
    if century:
        keep = keep & (F.col("person.birth_year") >= (century - 1) * 100) & (F.col("person.birth_year") < century * 100)
    if has_bio is not None:
        keep = keep & ((F.col("person.birth_year").isNotNull() | F.col("description").isNotNull()) == has_bio)
    if has_image is not None:
        keep = keep & (F.col("image_url").isNotNull() == has_image)
    return keep


def enriched(cat: Catalog) -> DataFrame:
    return cat.agents.select("agent_norm", "agent_raw", "record_id", "role_norm", "authority_uri").join(parsed(cat), "authority_uri")


def facets_except_own(cat: Catalog, **chosen) -> dict[str, DataFrame]:
    """(value, count) of roles, occupations and birth centuries, each under all other choices."""
    rows = enriched(cat)
    entity = F.coalesce("wikidata_id", "agent_norm")
    rest = lambda own: rows.where(where(**{k: v for k, v in chosen.items() if k != own}))
    count = lambda df: df.groupBy("value").agg(F.count_distinct("entity").alias("count"))
    return {
        "role": count(rest("role").select(F.coalesce("role_norm", F.lit("(none)")).alias("value"), entity.alias("entity"))),
        "occupation": count(rest("occupation").select(F.explode("person.occupations").alias("value"), entity.alias("entity"))).orderBy(F.desc("count"), "value").limit(25),
        "century": count(rest("century").where("person.birth_year is not null").select((F.floor(F.col("person.birth_year") / 100) + 1).cast("int").alias("value"), entity.alias("entity"))),
    }


def grouped(cat: Catalog, limit: int = 50, offset: int = 0, **chosen) -> DataFrame:
    """(entity, agent_norm, names, roles, records): agents that share an item are one row."""
    rows = enriched(cat).where(where(**chosen))
    out = rows.groupBy(F.coalesce("wikidata_id", "agent_norm").alias("entity")).agg(F.min("agent_norm").alias("agent_norm"), F.array_join(F.array_sort(F.collect_set("agent_raw")), ",").alias("names"), F.array_join(F.array_sort(F.collect_set("role_norm")), ",").alias("roles"), F.count_distinct("record_id").alias("records"))
    return out.orderBy(F.desc("records"), "entity").offset(offset).limit(limit)


def cache_get(cache: DataFrame, kind: str, key: str, now: Column) -> DataFrame:
    """The live entry of a key: one that has not expired."""
    return cache.where((F.col("kind") == kind) & (F.col("key") == " ".join(key.lower().split())) & (F.col("expires_at") > now))


def cache_put(cache: DataFrame, entries: DataFrame) -> DataFrame:
    """The cache with entries(kind, key, source, value, fetched_at, expires_at) put over the old."""
    return last_wins(cache.unionByName(entries), ["kind", "key", "source"], ["fetched_at", "expires_at"])


def cache_sweep(cache: DataFrame, now: Column) -> DataFrame:
    return cache.where(F.col("expires_at") > now)
