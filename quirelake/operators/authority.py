"""Authorities: seeding, aliases, look-up, corrections, scope flags, roles, fuzzy linkage.

Tables are values here: what would be an UPDATE returns the table as it is after it.
"""

from __future__ import annotations

import difflib
import hashlib
import math
import zlib
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import names, text
from ..shared import kept, workers_import
from ..sources.catalog import PERSON, Catalog, first_wins


def seed(cat: Catalog) -> tuple[DataFrame, DataFrame]:
    """(agent_authorities, agent_aliases) from enrichment, and from agents that it does not name.

    Of equal names the first is kept: those with enrichment first, then by name.
    """
    rows = []
    if cat.authority_enrichment is not None:
        rows.append(cat.authority_enrichment.where("label is not null").select(F.col("label").alias("canonical_name"), "authority_uri", "wikidata_id", F.lit(0.95).alias("confidence"), F.lit(0).alias("rank")))
    by_agent = cat.agents.where("agent_norm is not null").groupBy("agent_norm").agg(F.min("authority_uri").alias("authority_uri"))
    if rows:
        by_agent = by_agent.join(rows[0].where("authority_uri is not null").select("authority_uri").distinct(), "authority_uri", "left_anti")
    rows.append(by_agent.select(F.col("agent_norm").alias("canonical_name"), "authority_uri", F.lit(None).cast("string").alias("wikidata_id"), F.lit(0.80).alias("confidence"), F.lit(1).alias("rank")))
    a = reduce(DataFrame.unionByName, rows).withColumn("canonical_name_lower", F.lower("canonical_name"))
    a = first_wins(a, ["canonical_name_lower"], ["rank", "authority_uri"]).drop("rank")
    a = a.withColumn("id", F.xxhash64("canonical_name_lower"))
    own = a.select(F.col("id").alias("authority_id"), F.col("canonical_name").alias("alias_form"), F.lit("primary").alias("alias_type"), F.lit(0).alias("rank"))
    turned = a.select(F.col("id").alias("authority_id"), text.reorder_name(F.col("canonical_name")).alias("alias_form"), F.lit("word_reorder").alias("alias_type"), F.lit(1).alias("rank"))
    ways = [own, turned]
    if cat.authority_enrichment is not None:
        he = cat.authority_enrichment.select("authority_uri", F.from_json("person_info", PERSON)["hebrew_label"].alias("alias_form")).join(a.select("authority_uri", F.col("id").alias("authority_id")), "authority_uri")
        ways.append(he.select("authority_id", "alias_form", F.lit("cross_script").alias("alias_type"), F.lit(2).alias("rank")))
    return a, first_aliases(reduce(DataFrame.unionByName, ways))


def first_aliases(aliases: DataFrame) -> DataFrame:
    """aliases(authority_id, alias_form, alias_type, rank) with each form at its first authority."""
    a = aliases.where("alias_form is not null and alias_form != ''").withColumn("alias_form_lower", F.lower("alias_form"))
    return first_wins(a, ["alias_form_lower"], ["rank", "authority_id"]).drop("rank").withColumn("script", text.script(F.col("alias_form")))


def put(table: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """The table with rows added, or put in the place of those with their key."""
    return table.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def remove(table: DataFrame, variants: DataFrame, ids: list[int]) -> tuple[DataFrame, DataFrame]:
    """(table, variants) without the authorities of these ids, nor their forms."""
    return table.where(~F.col("id").isin(ids)), variants.where(~F.col("authority_id").isin(ids))


def by_form(variants: DataFrame, form: str, column: str = "variant_form_lower") -> DataFrame:
    """The authority ids that a form belongs to."""
    return variants.where(F.col(column) == form.strip().lower()).select("authority_id").distinct()


def linked_counts(cat: Catalog) -> DataFrame:
    """(publisher, imprints): imprints by the authority that their publisher's name or variant belongs to."""
    keys = cat.publisher_authorities.select(F.col("id").alias("publisher"), F.col("canonical_name_lower").alias("k")).unionByName(cat.publisher_variants.select(F.col("authority_id").alias("publisher"), F.col("variant_form_lower").alias("k"))).distinct()
    return cat.imprints.select(F.lower("publisher_norm").alias("k")).join(keys, "k").groupBy("publisher").agg(F.count("*").alias("imprints"))


def correct(imprints: DataFrame, field: str, raw: str, canonical: str) -> DataFrame:
    """The imprints with all of a raw value's rows set to a canonical one."""
    hit = F.col(f"{field}_raw") == raw
    put = {f"{field}_norm": F.lit(canonical), f"{field}_confidence": F.lit(0.95), f"{field}_method": F.lit(f"{field}_alias_map_correction")}
    return imprints.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in put.items()})


def corrections(imprints: DataFrame, field: str, table: DataFrame) -> DataFrame:
    """The imprints after table(raw, canonical), many corrections at once."""
    t = table.select(F.col("raw").alias(f"{field}_raw"), F.col("canonical").alias("_to")).dropDuplicates([f"{field}_raw"])
    df = imprints.join(t, f"{field}_raw", "left")
    hit = F.col("_to").isNotNull()
    put = {f"{field}_norm": F.col("_to"), f"{field}_confidence": F.lit(0.95), f"{field}_method": F.lit(f"{field}_alias_map_correction")}
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in put.items()}).drop("_to").select(imprints.columns)


def trim_roles(agents: DataFrame) -> DataFrame:
    """The agents with roles that no map knew read again without their final stops."""
    lost = (F.col("role_method") == "unmapped") & F.col("role_raw").endswith(".")
    new = names.normalize_role(F.rtrim("role_raw", F.lit(". ")))
    found = lost & (new["method"] != "unmapped")
    put = {"role_norm": new["value"], "role_confidence": new["confidence"], "role_method": new["method"]}
    return agents.withColumns({c: F.when(found, v).otherwise(F.col(c)) for c, v in put.items() if c in agents.columns})


def lower_schemes(subjects: DataFrame, scheme: str) -> DataFrame:
    """The subjects with every spelling of a scheme's name in lower case."""
    return subjects.withColumn("scheme", F.when(F.lower("scheme") == scheme.lower(), scheme.lower()).otherwise(F.col("scheme")))


def replace_by_code(imprints: DataFrame, table: DataFrame) -> DataFrame:
    """The imprints after table(place_norm, country_code, canonical): places that mean another in a country."""
    t = table.select("place_norm", "country_code", F.col("canonical").alias("_to")).dropDuplicates(["place_norm", "country_code"])
    df = imprints.join(t, ["place_norm", "country_code"], "left")
    put = {"place_norm": F.col("_to"), "place_confidence": F.lit(0.95), "place_method": F.lit("place_country_correction")}
    return df.withColumns({c: F.when(F.col("_to").isNotNull(), v).otherwise(F.col(c)) for c, v in put.items()}).select(imprints.columns)


def merge_norms(agents: DataFrame) -> DataFrame:
    """The agents of one authority under one norm: the one with most records, by name where equal."""
    w = Window.partitionBy("authority_uri").orderBy(F.desc("_n"), "agent_norm")
    n = agents.where("authority_uri is not null and agent_norm is not null").groupBy("authority_uri", "agent_norm").agg(F.count_distinct("record_id").alias("_n"))
    best = n.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("authority_uri", F.col("agent_norm").alias("_to"))
    return agents.join(best, "authority_uri", "left").withColumn("agent_norm", F.coalesce("_to", "agent_norm")).select(agents.columns)


def fill_countries(imprints: DataFrame, codes: DataFrame) -> DataFrame:
    """The imprints with the names of their country codes from codes(key, value) where they lack one."""
    t = codes.select(names.country_key(F.col("key")).alias("_k"), F.col("value").alias("_name")).dropDuplicates(["_k"])
    df = imprints.withColumn("_k", names.country_key(F.col("country_code"))).join(t, "_k", "left")
    return df.withColumn("country_name", F.coalesce("country_name", "_name")).select(imprints.columns)


def scope_flags(cat: Catalog) -> DataFrame:
    """(record_id, flag): records outside the collection's time."""
    y = F.col("date_start")
    return cat.imprints.select("record_id", F.when(y > 1950, "modern").when(y < 1400, "before_print").alias("flag")).where("flag is not null").distinct()


def infer_roles(occupations: DataFrame, direct: DataFrame, priority: list[str]) -> DataFrame:
    """(agent_norm, role, confidence): occupations(agent_norm, occupation) by direct(occupation, role, confidence).

    An exact name goes before one in another case; of a role the best confidence, of an agent the
    first role by priority.
    """
    exact = occupations.join(direct.select("occupation", "role", "confidence"), "occupation").select("agent_norm", "role", "confidence", F.lit(0).alias("way"))
    loose = occupations.withColumn("k", F.lower("occupation")).join(direct.select(F.lower("occupation").alias("k"), "role", "confidence"), "k").select("agent_norm", "role", "confidence", F.lit(1).alias("way"))
    found = exact.unionByName(loose).groupBy("agent_norm", "role").agg(F.max(F.struct(-F.col("way"), "confidence"))["confidence"].alias("confidence"))
    place = F.coalesce(F.array_position(F.array(*[F.lit(r) for r in priority]), F.col("role")), F.lit(0))
    return first_wins(found.withColumn("_p", F.when(place == 0, 10_000).otherwise(place)), ["agent_norm"], ["_p", "role"]).drop("_p")


#: Texts with the same two letter pairs that meet as many others at once.
CELL = 2000
#: Pairs of letters, by how many names have them, whose order by frequency every task knows.
KNOWN_PAIRS = 4096


def letter_pairs(t: str) -> list[tuple[str, int]]:
    """The neighbouring letters of a text between two walls, with the how-manieth each is of its kind."""
    seen: dict[str, int] = {}
    out = []
    walled = f"\x02{t}\x03"
    for i in range(len(walled) - 1):
        p = walled[i : i + 2]
        seen[p] = seen.get(p, 0) + 1
        out.append((p, seen[p]))
    return out


def letter_bits(t: str) -> tuple[int, int]:
    """128 bits, one set for each letter with the how-manieth it is: what only one of two texts has can't be in both."""
    seen: dict[str, int] = {}
    bits = [0, 0]
    for c in t:
        seen[c] = seen.get(c, 0) + 1
        h = zlib.crc32(f"{c}{seen[c]}".encode())
        bits[h & 1] |= 1 << (h >> 1 & 63)
    return tuple(b - (1 << 64) if b >> 63 else b for b in bits)


def rarest(t: str, least: float, rank: dict[str, int]) -> list[int]:
    """The rarest letter pairs as numbers, in one order for all texts.

    Of the pairs that two texts of ratio ``least`` have in common, at least two are among these of either.
    """
    n = len(t)
    common = math.ceil((1.5 * least - 1) * (n + n * least / (2 - least)) + 1 - 1e-9)  # with the shortest that can be so alike
    order = sorted((rank.get(p, 0) << 48) | int.from_bytes(hashlib.blake2b(f"{p}{k}".encode(), digest_size=6).digest()) for p, k in letter_pairs(t))
    return order[: max(2, len(order) - common + 2)]


def alike(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(a, b): the pairs of left(a) and right(b), distinct texts, that can have a ratio of ``least``.

    With texts of m and n letters, a ratio r means that r (m + n) / 2 letters match in order. So (1.5 r - 1)
    (m + n) + 1 pairs of neighbours are in both, which is over one where r is over two thirds. Texts meet
    where two of their rarest pairs are the same; then their lengths and letters must allow the ratio. A
    crowd that shares two pairs is dealt into cells. Python finds a text's rarest pairs; the rest is Spark's.
    """
    if not 1.5 * least > 1:
        raise ValueError("the least ratio must be over two thirds")
    workers_import()
    spark = left.sparkSession

    def pairs(batches):
        for b in batches:
            yield pd.DataFrame({"p": [p for t in b["text"] for p in {p for p, _ in letter_pairs(t)}]})

    both = left.select(F.col("a").alias("text")).unionByName(right.select(F.col("b").alias("text")))
    often = both.mapInPandas(pairs, "p string").groupBy("p").count().orderBy(F.desc("count"), "p").limit(KNOWN_PAIRS).collect()
    sent = left.sparkSession.sparkContext.broadcast({r["p"]: len(often) - i for i, r in enumerate(often)})

    def signed(batches):
        for b in batches:
            yield pd.DataFrame([(t, len(t), *letter_bits(t), rarest(t, least, sent.value)) for t in b["text"]], columns=["text", "n", "low", "high", "rare"])

    def side(df: DataFrame, c: str) -> DataFrame:
        out = kept(df.select(F.col(c).alias("text")).mapInPandas(signed, "text string, n int, low long, high long, rare array<long>"), "signatures")
        keys = F.flatten(F.transform("rare", lambda x, i: F.transform(F.slice("rare", i + 2, F.size("rare")), lambda y: F.xxhash64(x, y))))
        return out.select(*(F.col(x).alias(f"{c}_{x}") for x in ("text", "n", "low", "high")), F.explode(keys).alias("key"))

    def dealt(df: DataFrame, c: str, other: str) -> DataFrame:
        cells = F.sequence(F.lit(0).cast("long"), F.coalesce(f"cells_{other}", F.lit(1)) - 1)
        own = F.pmod(F.xxhash64(f"{c}_text"), F.coalesce(f"cells_{c}", F.lit(1))).alias(f"cell_{c}")
        return df.join(crowds, "key", "left").select(*df.columns, own, F.explode(cells).alias(f"cell_{other}"))

    a, b = side(left, "a"), side(right, "b")
    count = lambda df, c: df.groupBy("key").agg(F.ceil(F.count("*") / CELL).alias(f"cells_{c}"))
    crowds = kept(count(a, "a").join(count(b, "b"), "key").where("cells_a > 1 or cells_b > 1"), "crowds")
    only = lambda x, y: F.bit_count(F.col(f"{x}_low").bitwiseAND(F.bitwise_not(f"{y}_low"))) + F.bit_count(F.col(f"{x}_high").bitwiseAND(F.bitwise_not(f"{y}_high")))
    need = F.ceil((F.col("a_n") + F.col("b_n")) * (least / 2) - 1e-9)
    can = (F.least("a_n", "b_n") >= need) & (F.col("a_n") - only("a", "b") >= need) & (F.col("b_n") - only("b", "a") >= need)
    met = dealt(a, "a", "b").join(dealt(b, "b", "a"), ["key", "cell_a", "cell_b"]).where(can)
    return met.select(F.col("a_text").alias("a"), F.col("b_text").alias("b")).distinct()


def fuzzy_links(left: DataFrame, right: DataFrame, least: float = 0.80) -> DataFrame:
    """(name, match, ratio): for left(name) the most alike in right(match), over ``least`` by difflib.

    A match is compared in all its forms (``text.name_forms``), and the best ratio counts; of equal ones
    the first by name. Only names that share a word of three letters or more are compared, and of these
    only those that ``alike`` lets through, which loses none, whatever the tables' size.
    """
    workers_import()

    @F.pandas_udf(DoubleType())
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])

    words = lambda c: F.filter(F.split(F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " ")), " "), lambda x: F.length(x) >= 3)
    names = kept(left.select("name").distinct().withColumn("a", text.fold(F.col("name"))).where(F.size(words("a")) > 0), "names")
    forms = right.select("match").distinct().select("match", F.explode(text.name_forms(F.col("match"))).alias("form"))
    forms = kept(forms.select("match", text.fold(F.col("form")).alias("b")).where(F.size(words("b")) > 0).distinct(), "forms")
    pairs = kept(alike(names.select("a").distinct(), forms.select("b").distinct(), least).where(F.arrays_overlap(words("a"), words("b"))), "alike")
    scored = pairs.withColumn("ratio", ratio("a", "b")).where(F.col("ratio") >= least)
    found = scored.join(names, "a").join(forms, "b")
    return found.groupBy("name").agg(F.min(F.struct((-F.col("ratio")).alias("r"), "match")).alias("m")).select("name", "m.match", (-F.col("m.r")).alias("ratio"))
