"""From names as people write them to the values that a catalogue holds, with recorded ladders."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.filters import Filter
from ..sources.catalog import Catalog

#: Confidence by how a name was found.
ALIAS, CANONICAL, PARTS = 0.95, 0.90, 0.70
STOPWORDS = frozenset({"the", "and", "for", "with", "from", "by", "von", "van", "der", "den", "des", "les", "del", "della", "press", "printing", "house"})


def agent(cat: Catalog, name: str) -> DataFrame:
    """(agent_norm, method, confidence) of a name by the first way that finds one: an alias, an
    authority's name, or aliases that hold all of its words."""
    key = " ".join(name.strip().lower().split())
    words = [w for w in re.split(r"[\s,]+", key) if w]
    norms = cat.agents.where("agent_norm is not null").select("agent_norm", "authority_uri").distinct()
    if not cat.has_aliases:
        return norms.where(F.col("agent_norm") == key).select("agent_norm", F.lit("norm").alias("method"), F.lit(CANONICAL).alias("confidence"))
    alias = cat.agent_aliases.select("authority_id", "alias_form_lower")
    holds = reduce(lambda a, b: a & b, [F.col("alias_form_lower").contains(w) for w in words]) if words else F.lit(False)
    ways = [
        alias.where(F.col("alias_form_lower") == key).select("authority_id", F.lit(1).alias("rank"), F.lit("alias_exact").alias("method"), F.lit(ALIAS).alias("confidence")),
        cat.agent_authorities.where(F.col("canonical_name_lower") == key).select(F.col("id").alias("authority_id"), F.lit(2).alias("rank"), F.lit("canonical_exact").alias("method"), F.lit(CANONICAL).alias("confidence")),
        alias.where(holds).select("authority_id", F.lit(3).alias("rank"), F.lit("alias_parts").alias("method"), F.lit(PARTS).alias("confidence")),
    ]
    found = reduce(DataFrame.unionByName, ways).distinct()
    found = found.join(F.broadcast(found.agg(F.min("rank").alias("best"))), F.col("rank") == F.col("best"))  # one row
    uris = cat.agent_authorities.where("authority_uri is not null").select(F.col("id").alias("authority_id"), "authority_uri")
    return found.join(uris, "authority_id").join(norms, "authority_uri").select("agent_norm", "method", "confidence").distinct()


def publisher(cat: Catalog, name: str, most: int = 12) -> DataFrame:
    """(publisher_norm, method, confidence) of a publisher's name: by a variant, an authority's name, a
    variant that holds its words, or else imprints that hold it; expanded to what imprints hold."""
    key = " ".join(name.strip().lower().split())
    words = [w for w in re.split(r"\W+", key) if len(w) > 2 and w not in STOPWORDS] or [key]
    norms = cat.imprints.where("publisher_norm is not null").select(F.lower("publisher_norm").alias("publisher_norm")).distinct()
    by_text = norms.where(F.col("publisher_norm").contains(key)).orderBy("publisher_norm").limit(most).select("publisher_norm", F.lit("imprint_substring").alias("method"), F.lit(0.6).alias("confidence"), F.lit(4).alias("rank"))
    longest = max(words, key=len)
    by_word = norms.where(F.col("publisher_norm").contains(longest)).orderBy("publisher_norm").limit(most).select("publisher_norm", F.lit("imprint_token").alias("method"), F.lit(0.5).alias("confidence"), F.lit(5).alias("rank"))
    ways = [by_text, by_word] if len(key) >= 3 else []
    if cat.publisher_authorities is not None and cat.publisher_variants is not None:
        pv = cat.publisher_variants
        holds = reduce(lambda a, b: a & b, [F.col("variant_form_lower").contains(w) for w in words])
        hits = [
            pv.where(F.col("variant_form_lower") == key).select("authority_id", F.lit(1).alias("rank"), F.lit("variant_exact").alias("method"), F.lit(ALIAS).alias("confidence")),
            cat.publisher_authorities.where(F.col("canonical_name_lower") == key).select(F.col("id").alias("authority_id"), F.lit(2).alias("rank"), F.lit("canonical_exact").alias("method"), F.lit(CANONICAL).alias("confidence")),
            pv.where(holds).select("authority_id", F.lit(3).alias("rank"), F.lit("variant_token").alias("method"), F.lit(PARTS).alias("confidence")),
        ]
        forms = pv.select("authority_id", F.col("variant_form_lower").alias("form")).unionByName(cat.publisher_authorities.select(F.col("id").alias("authority_id"), F.col("canonical_name_lower").alias("form"))).distinct()
        known = reduce(DataFrame.unionByName, hits).join(forms, "authority_id").join(norms, F.col("form") == F.col("publisher_norm"))
        ways.insert(0, known.select("publisher_norm", "method", "confidence", "rank"))
    if not ways:
        return norms.where("false").select("publisher_norm", F.lit("none").alias("method"), F.lit(0.0).alias("confidence"))
    found = reduce(DataFrame.unionByName, ways).distinct()
    best = F.broadcast(found.agg(F.min("rank").alias("best")))  # one row
    return found.join(best, F.col("rank") == F.col("best")).select("publisher_norm", "method", "confidence").distinct()


def stem_variants(term: str) -> list[str]:
    """The term with its last word in the other number: ``maps`` for ``map`` and the other way about."""
    if not term.isascii() or not term.strip():
        return []
    head, _, last = term.strip().rpartition(" ")
    if last.endswith("es") and len(last) > 4:
        forms = [last[:-2], last[:-1]]
    elif last.endswith("s") and not last.endswith("ss") and len(last) > 3:
        forms = [last[:-1]]
    else:
        forms = [last + "s", last + "es"]
    return [f"{head} {x}".strip() for x in forms]


def fallback_words(text: str, most: int = 5) -> list[str]:
    """The words of a name worth a search of their own, longest first."""
    words = dict.fromkeys(w for w in re.split(r"\W+", text.lower()) if len(w) > 2 and w not in STOPWORDS)
    return sorted(words, key=lambda w: (-len(w), w))[:most]


def ceiling(n_records: int) -> int:
    """Most records that a guessed search may find before it is dropped as saying nothing."""
    return max(20, round(n_records / 100))


#: The fields of which one value can tell several names.
SEVERAL = ("imprint_place", "country", "publisher")


def split_values(f: Filter) -> Filter:
    """A filter on several names at once as one IN, each name whole and in its parts."""
    if f.field not in SEVERAL or f.op not in ("IN", "EQUALS"):
        return f
    if f.op == "EQUALS" and "," not in f.value:
        return f
    values = dict.fromkeys(x.strip() for v in f.values for x in (v, *v.split(",")) if x.strip())
    return Filter(f.field, "IN", list(values), negate=f.negate, confidence=f.confidence)
