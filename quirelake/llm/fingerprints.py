"""Threshold-scaled document fingerprints.

A fingerprint keeps every hash of a word shingle that falls below a fixed fraction of the hash
space, at every size, so that it grows with its document, and the containment of a short text in a very
long one can be told from both. Hashes have 40 bits: two texts of 5,000 shingles share one by chance
once in 45,000 times. A string of them is the base64 of five bytes each, ascending. Of a set of few
shingles the fraction leaves next to nothing, so what it left out is kept beside the fingerprint (the
columns ``short_rest``): two such sets are then compared exactly; against a larger set only hashes
below the fraction count. The fingerprint of a union of sets follows from theirs, whatever their sizes
(``merge``). Everything is DataFrame expressions.

Defined results: shingles are of five words, lower-cased in A-Z; a text of fewer words is one shingle
and a text without words has an empty fingerprint. The likeness of two fingerprints is the share of
the smaller that the other holds, and null where the smaller is so small that none of its hashes
falls below the fraction; of two empty ones it is 1, of an empty and another 0. Null text is empty.
Rows that share a ``doc_id`` follow one another in the order of their texts' hashes, and those without
one come last. A single document is its own next. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, bind, words

SHINGLE = 5
#: Bits of a shingle's hash.
BITS = 40
#: One shingle hash in so many is kept.
SCALE = 4
#: Sets of at most so many shingles keep the rest of theirs beside the fingerprint.
WHOLE = 64


def shingle_hashes(text: Column, k: int = SHINGLE) -> Column:
    hashes = F.transform(words(ascii_lower(text)), lambda x: F.xxhash64(x))

    def windows(h: Column) -> Column:
        wins = F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))
        short = F.transform(F.filter(F.array(h), lambda x: F.size(x) > 0), lambda x: F.xxhash64(F.size(x), *[F.get(x, F.lit(j)) for j in range(k - 1)]))
        return F.when(F.size(h) >= k, wins).otherwise(short)

    return F.transform(bind(hashes, windows), lambda x: F.shiftrightunsigned(x, 64 - BITS))


def sketch(text: Column, k: int = SHINGLE, scale: int = SCALE) -> Column:
    """whole: whether all hashes are at hand; hashes: the sorted distinct ones that are.

    The fingerprint is those below the fraction, in both cases.
    """
    return bind(F.array_distinct(shingle_hashes(text, k)), lambda s: _sketch(s, F.size(s) <= WHOLE, scale))


def _below(hashes: Column, scale: int) -> Column:
    """The hashes in the lowest ``1/scale`` of their range."""
    return F.filter(hashes, lambda x: x < 2**BITS // scale)


def _sketch(distinct: Column, whole: Column, scale: int) -> Column:
    return F.struct(whole.alias("whole"), F.array_sort(F.when(whole, distinct).otherwise(_below(distinct, scale))).alias("hashes"))


def compared(a: Column, b: Column, scale: int = SCALE) -> tuple[Column, Column]:
    """The hashes of two fingerprints that can be held against one another."""
    both = a["whole"] & b["whole"]
    return tuple(F.when(both | ~x["whole"], x["hashes"]).otherwise(_below(x["hashes"], scale)) for x in (a, b))


def support(a: Column, b: Column, scale: int = SCALE) -> Column:
    """How many hashes of the smaller set the likeness rests on."""
    x, y = compared(a, b, scale)
    return F.least(F.size(x), F.size(y))


def likeness(a: Column, b: Column, scale: int = SCALE) -> Column:
    def of(x: Column, y: Column) -> Column:
        least = F.least(F.size(x), F.size(y))
        return F.when(least > 0, F.size(F.array_intersect(x, y)) / least)

    x, y = compared(a, b, scale)
    empty = lambda c: c["whole"] & (F.size(c["hashes"]) == 0)
    return F.when(empty(a) & empty(b), 1.0).when(empty(a) | empty(b), 0.0).otherwise(bind(F.struct(x.alias("x"), y.alias("y")), lambda s: of(s["x"], s["y"])))


def merge(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The fingerprint of two sets' union, from theirs."""
    return bind(F.array_union(a["hashes"], b["hashes"]), lambda u: _sketch(u, a["whole"] & b["whole"] & (F.size(u) <= WHOLE), scale))


def as_string(hashes: Column) -> Column:
    """Sorted hashes as base64 of their bytes."""
    return F.base64(F.unhex(F.array_join(F.transform(hashes, lambda x: F.lpad(F.hex(x), BITS // 4, "0")), "")))


def fingerprint(sk: Column, scale: int = SCALE) -> Column:
    """What lies below the fraction."""
    return as_string(_below(sk["hashes"], scale))


def short_rest(sk: Column, scale: int = SCALE) -> Column:
    """What lies above it of a set of few shingles; null for others."""
    return F.when(sk["whole"], as_string(F.filter(sk["hashes"], lambda x: x >= 2**BITS // scale)))


def literal(values: list[int]) -> Column:
    """An array of numbers as one constant of the plan, whatever its length."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")


def with_next(docs: DataFrame, columns: list[str], tie: Column, buckets: int) -> DataFrame:
    """``docs`` with next_c for each c in columns: its value in the next row by descending doc_id.

    After the last comes the first. Rows are dealt out by ranges of doc_id, whose edges come from
    the ids' quantiles; an id that fills several ranges by itself is dealt out by ranges of ``tie`` too.
    Each range also gets a guest copy of the row that follows its last, so that no partition holds more
    than its range and one row.
    """
    docs = docs.withColumns({"_key": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), "_tie": tie})
    edges: list[int] = []
    if buckets > 1:
        edges = docs.agg(F.percentile_approx("_key", [(i + 1) / buckets for i in range(buckets - 1)], 20 * buckets)).first()[0] or []
    times = Counter(edges)
    edges = sorted(times)
    start, subs = [], []  # of each range: its first bucket, and into how many its greatest id is dealt
    for e in edges:
        start.append(start[-1] + subs[-1] + 1 if start else 0)
        subs.append(times[e] if times[e] > 1 else 0)
    start.append(start[-1] + subs[-1] + 1 if start else 0)
    subs.append(0)
    at = F.lit(0)
    if edges:
        steps = [2**i for i in range(len(edges).bit_length() - 1, -1, -1)]
        at = F.aggregate(literal(steps), F.lit(0), lambda p, s: F.when((p + s <= len(edges)) & (F.get(literal(edges), (p + s - 1).cast("int")) < F.col("_key")), (p + s).cast("int")).otherwise(p))
    docs = docs.withColumn("_r", at)
    many = F.get(literal(subs), F.col("_r"))
    part = F.floor((F.col("_tie") / 2.0**64 + 0.5) * many).cast("long")
    own_range = (many > 0) & (F.get(literal(edges or [0]), F.col("_r")) == F.col("_key"))
    # a range is read from its greatest id on: that id's parts by tie, then all others
    docs = docs.withColumn("_b", (F.get(literal(start), F.col("_r")) + F.when(own_range, F.least(part, many - 1)).otherwise(many)).cast("int"))
    place = F.struct((-1 - F.col("_key")).alias("k"), F.col("_tie").alias("t"))
    heads = {r["b"]: r["m"] for r in docs.groupBy(F.col("_b").alias("b")).agg(F.min(place).alias("m")).collect()}
    if not heads:
        return docs.drop("_key", "_tie", "_r", "_b").select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    order = [b for i in reversed(range(len(start))) for b in range(start[i], start[i] + subs[i] + 1) if b in heads]
    before = {b: order[i - 1] for i, b in enumerate(order)}  # whose last row b's first follows
    n = start[-1] + 1
    of = lambda values: F.get(literal([values.get(b, 0) for b in range(n)]), F.col("_b"))
    is_head = (-1 - F.col("_key") == of({b: m["k"] for b, m in heads.items()})) & (F.col("_tie") == of({b: m["t"] for b, m in heads.items()}))
    own = F.struct(F.col("_b").cast("long").alias("b"), F.lit(0).alias("guest"))
    guest = F.struct(of(before).alias("b"), F.lit(1).alias("guest"))
    dealt = docs.select("*", F.explode(F.when(is_head, F.array(own, guest)).otherwise(F.array(own))).alias("_at"))
    window = Window.partitionBy("_at.b").orderBy("_at.guest", F.desc("_key"), "_tie")
    led = dealt.select("*", *[F.lead(c).over(window).alias(f"next_{c}") for c in columns])
    return led.where("_at.guest = 0").drop("_key", "_tie", "_r", "_b", "_at")


def fingerprints(docs: DataFrame, buckets: int = 64) -> DataFrame:
    """Every document's fingerprint, and those of its edited text, with their likeness.

    A likeness that is not known is 0 here; ``edited_support`` and ``next_support`` tell how many hashes
    each rests on.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = docs.select("doc_id", text.alias("text"))
    plain = plain.select("doc_id", "text", F.length("text").cast("long").alias("n_chars"), sketch(F.col("text")).alias("sk"))
    led = with_next(plain, ["text", "sk"], F.xxhash64("text"), buckets)
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    sk, sk_n, sk_e = F.col("sk"), F.col("next_sk"), F.col("sk_e")
    led = led.select("doc_id", "n_chars", "sk", edited.alias("edited"), F.coalesce(likeness(sk, sk_n), F.lit(0.0)).alias("near_next"), support(sk, sk_n).alias("next_support"))
    led = led.select("doc_id", "n_chars", "sk", "near_next", "next_support", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), sketch(F.col("edited")).alias("sk_e"))
    return led.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(sk).alias("fingerprint"), fingerprint(sk_e).alias("edited_fingerprint"), short_rest(sk).alias("short_rest"), short_rest(sk_e).alias("edited_short_rest"),
        F.coalesce(likeness(sk, sk_e), F.lit(0.0)).alias("near_edited"), "near_next", support(sk, sk_e).alias("edited_support"), "next_support",
    )
