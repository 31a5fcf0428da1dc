"""Quality rules with adaptive thresholds.

Each document's measures are gathered into mergeable quantile sketches per language and source. The
sketch is a log-linear histogram: a value in ten-thousandths is cut to its seven leading bits, so
that quantiles have a relative error below 1/64 whatever their size, sketches merge by adding counts,
and the same rows give the same sketch in any order. Where a measure's median tells its scale, the
upper fence is the ninth decile and twice its distance from the median (in a normal distribution 3.8
deviations), and the mean length of words has a lower fence likewise. Where the median is zero there is
no scale, and the fence is the quantile below which all but a hundredth of the group lie, zeros and
others together; so such a measure rejects the group's most extreme hundredth, and no fixed rate or
count decides. A group's fences are shrunk towards its language's, and a language's towards the
whole table's, as if PRIOR documents of the parent were among its own; so small groups lean on larger
ones without a switch. The fences are joined to the documents. Everything is DataFrame expressions:
no Python runs on the executors.

Defined results: null text has no words and fails the base rule; null languages and sources are
groups of their own; repeated rows count and are judged each; values at a fence are within it; a text
of any length is measured whole, in arrays of its own words; an empty table gives an empty result.
Only ``doc_id``, ``text``, ``lang`` and ``source`` are read for the verdict; other columns can have
any name, and ``filter_documents`` keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, bind, fold, sized, staged, words

WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Sketched values are in so many parts of one, and keep so many leading bits.
PARTS, BITS = 10_000, 7
#: The fence lies beyond the decile by so many times its distance from the median.
WIDTH = 2
#: A parent's fence counts as much as so many of the group's own documents.
PRIOR = 20
MEASURES = ("mean_word", "symbol_rate", "dup_line_rate", "repeat_rate")
#: Measures whose low side is judged too.
BOTH_SIDES = ("mean_word",)


def repeated_words(w: Column, window: int = WINDOW) -> Column:
    """How many of the words in the array ``w`` lie in a window of words that occurs twice or more.

    Windows are compared by 64-bit hashes of their words' hashes.
    """

    def covered(wins: Column) -> Column:
        ordered = F.array_sort(F.transform(wins, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = bind(ordered, lambda o: F.filter(o, lambda x, i: ((i > 0) & (F.get(o, i - 1)["h"] == x["h"])) | (F.get(o, i + 1)["h"] == x["h"])))
        at = F.array_sort(F.transform(again, lambda x: x["i"]))
        return bind(at, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - x, F.lit(window)))), F.lit(0).cast("long"), lambda a, x: a + x))

    def of_windows(wins: Column) -> Column:
        return F.when(F.size(F.array_distinct(wins)) < F.size(wins), covered(wins)).otherwise(F.lit(0).cast("long"))

    hashes = F.transform(w, lambda x: F.xxhash64(x))
    wins = bind(hashes, lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)])))
    return F.when(F.size(w) > window, bind(wins, of_windows)).otherwise(F.lit(0).cast("long"))


def measures(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = lambda t: F.length(F.translate(t, BLANKS, ""))
    lines = F.filter(F.split(text, "\n"), lambda x: bare(x) > 0)
    w = words(text)
    counted = docs.select(
        *keep,
        bind(w, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"))).alias("_w"),
        bare(text).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        bind(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        F.regexp_count(text, F.lit("\n")).alias("_breaks"),
    )
    n, r = F.col("_w.n_words"), F.col("_w.n_repeat_words")
    return counted.select(*keep, n.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", r.alias("n_repeat_words"), ((n < 20) | (100 * r > 30 * n)).alias("base_failed"), (F.col("_breaks") + 1).alias("n_lines"))


def ratios() -> dict[str, Column]:
    """Each measure in sketch units."""
    n, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    told = {"mean_word": ("word_chars", n), "symbol_rate": ("n_symbols", n), "dup_line_rate": ("n_dup_lines", lines), "repeat_rate": ("n_repeat_words", n)}
    return {m: cut(F.call_function("div", PARTS * F.col(a), of)) for m, (a, of) in told.items()}


def cut(value: Column) -> Column:
    """A whole number with all but its leading bits at zero."""
    low = F.greatest(F.length(F.bin(value)) - BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, low), low)


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, m, value, c): how many documents that pass the base rule have each cut value."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), x.alias("value")) for m, x in ratios().items()]))
    return measured.where(~F.col("base_failed")).select("lang", "source", each.alias("_x")).groupBy("lang", "source", "_x.m", "_x.value").agg(F.count("*").alias("c"))


def merge(sketched: DataFrame, by: list[str]) -> DataFrame:
    """The sketches merged over all groups that are alike in ``by``."""
    return sketched.groupBy(*by, "m", "value").agg(F.sum("c").alias("c"))


def bounds(sketched: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, lo_m, hi_m for each measure m) from sketches, a row per group."""
    group = Window.partitionBy(*by, "m")
    up_to = F.sum("c").over(group.orderBy("value"))
    ranked = sketched.select(*by, "m", "value", up_to.alias("_at"), F.sum("c").over(group).alias("n"))
    quantile = lambda m, cents: F.min(F.when((F.col("m") == m) & (100 * F.col("_at") >= cents * F.col("n")), F.col("value"))).alias(f"q{cents}_{m}")
    found = ranked.groupBy(*by).agg(F.max("n").alias("n"), *[quantile(m, c) for m in MEASURES for c in (10, 50, 90, 99)])
    q = lambda m, cents: F.col(f"q{cents}_{m}")
    hi = lambda m: F.when(q(m, 50) == 0, q(m, 99)).otherwise(q(m, 90) + WIDTH * (q(m, 90) - q(m, 50)))
    lo = lambda m: F.greatest(q(m, 10) - WIDTH * (q(m, 50) - q(m, 10)), F.lit(0)) if m in BOTH_SIDES else F.lit(0).cast("long")
    return found.select(*by, "n", *[x for m in MEASURES for x in (lo(m).alias(f"lo_{m}"), hi(m).alias(f"hi_{m}"))])


def shrunk(own: Column, n: Column, parent: Column, prior: int = PRIOR) -> Column:
    """A fence drawn towards its parent's; the parent's where the group has none. Whole numbers, so exact."""
    return F.coalesce(F.call_function("div", n * own + prior * parent, n + prior), parent)


def fences(measured: DataFrame, prior: int = PRIOR) -> DataFrame:
    """(lang, source, lo_m, hi_m for each measure m), a row per group; nulls where nothing is sketched.

    Documents that fail the base rule are left out of the sketches.
    """
    own = staged(sketches(measured), "sketches")
    ends = [f"{side}_{m}" for m in MEASURES for side in ("lo", "hi")]
    level = lambda by, tag: bounds(merge(own, by), by).select(*[F.col(c).alias(f"_{c}") for c in by], F.struct("n", *ends).alias(tag))
    found = measured.select("lang", "source").distinct()
    found = found.join(level(["lang", "source"], "own"), F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left").drop("_lang", "_source")
    found = found.join(level(["lang"], "of_lang"), F.col("lang").eqNullSafe(F.col("_lang")), "left")
    found = found.join(F.broadcast(level([], "whole")))  # one row
    of_lang = lambda e: shrunk(F.col(f"of_lang.{e}"), F.col("of_lang.n"), F.col(f"whole.{e}"), prior)
    return found.select("lang", "source", *[shrunk(F.col(f"own.{e}"), F.col("own.n"), of_lang(e), prior).alias(e) for e in ends])


def judge(measured: DataFrame, prior: int = PRIOR) -> DataFrame:
    """``measured`` (with lang, source and the measures) with ``kept``, joined to its group's fences."""
    told = staged(fences(measured, prior), "fences")
    within = fold([x.between(F.col(f"lo_{m}"), F.col(f"hi_{m}")) for m, x in ratios().items()], lambda a, b: a & b)
    joined = measured.alias("d").join(told.alias("f"), F.col("d.lang").eqNullSafe(F.col("f.lang")) & F.col("d.source").eqNullSafe(F.col("f.source")), "left")
    return joined.select("d.*", (~F.col("base_failed") & F.coalesce(within, F.lit(True))).alias("kept"))


def filter_documents(docs: DataFrame, **settings) -> DataFrame:
    """The documents that the rules keep, with the columns they came with.

    The verdicts meet the documents again by ``doc_id`` and a hash of what they rest on, so that rows that
    share an id, or have none, are judged each.
    """
    row = F.xxhash64("doc_id", "lang", "source", "text")
    told = docs.select("doc_id", "lang", "source", "text", row.alias("_ql_row"))
    measured = staged(measures(told, ["doc_id", "lang", "source", "_ql_row"]), "measures")
    gone = judge(measured, **settings).where(~F.col("kept")).select(F.col("doc_id").alias("_ql_id"), "_ql_row").distinct()
    gone = sized(staged(gone, "gone"))
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_ql_id")) & (row == F.col("_ql_row")), "left_anti")
