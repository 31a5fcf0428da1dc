"""Subword lattice likelihood of texts under an existing vocabulary.

The pieces of a public vocabulary, and an end of text, are drawn one after another; a text's
probability sums over all ways to segment it. No piece goes over the begin of a word, so the sum is a
product over words, and each distinct word is summed once: a forward recursion in log space over its
bytes, for many words at a time. The pieces' weights start from the vocabulary's own scores, by rank,
and are re-estimated on the training words of the corpus by expectation maximization: the forward and
backward sums give the expected number of times that each piece is used. The vocabulary's weights keep
a fixed share of the probability whatever the corpus' size; the corpus has the rest.

What is gathered from the corpus is a table of its words with their training counts, built and kept
distributed. Words above a count that bounds their number go to the executors as arrays; the rest of
each text's words meet the table in a shuffle, so every word of every text is scored.

Defined results: null text is empty and scores as its end alone; every byte has a piece, so every
text has a probability. Words are told apart by 64-bit hashes. Rows that share a doc_id are scored
each. Without training texts N and V are 0 and the vocabulary's weights stand. An empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .common import arrow_map, staged

#: Most words that are sent to every executor (24 bytes each).
FREQUENT = 300_000
#: The share of the probability that the vocabulary's own scores keep in the re-estimate.
OWN_SHARE = 0.1
MARK = "▁".encode()
LOG10 = np.log(10.0)
U = np.uint64


@dataclass
class Pieces:
    """The vocabulary's pieces by the number of their bytes: sorted hashes, and each one's index."""

    by_size: dict[int, tuple[np.ndarray, np.ndarray]]
    start: np.ndarray  # log probabilities from the vocabulary's scores; the last is the end of text
    most: int


_vocabularies: dict[str, Pieces] = {}


def piece_hash(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = np.full(len(at), size, U)
        for j in range(size):
            h = h * U(0x100000001B3) + data[at + j] + U(1)
        return tn.mix(h)


def vocabulary(name: str) -> Pieces:
    """The pieces of a public vocabulary file, as bytes, without control pieces."""
    if name not in _vocabularies:
        import public_tokenizers
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        found: dict[bytes, float] = {}
        for i in range(model.get_piece_size()):
            if model.is_control(i) or model.is_unknown(i):
                continue
            piece = model.id_to_piece(i)
            raw = bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.encode()
            found[raw] = max(found.get(raw, -np.inf), np.nan if model.is_byte(i) else model.get_score(i))
        pieces = list(found)
        # a merge's score is its rank negated; by Zipf's law a piece's weight falls with its rank
        ranks = np.array([found[p] for p in pieces])
        ranks = np.where(np.isnan(ranks), np.nanmin(ranks) - 1, ranks)
        place = np.empty(len(pieces))
        place[np.argsort(-ranks, kind="stable")] = np.arange(len(pieces))
        weight = np.append(1 / (place + 10), 1 / 200)
        by_size = {}
        for size in sorted({len(p) for p in pieces}):
            own = np.array([i for i, p in enumerate(pieces) if len(p) == size])
            data = np.frombuffer(b"".join(pieces[i] for i in own), np.uint8).astype(U)
            h = piece_hash(data, np.arange(len(own)) * size, size)
            order = np.argsort(h)
            by_size[size] = (h[order], own[order])
        _vocabularies[name] = Pieces(by_size, np.log(weight / weight.sum()), max(by_size))
    return _vocabularies[name]


def arcs(words: list[bytes], pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, piece) of every piece in the marked words' bytes, and each word's begin and end.

    Positions count over all words, one after another with a gap of one.
    """
    sizes = np.array([len(w) + len(MARK) for w in words])
    begins = np.cumsum(sizes + 1) - sizes - 1
    data = np.frombuffer(b"\0".join(MARK + w for w in words) + b"\0", np.uint8).astype(U)
    stop = np.repeat(begins + sizes, sizes + 1)  # each position's word end
    place = np.arange(len(data))
    out = []
    for size, (hashes, own) in pieces.by_size.items():
        at = np.flatnonzero(place + size <= stop)
        if not len(at):
            continue
        h = piece_hash(data, at, size)
        i = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        hit = hashes[i] == h
        out.append((at[hit], at[hit] + size, own[i[hit]]))
    b, e, p = (np.concatenate(x) for x in zip(*out, strict=True))
    return b, e, p, begins, begins + sizes


def _recursion(source: np.ndarray, target: np.ndarray, weight: np.ndarray, depth: np.ndarray, total: np.ndarray) -> None:
    """total[t] = log sum exp over arcs (s, t) of total[s] + weight, in the order of depth."""
    order = np.lexsort((target, depth))
    source, target, weight, depth = source[order], target[order], weight[order], depth[order]
    edges = np.flatnonzero(np.diff(depth)) + 1
    for a, z in zip(np.append(0, edges), np.append(edges, len(depth)), strict=True):
        v = total[source[a:z]] + weight[a:z]
        first = np.flatnonzero(np.append(True, target[a + 1 : z] != target[a : z - 1]))
        top = np.maximum.reduceat(v, first)
        top = np.where(np.isfinite(top), top, 0)
        runs = np.diff(np.append(first, z - a))
        with np.errstate(divide="ignore"):
            total[target[a:z][first]] = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, runs)), first))


def marginals(words: list[bytes], pieces: Pieces, logp: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Each word's log probability over all segmentations, and with counts the expected uses of pieces."""
    if not words:
        return np.zeros(0), counts if counts is None else np.zeros(len(logp))
    b, e, p, begins, ends = arcs(words, pieces)
    n = int(ends[-1]) + 1
    origin = np.repeat(begins, np.diff(np.append(begins, n)))
    forward = np.full(n, -np.inf)
    forward[begins] = 0
    w = logp[p]
    _recursion(b, e, w, e - origin[e], forward)
    found = forward[ends]
    if counts is None:
        return found, None
    final = np.repeat(ends, np.diff(np.append(begins, n)))
    backward = np.full(n, -np.inf)
    backward[ends] = 0
    _recursion(e, b, w, final[b] - b, backward)
    owner = np.searchsorted(begins, b, "right") - 1
    with np.errstate(invalid="ignore"):
        use = np.exp(forward[b] + w + backward[e] - found[owner]) * counts[owner]
    return found, np.bincount(p, np.nan_to_num(use), minlength=len(logp))


def groups(words: list[bytes], most: int = 200_000):
    """Runs of words with about ``most`` bytes."""
    first, size = 0, 0
    for i, w in enumerate(words):
        if size and size + len(w) > most:
            yield slice(first, i)
            first, size = i, 0
        size += len(w) + 4
    if size:
        yield slice(first, len(words))


def distinct_words(texts: list) -> tuple[np.ndarray, ...]:
    """(hash, text, times, begin, end) of each text's distinct words, with A-Z lower-cased, and the bytes."""
    data, at = tn.padded(texts, lower=True)
    starts, ends = tn.word_bounds(data)
    if not len(starts):
        z = np.zeros(0, np.int64)
        return z.astype(U), z, z, z, z, data
    h, of = tn.word_hashes(data, starts, ends), tn.text_of_word(starts, at)
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (of[1:] != of[:-1])))
    return h[first], of[first], np.diff(np.append(first, len(h))), starts[order][first], ends[order][first], data


def word_table(docs: DataFrame, learn: Column) -> DataFrame:
    """(hash, word, c, seen): every distinct word, how often training texts and all texts hold it.

    A last row without a word counts the training texts, which have one end each.
    """

    def counted(batches):
        for b in batches:
            for first, run in tn.pieces(b["text"], 4 << 20):
                h, of, times, s, e, data = distinct_words(run)
                train = b["learn"].to_numpy(zero_copy_only=False)[first : first + len(run)].astype(np.int64)
                u, at, inv = np.unique(h, return_index=True, return_inverse=True)
                seen = np.bincount(inv, times, minlength=len(u)).astype(np.int64)
                c = np.bincount(inv, times * train[of], minlength=len(u)).astype(np.int64)
                raw = data.tobytes()
                words = [raw[i:j] for i, j in zip(s[at].tolist(), e[at].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(words, pa.binary()), pa.array(c), pa.array(seen)], ["hash", "word", "c", "seen"])

    parts = arrow_map(docs.select("text", F.coalesce(learn, F.lit(False)).alias("learn")), counted, "hash long, word binary, c long, seen long")
    return staged(parts.groupBy("hash").agg(F.min("word").alias("word"), F.sum("c").alias("c"), F.sum("seen").alias("seen")), "words")


def estimate(words: DataFrame, texts: int, name: str, rounds: int = 2) -> np.ndarray:
    """The pieces' log probabilities after EM on the training words; the last is the end's."""
    logp = vocabulary(name).start
    own = np.exp(logp)
    spark = words.sparkSession
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(logp)

        def expected(batches, sent=sent):
            pieces, total = vocabulary(name), np.zeros(len(sent.value))
            for b in batches:
                words_, counts = b["word"].to_pylist(), b["c"].to_numpy().astype(float)
                for g in groups(words_):
                    total += marginals(words_[g], pieces, sent.value, counts[g])[1]
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], ["piece", "uses"])

        # at most one number per piece of the vocabulary comes back
        got = arrow_map(words.where("c > 0").select("word", "c"), expected, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).toPandas()
        used = np.zeros(len(own))
        used[got["piece"].to_numpy(dtype=np.int64)] = got["uses"].to_numpy(dtype=float)
        used[-1] = texts
        if used.sum() > 0:
            logp = np.log(OWN_SHARE * own + (1 - OWN_SHARE) * used / used.sum())
    return logp


def score(docs: DataFrame, learn: Column, name: str = "piece_bpe_32k.model", frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, learnt, n_tokens, n_known, train_tokens, base_score, score) of every whole text.

    ``learn`` tells the training texts. base_score is the add-one unigram score over words.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.coalesce(learn, F.lit(False)).alias("learn"))
    words = word_table(docs, F.col("learn"))
    texts = docs.where("learn").count()
    sums = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    n, v = sums["n"] + texts, sums["v"] + (texts > 0)
    logp = estimate(words, texts, name)
    sent = spark.sparkContext.broadcast(logp)

    def weighed(batches):
        pieces = vocabulary(name)
        for b in batches:
            own, out = b["word"].to_pylist(), np.zeros(b.num_rows)
            for g in groups(own):
                out[g] = marginals(own[g], pieces, sent.value)[0]
            yield pa.RecordBatch.from_arrays([b["hash"], b["c"], b["seen"], pa.array(out / LOG10)], ["hash", "c", "seen", "lat"])

    weights = staged(arrow_map(words.select("hash", "word", "c", "seen"), weighed, "hash long, c long, seen long, lat double"), "weights")

    # the least count that leaves at most ``frequent`` words: counts beyond the last step fall together
    steps = weights.groupBy(F.least(F.col("seen"), F.lit(100_000)).alias("s")).count().orderBy(F.desc("s")).collect()
    least, room = 100_001, frequent
    for r in steps:
        room -= r["count"]
        if room < 0:
            break
        least = r["s"]
    top = weights.where(F.col("seen") >= least).select("hash", "c", "lat").orderBy("hash").toPandas()
    common = spark.sparkContext.broadcast((top["hash"].to_numpy(np.int64), top["c"].to_numpy(np.int64), top["lat"].to_numpy(float)))
    base_of = np.log10(n + v + 1)

    def summed(batches):
        task, at = TaskContext.get().partitionId() << 36, 0
        hashes, cs, lats = common.value
        names = ["row", "doc_id", "learn", "hash", "times", "n_tokens", "n_known", "base", "lat"]
        for b in batches:
            docs_, learns = b["doc_id"].to_numpy(zero_copy_only=False), b["learn"].to_numpy(zero_copy_only=False)
            for first, run in tn.pieces(b["text"], 4 << 20):
                h, of, times, *_ = distinct_words(run)
                h, m = h.view(np.int64), len(run)
                i = np.minimum(np.searchsorted(hashes, h), max(0, len(hashes) - 1))
                hit = hashes[i] == h if len(hashes) else np.zeros(len(h), bool)
                i, o, t = i[hit], of[hit], times[hit]
                add = lambda x, o=o, m=m: np.bincount(o, x, minlength=m)
                rows = task + at + np.arange(m)
                ends = [rows, docs_[first : first + m], learns[first : first + m], None, None, np.bincount(of, times, minlength=m).astype(np.int64) + 1, add(t * (cs[i] > 0)).astype(np.int64), add(t * np.log10(cs[i] + 1)) if len(i) else np.zeros(m), add(t * lats[i]) if len(i) else np.zeros(m)]
                kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.nulls(m, k) if x is None else pa.array(x, k, from_pandas=True) for x, k in zip(ends, kinds, strict=True)], names)
                rest = [rows[of[~hit]], None, None, h[~hit], times[~hit], None, None, None, None]
                k = int((~hit).sum())
                if k:
                    yield pa.RecordBatch.from_arrays([pa.nulls(k, t) if x is None else pa.array(x, t) for x, t in zip(rest, kinds, strict=True)], names)
                at += m

    schema = "row long, doc_id long, learn boolean, hash long, times long, n_tokens long, n_known long, base double, lat double"
    parts = staged(arrow_map(docs.withColumn("doc_id", F.col("doc_id").cast("long")), summed, schema), "scored")
    rare = weights.where(F.col("seen") < least).select("hash", "c", F.col("lat").alias("w"))
    rest = parts.where("hash is not null").select("row", "hash", "times").join(rare, "hash")
    rest = rest.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("k"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("b"), F.sum(F.col("times") * F.col("w")).alias("l"))
    whole = parts.where("hash is null").select("row", "doc_id", "learn", "n_tokens", "n_known", "base", "lat").join(rest, "row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return whole.select(
        "doc_id", F.col("learn").alias("learnt"), "n_tokens",
        (F.col("n_known") + zero("k") + F.lit(int(texts > 0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + zero("b") + F.lit(float(np.log10(texts + 1))) - F.col("n_tokens") * F.lit(float(base_of))).alias("base_score"),
        (F.col("lat") + zero("l") + F.lit(float(logp[-1] / LOG10))).alias("score"),
    )
