"""A supervised subword classifier of document quality.

A document is the mean of learned vectors of its features: every word, every pair of neighbouring
words, and every n-gram of 3 to 5 characters inside a word with its boundaries, each hashed into a
table of vectors; a softmax over two classes follows. It is trained by stochastic gradient descent in
numpy on the driver, over a sample of labelled documents whose features the executors hash, bounded in
documents and in features.
As the softmax of two classes depends on one difference that is linear in the mean, scoring needs
one number per feature; texts are scored whole, a run of texts at a time.

Defined results: a null or empty text has no feature and scores by the bias alone; without any
labelled row, or with labels of one class only, every score is that class's share, or one half.
Repeated label rows of a document count once, by the highest label; of several texts with a labelled
id the one with the least hash is learned from. Labels without an id or a label are not. Repeated
documents get equal scores, since only the text is an input. Other columns are kept, and one that has
the score's name is replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from . import textnum as tn
from .common import arrow_map, give_back, staged

BITS, DIM = 18, 16
ORDERS = (3, 4, 5)
#: Most labelled documents that are learned from: those with the least hash of their id.
SAMPLE = 4000
#: Most distinct features of them all, a document's counted each: what is over it is not learned from.
SAMPLE_FEATURES = 20_000_000
#: Bytes of texts whose features are in memory at once, about 150 bytes for each.
RUN_BYTES = 256 << 10
U = np.uint64


@dataclass
class Model:
    weights: np.ndarray  # what each hashed feature adds to the log odds of class 1
    bias: float


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> U(64 - BITS)).astype(np.int64)


def features(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(slot, text) of every feature of the texts."""
    data, at = tn.padded(texts)
    starts, ends = tn.word_bounds(data)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, of = tn.word_hashes(data, starts, ends), tn.text_of_word(starts, at)
    slots, owners = [_slots(h)], [of]
    with np.errstate(over="ignore"):
        same_text = of[1:] == of[:-1]
        # a word that repeats the one before it is one feature, whatever the word
        pair = np.where(h[1:] == h[:-1], U(12345), tn.mix(h[:-1] * U(3) + h[1:]))
        slots.append(_slots(tn.mix(pair + U(7)))[same_text])
        owners.append(of[1:][same_text])
        first = np.flatnonzero((data & 0xC0) != 0x80)  # where characters begin
        size = np.diff(np.append(first, len(data)))
        codes = data[first].astype(U)
        for j in range(1, int(size.max())):
            longer = size > j
            codes[longer] = codes[longer] * U(64) + (data[first[longer] + j] & 0x3F)
        blank = (codes == 32) | ((codes >= 9) & (codes <= 13))
        gaps = np.concatenate([[0], np.cumsum(blank)])
        codes = np.where(blank, U(1), codes + U(2))
        owner = np.searchsorted(at - 1, first[:-1], "right") - 1  # the last character is the closing blank
        for n in ORDERS:
            m = len(codes) - n + 1
            if m <= 0:
                continue
            # no blank inside, at most at either end
            ok = np.flatnonzero(gaps[n - 1 : n - 1 + m] - gaps[1 : 1 + m] == 0)
            ok = ok[ok < len(owner)]
            g = np.full(len(ok), n, U)
            for j in range(n):
                g = g * U(0x100000001B3) + codes[ok + j]
            slots.append(_slots(tn.mix(g)))
            owners.append(owner[ok])
    return np.concatenate(slots), np.concatenate(owners)


def narrow(counts: np.ndarray) -> np.ndarray:
    """The counts in the smallest type that holds them, which for most texts is a byte each."""
    return counts.astype(np.min_scalar_type(int(counts.max()))) if len(counts) else counts


def fit(examples: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 12, rate: float = 8.0, seed: int = 11) -> Model:
    """SGD over (slots, counts, label)."""
    labels = np.array([y for *_, y in examples])
    if len(set(labels.tolist())) < 2:
        share = float(labels[0]) if len(labels) else 0.5
        return Model(np.zeros(1 << BITS, np.float32), float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    rng = np.random.default_rng(seed)
    vectors = rng.random((1 << BITS, DIM), np.float32)
    vectors -= 0.5  # in place, as each copy takes as much again of the driver's memory
    vectors /= DIM
    out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    steps, done = epochs * len(examples), 0
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            u, c, y = examples[i]
            c = c.astype(np.float32) / np.float32(max(1, c.sum()))
            lr = rate * (1 - done / steps)
            done += 1
            rows = vectors[u]
            x = c @ rows
            z = out @ x + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1  # the gradient of the loss by z
            back = p @ out
            out -= (lr * 0.1) * np.outer(p, x)
            bias -= (lr * 0.01) * p
            vectors[u] = rows - lr * np.outer(c, back)
    return Model((vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]))


def scores(texts: pa.Array, model: Model) -> np.ndarray:
    found = np.zeros(len(texts))
    for first, run in tn.pieces(texts, RUN_BYTES):
        slots, owners = features(run)
        n = np.bincount(owners, minlength=len(run))
        total = np.bincount(owners, model.weights[slots], minlength=len(run))
        z = model.bias + total / np.maximum(n, 1)
        found[first : first + len(run)] = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    return found


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", learn: Column | None = None, sample: int = SAMPLE, most_features: int = SAMPLE_FEATURES) -> Model:
    """Fit on at most ``sample`` labelled documents, with ``most_features``, among those where ``learn`` holds."""
    told = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label_col).cast("int").alias("_y"))
    if learn is not None:
        told = told.where(learn)
    told = told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def hashed(batches):
        for b in batches:
            ids, ys, us, cs = [], [], [], []
            for i, y, t in zip(b["doc_id"].to_pylist(), b["_y"].to_pylist(), b["text"], strict=True):
                u, c = np.unique(features([t.as_buffer() if t.is_valid else b""])[0], return_counts=True)
                ids.append(i)
                ys.append(y)
                us.append(u.astype("<u4").tobytes())
                cs.append(c.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ys, pa.int32()), b["mark"], pa.array(us, pa.binary()), pa.array(cs, pa.binary())], ["doc_id", "y", "mark", "u", "c"])

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(told), "doc_id").select("doc_id", "_y", F.xxhash64("text").alias("mark"), "text")
    rows = staged(arrow_map(texts, hashed, "doc_id long, y int, mark long, u binary, c binary"), "examples")
    # of at most ``sample`` documents one text each, as many as the features allow
    sizes = rows.groupBy("doc_id").agg(F.min(F.struct("mark", F.octet_length("u").alias("n"))).alias("m")).select("doc_id", "m.*")
    up_to = F.sum("n").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = sizes.withColumn("up_to", up_to).where(F.col("up_to") <= 4 * most_features).select("doc_id", "mark")
    examples: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}
    for r in rows.join(F.broadcast(chosen), ["doc_id", "mark"]).toLocalIterator():  # a partition at a time
        examples[r["doc_id"]] = (np.frombuffer(r["u"], "<u4").view(np.int32), narrow(np.frombuffer(r["c"], "<u4")), r["y"])
    model = fit([examples.pop(i) for i in sorted(examples)])
    give_back()  # what training took, before the driver plans what follows
    return model


def score(docs: DataFrame, model: Model, out_col: str = "score") -> DataFrame:
    """``docs`` with the score of their texts; a column that has the score's name is replaced."""
    docs = docs.drop(out_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def scored(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores(b.column("text"), sent.value), pa.float64())], [*names, out_col])

    return arrow_map(docs, scored, StructType([*docs.schema.fields]).add(out_col, DoubleType()))
