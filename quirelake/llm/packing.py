"""Best-fit packing of tokenized documents into sequences of a fixed capacity.

A document longer than the capacity is cut into full pieces, the first of which may be shorter. How
many pieces there are of each length is all the plan needs: at most ``capacity`` numbers, whatever
the corpus. On those counts, pieces over a third of the capacity, of which a sequence holds two at
most, are matched greedily, each longest with the longest that still fits beside it; then the smaller
ones go, longest first, to the tightest gap that takes them, and to new sequences where none does.
The plan is a list of runs: so many like sequences, with so many pieces of a length in each. As a
gap that takes pieces of length s is left below half of itself, a sequence run is used at most
log2(capacity) times, and each length splits at most one run, so the list has a fixed bound and can
go to every executor. Each piece finds its place from its rank among the pieces of its length.

Defined results: null text is empty, and an empty document is one piece that holds the end id alone.
Repeated rows, rows that share a doc_id, and rows without one are packed each; pieces that tie in
length are ranked by a hash of the piece, then by id. Texts of any length are tokenized whole. Extra
columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from .common import arrow_map, staged

CAPACITY = 2048
#: Pieces of a length that are ranked together; a length with more is dealt into parts of this size.
RANKED = 1_000_000


@dataclass
class Plan:
    """Runs of pieces: of ``length``, ranks from ``first``; ``each`` per sequence, from ``offset``."""

    length: np.ndarray
    first: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def places(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of the pieces with these lengths and ranks."""
        keys = np.array(list(zip(self.length, self.first, strict=True)), dtype=[("l", "i8"), ("f", "i8")])
        want = np.empty(len(length), keys.dtype)
        want["l"], want["f"] = length, rank
        run = np.searchsorted(keys, want, "right") - 1
        at = rank - self.first[run]
        return self.sequence[run] + at // self.each[run], self.offset[run] + at % self.each[run] * length


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    left = {n: c for n, c in counts.items() if c}
    used: dict[int, int] = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int]] = []  # length, first rank, each, first sequence, offset
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: runs of sequences (first, count) that have it
    order: list[int] = []  # the gaps, ascending
    total = 0

    def put(n: int, each: int, first: int, count: int, offset: int) -> None:
        runs.append((n, used[n], each, first, offset))
        used[n] += each * count
        left[n] -= each * count

    def leave(gap: int, first: int, count: int) -> None:
        if gap and count:
            if not gaps.get(gap):
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((first, count))

    large = sorted(n for n in left if 3 * n > capacity)
    for n in reversed(large):
        while left[n]:
            at = bisect_left(large, capacity - n + 1) - 1  # the longest that fits beside it
            while at >= 0 and (left[large[at]] == 0 or (large[at] == n and left[n] < 2)):
                at -= 1
            if at < 0:
                count = left[n]
                put(n, 1, total, count, 0)
                leave(capacity - n, total, count)
            elif large[at] == n:
                count = left[n] // 2
                put(n, 2, total, count, 0)
                leave(capacity - 2 * n, total, count)
            else:
                m = large[at]
                count = min(left[n], left[m])
                put(n, 1, total, count, 0)
                put(m, 1, total, count, n)
                leave(capacity - n - m, total, count)
            total += count
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            at = bisect_left(order, n)
            if at == len(order):
                each = min(capacity // n, left[n])
                count = left[n] // each
                put(n, each, total, count, 0)
                leave(capacity - each * n, total, count)
                total += count
                continue
            gap = order[at]
            first, count = gaps[gap].pop()
            if not gaps[gap]:
                order.pop(at)
            each = min(gap // n, left[n])
            take = min(count, left[n] // each)
            put(n, each, first, take, capacity - gap)
            leave(gap - each * n, first, take)
            leave(gap, first + take, count - take)
    runs.sort()
    cols = [np.array(c, np.int64) for c in zip(*runs, strict=True)] if runs else [np.zeros(0, np.int64)] * 5
    return Plan(*cols, total)


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, after a first that may be shorter."""
    head = n % capacity or capacity
    return [(0, head), *((s, capacity) for s in range(head, n, capacity))]


_encoders: dict[str, object] = {}


def encoder(name: str):
    """The tokenizer of the ranks in a public vocabulary file, special tokens' strings included.

    It gives the ids of the byte-level tokenizer file of the same vocabulary, several times faster.
    """
    if name not in _encoders:
        import base64

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[name] = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})
    return _encoders[name]


def pieces(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's pieces, tokenized whole."""

    def tokenized(batches):
        enc = encoder(vocabulary)
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.append(enc.encode_to_numpy(text.as_py() or "", allowed_special="all"), end_id).astype("<u4")
                for k, (s, n) in enumerate(cut(len(ids), capacity)):
                    rows.append((doc, k, s, n, zlib.crc32(ids[s : s + n].tobytes())))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), tokenized, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(cut_up: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut_up`` (materialized pieces) with sequence_id and offset.

    The pieces of a length are ranked by salt, then within the salt. A length has a salt for every
    RANKED of its pieces; the driver sees a count per length and per salt, so a number for every million
    pieces beside the capacity.
    """
    counts = {r["length"]: r["count"] for r in cut_up.groupBy("length").count().collect()}
    salts = [-(-counts.get(n, 0) // RANKED) or 1 for n in range(capacity + 1)]
    own = F.get(F.split(F.lit(",".join(map(str, salts))), ",").cast("array<long>"), F.col("length").cast("int"))
    dealt = cut_up.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), own).cast("int"))
    rows = dealt.groupBy("length", "salt").count().toPandas().sort_values(["length", "salt"])
    table = np.zeros((capacity + 1, max(salts)), np.int64)  # how many pieces of a length go before a salt's
    before: dict[int, int] = {}
    for n, s, c in rows.itertuples(index=False):
        table[n, s] = before.get(n, 0)
        before[n] = table[n, s] + c
    sent = cut_up.sparkSession.sparkContext.broadcast((plan(counts, capacity), table))
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")).cast("long") - 1)
    names = cut_up.columns

    def placed(batches):
        p, starts = sent.value
        for b in batches:
            n, s, r = (b.column(c).to_numpy() for c in ("length", "salt", "_rank"))
            seq, off = p.places(n, starts[n, s] + r) if len(n) else (n, n)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(seq, pa.int64()), pa.array(off, pa.int64())], [*names, "sequence_id", "offset"])

    return arrow_map(ranked, placed, StructType([*cut_up.schema.fields]).add("sequence_id", LongType()).add("offset", LongType()))


def pack_documents(docs: DataFrame, **settings) -> DataFrame:
    return pack(staged(pieces(docs, **settings), "pieces"), settings.get("capacity", CAPACITY))
