"""Alignment of two tokenizers' tokens over the same bytes, with corpus-wide counts of linked pairs.

A and B cut a blank and the text into tokens. Where tokens of both end at the same byte a group ends,
and within it every A and B token whose bytes overlap are linked. Documents are tokenized once; their ids
are kept in the shared folder, and both passes align those.

The first pass gives each task's distinct linked pairs, with the number of its documents that hold
each. The distinct pairs of the corpus get a minimal perfect hash, by shards of bounded size: a level is
a bitmap in which a pair alone at its place sets a bit, the others go on to the next level, and the
number of set bits before a pair's own is its index. The tasks' numbers are added into dense vectors by
index - one per shard and leaf, a leaf being some tasks - and these are summed by a tree, eight at a
time. Each shard also lists its pairs by index, by which every lookup is verified.

The second pass aligns the documents again and looks the counts up. Executors hold the hash of at most
``held`` pairs; where the corpus has more, of those in the most documents. The other pairs, each in few
documents, meet their counts in a shuffle.

Defined results: null and empty texts, and those for which the joined bytes of A or B are not the blank
and the text (as with U+2581, which B takes for a blank), have no tokens: zeros and an empty string.
Strings of special tokens are plain text. Texts of any length are aligned whole. Repeated rows, rows
that share a doc_id, and rows without one count as a document each. Extra columns are ignored, whatever
their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, staged
from .packing import encoder

A, B = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
#: A pair of ids as one number.
B_BITS = 24
#: Bits of a pair's slot, by which it belongs to a shard.
SLOT_BITS = 24
#: Pairs in a shard, rows of the first pass that go into one dense vector, and vectors summed at once.
SHARD, LEAF, FAN = 100_000, 1 << 18, 8
#: Pairs that each executor may hold (some 17 bytes each).
HELD = 4_000_000
#: Distinct pairs that a task gathers before it lets them go.
GATHERED = 2_000_000


def piece_bytes(piece: str) -> bytes:
    """What a piece of B stands for."""
    if re.fullmatch(r"<0x[0-9A-F]{2}>", piece):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode("utf-8")


class Tokenizers:
    """Both tokenizers, and what each of their tokens stands for."""

    def __init__(self, a: str, b: str):
        import public_tokenizers
        import sentencepiece

        self.a = encoder(a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(b))
        self.bytes_a = [self.a.decode_single_token_bytes(i) for i in range(self.a.n_vocab)]
        self.bytes_b = [piece_bytes(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.size_a, self.size_b = (np.array([len(t) for t in x], np.int64) for x in (self.bytes_a, self.bytes_b))

    def encode(self, text: str | None) -> tuple[list[int], list[int]]:
        """The ids of both, or none where the tokens' bytes are not the blank and the text."""
        if not text:
            return [], []
        a, b, raw = self.a.encode_ordinary(f" {text}"), self.b.encode(text), f" {text}".encode()
        if b"".join([self.bytes_a[i] for i in a]) != raw or b"".join([self.bytes_b[i] for i in b]) != raw:
            return [], []
        return a, b


_tokenizers: dict[tuple[str, str], Tokenizers] = {}


def tokenizers(a: str, b: str) -> Tokenizers:
    if (a, b) not in _tokenizers:
        _tokenizers[a, b] = Tokenizers(a, b)
    return _tokenizers[a, b]


TOKENS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))])
#: Bits of a row's number within its task, and documents tokenized at once.
ROW_BITS, AT_ONCE = 40, 64


def tokens(docs: DataFrame, a: str = A, b: str = B) -> DataFrame:
    """(row, doc_id, a, b): every document's ids by both tokenizers."""

    def encoded(batches):
        both, row = tokenizers(a, b), TaskContext.get().partitionId() << ROW_BITS
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                ids = [both.encode(text.as_py()) for text in part.column("text")]
                columns = [pa.array(np.arange(row, row + len(ids))), part.column("doc_id"), *(pa.array(x, t) for x, t in zip(zip(*ids, strict=True), TOKENS.types[2:], strict=True))]
                row += len(ids)
                yield pa.RecordBatch.from_arrays(columns, schema=TOKENS)

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), encoded, "row long, doc_id long, a array<int>, b array<int>")


class Aligned:
    """The tokens of a batch of documents, laid end to end, and their links and groups.

    The bytes of A's and B's tokens end together at the end of each document, so a batch is aligned as
    one text is. Between two neighbouring ends of either there is one link.
    """

    def __init__(self, batch: pa.RecordBatch, both: Tokenizers):
        self.a, self.b = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in "ab")
        self.of_a, self.of_b = (np.concatenate([[0], np.cumsum(batch.column(c).value_lengths().to_numpy(zero_copy_only=False))]) for c in "ab")
        ends_a, ends_b = np.cumsum(both.size_a[self.a]), np.cumsum(both.size_b[self.b])
        ends = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
        again = ends[1:] == ends[:-1]
        self.groups = ends[1:][again]  # the ends of groups
        ends = ends[np.concatenate([[True], ~again])] if len(ends) else ends
        at_a, at_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        self.pairs = self.a[at_a] << B_BITS | self.b[at_b]
        until = np.concatenate([[0], ends_a])[self.of_a]
        self.of_link, self.of_group = np.searchsorted(ends, until, "right"), np.searchsorted(self.groups, until, "right")
        self.ends_a, self.ends_b = ends_a, ends_b

    def entries(self, ids: int) -> np.ndarray:
        """Each id of the groups as they are written, with what follows it: 0 a comma, 1 a bar, 2 a
        semicolon, times ``ids``."""
        group_a, group_b = np.searchsorted(self.groups, self.ends_a), np.searchsorted(self.groups, self.ends_b)
        last_a, last_b = self.groups[group_a] == self.ends_a, self.groups[group_b] == self.ends_b
        upto_a, upto_b = np.flatnonzero(last_a) + 1, np.concatenate([[0], np.flatnonzero(last_b) + 1])
        out = np.empty(len(self.a) + len(self.b), np.int64)
        out[np.arange(len(self.a)) + upto_b[group_a]] = self.a + ids * last_a
        out[np.arange(len(self.b)) + upto_a[group_b]] = self.b + 2 * ids * last_b
        return out


# The first pass


def linked(encoded: DataFrame, a: str = A, b: str = B) -> DataFrame:
    """(task, slot, pair, docs): the distinct pairs of each task and how many of its documents hold them."""

    def gathered(batches):
        task, both = TaskContext.get().partitionId(), tokenizers(a, b)
        pairs, docs = np.zeros(0, np.int64), np.zeros(0, np.int64)
        waiting: list[np.ndarray] = []
        many = 0

        def merged():
            new, of, n = np.unique(np.concatenate([pairs, *waiting]), return_inverse=True, return_counts=True)
            n[of[: len(pairs)]] += docs - 1
            return new, n

        def out():
            step = 1 << 17
            for at in range(0, len(pairs), step):
                p, n = pairs[at : at + step], docs[at : at + step]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), task, np.int32)), pa.array(slots(p)), pa.array(p), pa.array(n)], ["task", "slot", "pair", "docs"])

        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):
                found = Aligned(whole.slice(at, AT_ONCE), both)
                of = np.repeat(np.arange(len(found.of_link) - 1), np.diff(found.of_link))
                waiting.append(np.unique(of << 2 * B_BITS | found.pairs) & (1 << 2 * B_BITS) - 1)
                many += len(waiting[-1])
                if many > GATHERED:
                    (pairs, docs), waiting, many = merged(), [], 0
                    if len(pairs) > GATHERED:
                        yield from out()
                        pairs, docs = pairs[:0], docs[:0]
        pairs, docs = merged()
        yield from out()

    return arrow_map(encoded.select("a", "b"), gathered, "task int, slot int, pair long, docs long")


# The hash


def mixed(pairs: np.ndarray, level: int) -> np.ndarray:
    """64 well mixed bits of each pair, others on each level."""
    x = pairs.astype(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slots(pairs: np.ndarray) -> np.ndarray:
    return (mixed(pairs, -1) >> np.uint64(64 - SLOT_BITS)).astype(np.int32)


def build(pairs: np.ndarray) -> tuple[list[int], bytes, np.ndarray]:
    """(bits of each level, the levels' bitmaps, the pairs by index) of distinct ``pairs``."""
    sizes, bits, order = [], [], []
    while len(pairs):
        size = -(-2 * len(pairs) // 64) * 64
        at = (mixed(pairs, len(sizes)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        mine = alone[at]
        order.append(pairs[mine][np.argsort(at[mine])])
        sizes.append(size)
        bits.append(np.packbits(alone, bitorder="little").tobytes())
        pairs = pairs[~mine]
    return sizes, b"".join(bits), np.concatenate(order) if order else np.zeros(0, np.int64)


class Hash:
    """The index of a pair in ``keys``, by the hashes of some shards."""

    def __init__(self, rows: list, shards: int):
        rows = sorted(rows, key=lambda r: r["shard"])
        self.shards, self.levels = shards, max((len(r["sizes"]) for r in rows), default=0)
        self.sizes, self.starts = np.zeros((2, shards, self.levels), np.int64)
        at = 0
        for r in rows:
            for level, size in enumerate(r["sizes"]):
                self.sizes[r["shard"], level], self.starts[r["shard"], level] = size, at
                at += size
        self.words = np.frombuffer(b"".join(r["bits"] for r in rows), np.uint64)
        self.before = np.cumsum(np.bitwise_count(self.words), dtype=np.int64) - np.bitwise_count(self.words)
        self.keys = np.frombuffer(b"".join(r["keys"] for r in rows), np.int64)

    def index(self, pairs: np.ndarray) -> np.ndarray:
        """Each pair's place in ``keys``, -1 for a pair that isn't there."""
        out = np.full(len(pairs), -1, np.int64)
        left, shard = np.arange(len(pairs)), shard_of(slots(pairs), self.shards)
        for level in range(self.levels):
            size = self.sizes[shard[left], level]
            left = left[size > 0]
            own = shard[left]
            at = self.starts[own, level] + (mixed(pairs[left], level) % self.sizes[own, level].astype(np.uint64)).astype(np.int64)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = (self.before[at >> 6] + below)[hit]
            left = left[~hit]
        known = out >= 0
        out[known] = np.where(self.keys[out[known]] == pairs[known], out[known], -1)
        return out


def shard_of(slot, shards: int):
    """The shard of a slot, a number or a column."""
    if isinstance(slot, np.ndarray):
        return slot.astype(np.int64) * shards >> SLOT_BITS
    return F.shiftright(slot.cast("long") * shards, SLOT_BITS).cast("int")


HASHED = "shard int, sizes array<long>, bits binary, keys binary"


def hashed(pairs: DataFrame, shards: int) -> DataFrame:
    """A row for each shard with the hash of its pairs, from (slot, pair) with repeats."""

    def shard(key, rows):
        sizes, bits, keys = build(rows.column("pair").to_numpy())
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "sizes": pa.array([sizes], pa.list_(pa.int64())), "bits": pa.array([bits], pa.binary()), "keys": pa.array([keys.tobytes()], pa.binary())})

    return pairs.select(shard_of(F.col("slot"), shards).alias("shard"), "pair").distinct().groupBy("shard").applyInArrow(shard, HASHED)


def counted(found: DataFrame, hashes: DataFrame, shards: int, leaves: int) -> DataFrame:
    """(shard, counts): the dense vectors of all tasks' numbers, summed by a tree."""

    def dense(key, heads, rows):
        head = heads.to_pylist()[0]
        one = Hash([head], shards)
        at = one.index(rows.column("pair").to_numpy())
        if (at < 0).any():
            raise RuntimeError("a pair is not in the hash of its shard")
        sums = np.zeros(len(one.keys), np.int64)
        np.add.at(sums, at, rows.column("docs").to_numpy())
        return vector(*key, sums)

    def vector(shard, node, sums):
        return pa.table({"shard": pa.array([shard.as_py()], pa.int32()), "node": pa.array([node.as_py()], pa.int32()), "counts": pa.array([sums.tobytes()], pa.binary())})

    def added(key, rows):
        return vector(*key, sum(np.frombuffer(v.as_py(), np.int64) for v in rows.column("counts")))

    schema = "shard int, node int, counts binary"
    rows = found.select(shard_of(F.col("slot"), shards).alias("shard"), F.expr(f"task % {leaves}").alias("node"), "pair", "docs")
    heads = hashes.select("shard", F.explode(F.sequence(F.lit(0), F.lit(leaves - 1))).alias("node"), "sizes", "bits", "keys")
    out = heads.groupBy("shard", "node").cogroup(rows.groupBy("shard", "node")).applyInArrow(dense, schema)
    while leaves > 1:
        leaves = -(-leaves // FAN)
        out = out.withColumn("node", F.expr(f"node div {FAN}").cast("int")).groupBy("shard", "node").applyInArrow(added, schema)
    return out.select("shard", "counts")


def entries(table: DataFrame) -> DataFrame:
    """(pair, docs) of all shards."""

    def rows(batches):
        for b in batches:
            for keys, counts in zip(b.column("keys"), b.column("counts"), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x.as_py(), np.int64)) for x in (keys, counts)], ["pair", "docs"])

    return arrow_map(table.select("keys", "counts"), rows, "pair long, docs long")


class Counts:
    """What executors hold: a hash, the counts by index, and each A id's highest count."""

    def __init__(self, rows: list, shards: int, best: dict[int, int], whole: bool):
        self.hash, self.whole = Hash(rows, shards), whole
        self.docs = np.frombuffer(b"".join(r["counts"] for r in sorted(rows, key=lambda r: r["shard"])), np.int64)
        self.best = np.zeros(max(best, default=0) + 1, np.int64)
        for a, n in best.items():
            self.best[a] = n


def count(encoded: DataFrame, a: str = A, b: str = B, held: int = HELD) -> tuple[Counts, DataFrame | None]:
    """(what executors hold, the other pairs' entries: pair, docs, best)."""
    found = staged(linked(encoded, a, b), "linked")
    size = found.agg(F.approx_count_distinct("pair").alias("pairs"), F.count("*").alias("rows")).first()
    shards = max(1, -(-size["pairs"] // SHARD))
    hashes = staged(hashed(found, shards), "hashes")
    table = staged(hashes.join(counted(found, hashes, shards, max(1, -(-size["rows"] // (shards * LEAF)))), "shard"), "counts")
    all_entries = entries(table)
    of_a = F.shiftright("pair", B_BITS)
    most = all_entries.groupBy(of_a.alias("a")).agg(F.max("docs").alias("docs"))
    best = {r["a"]: r["docs"] for r in most.collect()}  # a row for each A id at most
    by_size = {r["z"]: r["n"] for r in all_entries.groupBy(F.length(F.bin("docs")).alias("z")).agg(F.count("*").alias("n")).collect()}
    if sum(by_size.values()) <= held:
        return Counts(table.collect(), shards, best, True), None
    least = 1 + max(by_size)  # of powers of two, the least from which on at most `held` pairs are counted
    while by_size.get(least - 1, 0) + sum(n for z, n in by_size.items() if z >= least) <= held:
        least -= 1
    few = max(1, -(-held // SHARD))
    hot = staged(with_slots(all_entries.filter(F.length(F.bin("docs")) >= least)), "often")
    hot_hashes = staged(hashed(hot, few), "often-hashes")
    kept = hot_hashes.join(counted(hot, hot_hashes, few, 1), "shard").collect()
    rest = all_entries.filter(F.length(F.bin("docs")) < least)
    highest = F.broadcast(most.withColumnsRenamed({"a": "_a", "docs": "_most"}))
    return Counts(kept, few, best, False), rest.join(highest, of_a == F.col("_a")).select("pair", "docs", (F.col("docs") == F.col("_most")).alias("best"))


def with_slots(pairs: DataFrame) -> DataFrame:
    def rows(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(b.num_rows, np.int32)), pa.array(slots(b.column("pair").to_numpy())), *b.columns], ["task", "slot", *b.schema.names])

    return arrow_map(pairs, rows, "task int, slot int, pair long, docs long")


# The second pass


SIZES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
SCHEMA = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in SIZES), ("groups_sha256", pa.string()), ("others", pa.list_(pa.int64()))])


def sums_by(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The sums of the runs of ``values`` that begin and end at ``of``."""
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[of])


def align(docs: DataFrame, a: str = A, b: str = B, held: int = HELD) -> DataFrame:
    """Each document's tokens, groups and links, and what the corpus's counts say of its links."""
    encoded = staged(tokens(docs, a, b), "tokens")
    counts, rest = count(encoded, a, b, held)
    sent = docs.sparkSession.sparkContext.broadcast(counts)

    def aligned(batches):
        both, counts = tokenizers(a, b), sent.value
        ids = max(len(both.bytes_a), len(both.bytes_b))
        texts = np.array([f"{i}{after}" for after in ",|;" for i in range(ids)], object)
        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):
                part = whole.slice(at, AT_ONCE)
                found = Aligned(part, both)
                index = counts.hash.index(found.pairs)
                known = index >= 0
                if counts.whole and not known.all():
                    raise RuntimeError("a linked pair was not counted")
                docs = np.where(known, counts.docs[index], 0) if len(counts.docs) else np.zeros(len(index), np.int64)
                best = known & (docs == counts.best[found.pairs >> B_BITS])
                written = found.entries(ids)
                of = found.of_a + found.of_b
                digests = ["" if s == e else hashlib.sha256("".join(texts[written[s:e]])[:-1].encode()).hexdigest() for s, e in zip(of[:-1], of[1:], strict=True)]
                others = [found.pairs[s:e][~known[s:e]] for s, e in zip(found.of_link[:-1], found.of_link[1:], strict=True)]
                numbers = [np.diff(found.of_a), np.diff(found.of_b), np.diff(found.of_group), np.diff(found.of_link), sums_by(best, found.of_link), sums_by(docs, found.of_link)]
                columns = [part.column("row"), part.column("doc_id"), *(pa.array(x, pa.int64()) for x in numbers), pa.array(digests, pa.string()), pa.array(others, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, schema=SCHEMA)

    schema = f"row long, doc_id long, {', '.join(f'{c} long' for c in SIZES)}, groups_sha256 string, others array<long>"
    out = arrow_map(encoded, aligned, schema)
    result = ["doc_id", *SIZES, "groups_sha256"]
    if rest is None:
        return out.select(*result)
    out = staged(out, "aligned")
    links = out.select("row", F.explode("others").alias("pair")).groupBy("row", "pair").agg(F.count("*").alias("times"))
    sums = links.join(rest, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("docs") * F.col("times")).alias("_sum"))
    more = {"n_best": F.col("n_best") + F.coalesce("_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0))}
    return out.join(sums, "row", "left").withColumns(more).select(*result)
