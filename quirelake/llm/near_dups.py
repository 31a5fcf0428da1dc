"""Near-duplicate documents by MinHash bands and odd sketches.

A document's set is its distinct shingles of words; two documents are linked where the Jaccard
similarity of their sets reaches a threshold, and the links' connected components are the groups.

1. Equal word sequences are one class, which is all that the later steps see.
2. Every class gets MinHash samples. Runs of samples, hashed, are its bands; classes that share a band
   are in one bucket. All samples are folded into an odd sketch: each flips one bit of a bitmap, so
   that two bitmaps' exclusive-or counts the samples that differ, and with that the similarity.
3. In every bucket the members are paired with its first member only; each class keeps the leader that
   it shares most bands with, and the full sets of the two are compared. The links make components.
4. Buckets that still hold more than one component are searched for pairs across components. Of large
   ones, all members' shingles are counted, and pairs are sought by prefixes: of two alike sets the
   smaller one's rarest shingles meet the larger one's (``by_rare_shingles``). That takes in whoever
   shares a band, or a template of common shingles, and is not alike enough, at no cost by pairs; what
   is left of a large bucket are members whose prefix itself holds a common shingle. These with all
   others, and the members of small buckets, are held against one another in blocks of bounded size. Pairs whose odd sketches may reach the threshold are compared there on their
   sets, as bitmaps over the block's shingles, each pair in the first band that it shares only; of the
   links a spanning forest over the components leaves the block, and is confirmed on the full sets. So
   after this step each pair of the bands has either been compared in full, lies inside one component, or is further
   below the threshold than the sketch can err.

A large component's members stand in blocks of their own, which are not held against one another, so
a group of any size costs in proportion to its members and to what in its buckets is not part of it;
the pairs inside a group are never listed. Links, components and sketches stay distributed.

Defined results: A-Z are lower-cased; a document of fewer words than a shingle has its whole sequence
as its only one; null texts and texts without words have empty sets and are linked with nothing.
Classes are told apart by 64-bit hashes of the word sequences and shingles by 64-bit hashes. Rows that
share a doc_id belong to the group of their own text, and component ids are least doc_ids. A text none of whose
rows has a doc_id is linked with no near copy, and all rows without one stay. An empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .common import arrow_map, sized, staged

U = np.uint64
#: MinHash samples, of which the bands take the first ones.
SAMPLES, BANDS, ROWS = 256, 28, 4
SKETCH_BITS = 1024
#: How far below the threshold an estimate may lie and be compared in full: over four deviations.
MARGIN = 0.12
#: Most members of a chunk, of which a block has two at most; one with many shingles counts as several.
BLOCK = 1024
SHINGLES_A_MEMBER = 2000
#: Most sets that hold a shingle which pairs are sought by.
RARE = 256
#: Bytes of the bitmaps of a block, beyond which its pairs are compared one by one.
BITMAP_BYTES = 64 << 20

_rng = np.random.default_rng(20)
_A = _rng.integers(0, 2**32, SAMPLES, np.uint32) | np.uint32(1)
_B = _rng.integers(0, 2**32, SAMPLES, np.uint32)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """The distinct shingle hashes of a sequence of word hashes."""
    if not len(h):
        return h
    return np.unique(tn.windows(h, k) if len(h) >= k else tn.windows(h, len(h)) ^ U(len(h)))


def sequence_hash(h: np.ndarray) -> int:
    return int(tn.sum_of_parts(h, np.array([len(h)])).view(np.int64)[0])


def samples(s: np.ndarray) -> np.ndarray:
    """The least value of each hash function over the set."""
    low = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    x = (s >> U(32)).astype(np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(x), 256):
            np.minimum(low, (x[i : i + 256, None] * _A + _B).min(axis=0), out=low)
    return low


def signature(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, odd sketch as 64-bit words) of a set."""
    low = samples(s).astype(U)
    with np.errstate(over="ignore"):
        rows = low[: BANDS * ROWS].reshape(BANDS, ROWS)
        keys = np.arange(1, BANDS + 1, dtype=U)
        for j in range(ROWS):
            keys = tn.mix(keys * U(0x9E3779B97F4A7C15) + rows[:, j])
        bit = tn.mix(low + (np.arange(1, SAMPLES + 1, dtype=U) << U(40))) >> U(64 - SKETCH_BITS.bit_length() + 1)
    odd = np.bincount(bit.astype(np.int64), minlength=SKETCH_BITS) & 1
    return keys, np.packbits(odd.astype(np.uint8), bitorder="little").view(U)


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The similarity of each sketch in a with each in b."""
    odd = np.zeros((len(a), len(b)), np.int64)
    for w in range(a.shape[1]):
        odd += np.bitwise_count(a[:, w, None] ^ b[None, :, w])
    z = np.minimum(odd, SKETCH_BITS // 2 - 1)
    differ = -SKETCH_BITS / 2 * np.log1p(-2 * z / SKETCH_BITS)
    return 1 - differ / (2 * SAMPLES)


def _texts(batches, k: int):
    """(row of the batch, word hashes) for each text, batch by batch."""
    for b in batches:
        for first, run in tn.pieces(b["text"]):
            data, at = tn.padded(run, lower=True)
            starts, ends = tn.word_bounds(data)
            h = tn.word_hashes(data, starts, ends) if len(starts) else np.zeros(0, U)
            edges = np.searchsorted(starts, np.append(at, len(data)))
            yield b, first, [h[i:j] for i, j in zip(edges[:-1], edges[1:], strict=True)]


def classify(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, mark, class, n, bands, sketch) of every document; class null for empty sets.

    ``mark`` is a hash of the text as it is, which tells rows of one doc_id apart.
    """

    def made(batches):
        for b, first, hs in _texts(batches, k):
            seen: dict[int, tuple] = {}
            rows = []
            own = slice(first, first + len(hs))
            for doc, mark, h in zip(b["doc_id"].to_pylist()[own], b["mark"].to_pylist()[own], hs, strict=True):
                if not len(h):
                    rows.append((doc, mark, None, 0, None, None))
                    continue
                c = sequence_hash(h)
                if c not in seen:
                    s = shingles(h, k)
                    keys, sketch = signature(s)
                    seen[c] = (c, len(s), keys.view(np.int64), sketch.view(np.int64))
                rows.append((doc, mark, *seen[c]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "mark", "class", "n", "bands", "sketch"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("mark")), made, "doc_id long, mark long, class long, n long, bands array<long>, sketch array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(class, shingles) of the classes in wanted(class, lead), each read from a document with its lead's id."""

    def made(batches):
        for b, first, hs in _texts(batches, k):
            rows = [(w, sequence_hash(h), shingles(h, k).view(np.int64)) for w, h in zip(b["want"].to_pylist()[first : first + len(hs)], hs, strict=True)]
            rows = [(c, s) for w, c, s in rows if w == c]
            if rows:
                c, s = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(s, pa.list_(pa.int64()))], ["class", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("lead"), "text").join(sized(wanted.select("lead", F.col("class").alias("want"))), "lead")
    return arrow_map(texts, made, "class long, shingles array<long>").dropDuplicates(["class"])


def links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike enough."""
    a = sets.select(F.col("class").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("class").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    return pairs.join(a, "a").join(b, "b").where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, label) for all nodes of edges(a, b), or of ``nodes``(node) that the edges join.

    Each round every node goes over to the best of itself and its neighbours - the one with most
    neighbours, then by a hash of the round - and the edges are drawn between where their ends went.
    """
    edges = staged(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    every = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    label = staged(every.select("node", F.col("node").alias("label")), "labels")
    turn = 0
    while not edges.isEmpty():
        turn += 1
        ends = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        degree = staged(ends.groupBy("a").agg(F.count("*").alias("d")), "degrees")
        rank = lambda node, d: F.struct(F.col(d).alias("d"), F.xxhash64(F.lit(turn), node).alias("h"), F.col(node).alias("to"))  # noqa: B023, E731
        near = ends.join(degree.select(F.col("a").alias("b"), "d"), "b").select("a", rank("b", "d").alias("r"))
        near = near.unionByName(degree.select("a", rank("a", "d").alias("r")))
        goes = staged(near.groupBy("a").agg(F.max("r").alias("r")).select(F.col("a").alias("node"), F.col("r.to").alias("to")), "hops")
        label = staged(label.withColumnRenamed("node", "_n").join(goes.withColumnRenamed("node", "label"), "label", "left").select(F.col("_n").alias("node"), F.coalesce("to", "label").alias("label")), "labels")
        moved = edges.join(goes.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(goes.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        edges = staged(moved.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    return label


def by_rare_shingles(members: DataFrame, sets: DataFrame, classes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of members(class, label, n) with different labels that may be alike, and the members they leave.

    With shingles ordered from the rarest on, two sets of which at least ``c`` shingles are common share
    one among the first |x| - c + 1 of each. Alike sets have in common at least 2t/(1+t) of the smaller and
    t of the larger, with the threshold t. So a smaller set whose own prefix is rare is found with all
    its partners by these shingles alone; the classes whose prefix is not are returned as second.
    """
    t = percent / 100
    ex = members.join(sets, "class").select("class", "label", "n", F.explode("shingles").alias("s"))
    held = staged(ex.groupBy("s").agg(F.count("*").alias("c")).where("c > 1"), "held")
    shared = ex.join(sized(held), "s").groupBy("class", "label", "n").agg(F.array_sort(F.collect_list(F.struct("c", "s"))).alias("x"))
    # shingles that no other set holds come first in every order
    lone = F.col("n") - F.size("x")
    head = lambda share: F.greatest(F.col("n") - F.ceil(F.col("n") * share - 1e-9) + 1 - lone, F.lit(0)).cast("int")
    both = shared.select("class", "label", "n", F.slice("x", 1, head(2 * t / (1 + t))).alias("own"), F.slice("x", 1, head(t)).alias("other"))
    both = staged(both.withColumn("common", F.coalesce(F.try_element_at("own.c", F.lit(-1)) > RARE, F.lit(False))), "prefixes")
    left = both.where(~F.col("common")).select(F.col("class").alias("a"), F.col("label").alias("la"), F.col("n").alias("na"), F.explode("own.s").alias("s"))
    right = both.select(F.col("class").alias("b"), F.col("label").alias("lb"), F.col("n").alias("nb"), F.explode(F.filter("other", lambda x: x["c"] <= RARE)).alias("x")).withColumn("s", F.col("x.s"))
    met = left.join(right, "s").where((F.col("na") <= F.col("nb")) & (F.col("na") >= F.col("nb") * t - 1e-9) & (F.col("la") != F.col("lb")))
    met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sketch = lambda c: classes.select(F.col("class").alias(c), F.col("sketch").alias(f"sketch_{c}"))
    differ = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    most = SKETCH_BITS / 2 * (1 - np.exp(-4 * SAMPLES * (1 - t + MARGIN) / SKETCH_BITS))
    return met.join(sketch("a"), "a").join(sketch("b"), "b").where(differ <= float(most)).select("a", "b"), both.where("common").select("class")


def _blocks(members: DataFrame) -> DataFrame:
    """members(band, class, label, n, found) of buckets with several labels, dealt into blocks.

    A label that fills a chunk in a bucket has chunks of its own; the others share chunks. Chunks meet
    in pairs, a shared one also itself, never two of one label, nor two of members that are ``found``,
    whose pairs are known. Rows get ``block`` and ``side``: 0 in the first chunk of the pair, 1 in the
    second, 2 where the block is one chunk.
    """
    weight = F.sum(1 + F.col("n") / SHINGLES_A_MEMBER)
    sized = members.groupBy("band", "label", "found").agg(weight.alias("m"))
    big = sized.where(F.col("m") > BLOCK).select("band", "label", "found", F.ceil(F.col("m") / BLOCK).cast("long").alias("own"))
    rest = sized.where(F.col("m") <= BLOCK).groupBy("band", "found").agg(F.ceil(F.sum("m") / BLOCK).cast("long").alias("shared"))
    sized = staged(sized.join(big, ["band", "label", "found"], "left").join(rest, ["band", "found"], "left").select("band", "label", "found", "own", "shared"), "chunks")
    name = lambda pure, i: F.concat(F.when(F.col("found"), "f").otherwise("n"), F.coalesce(pure.cast("string"), F.lit("")), F.lit(":"), i)
    at = F.when(F.col("own").isNotNull(), name(F.col("label"), F.pmod(F.xxhash64("class"), "own"))).otherwise(name(F.lit(None), F.pmod(F.xxhash64("label"), "shared")))
    placed = members.join(sized, ["band", "label", "found"]).select("band", "class", "label", at.alias("chunk"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias("i")
    own = big.select("band", "found", each("own"), F.col("label").alias("pure"))
    shared = rest.select("band", "found", each("shared"), F.lit(None).cast("long").alias("pure"))
    chunks = staged(own.unionByName(shared).select("band", "found", "pure", name(F.col("pure"), F.col("i")).alias("chunk")), "chunks")
    x, y = (chunks.select("band", F.col("chunk").alias(c), F.col("pure").alias(f"p{c}"), F.col("found").alias(f"f{c}")) for c in "xy")
    met = x.join(y, "band").where(((F.col("x") < F.col("y")) & ~F.coalesce(F.col("px") == F.col("py"), F.lit(False))) | ((F.col("x") == F.col("y")) & F.col("px").isNull()))
    met = met.where(~(F.col("fx") & F.col("fy"))).withColumn("block", F.xxhash64("band", "x", "y"))
    sides = met.where("x = y").select("band", F.col("x").alias("chunk"), "block", F.lit(2).alias("side")).unionByName(met.where("x != y").select("band", F.explode(F.array(F.struct(F.col("x").alias("chunk"), F.lit(0).alias("side")), F.struct(F.col("y").alias("chunk"), F.lit(1).alias("side")))).alias("c"), "block").select("band", "c.chunk", "block", "c.side"))
    return placed.join(sides, ["band", "chunk"]).select("block", "side", "band", "class", "label")


def common(i: np.ndarray, j: np.ndarray, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many shingles the members i and j of a block have in common, for pairs of members."""
    sizes = np.diff(ends)
    used = np.unique(np.concatenate([i, j]))
    rows = np.repeat(np.arange(len(sizes)), sizes)
    keep = np.isin(rows, used)
    values, inverse, times = np.unique(flat[keep], return_inverse=True, return_counts=True)
    rows = np.searchsorted(used, rows[keep])
    twice = times > 1  # a shingle of one member is common to none
    column = np.cumsum(twice) - 1
    hit = twice[inverse]
    rows, inverse = rows[hit], column[inverse[hit]]
    words = int(twice.sum()) // 64 + 1
    if len(used) * words * 8 > BITMAP_BYTES:
        return np.array([len(np.intersect1d(flat[ends[a] : ends[a + 1]], flat[ends[b] : ends[b + 1]], assume_unique=True)) for a, b in zip(i, j, strict=True)], np.int64)
    bits = np.zeros((len(used), words), U)
    np.bitwise_or.at(bits, (rows, inverse >> 6), U(1) << (inverse & 63).astype(U))
    a, b = np.searchsorted(used, i), np.searchsorted(used, j)
    step = max(1, (1 << 20) // words)
    return np.concatenate([np.bitwise_count(bits[a[k : k + step]] & bits[b[k : k + step]]).sum(axis=1, dtype=np.int64) for k in range(0, len(a), step)])


def spanning(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The places of the pairs (x, y) that join what the pairs before them leave apart."""
    up: dict[int, int] = {}

    def root(a: int) -> int:
        while (b := up.setdefault(a, a)) != a:
            up[a] = a = up[b]
        return a

    kept = []
    for k, (a, b) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
        a, b = root(a), root(b)
        if a != b:
            up[a] = b
            kept.append(k)
    return np.array(kept, np.int64)


def across(members: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Pairs (a, b) of classes with different labels whose sets are alike enough.

    Sets are compared by 32 bits of their shingles' hashes, so a pair may be too many but none is
    missing; with ``forest`` a block gives only pairs that join labels not joined by its others.
    """
    cut = percent / 100 - MARGIN

    def search(band, sides, ids, labels, sketches, bands, flat, ends):
        if sides[0] == 2:
            left = right = np.arange(len(ids))
            est = np.triu(estimates(sketches, sketches), 1)
        else:
            left, right = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
            est = estimates(sketches[left], sketches[right])
        i, j = np.nonzero((est >= cut) & (labels[left][:, None] != labels[right][None, :]))
        i, j = left[i], right[j]
        if len(i):
            # only in the first band that the two share
            at = int(np.flatnonzero(bands[i[0]] == band)[0])
            first = ~np.any([bands[i, k] == bands[j, k] for k in range(at)], axis=0) if at else np.ones(len(i), bool)
            i, j = i[first], j[first]
        if not len(i):
            return i, j
        sizes = np.diff(ends)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        twice = np.bincount(owner[1:][(flat[1:] == flat[:-1]) & (owner[1:] == owner[:-1])], minlength=len(sizes))
        # two shingles of equal 32 bits count as one, which must not cost a pair its link
        both = common(i, j, flat, ends) + np.minimum(twice[i], twice[j])
        alike = 100 * both >= percent * (sizes[i] + sizes[j] - both)
        i, j = i[alike], j[alike]
        if forest and len(i) > 1:
            tree = spanning(labels[i], labels[j])
            i, j = i[tree], j[tree]
        return np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])

    def searched(batches):
        held = None  # the rows of a block that may go on in the next batch
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            block = t["block"].to_numpy()
            edges = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            if len(edges) > 1:
                yield from found(t.slice(0, edges[-1]), edges)
            held = t.slice(edges[-1])
        if held is not None and held.num_rows:
            yield from found(held, np.array([0, held.num_rows]))

    def found(t, edges):
        t = t.combine_chunks()
        band, sides, ids, labels = (t[c].to_numpy() for c in ("band", "side", "class", "label"))
        sketches, bands = (t[c].chunk(0).flatten().to_numpy().reshape(len(ids), -1) for c in ("sketch", "bands"))
        lists = t["short"].chunk(0)
        flat, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy()
        ends = ends - ends[0]
        got = [search(band[s], sides[s:e], ids[s:e], labels[s:e], sketches[s:e].view(U), bands[s:e], flat[ends[s] : ends[e]], ends[s : e + 1] - ends[s]) for s, e in zip(edges[:-1], edges[1:], strict=True)]
        a, b = (np.concatenate(x) for x in zip(*got, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    short = F.array_sort(F.transform("shingles", lambda x: F.shiftright(x, 32).cast("int")))
    told = classes.select("class", "sketch", "bands").join(sets.select("class", short.alias("short")), "class")
    dealt = _blocks(members).join(told, "class").repartition(n, "block").sortWithinPartitions("block")
    return arrow_map(dealt, searched, "a long, b long").distinct()


def group(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, mark, group_key), a row per document.

    Groups whose least doc_ids are equal, as ids can be repeated, still differ in ``group_key``.
    """
    rows = staged(classify(docs, k), "signatures")
    full = rows.where("class is not null")
    classes = staged(full.groupBy("class").agg(F.min("doc_id").alias("lead"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "classes")
    bands = classes.select("class", F.explode("bands").alias("band"))
    buckets = bands.groupBy("band").agg(F.min("class").alias("first"), F.count("*").alias("m")).where("m > 1").select("band", "first")
    members = staged(bands.join(buckets, "band"), "members")

    paired = members.where("class != first").groupBy("class", "first").agg(F.count("*").alias("shared"))
    star = paired.groupBy("class").agg(F.max(F.struct("shared", "first")).alias("s")).select(F.col("class").alias("a"), F.col("s.first").alias("b"))
    wanted = staged(members.select("class").distinct().join(classes.select("class", "lead"), "class"), "wanted")
    sets = staged(full_sets(docs, wanted, k), "sets")
    found = staged(links(star, sets, percent), "links")
    label = components(found)
    named = members.select("band", "class").join(label.withColumnRenamed("node", "class"), "class", "left").select("band", "class", F.coalesce("label", "class").alias("label"))
    several = named.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select("band")
    todo = staged(named.join(several, "band").join(sets.select("class", F.size("shingles").alias("n")), "class"), "open")
    crowd = staged(todo.groupBy("band").agg(F.sum(1 + F.col("n") / SHINGLES_A_MEMBER).alias("w")).where(F.col("w") > 2 * BLOCK).select("band", F.lit(True).alias("crowd")), "crowded")
    todo = todo.withColumn("found", F.lit(False))
    if not crowd.isEmpty():
        inside = todo.join(crowd, "band").select("class", "label", "n").distinct()
        near, common_ = by_rare_shingles(inside, sets, classes, percent)
        found = found.unionByName(staged(links(staged(near, "near"), sets, percent), "links"))
        open_ = common_.withColumn("open", F.lit(True))
        todo = staged(todo.drop("found").join(crowd, "band", "left").join(open_, "class", "left").withColumn("found", F.col("crowd").isNotNull() & F.col("open").isNull()).drop("crowd", "open"), "open")
    for forest in (True, False):
        if todo.where("not found").isEmpty():
            break
        met = staged(across(todo, classes, sets, percent, forest), "met")
        new = staged(links(met, sets, percent), "links")
        found = found.unionByName(new)
        # a pair that is only alike by 32 bits could stand in for one that is: then all are asked for
        if met.count() == new.count():
            break
    label = components(found).withColumnRenamed("node", "class")
    named = classes.select("class", "lead").join(label, "class", "left").select("class", "lead", F.coalesce("label", "class").alias("label"))
    lowest = named.groupBy("label").agg(F.min("lead").alias("component_id"))
    ids = staged(named.join(lowest, "label").select("class", "component_id", F.col("label").alias("group_key")), "components")
    out = rows.select("doc_id", "mark", "class", F.col("n").alias("n_shingles")).join(ids, "class", "left")
    own = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"), "mark", "group_key")


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, the one with the least doc_id, with the columns it came with.

    Where several rows of a group have that doc_id, one of them stays.
    """
    found = group(docs, k, percent)
    found = staged(found.select(F.col("doc_id").alias("_ql_id"), F.col("mark").alias("_ql_mark"), "kept", "group_key"), "groups")
    # several rows of a group can have its least doc_id
    several = staged(found.where("kept and group_key is not null").groupBy("group_key").agg(F.count("*").alias("n"), F.min("_ql_mark").alias("stays"), F.min("_ql_id").alias("_ql_id")).where("n > 1"), "several")
    other = found.where("kept").join(several.select("group_key", "stays"), "group_key").where("_ql_mark != stays")
    gone = staged(found.where(~F.col("kept")).select("_ql_id", "_ql_mark").unionByName(other.select("_ql_id", "_ql_mark")).distinct(), "gone")
    same = lambda mark: F.col("doc_id").cast("long").eqNullSafe(F.col("_ql_id")) & (F.xxhash64("text") == F.col(mark))
    left = docs.join(sized(gone), same("_ql_mark"), "left_anti")
    if several.isEmpty():
        return left
    twice = several.select("_ql_id", "stays").distinct()
    one = left.join(twice, same("stays"), "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(twice, same("stays"), "left_anti").unionByName(one)
