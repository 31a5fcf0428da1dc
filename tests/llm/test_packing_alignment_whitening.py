"""Histogram packing, alignment of tokenizers and whitening against brute force, and on odd tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quirelake.llm import alignment, histogram_packing, whitening

CLASHING = ["row", "task", "rank", "first", "x", "d", "n", "slot", "pair", "docs", "shard", "length", "start", "_best", "others"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeéñßжи好 -'") for _ in range(rng.randint(1, 9)))
    plain = [" ".join(word() for _ in range(rng.choice([1, 5, 30, 200, 900, 4000]))) for _ in range(60)]
    odd = ["", None, " ", "  two  blanks ", "\n\nlines\n", "a▁b", "▁", "tab\tand\x00nul", "<s></s><unk><0x0A> <|endoftext|>", "x" * 3000, "ﬁ é é 　wide", plain[3], plain[3], "🙂🙂 👩‍👩‍👧", "don't we'll I'VE"]
    return plain + odd


@pytest.fixture(scope="module")
def docs(spark, texts):
    df = spark.createDataFrame([(i if i % 9 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    return df.withColumns({c: F.lit("extra") for c in CLASHING}).cache()


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


# op11


def shortest_pack_first(lengths, capacity):
    """Each pack listed, as the plan must not."""
    packs = []
    for n in sorted(lengths, reverse=True):
        shortest = min(packs, key=sum, default=[capacity])
        if sum(shortest) + n <= capacity:
            shortest.append(n)
        else:
            packs.append([n])
    return Counter(sum(p) for p in packs)  # which of several packs of a fill takes a piece is open


@pytest.mark.parametrize("seed", range(6))
def test_patterns_are_those_of_single_packs(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([rng.randint(1, 64), rng.randint(1, 9), 33]) for _ in range(rng.randint(1, 400))]
    found = histogram_packing.patterns(Counter(lengths), 64)
    assert all(p.fill == sum(n for n, _, _ in p.items) for p in found)
    assert sum((Counter({p.fill: p.count}) for p in found), Counter()) == shortest_pack_first(lengths, 64)


@pytest.mark.parametrize("seed", range(8))
def test_a_plan_places_every_id_once_and_pads_nothing(seed):
    rng = random.Random(seed)
    counts = Counter(rng.choice([rng.randint(1, 32), 17, 1]) for _ in range(rng.randint(1, 300)))
    if seed == 7:
        counts = Counter({32: 5})
    plan = histogram_packing.plan(counts, 32)
    filled: dict[int, list] = defaultdict(list)
    for n, c in counts.items():
        for rank in range(c):
            run, at = plan.runs(np.array([n]), np.array([rank]))
            run, at = int(run[0]), int(at[0])
            if plan.sequence[run] >= 0:
                filled[int(plan.sequence[run]) + at].append((int(plan.offset[run]), n))
            else:
                cuts = plan.cuts(int(plan.offset[run]) + at * n, n)
                assert [s for s, *_ in cuts] == list(np.cumsum([0, *(m for _, m, *_ in cuts)])[:-1]) and sum(m for _, m, *_ in cuts) == n
                for _, m, seq, off in cuts:
                    filled[seq].append((off, m))
    for places in filled.values():
        at = 0
        for off, m in sorted(places):
            assert off == at
            at += m
        assert at == 32 or at & (at - 1) == 0
    assert set(filled) == set(range(plan.sequences))


@pytest.mark.parametrize("capacity", [2048, 64])
def test_histogram_packing_of_documents(docs, texts, capacity):
    tok = library()
    want = {}
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.setdefault(i if i % 9 else None, []).append(ids)
    rows = histogram_packing.pack_documents(docs, capacity=capacity).collect()
    total = sum(len(x) for v in want.values() for x in v)
    assert sum(r["length"] for r in rows) == total
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for doc, found in by_doc.items():
        if doc is not None:
            (ids,) = want[doc]
            at = 0
            for r in sorted(found, key=lambda r: r["start"]):
                assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
                at += r["length"]
            assert at == len(ids)
    for found in by_sequence.values():
        at = 0
        for r in sorted(found, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity and (at == capacity or at & (at - 1) == 0)


def test_packing_of_no_documents(spark):
    assert histogram_packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# op12


def aligned(texts):
    import sentencepiece

    tok, sp = library(), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    tok.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    byte = {chr(b) if b in plain else chr(next(spare)): b for b in range(256)}
    per, count = [], Counter()
    for t in texts:
        a, b, links, groups = [], [], [], []
        if t:
            a, b = tok.encode(f" {t}", add_special_tokens=False).ids, sp.encode(t)
            of_a = [bytes(byte[c] for c in tok.id_to_token(i)) for i in a]
            of_b = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [sp.id_to_piece(i)]]
            if not b"".join(of_a) == b"".join(of_b) == f" {t}".encode():
                a = b = []
        if a:
            ends = [np.cumsum([len(x) for x in of]).tolist() for of in (of_a, of_b)]
            spans = [list(zip([0, *e], e)) for e in ends]
            j = 0
            for i, (s, e) in enumerate(spans[0]):
                while spans[1][j][1] <= s:
                    j += 1
                k = j
                while k < len(b) and spans[1][k][0] < e:
                    links.append((a[i], b[k]))
                    k += 1
            start = 0
            for end in sorted(set(ends[0]) & set(ends[1])):
                own = [[str(i) for i, (s, e) in zip(ids, sp_, strict=True) if s >= start and e <= end] for ids, sp_ in zip((a, b), spans, strict=True)] if len(a) < 400 else None
                groups.append(own and "|".join(",".join(x) for x in own))
                start = end
        per.append((len(a), len(b), links, groups))
        count.update(set(links))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    return [(na, nb, len(g), len(k), sum(count[p] == best[p[0]] for p in k), sum(count[p] for p in k), None if None in g else hashlib.sha256(";".join(g).encode()).hexdigest() if na else "") for na, nb, k, g in per]


@pytest.mark.parametrize("settings", [{}, {"held": 200}, {"held": 0}])
def test_alignment_equals_brute_force(docs, texts, settings):
    want = aligned(texts)
    got = defaultdict(list)
    for r in alignment.align(docs, **settings).collect():
        got[r["doc_id"]].append(tuple(r)[1:])
    same = lambda g, w: g[:6] == w[:6] and w[6] in (None, g[6])
    for i, w in enumerate(want):
        if i % 9:
            assert len(got[i]) == 1 and same(got[i][0], w), (i, texts[i])
    none = [want[i] for i in range(0, len(texts), 9)]
    assert sorted(g[:6] for g in got[None]) == sorted(w[:6] for w in none)


@pytest.mark.parametrize("size", [0, 1, 7, 5000])
def test_hash_is_minimal_and_perfect(size):
    rng = np.random.default_rng(size)
    pairs = np.unique(rng.integers(0, 1 << 48, size))
    shards = [pairs[alignment.shard_of(alignment.slots(pairs), 3) == s] for s in range(3)]
    rows = []
    for s, own in enumerate(shards):
        sizes, bits, keys = alignment.build(own)
        rows.append({"shard": s, "sizes": sizes, "bits": bits, "keys": keys.tobytes()})
        assert sum(sizes) <= 6 * len(own) + 64 * 12
    h = alignment.Hash(rows, 3)
    assert sorted(h.index(pairs).tolist()) == list(range(len(pairs)))
    assert (h.index(np.setdiff1d(rng.integers(0, 1 << 48, 500), pairs)) == -1).all()


def test_dense_vectors_are_summed_by_a_tree(spark):
    rng = random.Random(3)
    rows = [(t, p, rng.randint(1, 9)) for t in range(40) for p in rng.sample(range(300), 90)]
    df = spark.createDataFrame(rows, "task int, pair long, docs long")
    slot = alignment.with_slots(df.select("pair", "docs")).select("pair", "slot").distinct()
    found = df.join(slot, "pair").select("task", "slot", "pair", "docs").cache()
    hashes = alignment.hashed(found, 4).cache()
    table = hashes.join(alignment.counted(found, hashes, 4, 20), "shard")
    want = Counter()
    for _, p, n in rows:
        want[p] += n
    assert {r["pair"]: r["docs"] for r in alignment.entries(table).collect()} == want


def test_alignment_of_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(empty).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(tuple(r) for r in alignment.align(nulls).collect()) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


# op13


def orthonormal(rng, d):
    q = np.linalg.qr(rng.standard_normal((d, d)))[0].astype(np.longdouble)
    for _ in range(4):  # to extended precision
        q = q @ (1.5 * np.eye(d, dtype=np.longdouble) - 0.5 * (q.T @ q))
    return q


@pytest.mark.parametrize("values", [
    [5, 4, 3, 2, 1], [3, 3, 3, 1, 1], [1, 1 - 1e-9, 1 - 2e-9, 0.5, 0.5 - 1e-12], [1, 1e-9, 1e-9 * (1 - 1e-5), 1e-12, 1e-16], [1e12, 1, 1 - 1e-7, 0, 0], [7] * 5, [0] * 5,
    [*np.linspace(1, 2, 40)], [1 + 1e-10 * k for k in range(30)], [*np.geomspace(1, 1e-15, 24)],
])
def test_eigenvectors_are_right_in_double_precision(values):
    rng = np.random.default_rng(len(values))
    d, q = len(values), orthonormal(rng, len(values))
    want = np.sort(np.array(values, np.longdouble))[::-1]
    a = (q * np.array(values, np.longdouble)) @ q.T
    a = (a + a.T) / 2
    got, x = whitening.eigen(a)
    top = max(want[0], 1e-300)
    assert np.abs(got - want).max() <= 1e-17 * top
    assert np.abs(x.T @ x - np.eye(d)).max() < 1e-17 and np.abs(a @ x - x * got).max() <= 1e-17 * top
    order = np.argsort(-np.array(values), kind="stable")
    for k in range(d):  # vectors whose eigenvalue stands apart
        gap = np.abs(np.delete(want, k) - want[k]).min()
        if gap > 1e-3 * top:
            assert 1 - abs(float(x[:, k] @ q[:, order[k]])) < 1e-15
        if gap > 1e-13 * top:
            v, w = x[:, k], q[:, order[k]]
            assert np.abs(v * np.sign(v @ w) - w).max() < 1e-18 / float(gap / top) * 50 + 1e-17


def test_products_and_sums_are_exact():
    rng = np.random.default_rng(1)
    for top in (10, 1 << 25, 1 << 61):
        y = rng.integers(-top, top, (70, 3))
        want = [[sum(int(r[i]) * int(r[j]) for r in y) for j in range(3)] for i in range(3)]
        assert whitening.products(y).tolist() == want
        assert whitening.column_sums(y) == [sum(map(int, y[:, i])) for i in range(3)]


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((120, 20)).astype(np.float32) @ np.diag(np.geomspace(3, 0.05, 20)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(i, base[0].tolist()) for i in range(200, 260)]
    odd = [(900, None), (901, []), (902, [1.0, None] + [0.0] * 18), (903, [float("nan")] * 20), (904, [float("inf")] + [0.0] * 19), (905, [1.0, 2.0]), (906, [1e30] * 20), (None, base[1].tolist()), (3, base[4].tolist())]
    return spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<float>").repartition(4).withColumns({c: F.lit("extra") for c in CLASHING}).cache()


def test_whitening_equals_exact_arithmetic(vectors):
    used = [(r["vec_id"], r["embedding"]) for r in vectors.collect() if r["embedding"] and len(r["embedding"]) == 20 and all(v is not None and abs(v) < 2**55 for v in r["embedding"])]
    xs = [(i, tuple(int(np.floor(64 * v)) + 1_000_000 for v in e)) for i, e in used]
    fit = sorted({x for _, x in xs})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    cov = [[float(Fraction(sum((n * x[i] - sums[i]) * (n * x[j] - sums[j]) for x in fit), n**3)) for j in range(20)] for i in range(20)]
    value, vec = np.linalg.eigh(np.array(cov))
    value, vec = value[::-1], vec[:, ::-1]
    rows = whitening.whiten(vectors).collect()
    got = defaultdict(list)
    for r in rows:
        got[r["vec_id"], r["deviation"]].append(r)
    assert len(rows) == 16 * len(xs) and {r["n"] for r in rows} == {n} and len({r["identity_error"] for r in rows}) == 1 and rows[0]["identity_error"] < 1e-9
    for i, x in xs:
        dev = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        own = got[i, dev]
        assert len(own) >= 16
        c = np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums)])
        for r in own:
            k = r["component"] - 1
            assert abs(abs(r["whitened"]) - abs(c @ vec[:, k]) / np.sqrt(value[k])) < 1e-8 and abs(r["explained"] * value.sum() / value[k] - 1) < 1e-10


def test_whitening_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, schema)).count() == 0  # one distinct vector: no variance
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 0.5, float(-i)]) for i in range(5)], schema)).collect()
    assert len(line) == 5 and abs(line[0]["explained"] - 1) < 1e-12 and line[0]["identity_error"] < 1e-12
    far = whitening.whiten(spark.createDataFrame([(1, [1e15, 0.0]), (2, [-1e15, 1.0]), (3, [0.0, 5.0])], schema)).collect()
    assert all(r["deviation"] is None for r in far if r["vec_id"] < 3) and len(far) == 3  # the second is too small beside the first
