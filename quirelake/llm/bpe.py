"""BPE encoding by an index of pair occurrences, and decoding.

A run of texts is split into words as the tokenizer file says. Its distinct words are laid out one
after another, every pair of neighbouring symbols is mapped to all positions where it occurs, and the
pairs are merged in ascending rank: at each of the pair's positions that still holds it, the two
symbols become one, and the pairs that this makes with the neighbours are added to their own lists.
Words are then assembled back into texts. Every distinct word is merged once per run of texts and
kept for the next runs of the partition, up to a number of words after which memory is let go.

Defined results: null text is empty; an empty text has no ids, and its digests are those of the empty
string. Strings of special tokens in a text become their ids, as in the library. Texts and words of
any length are processed whole. Decoding joins the ids' tokens by one space, as files without a
decoder do. Repeated rows and rows that share a doc_id, or have none, are encoded each. Extra columns
are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

#: Distinct words whose ids are kept between runs of texts.
KEPT_WORDS = 400_000


#: A character outside of the blocks that no version of Unicode classifies otherwise: Latin with its
#: extensions A and B, dashes, quotes and the euro sign. Texts without one take the fast path, which
#: gives what the library's normalizer and pre-tokenizer give; the others go through these.
UNSETTLED = re.compile(r"[^\x00-\u024f\u2010-\u2027\u2030-\u205e\u20ac]")


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where printable, else one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Tokenizer:
    """A BPE tokenizer file with word ends, lower-casing and no decoder."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Regex, pre_tokenizers
        from tokenizers import Tokenizer as Library

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        #: A pair of ids as one number: (rank, id of the merged symbol).
        self.pairs = {self.vocab[a] << 32 | self.vocab[b]: (r, self.vocab[a + b]) for r, (a, b) in reversed([*enumerate(merges)])}
        kinds = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        pattern = kinds[0]["pattern"]["Regex"]
        self.find = regex.compile(pattern).findall
        self.library = Library.from_file(path).normalizer.normalize_str
        self.pretokenize = pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")").split
        self.byte = byte_characters()
        self.inner = [self.vocab[c] for c in self.byte]
        self.last = [self.vocab[c + self.end] for c in self.byte]
        self.known: dict[str, tuple[str, str, int]] = {}

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        if text.isascii():
            return self.find(text.lower())
        if UNSETTLED.search(text) is None:
            return self.find(unicodedata.normalize("NFC", text).lower())
        return [w for w, _ in self.pretokenize(self.library(text))]

    def merged(self, new: list[str]) -> list[list[int]]:
        """The ids of each distinct word, by one index of pair positions over all of them."""
        ids: list[int] = []
        starts: list[int] = []
        if not new:
            return []
        for w in new:
            starts.append(len(ids))
            raw = w.encode("utf-8")
            inner = self.inner
            ids += [inner[b] for b in raw[:-1]]
            ids.append(self.last[raw[-1]])
            ids.append(-1)  # a wall between words
        n, pairs = len(ids), self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        where: dict[int, list[int]] = {}
        for i in range(n - 1):
            a, b = ids[i], ids[i + 1]
            if a >= 0 and b >= 0:
                key = a << 32 | b
                if key in where:
                    where[key].append(i)
                elif key in pairs:
                    where[key] = [i]
        active = [(pairs[k][0], k) for k in where]
        heapify(active)
        while active:
            _, key = heappop(active)
            made, left, right = pairs[key][1], key >> 32, key & 0xFFFFFFFF
            at = where.pop(key)
            at.sort()  # from the left, so that overlapping pairs merge as they are read
            for i in at:
                if ids[i] != left:
                    continue
                j = after[i]
                if j >= n or ids[j] != right:
                    continue
                k = after[j]
                ids[i], ids[j] = made, -2
                after[i] = k
                if k < n:
                    before[k] = i
                    if ids[k] >= 0:
                        new_key = made << 32 | ids[k]
                        if new_key in where:
                            where[new_key].append(i)
                        elif new_key in pairs:
                            where[new_key] = [i]
                            heappush(active, (pairs[new_key][0], new_key))
                h = before[i]
                if h >= 0 and ids[h] >= 0:
                    new_key = ids[h] << 32 | made
                    if new_key in where:
                        where[new_key].append(h)
                    elif new_key in pairs:
                        where[new_key] = [h]
                        heappush(active, (pairs[new_key][0], new_key))
        return [[x for x in ids[s : e - 1] if x >= 0] for s, e in zip(starts, [*starts[1:], n], strict=True)]

    def split(self, text: str) -> list[str]:
        """The words and special tokens of a text, in order."""
        if "<|" not in text:
            return self.words(text)
        out: list[str] = []
        for part in self.cut(text):
            out += [part] if part in self.special else self.words(part)
        return out

    def learn(self, texts: list[list[str]]) -> None:
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        if not self.known:
            self.known = {t: (str(i), t, 1) for t, i in self.special.items()}
        new = [w for w in dict.fromkeys(w for words in texts for w in words) if w not in self.known]
        for w, ids in zip(new, self.merged(new), strict=True):
            self.known[w] = (" ".join(map(str, ids)), " ".join([self.tokens[i] for i in ids]), len(ids))

    def encode(self, text: str) -> list[int]:
        words = self.split(text)
        self.learn([words])
        return [int(x) for w in words for x in self.known[w][0].split(" ")]

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join(self.tokens[i] for i in ids)


_loaded: dict[str, Tokenizer] = {}


def tokenizer(name: str) -> Tokenizer:
    if name not in _loaded:
        import public_tokenizers

        _loaded[name] = Tokenizer(public_tokenizers.path(name))
    return _loaded[name]


def digests(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", run_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text."""

    def encoded(batches):
        t = tokenizer(vocabulary)

        def flush(ids, texts):
            t.learn(texts)
            known, sha = t.known, hashlib.sha256
            rows = []
            for words in texts:
                got = [known[w] for w in words]
                rows.append((sum([g[2] for g in got]), sha(" ".join([g[0] for g in got]).encode()).hexdigest(), sha(" ".join([g[1] for g in got]).encode()).hexdigest()))
            n, a, b = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        ids, texts, size = [], [], 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py() or ""
                ids.append(doc)
                texts.append(t.split(text))
                size += len(text)
                if size >= run_bytes:
                    yield flush(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield flush(ids, texts)

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), encoded, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
