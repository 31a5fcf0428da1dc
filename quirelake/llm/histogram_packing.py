"""Shortest-pack-first packing over the histogram of lengths, with no padding left.

Documents longer than a sequence give full pieces first; the rest of each is one piece of less than the
capacity. Only the histogram of lengths, at most ``capacity`` numbers, is needed to plan: lengths are
placed longest first, each on the shortest pack that is open (the one with the most room), and on new
packs where none has room. Packs that hold the same lengths are one pattern with a count; a placement
changes a pattern's count and makes a new one, so the plan's size depends on the capacity alone.

As documents may be cut, the room that this leaves is filled: the shortest packs are dissolved, as few
as hold what all others have room for, and their documents, laid end to end, flow into the rooms of the
others in order. What remains flows into whole sequences, and the rest of the corpus, less than one
sequence, into sequences of the powers of two that it is the sum of. So nothing is padded, and all but
the dissolved documents stay whole.

Patterns meet documents by rank: tokenizing numbers the pieces of a length within each task, the counts
per task and length, summed up over the tasks before, give the first number of each task, and a
document's length and rank tell its pattern, sequence and offset. Dissolved documents find their cuts by
arithmetic on running totals, so no sequence is ever listed.

Defined results: null text is empty, and an empty document is one piece that holds the end id alone.
Repeated rows, rows that share a doc_id, and rows without one are packed each; ties in length go by
task and place. Texts of any length are tokenized whole. Extra columns are ignored, whatever their
names. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, sized, staged
from .packing import encoder

CAPACITY = 2048


@dataclass
class Pattern:
    """``count`` sequences that hold ``items``, each (length, first rank, offset), ``fill`` ids together."""

    count: int
    fill: int
    items: tuple[tuple[int, int, int], ...]


def patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Shortest-pack-first: the longest lengths first, each on the pack with the most room."""
    open_packs: list[tuple[int, int, Pattern]] = []  # fill, number, pattern: the shortest first
    made = 0
    for n in sorted((n for n, c in counts.items() if c), reverse=True):
        left, rank = counts[n], 0
        while left:
            if open_packs and open_packs[0][0] + n <= capacity:
                fill, _, p = heapq.heappop(open_packs)
                take = min(left, p.count)
                if take < p.count:  # the others of the pattern keep their room
                    later = tuple((m, first + take, at) for m, first, at in p.items)
                    heapq.heappush(open_packs, (fill, made := made + 1, Pattern(p.count - take, fill, later)))
                p = Pattern(take, fill + n, (*p.items, (n, rank, fill)))
            else:  # no other pack has room, so a new one takes pieces of this length until it has none
                each = min(capacity // n, left)
                take = left // each
                p = Pattern(take, n * each, tuple((n, rank + take * k, n * k) for k in range(each)))
                take *= each
            left, rank = left - take, rank + take
            heapq.heappush(open_packs, (p.fill, made := made + 1, p))
    return [p for _, _, p in sorted(open_packs, key=lambda x: x[:2])]


@dataclass
class Plan:
    """Whole pieces by (length, first rank): sequence and offset, and for dissolved ones (sequence -1) the
    offset in the stream. Rooms, in the stream's order: first stream offset, size, sequence, offset."""

    length: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    room_start: np.ndarray
    room_size: np.ndarray
    room_sequence: np.ndarray
    room_offset: np.ndarray
    sequences: int

    def runs(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the run of each piece, its place in the run)."""
        keys = np.array(list(zip(self.length, self.first, strict=True)), dtype=[("l", "i8"), ("f", "i8")])
        want = np.empty(len(length), keys.dtype)
        want["l"], want["f"] = length, rank
        run = np.searchsorted(keys, want, "right") - 1
        return run, rank - self.first[run]

    def cuts(self, start: int, length: int) -> list[tuple[int, int, int, int]]:
        """(start in the piece, length, sequence, offset) of the parts of a piece at ``start`` in the stream."""
        out, at, end = [], start, start + length
        run = int(np.searchsorted(self.room_start, start, "right")) - 1
        while at < end:
            while run + 1 < len(self.room_start) and self.room_start[run + 1] <= at:
                run += 1
            size = int(self.room_size[run])
            room, inside = divmod(at - int(self.room_start[run]), size)
            n = min(size - inside, end - at)
            out.append((at - start, n, int(self.room_sequence[run]) + room, int(self.room_offset[run]) + inside))
            at += n
        return out


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    found = sorted(patterns(counts, capacity), key=lambda p: p.fill)
    room = sum(p.count * (capacity - p.fill) for p in found)
    held = 0  # ids in dissolved packs
    kept: list[Pattern] = []
    dissolved: list[Pattern] = []
    for p in found:
        # A dissolved pack's ids join the stream and its own room is no more: each closes `capacity` ids of the difference.
        take = min(p.count, max(0, -(-(room - held) // capacity))) if p.fill < capacity else 0
        held, room = held + take * p.fill, room - take * (capacity - p.fill)
        if take:
            dissolved.append(Pattern(take, p.fill, p.items))
        if take < p.count:
            kept.append(Pattern(p.count - take, p.fill, tuple((n, first + take, at) for n, first, at in p.items)))
    runs: list[tuple[int, int, int, int]] = []
    rooms: list[tuple[int, int, int, int]] = []  # stream offset, size, sequence, offset
    total = stream = poured = 0
    for p in kept:
        runs += [(n, first, total, at) for n, first, at in p.items]
        if p.fill < capacity:
            rooms.append((poured, capacity - p.fill, total, p.fill))
            poured += p.count * (capacity - p.fill)
        total += p.count
    for p in dissolved:
        for n, first, _ in p.items:
            runs.append((n, first, -1, stream))
            stream += p.count * n
    rest = stream - poured
    sizes = [(capacity, rest // capacity)] + [(1 << k, 1) for k in reversed(range(capacity.bit_length())) if rest % capacity >> k & 1]
    for size, count in sizes:
        if count:
            rooms.append((poured, size, total, 0))
            poured, total = poured + size * count, total + count
    runs.sort()
    cols = [np.array(c, np.int64) for c in (*zip(*runs, strict=True),)] if runs else [np.zeros(0, np.int64)] * 4
    gaps = [np.array(c, np.int64) for c in (*zip(*rooms, strict=True),)] if rooms else [np.zeros(0, np.int64)] * 4
    return Plan(*cols, *gaps, total)


#: Bits of a row's number within the task that tokenizes it.
ROW_BITS = 40
PIECE = "task int, row long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, rank long, ids binary"


def pieces(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Each document's full pieces and its rest, which carries its ids (it may be cut), numbered by length."""

    def tokenized(batches):
        enc, task = encoder(vocabulary), TaskContext.get().partitionId()
        seen, row = np.zeros(capacity + 1, np.int64), task << ROW_BITS
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.append(enc.encode_to_numpy(text.as_py() or "", allowed_special="all"), end_id).astype("<u4")
                for s in range(0, len(ids), capacity):
                    part = ids[s : s + capacity]
                    raw, n = part.tobytes(), len(part)
                    rows.append((task, row, doc, s, n, zlib.crc32(raw), len(ids), int(seen[n]), raw if n < capacity else None))
                    seen[n] += 1
                    row += 1
            yield pa.RecordBatch.from_pylist([dict(zip(SCHEMA.names, r, strict=True)) for r in rows], SCHEMA)

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), tokenized, PIECE)


SCHEMA = pa.schema([("task", pa.int32()), *((c, pa.int64()) for c in ("row", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank")), ("ids", pa.binary())])
RESULT = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
PLACED = pa.schema([(c, pa.int64()) for c in RESULT])


def pack(cut_up: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The places of ``cut_up`` (staged pieces), some cut further."""
    spark = cut_up.sparkSession
    counted = cut_up.groupBy("task", "length").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    firsts = staged(counted.select("task", "length", F.coalesce(before, F.lit(0)).alias("first"), "count"), "ranks")
    counts = {r["length"]: r["n"] for r in firsts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    found = plan(counts, capacity)
    sent = spark.sparkContext.broadcast(found)
    ranked = cut_up.drop("ids").join(sized(firsts.drop("count")), ["task", "length"])

    def placed(batches):
        p = sent.value
        for b in batches:
            n, rank = (b.column(c).to_numpy() for c in ("length", "rank"))
            run, at = p.runs(n, rank + b.column("first").to_numpy()) if len(n) else (n, n)
            seq, off = p.sequence[run], p.offset[run]
            whole = seq >= 0
            seq, off = np.where(whole, seq + at, -1), np.where(whole, off, off + at * n)
            columns = [b.column("row"), *(b.column(c) for c in RESULT[:5]), pa.array(seq), pa.array(off)]
            yield pa.RecordBatch.from_arrays(columns, ["row", *RESULT])

    longs = ", ".join(f"{c} long" for c in ["row", *RESULT])
    at = staged(arrow_map(ranked, placed, longs), "places")
    cut_lengths = sorted({int(n) for n, s in zip(found.length, found.sequence, strict=True) if s < 0})
    apart = at.filter("sequence_id < 0").select("row", F.col("offset").alias("stream"))
    ids = cut_up.filter(F.col("length").isin(cut_lengths)).select("row", "doc_id", "start", "doc_tokens", "ids")

    def cut(batches):
        p = sent.value
        for b in batches:
            rows = []
            for r in b.to_pylist():
                ids = np.frombuffer(r["ids"], "<u4")
                for s, n, seq, off in p.cuts(r["stream"], len(ids)):
                    rows.append((r["doc_id"], r["start"] + s, n, zlib.crc32(ids[s : s + n].tobytes()), r["doc_tokens"], seq, off))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [()] * 7)], PLACED.names)

    whole = at.filter("sequence_id >= 0").select(*RESULT)
    if not cut_lengths:
        return whole
    return whole.union(arrow_map(ids.join(sized(apart), "row"), cut, ", ".join(f"{c} long" for c in RESULT)))


def pack_documents(docs: DataFrame, **settings) -> DataFrame:
    return pack(staged(pieces(docs, **settings), "pieces"), settings.get("capacity", CAPACITY))
