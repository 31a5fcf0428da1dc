"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

The six blanks and A-Z are single bytes in UTF-8 that no other character contains, so splitting into
words and lower-casing A-Z work on bytes. A sequence's hash is the sum of its parts' mixed values, each
mixed with its place; a word's parts are eight bytes each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix64's finalizer)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def pieces(column: pa.Array, most: int = 512 << 10):
    """(first row, texts as bytes) of runs of rows with about ``most`` bytes, or one longer text."""
    run, first, size = [], 0, 0
    for i, x in enumerate(column):
        b = x.as_buffer() if x.is_valid else b""
        n = len(b) if isinstance(b, bytes) else b.size
        if run and size + n > most:
            yield first, run
            run, first, size = [], i, 0
        run.append(b)
        size += n
    if run:
        yield first, run


def padded(texts: list, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, each after a blank and with one at the end, and where each text begins."""
    sizes = np.array([len(t) if isinstance(t, bytes) else t.size for t in texts], np.int64)
    at = np.cumsum(sizes + 1) - sizes
    data = np.full(int(sizes.sum()) + len(texts) + 1, 32, np.uint8)
    for t, a, n in zip(texts, at, sizes, strict=True):
        if n:
            data[a : a + n] = np.frombuffer(t, np.uint8)
    if lower:
        data[(data >= 65) & (data <= 90)] += 32
    return data, at


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the words in padded bytes."""
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    return edge[::2], edge[1::2]


def sum_of_parts(parts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A hash of each run of ``counts`` parts, one after another in ``parts``; no run is empty."""
    first = np.cumsum(counts) - counts
    with np.errstate(over="ignore"):
        place = (np.arange(len(parts)) - np.repeat(first, counts) + 1).astype(U)
        return mix(np.add.reduceat(mix(mix(parts) + place * U(0x9E3779B97F4A7C15)), first) + counts.astype(U))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, U)
    held = np.append(data, np.zeros(8, np.uint8))
    eight = np.ndarray(len(data), "<u8", held, strides=(1,))  # the eight bytes from each place on
    sizes = ends - starts
    counts = (sizes + 7) >> 3
    first = np.cumsum(counts) - counts
    offset = (np.arange(int(counts.sum())) - np.repeat(first, counts)) << 3
    left = np.minimum(np.repeat(sizes, counts) - offset, 8)
    mask = np.append(U(0), U(2**64 - 1) >> (U(8) * (U(8) - np.arange(1, 9, dtype=U))))
    with np.errstate(over="ignore"):
        # the size goes in, since a word can end with zero bytes
        return mix(sum_of_parts(eight[np.repeat(starts, counts) + offset] & mask[left], counts) + sizes.astype(U))


def text_of_word(starts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The index of the text that each word belongs to."""
    return np.searchsorted(at, starts, "right") - 1


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k word hashes."""
    n = len(h) - k + 1
    with np.errstate(over="ignore"):
        out = np.zeros(n, U)
        for j in range(k):
            out = out * U(0xD6E8FEB86659FD93) + h[j : j + n]
        return mix(out)
