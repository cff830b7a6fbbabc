"""Whole batches of texts as numpy arrays: words, their hashes, and hashes of word windows.

Everything here works on the UTF-8 bytes of an Arrow column, many texts at a time, so that no
Python object is made per word.  A word is a run of bytes other than space and ``\\t..\\r``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text handled at once; a longer text is one piece of its own.
PIECE_BYTES = 1 << 20

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits (the splitmix64 finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def seeded(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U64) + U64(seed) * U64(0x10001)) * U64(0x9E3779B97F4A7C15))


def powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse."""
    base = int(seeded(1, seed)[0]) | 1

    def run(b: int) -> np.ndarray:
        out = np.full(n, b, U64)
        out[:1] = 1
        return np.multiply.accumulate(out)

    return run(base), run(pow(base, -1, 1 << 64))


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of ``values[start:end]`` for every span, in one pass over the values."""
    up, down = powers(seed, len(values) + 1)
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0x2545F4914F6CDD1D))


@dataclass
class Words:
    """The words of several texts, one after another.

    ``first[i]:first[i + 1]`` are the words of text ``i``; ``starts`` and ``ends`` are byte
    positions in ``data``; ``hashes`` has 64 bits a word.
    """

    data: np.ndarray
    text_at: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def owner(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the limits of its texts; NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, limits, data = column.buffers()
    n = len(column)
    at = np.frombuffer(limits, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def find_words(column: pa.Array, lower: bool = False, hashed: bool = True) -> Words:
    data, at = text_buffers(column)
    if lower:
        data = _LOWER[data]
    n = len(data)
    inside = np.zeros(n + 2, bool)
    np.logical_not(_BLANK[data], out=inside[1:-1])
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    first = np.searchsorted(starts, at)
    hashes = _word_hashes(data, starts, ends) if hashed else np.zeros(0, U64)
    return Words(data, at, starts, ends, first, hashes)


#: Longer words are hashed one by one.
_LONG = 64
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], U64)


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Eight bytes a step, each step over all words that still have bytes left."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    size = ends - starts
    out = mix(eights[starts] & _KEEP[np.minimum(size, 8)]) + size.astype(U64)
    left, done = np.flatnonzero(size > 8), 8
    while done < _LONG and len(left):
        more = eights[starts[left] + done] & _KEEP[np.minimum(size[left] - done, 8)]
        out[left] = mix(out[left] * U64(0x9E3779B97F4A7C15) + mix(more ^ U64(done)))
        done += 8
        left = left[size[left] > done]
    for i in left:
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
        out[i] = np.frombuffer(digest, "<u8")[0]
    return out


def windows(words: Words, size: int, seed: int = 21) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each run of ``size`` words within one text, and the word it starts at."""
    n = len(words.hashes)
    if n < size:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    last = np.repeat(words.first[1:], words.counts)
    at = np.flatnonzero(np.arange(n) + size <= last)
    return spans_hash(words.hashes, at, at + size, seed), at


def shingles(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes and the text of each; a text of fewer words is one shingle of all its words."""
    hashes, at = windows(words, size)
    owner = np.searchsorted(words.first, at, side="right") - 1
    few = np.flatnonzero((words.counts > 0) & (words.counts < size))
    if len(few):
        extra = spans_hash(words.hashes, words.first[few], words.first[few + 1], 21)
        hashes, owner = np.concatenate([hashes, extra]), np.concatenate([owner, few])
        order = np.argsort(owner, kind="stable")
        hashes, owner = hashes[order], owner[order]
    return hashes, owner


def pieces(batches: Iterator[pa.RecordBatch], column: str | int = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches again, cut so that each piece holds about ``limit`` bytes of text."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        _, at = text_buffers(batch.column(column))
        lo = 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
            hi = min(hi, lo + 20_000, n)
            yield batch.slice(lo, hi - lo)
            lo = hi


def sums(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sum of ``values`` for each of ``n`` owners."""
    return np.bincount(owner, weights=values, minlength=n)
