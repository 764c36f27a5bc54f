"""Word bags as numpy arrays: the units that problems 2 and 4 compare.

A bag is the folded words of a title and a text with repetitions. It becomes a set of *units*,
one per word and occurrence number, so that the overlap of two bags is the Jaccard similarity of
their sets. All functions here work on one Arrow batch at a time, without a loop over words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

WORD = re.compile(r"[^\W_]+")
U = np.uint64


class WordHashes(dict):
    """64-bit hashes of words; emptied when it has grown to ``most`` words."""

    most = 1_000_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose results look random (the splitmix64 finaliser)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@dataclass
class Bags:
    """units: sorted within each record; start: first unit of each record, and the end."""

    words: np.ndarray
    units: np.ndarray
    start: np.ndarray
    text_words: np.ndarray

    @property
    def size(self) -> np.ndarray:
        return np.diff(self.start)

    def identity(self) -> np.ndarray:
        """One 64-bit value per record that depends on nothing but its bag."""
        total = np.concatenate([np.zeros(1, U), np.cumsum(mix(self.units), dtype=U)])
        got = mix(total[self.start[1:]] - total[self.start[:-1]] + self.size.astype(U) * U(0x9E3779B97F4A7C15))
        return got


def bags(titles: list[str | None], texts: list[str | None], known: WordHashes) -> Bags:
    """The bags of a batch; null counts as empty."""
    flat: list[int] = []
    n_all, n_text = np.empty(len(texts), np.int64), np.empty(len(texts), np.int64)
    find, get = WORD.findall, known.__getitem__
    for i, (a, b) in enumerate(zip(titles, texts)):
        body = find(b.lower()) if b else []
        n_text[i] = len(body)
        if a:
            body += find(a.lower())
        n_all[i] = len(body)
        flat.extend(map(get, body))
    h = np.array(flat, dtype=U)
    start = np.concatenate([np.zeros(1, np.int64), np.cumsum(n_all)])
    # 20 bits of record number above 44 bits of hash: one sort orders every record's words
    if len(texts) > 1 << 20:
        raise ValueError("a batch has at most 2**20 records")
    h = (np.repeat(np.arange(len(texts), dtype=U), n_all) << U(44)) | (h >> U(20))
    h.sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    at = np.arange(len(h))
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    words = h & U((1 << 44) - 1)
    return Bags(words, mix(words + (nth.astype(U) << U(44))), start, n_text)


def minima(b: Bags, count: int) -> np.ndarray:
    """(records, count) min-hashes: 32-bit minima of ``count`` fixed random orders of the units.

    Two records agree in one with the probability of their overlap. Empty records get zeros.
    """
    some = np.flatnonzero(b.size > 0)
    out = np.zeros((len(b.size), count), np.uint32)
    if not len(some):
        return out
    x = (b.units >> U(32)).astype(np.uint32)
    at = b.start[:-1][some]
    seeds = mix(np.arange(1, 2 * count + 1, dtype=U) * U(0x9E3779B97F4A7C15))
    mul, xor = (seeds[:count] | U(1)).astype(np.uint32), (seeds[count:] >> U(32)).astype(np.uint32)
    work = np.empty_like(x)
    for j in range(count):
        np.bitwise_xor(x, xor[j], out=work)
        np.multiply(work, mul[j], out=work)
        out[some, j] = np.minimum.reduceat(work, at)
    return out


def folded(columns: np.ndarray, seed: int) -> np.ndarray:
    """One 64-bit value per row of a matrix."""
    h = np.full(len(columns), mix(np.array([seed + 1], U))[0], U)
    for j in range(columns.shape[1]):
        h = mix(h ^ (columns[:, j].astype(U) + U((j + 1) * 0x9E3779B97F4A7C15 % 2**64)))
    return h


class SeenBags:
    """Whether a bag is new to this task: copies in their thousands then cost one row a task.

    A memory of the ``most`` latest; forgetting only lets a copy through, which the next step
    drops anyway.
    """

    most = 500_000

    def __init__(self) -> None:
        self.seen: set[int] = set()

    def first(self, ids: np.ndarray) -> np.ndarray:
        if len(self.seen) > self.most:
            self.seen.clear()
        out = np.zeros(len(ids), bool)
        for i, x in enumerate(ids.tolist()):
            if x not in self.seen:
                self.seen.add(x)
                out[i] = True
        return out


def signed(x: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    return pa.array(x.astype(U, copy=False).view(np.int64), mask=null)


def as_batches(batches: Iterator[pa.RecordBatch], most: int = 2000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most``, so that a batch of long texts stays small."""
    for b in batches:
        for at in range(0, b.num_rows, most):
            yield b.slice(at, most)
