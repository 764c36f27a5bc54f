"""Problem 7: evaluation passages inside a training corpus, by size-partitioned min-hash containment.

Items are partitioned by size: an item of up to L words, L being a power of two, meets windows of
L words of the documents, so that the two sets of SHINGLE-word shingles are of like size and a short item
isn't lost in a long document. Windows overlap by half. Each size has as many min-hashes as it
takes for a shared run of ``run`` words to give one in common but for a chance of MISS; bands are
of one row, since a run may be a small part of its item. Items of more than LARGEST words are taken
in parts that overlap by a run.

Candidates are then verified: document and item must share whole runs of ``run`` words, found by
the min-hash of their shingles of RUN_SHINGLE words and compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.bags import WORD, U, WordHashes, as_batches, mix, signed
from lectern.llm.common import bit_array, bit_test
from lectern.session import spread, written

RUN = 13
SHINGLE = 5
RUN_SHINGLE = 8
SMALLEST, LARGEST = 16, 64
MISS = 1e-4
BITS = 22
KEY_BITS = 24


def size_of(words: int) -> int:
    """The size class of an item: its number of words as a power of two, within bounds."""
    return min(LARGEST, max(SMALLEST, 1 << max(words - 1, 0).bit_length()))


def hashes_for(size: int, run: int = RUN) -> int:
    """Min-hashes for a size: the shingles of a run are at least that share of an item's and a window's."""
    own = run - SHINGLE + 1
    return int(np.ceil(np.log(MISS) / np.log1p(-own / max(2 * size - own, own + 1))))


def _shingles(h: np.ndarray, start: np.ndarray) -> np.ndarray:
    """32-bit values of the shingles that start at each word, or, where none does, of the text's last."""
    n = len(h)
    s = np.zeros(n, U)
    if n >= SHINGLE:
        m = n - SHINGLE + 1
        for j in range(SHINGLE):
            s[:m] = mix(s[:m] ^ (h[j : m + j] + U(j + 1)))
    last = np.repeat(start[1:], np.diff(start)) - SHINGLE
    return (s >> U(32)).astype(np.uint32)[np.minimum(np.arange(n), last)]


def _signatures(x: np.ndarray, cuts: np.ndarray, size: int, count: int) -> Iterator[np.ndarray]:
    """One 64-bit key per block of shingles and min-hash; blocks start at ``cuts``."""
    seeds = mix(np.arange(1, 2 * count + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(size))
    mul, xor = (seeds[:count] | U(1)).astype(np.uint32), (seeds[count:] >> U(32)).astype(np.uint32)
    y = np.empty_like(x)
    for i in range(count):
        np.bitwise_xor(x, xor[i], out=y)
        np.multiply(y, mul[i], out=y)
        yield np.minimum.reduceat(y, cuts)


def _keys(low: np.ndarray, size: int, i: int) -> np.ndarray:
    return mix(low.astype(U) | (U(size * 4096 + i) << U(32)))


def sized_keys(texts: DataFrame, sizes: list[int], run: int, items: bool, wanted: np.ndarray | None = None) -> DataFrame:
    """(id, k): the min-hash keys of items in their own size, or of documents' windows of all ``sizes``.

    A window of a document is two neighbouring blocks of half its size. With a bit filter only keys
    that may be in it are given.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        get = known.__getitem__
        for batch in as_batches(batches, 500):
            split = [WORD.findall(t.lower()) if t else [] for t in batch.column(1).to_pylist()]
            own = np.arange(len(split))
            if items:
                step = LARGEST - run + 1
                parts = [(i, ws[a : a + LARGEST]) for i, ws in enumerate(split) for a in range(0, max(1, len(ws) - run + 1), step)]
                own, split = np.array([i for i, _ in parts], np.int64), [ws for _, ws in parts]
            n = np.array([len(ws) for ws in split], np.int64)
            some = np.flatnonzero(n >= run)
            own, n, split = own[some], n[some], [split[i] for i in some]
            if not len(some):
                continue
            start = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
            x = _shingles(np.array([get(w) for ws in split for w in ws], dtype=U), start)
            kind = np.array([size_of(int(m)) for m in n])
            for size in sizes:
                if items:
                    pick = np.flatnonzero(kind == size)
                    if not len(pick):
                        continue
                    at = np.repeat(np.isin(np.arange(len(n)), pick), n)
                    cuts, of, part = np.concatenate([[0], np.cumsum(n[pick])[:-1]]), own[pick], x[at]
                else:
                    blocks = -(-n // (size // 2))
                    of = np.repeat(np.arange(len(n)), blocks)
                    nth = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                    cuts, part = start[:-1][of] + nth * (size // 2), x
                    more = np.append(of[1:] == of[:-1], False)
                for i, low in enumerate(_signatures(part, cuts, size, hashes_for(size, run))):
                    if not items:
                        low[:-1] = np.where(more[:-1], np.minimum(low[:-1], low[1:]), low[:-1])
                    k = _keys(low, size, i)
                    ok = np.flatnonzero(bit_test(wanted, k)) if wanted is not None else np.arange(len(k))
                    if len(ok):
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of[ok] if items else own[of[ok]])), signed(k[ok])], ["id", "k"])

    kind = texts.schema["_k"].dataType.simpleString()
    return texts.mapInArrow(rows, f"id {kind}, k long")


def candidates(docs: DataFrame, items: DataFrame, run: int = RUN) -> DataFrame:
    """(d, i): documents and items that have a min-hash of some window in common."""
    counts = F.size(F.regexp_extract_all(F.lower("_x"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    sizes = sorted({size_of(r.n) for r in items.where("_x is not null").select(F.least(counts, F.lit(LARGEST)).alias("n")).distinct().collect()})
    # the last part of a long item may be of any smaller size
    sizes = sizes if LARGEST not in sizes else [s for s in (1 << b for b in range(20)) if SMALLEST <= s <= LARGEST]
    own = written(sized_keys(items, sizes, run, True).distinct())
    wanted = bit_array(own, F.col("k"), KEY_BITS)
    hits = sized_keys(docs, sizes, run, False, wanted).distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(8)).cast("int"))
    every = own.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(7))))
    both = hits.alias("d").join(every.alias("i"), (F.col("d.k") == F.col("i.k")) & (F.col("d.salt") == F.col("i.salt")))
    return both.select(F.col("d.id").alias("d"), F.col("i.id").alias("i")).distinct()


def window_minima(h: np.ndarray, start: np.ndarray, run: int, shingle: int = RUN_SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(first word, min-hash) of every window of ``run`` words that stays within its text.

    h: word hashes of a batch, text after text; start: the first word of each text, and the end.
    """
    n, wide = len(h), run - shingle + 1
    if n < run:
        return np.zeros(0, np.int64), np.zeros(0, U)
    s = np.zeros(n - shingle + 1, U)
    for j in range(shingle):
        s = mix(s ^ (h[j : n - shingle + 1 + j] + U(j + 1)))
    low = s[: n - run + 1].copy()
    for j in range(1, wide):
        np.minimum(low, s[j : n - run + 1 + j], out=low)
    of = np.repeat(np.arange(len(start) - 1), np.diff(start))
    at = np.flatnonzero(of[: n - run + 1] == of[run - 1 :])
    return at, low[at]


def _windows(texts: DataFrame, run: int, wanted: np.ndarray | None) -> DataFrame:
    """(id, m, words): the windows' min-hashes; words holds the whole run, joined by spaces.

    With a bit filter only windows whose min-hash may be in it are given; equal neighbouring
    min-hashes of one text come once without words and as often as they occur with them.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        get = known.__getitem__
        for batch in as_batches(batches, 1000):
            split = [WORD.findall(t.lower()) if t else [] for t in batch.column(1).to_pylist()]
            flat = [w for ws in split for w in ws]
            start = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(ws) for ws in split])]).astype(np.int64)
            at, low = window_minima(np.array(list(map(get, flat)), dtype=U), start, run)
            if wanted is not None:
                ok = bit_test(wanted, low)
                at, low = at[ok], low[ok]
            of = np.searchsorted(start, at, side="right") - 1
            runs = pa.array([" ".join(flat[i : i + run]) for i in at.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), signed(low), runs], ["id", "m", "words"])

    kind = texts.schema["_k"].dataType.simpleString()
    return texts.mapInArrow(rows, f"id {kind}, m long, words string")


def leaks(corpus: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", run: int = RUN) -> DataFrame:
    """(doc, item, n_runs, item_runs, containment): the documents that contain parts of items.

    A document contains part of an item if they share ``run`` consecutive folded words; n_runs is
    the number of different runs they share, item_runs that of the item, containment the ratio.
    Null texts and texts shorter than a run share nothing; rows without key are left out; equal
    rows count once. Other columns are ignored; empty tables give no rows.

    Candidates come from min-hashes of like-sized windows and are missed with a chance of at most
    MISS; what they share is then counted exactly. Of the corpus only keys and runs that may be one of an item's
    leave the scan. A key or run that many documents share is joined with the items that have it,
    salted by document.
    """
    its = items.where(F.col(item).isNotNull()).select(F.col(item).alias("_k"), F.col(item_text).alias("_x"))
    own = _windows(its, run, None)
    wanted = bit_array(own, F.col("m"), BITS)
    docs = spread(corpus.where(F.col(doc).isNotNull()).select(F.col(doc).alias("_k"), F.col(text).alias("_x")))
    likely = candidates(docs, its, run)
    hits = _windows(docs, run, wanted).distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(8)).cast("int"))
    runs = own.distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(7))))
    both = hits.alias("d").join(runs.alias("i"), (F.col("d.m") == F.col("i.m")) & (F.col("d.salt") == F.col("i.salt")) & (F.col("d.words") == F.col("i.words")))
    shared = both.groupBy(F.col("d.id").alias("d"), F.col("i.id").alias("i")).agg(F.count("*").alias("n_runs")).join(likely, ["d", "i"], "left_semi")
    size = own.select("id", "words").distinct().groupBy("id").agg(F.count("*").alias("item_runs"))
    out = shared.join(size, F.col("i") == size["id"])
    return out.select(F.col("d").alias(doc), F.col("i").alias(item), "n_runs", "item_runs", (F.col("n_runs") / F.col("item_runs")).alias("containment"))
