"""Problem 4: near-duplicate records with small edits, by covering locality-sensitive hashing.

A record's fingerprint has BLOCKS blocks of 7 symbols; a symbol is made of DEPTH min-hashes of the
word bag. The 7 masks of a block are the non-zero vectors v of three bits, and mask v keeps the
symbols i = 1..7 with an odd number of ones in i & v: four symbols each. For any two symbols some
mask keeps neither, so two fingerprints that differ in at most two symbols of a block are certain
to collide in one of its tables; that is the covering property (radius 2, seven tables).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lectern.llm.bags import SeenBags, U, WordHashes, as_batches, bags, folded, minima, signed
from lectern.llm.common import bit_array, bit_test, pairs_within
from lectern.session import written

SYMBOLS = 7
BLOCKS = 16
DEPTH = 3
LEAST_WORDS = 20
BITS = 23
#: Bits of a table key. Keys that agree by chance only add candidates, less than one to a bag up to
#: 10**10 bags, and shorter keys make the widest shuffle narrower.
KEY_BITS = 48
MASKS = [[i for i in range(SYMBOLS) if ((i + 1) & v).bit_count() % 2] for v in range(1, SYMBOLS + 1)]


def cover_keys(mins: np.ndarray, blocks: int = BLOCKS, depth: int = DEPTH) -> np.ndarray:
    """(records, 7 * blocks) table keys of the min-hashes (records, 7 * blocks * depth)."""
    out = []
    for b in range(blocks):
        own = mins[:, b * SYMBOLS * depth : (b + 1) * SYMBOLS * depth]
        symbols = np.stack([folded(own[:, i * depth : (i + 1) * depth], i) for i in range(SYMBOLS)], 1)
        out += [folded(symbols[:, mask], 1000 + b * SYMBOLS + v) for v, mask in enumerate(MASKS)]
    return np.stack(out, 1)


def table_rows(records: DataFrame, title: str, text: str, least: int = LEAST_WORDS) -> DataFrame:
    """(k, bag): one row per table and distinct bag, from records with enough words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = WordHashes(), SeenBags()
        for batch in as_batches(batches):
            b = bags(batch.column(0).to_pylist(), batch.column(1).to_pylist(), known)
            ids = b.identity()
            take = np.flatnonzero((b.text_words >= least) & seen.first(ids))
            keys = cover_keys(minima(b, BLOCKS * SYMBOLS * DEPTH)[take])
            yield pa.RecordBatch.from_arrays([signed(keys.ravel() >> U(64 - KEY_BITS)), signed(np.repeat(ids[take], keys.shape[1]))], ["k", "bag"])

    return records.select(F.col(title).alias("_t"), F.col(text).alias("_x")).mapInArrow(rows, "k long, bag long")


def colliding(rows: DataFrame) -> DataFrame:
    """(a, b): distinct pairs of bags, a < b, that share a key.

    Every task that meets a bag gives its rows, so they are made distinct first, where their key
    lies; the self-join sees only keys of two bags or more, a full key in blocks.
    """
    size = F.count("*").over(Window.partitionBy("k"))
    # partitioned by the key alone, which serves the distinct rows and the window as well
    near = written(rows.repartition("k").dropDuplicates(["k", "bag"]).withColumn("n", size).where("n > 1"))
    return pairs_within(near, "k", "bag", F.col("n")).select("a", "b").distinct()


def members(records: DataFrame, key: str, title: str, text: str, wanted: np.ndarray, least: int = LEAST_WORDS, every: bool = False) -> DataFrame:
    """(id, bag, units): every eligible record's bag; its units where the bit filter has the bag.

    Units of equal bags come at least once, and at most once per task while it remembers them.
    With ``every``, records of too few words come too, their bag null.
    """
    kind = records.schema[key].dataType

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = WordHashes(), SeenBags()
        for batch in as_batches(batches):
            b = bags(batch.column(1).to_pylist(), batch.column(2).to_pylist(), known)
            ids = b.identity()
            enough = b.text_words >= least
            take = np.arange(len(ids)) if every else np.flatnonzero(enough)
            want = np.zeros(len(ids), bool)
            some = np.flatnonzero(enough & bit_test(wanted, ids))
            want[some] = seen.first(ids[some])
            ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.where(want[take], b.size[take], 0))])
            flat = b.units[np.repeat(want, b.size)]
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), signed(flat), mask=pa.array(~want[take]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take)), signed(ids[take], ~enough[take]), lists], ["id", "bag", "units"])

    picked = records.where(F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.col(title).alias("_t"), F.col(text).alias("_x"))
    return picked.mapInArrow(rows, f"id {kind.simpleString()}, bag long, units array<long>")


def overlap(x: Column, y: Column) -> Column:
    """Word overlap of two bags by their unit sets."""
    both = F.size(F.array_intersect(x, y))
    return both / (F.size(x) + F.size(y) - both)


def verified(pairs: DataFrame, member: DataFrame, least: float) -> DataFrame:
    """(a, b, overlap) of the pairs of bags whose exact overlap is at least ``least``."""
    units = member.where(F.col("units").isNotNull()).groupBy("bag").agg(F.first("units").alias("units"))
    x = units.select(F.col("bag").alias("a"), F.col("units").alias("x"))
    y = units.select(F.col("bag").alias("b"), F.col("units").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", overlap(F.col("x"), F.col("y")).alias("overlap")).where(F.col("overlap") >= least)


def near_bags(records: DataFrame, key: str = "chunk_id", title: str = "title", text: str = "text", least: float = 0.8, least_words: int = LEAST_WORDS) -> tuple[DataFrame, DataFrame]:
    """Links between distinct bags (a, b, overlap), and each record's bag (id, bag).

    Every pair whose fingerprints are within the radius in some block is found and then held
    against the exact overlap. Null titles and texts are empty bags; records whose text has fewer
    than ``least_words`` words, or without a key, take no part; equal rows count once. Other
    columns are ignored. An empty table gives none.

    The texts never move: the tables hold two longs a row, and only the bags of candidates are
    fetched, in a second pass that a bit filter of fixed size keeps narrow.
    """
    pairs = written(colliding(table_rows(records, title, text, least_words)))
    either = pairs.select("a").union(pairs.select(F.col("b").alias("a")))
    member = written(members(records, key, title, text, bit_array(either, F.col("a"), BITS), least_words))
    return written(verified(pairs, member, least)), member.select("id", "bag").distinct()


def near_pairs(records: DataFrame, key: str = "chunk_id", title: str = "title", text: str = "text", least: float = 0.8, least_words: int = LEAST_WORDS) -> DataFrame:
    """(id_a, id_b): all pairs of records, the smaller key first, that are near-duplicates."""
    links, member = near_bags(records, key, title, text, least, least_words)
    left, right = member.select(F.col("bag").alias("a"), F.col("id").alias("x")), member.select(F.col("bag").alias("b"), F.col("id").alias("y"))
    across = links.join(left, "a").join(right, "b").select("x", "y")
    copies = member.groupBy("bag").agg(F.count("*").alias("n")).where("n > 1")
    same = pairs_within(member.join(copies, "bag"), "bag", "id", F.col("n")).select(F.col("a").alias("x"), F.col("b").alias("y"))
    return across.union(same).where("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, class): the smallest node that each node is linked to, directly or not.

    Each round gives a node the least class of its neighbours and then that class's own class
    (pointer jumping), so the rounds grow with the logarithm of a chain's length. Rounds end when
    nothing changes; each is cut by a written table.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct())
    now = written(nodes.select(F.col("bag").alias("node")).distinct().select("node", F.col("node").alias("class")))
    while True:
        seen = both.join(now.select(F.col("node").alias("b"), "class"), "b").groupBy("a").agg(F.min("class").alias("low"))
        hooked = now.join(seen.withColumnRenamed("a", "node"), "node", "left").select("node", F.col("class").alias("old"), F.least("class", F.coalesce("low", "class")).alias("class"))
        jump = hooked.select(F.col("node").alias("class"), F.col("class").alias("up"))
        step = written(hooked.join(jump, "class", "left").select("node", "old", F.least("class", F.coalesce("up", "class")).alias("class")))
        now = step.select("node", "class")
        if step.where("old <> class").isEmpty():
            return now


def near_groups(records: DataFrame, key: str = "chunk_id", title: str = "title", text: str = "text", least: float = 0.8) -> DataFrame:
    """One row per eligible record: (key, class_id, n_links, n_copies).

    class_id is the smallest key of its group, n_links the number of different bags it is linked
    to, n_copies the number of other records with exactly its bag. No group is ever gathered.
    """
    links, member = near_bags(records, key, title, text, least)
    member = written(member)
    linked = links.select("a").union(links.select(F.col("b").alias("a"))).groupBy("a").agg(F.count("*").alias("n_links"))
    classes = components(links, linked.select(F.col("a").alias("bag")))
    per_bag = member.groupBy("bag").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    per_bag = written(per_bag.join(classes.withColumnRenamed("node", "bag"), "bag", "left").join(linked.withColumnRenamed("a", "bag"), "bag", "left").withColumn("class", F.coalesce("class", "bag")))
    names = per_bag.groupBy("class").agg(F.min("low").alias("class_id"))
    out = per_bag.join(names, "class").select("bag", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (F.col("n") - 1).alias("n_copies"))
    return member.join(out, "bag").select(F.col("id").alias(key), "class_id", "n_links", "n_copies")
