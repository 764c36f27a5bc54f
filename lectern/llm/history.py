"""Problem 2: deduplicating new batches against all history, with a table of pivot distances.

The metric is the number of words in which two bags differ, d(A, B) = |A| + |B| - 2 |A and B|; an
overlap of at least t means d(A, B) <= (1 - t) / (1 + t) (|A| + |B|). The words fall into CLASSES
classes by hash, and d is the sum of its parts over the classes. In each class the pivot is the
empty bag, so the distance to pivot j is the number of words in class j, and by the triangle
inequality the differences of pivot distances, summed over the classes, never exceed d. The
table keeps these distances, four bits each (capping them keeps the inequality), with the size of
the bag, the distance to the pivot that is empty in all classes.

Pivot distances alone can't find the partners: within the radius of an overlap of 0.8 lie about
half of all bags in each single pivot distance, and a join over ranges would keep a fixed share
of all pairs. So the join over size ranges also needs equality in one of TABLES keys, each of
DEPTH min-hashes, and the pivot distances prune what it finds before any bag is fetched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.bags import Bags, SeenBags, U, WordHashes, as_batches, bags, folded, minima, mix, signed
from lectern.llm.common import bit_array, bit_test
from lectern.llm.nearcopies import LEAST_WORDS, members, verified
from lectern.operators.snapshots import Snapshots, with_folders
from lectern.session import written

CLASSES = 32
TABLES = 30
DEPTH = 7
KEY_BITS = 24
BAG_BITS = 23
ROW = "k long, bag long, n int, p0 long, p1 long"


def pivot_distances(b: Bags) -> np.ndarray:
    """(records, 2): the distances to the CLASSES pivots, 16 of four bits in each value."""
    of = np.repeat(np.arange(len(b.size)), b.size) * CLASSES + (b.words & U(CLASSES - 1)).astype(np.int64)
    counts = np.minimum(np.bincount(of, minlength=len(b.size) * CLASSES), 15).reshape(-1, 2, CLASSES // 2).astype(U)
    return (counts << (U(4) * np.arange(CLASSES // 2, dtype=U))).sum(axis=2, dtype=U)


def pivot_gap(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Sum of the differences of pivot distances: a lower bound of the metric."""
    total = F.lit(0)
    for x, y in zip(a, b):
        for j in range(CLASSES // 2):
            part = [F.shiftrightunsigned(v, 4 * j).bitwiseAND(F.lit(15)) for v in (x, y)]
            total = total + F.abs(part[0] - part[1])
    return total


def pivot_rows(records: DataFrame, title: str, text: str, least: float, least_words: int, probe: bool, wanted: np.ndarray | None = None) -> DataFrame:
    """The pivot table's rows: (k, bag, n, p0, p1), TABLES per distinct bag.

    k joins a min-hash key with the range of the bag's size. Ranges grow by 1 / least, so that
    partners lie in the same or a neighbouring one; rows of a ``probe`` name all three. With a
    bit filter only rows whose k may be in it are made.
    """
    width = -np.log(least)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = WordHashes(), SeenBags()
        for batch in as_batches(batches):
            b = bags(batch.column(0).to_pylist(), batch.column(1).to_pylist(), known)
            ids = b.identity()
            take = np.flatnonzero((b.text_words >= least_words) & seen.first(ids))
            mins, n, pivots = minima(b, TABLES * DEPTH)[take], b.size[take], pivot_distances(b)[take]
            band = np.floor(np.log(np.maximum(n, 1)) / width + 1e-9).astype(np.int64)
            keys = np.stack([folded(mins[:, t * DEPTH : (t + 1) * DEPTH], t) for t in range(TABLES)], 1)
            for step in (-1, 0, 1) if probe else (0,):
                k = mix(keys ^ ((band + step + 2).astype(U) * U(0xD6E8FEB86659FD93))[:, None]).ravel()
                of = np.repeat(np.arange(len(take)), TABLES)
                if wanted is not None:
                    ok = bit_test(wanted, k)
                    k, of = k[ok], of[ok]
                yield pa.RecordBatch.from_arrays([signed(k), signed(ids[take][of]), pa.array(n[of].astype(np.int32)), signed(pivots[of, 0]), signed(pivots[of, 1])], ["k", "bag", "n", "p0", "p1"])

    return records.select(F.col(title).alias("_t"), F.col(text).alias("_x")).mapInArrow(rows, ROW)


def candidates(table: DataFrame, probes: DataFrame, least: float) -> DataFrame:
    """(a, b): distinct pairs of bags, a < b, that share a key and that no pivot rules out."""
    t, p = table.alias("t"), probes.alias("p")
    reach = (1 - least) / (1 + least)
    ok = (F.col("t.bag") != F.col("p.bag")) & (F.abs(F.col("t.n") - F.col("p.n")) <= reach * (F.col("t.n") + F.col("p.n")) + 1e-6)
    gap = pivot_gap((F.col("t.p0"), F.col("t.p1")), (F.col("p.p0"), F.col("p.p1"))) <= reach * (F.col("t.n") + F.col("p.n")) + 1e-6
    found = t.join(p, (F.col("t.k") == F.col("p.k")) & ok & gap)
    return found.select(F.least("t.bag", "p.bag").alias("a"), F.greatest("t.bag", "p.bag").alias("b")).distinct()


def resolve(rows: DataFrame, links: DataFrame) -> DataFrame:
    """(o,) of the rows that a pass in the order ``o`` would refuse.

    rows: (o, cid, bag), both nullable; links: (a, b) between bags. A row is refused if a row
    accepted before it has its cid, its bag or a linked bag. Each round settles every row that
    has no unsettled row before it in its cid, its bag and the linked bags; the least unsettled
    row is always among them. Rounds work on minima per cid and per bag, so a group of any size
    is pre-aggregated and never paired with itself.
    """
    both = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    none = F.lit(None).cast("boolean")
    now = written(rows.select("o", "cid", "bag", none.alias("kept")))
    while True:
        held, open_ = F.min(F.when(F.col("kept"), F.col("o"))), F.min(F.when(F.col("kept").isNull(), F.col("o")))
        by_cid = now.where("cid is not null").groupBy("cid").agg(held.alias("ca"), open_.alias("cu"))
        by_bag = now.where("bag is not null").groupBy("bag").agg(held.alias("ba"), open_.alias("bu"))
        across = both.join(by_bag.withColumnRenamed("bag", "b"), "b").select(F.col("a").alias("bag"), "ba", "bu")
        by_bag = by_bag.unionByName(across).groupBy("bag").agg(F.min("ba").alias("ba"), F.min("bu").alias("bu"))
        o = F.col("o")
        refused = F.coalesce(F.col("ca") < o, F.lit(False)) | F.coalesce(F.col("ba") < o, F.lit(False))
        first = F.coalesce(F.col("cu") >= o, F.lit(True)) & F.coalesce(F.col("bu") >= o, F.lit(True))
        settled = F.when(F.col("kept").isNotNull(), F.col("kept")).when(refused, False).when(first, True)
        now = written(now.join(by_cid, "cid", "left").join(by_bag, "bag", "left").select("o", "cid", "bag", settled.alias("kept")))
        if now.where("kept is null").isEmpty():
            return now.where("not kept").select("o")


def repeats(history: DataFrame, batches: DataFrame, key: str = "chunk_id", title: str = "title", text: str = "text", order: tuple[str, str] = ("batch_id", "row_id"), least: float = 0.8, least_words: int = LEAST_WORDS) -> DataFrame:
    """The ``order`` columns of the batch rows that repeat something held when their turn comes.

    History is held at the start; batch rows come in ``order`` and are held from then on unless
    refused. A row is refused if its key equals that of a held row, or its word overlap with one
    is at least ``least``, both texts having ``least_words`` words or more. Null keys equal
    nothing; null titles and texts are empty. Equal rows count in their order: the first may be
    accepted, the rest never. Empty tables are fine; other columns are ignored.

    History is read for its pivot rows and, in a second pass, for the bags of the candidates. It
    is never joined with itself: only keys of the batch rows, held in a bit filter of fixed size,
    reach the join.
    """
    probes = written(pivot_rows(batches, title, text, least, least_words, probe=True))
    wanted = bit_array(probes, F.col("k"), KEY_BITS)
    table = pivot_rows(history.select(title, text).unionByName(batches.select(title, text)), title, text, least, least_words, probe=False, wanted=wanted)
    pairs = written(candidates(table, probes, least))
    keep = bit_array(pairs.select("a").union(pairs.select(F.col("b").alias("a"))), F.col("a"), BAG_BITS)

    # a null key is no key, but its bag is held; of the held rows only bags and units are used
    held = history.select(F.lit("").alias("_id"), F.col(title).alias("_t"), F.col(text).alias("_x"))
    old = written(members(held, "_id", "_t", "_x", keep, least_words))
    new = written(members(_row(batches, key, title, text, order), "_id", "_t", "_x", keep, least_words, every=True))
    return _judged(new, old, history.select(F.col(key).alias("cid")), pairs, order, least)


def _row(batches: DataFrame, key: str, title: str, text: str, order: tuple[str, str]) -> DataFrame:
    return batches.select(F.struct(*order, F.col(key).alias("cid")).alias("_id"), F.col(title).alias("_t"), F.col(text).alias("_x"))


def _judged(new: DataFrame, old: DataFrame, keys: DataFrame, pairs: DataFrame, order: tuple[str, str], least: float) -> DataFrame:
    """The refused rows of ``new`` (id, bag, units), given the held bags and keys."""
    links = written(verified(pairs, old.select("bag", "units").unionByName(new.select("bag", "units")), least).select("a", "b"))
    old_bags = old.select("bag").distinct()
    bad_bags = old_bags.union(links.join(old_bags.withColumnRenamed("bag", "a"), "a", "left_semi").select("b")).union(links.join(old_bags.withColumnRenamed("bag", "b"), "b", "left_semi").select("a")).distinct().withColumn("bad", F.lit(True))
    old_keys = keys.where("cid is not null").distinct().withColumn("had", F.lit(True))
    o = F.struct(*(F.col(f"id.{c}").alias(c) for c in order)).alias("o")
    rows = new.select(o, F.col("id.cid").alias("cid"), "bag")
    rows = written(rows.join(old_keys, "cid", "left").join(bad_bags, "bag", "left").select("o", "cid", "bag", (F.col("had").isNotNull() | F.col("bad").isNotNull()).alias("bad")))

    # of rows with equal key and bag only the first can be accepted
    left = rows.where("not bad and (cid is not null or bag is not null)")
    first = left.groupBy("cid", "bag").agg(F.min("o").alias("o"))
    again = left.join(first.withColumnRenamed("o", "first"), left["cid"].eqNullSafe(first["cid"]) & left["bag"].eqNullSafe(first["bag"])).where("o <> first").select("o")
    # rows that share neither key nor bag with another, and whose bag has no link, are accepted
    ends = links.select(F.col("a").alias("bag")).union(links.select(F.col("b").alias("bag"))).distinct().withColumn("tied", F.lit(True))
    many_c = first.where("cid is not null").groupBy("cid").count().where("count > 1").select("cid", F.lit(True).alias("c2"))
    many_b = first.where("bag is not null").groupBy("bag").count().where("count > 1").select("bag", F.lit(True).alias("b2"))
    tied = first.join(many_c, "cid", "left").join(many_b, "bag", "left").join(ends, "bag", "left").where("c2 or b2 or tied").select("o", "cid", "bag")
    refused = resolve(tied, links)
    return rows.where("bad").select("o").union(again).union(refused).select("o.*")


class PivotTable:
    """The held records at ``path``, for batches that come one at a time.

    rows has the pivot rows, bags the held bags with their units, keys the held keys; each is kept
    in ``buckets`` folders by hash. A batch reads its own texts and, of the three, only the folders
    that its keys, its candidates' bags and its record keys lie in; it never reads the texts of the
    history. What a batch is told and what it adds appear in one version or not at all, so a batch
    that is repeated after a failure, by its ``name``, gets the same answer and adds nothing twice.
    """

    def __init__(self, spark, path: str, key: str = "chunk_id", title: str = "title", text: str = "text", least: float = 0.8, least_words: int = LEAST_WORDS, buckets: int = 64):
        self.spark, self.at, self.buckets = spark, Snapshots(spark, path), buckets
        self.key, self.title, self.text, self.least, self.least_words = key, title, text, least, least_words

    def _in(self, value: Column) -> Column:
        return F.pmod(F.xxhash64(value), F.lit(self.buckets)).cast("int")

    def _read(self, state: dict, table: str, values: DataFrame) -> DataFrame:
        """The rows of the folders in which the values of a one-column table lie."""
        own = [r.b for r in values.select(self._in(F.col(values.columns[0])).alias("b")).distinct().collect()]
        return self.at.read(state, table, own)

    def _with(self, state: dict, records: DataFrame) -> dict:
        every = np.full(1 << (BAG_BITS - 6), ~U(0), U)
        # a null key is no key, but its bag is held
        named = records.select(F.coalesce(F.col(self.key), F.lit("")).alias("_id"), F.col(self.title).alias("_t"), F.col(self.text).alias("_x"))
        for table, rows, by in (
            ("rows", pivot_rows(records, self.title, self.text, self.least, self.least_words, probe=False), "k"),
            ("bags", members(named, "_id", "_t", "_x", every, self.least_words).where("units is not null").select("bag", "units"), "bag"),
            ("keys", records.select(F.col(self.key).alias("cid")).where("cid is not null").distinct(), "cid"),
        ):
            state = with_folders(state, table, rows, self.buckets, self.at.write(rows, F.xxhash64(by), self.buckets))
        return state

    def append(self, records: DataFrame) -> None:
        """Holds records from now on; nothing is checked, and rows of equal bags do no harm."""
        base = self.at.version()
        self.at.commit(base, self._with(self.at.state(base), records))

    def admit(self, batch: DataFrame, order: tuple[str, str] = ("batch_id", "row_id"), name: str | None = None) -> DataFrame:
        """The ``order`` columns of the refused rows; the others are held when this returns.

        A table must hold something, be it an empty one, before the first batch comes. Conflict is
        raised, and nothing is held, if another batch was admitted meanwhile.
        """
        base = self.at.version()
        state = self.at.state(base)
        if name is not None and name in state.get("refused", {"folders": {}})["folders"]:
            return self.at.read({"refused": {**state["refused"], "folders": {name: state["refused"]["folders"][name]}}}, "refused")
        probes = written(pivot_rows(batch, self.title, self.text, self.least, self.least_words, probe=True))
        own = pivot_rows(batch, self.title, self.text, self.least, self.least_words, probe=False)
        pairs = written(candidates(self._read(state, "rows", probes.select("k")).unionByName(own), probes, self.least))
        ends = pairs.select("a").union(pairs.select(F.col("b").alias("a")))
        new = written(members(_row(batch, self.key, self.title, self.text, order), "_id", "_t", "_x", bit_array(ends, F.col("a"), BAG_BITS), self.least_words, every=True))
        near = written(ends.union(new.where("bag is not null").select("bag")).distinct().withColumnRenamed("a", "bag"))
        old = written(self._read(state, "bags", near).join(near, "bag", "left_semi"))
        keys = self._read(state, "keys", batch.select(self.key).where(F.col(self.key).isNotNull()))
        refused = written(_judged(new, old, keys, pairs, order, self.least))
        same = [F.col(f"b.{c}").eqNullSafe(F.col(f"r.{c}")) for c in order]
        state = self._with(state, batch.alias("b").join(refused.alias("r"), same, "left_anti"))
        if name is not None:
            folder = self.at.write(refused, F.lit(0), 1)
            state = with_folders(state, "refused", refused, 1, {name: f for f in folder.values()})
        self.at.commit(base, state)
        return refused
