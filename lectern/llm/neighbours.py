"""Problem 5: the most similar vectors of every vector, by NN-descent.

A graph of k neighbours per vector is started from cells and improved by local joins: a
neighbour of my neighbour is likely mine. Each round is one join that brings a vector's
neighbours, forward and reverse, together at that vector, where all pairs among them are
compared; only pairs that improve one of the two lists travel on. Cells come from two sets of
random directions: a vector goes to the ``split`` best pairs of a direction from either set,
``trees`` times over. Directions grow with the square root of the data, the rows per cell stay the
same; as more cells tear more pairs apart, trees grow with the logarithm of the data.

Vectors travel as 64 bytes (8 bits per component of a 64-dimensional vector); similarities in the
graph are therefore good to about 0.003. What must be exact is computed from the full vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lectern.llm.bags import as_batches, mix
from lectern.llm.common import bit_array, bit_test, one_per_key
from lectern.session import spread, written

#: Rows of one cell, or of a block of a larger one, that a task holds.
BLOCK = 16_384
#: Similarities that are computed at once.
TILE = 1 << 22


@dataclass(frozen=True)
class Effort:
    """k neighbours per vector; ``trees`` times ``split`` cells each, of about per_cell / split
    vectors' first choices; up to k + ``reverse`` vectors meet in a local join; ``rounds`` of them.
    ``trees`` is for up to ``base`` vectors, and one more for every fourfold of that. Pairs less
    similar than ``least`` are no neighbours."""

    k: int = 8
    split: int = 3
    trees: int = 2
    per_cell: int = 150
    reverse: int = 8
    rounds: int = 1
    base: int = 15_000
    least: float = -2.0

    def at(self, n: int) -> Effort:
        """The effort for n vectors, with as good a chance that a close pair has a common cell."""
        return replace(self, trees=self.trees + max(0, int(np.ceil(np.log(max(n, 1) / self.base) / np.log(4) - 1e-9))))


#: Enough to find vectors that resemble each other closely; those that don't hardly lead to them.
CLOSE = Effort(trees=4, base=150_000, least=0.6)
#: For the nearest of any vector, however far they are.
FULL = Effort(16, 3, 3, 300, 16, 2)
EDGE = "id long, nbr long, sim float"


def directions(n: int, dim: int, seed: int) -> np.ndarray:
    d = np.random.default_rng(seed).normal(size=(n, dim))
    return (d / np.linalg.norm(d, axis=1, keepdims=True)).astype(np.float32)


def packed(x: np.ndarray) -> np.ndarray:
    """Unit rows as 8-bit components."""
    return np.rint(x * (127 / np.maximum(np.abs(x).max(1, keepdims=True), 1e-12))).astype(np.int8)


def unpacked(col: pa.Array, dim: int) -> np.ndarray:
    q = np.frombuffer(b"".join(col.to_pylist()), np.int8).reshape(len(col), dim).astype(np.float32)
    return q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)


def binaries(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    raw = np.ascontiguousarray(x)
    step = raw.itemsize * (raw.shape[1] if raw.ndim == 2 else 1)
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer((np.arange(len(raw) + 1, dtype=np.int32) * step).tobytes()), pa.py_buffer(raw.tobytes())])


def units(records: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """(key, vid, q, unit): usable vectors at unit length; vid is equal for equal directions."""
    src = records.select(F.col(key).alias("_k"), F.col(vector).alias("_v")).where(F.size("_v") == dim)
    one = one_per_key(spread(src), "_k", ["_v"])
    kind = one.schema["_k"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in as_batches(batches, 10_000):
            flat = b.column(1).flatten().cast(pa.float64())
            x = np.nan_to_num(flat.fill_null(0.0).to_numpy(zero_copy_only=False), nan=0.0, posinf=0.0, neginf=0.0).reshape(-1, dim)
            n = np.linalg.norm(x, axis=1)
            ok = np.flatnonzero(n > 0)
            x = x[ok] / n[ok, None]
            grid = np.rint(x * 1e6).astype(np.int64).view(np.uint64)
            h = np.zeros(len(x), np.uint64)
            for j in range(dim):
                h = mix(h ^ (grid[:, j] + np.uint64(j + 1)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ok)), pa.array(h.view(np.int64)), binaries(packed(x)), binaries(x.astype(np.float32))], ["key", "vid", "q", "unit"])

    return one.mapInArrow(rows, f"key {kind}, vid long, q binary, unit binary")


def whole_groups(batches: Iterator[pa.RecordBatch], column: int = 0, most: int = 50_000) -> Iterator[pa.Table]:
    """Consecutive rows in tables that don't split a run of equal ids, unless it has ``most`` rows."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        if sum(x.num_rows for x in held) < most // 4:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        ids = t.column(column).to_numpy()
        other = np.flatnonzero(ids != ids[-1])
        end = int(other[-1]) + 1 if len(other) else 0
        if end == 0 and len(ids) < most:
            held = t.to_batches()
            continue
        end = end or len(ids)
        yield t.slice(0, end).combine_chunks()
        held = t.slice(end).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _cells(x: np.ndarray, sets: list[tuple[np.ndarray, np.ndarray]], side: int, split: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell): the ``split`` cells of each row in every set."""
    near = min(side, 2 * split)
    of, cells = [], []
    for t, (p, q) in enumerate(sets):
        a, c = x @ p.T, x @ q.T
        ia, ic = np.argsort(-a, 1)[:, :near], np.argsort(-c, 1)[:, :near]
        s = (np.take_along_axis(a, ia, 1)[:, :, None] + np.take_along_axis(c, ic, 1)[:, None, :]).reshape(len(x), -1)
        name = ((t * side + ia[:, :, None]) * side + ic[:, None, :]).reshape(len(x), -1)
        m = min(split, name.shape[1])
        cells.append(np.take_along_axis(name, np.argsort(-s, 1)[:, :m], 1).ravel())
        of.append(np.repeat(np.arange(len(x)), m))
    return np.concatenate(of), np.concatenate(cells).astype(np.int64)


def cell_rows(nodes: DataFrame, dim: int, side: int, e: Effort, most: int = BLOCK) -> DataFrame:
    """(cell, block, id, q): every vector in its cells.

    A cell of more than ``most`` rows is divided into blocks by hash, and stands for as many cells as
    it has pairs of blocks, each of its rows in those of its block: so all its pairs meet, in
    separate tasks. Full cells are counted first; there are few, as each holds ``most`` rows.
    """
    sets = [(directions(side, dim, 2 * t + 1), directions(side, dim, 2 * t + 2)) for t in range(e.trees)]
    split = e.split

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in as_batches(batches, 5000):
            cell, n = np.unique(_cells(unpacked(b.column(0), dim), sets, side, split)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n.astype(np.int64))], ["cell", "n"])

    counts = nodes.select("q").mapInArrow(sizes, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    full = np.array(sorted((r.cell, r.n) for r in counts.where(F.col("n") > most).collect()), np.int64).reshape(-1, 2)
    blocks = -(-full[:, 1] // most)
    # names of their own for the pairs of blocks, after those of all cells
    names = e.trees * side * side + np.cumsum(blocks * (blocks + 1) // 2) - blocks * (blocks + 1) // 2

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in as_batches(batches, 5000):
            of, first = _cells(unpacked(b.column(1), dim), sets, side, split)
            m = np.ones(len(of), np.int64)
            if len(full):
                at = np.minimum(np.searchsorted(full[:, 0], first), len(full) - 1)
                hit = full[at, 0] == first
                m, first = np.where(hit, blocks[at], 1), np.where(hit, names[at], first)
            own = (mix(b.column(0).to_numpy().view(np.uint64))[of] % m.astype(np.uint64)).astype(np.int64)
            for other in range(int(m.max(initial=0))):
                ok = m > other
                lo, hi = np.minimum(own[ok], other), np.maximum(own[ok], other)
                take = pa.array(of[ok])
                yield pa.RecordBatch.from_arrays([pa.array(first[ok] + lo * m[ok] - lo * (lo - 1) // 2 + hi - lo), pa.array(own[ok]), b.column(0).take(take), b.column(1).take(take)], ["cell", "block", "id", "q"])

    return nodes.select("id", "q").mapInArrow(rows, "cell long, block long, id long, q binary")


def _best(sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k greatest entries of each row, without -inf."""
    k = min(k, sim.shape[1])
    top = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    r = np.repeat(np.arange(len(sim)), k)
    c = top.ravel()
    ok = np.isfinite(sim[r, c])
    return r[ok], c[ok]


def cell_edges(cells: DataFrame, dim: int, k: int, least: float = -2.0) -> DataFrame:
    """The k most similar of each vector within its cell: every row of a cell is compared with
    every other, or every row of one block with every row of the other."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches):
            cell, block, ids = (t.column(c).to_numpy() for c in range(3))
            x = unpacked(t.column(3).combine_chunks(), dim)
            cuts = np.concatenate([[0], np.flatnonzero(cell[1:] != cell[:-1]) + 1, [len(cell)]])
            out = []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                mid = lo + int(np.searchsorted(block[lo:hi], block[lo], "right"))
                for (a, z), (u, v) in [((lo, hi), (lo, hi))] if mid == hi else [((lo, mid), (mid, hi)), ((mid, hi), (lo, mid))]:
                    step = max(1, TILE // (v - u))
                    for s in range(a, z, step):
                        end = min(s + step, z)
                        sim = x[s:end] @ x[u:v].T
                        if a == u:
                            sim[np.arange(end - s), np.arange(s - u, end - u)] = -np.inf
                        r, c = _best(sim, k)
                        near = sim[r, c] >= least
                        r, c = r[near], c[near]
                        out.append((ids[s:end][r], ids[u:v][c], sim[r, c]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in zip(*out)], ["id", "nbr", "sim"])

    # not a rebalance, which may tear a cell apart
    return cells.repartition("cell").sortWithinPartitions("cell", "block").mapInArrow(rows, EDGE)


def best_k(edges: DataFrame, k: int) -> DataFrame:
    """The k most similar different neighbours of each id."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches):
            i, n, s = (t.column(c).to_numpy() for c in range(3))
            o = np.lexsort((-s, n, i))
            i, n, s = i[o], n[o], s[o]
            new = np.concatenate([[True], (i[1:] != i[:-1]) | (n[1:] != n[:-1])]) & (i != n)
            i, n, s = i[new], n[new], s[new]
            o = np.lexsort((n, -s, i))
            i, n, s = i[o], n[o], s[o]
            first = np.concatenate([[True], i[1:] != i[:-1]]) if len(i) else np.zeros(0, bool)
            at = np.arange(len(i))
            rank = at - np.maximum.accumulate(np.where(first, at, 0)) if len(i) else at
            keep = rank < k
            yield pa.RecordBatch.from_arrays([pa.array(i[keep]), pa.array(n[keep]), pa.array(s[keep])], ["id", "nbr", "sim"])

    return edges.repartition("id").sortWithinPartitions("id").mapInArrow(rows, EDGE)


def descend(graph: DataFrame, nodes: DataFrame, dim: int, e: Effort) -> DataFrame:
    """Pairs that one round of local joins finds to improve a list, in both directions.

    Of the reverse neighbours of a vector the ``reverse`` most similar take part, as NN-descent
    samples them: the neighbours of a hub are many, and each has lists of its own to be found by.
    """
    worst = graph.groupBy("id").agg(F.when(F.count("*") >= e.k, F.min("sim")).otherwise(F.lit(e.least)).cast("float").alias("low"))
    rank = F.row_number().over(Window.partitionBy("nbr").orderBy(F.desc("sim"), "id"))
    back = graph.withColumn("r", rank).where(F.col("r") <= e.reverse).select(F.col("nbr").alias("u"), F.col("id").alias("w"))
    member = graph.select(F.col("id").alias("u"), F.col("nbr").alias("w")).union(back).distinct()
    full = nodes.join(worst, "id", "left").select(F.col("id").alias("w"), "q", F.coalesce("low", F.lit(e.least)).cast("float").alias("low"))
    met = member.join(full, "w").select("u", "w", "low", "q")
    wide = e.k + e.reverse

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, most=20_000):
            u, w, low = (t.column(c).to_numpy() for c in range(3))
            x = unpacked(t.column(3).combine_chunks(), dim)
            start = np.concatenate([[True], u[1:] != u[:-1]])
            group = np.cumsum(start) - 1
            at = np.arange(len(u)) - np.flatnonzero(start)[group]
            ok = at < wide
            block = np.zeros((group[-1] + 1, wide, dim), np.float32)
            name = np.zeros((group[-1] + 1, wide), np.int64)
            least = np.full((group[-1] + 1, wide), np.inf, np.float32)
            block[group[ok], at[ok]], name[group[ok], at[ok]], least[group[ok], at[ok]] = x[ok], w[ok], low[ok]
            sim = block @ block.transpose(0, 2, 1)
            better = (sim > least[:, :, None]) & np.isfinite(least)[:, None, :]
            better &= ~np.eye(wide, dtype=bool)
            g, a, b = np.nonzero(better)
            yield pa.RecordBatch.from_arrays([pa.array(name[g, a]), pa.array(name[g, b]), pa.array(sim[g, a, b])], ["id", "nbr", "sim"])

    return met.repartition("u").sortWithinPartitions("u").mapInArrow(rows, EDGE)


def neighbour_graph(nodes: DataFrame, dim: int, e: Effort = CLOSE) -> DataFrame:
    """(id, nbr, sim): about the k most similar of every vector of (id, q)."""
    n = nodes.count()
    e = e.at(n)
    side = max(2, int(np.ceil(np.sqrt(n * e.split / e.per_cell))))
    graph = written(best_k(cell_edges(cell_rows(nodes, dim, side, e), dim, e.k, e.least), e.k))
    for _ in range(e.rounds):
        graph = written(best_k(graph.union(descend(graph, nodes, dim, e)), e.k))
    return graph


def exact(pairs: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """(id, nbr, cos) of the pairs, both ways, from the full vectors (vid, unit)."""
    ends = pairs.select("id").union(pairs.select("nbr"))
    wanted = bit_array(ends, F.col("id"), 20)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(bit_test(wanted, b.column(0).to_numpy().view(np.uint64))))

    few = vectors.select("vid", "unit").mapInArrow(some, "vid long, unit binary").groupBy("vid").agg(F.min("unit").alias("unit"))
    x, y = few.select(F.col("vid").alias("id"), F.col("unit").alias("x")), few.select(F.col("vid").alias("nbr"), F.col("unit").alias("y"))
    both = pairs.select(F.least("id", "nbr").alias("id"), F.greatest("id", "nbr").alias("nbr")).distinct().join(x, "id").join(y, "nbr").select("id", "nbr", "x", "y")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in as_batches(batches, 10_000):
            u, v = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.float32).reshape(-1, dim).astype(np.float64) for c in (2, 3))
            cos = (u * v).sum(1) / np.sqrt((u * u).sum(1) * (v * v).sum(1))
            i, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([i, n])), pa.array(np.concatenate([n, i])), pa.array(np.concatenate([cos, cos]))], ["id", "nbr", "cos"])

    return both.mapInArrow(rows, "id long, nbr long, cos double")


def to_keys(edges: DataFrame, vectors: DataFrame, sim: str, k: int) -> DataFrame:
    """(key, other, sim, rank): neighbours of records from those of their vectors.

    Records with one vector are each other's neighbours at similarity 1; of any vector's records
    the first k + 1 by key are enough for k neighbours of any record.
    """
    by = Window.partitionBy("vid").orderBy("key")
    head = vectors.select("vid", "key").withColumn("r", F.row_number().over(by)).where(F.col("r") <= k + 1).select(F.col("vid").alias("nbr"), F.col("key").alias("other"))
    many = vectors.groupBy("vid").count().where("count > 1").select(F.col("vid").alias("id"), F.col("vid").alias("nbr"), F.lit(1.0).alias(sim))
    all_edges = edges.select("id", "nbr", F.col(sim).cast("double").alias(sim)).unionByName(many)
    pairs = vectors.select(F.col("vid").alias("id"), "key").join(all_edges, "id").join(head, "nbr").where("key <> other")
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc(sim), "other"))
    return pairs.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).select("key", "other", sim, "rank")


def nearest(records: DataFrame, key: str = "chunk_id", vector: str = "embedding", dim: int = 64, effort: Effort = FULL) -> tuple[DataFrame, DataFrame]:
    """The vectors (key, vid, q, unit) of the usable records and their graph (id, nbr, sim).

    Null vectors, all-zero ones and such of another length than ``dim`` are not usable; null, NaN
    and infinite components count as 0. Records without key are left out; rows of equal key count
    once. Records of one direction share a vid, so copies in any number are one node. Other
    columns are ignored; an empty table gives empty tables.
    """
    vectors = written(units(records, key, vector, dim))
    nodes = written(vectors.groupBy(F.col("vid").alias("id")).agg(F.min("q").alias("q")))
    return vectors, neighbour_graph(nodes, dim, effort)


def most_similar(records: DataFrame, key: str = "chunk_id", vector: str = "embedding", dim: int = 64, k: int = 5, effort: Effort = FULL) -> DataFrame:
    """(key, other, sim, rank): about the k most similar records of every usable one."""
    vectors, graph = nearest(records, key, vector, dim, effort)
    return to_keys(graph, vectors, "sim", k).withColumnRenamed("key", key)


def close_pairs(records: DataFrame, key: str = "chunk_id", vector: str = "embedding", dim: int = 64, k: int = 5, least: float = 0.85) -> DataFrame:
    """(a, b): pairs of records, one among the k most similar of the other, with cosine >= least.

    The graph gives the candidates; cosines and ranks of all that may reach ``least`` come from
    the full vectors.
    """
    vectors, graph = nearest(records, key, vector, dim, CLOSE)
    likely = written(graph.where(F.col("sim") >= least - 0.02).select("id", "nbr"))
    near = to_keys(exact(likely, vectors, dim), vectors, "cos", k).where(F.col("cos") >= least)
    return near.select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b")).distinct()


def to_vectors(found: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query, key, sim): the records of the nodes that a search has found."""
    return found.join(vectors.select(F.col("vid").alias("id"), "key"), "id").select("query", "key", "sim")


def search(queries: DataFrame, nodes: DataFrame, graph: DataFrame, dim: int = 64, k: int = 5, beam: int = 16, rounds: int = 5, starts: int = 24) -> DataFrame:
    """(query, id, sim): about the k most similar nodes of each query (query, q), by greedy search.

    Each query starts at ``starts`` nodes of each of its cells, and as many of all, chosen by hash,
    and keeps its ``beam`` best; every round
    it looks at all neighbours of those, in either direction of the graph. ``nodes`` is (id, q).
    """
    n = max(nodes.count(), 1)
    share = min(1.0, starts * 4 / n)
    first = nodes.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < max(1, int(share * 1_000_000))).select("id").limit(starts)
    links = written(graph.select("id", "nbr").union(graph.select(F.col("nbr").alias("id"), F.col("id").alias("nbr"))).distinct())

    def scored(pairs: DataFrame) -> DataFrame:
        met = pairs.join(queries.select("query", F.col("q").alias("x")), "query").join(nodes.select("id", F.col("q").alias("y")), "id").select("query", "id", "x", "y")

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in as_batches(batches, 10_000):
                sim = (unpacked(b.column(2), dim) * unpacked(b.column(3), dim)).sum(1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sim.astype(np.float32))], ["query", "id", "sim"])

        return met.mapInArrow(rows, f"query {queries.schema['query'].dataType.simpleString()}, id long, sim float")

    def best(rows: DataFrame, m: int) -> DataFrame:
        r = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("sim"), "id"))
        return rows.withColumn("r", r).where(F.col("r") <= m).drop("r")

    entry = [r[0] for r in first.collect()]
    seeds: Column = F.explode(F.array(*map(F.lit, entry)) if entry else F.array().cast("array<long>"))
    e = FULL.at(n)
    side = max(2, int(np.ceil(np.sqrt(n * e.split / e.per_cell))))
    cells = lambda of: cell_rows(of, dim, side, e, 1 << 62).select("cell", "id")
    some = F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64("id"), "id"))
    inside = cells(nodes).withColumn("r", some).where(F.col("r") <= starts).drop("r")
    asked = queries.select("query", F.xxhash64("q").alias("h"), "q")
    own = cells(asked.select(F.col("h").alias("id"), "q").distinct()).withColumnRenamed("id", "h").join(inside, "cell")
    near = asked.select("query", "h").join(own, "h").select("query", "id")
    now = written(best(scored(near.union(queries.select("query", seeds.alias("id"))).distinct()), beam))
    for _ in range(rounds):
        fresh = now.select("query", "id").join(links, "id").select("query", F.col("nbr").alias("id")).distinct().join(now.select("query", "id"), ["query", "id"], "left_anti")
        now = written(best(now.unionByName(scored(fresh)), beam))
    return best(now, k)
