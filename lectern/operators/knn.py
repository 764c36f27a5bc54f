"""Exact nearest neighbours of a set of query vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Components of all query vectors that are sent to the workers at once.
BLOCK_VALUES = 1 << 20


def knn(queries: DataFrame, items: DataFrame, k: int, query: str = "query_id", key: str = "id", vector: str = "embedding", floor: float | None = None) -> DataFrame:
    """(query_id, id, cosine, rank): the k items most similar to each query vector.

    Queries come in blocks of bounded size (the block is closed over by the tasks); each block is
    one matrix product per Arrow batch of items, and only k rows a query and batch leave a task.
    Null and all-zero vectors take no part. Cosines are rounded to 6 digits before ranking; ties
    go to the smaller id.
    """
    clean = lambda df, name: df.select(F.col(name).alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v")).where(F.exists("v", lambda x: x != 0))
    rows = clean(queries, query)
    kind, qkind = items.schema[key].dataType.simpleString(), queries.schema[query].dataType.simpleString()
    found: DataFrame | None = None
    block: list = []

    def flush() -> None:
        nonlocal found
        ids, q = [r[0] for r in block], np.array([r[1] for r in block], np.float64)
        q /= np.linalg.norm(q, axis=1, keepdims=True)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                cos = np.round(q @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T, 6)
                name = np.array(b.column(0).to_pylist(), dtype=object)
                by = np.argsort(np.argsort(name, kind="stable"), kind="stable")
                for i, row in enumerate(cos):
                    top = np.lexsort((by, -row))[:k]
                    if floor is not None:
                        top = top[row[top] >= floor]
                    yield pa.RecordBatch.from_arrays([pa.array([ids[i]] * len(top)), b.column(0).take(pa.array(top)), pa.array(row[top])], ["query_id", "id", "cosine"])

        part = clean(items, key).mapInArrow(scan, f"query_id {qkind}, id {kind}, cosine double")
        found = part if found is None else found.union(part)
        block.clear()

    for r in rows.toLocalIterator():
        block.append(r)
        if len(block) * len(r[1]) >= BLOCK_VALUES:
            flush()
    if block or found is None:
        if not block:
            return queries.sparkSession.createDataFrame([], f"query_id {qkind}, id {kind}, cosine double, rank long")
        flush()
    r = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id"))
    return found.withColumn("rank", r.cast("long")).where(F.col("rank") <= k)


def merge_variations(ranked: DataFrame) -> DataFrame:
    """(query_id, id, cosine, rank) from (query_id, variation, id, cosine, rank).

    An item that several variations found keeps its first place in the order of variations, and
    that place's similarity; ranks are then renumbered in that order.
    """
    first = ranked.groupBy("query_id", "id").agg(F.min(F.struct("variation", "rank", "cosine")).alias("f"))
    r = F.row_number().over(Window.partitionBy("query_id").orderBy("f.variation", "f.rank"))
    return first.select("query_id", "id", F.col("f.cosine").alias("cosine"), r.cast("long").alias("rank"))


def pool_size(n: int, variations: int) -> tuple[int, int]:
    """Candidates per query and per variation."""
    pool = max(4 * n, 20)
    return pool, max(1, pool // max(variations, 1))
