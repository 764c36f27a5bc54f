"""Lexical search: Okapi BM25 over postings."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lectern.functions.text import tokenize
from lectern.session import written

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Query texts that are scored at once, their terms that go to the workers with them, and scores
#: that are held at once.
TEXTS, TERMS, CELLS = 512, 1 << 18, 1 << 22


@dataclass
class Index:
    """postings(id, term, tf, dl), terms(term, df, idf) and the scalars of one collection."""

    postings: DataFrame
    terms: DataFrame
    scalars: DataFrame


def build(docs: DataFrame, key: str = "chunk_id", text: str = "text") -> Index:
    """The index of a collection; statistics cover all of it, whatever is filtered later.

    A term in more than half of all documents gets EPSILON times the mean idf of all terms
    instead of its negative one.
    """
    toks = docs.select(F.col(key).alias("id"), tokenize(text).alias("t"))
    # outer, since the filter that goes with an inner explode would split the texts again
    each = toks.select("id", F.size("t").cast("long").alias("dl"), F.explode_outer("t").alias("term")).where("term is not null")
    # the texts are read once; everything else comes from the postings
    postings = written(each.groupBy("id", "dl", "term").agg(F.count("*").alias("tf")))
    n_docs = docs.agg(F.count("*").alias("n"))
    scalars = postings.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("words")).withColumn("n", n_docs.scalar()).select("n", F.try_divide("words", "n").alias("avgdl"))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    n = n_docs.scalar()
    raw = df.withColumn("raw", F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw")).scalar()
    terms = raw.withColumn("idf", F.when(F.col("raw") < 0, EPSILON * mean).otherwise(F.col("raw"))).select("term", "df", "idf")
    return Index(postings, terms, scalars)


def _blocks(texts: DataFrame) -> Iterator[tuple[list[str], list[str], np.ndarray, np.ndarray, np.ndarray]]:
    """(texts, terms, text of each entry, term of each entry, how often) of blocks of query texts
    that together have about TERMS entries."""
    held: list[tuple[str, dict[str, int]]] = []

    def block():
        terms = sorted({t for _, c in held for t in c})
        at = {t: i for i, t in enumerate(terms)}
        rows = [(i, at[t], n) for i, (_, c) in enumerate(held) for t, n in c.items()]
        return [x for x, _ in held], terms, *np.array(rows, np.int64).reshape(-1, 3).T

    size = 0
    for (norm,) in texts.toLocalIterator():
        counts: dict[str, int] = {}
        for t in norm.split(" "):
            counts[t] = counts.get(t, 0) + 1
        held.append((norm, counts))
        size += len(counts)
        if size >= TERMS:
            yield block()
            held, size = [], 0
    if held:
        yield block()


def search(index: Index, queries: DataFrame, k: int, keep: DataFrame | None = None, query: str = "query_id", text: str = "text") -> DataFrame:
    """(query_id, id, score, rank): the k best documents with a positive score per query, ties to
    the smaller id; with ``keep`` (id) only those documents are ranked, by the same statistics.

    Equal query texts are scored once. A document arrives as one row with its terms that occur in
    queries; a task scores its documents against blocks of query texts as matrix products and
    hands on k rows a text and batch, so the pairs of queries and documents, most of which share
    a common word, are never rows. Query texts come in parts of about TERMS terms, each part being
    one pass over the postings.
    """
    qs = queries.select(F.col(query).alias("query_id"), F.array_join(tokenize(text), " ").alias("norm")).where("norm <> ''")
    kind = index.postings.schema["id"].dataType.simpleString()
    avgdl = float(index.scalars.first()["avgdl"] or 1.0)
    spark, found = queries.sparkSession, None
    for texts, terms, q, t, n in _blocks(qs.select("norm").distinct()):
        weights = spark.createDataFrame(list(enumerate(terms)), "t int, term string").join(index.terms.select("term", "idf"), "term").select("t", "term", "idf")
        hits = index.postings.join(weights, "term")
        if keep is not None:
            hits = hits.join(keep.select("id").distinct(), "id", "left_semi")
        docs = hits.groupBy("id", "dl").agg(F.collect_list("t").alias("t"), F.collect_list("tf").alias("tf"), F.collect_list("idf").alias("idf"))
        names = np.array(texts, dtype=object)

        def scan(batches: Iterator[pa.RecordBatch], names=names, n_terms=len(terms), q=q, t=t, n=n) -> Iterator[pa.RecordBatch]:
            def best(total: np.ndarray, ids: pa.Array, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                for i, row in enumerate(total):
                    some = np.flatnonzero(row > 0)
                    if len(some) > k:
                        low = np.partition(row[some], len(some) - k)[len(some) - k]
                        some = some[row[some] >= low]
                    yield i, some[np.lexsort((by[some], -row[some]))[:k]]

            parts = []
            for lo in range(0, len(names), TEXTS):
                own = np.flatnonzero((q >= lo) & (q < lo + TEXTS))
                used, col = np.unique(t[own], return_inverse=True)
                w = np.zeros((min(TEXTS, len(names) - lo), len(used)))
                w[q[own] - lo, col] = n[own]
                parts.append((lo, used, w))
            for b in batches:
                step = max(1, CELLS // max(TEXTS, n_terms))
                for at in range(0, b.num_rows, step):
                    docs = b.slice(at, step)
                    size = np.diff(docs.column("t").offsets.to_numpy())
                    flat = lambda c: docs.column(c).flatten().to_numpy(zero_copy_only=False)  # noqa: B023, E731
                    tf, dl = flat("tf").astype(float), np.repeat(docs.column("dl").to_numpy().astype(float), size)
                    c = np.zeros((docs.num_rows, n_terms))
                    c[np.repeat(np.arange(docs.num_rows), size), flat("t")] = flat("idf") * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * dl / avgdl))
                    ids = docs.column("id")
                    by = np.argsort(np.argsort(np.array(ids.to_pylist(), dtype=object), kind="stable"), kind="stable")
                    for lo, used, w in parts:
                        total = np.round(w @ c[:, used].T, 6)
                        rows = [(lo + i, r, total[i, r]) for i, r in best(total, ids, by) if len(r)]
                        if rows:
                            which = np.repeat([i for i, _, _ in rows], [len(r) for _, r, _ in rows])
                            r = np.concatenate([r for _, r, _ in rows])
                            yield pa.RecordBatch.from_arrays([pa.array(names[which], pa.string()), ids.take(pa.array(r)), pa.array(np.concatenate([s for _, _, s in rows]))], ["norm", "id", "score"])

        part = docs.mapInArrow(scan, f"norm string, id {kind}, score double")
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], f"query_id {queries.schema[query].dataType.simpleString()}, id {kind}, score double, rank long")
    r = F.row_number().over(Window.partitionBy("norm").orderBy(F.desc("score"), "id"))
    return qs.join(found.withColumn("rank", r.cast("long")).where(F.col("rank") <= k), "norm").select("query_id", "id", "score", "rank")
