"""Weighted reciprocal rank fusion and what follows it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Rank constant, weights and the least similarity of a hit that is no scripture match. Fixed values.
RRF_K = 60
WEIGHTS = {"semantic": 1.0, "lexical": 1.0, "scripture": 2.0}
FLOOR = 0.35


def fuse(arms: DataFrame) -> DataFrame:
    """(query_id, id, rrf, semantic_score, is_scripture) from (query_id, id, arm, rank, score).

    One aggregation over the union of the arms; the terms of the sum are added arm by arm, so
    the result doesn't depend on the order of rows.
    """
    rank = {a: F.min(F.when(F.col("arm") == a, F.col("rank"))) for a in WEIGHTS}
    rrf = sum((F.coalesce(F.lit(w) / (RRF_K + rank[a]), F.lit(0.0)) for a, w in WEIGHTS.items()), F.lit(0.0))
    sem = F.coalesce(F.max(F.when(F.col("arm") == "semantic", F.col("score"))), F.lit(0.0))
    return arms.groupBy("query_id", "id").agg(F.round(rrf, 9).alias("rrf"), sem.alias("semantic_score"), rank["scripture"].isNotNull().alias("is_scripture"))


def above_floor(fused: DataFrame, floor: float = FLOOR) -> DataFrame:
    """Hits of enough similarity, and all scripture matches. A lexical hit alone has similarity 0."""
    return fused.where((F.col("semantic_score") >= floor) | F.col("is_scripture"))


def cut(df: DataFrame, by: str, k: int | Column) -> DataFrame:
    """The k rows per query with the greatest ``by``, ranked; ties go to the smaller id."""
    r = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(by), "id"))
    return df.withColumn("rank", r.cast("long")).where(F.col("rank") <= k)


def rerank_size(n: int) -> int:
    return max(max(4 * n, 20) // 2, n)


def without_reranker(fused: DataFrame, n: int) -> DataFrame:
    """The n best by fusion, scored by their similarity: what a search gives without a reranker."""
    return cut(fused, "rrf", n).withColumn("score", F.round("semantic_score", 3))


def blend(df: DataFrame) -> DataFrame:
    """final_score from rerank_score (a logit) and rrf: 0.6 sigmoid + 0.4 rrf / the query's best."""
    best = F.max("rrf").over(Window.partitionBy("query_id"))
    best = F.when(best > 0, best).otherwise(1.0)
    return df.withColumn("final_score", F.round(0.6 * (1 / (1 + F.exp(-F.col("rerank_score")))) + 0.4 * F.col("rrf") / best, 9))


def display_score(logit: Column | str) -> Column:
    c = F.col(logit) if isinstance(logit, str) else logit
    return F.round(F.least(F.lit(0.99), F.greatest(F.lit(0.5), (c + 1) / 12)), 3)


def recency(df: DataFrame, as_of: Column, weight: float, date: str = "date") -> DataFrame:
    """final_score blended with exp(-days / 365); unreadable dates keep their score."""
    from lectern.functions.dates import iso_date

    if weight <= 0:
        return df
    d = iso_date(date)
    age = F.greatest(F.lit(0), F.date_diff(as_of, d))
    return df.withColumn("final_score", F.when(d.isNull(), F.col("final_score")).otherwise(F.round((1 - weight) * F.col("final_score") + weight * F.exp(-age / 365.0), 9)))
