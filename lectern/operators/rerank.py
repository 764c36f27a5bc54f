"""Reranking seam, overlap merging and diversity selection over a query's few candidates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lectern.functions.text import let, space_words, token_set

LAMBDA = 0.7
#: Words at either end that are compared, and how many must be shared. Fixed values.
EDGE_WORDS, SHARED = 50, 30

Scorer = Callable[[list[str], list[str]], list[float]]


def rerank(df: DataFrame, load: Callable[[], Scorer], query: str = "query", text: str = "text") -> DataFrame:
    """rerank_score by a model: ``load`` runs once per worker, its result once per Arrow batch."""

    @F.pandas_udf(DoubleType())
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for q, t in parts:
            yield pd.Series(model(q.fillna("").tolist(), t.fillna("").tolist()), dtype="float64")

    return df.withColumn("rerank_score", score(query, text))


def overlap_score(query: Column | str, text: Column | str) -> Column:
    """A deterministic stand-in for a cross-encoder: 10 (share of query tokens in the text) - 5."""
    q, t = token_set(query), token_set(text)
    return F.round(10 * F.coalesce(F.size(F.array_intersect(q, t)) / F.nullif(F.size(q), F.lit(0)), F.lit(0.0)) - 5, 6)


def dedupe_cut(n: int) -> int:
    return max(3 * n, n + 5)


def merge_adjacent(df: DataFrame) -> DataFrame:
    """Consecutive chunks of a sermon that repeat each other's edge become one.

    df: (query_id, id, ord, title, date, chunk_index, text, score, final_score), ord giving the
    rank. Within (query_id, title, date), by chunk_index, a chunk whose index differs by at most
    1 from the merged head and shares more than SHARED distinct words of the EDGE_WORDS at the
    edge is appended to the head, which keeps its index and final_score and the better score.
    The new ord follows the groups by first appearance, then the index.

    A group holds candidates of one query only, so its size is bounded by the candidate cut.
    """
    item = F.struct(F.coalesce("chunk_index", F.lit(0)).alias("i"), "ord", "id", F.coalesce("text", F.lit("")).alias("text"), "score", "final_score")
    groups = df.groupBy("query_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("date", F.lit("")).alias("date")).agg(F.min("ord").alias("seen"), F.array_sort(F.collect_list(item)).alias("c"))

    def step(acc: Column, c: Column) -> Column:
        last = F.element_at(acc, -1)
        ws = space_words(last["text"])
        tail = F.slice(ws, F.greatest(F.lit(1), F.size(ws) - EDGE_WORDS + 1), EDGE_WORDS)
        shared = F.size(F.array_intersect(tail, F.slice(space_words(c["text"]), 1, EDGE_WORDS)))
        joins = (F.abs(c["i"] - last["i"]) <= 1) & (shared > SHARED)
        merged = F.struct(last["i"].alias("i"), last["ord"].alias("ord"), last["id"].alias("id"), F.concat(last["text"], F.lit(" [...] "), c["text"]).alias("text"), F.greatest(last["score"], c["score"]).alias("score"), last["final_score"].alias("final_score"))
        return F.when(joins, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(merged))).otherwise(F.concat(acc, F.array(c)))

    folded = groups.select("query_id", "title", "date", "seen", F.aggregate(F.slice("c", 2, F.greatest(F.size("c") - 1, F.lit(0))), F.slice("c", 1, 1), step).alias("m"))
    rows = folded.select("query_id", "title", "date", "seen", F.posexplode("m").alias("p", "e"))
    from pyspark.sql import Window

    ord_ = F.row_number().over(Window.partitionBy("query_id").orderBy("seen", "p"))
    return rows.select("query_id", F.col("e.id").alias("id"), ord_.cast("long").alias("ord"), "title", "date", F.col("e.i").alias("chunk_index"), F.col("e.text").alias("text"), F.col("e.score").alias("score"), F.col("e.final_score").alias("final_score"))


def mmr(df: DataFrame, n: int, lambda_: float = LAMBDA) -> DataFrame:
    """(query_id, id, pick): up to n candidates per query, relevant and different.

    df: (query_id, id, ord, title, date, text, final_score). With n candidates or fewer all come
    in their order. Otherwise the first by ord is taken, then always the one with the greatest
    lambda final_score - (1 - lambda) s, s being its greatest similarity to those taken: 0.5 for
    the same sermon, or the Jaccard similarity of the words if that is more. Ties go to the first.
    """
    item = F.struct("ord", "id", "final_score", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("date", F.lit("")).alias("date"), token_set("text").alias("w"))
    per = df.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("c"))

    def similarity(a: Column, b: Column) -> Column:
        words = F.size(a["w"]) + F.size(b["w"])
        jaccard = let(F.size(F.array_intersect(a["w"], b["w"])), lambda both: F.when(words > both, both / (words - both)).otherwise(0.0))
        return F.greatest(F.when((a["title"] == b["title"]) & (a["date"] == b["date"]), 0.5).otherwise(0.0), jaccard)

    def step(acc: Column, _: Column) -> Column:
        left = let(F.transform(acc, lambda x: x["ord"]), lambda taken: F.filter("c", lambda x: ~F.array_contains(taken, x["ord"])))
        worth = F.transform(left, lambda x: F.struct(F.round(lambda_ * x["final_score"] - (1 - lambda_) * F.array_max(F.transform(acc, lambda y: similarity(x, y))), 9).alias("s"), (-x["ord"]).alias("o")))
        return let(-F.array_max(worth)["o"], lambda best: F.when(best.isNotNull(), F.concat(acc, F.filter("c", lambda x: x["ord"] == best))).otherwise(acc))

    picked = F.when(F.size("c") <= n, F.col("c")).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(max(n - 1, 1))), F.slice("c", 1, 1), step))
    rows = per.select("query_id", F.posexplode(F.slice(picked, 1, n)).alias("p", "e"))
    return rows.select("query_id", F.col("e.id").alias("id"), (F.col("p") + 1).cast("long").alias("pick"))
