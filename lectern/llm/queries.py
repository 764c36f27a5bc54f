"""The p queries over the test tables, and the SQL of those that SQL can check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    from lectern.llm.distinctive import distinctive_terms, leading_term

    return leading_term(distinctive_terms(_t(spark, sf, "chunks"))).select("chunk_id", "term")


def p1_scores(spark: SparkSession, sf: str) -> DataFrame:
    from lectern.llm.distinctive import distinctive_terms

    return distinctive_terms(_t(spark, sf, "chunks")).select("chunk_id", "term", "tf", "df", F.round("ppmi", 6).alias("ppmi"), F.round("tf_idf", 6).alias("tf_idf"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    from lectern.llm.history import repeats

    return repeats(_t(spark, sf, "chunks"), _t(spark, sf, "chunk_batches")).select("row_id")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    from lectern.llm.splitting import cuts

    return cuts(_t(spark, sf, "chunks"))


def p3_pieces(spark: SparkSession, sf: str) -> DataFrame:
    from lectern.llm.splitting import pieces

    return pieces(_t(spark, sf, "chunks"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    from lectern.llm.nearcopies import near_pairs

    return near_pairs(_t(spark, sf, "chunks")).select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p4_groups(spark: SparkSession, sf: str) -> DataFrame:
    from lectern.llm.nearcopies import near_groups

    return near_groups(_t(spark, sf, "chunks"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    from lectern.llm.neighbours import close_pairs

    return close_pairs(_t(spark, sf, "chunks")).select(F.col("a").alias("chunk_id_a"), F.col("b").alias("chunk_id_b"))


def p5_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    from lectern.llm.neighbours import most_similar

    return most_similar(_t(spark, sf, "chunks"))


def p5_search(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy graph search: every twentieth vector of ``embeddings`` against all of them."""
    from lectern.llm.neighbours import nearest, search, to_vectors

    e = _t(spark, sf, "embeddings")
    vectors, graph = nearest(e, "vec_id", "embedding")
    nodes = vectors.groupBy(F.col("vid").alias("id")).agg(F.min("q").alias("q"))
    asked = vectors.where("key % 20 = 0").select(F.col("key").alias("query"), "q")
    return to_vectors(search(asked, nodes, graph), vectors).select(F.col("query").alias("query_id"), F.col("key").alias("vec_id"), F.col("sim").cast("double").alias("sim"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    from lectern.llm.canonical import match_references

    return match_references(_t(spark, sf, "chunks"), _t(spark, sf, "ref_books")).where("not exact").select("chunk_id", "ref_pos", "book_id")


def p6_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    """The values that name no book, with how often they occur."""
    from lectern.llm.canonical import match_references

    return match_references(_t(spark, sf, "chunks"), _t(spark, sf, "ref_books")).where("book_id = 0").groupBy("value").agg(F.count("*").alias("n"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    from lectern.llm.leaks import leaks

    return leaks(_t(spark, sf, "documents"), _t(spark, sf, "eval_items")).select("doc_id", "item_id")


def p7_containment(spark: SparkSession, sf: str) -> DataFrame:
    from lectern.llm.leaks import leaks

    return leaks(_t(spark, sf, "documents"), _t(spark, sf, "eval_items"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Sources that the fitted rates leave short of their goal, and of these, by the definition,
    those that would be short at their cap too."""
    from lectern.llm.mixing import mix

    return mix(_t(spark, sf, "documents"), _t(spark, sf, "mix_targets"))[1].where("short and not can_reach").select("source")


def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    from lectern.llm.mixing import mix

    return mix(_t(spark, sf, "documents"), _t(spark, sf, "mix_targets"))[1]


def p8_uses(spark: SparkSession, sf: str) -> DataFrame:
    from lectern.llm.mixing import mix

    return mix(_t(spark, sf, "documents"), _t(spark, sf, "mix_targets"))[0]


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    from lectern.llm.truncated import endings

    return endings(_t(spark, sf, "documents")).where("cut").select("doc_id")


def p9_rates(spark: SparkSession, sf: str) -> DataFrame:
    from lectern.llm.truncated import cut_rates, endings

    return cut_rates(endings(_t(spark, sf, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit()}
