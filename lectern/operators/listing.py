"""Listings: one representative chunk per sermon, latest days, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

MOST = 20


def listing(chunks: DataFrame, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """The newest ``most`` sermons, each by the chunk nearest to index 1, and how many there are.

    A sermon is a (date, title) pair, nulls as ''. Ties go to the smaller chunk_id. The nearest
    chunk is a minimum per group, taken before and after the shuffle; no group is gathered.
    """
    c = chunks.select(F.coalesce("date", F.lit("")).alias("date"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("chunk_index", F.lit(0)).alias("chunk_index"), "chunk_id", "chunk_type")
    nearest = c.groupBy("date", "title").agg(F.min(F.struct(F.abs(F.col("chunk_index") - 1).alias("away"), "chunk_id", "chunk_index", "chunk_type")).alias("c"))
    rows = nearest.select("date", "title", "c.chunk_id", "c.chunk_index", "c.chunk_type", F.lit(0.99).alias("score"))
    return rows.orderBy(F.desc("date"), "title").limit(most), nearest.agg(F.count("*").alias("n_sermons"))


def latest_days(chunks: DataFrame, day: str, n: int) -> DataFrame:
    """The n latest distinct dates (yyyymmdd) on a weekday."""
    return chunks.where((F.col("day_of_week") == day) & (F.col("date_numeric") > 0)).select("date_numeric").distinct().orderBy(F.desc("date_numeric")).limit(n)


def type_counts(chunks: DataFrame) -> DataFrame:
    """Chunks and mean word count per file and type, with totals per file and over all."""
    return chunks.rollup("source_file", "chunk_type").agg(F.count("*").alias("n_chunks"), F.round(F.avg("word_count"), 6).alias("avg_words"))


def latest_rank(df: DataFrame, by: str, order: str, most: int) -> DataFrame:
    r = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))
    return df.withColumn("r", r).where(F.col("r") <= most).drop("r")
