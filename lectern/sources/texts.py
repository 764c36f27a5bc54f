"""Cleaned texts on disk, and the sinks of the cleaning steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, text) of whole files, UTF-8."""
    return spark.read.text(path, wholetext=True, pathGlobFilter="*.txt").select(F.col("_metadata.file_name").alias("source_file"), F.col("value").alias("text"))


def write_texts(docs: DataFrame, path: str) -> None:
    """Cleaned documents as a table; one row instead of one small file each."""
    docs.select("source_file", "text").write.mode("overwrite").parquet(path)


def dry_run(chunks: DataFrame, n: int = 5, most: int = 200) -> DataFrame:
    """The first chunks by file and index, their texts cut for reading."""
    return chunks.orderBy("source_file", "chunk_index").select("source_file", "chunk_index", "chunk_type", "word_count", F.substring("text", 1, most).alias("text")).limit(n)
