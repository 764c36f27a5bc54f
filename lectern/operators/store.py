"""The stored chunk table: upsert, partial update, backfill, export, what is already there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.dates import iso_date


def latest(df: DataFrame, key: str, by: str) -> DataFrame:
    """One row per key: the latest by ``by`` (nulls first), of equal ones the greatest by content."""
    rest = [c for c in df.columns if c not in (key, by)]
    best = df.groupBy(key).agg(F.max(F.struct(by, *rest)).alias("_r"))
    return best.select(key, *(F.col(f"_r.{c}").alias(c) for c in df.columns if c != key))


def upsert(stored: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Stored rows without those that ``new`` replaces, and the new rows."""
    return stored.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def replace_by(stored: DataFrame, new: DataFrame, group: str = "source_file") -> DataFrame:
    """As upsert, but by file: a file that now gives fewer chunks leaves none behind."""
    return stored.join(new.select(group).distinct(), group, "left_anti").unionByName(new, allowMissingColumns=True)


def update(stored: DataFrame, changes: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Stored rows with the non-null columns of ``changes`` (one row per key) in place of theirs."""
    cols = [c for c in changes.columns if c != key]
    new = changes.select(key, *(F.col(c).alias(f"_new_{c}") for c in cols))
    return stored.join(new, key, "left").select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in cols else c for c in stored.columns))


def backfill_weekday(stored: DataFrame) -> DataFrame:
    """day_of_week where it is missing and the date can be read; other rows as they are."""
    d = iso_date("date")
    missing = F.coalesce("day_of_week", F.lit("")) == ""
    return stored.withColumn("day_of_week", F.when(missing & d.isNotNull(), F.lower(F.date_format(d, "EEEE"))).otherwise(F.col("day_of_week")))


def not_ingested(candidates: DataFrame, stored: DataFrame, stem: str = "stem", file: str = "source_file") -> DataFrame:
    """Candidates whose stem occurs in no stored file name.

    A substring test has no key to join by, but a stem can only occur in a name that holds its
    first eight characters, so both sides meet on those: each name is exploded into its distinct
    pieces of eight characters. Shorter stems meet on pieces of their own length.
    """
    names = stored.select(file).where(F.col(file).isNotNull() & (F.col(file) != "")).distinct()
    c = candidates.where(F.col(stem).isNotNull()).select(stem).distinct()
    sizes = c.agg(F.collect_set(F.least(F.length(stem), F.lit(8)))).scalar()
    pieces = names.withColumn("_n", sizes).select(file, F.explode("_n").alias("_s")).where("_s > 0").where(F.length(file) >= F.col("_s"))
    pieces = pieces.select(file, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(file) - F.col("_s") + 1), lambda i: F.substring(F.col(file), i, F.col("_s"))))).alias("_p"))
    hit = c.withColumn("_p", F.substring(stem, 1, 8)).join(pieces, "_p").where(F.contains(F.col(file), F.col(stem))).select(stem).distinct()
    hit = hit.union(c.where(F.col(stem) == "").select(stem))
    return candidates.join(hit, stem, "left_anti")


def export_json(chunks: DataFrame, path: str) -> None:
    """One JSON object a line, non-ASCII characters kept."""
    chunks.write.mode("overwrite").json(path)
