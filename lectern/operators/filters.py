"""Predicates over chunk metadata: a small condition language compiled to columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lectern.functions.dates import date_number
from lectern.functions.text import col
from lectern.functions.vocabulary import LESSON_TYPES, SERMON_TYPES

OPS = {"$eq": lambda c, v: c == v, "$in": lambda c, v: c.isin(*v), "$gte": lambda c, v: c >= v, "$lte": lambda c, v: c <= v}


def compile_filter(where: dict | None) -> Column | None:
    """A column for {field: {op: value}}, a plain {field: value} or {"$and": [...]}; None for none."""
    if not where:
        return None
    parts: list[Column] = []
    for name, cond in where.items():
        if name == "$and":
            parts += [c for c in map(compile_filter, cond) if c is not None]
        elif isinstance(cond, dict):
            parts += [OPS[op](F.col(name), v) for op, v in cond.items()]
        else:
            parts.append(F.col(name) == cond)
    return reduce(lambda a, b: a & b, parts) if parts else None


def merge_filters(*filters: dict | None) -> dict | None:
    """One condition from several: empties dropped, nested conjunctions flattened."""
    flat: list[dict] = []
    for f in filters:
        if f:
            flat += f["$and"] if set(f) == {"$and"} else [f]
    return None if not flat else flat[0] if len(flat) == 1 else {"$and": flat}


def apply_filter(df: DataFrame, where: dict | None) -> DataFrame:
    c = compile_filter(where)
    return df if c is None else df.where(c)


def year_filter(year: int | None) -> dict | None:
    return {"year": {"$eq": year}} if year else None


def day_filter(yyyymmdd: int | None) -> dict | None:
    return {"date_numeric": {"$eq": yyyymmdd}} if yyyymmdd else None


def range_filter(first: int, last: int) -> dict:
    return {"$and": [{"date_numeric": {"$gte": first}}, {"date_numeric": {"$lte": last}}]}


def weekday_filter(day: str | None) -> dict | None:
    return {"day_of_week": {"$eq": day.lower()}} if day else None


def source_of(text: Column | str) -> Column:
    """'sermon' or 'lesson' if a text asks for one (whole words, no plurals), else null."""
    t = F.lower(col(text))
    return F.when(F.rlike(t, F.lit(r"\bsermon\b|\bmessage\b")), "sermon").when(F.rlike(t, F.lit(r"\blesson\b")), "lesson")


def source_filter(kind: str | None) -> dict | None:
    """The chunk types of a source. Video chunks belong to none."""
    types = {"sermon": SERMON_TYPES, "lesson": LESSON_TYPES}.get(kind or "")
    return {"chunk_type": {"$in": list(types)}} if types else None


def source_by_history(turns: DataFrame, last: int = 6) -> DataFrame:
    """(conv_id, source): what the newest of the last turns that says so asks for."""
    t = turns.select("conv_id", "turn", "text").distinct()
    r = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc_nulls_last("text")))
    near = t.withColumn("r", r).where(F.col("r") <= last).withColumn("s", source_of("text"))
    return near.groupBy("conv_id").agg(F.min_by("s", F.when(F.col("s").isNotNull(), F.col("r"))).alias("source"))


def date_filter(d: Column) -> Column:
    return F.col("date_numeric") == date_number(d)
