"""What several operators of this package share."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_per_key(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """One row per non-null ``key``: of rows that differ, the greatest by ``cols`` (nulls last).

    The maximum is taken before the shuffle as well, so a key that holds a third of all rows
    arrives as one row per task.
    """
    best = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*cols)).alias("_r"))
    return best.select(key, *(F.col(f"_r.{c}").alias(c) for c in cols))


def pairs_within(rows: DataFrame, group: str, member: str, size: Column, block: int = 2048) -> DataFrame:
    """(group, a, b): all pairs a < b of the members of a group; rows are distinct (group, member).

    ``size`` is a column with the number of members of the row's group. A group of more than
    ``block`` members is divided into blocks by hash, and every pair of blocks is a join key of its
    own, so its pairs are made by as many tasks as it has pairs of blocks.
    """
    n = F.ceil(size / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(member), n).cast("int")
    every = F.explode(F.sequence(F.lit(0), n - 1))
    left = rows.select(group, F.col(member).alias("a"), own.alias("_i"), every.alias("_j"))
    right = rows.select(group, F.col(member).alias("b"), own.alias("_j"), every.alias("_i"))
    return left.join(right, [group, "_i", "_j"]).where("a < b").select(group, "a", "b")


# -- bounded membership filters ---------------------------------------------------------
# A filter is a bit per hash value modulo 2**bits: its size is fixed whatever the data, and it
# never rejects a member. It only spares work; an exact join always follows.


def bit_words(df: DataFrame, h: Column, bits: int) -> DataFrame:
    """(w, b): the non-empty 64-bit words of the filter over ``h``; 2**(bits-6) rows at most."""
    slot = h.bitwiseAND(F.lit((1 << bits) - 1))
    return df.select(F.shiftright(slot, 6).alias("w"), F.expr("1L").alias("o"), slot.alias("s")).groupBy("w").agg(F.expr("bit_or(shiftleft(o, cast(s & 63L as int)))").alias("b"))


def bit_column(df: DataFrame, h: Column, bits: int) -> Column:
    """The filter as a scalar subquery: an array of 2**(bits-6) longs."""
    spark = df.sparkSession
    every = spark.range(0, 1 << (bits - 6), 1, 1).withColumnRenamed("id", "w")
    rows = every.join(bit_words(df, h, bits), "w", "left")
    return rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", F.coalesce("b", F.lit(0)).alias("b")))), lambda x: x["b"]).alias("bits")).scalar()


def has_bit(filter_: Column, h: Column, bits: int) -> Column:
    slot = h.bitwiseAND(F.lit((1 << bits) - 1))
    return F.call_function("bit_get", F.get(filter_, F.shiftright(slot, 6).cast("int")), slot.bitwiseAND(F.lit(63)).cast("int")) == 1


def bit_array(df: DataFrame, h: Column, bits: int) -> np.ndarray:
    """The filter on the driver, as uint64 words (2**(bits-3) bytes), for Python workers."""
    out = np.zeros(1 << (bits - 6), np.uint64)
    got = bit_words(df, h, bits).toPandas()
    out[got["w"].to_numpy(np.int64)] = got["b"].to_numpy(np.int64).view(np.uint64)
    return out


def bit_test(filter_: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Boolean mask of the 64-bit values ``h`` that may be in the filter."""
    slot = h.astype(np.uint64) & np.uint64(len(filter_) * 64 - 1)
    return (filter_[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) != 0
