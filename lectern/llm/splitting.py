"""Problem 3: splitting oversized texts at natural boundaries, by pointer doubling.

A cut at word p is followed by a piece that starts ``overlap`` words earlier, so the next cut
depends on p alone: every possible cut has one successor. Squaring the successor table doubles
the steps it jumps, so all cuts of a text of n words are known after log2(n) joins, however they
depend on each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lectern.llm.common import one_per_key
from lectern.session import written

#: A word with the whitespace after it.
WORD_GAP = r"(?U)\S+\s*"
SENTENCE_END = "(?U)[.!?][\"')\\]”’]*\\s*$"


def boundaries(records: DataFrame, key: str, text: str, limit: int, overlap: int, least: int) -> DataFrame:
    """(_k, n, pos, kind): where the oversized texts may be cut; pos words precede the cut.

    kind 2 is a paragraph break, 1 a sentence end, 0 any other word, -1 the virtual cut before
    the first piece. Kind 0 is given only for texts that have ``least``.. ``limit`` words somewhere
    without a boundary, since only there a cut can fall between words at the limit.
    """
    long = records.where(F.length(text) > 2 * limit).select(F.col(key).alias("_k"), F.col(text).alias("_x"))
    long = long.where(F.size(F.regexp_extract_all("_x", F.lit(WORD_GAP), F.lit(0))) > limit)
    one = one_per_key(long, "_k", ["_x"]).select("_k", F.regexp_extract_all("_x", F.lit(WORD_GAP), F.lit(0)).alias("w"))
    newlines = lambda t: F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    kinds = F.transform("w", lambda t: F.when(newlines(t) >= 2, 2).when(F.rlike(t, F.lit(SENTENCE_END)), 1).otherwise(0))
    one = one.select("_k", F.size("w").alias("n"), kinds.alias("kind"))
    each = one.select("_k", "n", F.posexplode_outer("kind").alias("i", "kind")).where("i is not null").select("_k", "n", (F.col("i") + 1).alias("pos"), "kind")
    natural = each.where("kind > 0")
    start = one.select("_k", "n", F.lit(overlap).alias("pos"), F.lit(-1).alias("kind"))
    ends = one.select("_k", "n", F.col("n").alias("pos"), F.lit(0).alias("kind"))
    by = Window.partitionBy("_k").orderBy("pos")
    gaps = natural.select("_k", "n", "pos").unionByName(start.select("_k", "n", F.lit(0).alias("pos"))).unionByName(ends.select("_k", "n", "pos"))
    bare = gaps.withColumn("next", F.lead("pos").over(by)).where(F.col("next") - F.col("pos") >= limit - least).select("_k").distinct()
    return natural.unionByName(start).unionByName(each.where("kind = 0").join(bare, "_k", "left_semi"))


def successors(points: DataFrame, limit: int, overlap: int, least: int) -> DataFrame:
    """(_k, pos, nxt): the next cut after a cut at pos; no row where the rest is one piece."""
    by = Window.partitionBy("_k").orderBy("pos").rangeBetween(least + 1 - overlap, limit - overlap)
    last = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("pos"))).over(by)
    far = F.col("pos") + (limit - overlap)
    return points.select("_k", "n", "pos", F.coalesce(last(2), last(1), far).alias("nxt")).where(F.col("n") > far).select("_k", "pos", "nxt").distinct()


def cuts(records: DataFrame, key: str = "chunk_id", text: str = "text", limit: int = 400, overlap: int = 75, least: int = 200) -> DataFrame:
    """(key, cut_word): every cut of the texts of more than ``limit`` words.

    A piece that starts after s words and has more than ``limit`` words left ends at the last
    paragraph break in s + least + 1 .. s + limit, else at the last sentence end there, else at
    s + limit; the next piece starts ``overlap`` words before. Null and short texts give no row,
    nor do null keys; rows of equal key count once (of different texts the greatest). Other
    columns, a word count among them, are ignored.
    """
    if not 0 <= overlap <= least < limit:
        raise ValueError("0 <= overlap <= least < limit must hold")
    jump = written(successors(boundaries(records, key, text, limit, overlap, least), limit, overlap, least))
    found = written(jump.where(F.col("pos") == overlap).join(written(jump.select("_k").distinct()), "_k", "left_semi").select("_k", F.col("pos").alias("at")).distinct())
    while not jump.isEmpty():
        step = found.join(jump, (found["_k"] == jump["_k"]) & (found["at"] == jump["pos"])).select(found["_k"], F.col("nxt").alias("at"))
        found = written(found.union(step).distinct())
        a, b = jump.alias("a"), jump.alias("b")
        jump = written(a.join(b, (F.col("a._k") == F.col("b._k")) & (F.col("a.nxt") == F.col("b.pos"))).select("a._k", "a.pos", "b.nxt"))
    return found.where(F.col("at") > overlap).select(F.col("_k").alias(key), F.col("at").cast("long").alias("cut_word"))


def pieces(records: DataFrame, key: str = "chunk_id", text: str = "text", limit: int = 400, overlap: int = 75, least: int = 200) -> DataFrame:
    """(key, piece_index, first_word, word_count, text): the pieces of the oversized texts.

    piece_index counts from 0, first_word is the number of words before the piece. A piece keeps
    the whitespace between its words.
    """
    at = cuts(records, key, text, limit, overlap, least).select(F.col(key).alias("_k"), "cut_word")
    long = records.where(F.length(text) > 2 * limit).select(F.col(key).alias("_k"), F.col(text).alias("_x"))
    long = long.where(F.size(F.regexp_extract_all("_x", F.lit(WORD_GAP), F.lit(0))) > limit)
    one = one_per_key(long, "_k", ["_x"]).select("_k", F.regexp_extract_all("_x", F.lit(WORD_GAP), F.lit(0)).alias("w"))
    by = Window.partitionBy("_k").orderBy("cut_word")
    ends = at.union(one.select("_k", F.size("w").cast("long")))
    spans = ends.select("_k", F.coalesce(F.lag("cut_word").over(by) - overlap, F.lit(0)).alias("s"), F.col("cut_word").alias("e"), (F.row_number().over(by) - 1).cast("long").alias("i"))
    body = F.array_join(F.slice("w", (F.col("s") + 1).cast("int"), (F.col("e") - F.col("s")).cast("int")), "")
    return spans.join(one, "_k").select(F.col("_k").alias(key), F.col("i").alias("piece_index"), F.col("s").cast("long").alias("first_word"), (F.col("e") - F.col("s")).cast("long").alias("word_count"), F.regexp_replace(body, r"(?U)\s+$", "").alias("text"))
