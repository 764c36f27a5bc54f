"""Contexts for an answer, and its citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lectern.functions.text import col, preview

MARK = r"\[(\d+)\]"
#: Least score of a supporting chunk, and the length below which a claim isn't checked. Fixed values.
SUPPORT, LEAST_CLAIM = -0.5, 20
#: Turns of a conversation that count. Fixed value.
LAST_TURNS = 6
SENTENCE = r"[^.!?\n]+[.!?\n]+\s*|[^.!?\n]+\z"


def context(df: DataFrame, by: str = "query_id") -> DataFrame:
    """(by, context): the numbered chunks of each answer in their order, ready for a prompt."""
    refs = F.array_join(F.coalesce("scripture_refs", F.array().cast("array<string>")), ", ")
    label = F.concat(F.lit("["), F.col("pick").cast("string"), F.lit("] "), F.coalesce("date", F.lit("")), F.lit(" — "), F.coalesce("title", F.lit("")), F.lit(" ("), F.upper(F.coalesce("chunk_type", F.lit(""))), F.lit(")"))
    label = F.concat(label, F.when(refs != "", F.concat(F.lit(" | Scriptures: "), refs)).otherwise(""))
    part = F.concat(label, F.lit("\n"), F.coalesce("text", F.lit("")))
    parts = F.array_sort(F.collect_list(F.struct("pick", part.alias("t"))))
    return df.groupBy(by).agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n\n---\n\n").alias("context"))


def cited(answer: Column | str, n: Column | int) -> Column:
    """The distinct citation numbers within 1..n, in numeric order."""
    n = F.lit(n) if isinstance(n, int) else n
    found = F.transform(F.regexp_extract_all(col(answer), F.lit(MARK), F.lit(1)), lambda x: x.try_cast("int"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: (x >= 1) & (x <= n))))


def renumber(answer: Column | str, n: Column | int) -> Column:
    """The answer with its citations numbered 1, 2, ... in numeric order, those out of range dropped.

    An answer without valid citations stays as it is.
    """
    nums = cited(answer, n)
    marked = F.aggregate(F.sequence(F.lit(1), F.size(nums)), col(answer), lambda acc, i: F.replace(acc, F.concat(F.lit("["), F.get(nums, i - 1).cast("string"), F.lit("]")), F.concat(F.lit("\u0001"), i.cast("string"), F.lit("\u0002"))))
    clean = F.regexp_replace(marked, MARK, "")
    done = F.replace(F.replace(clean, F.lit("\u0001"), F.lit("[")), F.lit("\u0002"), F.lit("]"))
    return F.when(F.size(nums) > 0, done).otherwise(col(answer))


def sentences(answer: Column | str) -> Column:
    return F.regexp_extract_all(col(answer), F.lit(SENTENCE), F.lit(0))


def bare_claim(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(sentence, r"\s*\[\d+\]\s*", " "), r"\s+", " "))


def without_marks(sentence: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(sentence, MARK, ""), r"\s+([.,!?])", "$1"), r"  +", " ")


def verify(answers: DataFrame, sources: DataFrame, score: Column, by: str = "answer_id") -> DataFrame:
    """(by, answer, removed): answers without the citations that no cited source supports.

    answers: (by, answer); sources: (by, n, text). ``score`` is a column over ``claim`` and
    ``text``. A sentence keeps all its citations if any cited source scores above SUPPORT, if its
    claim is shorter than LEAST_CLAIM, or if it cites nothing within range; else it loses all of
    them, repeats counted in ``removed``.
    """
    sent = answers.select(by, F.posexplode(sentences("answer")).alias("pos", "s"))
    sent = sent.withColumn("marks", F.transform(F.regexp_extract_all("s", F.lit(MARK), F.lit(1)), lambda x: x.try_cast("int"))).withColumn("claim", bare_claim(F.col("s")))
    asked = sent.where((F.size("marks") > 0) & (F.length("claim") >= LEAST_CLAIM)).select(by, "pos", "claim", F.explode(F.array_distinct("marks")).alias("n"))
    held = asked.join(sources, [by, "n"]).select(by, "pos", (score > SUPPORT).alias("ok")).groupBy(by, "pos").agg(F.bool_or("ok").alias("ok"))
    out = sent.join(held, [by, "pos"], "left")
    bad = F.coalesce(~F.col("ok"), F.lit(False))
    parts = F.array_sort(F.collect_list(F.struct("pos", F.when(bad, without_marks(F.col("s"))).otherwise(F.col("s")).alias("s"))))
    return out.groupBy(by).agg(F.array_join(F.transform(parts, lambda p: p["s"]), "").alias("answer"), F.sum(F.when(bad, F.size("marks")).otherwise(0)).alias("removed"))


def source_cards(df: DataFrame) -> DataFrame:
    """What is shown of a cited chunk."""
    return df.select("date", "title", "chunk_type", "score", preview("text").alias("preview"), F.array_join("topics", ", ").alias("topics"), F.col("section_type").alias("section"))


def history_window(turns: DataFrame, last: int = LAST_TURNS) -> DataFrame:
    """The last turns of each conversation; a turn delivered twice counts once."""
    t = turns.select("conv_id", "turn", "role", "text").distinct()
    r = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc_nulls_last("text"), F.desc_nulls_last("role")))
    return t.withColumn("back", r.cast("long")).where(F.col("back") <= last)


def history_digest(turns: DataFrame, last: int = 4, most: int = 300) -> DataFrame:
    """(conv_id, digest): ROLE: text lines of the last turns, each text cut to ``most``."""
    line = F.concat(F.upper(F.coalesce("role", F.lit(""))), F.lit(": "), F.substring(F.coalesce("text", F.lit("")), 1, most))
    parts = F.sort_array(F.collect_list(F.struct("back", line.alias("l"))), asc=False)
    return history_window(turns, last).groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["l"]), "\n").alias("digest"))


def empty_message(recency: Column, day: Column, year: Column, range_: Column) -> Column:
    """What is said when nothing was found, the most telling reason first."""
    return (
        F.when(recency.isNotNull() & day.isNotNull(), F.concat(F.lit("No recent "), day, F.lit(" sermon was found.")))
        .when(year.isNotNull(), F.concat(F.lit("Nothing was found for "), year.cast("string"), F.lit(".")))
        .when(range_.isNotNull(), F.concat(F.lit("Nothing was found for "), range_, F.lit(".")))
        .otherwise("Nothing relevant was found.")
    )


def truncation_notice(total: Column, shown: Column) -> Column:
    return F.when(total > shown, F.concat(F.lit("Showing "), shown.cast("string"), F.lit(" of "), total.cast("string"), F.lit(".")))
