"""Problem 1: how distinctive a term is of one record against the whole collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import folded_words
from lectern.llm.common import bit_column, has_bit, one_per_key
from lectern.session import written

BITS = 20
SALTS = 8
#: The term that counts the records; no folded term is empty.
ALL = ""


def _terms(topics: str) -> Column:
    """Distinct folded terms of an array column, never null and without empty ones."""
    folded = F.transform(F.coalesce(topics, F.array().cast("array<string>")), lambda t: F.array_join(folded_words(F.coalesce(t, F.lit(""))), " "))
    return F.array_distinct(F.filter(folded, lambda t: t != ""))


def _grams(words: Column, lengths: Column) -> Column:
    """All runs of n consecutive words, for each n > 1 of ``lengths``, joined by single spaces."""
    n = F.size(words)

    def runs(k: Column) -> Column:
        return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(words, i, k), " "))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(F.filter(lengths, lambda k: k > 1), runs))


def distinctive_terms(records: DataFrame, key: str = "chunk_id", text: str = "text", topics: str = "topics", alpha: float = 0.75) -> DataFrame:
    """Every topic of every record, scored by positive pointwise mutual information.

    Columns: ``key``, ``term`` (folded words joined by spaces), ``tf`` (times the term stands in
    the record), ``df`` (records in which it stands), ``n_records``, ``term_total`` (times it
    stands anywhere), ``n_words`` (of the record), ``ppmi`` and ``tf_idf`` = tf ln(n_records / df).

    With W words in all, the joint probability is tf / W, that of the term term_total / W, and
    that of the record n_words**alpha over the sum of that power: the exponent below 1 raises the
    share of short records, so that a term of a one-line record doesn't win by its brevity.

    Statistics cover every record. Records without key are left out; rows of equal key count
    once; null or empty texts have no words (tf 0, ppmi 0); null arrays and elements, and terms
    without a letter or digit, give no row. Other columns of the input are ignored, whatever
    their names. An empty table gives no rows.

    Plan: one shuffle of the texts, by key. Words and runs of words are then counted per record
    within the same partition and written once, the record's own terms among them; a bit filter of
    the topics, of fixed size, drops most words before. Counts per term are pre-aggregated before
    they move, and hot terms are salted.
    """
    src = records.select(F.col(key).alias("_k"), F.col(text).alias("_x"), F.col(topics).alias("_t"))
    # outer throughout, since the filter that goes with an inner explode would make its array again
    vocabulary = src.select(F.explode_outer(_terms("_t")).alias("t")).where("t is not null")
    filter_ = bit_column(vocabulary, F.xxhash64("t"), BITS)
    lengths = vocabulary.agg(F.coalesce(F.collect_set(F.size(F.split("t", " "))), F.array().cast("array<int>"))).scalar()

    recs = one_per_key(src, "_k", ["_x", "_t"]).select("_k", folded_words(F.coalesce("_x", F.lit(""))).alias("w"), "_t")
    recs = recs.withColumn("_bits", filter_).withColumn("_lengths", lengths)

    def units(w: Column, terms: Column) -> Column:
        """(g, c, own): the words and runs that may be a term, the terms of the record itself, and
        the number of words; c is how often."""
        unit = lambda g, c, own: F.struct(g.alias("g"), c.cast("long").alias("c"), F.lit(own).alias("own"))
        hit = F.filter(F.concat(w, _grams(w, F.col("_lengths"))), lambda g: has_bit(F.col("_bits"), F.xxhash64(g), BITS))
        return F.concat(F.array(unit(F.lit(ALL), F.size(w), False)), F.transform(hit, lambda g: unit(g, F.lit(1), False)), F.transform(terms, lambda g: unit(g, F.lit(0), True)))

    rows = recs.select("_k", F.size("w").cast("long").alias("n_words"), F.explode_outer(units(F.col("w"), _terms("_t"))).alias("u"))
    joint = written(rows.groupBy("_k", F.col("u.g").alias("g")).agg(F.sum("u.c").alias("tf"), F.max("u.own").alias("own"), F.max("n_words").alias("n_words")))
    stats = joint.where("tf > 0 or g = ''").groupBy("g").agg(F.count("*").alias("df"), F.sum("tf").alias("total"), F.sum(F.pow("tf", F.lit(alpha))).alias("smooth"))
    whole = stats.agg(F.max(F.when(F.col("g") == ALL, F.struct("df", "smooth")))).scalar()

    salt = F.pmod(F.xxhash64("_k"), F.lit(SALTS)).cast("int")
    own = joint.where("own").select("_k", "n_words", "g", "tf", salt.alias("salt"))
    spread = stats.where(F.col("g") != ALL).select("g", "df", "total", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    out = own.join(spread, ["g", "salt"], "left").withColumn("_all", whole)
    there = F.col("tf") > 0
    pmi = F.log(F.col("tf") * F.col("_all.smooth") / (F.col("total") * F.pow("n_words", F.lit(alpha))))
    return out.select(
        F.col("_k").alias(key), F.col("g").alias("term"), "tf",
        F.coalesce("df", F.lit(0)).cast("long").alias("df"), F.col("_all.df").alias("n_records"),
        F.coalesce("total", F.lit(0)).cast("long").alias("term_total"), "n_words",
        F.when(there, F.greatest(F.lit(0.0), pmi)).otherwise(0.0).alias("ppmi"),
        F.when(there, F.col("tf") * F.log(F.col("_all.df") / F.col("df"))).otherwise(0.0).alias("tf_idf"),
    )


def leading_term(scored: DataFrame, key: str = "chunk_id", least_terms: int = 3, lead: float = 2.0) -> DataFrame:
    """The term of each record, of those with positive mutual information, whose tf_idf is above 0
    and at least ``lead`` times that of every other term.

    Records with fewer than ``least_terms`` terms have none, nor do ties unless ``lead`` is 1.
    """
    best = F.max(F.struct(F.col("tf_idf").alias("s"), F.col("term").alias("t"), F.col("ppmi")))
    top = scored.groupBy(key).agg(F.count("*").alias("n"), best.alias("b"), F.slice(F.sort_array(F.collect_list("tf_idf"), False), 2, 1).alias("next"))
    ok = (F.col("n") >= least_terms) & (F.col("b.ppmi") > 0) & (F.col("b.s") > 0) & (F.col("b.s") >= lead * F.coalesce(F.get("next", F.lit(0)), F.lit(0.0)))
    return top.where(ok).select(key, F.col("b.t").alias("term"))
