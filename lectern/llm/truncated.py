"""Problem 9: texts cut off by field limits, by final trigrams that are frequent inside and rare at ends.

Tokens are runs of non-whitespace within a line. A token is itself if it is frequent, and
otherwise its class: a word, one that ends a sentence, one in brackets, a number. Every token of
every text has one gram of three tokens:

- the two tokens before it and its class, so a text cut inside a word ends in the same gram as one
  cut after it;
- before the end of a line's first sentence, the two tokens that open the line and its class, since
  headings and closing lines are told by how they begin.

How often a gram stands in all texts and how often it is the last of one are counted over all
texts. A whole sentence ends a text far more often than the average token does, a broken one
hardly ever; the text's own end is left out of its counts. A gram that is too seldom to tell is
judged by two tokens, then by classes alone. What follows a cut in transfer (dots, half an entity,
a replacement character, a link) is taken off first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.session import spread, written

#: What a transfer leaves behind a cut, at the end of a text.
LEFT = r"(?is)(?:\s|�|\[(?:\.\.\.|…|truncated)\]|(?:\.\.\.|…)\s*(?:read more|continue reading|more)?|&(?:[a-z]{1,6}|#\d{0,6})?;?|<[^<>]*>?)+\z"
SENTENCE_END = r"[.!?。！？][\"')\]”’»]*\z"
#: A last sentence that opens a quotation and ends without closing it.
OPEN_QUOTE = r"(?:\A|[.!?][\"')\]”’»]*\s)\s*\"[^\"]*\z"
#: Frequent tokens that stand for themselves, and frequent first tokens of last lines.
COMMON, OPENERS = 40, 40
#: Other places at which a gram must stand to be told by itself: with a line's opening, with the tokens before.
LEAST_OPEN, LEAST_INSIDE = 3, 100
#: What a sentence may end with.
CLOSERS = (".", "!", "?", "。", "！", "？", '"', "'", ")", "]", "”", "’", "»")
#: Characters looked at first; what may need more is looked at whole.
TAIL = 96
#: Class names: a word, one that ends a sentence, one in brackets, a number, one that ends a
#: sentence. Tokens are lower-cased, so none is a class name.
WORD, END, BRACKET, NUMBER, LAST_NUMBER = CLASSES = ("W", "E", "B", "N", "M")


def _let(c: Column, body) -> Column:
    """``body`` of the value of ``c``, which is computed once however often it is used."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def _low(x: Column | str) -> Column:
    """Lower-cased, with blanks for all whitespace but line breaks: split by plain characters from here on."""
    out = F.lower(x)
    for c in "\t\r\f\x0b":
        out = F.replace(out, F.lit(c), F.lit(" "))
    return out


def _tokens(c: Column) -> Column:
    return F.array_remove(F.split(c, " "), "")


def _with_core(x: str, body) -> Column:
    """``body`` of the core of a text column. Each value is bound once, as functions of arrays
    evaluate what they are given without sharing its parts."""
    return _let(_low(x), lambda low: _let(_core(low), body))


def _open_tag(x: Column) -> Column:
    return F.contains(x, F.lit("<")) & ~F.contains(F.substring_index(x, "<", -1), F.lit(">"))


def _core(x: Column) -> Column:
    """The lower-cased text without what a transfer left behind it.

    Few endings are such that something can be taken off, and of these few take more than the last
    characters: only a tag has any length, so one that is left open is looked at with the whole text.
    """
    maybe = F.contains(F.right(x, F.lit(8)), F.lit("&")) | _open_tag(x)
    for end in (" ", "\n", "�", "]", "…", ";", ">", "...", "more", "reading"):
        maybe = maybe | F.endswith(x, F.lit(end))
    whole = F.regexp_replace(x, LEFT, "")

    def joined(tail: Column) -> Column:
        return _let(F.concat(F.substring(x, F.lit(1), F.length(x) - TAIL), tail), lambda c: F.when(_open_tag(c), whole).otherwise(c))

    short = lambda t: F.when(F.length(t) > TAIL // 3, joined(t)).otherwise(whole)
    return F.when(~maybe, x).when(F.length(x) <= TAIL, whole).otherwise(_let(F.regexp_replace(F.right(x, F.lit(TAIL)), LEFT, ""), short))


def _line(core: Column) -> Column:
    """The last line; within an open quotation it doesn't end a sentence."""
    return _let(F.substring_index(core, "\n", -1), lambda x: F.when(F.rlike(x, F.lit(OPEN_QUOTE)), F.regexp_replace(x, SENTENCE_END, "")).otherwise(x))


def _ends(t: Column) -> Column:
    return F.substring(t, -1, 1).isin(*CLOSERS) & F.rlike(t, F.lit(SENTENCE_END))


def _class(t: Column) -> Column:
    digit = (t >= "0") & (t < ":")
    return F.when(_ends(t), F.when(digit, LAST_NUMBER).otherwise(END)).when(digit, NUMBER).when(F.startswith(t, F.lit("(")), BRACKET).otherwise(WORD)


def _frequent(base: DataFrame, common: int, openers: int) -> tuple[list[str], list[str]]:
    """The most frequent tokens, and the most frequent first tokens of last lines that end no
    sentence, of those that neither end a sentence nor begin with a digit: two short lists."""

    def marked(x: Column) -> Column:
        first = _let(_line(x), lambda line: F.when(~F.rlike(line, F.lit(SENTENCE_END)), F.get(_tokens(line), F.lit(0))))
        return F.array_append(_tokens(F.replace(x, F.lit("\n"), F.lit(" "))), F.concat(F.lit(" "), F.coalesce(first, F.lit(""))))

    # outer, since the filter that goes with an inner explode would make its array again
    tokens = base.select(F.explode_outer(_with_core("_x", marked)).alias("t"))
    # an aggregate, so that no filter goes below the count and both lists come from one
    counts = tokens.groupBy("t").agg(F.count("*").alias("count"), F.max(F.startswith("t", F.lit(" "))).alias("opens"))
    counts = counts.where("opens is not null").where(~F.trim("t").rlike(r"^(?:[0-9]|\z)") & ~F.rlike("t", F.lit(SENTENCE_END)))
    head = lambda own, most: counts.where(own).orderBy(F.desc("count"), "t").limit(most).select("t")
    both = [r["t"] for r in head(~F.col("opens"), common).unionAll(head(F.col("opens"), openers)).collect()]
    return [t for t in both if t[0] != " "], [t[1:] for t in both if t[0] == " "]


def _grams(tokens: Column, common: list[str], openers: list[str], last: bool = False) -> Column:
    """The gram of every token of a line, or of its last token: ``^ first second place token`` before
    the end of its first sentence, place being 0, 1 or 2 for further, else the token after up to two others."""
    own = F.transform(tokens, lambda t: F.when(t.isin(common), t).otherwise(_class(t)))

    def line(c: Column) -> Column:
        ends = [F.nullif(F.array_position(c, k), F.lit(0).cast("long")) for k in (END, LAST_NUMBER)]
        opens = [_let(F.get(tokens, F.lit(k)), lambda t, k=k: F.when(t.isin(openers), t).otherwise(F.get(c, F.lit(k)))) for k in (0, 1)]
        head = F.struct(F.coalesce(F.least(*ends), F.lit(1 << 40)).alias("first"), F.concat(F.lit("^ "), opens[0], F.lit(" - 0 ")).alias("zero"), F.concat(F.lit("^ "), opens[0], F.lit(" "), opens[1], F.lit(" ")).alias("one"))

        def gram(x: Column, i: Column, h: Column) -> Column:
            opening = F.when(i == 0, F.concat(h["zero"], x)).when(i == 1, F.concat(h["one"], F.lit("1 "), x)).otherwise(F.concat(h["one"], F.lit("2 "), x))
            blank = F.lit(" ")
            inside = F.when(i > 1, F.concat(F.get(c, i - 2), blank, F.get(c, i - 1), blank, x)).when(i == 1, F.concat(F.get(c, i - 1), blank, x)).otherwise(x)
            return F.when(i + 1 < h["first"], opening).otherwise(inside)

        if last:
            return _let(head, lambda h: gram(F.try_element_at(c, F.lit(-1)), F.size(c) - 1, h))
        return _let(head, lambda h: F.transform(c, lambda x, i: gram(x, i, h)))

    return _let(own, line)


def _shorter(grams: DataFrame) -> DataFrame:
    """``grams`` with g1, g2, g3 and least: the gram with the class of its last token, the two
    shorter ones, and how often the first must stand elsewhere to tell."""
    p = F.split("g", " ")
    kind = lambda c: F.when(c.isin(*CLASSES), c).otherwise(WORD)
    x, b, opening = kind(F.element_at(p, -1)), F.try_element_at(p, F.lit(-2)), F.startswith("g", F.lit("^ "))
    one, place = F.get(p, F.lit(1)), F.least(F.get(p, F.lit(3)), F.lit("1"))
    before = F.array_join(F.slice(p, 1, F.size(p) - 1), " ")
    return grams.select(
        "*", F.concat_ws(" ", before, x).alias("g1"),
        F.when(opening, F.concat_ws(" ", F.lit("^"), one, place, x)).otherwise(F.concat_ws(" ", F.lit("|"), b, x)).alias("g2"),
        F.when(opening, F.concat_ws(" ", F.lit("^^"), kind(one), place, x)).otherwise(F.concat_ws(" ", F.lit("||"), kind(b), x)).alias("g3"),
        F.when(opening, LEAST_OPEN).otherwise(LEAST_INSIDE).alias("least"),
    )


def endings(docs: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source", rare: float = 1.5, common: int = COMMON, openers: int = OPENERS) -> DataFrame:
    """(doc, source, cut, at_limit, leftover, inside, final): how each text ends.

    cut tells that the running text breaks off; at_limit that its length is one at which an
    unusual share of its source's texts end; leftover that something of a transfer follows.
    inside and final count the gram that decided, in all other places and at all other ends.

    A text is cut if its last gram ends at most ``rare`` times as large a share of its places as
    the average token does. Where even its classes stand in fewer than LEAST_OPEN other places, a
    token that ends a sentence ends a text.

    Null texts give no row; empty and blank ones are not cut. Rows of equal id are judged each
    for itself and come once if equal. Null sources are one source. Other columns are ignored. An
    empty table gives no rows.

    Counts are pre-aggregated before they move; the grams are hashes of few frequent tokens and
    classes, so their number doesn't grow with the texts, and the join back is on the last ones.
    """
    base = spread(docs.select(F.col(doc).alias("_d"), F.col(source).alias("_s"), F.col(text).alias("_x")).where("_x is not null"))
    known = _frequent(base, common, openers)

    def counted(core: Column) -> Column:
        """All grams of a text, and the last one again with a mark before it."""
        before = F.substring(core, F.lit(1), F.length(core) - F.length(F.substring_index(core, "\n", -1)))
        lines = F.filter(F.transform(F.array_append(F.split(before, "\n"), _line(core)), _tokens), lambda x: F.size(x) > 0)
        every = F.flatten(F.transform(lines, lambda x: _grams(x, *known)))
        return _let(every, lambda e: F.array_append(e, F.concat(F.lit("$"), F.try_element_at(e, F.lit(-1)))))

    grams = base.select(_with_core("_x", lambda c: F.when(F.rlike(c, F.lit(r"\S")), counted(c))).alias("g")).select(F.explode_outer("g").alias("g")).where("g is not null")
    counts = grams.groupBy("g").agg(F.count("*").alias("n"))
    final = F.startswith("g", F.lit("$"))
    own = counts.select(F.when(final, F.substring("g", 2, 1 << 30)).otherwise(F.col("g")).alias("g"), F.when(final, 0).otherwise(F.col("n")).alias("n"), F.when(final, F.col("n")).otherwise(0).alias("t"))
    stat = written(_shorter(own.groupBy("g").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))))

    seen = _with_core("_x", lambda core: F.when(core != "", F.struct(
        _let(_tokens(_line(core)), lambda t: _grams(t, *known, last=True)).alias("g"), F.rlike(_line(core), F.lit(SENTENCE_END)).alias("ends"),
        F.rlike(F.substring("_x", F.length(core) + 1, F.lit(1 << 30)), F.lit(r"\S")).alias("leftover"),
    )))
    # as it stands, since a filter or a field taken here would compute it again
    f = written(base.select("_d", "_s", F.length("_x").alias("size"), seen.alias("e"))).where("e is not null").select("_d", "_s", "size", "e.*")

    # the few grams that end texts, and what each comes to
    one = stat.groupBy("g1").agg(F.sum("n").alias("n1"), F.sum("t").alias("t1"))
    two = stat.groupBy("g2").agg(F.sum("n").alias("n2"), F.sum("t").alias("t2"))
    three = stat.groupBy("g3").agg(F.sum("n").alias("n3"), F.sum("t").alias("t3"))
    whole = stat.agg(F.struct(F.sum("n").alias("n"), F.sum("t").alias("t"))).scalar()
    last = stat.where("t > 0").join(one, "g1").join(two, "g2").join(three, "g3").withColumn("_all", whole)
    level = F.when(F.col("n1") > F.col("least"), 1).when(F.col("n2") > F.col("least"), 2).when(F.col("n3") > LEAST_OPEN, 3).otherwise(0)
    pick = lambda c: F.when(level == 1, F.col(f"{c}1")).when(level == 2, F.col(f"{c}2")).otherwise(F.col(f"{c}3")) - 1
    last = last.select("g", level.alias("level"), pick("n").alias("inside"), pick("t").alias("final"), F.col("_all"))
    low = F.col("final") * F.col("_all.n") <= rare * F.col("inside") * F.col("_all.t")

    total = f.groupBy("_s").agg(F.count("*").alias("n_source"))
    spike = f.groupBy("_s", "size").agg(F.count("*").alias("n_size"))
    limits = spike.join(total, spike["_s"].eqNullSafe(total["_s"])).where("n_size >= 5 and n_size >= 0.04 * n_source").select(spike["_s"].alias("ls"), F.col("size").alias("lsize"), F.lit(True).alias("at_limit"))
    out = f.join(last, "g").join(limits, F.col("_s").eqNullSafe(F.col("ls")) & (F.col("size") == F.col("lsize")), "left")
    cut = F.when(F.col("level") > 0, low).otherwise(~F.col("ends"))
    return out.select(F.col("_d").alias(doc), F.col("_s").alias(source), cut.alias("cut"), F.coalesce("at_limit", F.lit(False)).alias("at_limit"), "leftover", "inside", "final").distinct()


def cut_rates(found: DataFrame, source: str = "source") -> DataFrame:
    """(source, n_texts, n_cut, cut_share, limit): how often each source truncates.

    limit tells that most of the source's cut texts end at a length of its own.
    """
    n = F.count("*")
    hit = F.sum(F.col("cut").cast("long"))
    return found.groupBy(source).agg(n.alias("n_texts"), hit.alias("n_cut"), (hit / n).alias("cut_share"), (F.sum((F.col("cut") & F.col("at_limit")).cast("long")) * 2 > hit).alias("limit"))
