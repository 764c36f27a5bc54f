"""Cleaned text to typed paragraphs to overlapping chunks. All of it stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lectern.functions import patterns
from lectern.functions.text import space_words

#: Words per chunk, overlap, shortest paragraph, scripture context and shortest chunk. Fixed values.
TARGET, OVERLAP, SHORT, AROUND, TINY = 400, 75, 5, 50, 20
ORPHAN = r"^\[[^\]]*\d+:\d+[^\]]*\]$"


def words_in(c: Column) -> Column:
    return F.size(space_words(c))


def header(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with date, title and body: leading DATE: and TITLE: lines in any order, the last
    of each counting. A text without body has an empty one."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\r?\n")
    head = F.aggregate(lines, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on"), F.lit("").alias("date"), F.lit("").alias("title")), lambda a, x: F.when(a["on"] & F.startswith(x, F.lit("DATE:")), F.struct((a["n"] + 1).alias("n"), F.lit(True).alias("on"), F.trim(F.substring(x, 6, 1 << 30)).alias("date"), a["title"].alias("title"))).when(a["on"] & F.startswith(x, F.lit("TITLE:")), F.struct((a["n"] + 1).alias("n"), F.lit(True).alias("on"), a["date"].alias("date"), F.trim(F.substring(x, 7, 1 << 30)).alias("title"))).otherwise(F.struct(a["n"].alias("n"), F.lit(False).alias("on"), a["date"].alias("date"), a["title"].alias("title"))))
    d = docs.withColumn("_l", lines).withColumn("_h", head)
    body = F.array_join(F.slice("_l", F.col("_h.n") + 1, F.greatest(F.size("_l") - F.col("_h.n"), F.lit(0))), "\n")
    return d.select(*docs.columns, F.col("_h.date").alias("date"), F.col("_h.title").alias("title"), body.alias("body")).drop(text)


def blocks(body: Column | str) -> Column:
    """Blocks between whitespace-only lines, trimmed, empty ones left out."""
    b = F.col(body) if isinstance(body, str) else body
    return F.filter(F.transform(F.split(b, r"\n[ \t\r]*\n\s*"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: x != "")


def merge_orphans(b: Column) -> Column:
    """A block that is only a reference tag is glued to the next block, pairs from left to right."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("held"))

    def step(a: Column, x: Column) -> Column:
        glued = F.struct(F.concat(a["done"], F.array(F.concat_ws(" ", a["held"], x))).alias("done"), F.lit(None).cast("string").alias("held"))
        hold = F.struct(a["done"].alias("done"), x.alias("held"))
        plain = F.struct(F.concat(a["done"], F.array(x)).alias("done"), F.lit(None).cast("string").alias("held"))
        return F.when(a["held"].isNotNull(), glued).when(F.rlike(x, F.lit(ORPHAN)), hold).otherwise(plain)

    return F.aggregate(b, start, step, lambda a: F.when(a["held"].isNotNull(), F.concat(a["done"], F.array(a["held"]))).otherwise(a["done"]))


def collapse_videos(b: Column) -> Column:
    """(type, video_index, text) per block: blocks between video marks become one video block,
    counted by end marks; an open span is dropped, an empty one gives nothing."""
    item = lambda kind, n, t: F.struct(F.lit(kind).alias("type"), n.cast("int").alias("video_index"), t.alias("text"))
    none = F.lit(None).cast("int")
    start = F.struct(F.slice(F.array(item("block", none, F.lit(""))), 1, 0).alias("done"), F.lit(False).alias("open"), F.array().cast("array<string>").alias("held"), F.lit(0).alias("n"))

    def state(done: Column, open_: Column, held: Column, n: Column) -> Column:
        return F.struct(done.alias("done"), open_.alias("open"), held.alias("held"), n.alias("n"))

    def step(a: Column, x: Column) -> Column:
        empty = F.array().cast("array<string>")
        closed = F.when(F.size(a["held"]) > 0, F.concat(a["done"], F.array(item("video", a["n"] + 1, F.array_join(a["held"], " "))))).otherwise(a["done"])
        return (
            F.when(F.rlike(x, F.lit(patterns.VIDEO_START)), state(a["done"], F.lit(True), empty, a["n"]))
            .when(F.rlike(x, F.lit(patterns.VIDEO_END)), state(F.when(a["open"], closed).otherwise(a["done"]), F.lit(False), empty, a["n"] + 1))
            .when(a["open"], state(a["done"], F.lit(True), F.concat(a["held"], F.array(x)), a["n"]))
            .otherwise(state(F.concat(a["done"], F.array(item("block", none, x))), F.lit(False), empty, a["n"]))
        )

    return F.aggregate(b, start, step, lambda a: a["done"])


def typed(items: Column) -> Column:
    """Blocks as paragraphs: scripture where a reference tag leads, otherwise sermon."""

    def one(x: Column) -> Column:
        ref = F.regexp_extract(x["text"], patterns.REFERENCE_TAG, 1)
        is_ref = (x["type"] == "block") & (ref != "")
        body = F.regexp_replace(F.regexp_extract(x["text"], patterns.REFERENCE_TAG, 2), r"^\s+|\s+$", "")
        return F.struct(F.when(x["type"] == "video", "video").when(is_ref, "scripture").otherwise("sermon").alias("type"), F.when(is_ref, F.trim(ref)).alias("ref"), x["video_index"].alias("video_index"), F.when(is_ref, F.trim(F.concat(F.lit("["), F.trim(ref), F.lit("] "), body))).otherwise(x["text"]).alias("text"))

    return F.transform(items, one)


def parse(docs: DataFrame, key: str = "source_file", text: str = "text") -> DataFrame:
    """(key, date, title, paragraphs) of cleaned texts; a text without body has no paragraphs."""
    h = header(docs.select(key, text), text)
    return h.select(key, "date", "title", typed(collapse_videos(merge_orphans(blocks("body")))).alias("paragraphs"))


def merge_short(paras: Column) -> Column:
    """Sermon paragraphs of fewer than SHORT words go to the end of a sermon paragraph before them."""
    empty = F.slice(paras, 1, 0)

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joins = (F.size(acc) > 0) & (x["type"] == "sermon") & (words_in(x["text"]) < SHORT) & (F.try_element_at(acc, F.lit(-1))["type"] == "sermon")
        longer = F.struct(last["type"].alias("type"), last["ref"].alias("ref"), last["video_index"].alias("video_index"), F.concat_ws(" ", last["text"], x["text"]).alias("text"))
        return F.when(joins, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(paras, empty, step)


def pack(texts: Column) -> Column:
    """Greedy packing of paragraph texts: a chunk is closed when the next paragraph would bring it
    to TARGET words or more. Returns arrays of texts; a single longer paragraph is not split."""
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("cur"), F.lit(0).alias("n"))

    def step(a: Column, t: Column) -> Column:
        w = words_in(t)
        full = (F.size(a["cur"]) > 0) & (a["n"] + w >= TARGET)
        return F.when(full, F.struct(F.concat(a["done"], F.array(a["cur"])).alias("done"), F.array(t).alias("cur"), w.alias("n"))).otherwise(F.struct(a["done"].alias("done"), F.concat(a["cur"], F.array(t)).alias("cur"), (a["n"] + w).alias("n")))

    return F.aggregate(texts, start, step, lambda a: F.when(F.size(a["cur"]) > 0, F.concat(a["done"], F.array(a["cur"]))).otherwise(a["done"]))


def packed_rows(docs: DataFrame, key: str, texts: str) -> DataFrame:
    """(key, k, text): packed chunks with the overlap of the chunk before, tiny ones dropped.

    The overlap is the last OVERLAP words of the previous chunk's last paragraph, or all of it as
    it stands when shorter; a dropped chunk's overlap is still carried on.
    """
    rows = docs.select(key, F.posexplode_outer(pack(F.col(texts))).alias("k", "ps")).where("k is not null")
    last = F.lag(F.element_at("ps", -1)).over(Window.partitionBy(key).orderBy("k"))
    ws = space_words(F.col("_last"))
    tail = F.when(F.size(ws) <= OVERLAP, F.col("_last")).otherwise(F.array_join(F.slice(ws, F.greatest(F.size(ws) - OVERLAP + 1, F.lit(1)), OVERLAP), " "))
    body = F.array_join("ps", "\n\n")
    full = F.when(F.col("_last").isNull(), body).otherwise(F.concat(tail, F.lit("\n\n"), body))
    return rows.withColumn("_last", last).select(key, "k", full.alias("text")).where(words_in(F.col("text")) >= TINY)


def scripture_rows(docs: DataFrame, key: str, paras: str) -> DataFrame:
    """(key, pos, kind, ref, text): scripture blocks amid AROUND sermon words on either side, and
    video blocks as they are."""
    near = lambda part: F.flatten(F.transform(F.filter(part, lambda p: p["type"] == "sermon"), lambda p: space_words(p["text"])))
    rows = docs.select(key, paras, F.posexplode(paras).alias("pos", "p")).where("p.type <> 'sermon'")
    before, after = near(F.slice(paras, 1, F.col("pos"))), near(F.slice(paras, F.col("pos") + 2, F.size(paras)))
    lead = F.slice(before, F.greatest(F.size(before) - AROUND + 1, F.lit(1)), AROUND)
    text = F.concat_ws("\n\n", F.nullif(F.array_join(lead, " "), F.lit("")), F.col("p.text"), F.nullif(F.array_join(F.slice(after, 1, AROUND), " "), F.lit("")))
    return rows.select(key, "pos", F.col("p.type").alias("kind"), F.col("p.ref").alias("ref"), F.when(F.col("p.type") == "scripture", text).otherwise(F.col("p.text")).alias("text"))


def chunk_id(key: Column | str, index: Column | str) -> Column:
    return F.md5(F.concat_ws("_", key, F.col(index).cast("string") if isinstance(index, str) else index.cast("string")))


def section_type(index: Column, total: Column) -> Column:
    ratio = index / total
    return F.when(total <= 2, "body").when(ratio < 0.15, "intro").when(ratio > 0.85, "conclusion").otherwise("body")


def build_chunks(docs: DataFrame, doc_type: str = "sermon", key: str = "source_file", text: str = "text") -> DataFrame:
    """The chunk table of cleaned texts.

    Scripture and video blocks come first in document order, then the packed chunks; indices
    count from 0. A packed chunk carries all references of its document, a scripture chunk its
    own. Keys must be unique: equal rows count once. Null texts give no chunk.
    """
    p = parse(docs.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(key, text).distinct(), key, text)
    refs = F.filter(F.transform("paragraphs", lambda x: x["ref"]), lambda r: r.isNotNull())
    meta = p.select(key, "date", "title", refs.alias("all_refs"))
    special = scripture_rows(p, key, "paragraphs").select(key, F.lit(0).alias("part"), "pos", "text", F.when((F.col("kind") == "scripture") & (F.lit(doc_type) != "sermon"), doc_type).otherwise(F.col("kind")).alias("chunk_type"), F.when(F.col("ref").isNotNull(), F.array("ref")).otherwise(F.array().cast("array<string>")).alias("own"), F.lit(False).alias("every"))
    sermon = p.select(key, F.transform(F.filter(merge_short(F.col("paragraphs")), lambda x: x["type"] == "sermon"), lambda x: x["text"]).alias("texts"))
    packed = packed_rows(sermon, key, "texts").select(key, F.lit(1).alias("part"), F.col("k").alias("pos"), "text", F.lit(doc_type).alias("chunk_type"), F.array().cast("array<string>").alias("own"), F.lit(True).alias("every"))
    by = Window.partitionBy(key)
    rows = special.unionByName(packed).withColumn("chunk_index", F.row_number().over(by.orderBy("part", "pos")) - 1).withColumn("total_chunks", F.count("*").over(by).cast("int"))
    out = rows.join(meta, key)
    return out.select(chunk_id(key, "chunk_index").alias("chunk_id"), "date", "title", "chunk_index", "total_chunks", "chunk_type", F.when(F.col("every"), F.col("all_refs")).otherwise(F.col("own")).alias("scripture_refs"), "text", words_in(F.col("text")).alias("word_count"), F.col(key).alias("source_file"), section_type(F.col("chunk_index"), F.col("total_chunks")).alias("section_type"))
