"""The reference operators as queries over the test tables, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import dates, references, text
from lectern.operators import bm25, chunking, citations, filters, fusion, knn, listing, rerank, store
from lectern.session import spread

AS_OF = "2025-04-17"
K = 20
Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

DATE_PHRASES = ["last sunday", "this sunday", "Last Wed", "most recent sermon", "latest message", "past friday", "may 18", "may 18 2025", "May 18, 2025", "2025-05-18", "december 31", "february 29", "feb 29 2024", "last month", "this thu", "sept 3", "gibberish", ""]
RANGE_PHRASES = ["last week", "this week", "last month", "this month", "may", "may 2023", "2023 may", "sept", "december", "june 2199", "gibberish", ""]


def query(f: Query) -> Query:
    REGISTRY[f.__name__] = f
    return f


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def chunks(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    """Distinct chunks: rows delivered again differ in nothing but their time."""
    return t(spark, sf, "chunks").select("chunk_id", *cols).dropDuplicates(["chunk_id"])


def as_of():
    return F.lit(AS_OF).cast("date")


def _index(spark: SparkSession, sf: str) -> bm25.Index:
    return bm25.build(chunks(spark, sf, "text"))


# -- lexical ----------------------------------------------------------------------------


@query
def bm25_stats(spark, sf):
    return _index(spark, sf).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query
def bm25_topk(spark, sf):
    return bm25.search(_index(spark, sf), t(spark, sf, "queries"), K).select("query_id", F.col("id").alias("chunk_id"), "score", "rank")


@query
def bm25_filtered(spark, sf):
    keep = filters.apply_filter(chunks(spark, sf, "chunk_type", "year"), filters.merge_filters(filters.source_filter("sermon"), {"year": {"$gte": 2018}}))
    return bm25.search(_index(spark, sf), t(spark, sf, "queries"), K, keep.select(F.col("chunk_id").alias("id"))).select("query_id", F.col("id").alias("chunk_id"), "score", "rank")


# -- vectors ----------------------------------------------------------------------------


def _vectors(spark, sf):
    e = t(spark, sf, "embeddings")
    return e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), e.withColumnRenamed("vec_id", "id")


@query
def knn_topk(spark, sf):
    q, items = _vectors(spark, sf)
    return knn.knn(q, items, 10)


@query
def knn_filtered(spark, sf):
    q, items = _vectors(spark, sf)
    return knn.knn(q, filters.apply_filter(items, {"label": {"$in": [1, 3, 5]}}), 10, floor=0.1)


@query
def multi_query_merge(spark, sf):
    q, items = _vectors(spark, sf)
    ranked = knn.knn(q, items, 7).select((F.expr("query_id div 60")).alias("q"), (F.expr("query_id div 20 % 3")).alias("variation"), "id", "cosine", "rank")
    return knn.merge_variations(ranked.withColumnRenamed("q", "query_id"))


# -- references -------------------------------------------------------------------------


def _refs(spark, sf):
    return chunks(spark, sf, "scripture_refs").select("chunk_id", F.posexplode("scripture_refs").alias("pos", "ref")).where("ref is not null")


@query
def scripture_parse(spark, sf):
    p = _refs(spark, sf).select("chunk_id", F.col("pos").cast("long").alias("pos"), references.parse_reference("ref").alias("r"))
    return p.select("chunk_id", "pos", "r.book", F.col("r.chapter").cast("long").alias("chapter"), F.col("r.verse_start").cast("long").alias("verse_start"), F.col("r.verse_end").cast("long").alias("verse_end"))


def scripture_entries(spark, sf):
    r = _refs(spark, sf).select("chunk_id", references.parse_reference("ref").alias("r")).where("r is not null")
    return r.select(F.col("r.book").alias("book"), F.col("r.chapter").cast("long").alias("chapter"), "chunk_id").distinct()


@query
def scripture_index(spark, sf):
    return scripture_entries(spark, sf).groupBy("book").agg(F.countDistinct("chapter").alias("n_chapters"), F.count("*").alias("n_entries"))


def _query_refs(spark, sf):
    q = t(spark, sf, "queries").select("query_id", F.posexplode(references.references_in("text")).alias("pos", "r"))
    return q.select("query_id", F.col("pos").cast("long").alias("pos"), "r.book", F.col("r.chapter").cast("long").alias("chapter"), F.col("r.verse").cast("long").alias("verse"))


@query
def scripture_extract(spark, sf):
    return _query_refs(spark, sf)


@query
def scripture_lookup(spark, sf):
    return _query_refs(spark, sf).select("query_id", "book", "chapter").distinct().join(scripture_entries(spark, sf), ["book", "chapter"]).select("query_id", "chunk_id").distinct()


# -- fusion -----------------------------------------------------------------------------


def _arms(spark, sf):
    """A query's vector is the row of ``embeddings`` with its number; with an embedding model it
    would be the model's."""
    qs = t(spark, sf, "queries").select("query_id", "text")
    vectors = t(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding").join(qs.select("query_id").distinct(), "query_id", "left_semi")
    sem = knn.knn(vectors, chunks(spark, sf, "embedding").withColumnRenamed("chunk_id", "id"), 28).select("query_id", "id", F.lit("semantic").alias("arm"), "rank", F.round("cosine", 3).alias("score"))
    lex = bm25.search(_index(spark, sf), qs, 28).select("query_id", "id", F.lit("lexical").alias("arm"), "rank", "score")
    from pyspark.sql import Window

    look = scripture_lookup(spark, sf)
    scr = look.select("query_id", F.col("chunk_id").alias("id"), F.lit("scripture").alias("arm"), F.row_number().over(Window.partitionBy("query_id").orderBy("chunk_id")).cast("long").alias("rank"), F.lit(1.0).alias("score"))
    return sem.unionByName(lex).unionByName(scr)


@query
def rrf_fuse(spark, sf):
    return fusion.fuse(_arms(spark, sf)).withColumnRenamed("id", "chunk_id")


@query
def hybrid_search(spark, sf):
    top = fusion.without_reranker(fusion.above_floor(fusion.fuse(_arms(spark, sf))), 7)
    return top.select("query_id", F.col("id").alias("chunk_id"), "rrf", "score", "rank")


def _reranked(spark, sf):
    """Candidates joined late with the few columns of the few chunks that are left."""
    cand = fusion.cut(fusion.above_floor(fusion.fuse(_arms(spark, sf))), "rrf", fusion.rerank_size(7)).drop("rank")
    rows = cand.join(chunks(spark, sf, "text", "title", "date", "chunk_index").withColumnRenamed("chunk_id", "id"), "id").join(t(spark, sf, "queries").select("query_id", F.col("text").alias("query")), "query_id")
    rows = fusion.blend(rows.withColumn("rerank_score", rerank.overlap_score("query", "text")))
    return fusion.recency(rows, as_of(), 0.2).withColumn("score", fusion.display_score("rerank_score"))


@query
def rerank_blend(spark, sf):
    return _reranked(spark, sf).select("query_id", F.col("id").alias("chunk_id"), F.round("rerank_score", 6).alias("rerank_score"), F.round("final_score", 6).alias("final_score"), "score")


def _ordered(spark, sf):
    return fusion.cut(_reranked(spark, sf), "final_score", rerank.dedupe_cut(7)).withColumnRenamed("rank", "ord")


@query
def dedupe_adjacent(spark, sf):
    return rerank.merge_adjacent(_ordered(spark, sf)).select("query_id", F.col("id").alias("chunk_id"), "ord", F.length("text").cast("long").alias("text_length"), F.round("final_score", 6).alias("final_score"))


@query
def mmr_select(spark, sf):
    return rerank.mmr(rerank.merge_adjacent(_ordered(spark, sf)), 7).withColumnRenamed("id", "chunk_id")


# -- listing and filters ----------------------------------------------------------------

LIST = ("date", "title", "chunk_index", "chunk_type", "year", "date_numeric", "day_of_week")


@query
def listing_mode(spark, sf):
    c = filters.apply_filter(chunks(spark, sf, *LIST), filters.year_filter(2022))
    return listing.listing(c)[0].select("date", "title", "chunk_id", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk_type", F.col("score").cast("double").alias("score"))


@query
def listing_total(spark, sf):
    return listing.listing(filters.apply_filter(chunks(spark, sf, *LIST), filters.range_filter(20200101, 20221231)))[1]


@query
def latest_dates_dow(spark, sf):
    return listing.latest_days(t(spark, sf, "chunks"), "wednesday", 12).select(F.col("date_numeric").cast("long").alias("date_numeric"))


def _filtered(where):
    return lambda spark, sf: filters.apply_filter(chunks(spark, sf, *LIST), where).select("chunk_id")


REGISTRY["filter_year"] = _filtered(filters.year_filter(2021))
REGISTRY["filter_day"] = _filtered(filters.day_filter(20220731))
REGISTRY["filter_range"] = _filtered(filters.range_filter(20210601, 20220531))
REGISTRY["filter_dow"] = _filtered(filters.weekday_filter("Sunday"))
REGISTRY["filter_source"] = _filtered(filters.merge_filters(filters.source_filter("sermon"), filters.year_filter(2020), None, {"$and": [{"day_of_week": {"$eq": "sunday"}}]}))


@query
def date_fallback(spark, sf):
    """Chunks of each query's day, and of the service before where that day has none."""
    days = t(spark, sf, "queries").select("query_id", F.date_add(F.lit("2022-01-01").cast("date"), (F.col("query_id") % 100).cast("int")).alias("d"))
    c = chunks(spark, sf, "date_numeric").where("date_numeric > 0").groupBy("date_numeric").agg(F.count("*").alias("n"))
    exact = days.join(c, dates.date_number(F.col("d")) == F.col("date_numeric")).select("query_id", F.lit(0).alias("tier"), "date_numeric", "n")
    near = days.join(c, dates.date_number(dates.service_date(F.col("d"))) == F.col("date_numeric")).select("query_id", F.lit(1).alias("tier"), "date_numeric", "n")
    best = exact.union(near).groupBy("query_id").agg(F.min(F.struct("tier", "date_numeric", "n")).alias("b"))
    return best.select("query_id", F.col("b.tier").cast("long").alias("tier"), F.col("b.date_numeric").cast("long").alias("date_numeric"), "b.n")


# -- conversations ----------------------------------------------------------------------


@query
def source_detect_history(spark, sf):
    return filters.source_by_history(t(spark, sf, "chat_turns"))


@query
def history_window(spark, sf):
    return citations.history_window(t(spark, sf, "chat_turns")).select("conv_id", "turn", "role", "back")


@query
def history_digest(spark, sf):
    return citations.history_digest(t(spark, sf, "chat_turns"))


@query
def query_expand(spark, sf):
    e = t(spark, sf, "queries").where("text is not null").select("query_id", F.posexplode(text.expand_query("text")).alias("i", "variant"))
    return e.select("query_id", F.col("i").cast("long").alias("i"), "variant")


@query
def paraphrase_dedupe(spark, sf):
    others = F.array(F.upper("text"), F.concat(F.lit("  "), F.col("text")), F.concat(F.col("text"), F.lit(" please")), F.concat(F.col("text"), F.lit(" PLEASE ")), F.lit("amen"))
    e = t(spark, sf, "queries").where("text is not null").select("query_id", F.posexplode(text.distinct_variations("text", others, 3)).alias("i", "variant"))
    return e.select("query_id", F.col("i").cast("long").alias("i"), "variant")


# -- dates ------------------------------------------------------------------------------


def _days(spark, sf):
    return t(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()


@query
def service_date(spark, sf):
    return _days(spark, sf).select("day", dates.service_date(F.col("day")).alias("service"))


@query
def date_expr(spark, sf):
    d = _days(spark, sf).select("day", F.explode(F.array(*map(F.lit, DATE_PHRASES))).alias("phrase"))
    return d.select("day", "phrase", dates.resolve_date("phrase", F.col("day")).alias("resolved"))


@query
def date_range(spark, sf):
    d = _days(spark, sf).select("day", F.explode(F.array(*map(F.lit, RANGE_PHRASES))).alias("phrase"))
    return d.select("day", "phrase", dates.resolve_range("phrase", F.col("day")).alias("r")).select("day", "phrase", F.col("r.first").alias("first_day"), F.col("r.last").alias("last_day"))


@query
def date_number_roundtrip(spark, sf):
    n = dates.date_number(F.col("day"))
    return _days(spark, sf).select("day", n.cast("long").alias("number"), dates.number_date(n).alias("back"))


@query
def date_hints(spark, sf):
    d = F.col("day")
    return _days(spark, sf).select("day", dates.date_hint(d).alias("hint"), dates.range_hint(F.to_date(F.date_trunc("month", d)), F.last_day(d)).alias("whole"), dates.range_hint(d, F.last_day(d)).alias("part"))


@query
def derived_dates(spark, sf):
    y, n, w = dates.derived_dates("date")
    return chunks(spark, sf, "date").select("chunk_id", y.cast("long").alias("year"), n.cast("long").alias("date_numeric"), w)


@query
def backfill_dow(spark, sf):
    return store.backfill_weekday(chunks(spark, sf, "date", "day_of_week")).select("chunk_id", "day_of_week")


# -- cleaning and chunking --------------------------------------------------------------


def _docs(spark, sf):
    return spread(t(spark, sf, "documents").select("doc_id", "text"))


@query
def word_counts(spark, sf):
    return _docs(spark, sf).select("doc_id", chunking.words_in(F.col("text")).cast("long").alias("n_words"))


@query
def header_parse(spark, sf):
    return chunking.header(_docs(spark, sf)).select("doc_id", "date", "title", F.length("body").cast("long").alias("body_length"))


@query
def para_split(spark, sf):
    b = chunking.header(_docs(spark, sf)).select("doc_id", F.posexplode(chunking.blocks("body")).alias("pos", "block"))
    return b.select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5("block").alias("digest"))


@query
def typed_paragraphs(spark, sf):
    p = chunking.parse(_docs(spark, sf), "doc_id").select("doc_id", F.explode("paragraphs").alias("p"))
    return p.groupBy("doc_id", F.col("p.type").alias("type")).agg(F.count("*").alias("n"), F.sum(F.length("p.text")).alias("characters"))


@query
def pack_paragraphs(spark, sf):
    h = chunking.header(_docs(spark, sf)).select("doc_id", chunking.pack(chunking.blocks("body")).alias("c"))
    p = h.select("doc_id", F.posexplode("c").alias("k", "ps"))
    return p.select("doc_id", F.col("k").cast("long").alias("k"), F.size("ps").cast("long").alias("n_paragraphs"), F.md5(F.array_join("ps", "\n\n")).alias("digest"))


@query
def build_chunks(spark, sf):
    d = spread(t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("source_file"), "text"))
    return chunking.build_chunks(d).select("chunk_id", "date", "title", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("total_chunks").cast("long").alias("total_chunks"), "chunk_type", F.col("word_count").cast("long").alias("word_count"), "section_type", F.md5("text").alias("digest"))


@query
def section_types(spark, sf):
    return chunks(spark, sf, "chunk_index", "total_chunks").select("chunk_id", chunking.section_type(F.col("chunk_index"), F.col("total_chunks")).alias("section"))


@query
def chunk_ids(spark, sf):
    return chunks(spark, sf, "source_file", "chunk_index").select("chunk_id", chunking.chunk_id("source_file", "chunk_index").alias("made"))


def _lines(spark, sf):
    return _docs(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("doc_id", F.col("pos").cast("long").alias("pos"), "line")


@query
def noise_lines(spark, sf):
    return _lines(spark, sf).where(text.is_noise_line("line") | text.is_footer("line")).select("doc_id", "pos")


@query
def substantive_lines(spark, sf):
    return _lines(spark, sf).where(text.is_substantive("line")).groupBy("doc_id").agg(F.count("*").alias("n"))


@query
def clean_lines(spark, sf):
    """All of the noise rewrites; SQL without lookaround can't express them."""
    return _lines(spark, sf).select("doc_id", "pos", text.clean_noise("line").alias("clean")).where("clean <> ''")


@query
def lesson_files(spark, sf):
    f = t(spark, sf, "chunks").select("source_file").distinct().select("source_file", text.lesson_name(F.replace(F.col("source_file"), F.lit("_pure.txt"), F.lit(".docx"))).alias("m"))
    return f.where("m is not null").select("source_file", "m.date", "m.lesson", "m.title")


@query
def attachment_names(spark, sf):
    return t(spark, sf, "chunks").select("title").where("title is not null").distinct().select("title", text.attachment_name(F.concat("title", F.lit(" (12 kB)"))).alias("file"))


# -- store ------------------------------------------------------------------------------


@query
def ingest_stats(spark, sf):
    return listing.type_counts(chunks(spark, sf, "source_file", "chunk_type", "word_count"))


@query
def distinct_sources(spark, sf):
    return t(spark, sf, "chunks").select("source_file").where("source_file is not null and source_file <> ''").distinct()


def _new(spark, sf):
    b = t(spark, sf, "chunk_batches").where("chunk_id is not null").select("chunk_id", F.struct("batch_id", "row_id").alias("o"), "source_file", F.length("text").cast("long").alias("text_length"))
    return store.latest(b, "chunk_id", "o").drop("o")


@query
def upsert(spark, sf):
    old = chunks(spark, sf, "source_file", "text").select("chunk_id", "source_file", F.length("text").cast("long").alias("text_length"))
    return store.upsert(old, _new(spark, sf))


@query
def replace_files(spark, sf):
    old = chunks(spark, sf, "source_file", "text").where("source_file is not null").select("chunk_id", "source_file", F.length("text").cast("long").alias("text_length"))
    return store.replace_by(old, _new(spark, sf).where("source_file is not null"))


@query
def update_metadata(spark, sf):
    old = chunks(spark, sf, "source_file", "text").select("chunk_id", "source_file", F.length("text").cast("long").alias("text_length"))
    return store.update(old, _new(spark, sf))


@query
def anti_join_substring(spark, sf):
    stems = t(spark, sf, "chunk_batches").select(F.regexp_replace("source_file", r"_pure\.txt$", "").alias("stem")).where("stem is not null").distinct()
    return store.not_ingested(stems, t(spark, sf, "chunks"))


# -- citations and presentation ---------------------------------------------------------


def _answers(spark, sf):
    a = t(spark, sf, "chat_turns").where("text is not null").select("conv_id", "turn", "text").distinct()
    return a.withColumn("answer_id", F.concat_ws("-", "conv_id", "turn", F.md5("text"))).withColumnRenamed("text", "answer")


@query
def cite_extract(spark, sf):
    return _answers(spark, sf).select("answer_id", F.array_join(citations.cited("answer", 6), ",").alias("cited"))


@query
def cite_renumber(spark, sf):
    return _answers(spark, sf).select("answer_id", citations.renumber("answer", 6).alias("answer"))


@query
def cite_verify(spark, sf):
    a = _answers(spark, sf)
    sources = a.select("answer_id", F.posexplode(F.filter(F.split("answer", r"\. "), lambda x: x != "")).alias("p", "text")).select("answer_id", (F.col("p") + 1).alias("n"), "text")
    return citations.verify(a.select("answer_id", "answer"), sources, rerank.overlap_score("claim", "text")).select("answer_id", F.md5("answer").alias("digest"), F.col("removed").cast("long").alias("removed"))


@query
def context_build(spark, sf):
    top = hybrid_search(spark, sf).select("query_id", "chunk_id", F.col("rank").alias("pick"))
    c = chunks(spark, sf, "date", "title", "chunk_type", "scripture_refs", "text")
    return citations.context(top.join(c, "chunk_id")).select("query_id", F.md5("context").alias("digest"))


@query
def source_cards(spark, sf):
    c = chunks(spark, sf, "date", "title", "chunk_type", "text", "topics", "section_type").withColumn("score", F.lit(0.99))
    return citations.source_cards(c).select("date", "title", "chunk_type", F.col("score").cast("double").alias("score"), "preview", "topics", "section")


@query
def escape_html(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.md5(text.escape_html("text")).alias("digest"))


@query
def format_answer(spark, sf):
    return _answers(spark, sf).select("answer_id", text.format_answer("answer", "conv_id").alias("html"))


def queries() -> dict[str, Query]:
    return dict(REGISTRY)
