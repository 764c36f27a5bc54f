"""The engine: search, chat, ingestion and statistics over a stored chunk table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from lectern.functions import dates, references, text
from lectern.operators import bm25, chunking, citations, cleaning, filters, fusion, knn, listing, rerank, store, topics
from lectern.operators.snapshots import BucketedTable
from lectern.plans import planner
from lectern.session import written
from lectern.sources.docx import read_docx, stem_of, word_files
from lectern.sources.texts import read_texts


class Engine:
    """A chunk table at ``path`` and what can be asked of it.

    Models come as loaders, run once per worker: ``embedder`` () -> (texts -> vectors) and
    ``reranker`` () -> (queries, texts -> logits). The language model's parts are plain
    functions: ``answerer`` (question, context, history) -> text, ``guardrail`` (question, context,
    answer) -> text, ``rewriter`` (message, history) -> Rewrite, ``paraphraser`` (query) -> list. Without
    them the engine embeds by hashing, skips reranking, answers by quoting and rewrites by rules.
    ``floor`` is the least similarity of a hit that is no scripture match; hashed embeddings of a
    short question resemble nothing, so without an embedder there is none. ``prefixes`` go before
    questions and before chunks when they are embedded.
    """

    def __init__(self, spark: SparkSession, path: str, *, embedder=None, reranker=None, answerer=None, guardrail=None, rewriter=planner.rewrite, paraphraser=None, floor: float | None = None, prefixes: tuple[str, str] = ("", "")):
        self.spark, self.path = spark, path
        self.embedder, self.reranker = embedder, reranker
        self.answerer: Callable = answerer or (lambda question, context, history: context.split("\n")[1] + " [1]" if "\n" in context else "")
        self.guardrail: Callable = guardrail or (lambda question, context, answer: answer)
        self.rewriter, self.paraphraser = rewriter, paraphraser
        self.floor = floor if floor is not None else fusion.FLOOR if embedder else -1.0
        self.prefixes = prefixes
        self.table = BucketedTable(spark, path, "source_file")
        self._index: tuple[int, bm25.Index] | None = None

    # -- store ---------------------------------------------------------------------------

    def chunks(self) -> DataFrame:
        return self.table.read()

    def get(self, ids: list[str], where: dict | None = None) -> DataFrame:
        """The chunks of these ids that fulfil a condition."""
        return filters.apply_filter(self.chunks().where(F.col("chunk_id").isin(ids)), where)

    def add(self, docs: DataFrame, doc_type: str = "sermon", keywords: bool = True) -> None:
        """Chunks of cleaned documents (source_file, text), in place of those of the same files.

        Only the folders that hold these files' chunks are written again.
        """
        c = chunking.build_chunks(docs, doc_type)
        c = c.select("*", *dates.derived_dates("date"), topics.embed("text", self.embedder, self.prefixes[1]).alias("embedding"))
        few = F.when(F.col("chunk_type").isin("scripture", "video"), topics.FEW).otherwise(topics.MANY)
        c = c.withColumn("topics", topics.topics("text", few) if keywords else F.array().cast("array<string>"))
        self.table.change(written(c), store.replace_by)

    def ingest(self, folder: str, doc_type: str = "sermon") -> None:
        self.add(read_texts(self.spark, folder), doc_type)

    def run_incremental(self, folder: str, doc_type: str = "sermon") -> int:
        """Ingests the files whose stem occurs in no stored file name; gives their number.

        Cleaned texts are taken as they are; of Word files only the new ones are opened, cleaned
        as transcripts or lessons by ``doc_type``, and stored as ``<stem>_pure.txt``. Files that
        can't be read or cleaned are left out; ``failed`` has them with the reason.
        """
        texts = read_texts(self.spark, folder).withColumn("stem", stem_of("source_file"))
        words = word_files(self.spark, folder)
        if self.table.exists():
            texts, words = store.not_ingested(texts, self.chunks()), store.not_ingested(words, self.chunks())
        paras = written(read_docx(self.spark, folder, words.select("source_file")))
        clean = cleaning.clean_lessons if doc_type == "lesson" else cleaning.clean_transcripts
        done = clean(paras.where("error is null"))
        self.failed = paras.where("error is not null").select("source_file", "error")
        if "error" in done.columns:
            done = written(done)
            self.failed = self.failed.unionByName(done.where("error is not null").select("source_file", "error"))
            done = done.where("error is null")
        done = done.select(F.concat(stem_of("source_file"), F.lit("_pure.txt")).alias("source_file"), "text")
        # a cleaned text of the folder wins over its Word file
        docs = texts.select("source_file", "text").unionByName(done.join(texts.select("source_file"), "source_file", "left_anti"))
        docs = written(docs)
        n = docs.count()
        if n:
            self.add(docs, doc_type)
        return n

    def stats(self) -> dict:
        r = self.chunks().agg(F.count("*").alias("chunks"), F.countDistinct("source_file").alias("files"), F.max("date_numeric").alias("newest")).first()
        return r.asDict()

    def index(self) -> bm25.Index:
        """The lexical index, written once per version of the table."""
        version = self.table.at.version()
        if self._index is None or self._index[0] != version:
            i = bm25.build(self.chunks())
            self._index = version, bm25.Index(i.postings, written(i.terms), written(i.scalars))
        return self._index[1]

    # -- search --------------------------------------------------------------------------

    def variations(self, queries: DataFrame) -> DataFrame:
        """(query_id, variation, text): the query and its paraphrases or synonym variants."""
        if self.paraphraser:
            f = self.paraphraser
            rows = [(r.query_id, [r.text, *f(r.text)]) for r in queries.select("query_id", "text").toLocalIterator() if r.text]
            df = self.spark.createDataFrame(rows, f"query_id {queries.schema['query_id'].dataType.simpleString()}, texts array<string>")
            df = df.select("query_id", text.distinct_variations(F.get("texts", F.lit(0)), F.slice("texts", 2, 100), 3).alias("texts"))
        else:
            df = queries.select("query_id", text.expand_query("text").alias("texts"))
        return df.select("query_id", F.posexplode("texts").alias("variation", "text"))

    def candidates(self, queries: DataFrame, where: dict | None = None, n: int = planner.N) -> DataFrame:
        """The fused candidates above the floor for (query_id, text). Filters apply to what is
        ranked; the statistics of the lexical index stay those of the whole table."""
        chunks = self.chunks()
        keep = filters.apply_filter(chunks, where)
        var = self.variations(queries).withColumn("vid", F.concat_ws("/", "query_id", "variation")).withColumn("embedding", topics.embed("text", self.embedder, self.prefixes[0]))
        pool, _ = knn.pool_size(n, 1)
        count = F.count("*").over(Window.partitionBy("query_id"))
        near = knn.knn(var, keep.select(F.col("chunk_id").alias("id"), "embedding"), pool, query="vid")
        near = near.withColumnRenamed("query_id", "vid").join(var.select("vid", "query_id", "variation", count.alias("n_var")), "vid")
        near = near.where(F.col("rank") <= F.greatest(F.lit(1), F.floor(F.lit(pool) / F.col("n_var"))))
        sem = knn.merge_variations(near.select("query_id", "variation", "id", "cosine", "rank")).select("query_id", "id", F.lit("semantic").alias("arm"), "rank", F.round("cosine", 3).alias("score"))
        lex = bm25.search(self.index(), queries, pool, keep.select(F.col("chunk_id").alias("id")) if where else None).select("query_id", "id", F.lit("lexical").alias("arm"), "rank", "score")
        asked = queries.select("query_id", F.explode(references.references_in("text")).alias("r")).select("query_id", "r.book", "r.chapter").distinct()
        entries = keep.select("chunk_id", F.explode("scripture_refs").alias("ref")).select("chunk_id", references.parse_reference("ref").alias("p")).where("p is not null").select(F.col("chunk_id").alias("id"), "p.book", "p.chapter").distinct()
        r = F.row_number().over(Window.partitionBy("query_id").orderBy("id"))
        scr = asked.join(entries, ["book", "chapter"]).select("query_id", "id").distinct().select("query_id", "id", F.lit("scripture").alias("arm"), r.cast("long").alias("rank"), F.lit(1.0).alias("score"))
        return fusion.above_floor(fusion.fuse(sem.unionByName(lex).unionByName(scr)), self.floor)

    def search_many(self, queries: DataFrame, where: dict | None = None, n: int = planner.N, as_of: dt.date | None = None, recency_weight: float = 0.0, diverse: bool = True, hint: str | None = None) -> DataFrame:
        """(query_id, pick, chunk columns, score): n results for each of (query_id, text). A date
        hint is added to the texts that are searched for."""
        if hint:
            queries = queries.withColumn("text", F.concat_ws(" ", "text", F.lit(hint)))
        fused = self.candidates(queries, where, n)
        meta = self.chunks().select(F.col("chunk_id").alias("id"), "title", "date", "chunk_index", "text")
        if self.reranker is None:
            best = fusion.without_reranker(fused, n).select("query_id", "id", F.col("rank").alias("pick"), "score")
        else:
            cand = fusion.cut(fused, "rrf", fusion.rerank_size(n)).drop("rank").join(meta, "id").join(queries.select("query_id", F.col("text").alias("query")), "query_id")
            rows = fusion.blend(rerank.rerank(cand, self.reranker))
            if as_of:
                rows = fusion.recency(rows, F.lit(as_of.isoformat()).cast("date"), recency_weight)
            rows = fusion.cut(rows.withColumn("score", fusion.display_score("rerank_score")), "final_score", rerank.dedupe_cut(n)).withColumnRenamed("rank", "ord")
            merged = written(rerank.merge_adjacent(rows))
            pick = rerank.mmr(merged, n) if diverse else merged.where(F.col("ord") <= n).select("query_id", "id", F.col("ord").alias("pick"))
            best = pick.join(merged.select("query_id", "id", "score", F.col("text").alias("merged")), ["query_id", "id"])
        cols = ["date", "title", "chunk_type", "chunk_index", "scripture_refs", "topics", "section_type", "text"]
        out = best.join(self.chunks().select(F.col("chunk_id").alias("id"), *cols), "id")
        if "merged" in out.columns:
            out = out.withColumn("text", F.coalesce("merged", "text")).drop("merged")
        return out.withColumnRenamed("id", "chunk_id")

    def search(self, query: str, n: int = planner.N) -> DataFrame:
        """Plain search: no rewriting, no filters."""
        if not query or not query.strip():
            raise ValueError("blank query")
        return self.search_many(self.spark.createDataFrame([(0, query)], "query_id long, text string"), n=n).drop("query_id").orderBy("pick")

    def chat(self, message: str, history: list[str] | None = None, as_of: dt.date | None = None) -> dict:
        """An answer with numbered sources: {answer, sources, removed, notice}.

        The last turns of the history go to the rewriter and the answerer. notice says how many
        sermons a listing leaves out; it is part of the answerer's context too.
        """
        if not message or not message.strip():
            raise ValueError("blank message")
        as_of = as_of or dt.date.today()
        history = (history or [])[-citations.LAST_TURNS :]
        r = self.rewriter(message, history)
        latest = lambda day, n: [x[0] for x in listing.latest_days(self.chunks(), day, n).collect()]
        p = planner.plan(self.spark, r, as_of, planner.source_kind(message, history), latest)
        one = self.spark.createDataFrame([(0, r.query)], "query_id long, text string")
        rows: list = []
        total = 0
        if p.listing:
            sermons, count = listing.listing(filters.apply_filter(self.chunks(), p.where))
            total = count.first().n_sermons
            picked = sermons.withColumn("pick", F.row_number().over(Window.orderBy(F.desc("date"), "title")))
            rows = picked.select("chunk_id", "pick", "score").join(self.chunks().drop("score"), "chunk_id").orderBy("pick").collect()
        for where in [p.where, *p.fallbacks]:
            if rows:
                break
            rows, total = self.search_many(one, where, p.n, as_of, p.recency_weight, hint=p.hint).orderBy("pick").collect(), 0
        if not rows:
            none = self.spark.range(1).select(citations.empty_message(*(F.lit(v).cast("string") for v in (r.recency, r.day_of_week, r.year, r.date_range))).alias("m")).first()
            return {"answer": none.m, "sources": [], "removed": 0, "notice": None}
        schema = "query_id long, n int, pick int, date string, title string, chunk_type string, scripture_refs array<string>, topics array<string>, section_type string, text string, score double"
        top = self.spark.createDataFrame([(0, i, i, x.date, x.title, x.chunk_type, x.scripture_refs, x.topics, x.section_type, x.text, float(x.score)) for i, x in enumerate(rows, 1)], schema)
        context = citations.context(top).first().context
        notice = self.spark.range(1).select(citations.truncation_notice(F.lit(total), F.lit(len(rows))).alias("n")).first().n
        context = f"{context}\n\n{notice}" if notice else context
        answer = self.guardrail(message, context, self.answerer(message, context, history))
        a = self.spark.createDataFrame([(0, answer)], "answer_id long, answer string")
        checked = citations.verify(a, top.select(F.col("query_id").alias("answer_id"), "n", "text"), rerank.overlap_score("claim", "text"))
        got = checked.select(citations.renumber("answer", len(rows)).alias("answer"), citations.cited("answer", len(rows)).alias("cited"), "removed").first()
        cards = citations.source_cards(top.where(F.col("n").isin(got.cited or []))).collect() if got and got.cited else []
        return {"answer": got.answer if got else "", "sources": [c.asDict() for c in cards], "removed": got.removed if got else 0, "notice": notice}
