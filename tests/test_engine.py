"""Ingestion, search and chat end to end, and the parts that SQL can't check."""

import datetime as dt
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

BODY = "\n\n".join(f"The lamp of {w} stood by the river and the people of the valley gave thanks for {w} in the morning. " * 6 for w in ("mercy", "hope", "grace"))


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    from lectern.plans.api import Engine

    folder = tmp_path_factory.mktemp("texts")
    for i, (day, topic) in enumerate([("2025-04-13", "harvest"), ("2025-04-09", "shepherd"), ("2024-06-02", "bronze")]):
        (folder / f"{day.replace('-', '')}_{i}_{topic}_pure.txt").write_text(f"DATE: {day}\nTITLE: The {topic}\n\n[John {i + 3}:16] For the {topic} was loved\n\n{BODY}\n\nThe {topic} is what we speak of, and the {topic} will stand for all who wait. " * 1)
    e = Engine(spark, str(tmp_path_factory.mktemp("store") / "chunks"), reranker=lambda: lambda q, t: [5.0 if a.split()[-1] in b else -5.0 for a, b in zip(q, t)])
    assert e.run_incremental(str(folder)) == 3
    assert e.run_incremental(str(folder)) == 0
    return e


def test_store(engine):
    s = engine.stats()
    assert s["files"] == 3 and s["newest"] == 20250413
    rows = engine.chunks().collect()
    assert len({r.chunk_id for r in rows}) == len(rows)
    assert {r.day_of_week for r in rows} == {"sunday", "wednesday"}
    assert all(len(r.embedding) == 64 for r in rows)


def test_search(engine):
    got = engine.search("tell me of shepherd").collect()
    assert got and got[0].title == "The shepherd"
    assert any(r.title == "The bronze" for r in engine.search("John 5:16").collect())
    with pytest.raises(ValueError):
        engine.search("  ")


def test_chat(engine):
    said = engine.chat("latest sunday sermon on harvest", as_of=dt.date(2025, 4, 17))
    assert said["sources"] and {s["date"] for s in said["sources"]} == {"2025-04-13"}
    listed = engine.chat("which sermons in 2024", as_of=dt.date(2025, 4, 17))
    assert {s["date"] for s in listed["sources"]} == {"2024-06-02"}
    assert listed["notice"] is None
    asked = []
    engine.answerer, answer = lambda q, c, h: asked.append((q, c, h)) or "", engine.answerer
    engine.chat("sermon on harvest", [f"turn {i}" for i in range(9)], dt.date(2025, 4, 17))
    engine.answerer = answer
    assert asked[0][2] == [f"turn {i}" for i in range(3, 9)]
    assert "2019" in engine.chat("sermon in 2019", as_of=dt.date(2025, 4, 17))["answer"]


def test_stream(spark, tmp_path):
    from lectern.plans.api import Engine
    from lectern.streaming.landing import watch

    land = tmp_path / "land"
    land.mkdir()
    (land / "a_pure.txt").write_text("DATE: 2025-01-05\nTITLE: A\n\n" + BODY)
    e = Engine(spark, str(tmp_path / "t"))
    for name in ("b_pure.txt", "a2_pure.txt"):
        watch(e, str(land), str(tmp_path / "c")).awaitTermination(120)
        (land / name).write_text("DATE: 2025-01-12\nTITLE: B\n\n" + BODY)
    assert {r.source_file for r in e.chunks().collect()} == {"a_pure.txt", "b_pure.txt"}


def docx(paras):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r>{'<w:rPr><w:b/></w:rPr>' if bold else ''}<w:t>{t}</w:t></w:r></w:p>" for t, bold in paras)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_word_files(spark, tmp_path):
    from lectern.operators.cleaning import clean_lessons, clean_transcripts
    from lectern.sources.docx import read_docx

    lesson = [("A title", True), ("John 14:9", True), ("Whoever has seen me.", False), ("1. Opening", True), ("This is the first body text.", False), ("Show commentary here", False), ("John Gill", False), ("(Mark 1:2) As it is written", False), ("* A plain closing line of text", False), ("Compiled by Some One", False), ("https://example.org", False)]
    (tmp_path / "20200210_23-1_The_Lamb_s_Way__P_Name.docx").write_bytes(docx(lesson))
    (tmp_path / "other.docx").write_bytes(b"broken")
    (tmp_path / "old.doc").write_bytes(b"legacy")
    read = read_docx(spark, str(tmp_path))
    assert {r.source_file: r.error is None for r in read.collect()} == {"20200210_23-1_The_Lamb_s_Way__P_Name.docx": True, "other.docx": False, "old.doc": False}
    row = clean_lessons(read.where("error is null")).first()
    assert (row.date, row.title, row.error) == ("2020-02-10", "The Lamb's Way", None)
    assert row.text.split("\n\n")[1:] == ["[John 14:9] Whoever has seen me.", "[1. Opening] This is the first body text.", "[Mark 1:2] As it is written", "A plain closing line of text"]
    paras = [("Sunday Message April 13th, 2025", False), ("The Narrow Road", False), ("Main Text: John 3", False), ("Scriptures:", False), ("He said {note} &lt;John 3:16&gt; is 길 true .", False), ("...", False), ("TR: someone", False), ("after", False)]
    (tmp_path / "s.docx").write_bytes(docx(paras))
    out = clean_transcripts(read_docx(spark, str(tmp_path / "s.docx"))).first()
    assert (out.date, out.title) == ("2025-04-13", "The Narrow Road")
    assert out.text == "DATE: 2025-04-13\nTITLE: The Narrow Road\n\nMain Text: John 3\n\nHe said [John 3:16] is true ."


def test_lesson_grammar():
    from lectern.operators.cleaning import lesson_blocks

    rows = [("John Gill", True), ("the first bold line", True), ("1 Kings 17:1-7.", True), ("1 Kings 17:1-7", True), ("He went.", False), ("", False), ("And stayed.", False), ("2. He fled", True), ("", False), ("Introduction", True), ("Body of it.", False), ("1) He rose", True), ("(Mark 1:2)", False), ("As it is", False), ("two words", False), ("C. Last one.", True), ("Translated by A", False), ("", False), ("13 | 10 Page foot", False)]
    got = lesson_blocks([{"text": t, "is_bold": b, "has_image": False} for t, b in rows])
    # a name is a credit even where it is bold; a label stands alone before another bold line
    assert got == ["[1 Kings 17:1-7]", "[1 Kings 17:1-7] He went. And stayed.", "[2. He fled]", "[Introduction] Body of it.", "1) He rose", "[Mark 1:2] As it is two words", "[C. Last one]"]
    assert lesson_blocks([]) == []


def test_noise_lines(spark):
    from lectern.functions.text import clean_noise

    cases = {"<John 3:16> “ Well ” 말씀 {note} ok": "[John 3:16] Well ok", "it's 'so' ' .": "it's 'so' .", "end . . . more": "end . more", "end... more": "end. more", "a , ; b": "a b", "【x】 \"\" y": "x y", "Done. .,": "Done.", "": ""}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.c for r in df.select("t", clean_noise("t").alias("c")).collect()} == cases


def test_word_files_become_chunks(spark, tmp_path):
    from lectern.plans.api import Engine

    folder = tmp_path / "raw"
    folder.mkdir()
    text = " ".join(["The narrow road is long and many walk it with joy."] * 6)
    (folder / "one.docx").write_bytes(docx([("Sunday Message April 13th, 2025", False), ("The Narrow Road", False), ("Main Text", False), (text, False)]))
    (folder / "bad.docx").write_bytes(b"broken")
    e = Engine(spark, str(tmp_path / "store"))
    assert e.run_incremental(str(folder)) == 1
    assert [(r.source_file) for r in e.failed.collect()] == ["bad.docx"]
    assert {(r.source_file, r.date, r.title) for r in e.chunks().collect()} == {("one_pure.txt", "2025-04-13", "The Narrow Road")}
    (folder / "two.docx").write_bytes(docx([("Sunday Message April 20th, 2025", False), ("Another Road", False), ("Main Text", False), (text, False)]))
    assert e.run_incremental(str(folder)) == 1 and e.stats()["files"] == 2
    ids = [r.chunk_id for r in e.chunks().where("title = 'Another Road'").collect()]
    assert {r.title for r in e.get(ids).collect()} == {"Another Road"} and e.get(ids, {"year": 1999}).count() == 0


def test_versions(spark, tmp_path):
    from lectern.operators.snapshots import BucketedTable, Conflict
    from lectern.operators.store import upsert

    t = BucketedTable(spark, str(tmp_path / "t"), "k", 4)
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v int")
    up = lambda old, new: upsert(old, new, "k")
    t.change(rows(*((f"k{i}", i) for i in range(20))), up)
    before, state = t.at.version(), t.at.state()
    t.change(rows(("k3", 33), ("new", 1)), up)
    got = {r.k: r.v for r in t.read().collect()}
    assert got == {**{f"k{i}": i for i in range(20)}, "k3": 33, "new": 1}
    # folders of other buckets are those of the version before, which can still be read
    after = t.at.state()["rows"]["folders"]
    assert sum(state["rows"]["folders"][b] == f for b, f in after.items() if b in state["rows"]["folders"]) >= 2
    assert {r.v for r in t.at.read(state, "rows").collect()} == set(range(20))
    with pytest.raises(Conflict):
        t.at.commit(before, state)
    t.at.vacuum()
    assert {r.k: r.v for r in t.read().collect()} == got and t.at.version() == before + 1


def test_pages(spark):
    from lectern.sources.html import extract_links

    page = '<html><title>Board</title><td class="subject"><div><span><a href="x?topic=5.0#new">t</a></span></div></td><div class="attachments"><br><a href="f1">readme</a><a href="f2">SM 2025: Road (12 kB)</a></div>'
    df = spark.createDataFrame([(1, page), (2, "<title>Login</title>"), (3, None)], "page_id long, html string")
    got = {r.page_id: (r.login, r.topic, r.attachment, r.file) for r in extract_links(df).collect()}
    assert got[1] == (False, "x?topic=5.0", "f2", "SM 2025 Road.docx") and got[2][0] is True and got[3][1] is None


def test_paragraph_grammar(spark):
    from lectern.operators import chunking

    body = "DATE: 2025-01-01\nTITLE: T\n\n[John 3:16]\n\nfor God\n\n<video 1 start>\n\nclip one\n\nclip two\n\n<video 1 end>\n\nsix words are in this text\n\nAmen so\n\n[Mark 1:2] text\n\n<video 2 start>\n\nlost"
    row = chunking.parse(spark.createDataFrame([("f", body), ("g", "DATE: x"), ("h", "")], "source_file string, text string")).collect()
    got = {r.source_file: [(p.type, p.ref, p.video_index, p.text) for p in r.paragraphs] for r in row}
    assert got["f"] == [("scripture", "John 3:16", None, "[John 3:16] for God"), ("video", None, 1, "clip one clip two"), ("sermon", None, None, "six words are in this text"), ("sermon", None, None, "Amen so"), ("scripture", "Mark 1:2", None, "[Mark 1:2] text")]
    assert got["g"] == [] and got["h"] == []
    merged = spark.createDataFrame([("f", body)], "source_file string, text string")
    p = chunking.parse(merged).select(F.transform(chunking.merge_short(F.col("paragraphs")), lambda x: x["text"]).alias("t")).first().t
    assert "six words are in this text Amen so" in p


def test_chunks_of_long_documents(spark):
    from lectern.operators import chunking

    paras = [" ".join(f"p{i}w{j}" for j in range(n)) for i, n in enumerate([150, 200, 90, 30, 500, 10, 380, 3])]
    text = "DATE: 2025-01-01\nTITLE: T\n\n" + "\n\n".join(paras)
    rows = sorted(chunking.build_chunks(spark.createDataFrame([("f", text)], "source_file string, text string")).collect(), key=lambda r: r.chunk_index)
    merged = paras[:-2] + [paras[-2] + " " + paras[-1]]
    packs, cur, n = [], [], 0
    for p in merged:
        w = len(p.split())
        if cur and n + w >= 400:
            packs.append(cur)
            cur, n = [], 0
        cur, n = [*cur, p], n + w
    packs.append(cur)
    want = ["\n\n".join(([" ".join(packs[i - 1][-1].split()[-75:])] if i else []) + c) for i, c in enumerate(packs)]
    assert [r.text for r in rows] == [w for w in want if len(w.split()) >= 20]
    assert [r.chunk_index for r in rows] == list(range(len(rows))) and {r.total_chunks for r in rows} == {len(rows)}


def test_merge_adjacent_and_mmr(spark):
    from lectern.operators import rerank

    edge = " ".join(f"e{i}" for i in range(40))
    rows = [(1, "a", 1, "T", "d", 1, "start " * 5 + edge, 0.6, 0.9), (1, "b", 3, "T", "d", 2, edge + " tail", 0.8, 0.5), (1, "c", 2, "U", "d", 7, "other words", 0.7, 0.8), (1, "d", 4, "T", "d", 3, "no overlap", 0.5, 0.4)]
    df = spark.createDataFrame(rows, "query_id long, id string, ord long, title string, date string, chunk_index int, text string, score double, final_score double")
    got = sorted(rerank.merge_adjacent(df).collect(), key=lambda r: r.ord)
    assert [(r.id, r.score, "[...]" in r.text) for r in got] == [("a", 0.8, True), ("d", 0.5, False), ("c", 0.7, False)]
    picks = sorted(rerank.mmr(rerank.merge_adjacent(df), 2).collect(), key=lambda r: r.pick)
    assert [r.id for r in picks] == ["a", "c"]


def test_filters_and_plans(spark):
    from lectern.operators import filters
    from lectern.plans import planner

    assert filters.merge_filters(None, {"$and": [{"a": 1}, {"b": 2}]}, {"c": 3}) == {"$and": [{"a": 1}, {"b": 2}, {"c": 3}]}
    assert filters.compile_filter(None) is None
    as_of = dt.date(2025, 4, 17)
    p = planner.plan(spark, planner.rewrite("latest wednesday message"), as_of, "sermon", lambda d, n: [20250416])
    assert {"date_numeric": {"$eq": 20250416}} in p.where["$and"] and p.recency_weight == 0.4
    p = planner.plan(spark, planner.rewrite("lesson of last sunday"), as_of, "lesson")
    assert {"date_numeric": {"$eq": 20250413}} in p.where["$and"] and p.fallbacks
    assert planner.plan(spark, planner.rewrite("what is grace"), as_of) == planner.Plan()


def test_export(spark, tmp_path):
    from lectern.operators.store import export_json

    export_json(spark.createDataFrame([("é", ["a"])], "t string, l array<string>"), str(tmp_path / "j"))
    lines = [x for f in (tmp_path / "j").glob("part-*") for x in f.read_text().splitlines()]
    assert json.loads(lines[0]) == {"t": "é", "l": ["a"]} and "é" in lines[0]
