"""Each operator against a brute-force version, and on awkward tables."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
CHUNK = "chunk_id string, title string, text string, topics array<string>, scripture_refs array<string>, embedding array<float>, _k string, _x string, bag long, id long, q string, w string, n int"


def fold(s):
    return WORD.findall((s or "").lower())


def rows_of(df):
    return {tuple(r) for r in df.collect()}


def make(spark, rows):
    """Rows of chunk_id, title, text, topics, refs, embedding; the other columns clash by name."""
    return spark.createDataFrame([(*r, "k", "x", 1, 2, "q", "w", 3) for r in rows], CHUNK)


VOCAB = [f"word{i}" for i in range(400)]


def text(rng, n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def edited(rng, s, edits):
    ws = s.split()
    for _ in range(edits):
        i = rng.randrange(len(ws))
        kind = rng.random()
        if kind < 0.4:
            ws[i] = rng.choice(VOCAB)
        elif kind < 0.7:
            del ws[i]
        else:
            ws.insert(i, rng.choice(VOCAB))
    return " ".join(ws)


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    base = [text(rng, rng.choice([5, 25, 60, 150])) for _ in range(n)]
    out = [(f"c{i:03}", f"Title {i}", t) for i, t in enumerate(base)]
    for i in range(n):
        out.append((f"d{i:03}", f"Title {i}", edited(rng, base[i], rng.choice([0, 1, 3, 10]))))
    out += [(f"e{i}", "copy", base[3]) for i in range(8)] + [("n0", None, None), ("n1", None, ""), (None, "no key", base[2]), ("c001", "Title 1", base[1])]
    return out


def overlap(a, b):
    x, y = Counter(fold(a[1]) + fold(a[2])), Counter(fold(b[1]) + fold(b[2]))
    u = sum((x | y).values())
    return sum((x & y).values()) / u if u else 0.0


def near(a, b):
    return len(fold(a[2])) >= 20 and len(fold(b[2])) >= 20 and overlap(a, b) >= 0.8


@pytest.fixture(scope="module")
def chunks(spark):
    return make(spark, [(i, t, x, None, None, None) for i, t, x in corpus()])


@pytest.fixture(scope="module")
def empty(spark):
    return make(spark, [])


def distinct_records():
    return sorted({r for r in corpus() if r[0] is not None})


# -- 1 -----------------------------------------------------------------------------------


def test_distinctive_terms(spark, empty):
    from lectern.llm.distinctive import distinctive_terms, leading_term

    data = [
        ("a", "Grace and grace, holy holy HOLY lamb.", ["grace", "Holy Holy", "lamb", None, "..", "grace "]),
        ("b", "grace of the lamb", ["grace", "unseen"]),
        ("c", None, ["grace"]),
        ("d", "x " * 5000 + "lamb", ["lamb", "x"]),
        ("e", "", []),
        ("f", "a_b é über", None),
        (None, "grace", ["grace"]),
    ]
    df = make(spark, [(k, "t", x, ts, None, None) for k, x, ts in [*data, data[0]]])
    got = {(r.chunk_id, r.term): r for r in distinctive_terms(df).collect()}
    recs = [d for d in data if d[0]]
    words = {k: fold(x) for k, x, _ in recs}

    def tf(k, term):
        t, w = term.split(), words[k]
        return sum(w[i : i + len(t)] == t for i in range(len(w) - len(t) + 1))

    smooth = sum(len(w) ** 0.75 for w in words.values())
    want = {(k, " ".join(fold(t))) for k, _, ts in recs for t in ts or [] if t and fold(t)}
    assert set(got) == want
    for (k, t), r in got.items():
        df_, total = sum(tf(x, t) > 0 for x in words), sum(tf(x, t) for x in words)
        assert (r.tf, r.df, r.n_records, r.term_total, r.n_words) == (tf(k, t), df_, len(recs), total, len(words[k]))
        assert r.tf_idf == pytest.approx(r.tf * math.log(len(recs) / df_) if r.tf else 0)
        pmi = math.log(r.tf * smooth / (total * len(words[k]) ** 0.75)) if r.tf else 0
        assert r.ppmi == pytest.approx(max(0.0, pmi))
    assert got[("a", "holy holy")].tf == 2
    assert distinctive_terms(empty).count() == 0
    assert {(r.chunk_id, r.term) for r in leading_term(distinctive_terms(df)).collect()} <= want


# -- 2 -----------------------------------------------------------------------------------


def brute_repeats(history, batch):
    held, keys, out = [h for h in history], {h[0] for h in history if h[0]}, set()
    for b, r, *rec in batch:
        rec = tuple(rec)
        if rec[0] in keys or any(near(rec, h) for h in held):
            out.add((b, r))
        else:
            held.append(rec)
            if rec[0] is not None:
                keys.add(rec[0])
    return out


def test_repeats_against_all_history(spark, empty):
    from lectern.llm.history import repeats

    rng = random.Random(5)
    every = corpus(7)
    history, later = every[:50], every[50:]
    chain = text(rng, 100)
    for i in range(6):
        chain = edited(rng, chain, 6)
        later.append((f"chain{i}", "c", chain))
    later += [(None, None, None), (None, "t", text(rng, 30)), ("same", "t", text(rng, 30)), ("same", "t", text(rng, 40)), ("short", "t", "a b"), ("short", "t", "a b"), ("short2", "t", "a b")]
    rng.shuffle(later)
    batch = [(i // 9, i, *r) for i, r in enumerate(later)]
    want = brute_repeats([h for h in history if h[0]] + [h for h in history if not h[0]], batch)
    h = make(spark, [(a, b, c, None, None, None) for a, b, c in history])
    schema = "batch_id long, row_id long, chunk_id string, title string, text string, cid string, o int, bag int"
    b = spark.createDataFrame([(*x, "z", 1, 2) for x in batch], schema)
    assert rows_of(repeats(h, b)) == want
    assert rows_of(repeats(empty, b)) == brute_repeats([], batch)
    assert repeats(h, spark.createDataFrame([], schema)).count() == 0


def test_history_rows_without_key_are_held(spark, tmp_path):
    from lectern.llm.history import PivotTable, repeats

    rng = random.Random(12)
    one, other = text(rng, 100), text(rng, 100)
    history = [(None, "t", one), (None, "t", other), ("k", "t", text(rng, 100))]
    batch = [(0, 0, "a", "t", edited(rng, one, 2)), (0, 1, "b", "t", other), (0, 2, None, "t", text(rng, 100)), (0, 3, "c", "t", text(rng, 100))]
    h = make(spark, [(*r, None, None, None) for r in history])
    b = spark.createDataFrame(batch, "batch_id long, row_id long, chunk_id string, title string, text string")
    assert rows_of(repeats(h, b)) == brute_repeats(history, batch) == {(0, 0), (0, 1)}
    table = PivotTable(spark, str(tmp_path / "held"), buckets=4)
    table.append(h)
    assert rows_of(table.admit(b)) == {(0, 0), (0, 1)}


def test_pivot_table_batch_by_batch(spark, tmp_path):
    from lectern.llm.history import PivotTable

    every = [r for r in corpus(11, 30) if r[0]]
    random.Random(3).shuffle(every)
    batch = [(i // 15, i, *r) for i, r in enumerate(every[20:])]
    table = PivotTable(spark, str(tmp_path / "held"), buckets=4)
    table.append(make(spark, [(a, b, c, None, None, None) for a, b, c in every[:20]]))
    got = set()
    for n in sorted({b[0] for b in batch}):
        got |= rows_of(table.admit(spark.createDataFrame([b for b in batch if b[0] == n], "batch_id long, row_id long, chunk_id string, title string, text string")))
    assert got == brute_repeats(every[:20], batch)
    # a batch that comes again by its name gets its answer again and adds nothing
    more = [(9, 900 + i, f"m{i}", "t", text(random.Random(i), 40)) for i in range(3)] + [(9, 910, None, *every[0][1:]), (9, None, "m0", "t", "x")]
    df = spark.createDataFrame(more, "batch_id long, row_id long, chunk_id string, title string, text string")
    first = rows_of(table.admit(df, name="nine"))
    version = table.at.version()
    assert rows_of(table.admit(df, name="nine")) == first and table.at.version() == version
    assert (9, 910) in first


# -- 3 -----------------------------------------------------------------------------------


def brute_cuts(t, limit=400, over=75, least=200):
    ws = list(re.finditer(r"\S+", t or ""))
    s, out = 0, []
    while len(ws) - s > limit:
        span = range(s + limit, s + least, -1)
        gap = lambda p: t[ws[p - 1].end() : ws[p].start()].count("\n") >= 2
        ends = lambda p: re.search(r"[.!?][\"')\]”’]*$", ws[p - 1].group())
        cut = next((p for p in span if gap(p)), None) or next((p for p in span if ends(p)), None) or s + limit
        out.append(cut)
        s = cut - over
    return out


def test_cuts_and_pieces(spark, empty):
    from lectern.llm.splitting import cuts, pieces

    rng = random.Random(3)

    def prose(n, stop, para):
        return "".join(rng.choice(VOCAB) + (rng.choice([". ", '." ', "?\n", "!) "]) if rng.random() < stop else "\n \n" if rng.random() < para else " ") for _ in range(n))

    texts = {f"t{i}": prose(rng.choice([399, 400, 401, 900, 2500]), rng.choice([0, 0.004, 0.05]), rng.choice([0, 0.002, 0.01])) for i in range(40)}
    texts |= {"none": None, "blank": " \n ", "long": "w " * 30000}
    df = make(spark, [(k, "t", x, None, None, None) for k, x in [*texts.items(), ("t1", texts["t1"]), (None, "w " * 500)]])
    want = {(k, c) for k, x in texts.items() for c in brute_cuts(x)}
    assert rows_of(cuts(df)) == want
    assert cuts(empty).count() == 0
    got = pieces(df).collect()
    assert max(r.word_count for r in got) <= 400
    for k in {r.chunk_id for r in got}:
        own = sorted((r for r in got if r.chunk_id == k), key=lambda r: r.piece_index)
        ws = texts[k].split()
        assert own[0].first_word == 0 and own[-1].first_word + own[-1].word_count == len(ws)
        assert all(r.text.split() == ws[r.first_word : r.first_word + r.word_count] for r in own)
        assert all(b.first_word == a.first_word + a.word_count - 75 for a, b in zip(own, own[1:]))


# -- 4 -----------------------------------------------------------------------------------


def test_near_pairs_and_groups(spark, chunks, empty):
    from lectern.llm.nearcopies import near_groups, near_pairs

    recs = distinct_records()
    want = {(a[0], b[0]) for i, a in enumerate(recs) for b in recs[i + 1 :] if a[0] != b[0] and near(a, b)}
    assert rows_of(near_pairs(chunks)) == want
    assert near_pairs(empty).count() == 0
    parent = {r[0]: r[0] for r in recs if len(fold(r[2])) >= 20}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in want:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    groups = near_groups(chunks).collect()
    assert {(r.chunk_id, r.class_id) for r in groups} == {(k, root(k)) for k in parent}
    assert near_groups(empty).count() == 0


def test_pairs_do_not_depend_on_the_partitions(spark):
    from lectern.llm.common import pairs_within
    from lectern.llm.nearcopies import colliding, near_pairs

    rows = [(1, 5), (1, 5), (1, 7), (2, 5), (2, 7), (2, 7), (3, 4), (3, 4), (4, 1), (4, 2), (4, 2), (4, 3), (4, 1)]
    df = spark.createDataFrame(rows, "k long, bag long")
    for n in (1, 3, 8):
        assert rows_of(colliding(df.repartition(n))) == {(5, 7), (1, 2), (1, 3), (2, 3)}
    groups = spark.createDataFrame([(g, m, n) for g, n in ((0, 1), (1, 3), (2, 90)) for m in range(n)], "g int, m int, n long")
    assert sorted(map(tuple, pairs_within(groups, "g", "m", F.col("n"), 8).collect())) == [(g, a, b) for g, n in ((1, 3), (2, 90)) for a in range(n) for b in range(a + 1, n)]
    recs = distinct_records()
    every = make(spark, [(*r, None, None, None) for r in recs])
    want = {(a[0], b[0]) for i, a in enumerate(recs) for b in recs[i + 1 :] if near(a, b)}
    for n in (1, 8, 64):
        assert rows_of(near_pairs(every.repartition(n))) == want


def test_every_pair_within_the_radius_collides():
    from lectern.llm.nearcopies import MASKS, cover_keys

    assert sorted(map(len, MASKS)) == [4] * 7
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**32, (1, 21)).astype(np.uint32)
    for i in range(7):
        for j in range(7):
            b = a.copy()
            b[0, 3 * i] += 1
            b[0, 3 * j + 1] += 1
            assert (cover_keys(a, 1, 3) == cover_keys(b, 1, 3)).any()


def test_components_of_a_long_chain(spark):
    from lectern.llm.nearcopies import components

    links = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    nodes = spark.range(202).select(F.col("id").alias("bag"))
    assert {(r.node, r["class"]) for r in components(links, nodes).collect()} == {*((i, 0) for i in range(201)), (201, 201)}


# -- 5 -----------------------------------------------------------------------------------


def test_neighbours(spark, empty):
    from lectern.llm.neighbours import close_pairs, most_similar, nearest, search

    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 64))
    x = np.concatenate([base, base[:200] + rng.normal(size=(200, 64)) * 0.3, base[:5] * 3])
    rows = [(f"v{i:03}", "t", "x", None, None, [float(y) for y in v]) for i, v in enumerate(x)]
    rows += [("null", "t", "x", None, None, None), ("zero", "t", "x", None, None, [0.0] * 64), ("short", "t", "x", None, None, [1.0]), (None, "t", "x", None, None, [1.0] * 64), rows[0]]
    rows.append(("holes", "t", "x", None, None, [None, float("nan")] + [1.0] * 62))
    df = make(spark, rows)
    x = np.concatenate([x, [[0.0, 0.0] + [1.0] * 62]]).astype(np.float32).astype(np.float64)
    ids = [f"v{i:03}" for i in range(505)] + ["holes"]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {tuple(sorted((ids[i], ids[j]))) for i in range(len(ids)) for j in np.argsort(-s[i], kind="stable")[:5] if s[i, j] >= 0.85}
    got = rows_of(close_pairs(df))
    assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.01 * len(want)
    top = most_similar(df).collect()
    best = {ids[i]: {ids[j] for j in np.argsort(-s[i], kind="stable")[:5]} for i in range(len(ids))}
    assert sum(r.other in best[r.chunk_id] for r in top) >= 0.9 * 5 * len(ids)
    assert close_pairs(empty).count() == 0 and most_similar(empty).count() == 0
    vectors, graph = nearest(df)
    nodes = vectors.groupBy(F.col("vid").alias("id")).agg(F.min("q").alias("q"))
    found = search(vectors.select(F.col("key").alias("query"), "q"), nodes, graph).collect()
    name = {r.key: r.vid for r in vectors.collect()}
    first = {r.query for r in found if r.id == name[r.query]}
    assert len(first) >= 0.9 * len(ids)


def test_neighbours_in_a_crowded_region(spark):
    from lectern.llm.neighbours import close_pairs

    rng = np.random.default_rng(2)
    center = rng.normal(size=64)
    crowd = center + rng.normal(size=(2500, 64)) * 0.35
    x = np.concatenate([crowd, crowd + rng.normal(size=crowd.shape) * 0.1, rng.normal(size=(10_000, 64))]).astype(np.float32)
    ids = np.array([f"v{i:05}" for i in range(len(x))])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = set()
    for i in range(0, 5000, 500):
        s = u[i : i + 500] @ u.T
        s[np.arange(500), np.arange(i, i + 500)] = -2
        for r, row in enumerate(np.argpartition(-s, 5, axis=1)[:, :5]):
            want |= {tuple(sorted((ids[i + r], ids[j]))) for j in row if s[r, j] >= 0.85}
    df = spark.createDataFrame([(k, [float(y) for y in v]) for k, v in zip(ids, x)], "chunk_id string, embedding array<float>")
    got = rows_of(close_pairs(df))
    assert len(got & want) >= 0.99 * len(want)


def test_close_pairs_share_a_cell_at_any_size():
    from lectern.llm.neighbours import CLOSE, _cells, directions

    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 64))
    y = x + rng.normal(size=x.shape) * 0.5  # cosines about 0.9
    x, y = ((v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32) for v in (x, y))
    for n in (15_000, 150_000, 1_500_000, 30_000_000):
        e = CLOSE.at(n)
        side = int(np.ceil(np.sqrt(n * e.split / e.per_cell)))
        sets = [(directions(side, 64, 2 * t + 1), directions(side, 64, 2 * t + 2)) for t in range(e.trees)]
        a, b = (_cells(v, sets, side, e.split) for v in (x, y))
        a, b = ({*zip(*map(np.ndarray.tolist, v))} for v in (a, b))
        assert len({row for row, _ in a & b}) >= 0.93 * len(x), n


def test_every_pair_of_a_full_cell_meets(spark):
    from lectern.llm.neighbours import Effort, cell_edges, cell_rows, packed

    x = np.random.default_rng(3).normal(size=(3000, 8)) * 0.1 + 1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = packed(x)
    nodes = spark.createDataFrame([(i, bytearray(v.tobytes())) for i, v in enumerate(q)], "id long, q binary").repartition(3)
    u = q / np.linalg.norm(q.astype(float), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    for most in (700, 5000):
        # one direction of each set: a single cell
        edges = cell_edges(cell_rows(nodes, 8, 1, Effort(split=1, trees=1), most), 8, 4).toPandas()
        top = edges.drop_duplicates(["id", "nbr"]).sort_values("sim").groupby("id").tail(4).groupby("id")["sim"].min().sort_index()
        assert len(top) == 3000 and np.allclose(top.to_numpy(), np.sort(s, 1)[:, -4], atol=1e-5)


# -- 6 -----------------------------------------------------------------------------------

BOOKS = [(1, "Genesis", "Gen", 50), (9, "1 Samuel", "1 Sam", 31), (10, "2 Samuel", "2 Sam", 24), (19, "Psalms", "Ps", 150), (22, "Song of Solomon", "Song", 8), (32, "Jonah", "Jnh", 4), (40, "Matthew", "Matt", 28), (44, "Acts", "Ac", 28), (46, "1 Corinthians", "1 Cor", 16), (50, "Philippians", "Php", 4), (57, "Philemon", "Phlm", 1), (62, "1 John", "1 Jn", 5), (43, "John", "Jn", 21)]


@pytest.mark.parametrize(
    ("value", "book"),
    [("Genesis 3", 1), ("gen. 3:5f", 1), ("Genseis 4:1-2", 1), ("I Samuel 3", 9), ("2nd Samuel 3:4", 10), ("2-Sam11", 10), ("l Corinthians 3:28", 46), ("1Corinthians 3 v 4", 46), ("First  Corrinthans (3:4)", 46),
     ("Psalm 23", 19), ("The Psalms 80", 19), ("Song of Songs 2", 22), ("Songo f Solomon 2", 22), ("Jonoh 1", 32), ("cf. Matthew ch. 5:3", 40), ("Mattheew5", 40), ("St. Matthew 3", 40), ("Philip 1:9", 50), ("Philem 4", 57), ("1 John 1", 62),
     ("The Gospel according to John 3", 43), ("Johnch. 6:22", 43), ("Samuel 3", 0), ("3 Samuel 1", 0), ("Hymn 24", 0), ("Lesson 2-1", 0), ("n/a", 0), ("", 0), ("12:3", 0), ("Fenorvin 3:4", 0), ("x" * 100_000, 0)],
)
def test_choose(value, book):
    from lectern.llm.canonical import Trie, choose

    trie = Trie([(b, n, full) for b, name, short, _ in BOOKS for n, full in ((name, True), (short, False))] + [(19, "Psalm", False), (22, "Song of Songs", False)])
    assert choose(trie, value, {b: n for b, _, _, n in BOOKS})[0] == book


@pytest.mark.parametrize(
    ("value", "book"),
    [("Solomon's Song (5:12)", 22), ("Solomons Song 2", 22), ("Solomon\u2019s Sonng 2", 22), ("Song of Sogns 2", 22), ("Canticels 1", 22), ("Canticle of Canticles 1", 22), ("Acts of the Apostels 2", 44), ("Apocalipse 3", 66), ("Pslam 23", 19), ("Mtat 5:3", 40), ("Phlm 1", 57), ("Phil 1", 50), ("Johs 3", 43), ("Hymn 24", 0), ("Lesson 2-1", 0), ("Page 3", 0), ("Gan 3", 0)],
)
def test_aliases_and_their_typing_errors(spark, value, book):
    from lectern.llm.canonical import match_references

    books = spark.createDataFrame([*BOOKS, (6, "Joshua", "Josh", 24), (66, "Revelation", "Rev", 22)], "book_id long, book_name string, short_form string, n_chapters int")
    assert [r.book_id for r in match_references(make(spark, [("a", "t", "x", None, [value], None)]), books).collect()] == [book]


def test_automaton_against_edit_distance():
    from lectern.llm.canonical import Trie, limit

    def distance(a, b):
        d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    rng = random.Random(2)
    names = ["".join(rng.choice("abc") for _ in range(rng.randint(3, 10))) for _ in range(60)]
    trie = Trie([(i, n, True) for i, n in enumerate(names)])
    for _ in range(200):
        x = "".join(rng.choice("abc") for _ in range(rng.randint(1, 11)))
        assert trie.within("", x) == {i: distance(x, n) for i, n in enumerate(names) if distance(x, n) <= limit(len(n))}


def test_match_references(spark, empty):
    from lectern.llm.canonical import match_references

    books = spark.createDataFrame([(b, n, s, c) for b, n, s, c in BOOKS] + [(99, None, None, None)], "book_id long, book_name string, short_form string, n_chapters int")
    df = make(spark, [("a", "t", "x", None, ["Genesis 1:2", None, "Genseis 1", ""], None), ("b", "t", "x", None, [], None), ("c", "t", "x", None, None, None), (None, "t", "x", None, ["Gen 1"], None), ("a", "t", "x", None, ["Genesis 1:2", None, "Genseis 1", ""], None)])
    got = {(r.chunk_id, r.ref_pos, r.exact, r.book_id) for r in match_references(df, books).collect()}
    assert got == {("a", 0, True, 1), ("a", 2, False, 1), ("a", 3, False, 0)}
    assert match_references(empty, books).count() == 0
    assert {r.book_id for r in match_references(df, books.limit(0)).collect()} == {0}


# -- 7 -----------------------------------------------------------------------------------


def test_leaks(spark):
    from lectern.llm.leaks import leaks

    rng = random.Random(4)
    items = [(i, text(rng, rng.choice([5, 12, 13, 20, 80]))) for i in range(30)] + [(90, None), (91, ""), (None, text(rng, 40))]
    docs = []
    for d in range(60):
        ws = text(rng, rng.choice([0, 20, 200])).split()
        if rng.random() < 0.6:
            item = rng.choice(items[:30])[1].split()
            a = rng.randrange(len(item))
            ws[len(ws) // 2 : len(ws) // 2] = [w.upper() + rng.choice(["", ",", " --"]) for w in item[a : a + rng.choice([12, 13, 14, 60])]]
        docs.append((d, " ".join(ws)))
    docs += [(1000, None), (1001, items[3][1] * 2), (None, items[3][1]), (1001, items[3][1] * 2)]
    grams = lambda s: {tuple(fold(s)[i : i + 13]) for i in range(len(fold(s)) - 12)}
    want = {(d, i, len(grams(x) & grams(y)), len(grams(y))) for d, x in docs for i, y in items if d is not None and i is not None and grams(x) & grams(y)}
    c = spark.createDataFrame([(*d, 1, "m", "w") for d in docs], "doc_id long, text string, id int, m string, words string")
    e = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_runs, r.item_runs) for r in leaks(c, e).collect()}
    assert got == want and len(want) > 5
    assert leaks(c.limit(0), e).count() == 0 and leaks(c, e.limit(0)).count() == 0


# -- 8 -----------------------------------------------------------------------------------


def test_mix(spark):
    from lectern.llm.mixing import TOKENIZER, encoder, mix, token_counts

    rng = random.Random(6)
    words = {"a": VOCAB[:100], "b": VOCAB[100:200], "c": VOCAB[200:300], "d": VOCAB[300:]}
    rows, i = [], 0
    for s, n in (("a", 200), ("b", 60), ("c", 10), ("d", 30)):
        for _ in range(n):
            rows.append((i, " ".join(rng.choice(words[s]) for _ in range(30)), s, 1.0, 2))
            i += 1
    rows += [(i, None, "a", 0.0, 0), (i + 1, "unlabelled text", None, 0.0, 0), (i + 2, "", "b", 0.0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, rate double, uses int")
    targets = spark.createDataFrame([("a", 0.3, 2), ("b", 0.4, 4), ("c", 0.2, 3), ("gone", 0.1, 9), (None, 0.5, 1), ("a", 0.3, 2)], "source string, target_share double, max_repeats int")
    used, report = mix(docs, targets)
    got = {r.source: r for r in report.collect()}
    size = sum(token_counts([r[1] for r in rows if r[2] in {"a", "b", "c"}], encoder(TOKENIZER)))
    assert set(got) == {"a", "b", "c", "gone"}
    assert {s for s, r in got.items() if not r.can_reach} == {"c", "gone"}
    assert {s for s, r in got.items() if r.short} >= {"c", "gone"}
    assert all(r.fitted_tokens <= r.max_repeats * r.tokens + 1e-6 and r.goal_tokens == pytest.approx(r.target_share * size) for r in got.values())
    assert got["a"].used_tokens == pytest.approx(0.3 * size, rel=0.1) and got["b"].used_tokens == pytest.approx(0.4 * size, rel=0.1)
    assert got["c"].used_tokens == 3 * got["c"].tokens
    assert sum(r.reached_share for r in got.values()) == pytest.approx(1)
    caps = {"a": 2, "b": 4, "c": 3}
    assert all(0 <= r.uses <= caps.get(r.source, 0) for r in used.collect())
    assert used.count() == len(rows)
    u, r = mix(docs.limit(0), targets)
    assert u.count() == 0 and {x.reached_share for x in r.collect()} == {0.0}
    assert mix(docs, targets.limit(0))[1].count() == 0


def test_posteriors_change_the_rates(spark):
    """Of one source, rows that read like another domain are used at another rate."""
    from lectern.llm.mixing import mix

    rng = random.Random(3)
    a, b = VOCAB[:150], VOCAB[200:350]
    draw = lambda pool: " ".join(rng.choice(pool) for _ in range(40))
    rows = [(i, draw(a), "a") for i in range(80)] + [(100 + i, draw(b), "b") for i in range(80)] + [(200 + i, draw(b), "a") for i in range(15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.2, 5), ("b", 0.8, 5)], "source string, target_share double, max_repeats int")
    rate = {r.doc_id: r.rate for r in mix(docs, targets)[0].collect()}
    own, alike = [rate[i] for i in range(80)], [rate[200 + i] for i in range(15)]
    assert min(alike) > max(own)


def test_domain_classifier_on_held_out_rows(spark):
    from lectern.llm.bags import WordHashes
    from lectern.llm.mixing import _features, _posteriors, fit_domains

    rng = random.Random(8)
    pools = {"x": VOCAB[:200], "y": VOCAB[150:350], "z": VOCAB[200:]}
    draw = lambda s: " ".join(rng.choice(pools[s]) for _ in range(60))
    rows = [(i, draw(s), s) for i, s in enumerate("xyz" * 80)]
    docs = spark.createDataFrame([(i, "xyz".index(s), t) for i, t, s in rows], "key long, label int, text string")
    model = fit_domains(docs, np.array([80.0, 80.0, 80.0]), 60)
    test = [(draw(s), k) for _ in range(40) for k, s in enumerate("xyz")]
    p = _posteriors(*_features([t for t, _ in test], WordHashes()), model)
    assert (p.argmax(1) == [k for _, k in test]).mean() > 0.95


# -- 9 -----------------------------------------------------------------------------------


def test_cut_texts(spark):
    from lectern.llm.truncated import cut_rates, endings

    rng = random.Random(9)
    nouns = [f"noun{i}" for i in range(40)]
    sentence = lambda: f"The {rng.choice(nouns)} of the {rng.choice(nouns)} was in the {rng.choice(nouns)} with a {rng.choice(nouns)}."
    body = lambda: "\n\n".join(" ".join(sentence() for _ in range(rng.randint(2, 5))) for _ in range(3))
    rows, want = [], set()
    closings = ["Amen", "Hymn 12", "Hymn 40", "Recorded in Town", "End of part 3", "Next week: The Nouns of Hope"]
    for i in range(400):
        t = body()
        if i % 8 == 0:
            t = t[: len(t) * 2 // 3].rstrip(". \n") + rng.choice(["", "...", "…", " &am", "�", " [...]", "... Read more", "  \n"])
            want.add(i)
        elif i % 3 == 0:
            t += "\n\n" + rng.choice(closings)
        elif i % 5 == 0:
            t = t[:-1] + rng.choice(['."', "!", "?", ".)", ".\n\n"])
        rows.append((i, "s1", t))
    for i in range(400, 460):  # a field limit
        t = (body() * 2)[:500]
        rows.append((i, "s2", t))
        if not t.rstrip().endswith("."):
            want.add(i)
    quoted = body() + ' "Why did the noun1 come?'
    rows += [(900, None, body()), (901, "s1", None), (902, "s1", ""), (903, "s1", "   "), (904, "s1", quoted), (900, None, rows[1][2]), (905, "s1", (sentence() + " ") * 3000)]
    want.add(904)
    df = spark.createDataFrame([(*r, "e", 1) for r in rows], "doc_id long, source string, text string, last string, open int")
    got = endings(df)
    assert {r.doc_id for r in got.where("cut").collect()} == want
    # nothing but the share of a gram's ends decides
    assert endings(df, rare=1e9).where("cut").count() > len(want)
    rates = {r.source: r for r in cut_rates(got).collect()}
    assert rates["s2"].limit and not rates["s1"].limit
    assert endings(df.limit(0)).count() == 0
