"""The queries of this package as SQL for DuckDB, over the same whole tables."""

from __future__ import annotations

from lectern.functions.vocabulary import BOOK_ABBREVIATIONS, BOOKS, MONTHS, SERMON_TYPES, SYNONYMS, WEEKDAYS
from lectern.plans.queries import AS_OF, DATE_PHRASES, RANGE_PHRASES, K

SQL: dict[str, str] = {}


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


C = "c AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at) AS rn FROM chunks) WHERE rn = 1)"
TOK = r"list_filter(regexp_split_to_array(regexp_replace(lower(coalesce({0}, '')), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+'), lambda w: w <> '')"
WORDS = r"list_filter(regexp_split_to_array(coalesce({0}, ''), '\s+'), lambda w: w <> '')"
TSET = r"list_distinct(list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '\s+'), lambda w: w <> ''))"

BM25 = f"""
    {C}, tok AS (SELECT chunk_id AS id, {TOK.format('text')} AS w FROM c),
    p AS (SELECT id, len(w) AS dl, unnest(w) AS term FROM tok), postings AS (SELECT id, dl, term, count(*) AS tf FROM p GROUP BY ALL),
    s AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM tok), d AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
    r AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM d, s), m AS (SELECT avg(raw) AS mean FROM r),
    terms AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END AS idf FROM r, m)"""
SCORED = f"""
    qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({TOK.format('text')}) AS term FROM queries) GROUP BY ALL),
    scored AS (SELECT query_id, id, round(sum(qtf * idf * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
               FROM qt JOIN terms USING (term) JOIN postings USING (term), s GROUP BY ALL)"""


def top(src: str, k: int) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {src} WHERE score > 0) WHERE rank <= {k}"


SQL["bm25_stats"] = f"WITH {BM25} SELECT term, df, round(idf, 6) AS idf FROM terms"
SQL["bm25_topk"] = f"WITH {BM25}, {SCORED} SELECT query_id, id AS chunk_id, score, rank FROM ({top('scored', K)})"
SQL["bm25_filtered"] = f"""WITH {BM25}, {SCORED}, k AS (SELECT scored.* FROM scored JOIN c ON id = chunk_id WHERE chunk_type IN {SERMON_TYPES} AND year >= 2018)
    SELECT query_id, id AS chunk_id, score, rank FROM ({top('k', K)})"""


def knn(queries: str, items: str, k: int, floor: str = "") -> str:
    """queries(query_id, v), items(id, v)"""
    return f"""SELECT * FROM (SELECT query_id, id, cosine, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS rank FROM (
        SELECT query_id, id, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM {queries} a, {items} b) {floor}) WHERE rank <= {k}"""


EMB = """e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), eq AS (SELECT vec_id AS query_id, v FROM e WHERE vec_id % 20 = 0),
    ei AS (SELECT vec_id AS id, label, v FROM e)"""
SQL["knn_topk"] = f"WITH {EMB} {knn('eq', 'ei', 10)}"
SQL["knn_filtered"] = f"WITH {EMB}, f AS (SELECT * FROM ei WHERE label IN (1, 3, 5)) {knn('eq', 'f', 10, 'WHERE cosine >= 0.1')}"
SQL["multi_query_merge"] = f"""WITH {EMB}, r AS ({knn('eq', 'ei', 7)}),
    f AS (SELECT query_id // 60 AS query_id, id, min((query_id // 20 % 3, rank, cosine)) AS f FROM r GROUP BY 1, 2)
    SELECT query_id, id, f[3] AS cosine, row_number() OVER (PARTITION BY query_id ORDER BY f) AS rank FROM f"""

ALIAS = "alias AS (SELECT * FROM (VALUES " + ", ".join(f"({q(k)}, {q(v)})" for k, v in {**BOOK_ABBREVIATIONS, **{b: b for b in BOOKS}}.items()) + ") AS x(name, book))"
META = q(r"^\s*([1-3]?\s*[A-Za-z][A-Za-z\s]*?)\s+(\d+):(\d+)(?:-(\d+))?")
REFS = f"""{C}, {ALIAS}, el AS (SELECT chunk_id, unnest(scripture_refs) AS ref, unnest(range(len(scripture_refs))) AS pos FROM c),
    g AS (SELECT chunk_id, pos, trim(ref) AS ref FROM el WHERE ref IS NOT NULL),
    parsed AS (SELECT chunk_id, pos, book, CAST(nullif(regexp_extract(ref, {META}, 2), '') AS BIGINT) AS chapter, CAST(nullif(regexp_extract(ref, {META}, 3), '') AS BIGINT) AS verse_start,
        CAST(coalesce(nullif(regexp_extract(ref, {META}, 4), ''), nullif(regexp_extract(ref, {META}, 3), '')) AS BIGINT) AS verse_end
        FROM g LEFT JOIN alias ON name = regexp_replace(lower(trim(regexp_extract(ref, {META}, 1))), '\\s+', ' ', 'g'))"""
SQL["scripture_parse"] = f"""WITH {REFS} SELECT chunk_id, pos, book, CASE WHEN book IS NOT NULL THEN chapter END AS chapter, CASE WHEN book IS NOT NULL THEN verse_start END AS verse_start,
    CASE WHEN book IS NOT NULL THEN verse_end END AS verse_end FROM parsed"""
ENTRIES = "entries AS (SELECT DISTINCT book, chapter, chunk_id FROM parsed WHERE book IS NOT NULL)"
SQL["scripture_index"] = f"WITH {REFS}, {ENTRIES} SELECT book, count(DISTINCT chapter) AS n_chapters, count(*) AS n_entries FROM entries GROUP BY book"
NAMES = "|".join(sorted([*BOOKS, *BOOK_ABBREVIATIONS], key=lambda n: (-len(n), n)))
INTEXT = q(rf"(?i)\b({NAMES})\.?\s+(\d+)(?::(\d+))?(?:-(\d+))?\b")
QREFS = f"""qx AS (SELECT query_id, regexp_extract_all(text, {INTEXT}, 1) AS b, regexp_extract_all(text, {INTEXT}, 2) AS ch, regexp_extract_all(text, {INTEXT}, 3) AS v FROM queries WHERE text IS NOT NULL),
    qe AS (SELECT query_id, unnest(b) AS b, unnest(ch) AS ch, unnest(v) AS v, unnest(range(len(b))) AS i FROM qx),
    qm AS (SELECT query_id, i, book, CAST(ch AS BIGINT) AS chapter, CAST(nullif(v, '') AS BIGINT) AS verse FROM qe JOIN alias ON name = regexp_replace(lower(b), '\\s+', ' ', 'g')),
    qd AS (SELECT query_id, book, chapter, verse, min(i) AS i FROM qm GROUP BY ALL)"""
SQL["scripture_extract"] = f"WITH {ALIAS}, {QREFS} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY i) - 1 AS pos, book, chapter, verse FROM qd"
SQL["scripture_lookup"] = f"WITH {REFS}, {ENTRIES}, {QREFS} SELECT DISTINCT query_id, chunk_id FROM qd JOIN entries USING (book, chapter)"

ARMS = f"""{BM25}, {SCORED}, {ALIAS}, {REFS.split(ALIAS + ',')[1]}, {ENTRIES}, {QREFS},
    vq AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IN (SELECT query_id FROM queries)),
    vi AS (SELECT chunk_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM c WHERE embedding IS NOT NULL AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
    arms AS (SELECT query_id, id, 'semantic' AS arm, rank, round(cosine, 3) AS score FROM ({knn('vq', 'vi', 28)})
        UNION ALL SELECT query_id, id, 'lexical', rank, score FROM ({top('scored', 28)})
        UNION ALL SELECT query_id, chunk_id, 'scripture', row_number() OVER (PARTITION BY query_id ORDER BY chunk_id), 1.0 FROM (SELECT DISTINCT query_id, chunk_id FROM qd JOIN entries USING (book, chapter))),
    piv AS (SELECT query_id, id, min(rank) FILTER (WHERE arm = 'semantic') AS a, min(rank) FILTER (WHERE arm = 'lexical') AS b, min(rank) FILTER (WHERE arm = 'scripture') AS s3, max(score) FILTER (WHERE arm = 'semantic') AS sem FROM arms GROUP BY ALL),
    fused AS (SELECT query_id, id, round(coalesce(1.0::DOUBLE / (60 + a), 0) + coalesce(1.0::DOUBLE / (60 + b), 0) + coalesce(2.0::DOUBLE / (60 + s3), 0), 9) AS rrf, coalesce(sem, 0) AS semantic_score, s3 IS NOT NULL AS is_scripture FROM piv),
    held AS (SELECT * FROM fused WHERE semantic_score >= 0.35 OR is_scripture)"""
SQL["rrf_fuse"] = f"WITH {ARMS} SELECT query_id, id AS chunk_id, rrf, semantic_score, is_scripture FROM fused"
HYBRID = "hybrid AS (SELECT query_id, id, rrf, round(semantic_score, 3) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, id) AS rank FROM held) WHERE rank <= 7)"
SQL["hybrid_search"] = f"WITH {ARMS}, {HYBRID} SELECT query_id, id AS chunk_id, rrf, score, rank FROM hybrid"


def stub(claim: str, text: str) -> str:
    return f"round(10 * coalesce(len(list_intersect({TSET.format(claim)}, {TSET.format(text)})) / nullif(len({TSET.format(claim)}), 0), 0) - 5, 6)"


RERANKED = f"""{ARMS}, cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, id) AS rk FROM held) WHERE rk <= 14),
    sc AS (SELECT cand.query_id, id, rrf, c.text, c.title, c.date, c.chunk_index, {stub('queries.text', 'c.text')} AS rerank_score FROM cand JOIN c ON id = c.chunk_id JOIN queries ON cand.query_id = queries.query_id),
    bl AS (SELECT *, round(0.6 * (1 / (1 + exp(-rerank_score))) + 0.4 * rrf / (CASE WHEN max(rrf) OVER (PARTITION BY query_id) > 0 THEN max(rrf) OVER (PARTITION BY query_id) ELSE 1 END), 9) AS f0,
        CASE WHEN regexp_matches(date, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN try_cast(date AS DATE) END AS d FROM sc),
    rr AS (SELECT *, CASE WHEN d IS NULL THEN f0 ELSE round(0.8 * f0 + 0.2 * exp(-greatest(0, date_diff('day', d, DATE '{AS_OF}')) / 365.0::DOUBLE), 9) END AS final_score,
        round(least(0.99, greatest(0.5, (rerank_score + 1) / 12)), 3) AS score FROM bl)"""
SQL["rerank_blend"] = f"WITH {RERANKED} SELECT query_id, id AS chunk_id, round(rerank_score, 6) AS rerank_score, round(final_score, 6) AS final_score, score FROM rr"

SQL["listing_mode"] = f"""WITH {C}, g AS (SELECT coalesce(date, '') AS date, coalesce(title, '') AS title, chunk_id, chunk_index, chunk_type,
        row_number() OVER (PARTITION BY coalesce(date, ''), coalesce(title, '') ORDER BY abs(coalesce(chunk_index, 0) - 1), chunk_id) AS r FROM c WHERE year = 2022)
    SELECT date, title, chunk_id, CAST(chunk_index AS BIGINT) AS chunk_index, chunk_type, 0.99::DOUBLE AS score FROM g WHERE r = 1 ORDER BY date DESC, title LIMIT 20"""
SQL["listing_total"] = "SELECT count(*) AS n_sermons FROM (SELECT DISTINCT coalesce(date, ''), coalesce(title, '') FROM chunks WHERE date_numeric BETWEEN 20200101 AND 20221231)"
SQL["latest_dates_dow"] = "SELECT DISTINCT CAST(date_numeric AS BIGINT) AS date_numeric FROM chunks WHERE day_of_week = 'wednesday' AND date_numeric > 0 ORDER BY 1 DESC LIMIT 12"
for name, cond in {
    "filter_year": "year = 2021",
    "filter_day": "date_numeric = 20220731",
    "filter_range": "date_numeric BETWEEN 20210601 AND 20220531",
    "filter_dow": "day_of_week = 'sunday'",
    "filter_source": f"chunk_type IN {SERMON_TYPES} AND year = 2020 AND day_of_week = 'sunday'",
}.items():
    SQL[name] = f"SELECT DISTINCT chunk_id FROM chunks WHERE {cond}"


def number(d: str) -> str:
    return f"(year({d}) * 10000 + month({d}) * 100 + day({d}))"


def service(d: str) -> str:
    """isodow counts Monday as 1."""
    return f"({d} - CAST(least((isodow({d}) + 0) % 7, (isodow({d}) + 4) % 7) AS INTEGER))"


SQL["date_fallback"] = f"""WITH {C}, d AS (SELECT query_id, DATE '2022-01-01' + CAST(query_id % 100 AS INTEGER) AS d FROM queries), n AS (SELECT date_numeric, count(*) AS n FROM c WHERE date_numeric > 0 GROUP BY 1),
    u AS (SELECT query_id, 0 AS tier, date_numeric, n FROM d JOIN n ON {number('d')} = date_numeric UNION ALL SELECT query_id, 1, date_numeric, n FROM d JOIN n ON {number(service('d'))} = date_numeric)
    SELECT query_id, CAST(tier AS BIGINT) AS tier, CAST(date_numeric AS BIGINT) AS date_numeric, n FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, date_numeric, n) AS r FROM u) WHERE r = 1"""

SOURCE = r"CASE WHEN regexp_matches(lower(text), '\bsermon\b|\bmessage\b') THEN 'sermon' WHEN regexp_matches(lower(text), '\blesson\b') THEN 'lesson' END"
HIST = "h AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC NULLS LAST, role DESC NULLS LAST) AS back FROM (SELECT DISTINCT conv_id, turn, role, text FROM chat_turns))"
SQL["source_detect_history"] = f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC NULLS LAST) AS r FROM (SELECT DISTINCT conv_id, turn, text FROM chat_turns)),
    s AS (SELECT conv_id, r, {SOURCE} AS s FROM t WHERE r <= 6) SELECT conv_id, arg_min(s, r) FILTER (WHERE s IS NOT NULL) AS source FROM s GROUP BY conv_id"""
SQL["history_window"] = f"WITH {HIST} SELECT conv_id, turn, role, back FROM h WHERE back <= 6"
SQL["history_digest"] = f"WITH {HIST} SELECT conv_id, string_agg(upper(coalesce(role, '')) || ': ' || left(coalesce(text, ''), 300), chr(10) ORDER BY back DESC) AS digest FROM h WHERE back <= 4 GROUP BY conv_id"

_syn = [(i, t, s) for i, (t, s) in enumerate((t, s) for t, syn in SYNONYMS.items() for s in syn[:2])]
SQL["query_expand"] = f"""WITH syn AS (SELECT * FROM (VALUES {', '.join(f'({i}, {q(t)}, {q(s)})' for i, t, s in _syn)}) AS x(i, term, syn)),
    v AS (SELECT query_id, -1 AS i, text AS variant FROM queries WHERE text IS NOT NULL UNION ALL SELECT query_id, i, replace(lower(text), term, syn) FROM queries, syn WHERE contains(lower(text), term)),
    d AS (SELECT query_id, variant, min(i) AS i FROM v GROUP BY ALL), r AS (SELECT query_id, variant, row_number() OVER (PARTITION BY query_id ORDER BY i) - 1 AS i FROM d) SELECT query_id, i, variant FROM r WHERE i < 3"""
SQL["paraphrase_dedupe"] = """WITH v AS (SELECT query_id, unnest([text, upper(text), '  ' || text, text || ' please', text || ' PLEASE ', 'amen']) AS x, unnest(range(6)) AS i FROM queries WHERE text IS NOT NULL),
    t AS (SELECT query_id, trim(x) AS x, i FROM v WHERE trim(x) <> ''), d AS (SELECT query_id, arg_min(x, i) AS variant, min(i) AS i FROM t GROUP BY query_id, lower(x)),
    r AS (SELECT query_id, variant, row_number() OVER (PARTITION BY query_id ORDER BY i) - 1 AS i FROM d) SELECT query_id, i, variant FROM r WHERE i < 4"""

DAYS = "days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)"
SQL["service_date"] = f"WITH {DAYS} SELECT day, {service('day')} AS service FROM days"


def case(c: str, of: dict) -> str:
    return f"CASE {c} " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in of.items()) + " END"


def made(y: str, m: str, d: str) -> str:
    return f"try_strptime(concat_ws('-', {y}, {m}, {d}), '%Y-%m-%d')::DATE"


_wd = r"^(last|this)\s+(monday|tuesday|wednesday|thursday|friday|saturday|sunday|mon|tue|wed|thu|fri|sat|sun)\b"
_full, _short, _iso = r"^([a-z]+)\s+(\d{1,2}),?\s+(\d{4})$", r"^([a-z]+)\s+(\d{1,2})$", r"^(\d{4})-(\d{1,2})-(\d{1,2})$"
_m = {k: v for k, v in MONTHS.items() if k != "sept"}
x = lambda p, i: f"regexp_extract(e, {q(p)}, {i})"
SQL["date_expr"] = f"""WITH {DAYS}, p AS (SELECT day, unnest([{', '.join(map(q, DATE_PHRASES))}]) AS phrase FROM days),
    n AS (SELECT day, phrase, regexp_replace(regexp_replace(lower(trim(phrase)), '\\b(most recent|recent|latest)\\b', 'last', 'g'), '\\bpast\\b', 'last', 'g') AS e FROM p),
    w AS (SELECT *, (isodow(day) - 1 - {case(x(_wd, 2), WEEKDAYS)} + 7) % 7 AS since, {case(x(_short, 1), _m)} AS sm, {case(x(_full, 1), _m)} AS fm FROM n)
    SELECT day, phrase, CASE WHEN e = '' THEN NULL WHEN regexp_matches(e, '\\blast\\s+(service|message|sermon)\\b') THEN {service('day')}
        WHEN regexp_matches(e, {q(_wd)}) THEN day - CAST(CASE WHEN {x(_wd, 1)} = 'last' AND since = 0 THEN 7 ELSE since END AS INTEGER)
        WHEN regexp_matches(e, {q(_iso)}) THEN {made(x(_iso, 1), x(_iso, 2), x(_iso, 3))} WHEN regexp_matches(e, {q(_full)}) THEN CASE WHEN fm IS NOT NULL THEN {made(x(_full, 3), 'fm', x(_full, 2))} END
        WHEN regexp_matches(e, {q(_short)}) AND sm IS NOT NULL AND NOT (sm = 2 AND {x(_short, 2)} = '29') THEN CASE WHEN {made('year(day)', 'sm', x(_short, 2))} <= day THEN {made('year(day)', 'sm', x(_short, 2))} ELSE {made('year(day) - 1', 'sm', x(_short, 2))} END END AS resolved FROM w"""
_mn = "|".join(sorted(MONTHS, key=len, reverse=True))
SQL["date_range"] = f"""WITH {DAYS}, p AS (SELECT day, unnest([{', '.join(map(q, RANGE_PHRASES))}]) AS phrase FROM days),
    n AS (SELECT *, lower(trim(phrase)) AS e, date_trunc('week', day)::DATE AS mon, date_trunc('month', day)::DATE AS f FROM p), m AS (SELECT *, {case(x(rf'\b({_mn})\b', 1), MONTHS)} AS m, try_cast(nullif({x(r'\b(\d{4})\b', 1)}, '') AS INTEGER) AS yy FROM n),
    s AS (SELECT *, CASE WHEN m IS NOT NULL THEN make_date(coalesce(yy, CASE WHEN m > month(day) THEN year(day) - 1 ELSE year(day) END), m, 1) END AS st FROM m)
    SELECT day, phrase, CASE WHEN contains(e, 'last week') THEN mon - 7 WHEN contains(e, 'this week') THEN mon WHEN contains(e, 'last month') THEN (f - INTERVAL 1 MONTH)::DATE WHEN contains(e, 'this month') THEN f ELSE st END AS first_day,
        CASE WHEN contains(e, 'last week') THEN mon - 1 WHEN contains(e, 'this week') THEN day WHEN contains(e, 'last month') THEN f - 1 WHEN contains(e, 'this month') THEN day WHEN st IS NOT NULL THEN least(last_day(st), day) END AS last_day FROM s"""
SQL["date_number_roundtrip"] = f"WITH {DAYS} SELECT day, {number('day')} AS number, day AS back FROM days"
SQL["date_hints"] = f"""WITH {DAYS} SELECT day, strftime(day, '%B %-d %Y') AS hint, strftime(day, '%B %Y') AS whole,
    CASE WHEN day(day) = 1 THEN strftime(day, '%B %Y') ELSE strftime(day, '%B %-d %Y') || ' to ' || strftime(last_day(day), '%B %-d %Y') END AS part FROM days"""
ISO = r"CASE WHEN regexp_matches(date, '^\d{4}-\d{2}-\d{2}$') THEN try_cast(date AS DATE) END"
SQL["derived_dates"] = f"WITH {C}, d AS (SELECT chunk_id, {ISO} AS d FROM c) SELECT chunk_id, coalesce(year(d), 0) AS year, coalesce({number('d')}, 0) AS date_numeric, coalesce(lower(dayname(d)), '') AS day_of_week FROM d"
SQL["backfill_dow"] = f"WITH {C}, d AS (SELECT chunk_id, day_of_week, {ISO} AS d FROM c) SELECT chunk_id, CASE WHEN coalesce(day_of_week, '') = '' AND d IS NOT NULL THEN lower(dayname(d)) ELSE day_of_week END AS day_of_week FROM d"

SQL["word_counts"] = f"SELECT doc_id, len({WORDS.format('text')}) AS n_words FROM documents"
HEAD = r"""hd AS (SELECT doc_id, text, regexp_extract(text, '^((?:(?:DATE|TITLE):[^\n]*(?:\n|$))*)', 1) AS head FROM documents),
    hp AS (SELECT doc_id, substr(text, length(head) + 1) AS body, trim(coalesce(regexp_extract_all(head, 'DATE:([^\n]*)', 1)[-1], '')) AS date, trim(coalesce(regexp_extract_all(head, 'TITLE:([^\n]*)', 1)[-1], '')) AS title FROM hd)"""
SQL["header_parse"] = f"WITH {HEAD} SELECT doc_id, date, title, length(body) AS body_length FROM hp"
BLOCKS = r"""bl AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(body, '\n[ \t\r]*\n\s*'), lambda b: trim(regexp_replace(b, '^\s+|\s+$', '', 'g'))), lambda b: b <> '') AS bs FROM hp),
    be AS (SELECT doc_id, unnest(bs) AS block, unnest(range(len(bs))) AS pos FROM bl)"""
SQL["para_split"] = f"WITH {HEAD}, {BLOCKS} SELECT doc_id, pos, md5(block) AS digest FROM be"
SQL["pack_paragraphs"] = f"""WITH RECURSIVE {HEAD}, {BLOCKS}, wc AS (SELECT doc_id, pos, block, len({WORDS.format('block')}) AS w FROM be),
    st AS (SELECT doc_id, pos, w AS acc, 0 AS k FROM wc WHERE pos = 0 UNION ALL
        SELECT wc.doc_id, wc.pos, CASE WHEN acc + w >= 400 THEN w ELSE acc + w END, CASE WHEN acc + w >= 400 THEN k + 1 ELSE k END FROM st JOIN wc ON wc.doc_id = st.doc_id AND wc.pos = st.pos + 1)
    SELECT doc_id, CAST(k AS BIGINT) AS k, count(*) AS n_paragraphs, md5(string_agg(block, chr(10) || chr(10) ORDER BY pos)) AS digest FROM st JOIN wc USING (doc_id, pos) GROUP BY doc_id, k"""
SQL["section_types"] = f"""WITH {C} SELECT chunk_id, CASE WHEN total_chunks <= 2 THEN 'body' WHEN chunk_index / total_chunks < 0.15 THEN 'intro' WHEN chunk_index / total_chunks > 0.85 THEN 'conclusion' ELSE 'body' END AS section FROM c"""
SQL["chunk_ids"] = f"WITH {C} SELECT chunk_id, md5(concat_ws('_', source_file, chunk_index::VARCHAR)) AS made FROM c"
LINES = "ls AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL)"
NOISE = r"""(trim(line) = '' OR (regexp_matches(trim(line), '(?i)^(review(ed)?|edit(ed)?|compiled?(\s+and\s+\w+)?|compilation(\s+and\s+\w+)?|translat(ed|ion)?(\s+and\s+\w+)?|based)\s+(by|on)\b') AND len(""" + WORDS.format("trim(line)") + r""") <= 10)
    OR regexp_matches(trim(line), '^\d+\s*\|\s*\d+\s+\w') OR regexp_matches(trim(line), '(?i)^show\s+commentar(y|ies)\s+here') OR regexp_matches(trim(line), '(?i)^\d+[-\d]*\s+\w[\w\s]+\s+by\s+\w+\s+\d{6}$')
    OR regexp_matches(trim(line), '^https?://\S+$') OR regexp_matches(trim(line), '^\[.+\]\(.+\)$') OR regexp_matches(upper(line), '^(TR:|TRX:|ENPE:|KOR:|EDIT:|TRANSLATED BY:)'))"""
SQL["noise_lines"] = f"WITH {LINES} SELECT doc_id, pos FROM ls WHERE {NOISE}"
SQL["substantive_lines"] = f"WITH {LINES} SELECT doc_id, count(*) AS n FROM ls WHERE regexp_matches(line, '\\p{{L}}') GROUP BY doc_id"
LF = q(r"(?i)^(\d{4})(\d{2})(\d{2})_([0-9\-]+)[\s_]+(.*?)(?:_+P[\s_]+\w+)?\.docx?$")
SQL["lesson_files"] = f"""WITH f AS (SELECT DISTINCT source_file, replace(source_file, '_pure.txt', '.docx') AS n FROM chunks), m AS (SELECT *, trim(regexp_replace(replace(replace(regexp_extract(n, {LF}, 5), '_s_', '''s '), '_', ' '), '\\s+', ' ', 'g')) AS t FROM f WHERE regexp_matches(n, {LF}))
    SELECT source_file, concat_ws('-', regexp_extract(n, {LF}, 1), regexp_extract(n, {LF}, 2), regexp_extract(n, {LF}, 3)) AS date, regexp_extract(n, {LF}, 4) AS lesson, CASE WHEN t = '' THEN 'Unknown Title' ELSE t END AS title FROM m"""
SQL["attachment_names"] = """WITH f AS (SELECT DISTINCT title FROM chunks WHERE title IS NOT NULL), n AS (SELECT title, regexp_replace(trim(string_split(title || ' (12 kB)', '(')[1]), '[\\\\/*?:"<>|]', '', 'g') AS r FROM f)
    SELECT title, CASE WHEN lower(r) LIKE '%.docx' OR lower(r) LIKE '%.doc' THEN r ELSE r || '.docx' END AS file FROM n"""

SQL["ingest_stats"] = f"WITH {C} SELECT source_file, chunk_type, count(*) AS n_chunks, round(avg(word_count), 6) AS avg_words FROM c GROUP BY ROLLUP (source_file, chunk_type)"
SQL["distinct_sources"] = "SELECT DISTINCT source_file FROM chunks WHERE source_file <> ''"
NEW = f"""{C}, nw AS (SELECT chunk_id, source_file, length(text) AS text_length FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY batch_id DESC, row_id DESC) AS r FROM chunk_batches WHERE chunk_id IS NOT NULL) WHERE r = 1),
    od AS (SELECT chunk_id, source_file, length(text) AS text_length FROM c)"""
SQL["upsert"] = f"WITH {NEW} SELECT * FROM od WHERE chunk_id NOT IN (SELECT chunk_id FROM nw) UNION ALL SELECT * FROM nw"
SQL["replace_files"] = f"WITH {NEW} SELECT * FROM od WHERE source_file NOT IN (SELECT source_file FROM nw WHERE source_file IS NOT NULL) UNION ALL SELECT * FROM nw WHERE source_file IS NOT NULL"
SQL["update_metadata"] = f"WITH {NEW} SELECT chunk_id, coalesce(nw.source_file, od.source_file) AS source_file, coalesce(nw.text_length, od.text_length) AS text_length FROM od LEFT JOIN nw USING (chunk_id)"
SQL["anti_join_substring"] = r"""WITH s AS (SELECT DISTINCT regexp_replace(source_file, '_pure\.txt$', '') AS stem FROM chunk_batches WHERE source_file IS NOT NULL), n AS (SELECT DISTINCT source_file FROM chunks WHERE source_file <> '')
    SELECT stem FROM s WHERE NOT EXISTS (SELECT 1 FROM n WHERE contains(n.source_file, s.stem))"""

ANS = "an AS (SELECT DISTINCT concat_ws('-', conv_id, turn, md5(text)) AS answer_id, conv_id, text AS answer FROM chat_turns WHERE text IS NOT NULL)"
CITED = r"list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(answer, '\[(\d+)\]', 1), lambda v: try_cast(v AS INTEGER)), lambda v: v BETWEEN 1 AND 6)))"
SQL["cite_extract"] = f"WITH {ANS} SELECT answer_id, coalesce(array_to_string({CITED}, ','), '') AS cited FROM an"
_ren = "answer"
for _i in range(1, 7):
    _ren = f"CASE WHEN list_contains(l, {_i}) THEN replace({_ren}, '[{_i}]', chr(1) || list_position(l, {_i}) || chr(2)) ELSE {_ren} END" if _i == 1 else f"replace({_ren}, '[{_i}]', CASE WHEN list_contains(l, {_i}) THEN chr(1) || list_position(l, {_i}) || chr(2) ELSE '[{_i}]' END)"
SQL["cite_renumber"] = f"""WITH {ANS}, l AS (SELECT answer_id, answer, {CITED} AS l FROM an) SELECT answer_id, CASE WHEN len(l) > 0 THEN replace(replace(regexp_replace({_ren}, '\\[(\\d+)\\]', '', 'g'), chr(1), '['), chr(2), ']') ELSE answer END AS answer FROM l"""
SQL["cite_verify"] = rf"""WITH {ANS}, so AS (SELECT answer_id, unnest(x) AS text, unnest(range(1, len(x) + 1)) AS n FROM (SELECT answer_id, list_filter(string_split(answer, '. '), lambda v: v <> '') AS x FROM an)),
    sl AS (SELECT answer_id, regexp_extract_all(answer, '[^.!?\n]+[.!?\n]+\s*|[^.!?\n]+\z') AS ss FROM an), se AS (SELECT answer_id, unnest(ss) AS s, unnest(range(len(ss))) AS pos FROM sl),
    cl AS (SELECT *, trim(regexp_replace(regexp_replace(s, '\s*\[\d+\]\s*', ' ', 'g'), '\s+', ' ', 'g')) AS claim, list_transform(regexp_extract_all(s, '\[(\d+)\]', 1), lambda v: try_cast(v AS INTEGER)) AS marks FROM se),
    k AS (SELECT answer_id, pos, claim, unnest(list_distinct(marks)) AS n FROM cl WHERE len(marks) > 0 AND length(claim) >= 20), o AS (SELECT answer_id, pos, bool_or({stub('claim', 'text')} > -0.5) AS ok FROM k JOIN so USING (answer_id, n) GROUP BY ALL),
    z AS (SELECT cl.*, coalesce(NOT ok, false) AS bad FROM cl LEFT JOIN o USING (answer_id, pos))
    SELECT answer_id, md5(string_agg(CASE WHEN bad THEN regexp_replace(regexp_replace(regexp_replace(s, '\[(\d+)\]', '', 'g'), '\s+([.,!?])', '\1', 'g'), '  +', ' ', 'g') ELSE s END, '' ORDER BY pos)) AS digest, CAST(sum(CASE WHEN bad THEN len(marks) ELSE 0 END) AS BIGINT) AS removed FROM z GROUP BY answer_id"""
SQL["context_build"] = f"""WITH {ARMS}, {HYBRID}, ch AS (SELECT query_id, rank, '[' || rank || '] ' || coalesce(date, '') || ' — ' || coalesce(title, '') || ' (' || upper(coalesce(chunk_type, '')) || ')'
        || CASE WHEN coalesce(array_to_string(list_filter(scripture_refs, lambda v: v IS NOT NULL), ', '), '') <> '' THEN ' | Scriptures: ' || array_to_string(list_filter(scripture_refs, lambda v: v IS NOT NULL), ', ') ELSE '' END || chr(10) || coalesce(c.text, '') AS p FROM hybrid JOIN c ON id = chunk_id)
    SELECT query_id, md5(string_agg(p, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS digest FROM ch GROUP BY query_id"""
SQL["source_cards"] = f"""WITH {C} SELECT date, title, chunk_type, 0.99::DOUBLE AS score, CASE WHEN length(text) > 250 THEN left(text, 250) || '...' ELSE text END AS preview,
    CASE WHEN topics IS NOT NULL THEN coalesce(array_to_string(list_filter(topics, lambda v: v IS NOT NULL), ', '), '') END AS topics, section_type AS section FROM c"""
SQL["escape_html"] = """SELECT doc_id, md5(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS digest FROM documents"""
SQL["format_answer"] = rf"""WITH {ANS} SELECT answer_id, replace(replace(regexp_replace(regexp_replace(answer, '\*\*(.*?)\*\*', '<strong>\1</strong>', 'g'), '\[(\d+)\]', '<a class="citation" data-mid="@@" data-src="\1" title="View source \1">\1</a>', 'g'), '@@', conv_id::VARCHAR), chr(10), '<br>') AS html FROM an"""


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
