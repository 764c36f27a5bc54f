"""SQL for DuckDB that gives the same rows as the queries of this package, where SQL can.

p2 (order-dependent acceptance), p6 (edit distance in a trie), p5_neighbours and p5_search
(approximate indexes) and p8's fitted uses are held against brute force in tests/llm instead.
"""

from __future__ import annotations

from lectern.llm import truncated

FOLD = r"regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}]+')"
C = "c AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at) AS rn FROM chunks WHERE chunk_id IS NOT NULL) WHERE rn = 1)"

TERMS = f"""{C}, w AS (SELECT chunk_id, {FOLD.format('text')} AS w, list_distinct(list_filter(list_transform(coalesce(topics, []), lambda t: array_to_string({FOLD.format('t')}, ' ')), lambda t: t <> '')) AS ts FROM c),
    top AS (SELECT chunk_id, unnest(ts) AS term FROM w), voc AS (SELECT DISTINCT term, len(string_split(term, ' ')) AS k FROM top), ks AS (SELECT DISTINCT k FROM voc),
    g AS (SELECT chunk_id, array_to_string(w[i + 1:i + k], ' ') AS term FROM (SELECT chunk_id, w, k, unnest(range(len(w) - k + 1)) AS i FROM w, ks WHERE len(w) >= k)),
    joint AS (SELECT chunk_id, term, count(*) AS tf FROM g SEMI JOIN voc USING (term) GROUP BY ALL), st AS (SELECT term, count(*) AS df, sum(tf) AS total FROM joint GROUP BY term),
    al AS (SELECT count(*) AS n, sum(pow(len(w), 0.75)) AS smooth FROM w),
    sc AS (SELECT top.chunk_id, top.term, coalesce(tf, 0) AS tf, coalesce(df, 0) AS df, n, total, len(w.w) AS len, coalesce(tf * ln(n / df), 0) AS s,
        coalesce(greatest(0, ln(tf * smooth / (total * pow(len(w.w), 0.75)))), 0) AS ppmi FROM top JOIN w USING (chunk_id) LEFT JOIN joint USING (chunk_id, term) LEFT JOIN st ON st.term = top.term, al)"""
BAGS = f"""{C}, b AS (SELECT chunk_id, list_concat({FOLD.format('title')}, {FOLD.format('text')}) AS w, len({FOLD.format('text')}) AS nt FROM c), k AS (SELECT chunk_id, w, len(w) AS n FROM b WHERE nt >= 20),
    u AS (SELECT chunk_id, n, t, count(*) AS m FROM (SELECT chunk_id, n, unnest(w) AS t FROM k) GROUP BY ALL),
    pr AS (SELECT x.chunk_id AS a, y.chunk_id AS b, x.n AS na, y.n AS nb, sum(least(x.m, y.m)) AS i FROM u x JOIN u y ON x.t = y.t AND x.chunk_id < y.chunk_id AND y.n BETWEEN 0.8 * x.n AND 1.25 * x.n GROUP BY ALL)"""



def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_END = f"regexp_matches({{0}}, {_q(truncated.SENTENCE_END)})"
_KIND = f"""CASE WHEN substr({{0}}, 1, 1) BETWEEN '0' AND '9' THEN CASE WHEN {_END} THEN 'M' ELSE 'N' END WHEN {_END} THEN 'E' WHEN substr({{0}}, 1, 1) = '(' THEN 'B' ELSE 'W' END"""
_ELIGIBLE = f"t <> '' AND NOT substr(t, 1, 1) BETWEEN '0' AND '9' AND NOT {_END.format('t')}"
ENDINGS = rf"""x AS (SELECT row_number() OVER () AS r, doc_id, source, length(text) AS size, text, regexp_replace(lower(text), {_q(truncated.LEFT)}, '') AS core FROM documents WHERE text IS NOT NULL),
    y AS (SELECT *, regexp_extract(core, '[^\n]*\z') AS tail FROM x WHERE core <> ''), z AS (SELECT *, CASE WHEN regexp_matches(tail, {_q(truncated.OPEN_QUOTE)}) THEN regexp_replace(tail, {_q(truncated.SENTENCE_END)}, '') ELSE tail END AS line FROM y),
    com AS (SELECT list(t) AS c FROM (SELECT t FROM (SELECT unnest(regexp_extract_all(core, '\S+')) AS t FROM z) WHERE {_ELIGIBLE} GROUP BY t ORDER BY count(*) DESC, t LIMIT {truncated.COMMON})),
    ope AS (SELECT list(t) AS p FROM (SELECT t FROM (SELECT regexp_extract(line, '\S+') AS t FROM z WHERE NOT {_END.format('line')}) WHERE {_ELIGIBLE} GROUP BY t ORDER BY count(*) DESC, t LIMIT {truncated.OPENERS})),
    ls AS (SELECT r, unnest(ls) AS w, unnest(range(len(ls))) AS k FROM (SELECT r, list_filter(list_transform(list_append(string_split(left(core, length(core) - length(tail)), chr(10)), line), lambda l: regexp_extract_all(l, '\S+')), lambda w: len(w) > 0) AS ls FROM z)),
    ow AS (SELECT r, k, w, list_transform(w, lambda t: CASE WHEN list_contains(coalesce(c, []), t) THEN t ELSE {_KIND.format('t')} END) AS o, p FROM ls, com, ope),
    hd AS (SELECT *, coalesce(list_min(list_filter(range(1, len(o) + 1), lambda i: o[i] IN ('E', 'M'))), 1000000000) AS f, CASE WHEN list_contains(coalesce(p, []), w[1]) THEN w[1] ELSE o[1] END AS one, CASE WHEN list_contains(coalesce(p, []), w[2]) THEN w[2] ELSE o[2] END AS two FROM ow),
    gr AS (SELECT r, k, i, CASE WHEN i < f THEN '^ ' || one || CASE WHEN i = 1 THEN ' - 0 ' WHEN i = 2 THEN ' ' || two || ' 1 ' ELSE ' ' || two || ' 2 ' END || o[i]
        ELSE concat_ws(' ', CASE WHEN i > 2 THEN o[i - 2] END, CASE WHEN i > 1 THEN o[i - 1] END, o[i]) END AS g FROM (SELECT *, unnest(range(1, len(o) + 1)) AS i FROM hd)),
    la AS (SELECT r, arg_max(g, (k, i)) AS g FROM gr GROUP BY r), st AS (SELECT g, count(*) AS n, coalesce(any_value(t), 0) AS t FROM gr LEFT JOIN (SELECT g, count(*) AS t FROM la GROUP BY g) USING (g) GROUP BY g),
    pa AS (SELECT *, string_split(g, ' ') AS p, starts_with(g, '^ ') AS op FROM st), kd AS (SELECT *, CASE WHEN p[-1] IN ('W', 'E', 'B', 'N', 'M') THEN p[-1] ELSE 'W' END AS x, least(p[4], '1') AS place FROM pa),
    sh AS (SELECT g, n, t, op, concat_ws(' ', array_to_string(p[:-2], ' '), x) AS g1, CASE WHEN op THEN concat_ws(' ', '^', p[2], place, x) ELSE concat_ws(' ', '|', p[-2], x) END AS g2,
        CASE WHEN op THEN concat_ws(' ', '^^', CASE WHEN p[2] IN ('W', 'E', 'B', 'N', 'M') THEN p[2] ELSE 'W' END, place, x) ELSE concat_ws(' ', '||', CASE WHEN len(p) < 2 THEN NULL WHEN p[-2] IN ('W', 'E', 'B', 'N', 'M') THEN p[-2] ELSE 'W' END, x) END AS g3 FROM kd),
    lv AS (SELECT g, op, sum(n) OVER (PARTITION BY g1) AS n1, sum(t) OVER (PARTITION BY g1) AS t1, sum(n) OVER (PARTITION BY g2) AS n2, sum(t) OVER (PARTITION BY g2) AS t2, sum(n) OVER (PARTITION BY g3) AS n3, sum(t) OVER (PARTITION BY g3) AS t3, sum(n) OVER () AS n, sum(t) OVER () AS t FROM sh),
    de AS (SELECT g, n, t, unnest(CASE WHEN n1 > CASE WHEN op THEN {truncated.LEAST_OPEN} ELSE {truncated.LEAST_INSIDE} END THEN {{'ins': n1 - 1, 'fin': t1 - 1, 'told': true}} WHEN n2 > CASE WHEN op THEN {truncated.LEAST_OPEN} ELSE {truncated.LEAST_INSIDE} END THEN {{'ins': n2 - 1, 'fin': t2 - 1, 'told': true}} ELSE {{'ins': n3 - 1, 'fin': t3 - 1, 'told': n3 > {truncated.LEAST_OPEN}}} END) FROM lv),
    en AS (SELECT DISTINCT doc_id, source, size, ins, fin, regexp_matches(substr(text, length(core) + 1), '\S') AS leftover, CASE WHEN told THEN fin * n <= 1.5 * ins * t ELSE NOT {_END.format('line')} END AS cut FROM z JOIN la USING (r) JOIN de USING (g)),
    sz AS (SELECT source, size, count(*) AS a FROM z GROUP BY source, size), li AS (SELECT source, size FROM (SELECT *, sum(a) OVER (PARTITION BY source) AS b FROM sz) WHERE a >= 5 AND a >= 0.04 * b)"""

CUTS = r"""WITH RECURSIVE c AS (SELECT chunk_id, any_value(text) AS text FROM chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id), t AS (SELECT chunk_id, regexp_extract_all(text, '\S+\s*') AS w FROM c), l AS (SELECT * FROM t WHERE len(w) > 400),
        p AS (SELECT chunk_id, unnest(range(1, len(w) + 1)) AS pos, unnest(list_transform(w, lambda x: CASE WHEN len(x) - len(replace(x, chr(10), '')) >= 2 THEN 2 WHEN regexp_matches(x, '[.!?]["'')\]”’]*\s*$') THEN 1 ELSE 0 END)) AS kind FROM l),
        cut AS (SELECT chunk_id, 0::BIGINT AS s, NULL::BIGINT AS cut_word FROM l UNION ALL
            SELECT chunk_id, nxt - 75, nxt FROM (SELECT cut.chunk_id, coalesce(max(pos) FILTER (WHERE kind = 2), max(pos) FILTER (WHERE kind = 1), cut.s + 400) AS nxt
                FROM cut JOIN l ON l.chunk_id = cut.chunk_id JOIN p ON p.chunk_id = cut.chunk_id AND p.pos BETWEEN cut.s + 201 AND cut.s + 400 WHERE len(l.w) - cut.s > 400 GROUP BY cut.chunk_id, cut.s))"""

SQL = {
    "p1_found": f"""WITH {TERMS}, r AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY s DESC, term DESC) AS r, count(*) OVER (PARTITION BY chunk_id) AS m FROM sc)
        SELECT a.chunk_id, a.term FROM r a LEFT JOIN r b ON a.chunk_id = b.chunk_id AND b.r = 2 WHERE a.r = 1 AND a.m >= 3 AND a.s > 0 AND a.s >= 2 * b.s""",
    "p1_scores": f"WITH {TERMS} SELECT chunk_id, term, tf, df, round(ppmi, 6) AS ppmi, round(s, 6) AS tf_idf FROM sc",
    "p3_found": f"{CUTS} SELECT chunk_id, cut_word FROM cut WHERE cut_word IS NOT NULL",
    "p3_pieces": rf"""{CUTS}, en AS (SELECT chunk_id, cut_word AS e FROM cut WHERE cut_word IS NOT NULL UNION ALL SELECT chunk_id, len(w) FROM l),
        sp AS (SELECT chunk_id, e, coalesce(lag(e) OVER (PARTITION BY chunk_id ORDER BY e) - 75, 0) AS s, row_number() OVER (PARTITION BY chunk_id ORDER BY e) - 1 AS i FROM en)
        SELECT chunk_id, i AS piece_index, s AS first_word, e - s AS word_count, regexp_replace(array_to_string(w[s + 1:e], ''), '\s+$', '') AS text FROM sp JOIN l USING (chunk_id)""",
    "p4_found": f"WITH {BAGS} SELECT a AS chunk_id_a, b AS chunk_id_b FROM pr WHERE i >= 0.8 * (na + nb - i)",
    "p4_groups": f"""WITH RECURSIVE {BAGS}, ok AS (SELECT a, b FROM pr WHERE i >= 0.8 * (na + nb - i)), e AS (SELECT a, b FROM ok UNION ALL SELECT b, a FROM ok),
        reach AS (SELECT chunk_id AS a, chunk_id AS b FROM k UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a), cls AS (SELECT a AS chunk_id, min(b) AS class_id FROM reach GROUP BY a),
        bag AS (SELECT chunk_id, list_sort(w) AS bag FROM k), ln AS (SELECT e.a AS chunk_id, count(DISTINCT CASE WHEN x.bag <> y.bag THEN y.bag END) AS n_links, count(*) FILTER (WHERE x.bag = y.bag) AS n_copies FROM e JOIN bag x ON e.a = x.chunk_id JOIN bag y ON e.b = y.chunk_id GROUP BY e.a)
        SELECT chunk_id, class_id, coalesce(n_links, 0) AS n_links, coalesce(n_copies, 0) AS n_copies FROM cls LEFT JOIN ln USING (chunk_id)""",
    "p5_found": """WITH c AS (SELECT chunk_id, CAST(any_value(embedding) AS DOUBLE[]) AS v FROM chunks WHERE embedding IS NOT NULL AND chunk_id IS NOT NULL GROUP BY chunk_id), n AS (SELECT chunk_id, v FROM c WHERE list_sum(list_transform(v, lambda x: abs(x))) > 0),
        s AS (SELECT x.chunk_id AS a, y.chunk_id AS b, list_cosine_similarity(x.v, y.v) AS s FROM n x JOIN n y ON x.chunk_id <> y.chunk_id), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM s WHERE s >= 0.85)
        SELECT DISTINCT least(a, b) AS chunk_id_a, greatest(a, b) AS chunk_id_b FROM r WHERE r <= 5""",
    "p7_found": f"""WITH i AS (SELECT item_id, {FOLD.format('text')} AS w FROM eval_items), ig AS (SELECT DISTINCT item_id, array_to_string(w[k + 1:k + 13], ' ') AS g FROM (SELECT item_id, w, unnest(range(len(w) - 12)) AS k FROM i WHERE len(w) >= 13)),
        d AS (SELECT doc_id, {FOLD.format('text')} AS w FROM documents), dg AS (SELECT doc_id, array_to_string(w[k + 1:k + 13], ' ') AS g FROM (SELECT doc_id, w, unnest(range(len(w) - 12)) AS k FROM d WHERE len(w) >= 13))
        SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
    "p7_containment": f"""WITH i AS (SELECT item_id, {FOLD.format('text')} AS w FROM eval_items), ig AS (SELECT DISTINCT item_id, array_to_string(w[k + 1:k + 13], ' ') AS g FROM (SELECT item_id, w, unnest(range(len(w) - 12)) AS k FROM i WHERE len(w) >= 13)),
        d AS (SELECT doc_id, {FOLD.format('text')} AS w FROM documents), dg AS (SELECT DISTINCT doc_id, array_to_string(w[k + 1:k + 13], ' ') AS g FROM (SELECT doc_id, w, unnest(range(len(w) - 12)) AS k FROM d WHERE len(w) >= 13)),
        z AS (SELECT item_id, count(*) AS item_runs FROM ig GROUP BY item_id), h AS (SELECT doc_id, item_id, count(*) AS n_runs FROM dg JOIN ig USING (g) GROUP BY ALL) SELECT doc_id, item_id, n_runs, item_runs, n_runs / item_runs AS containment FROM h JOIN z USING (item_id)""",
    # tokens as words, numbers and signs; any common tokenizer gives the same answer
    "p8_found": r"""WITH t AS (SELECT source, max(target_share) AS share, max(max_repeats) AS reps FROM mix_targets GROUP BY source), d AS (SELECT source, sum(len(regexp_extract_all(coalesce(text, ''), '\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+'))) AS size FROM documents SEMI JOIN t USING (source) GROUP BY source)
        SELECT t.source FROM t LEFT JOIN d USING (source) WHERE reps * coalesce(size, 0) < share * (SELECT sum(size) FROM d)""",
    "p9_found": f"WITH {ENDINGS} SELECT doc_id FROM en WHERE cut",
    "p9_rates": f"""WITH {ENDINGS} SELECT en.source, count(*) AS n_texts, sum(CAST(cut AS BIGINT)) AS n_cut, sum(CAST(cut AS BIGINT)) / count(*) AS cut_share, 2 * sum(CAST(cut AND li.size IS NOT NULL AS BIGINT)) > sum(CAST(cut AS BIGINT)) AS "limit"
        FROM en LEFT JOIN li ON en.source IS NOT DISTINCT FROM li.source AND en.size = li.size GROUP BY en.source""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
