"""DuckDB SQL for the queries that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE_SQL = {
    "op1_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
),
pairs AS (
  SELECT q.vec_id AS query_id, v.vec_id, cast(list_sum(list_transform(range(1, len(v.e) + 1), lambda i: v.e[i] * q.e[i])) AS BIGINT) AS score
  FROM v AS q, v WHERE q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id
)
SELECT query_id, cast(rank AS INT) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs
) WHERE rank <= 5
""",
    "op9_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT DISTINCT item_id, {_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s + 1 : s + least(10, len(w))], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(0, len(w) - least(10, len(w)) + 1)) AS s FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, s, array_to_string(w[s + 1 : s + n], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS s FROM d, sizes WHERE len(w) >= n)
),
hits AS (SELECT doc_id, item_id, s, dw.n AS n FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
  FROM (SELECT DISTINCT doc_id, cast(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, cast(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
""",
    "op12_ranked_search": f"""
WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
s AS (SELECT count(*) FILTER (WHERE len(w) > 0) AS n_docs, cast(sum(len(w)) AS BIGINT) AS n_terms FROM d),
t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY doc_id, term),
norms AS (SELECT doc_id, 75 + (25 * len(w) * n_docs) // n_terms AS m FROM d, s WHERE len(w) > 0),
weights AS (SELECT term, cast(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM t, s GROUP BY term, n_docs),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY item_id, term),
scored AS (
  SELECT item_id, doc_id, cast(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM q JOIN weights USING (term) JOIN t USING (term) JOIN norms USING (doc_id) GROUP BY item_id, doc_id
)
SELECT item_id, cast(rank AS INT) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0
) WHERE rank <= 20
""",
    "op13_filter_audit": r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
),
firsts AS (SELECT text, min(doc_id) AS first FROM t GROUP BY text),
marks AS (SELECT doc_id, max(cast(quality = 1 AS INT)) AS good, max(cast(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, {
    'A': len(w) < 100,
    'B': 100 * len(list_distinct(w)) < 80 * len(w),
    'C': 10 * length(regexp_replace(t.text, '[^A-Z]', '', 'g')) > length(t.text),
    'D': regexp_matches(t.text, '[#$%&*|]'),
    'E': coalesce(t.doc_id > first, false)} AS f
  FROM t JOIN firsts ON t.text = firsts.text LEFT JOIN marks ON t.doc_id = marks.doc_id
),
long AS (
  SELECT part, good, toxic, unnest(['A', 'B', 'C', 'D', 'E']) AS name, unnest([f.A, f.B, f.C, f.D, f.E]) AS failed, row FROM (SELECT *, row_number() OVER () AS row FROM m)
),
cells AS (
  SELECT part, names, count(*) AS n, sum(good) AS n_good, sum(toxic) AS n_toxic FROM (
    SELECT row, part, any_value(good) AS good, any_value(toxic) AS toxic, coalesce(string_agg(name, '') FILTER (WHERE failed), '') AS names FROM long GROUP BY row, part
  ) GROUP BY part, names
),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
perms AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
),
runs AS (SELECT filter_order, step, filter_order[step] AS own, filter_order[1 : step - 1] AS before FROM perms, (SELECT unnest(range(1, 6)) AS step)),
met AS (
  SELECT cells.*, filter_order, step, own, contains(names, own) AS fails, names = own AS alone,
    len(list_filter(string_split(names, ''), lambda x: x <> '' AND contains(before, x))) > 0 AS gone FROM cells, runs
),
steps AS (
  SELECT part, filter_order, cast(step AS INT) AS step, own,
    sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN gone AND fails THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN alone THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN NOT gone AND fails THEN n_good ELSE 0 END) AS good_lost,
    sum(CASE WHEN NOT gone AND fails THEN n_toxic ELSE 0 END) AS toxic_lost
  FROM met GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, cast(kept AS BIGINT) AS kept, cast(removed AS BIGINT) AS removed, cast(redundant AS BIGINT) AS redundant,
  cast(unique_fails AS BIGINT) AS unique_fails, cast(good_lost AS BIGINT) AS good_lost, cast(toxic_lost AS BIGINT) AS toxic_lost,
  cast(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM steps
""",
}
