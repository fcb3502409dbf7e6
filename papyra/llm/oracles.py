"""DuckDB twins of the queries that SQL can express; the other queries are held against brute force in the tests."""

ORACLES: dict[str, str] = {
    "op6_exact_dedup_fuse": r"""WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)""",
    "op11_accumulator_search": r"""WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
n AS (SELECT row_id, doc_id, len(words)::BIGINT AS n FROM d WHERE len(words) > 0),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM n),
tf AS (SELECT row_id, term, count(*)::BIGINT AS tf FROM (SELECT row_id, unnest(words) AS term FROM d) GROUP BY ALL),
q AS (SELECT item, item_id, term, count(*)::BIGINT AS times FROM (
  SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
      FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total),
s AS (SELECT q.item, q.item_id, n.doc_id, n.row_id,
             sum(q.times * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (25 + (75 * n.n * total.docs) // total.terms))))::BIGINT AS score
      FROM q JOIN w USING (term) JOIN tf USING (term) JOIN n USING (row_id), total GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10""",
    "op12_hamming_minhash": r"""WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
one AS (SELECT doc_id, unnest(s) AS shingle FROM sets),
size AS (SELECT doc_id, len(s)::BIGINT AS n_shingles FROM sets),
links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM one x JOIN one y USING (shingle) JOIN size m ON m.doc_id = x.doc_id
          JOIN size n ON n.doc_id = y.doc_id WHERE x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id, m.n_shingles, n.n_shingles
          HAVING 100 * count(*) >= 85 * (m.n_shingles + n.n_shingles - count(*))),
reach AS (SELECT doc_id, doc_id AS root FROM size UNION SELECT links.a, reach.root FROM reach JOIN links ON links.b = reach.doc_id),
least AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM size JOIN least USING (doc_id)""",
    "op13_recursive_filter_audit": r"""WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
m AS (SELECT part, (len(words) < 100)::INT + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INT
       + 4 * (100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * len(text))::INT
       + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * (doc_id > min(doc_id) OVER (PARTITION BY text))::INT AS mask,
       coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic FROM w LEFT JOIN labels USING (doc_id)),
cells AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS t(letter, bit)),
chain AS (SELECT '' AS prefix, 0 AS bit, 0 AS applied UNION ALL
          SELECT prefix || letter, l.bit, applied | c.bit FROM chain c JOIN letters l ON NOT contains(prefix, letter)),
steps AS (SELECT part, prefix, sum(n) FILTER (mask & (applied | bit) = 0) AS kept,
    sum(n) FILTER (mask & bit > 0 AND mask & applied = 0) AS removed, sum(n) FILTER (mask & bit > 0 AND mask & applied > 0) AS redundant,
    sum(n) FILTER (mask = bit) AS unique_fails, sum(good) FILTER (mask & bit > 0 AND mask & applied = 0) AS good_lost,
    sum(toxic) FILTER (mask & bit > 0 AND mask & applied = 0) AS toxic_lost FROM chain, cells WHERE prefix <> '' GROUP BY part, prefix),
rows AS (SELECT o.part, o.prefix AS filter_order, step::INT AS step, s.* EXCLUDE (part, prefix)
    FROM (SELECT part, prefix FROM steps WHERE len(prefix) = 5) o, range(1, 6) AS k(step)
    JOIN steps s ON s.part = o.part AND s.prefix = left(o.prefix, step))
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
       coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, filter_order[step]), 0)::BIGINT AS shapley FROM rows""",
}
