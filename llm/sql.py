"""DuckDB SQL for the queries that SQL can state, over the same tables."""

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINE_DEDUP = f"""
WITH lines AS (
  SELECT doc_id, row, i, line, translate(trim(line, {_SPACES}), {_AZ}) AS k
  FROM (SELECT doc_id, row, lines, unnest(lines) AS line, unnest(range(len(lines))) AS i
        FROM (SELECT doc_id, row_number() OVER () AS row,
                     string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
firsts AS (
  SELECT k, min(coalesce(doc_id, 9223372036854775807)) AS first FROM lines WHERE length(k) >= 10 GROUP BY k),
marked AS (
  SELECT l.*, f.first IS NOT NULL AND f.first < coalesce(l.doc_id, 9223372036854775807) AS gone
  FROM lines l LEFT JOIN firsts f ON l.k = f.k)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY row
"""

_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_HITS = f"""
items AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, array_to_string(ws[s:s + 9], ' ') AS win, least(len(ws), 10) AS n
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS s FROM items WHERE len(ws) > 0)),
docs AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS ws FROM documents),
sizes AS (SELECT DISTINCT n FROM wins),
grams AS (
  SELECT row, s, n, array_to_string(ws[s:s + n - 1], ' ') AS win
  FROM (SELECT row, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM docs, sizes WHERE len(ws) >= n)),
hits AS (SELECT row, s, g.n, item_id FROM grams g JOIN wins w USING (win, n)),
hit_words AS (SELECT row, count(DISTINCT p) AS n_hit
              FROM (SELECT row, unnest(range(s, s + n)) AS p FROM hits) GROUP BY row),
hit_items AS (SELECT row, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS names
              FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY row)
"""

DECONTAMINATION = f"""
WITH {_HITS}
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit_words USING (row) LEFT JOIN hit_items USING (row)
"""

NEAR_DEDUP = f"""
WITH RECURSIVE
docs AS (SELECT row_number() OVER () AS row, doc_id,
                regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
grams AS (SELECT DISTINCT row, array_to_string(ws[s:s + 2], ' ') AS g
          FROM (SELECT row, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS s FROM docs WHERE len(ws) > 0)),
sizes AS (SELECT row, count(*) AS n FROM grams GROUP BY row),
links AS (SELECT a.row AS x, b.row AS y FROM grams a JOIN grams b ON a.g = b.g AND a.row <> b.row
          JOIN sizes p ON p.row = a.row JOIN sizes q ON q.row = b.row
          GROUP BY a.row, b.row, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))),
reach AS (SELECT row AS x, row AS y FROM docs UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
least AS (SELECT r.x AS row, min(d.doc_id) AS component_id FROM reach r JOIN docs d ON d.row = r.y GROUP BY r.x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
FROM docs LEFT JOIN sizes USING (row) JOIN least USING (row)
"""

DIVERGENCE = f"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents),
words AS (SELECT row, lang, source, unnest(ts) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
groups AS (SELECT DISTINCT lang, source FROM docs),
vocab AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
grid AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, v.v,
         sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total,
         sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, k.term) AS lang_n,
         sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang) AS lang_total
  FROM groups g JOIN kept k USING (lang) JOIN vocab v USING (lang)
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
shares AS (
  SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (total + 2 * v) AS p,
         1 + (1000000000::HUGEINT * (lang_n + 2)) // (lang_total + 2 * v) AS q FROM grid),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
         coalesce((SELECT sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) FROM shares x JOIN shares y
                   ON x.lang = y.lang AND x.term = y.term WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source),
tops AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM tops))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 10
"""

#: CRC-32 of a decimal number's text, bit by bit (reflected, polynomial 0xEDB88320).
_CRC = """xor(4294967295, list_reduce(
  list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
    lambda c: list_transform(range(8), lambda i: (ascii(c) >> i::INT) & 1)))),
  lambda crc, bit: xor(crc >> 1, 3988292384 * xor(crc & 1, bit))))"""

CONVERSATION_TRIE = f"""
WITH turns AS (
  SELECT conv_id, turn, left(sha256(strlen(r) || ':' || r || t), 32) AS tid, len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS words
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL)),
own AS (SELECT conv_id, list({{'tid': tid, 'words': words}} ORDER BY turn NULLS FIRST, tid) AS ts FROM turns GROUP BY conv_id),
heads AS (SELECT *, {_CRC} % 4 AS h FROM own),
built AS (SELECT a.conv_id, list_concat(coalesce(b.ts, [])[1:a.h], a.ts[a.h + 1:]) AS ts
          FROM heads a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 20),
steps AS (SELECT conv_id, d, len(ts) = d AS ends, array_to_string(list_transform(ts[1:d], lambda x: x.tid), '') AS k,
                 CASE WHEN d > 0 THEN ts[d].words ELSE 0 END AS words
          FROM (SELECT conv_id, ts, unnest(range(0, len(ts) + 1)) AS d FROM built)),
nodes AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
                 sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
          FROM steps GROUP BY k, d),
kids AS (SELECT left(k, 32 * (d - 1)) AS k, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
full_nodes AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids c USING (k)),
trees AS (SELECT left(k, 32 * a) AS k, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * words) AS saved
          FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM full_nodes) GROUP BY 1)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children,
       CAST(t.n_leaves AS BIGINT) AS n_leaves, CAST(t.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN trees t USING (k) LEFT JOIN full_nodes p ON n.d > 0 AND p.k = left(n.k, 32 * (n.d - 1))
"""

ORACLE_SQL = {"op13_conversation_trie": CONVERSATION_TRIE, "op12_divergence": DIVERGENCE, "op8_near_dedup": NEAR_DEDUP, "op4_line_dedup": LINE_DEDUP, "op10_decontamination": DECONTAMINATION}
