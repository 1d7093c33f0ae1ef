"""DuckDB SQL for the queries that SQL can express over whole tables."""

QUALITY = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS win
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 7)) AS i FROM w WHERE len(ws) > 8)
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM again) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), counts AS (
  SELECT w.doc_id, w.source, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)
), judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts
), hosts AS (
  SELECT source, count(*) AS n, sum(CAST(base_failed AS INT)) AS failed FROM judged GROUP BY source
), prior AS (
  SELECT avg(failed / n) AS m, var_pop(failed / n) AS v, avg(1.0 / n) AS c FROM hosts
), strength AS (
  SELECT m, CASE WHEN v - m * (1 - m) * c > 1e-9 THEN least(greatest(m * (1 - m) / (v - m * (1 - m) * c) - 1, 0), 1000)
            ELSE 1000 END AS s FROM prior
), rejected AS (
  SELECT source FROM hosts, strength WHERE (failed + m * s) / (n + s) > 0.5
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT EXISTS (
         SELECT 1 FROM rejected WHERE rejected.source IS NOT DISTINCT FROM judged.source) AS kept
FROM judged
"""

TOP_K = r"""
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(
           list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM whole q JOIN whole c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scored
)
SELECT query_id, CAST(place AS INT) AS rank, vec_id, score FROM ranked WHERE place <= 5
"""

NEAR_DUPLICATES = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN []
    WHEN len(ws) = 1 THEN ws
    ELSE list_transform(generate_series(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS s
  FROM w
), classes AS (
  SELECT min(doc_id) AS node, list_sort(s) AS s FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)
), items AS (
  SELECT node, len(s) AS n, unnest(s) AS item FROM classes
), shared AS (
  SELECT a.node AS u, b.node AS v, count(*) AS common, any_value(a.n) AS n, any_value(b.n) AS m
  FROM items a JOIN items b ON a.item = b.item AND a.node < b.node
    AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.node, b.node
), links AS (
  SELECT u, v FROM shared WHERE 100 * common >= 80 * (n + m - common)
), ways AS (
  SELECT u, v FROM links UNION ALL SELECT v, u FROM links
), reach(node, root) AS (
  SELECT node, node FROM classes
  UNION
  SELECT ways.v, reach.root FROM reach JOIN ways ON ways.u = reach.node
), roots AS (
  SELECT node, min(root) AS root FROM reach GROUP BY node
)
SELECT sets.doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles,
       coalesce(roots.root, sets.doc_id) AS component_id,
       sets.doc_id = coalesce(roots.root, sets.doc_id) AS kept
FROM sets LEFT JOIN classes ON classes.s = list_sort(sets.s)
LEFT JOIN roots ON roots.node = classes.node
"""

REPEATED_STRINGS = r"""
WITH coded AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), strings AS (
  SELECT doc_id, i, substr(h, 2 * i - 1, 100) AS s
  FROM (SELECT doc_id, h, unnest(generate_series(1, len(h) // 2 - 49)) AS i FROM coded WHERE len(h) >= 100)
), hit AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS least FROM strings)
  WHERE doc_id > least
), edges AS (
  SELECT doc_id, i, i + 50 AS e, max(i + 50) OVER (
    PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM hit
), numbered AS (
  SELECT doc_id, i, e, sum(CASE WHEN before IS NULL OR i > before THEN 1 ELSE 0 END) OVER (
    PARTITION BY doc_id ORDER BY i) AS run FROM edges
), spans AS (
  SELECT doc_id, run, min(i) AS b, max(e) AS e FROM numbered GROUP BY doc_id, run
), pieces AS (
  SELECT coded.doc_id, run, e, substr(h, 2 * coalesce(lag(e) OVER w, 1) - 1,
         2 * (b - coalesce(lag(e) OVER w, 1))) AS piece
  FROM spans JOIN coded USING (doc_id) WINDOW w AS (PARTITION BY spans.doc_id ORDER BY run)
), kept AS (
  SELECT doc_id, string_agg(piece, '' ORDER BY run) AS head, max(e) AS e FROM pieces GROUP BY doc_id
), sums AS (
  SELECT doc_id, sum(e - b) AS n, count(*) AS k FROM spans GROUP BY doc_id
)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(k, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN kept.e IS NULL THEN h ELSE head || substr(h, 2 * kept.e - 1) END)) AS kept_sha256
FROM coded LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

URL_FILTER = r"""
WITH rules AS (
  SELECT * FROM (VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
    ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'),
    ('com/de/', 'com', '/de/', 'block')) r(rule, rule_host, rule_path, says)
), rest AS (
  SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS u FROM pages
), urls AS (
  SELECT page_id, html, translate(regexp_extract(u, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(u, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), thin AS (
  SELECT host || path AS key FROM urls GROUP BY ALL
  HAVING max(len(regexp_extract_all(regexp_replace(coalesce(html, ''), '<[^>]*>', ' ', 'g'), '[^\x20\x09-\x0D]+'))) < 100
), ruled AS (
  SELECT u.*, (SELECT max_by(r.rule, length(r.rule)) FROM rules r
    WHERE (u.host = r.rule_host OR ends_with(u.host, '.' || r.rule_host)) AND starts_with(u.path, r.rule_path)) AS rule
  FROM urls u
)
SELECT page_id, host, path, rule, host || path IN (SELECT key FROM thin) AS listed,
       coalesce((SELECT says FROM rules r WHERE r.rule = ruled.rule),
                CASE WHEN host || path IN (SELECT key FROM thin) THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled
"""

# the digest is a table-driven CRC-32 over the UTF-8 bytes of letters below U+0100
SPELLING = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)),
      lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i)
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents
), lowered AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS place,
         translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n
  FROM runs GROUP BY ALL
), coded AS (
  SELECT w, n, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(
           list_filter(string_split(place || w, ''), lambda x: x <> ''),
           lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)]
             ELSE [CAST(192 + unicode(x) // 64 AS BIGINT), CAST(128 + unicode(x) % 64 AS BIGINT)] END))),
         lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS BIGINT) + 1]))) AS h
  FROM lowered, crc_table
), changed AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) AS BIGINT) + 2)
         ELSE w END AS word, n FROM coded
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM changed WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), shorter AS (
  SELECT DISTINCT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM shorter a JOIN shorter b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM shorter a JOIN words b ON a.less = b.word
  UNION SELECT b.word, a.word, a.n FROM shorter a JOIN words b ON a.less = b.word
), best AS (
  SELECT word, count(*) AS n_near, arg_min({'w': other, 'm': m}, {'a': -m, 'b': other}) AS top FROM near GROUP BY word
), forms AS (
  SELECT w.word, w.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CASE WHEN top.m >= 5 * w.n THEN top.w END AS form,
         CASE WHEN top.m >= 5 * w.n THEN top.m END AS form_n
  FROM words w LEFT JOIN best USING (word)
), followed AS (
  SELECT word, form, word AS root FROM forms
  UNION ALL SELECT f.word, g.form, g.word FROM followed f JOIN forms g ON f.form = g.word
)
SELECT f.word, n, n_near, f.form, form_n, r.root
FROM forms f JOIN followed r ON f.word = r.word AND r.form IS NULL
"""

CONVERSATION_TRIE = r"""
WITH crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)),
      lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i)
), rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text)) AS turns
  FROM rows GROUP BY conv_id
), opened AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(
           list_filter(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: x <> ''), lambda x: CAST(unicode(x) AS BIGINT))),
         lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS BIGINT) + 1]))) % 9 AS h
  FROM own, crc_table
), rebuilt AS (
  SELECT o.conv_id, list_concat(coalesce(b.turns[1:o.h], []), coalesce(o.turns[o.h + 1:], [])) AS turns
  FROM opened o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 5
), prefixes AS (
  SELECT conv_id, len(turns) AS size, d AS depth, turns[1:d] AS prefix, CASE WHEN d > 0 THEN strlen(turns[d].t) ELSE 0 END AS n_bytes
  FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)
), members AS (
  SELECT *, min(conv_id) OVER (PARTITION BY depth, prefix) AS node FROM prefixes
), nodes AS (
  SELECT m.node AS conv_id, m.depth, any_value(p.node) AS parent_conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(m.n_bytes) AS saved,
         sha256(coalesce(string_agg(CAST(m.conv_id AS VARCHAR), ',' ORDER BY m.conv_id) FILTER (m.depth = m.size), '')) AS ends_sha256
  FROM members m LEFT JOIN members p ON p.conv_id = m.conv_id AND p.depth = m.depth - 1 GROUP BY m.node, m.depth
), children AS (
  SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL
), counted AS (
  SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c USING (conv_id, depth)
), totals AS (
  SELECT m.node AS conv_id, m.depth, sum(n.saved) AS saved_tokens, count(*) FILTER (n.n_children = 0) AS n_leaves
  FROM counted n JOIN members m ON m.conv_id = n.conv_id AND m.depth <= n.depth GROUP BY ALL
)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM counted JOIN totals USING (conv_id, depth)
"""
