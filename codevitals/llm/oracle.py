"""SQL of the queries that SQL can express, for DuckDB over the given tables."""

OP11_SUBSTRING = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
spans AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY array_to_string(ws[s:s + 19], ' ') ORDER BY doc_id, s) AS nth
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w)),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM spans WHERE nth > 1),
words AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM w),
stays AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text
  FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN stays USING (doc_id)
"""

_TERMS = r"""unnest(regexp_extract_all(
  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"""

OP12_REVERSED_SEARCH = f"""
WITH d AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {_TERMS} AS term FROM documents) GROUP BY ALL),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, {_TERMS} AS term FROM benchmark) GROUP BY ALL),
n AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM d GROUP BY doc_id),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM n),
weight AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM d, total GROUP BY term),
m AS (SELECT doc_id, 100 - 25 + ((25 * n * docs) // length) AS m FROM n, total),
found AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM q JOIN d USING (term) JOIN weight USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM found WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 20
"""

# h is the CRC-32 of the decimal number, modulo 4: a step for each byte and eight for its bits.
OP13_PREFIX_TRIE = """
WITH own AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
heads AS (
  SELECT *, xor(list_reduce(list_concat([4294967295], flatten(list_transform(
      string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 4 AS h
  FROM own),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(f.turns[1:c.h], []), c.turns[c.h + 1:]) AS path
  FROM heads c LEFT JOIN own f ON f.conv_id = c.conv_id - c.conv_id % 20),
members AS (SELECT conv_id, path[1:d] AS p, d, d = len(path) AS ends FROM (SELECT *, unnest(range(0, len(path) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
    CASE WHEN d > 0 THEN (count(*) - 1) * len(regexp_extract_all(p[d].text, '[^\\x20\\x09-\\x0D]+')) ELSE 0 END AS saves
  FROM members GROUP BY p, d),
children AS (SELECT p[1:d - 1] AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (p)),
below AS (
  SELECT p[1:a] AS p, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(saves) AS BIGINT) AS saved_tokens
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM full_nodes) GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, above.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, n.ends_sha256
FROM full_nodes n JOIN below ON below.p = n.p LEFT JOIN nodes above ON n.d > 0 AND above.p = n.p[1:n.d - 1]
"""

ORACLE = {
    "op11_substring_dedup": OP11_SUBSTRING,
    "op12_reversed_search": OP12_REVERSED_SEARCH,
    "op13_prefix_trie": OP13_PREFIX_TRIE,
}
