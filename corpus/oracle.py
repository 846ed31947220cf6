"""DuckDB SQL for the registered queries, written from the rules, not from the engine."""

from __future__ import annotations

from .render import template_oracle
from .templates import TEMPLATES

ORACLE: dict[str, str] = {f"parser_{lang}": template_oracle(lang) for lang in TEMPLATES}

_langs = sorted(TEMPLATES)
ORACLE["symbol_profile"] = "SELECT lang, kind, CAST(sum(symbols) AS BIGINT) AS symbols FROM (" + " UNION ALL ".join(
    f"SELECT '{lang}' AS lang, '{kind}' AS kind, "
    f"{sum(1 for row in TEMPLATES[lang][1] if row[0] == kind)} * count(*) AS symbols "
    f"FROM documents WHERE doc_id % {len(_langs)} = {k}"
    for k, lang in enumerate(_langs)
    for kind in ("import", "export", "function", "class", "variable", "call")
    if any(row[0] == kind for row in TEMPLATES[lang][1])
) + ") GROUP BY lang, kind HAVING sum(symbols) > 0"

# ------------------------------------------------------------------------- documents
# newline count, plus one for an unterminated last line
_LINES = ("length({c}) - length(replace({c}, chr(10), '')) "
          "+ CASE WHEN {c} <> '' AND right({c}, 1) <> chr(10) THEN 1 ELSE 0 END")
_DOC_LINES = _LINES.format(c="text")
_DOC_PATH = "source || '/' || lang || '/' || doc_id || '.txt'"
_HASH = "substr(sha256(detector || ':' || category || ':' || file || ':' || coalesce(CAST(line AS VARCHAR), 'None')), 1, 12)"


def _large(threshold: int) -> str:
    return f"""SELECT *, {_HASH} AS hash FROM (
  SELECT {_DOC_PATH} AS file, 1 AS line, 'size' AS detector, 'large_file' AS category,
         'File is ' || ({_DOC_LINES}) || ' lines (threshold: {threshold})' AS message
  FROM documents WHERE {_DOC_LINES} > {threshold})"""


ORACLE["large_file"] = f"SELECT file, line, message, hash FROM ({_large(20)})"
ORACLE["raw_lines_profile"] = f"""
SELECT source, lang, count(*) AS files, CAST(sum({_DOC_LINES}) AS BIGINT) AS lines,
       CAST(max({_DOC_LINES}) AS INTEGER) AS longest
FROM documents GROUP BY source, lang"""

# Line-by-line text of a document without blank and comment lines, then literals replaced.
_BODIES = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS l,
         unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos
  FROM documents WHERE %s >= 5
), kept AS (
  SELECT doc_id, string_agg(trim(l), ' ' ORDER BY pos) AS body
  FROM lines WHERE trim(l) <> '' AND NOT regexp_matches(trim(l), '^(#|//)') GROUP BY doc_id
), norm AS (
  SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(body,
    '"(?:[^"\\]|\\.)*"', '"_"', 'g'), '''(?:[^''\\]|\\.)*''', '''_''', 'g'),
    '(^|[^\p{L}\p{N}_])[0-9]+(?:\.[0-9]*)?', '\10', 'g'), '[\s]+', '', 'g') AS body
  FROM kept
), sized AS (
  SELECT doc_id, body, count(*) OVER (PARTITION BY body) AS copies FROM norm WHERE body <> ''
)""" % _DOC_LINES
ORACLE["duplicate_bodies"] = _BODIES + " SELECT doc_id, copies FROM sized WHERE copies >= 3"
ORACLE["duplicate_others"] = _BODIES + """
SELECT doc_id, copies, min(doc_id) OVER (PARTITION BY body) AS first_doc FROM sized WHERE copies >= 3"""

_SECRET_RULES = [
    ("private_key", r"(-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----)"),
    ("api_key", r"((?:AKIA|ASIA)[0-9A-Z]{16})"),
    ("api_key", r"(sk_live_[0-9a-zA-Z]{16,})"),
    ("access_token", r"(gh[pousr]_[0-9A-Za-z]{36})"),
    ("access_token", r"(xox[abpors]-[0-9A-Za-z-]{10,})"),
    ("api_key", r"""(?i)api[_-]?key["']?[ \t]*[:=][ \t]*["']([0-9a-z_-]{16,})["']"""),
    ("access_token", r"""(?i)token["']?[ \t]*[:=][ \t]*["']([0-9a-z_.-]{16,})["']"""),
    ("password", r"""(?i)passw(?:or)?d["']?[ \t]*[:=][ \t]*["']([^"' \t]{6,})["']"""),
]


def _secrets(table: str, key: str, text: str) -> str:
    parts = " UNION ALL ".join(
        "SELECT k, line, '{c}' AS category, unnest(regexp_extract_all(l, '{p}', 1)) AS secret, l FROM lines "
        "WHERE regexp_matches(l, '{p}')".format(c=c, p=p.replace("'", "''")) for c, p in _SECRET_RULES)
    return f"""WITH lines AS (
  SELECT {key} AS k, unnest(string_split({text}, chr(10))) AS l,
         CAST(unnest(range(1, len(string_split({text}, chr(10))) + 1)) AS INTEGER) AS line
  FROM {table}) , found AS ({parts})"""


# two keys of one kind and a password on one line, made from the whole row
_KEY_LINE = ("({0} || chr(10) || 'token = \"' || md5({0}) || '\"; token: \"' || md5(md5({0})) || '\" PASSWORD=\"pw' || length({0}) || '!secret\"')")
ORACLE["secret_documents"] = _secrets("documents", "doc_id", "text") + \
    " SELECT k AS doc_id, line, category, secret FROM found"
ORACLE["secret_pages"] = _secrets("pages", "page_id", _KEY_LINE.format("html")) + \
    " SELECT k AS page_id, line, category, secret FROM found"
ORACLE["secret_conversations"] = _secrets("conversations", "conv_id || '/' || turn", _KEY_LINE.format("text")) + \
    " SELECT k AS file, line, category, secret FROM found"
ORACLE["secret_findings"] = _secrets("documents", _DOC_PATH, "text") + f"""
SELECT file, line, category, message, {_HASH} AS hash FROM (
  SELECT k AS file, line, category, 'secrets' AS detector,
         'Possible ' || replace(category, '_', ' ') || ' in source: ' || substr(secret, 1, least(4, length(secret) // 4))
         || repeat('*', length(secret) - least(4, length(secret) // 4)) AS message FROM found)"""


# ----------------------------------------------------------------------------- paths
def _choose(*values: str) -> str:
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE doc_id % {len(values)} {cases} END"


_PATHS = "WITH paths AS (SELECT doc_id, {} || '/d' || (doc_id % 5) || '/' || doc_id || '_' || {} AS path FROM documents)".format(
    _choose("src", "node_modules", "build", "pkg/dist", ".hidden", "lib/env", "app"),
    _choose("main.py", "app.min.js", "types.d.ts", "__init__.py", "util.go", "Makefile", ".dot.py", "a.b.rs",
            "page.tsx", "README.md", "x.min.css"))
_SUPPORTED = "regexp_matches(path, '\\.(py|js|ts|go|rs|tsx)$')"
_SKIPPED = "(path LIKE '%.d.ts' OR path LIKE '%.d.tsx' OR path LIKE '%.min.js' OR path LIKE '%.min.css')"
# every ignored directory here is the first part of the path; env and dist are deeper
_IGNORED = ("(path LIKE 'node_modules/%' OR path LIKE 'build/%' OR path LIKE '%.min.js' OR path LIKE '%.min.css'"
            " OR path LIKE 'env/%' OR path LIKE 'dist/%')")
_PRUNED = ("(path LIKE 'node_modules/%' OR path LIKE 'build/%' OR path LIKE 'pkg/dist/%' OR path LIKE '.hidden/%'"
           " OR path LIKE 'lib/env/%')")
ORACLE["extension_filter"] = _PATHS + f" SELECT * FROM paths WHERE {_SUPPORTED}"
ORACLE["skip_suffix"] = _PATHS + f" SELECT * FROM paths WHERE NOT {_SKIPPED}"
ORACLE["ignore_filter"] = _PATHS + f""" SELECT * FROM paths WHERE NOT {_IGNORED}
  AND NOT path LIKE 'src/d1/%' AND NOT path LIKE '%/d2/%\\_util.go' ESCAPE '\\'
  AND NOT (path LIKE 'app/d3/%' OR path LIKE 'app/d4/%')"""
ORACLE["pruned_directories"] = _PATHS + f" SELECT * FROM paths WHERE NOT {_PRUNED}"
ORACLE["source_files"] = _PATHS + \
    f" SELECT * FROM paths WHERE {_SUPPORTED} AND NOT {_SKIPPED} AND NOT {_PRUNED} AND NOT {_IGNORED}"
ORACLE["parser_dispatch"] = _PATHS + f"""
SELECT CASE regexp_extract(path, '\\.([a-z]+)$', 1) WHEN 'py' THEN 'python' WHEN 'go' THEN 'go'
       WHEN 'rs' THEN 'rust' ELSE 'javascript' END AS language, count(*) AS files
FROM paths WHERE {_SUPPORTED} GROUP BY 1"""
ORACLE["path_order"] = _PATHS + """
SELECT path, lag(path) OVER (
  PARTITION BY array_to_string(string_split(path, '/')[1:2], '/') ORDER BY string_split(path, '/')) AS previous
FROM paths"""

# ----------------------------------------------------------------------------- names
_WORDS = "WITH words AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents)"
ORACLE["name_prefixes"] = _WORDS + """
SELECT 'self.' || w || '.' || reverse(w) AS name,
       unnest(['self', 'self.' || w, 'self.' || w || '.' || reverse(w), w || '.' || reverse(w)]) AS reference
FROM words"""
ORACLE["name_case"] = _WORDS + """, names AS (
  SELECT DISTINCT unnest([w, upper(w), upper(w) || '_2', '_' || w, upper(w) || '_X']) AS name FROM words)
SELECT name, regexp_matches(name, '^[A-Z]') AND upper(name) <> name AND NOT contains(name, '_') AS pascal,
       regexp_matches(name, '^[_A-Z]*[A-Z][_A-Z]*$') AND length(name) > 1 AS caps
FROM names"""

# ------------------------------------------------------------------------- detectors
_BASE = """WITH base AS (
  SELECT doc_id AS i, length(text) - length(replace(text, chr(10), '')) + 1 AS k, count(*) OVER () AS n,
         90 + doc_id % 20 AS long_lines, 15 + doc_id % 10 AS methods
  FROM documents)"""
_PY = "'src/m' || (i % 16) || '/f' || i || '.py'"
_TS = "'src/m' || (i % 16) || '/g' || i || '.ts'"
_FAR = "(7 * i + 3) % n"
_HELPER_DEAD = ("i % 5 <> 0 AND i NOT IN (SELECT (7 * j.i + 3) % j.n FROM base j "
                "WHERE j.i % 4 = 0 AND (7 * j.i + 3) % j.n <> j.i)")


def _rows(path: str, *parts: tuple[str, str, str, str]) -> str:
    """(category, message, line relative to the code, condition) -> UNION ALL."""
    return " UNION ALL ".join(
        f"SELECT {path} AS file, '{category}' AS category, {message} AS message, CAST(k + {line} AS INTEGER) AS line "
        f"FROM base WHERE {where}" for category, message, line, where in parts)


def _unused(name: str) -> str:
    return f"'''' || {name} || ''' is imported but never used'"


_PY_IMPORTS = [
    ("unused_import", _unused("'os' || i || 'x'"), "1", "i % 3 = 0"),
    ("unused_import", _unused("'ld' || i || 'x'"), "2", "i % 2 = 1"),
    ("unused_import", _unused(f"'_helper' || ({_FAR}) || 'x'"), "3", f"i % 4 = 0 AND {_FAR} <> i"),
]
_PY_FUNCTIONS = [
    ("unused_function", "'Function ''_helper' || i || 'x'' is defined but never called'", "5", _HELPER_DEAD),
    ("unused_function", "'Function ''_m' || i || 'x'' is defined but never called'", "19", "true"),
]
_PY_CLASSES = [("unused_class", "'Class ''_Base' || i || 'x'' is defined but never referenced'", "16", "i % 6 <> 0")]
_PY_LONG = [("large_function",
             "'Function ''long' || i || 'x'' is ' || (long_lines + 2) || ' lines (threshold: 100)'", "26",
             "long_lines + 2 > 100")]
_PY_GOD = [("god_class", "'Class ''God' || i || 'x'' has ' || methods || ' methods (threshold: 20)'",
            "28 + long_lines", "methods >= 20")]
_PY_TOTAL = "k + 29 + long_lines + methods"
_PY_LARGE = [("large_file", f"'File is ' || ({_PY_TOTAL}) || ' lines (threshold: 500)'", "1 - k", f"{_PY_TOTAL} > 500")]
ORACLE["unused_import_python"] = f"{_BASE} {_rows(_PY, *_PY_IMPORTS)}"
ORACLE["import_text_fallback"] = f"""{_BASE}
SELECT {_PY} AS file, 'os' || i || 'x' AS name, CAST(k + 1 AS INTEGER) AS line, i % 3 <> 0 AS in_text FROM base
UNION ALL SELECT {_PY}, 'load' || i || 'x', CAST(k + 2 AS INTEGER), i % 2 = 0 FROM base
UNION ALL SELECT {_PY}, '_helper' || ({_FAR}) || 'x', CAST(k + 3 AS INTEGER), {_FAR} = i FROM base WHERE i % 4 = 0"""
ORACLE["unused_function"] = f"{_BASE} {_rows(_PY, *_PY_FUNCTIONS)}"
ORACLE["unused_class"] = f"{_BASE} {_rows(_PY, *_PY_CLASSES)}"
ORACLE["large_function"] = f"{_BASE} {_rows(_PY, *_PY_LONG)}"
ORACLE["god_class"] = f"{_BASE} {_rows(_PY, *_PY_GOD)}"
ORACLE["decorated_exempt"] = f"{_BASE} SELECT {_PY} AS file, '_deco' || i || 'x' AS name, CAST(k + 10 AS INTEGER) AS line FROM base"
ORACLE["duplicated_function"] = f"""{_BASE}
SELECT {_PY} AS file, 'dup' AS name, CAST(k + 20 AS INTEGER) AS line, count(*) OVER () AS copies FROM base WHERE i % 11 = 0"""
_TS_IMPORTS = [
    ("unused_import", _unused("'a' || i || 'x'"), "1", "i % 3 <> 0"),
    ("unused_import", _unused("'c' || i || 'x'"), "1", "i % 3 = 0"),
    ("unused_import", _unused("'pub' || ((3 * i + 1) % n) || 'x'"), "7", "i % 5 = 0 AND (3 * i + 1) % n <> i"),
]
ORACLE["unused_import_typescript"] = f"{_BASE} {_rows(_TS, *_TS_IMPORTS)}"
ORACLE["unused_variable"] = _BASE + " " + _rows(
    _TS,
    ("unused_variable", "'Module-level variable ''kept' || i || 'x'' is never referenced'", "3", "true"),
    ("unused_variable", "'Module-level variable ''idle' || i || 'x'' is never referenced'", "4", "i % 4 <> 0"))
ORACLE["unused_export"] = _BASE + " " + _rows(
    _TS,
    ("unused_export", "'Export ''pub' || i || 'x'' is not imported by any other file'", "6",
     "i NOT IN (SELECT (3 * j.i + 1) % j.n FROM base j WHERE j.i % 5 = 0 AND (3 * j.i + 1) % j.n <> j.i)"),
    ("unused_export", "'Export ''main' || i || 'x'' is not imported by any other file'", "8", "true"))
ORACLE["unused_function_typescript"] = _BASE + " " + _rows(
    _TS, ("unused_function", "'Function ''priv' || i || 'x'' is defined but never called'", "9", "i % 2 = 1"))
_LINKS = f"""{_BASE}, links AS (
  SELECT i, n, CASE WHEN (i // 2) % 7 = 0 THEN CASE WHEN i % 2 = 0 THEN i + 1 ELSE i - 1 END ELSE i + 1 END AS t
  FROM base), edges AS (
  SELECT 'src/m' || (i % 16) || '/g' || i || '.ts' AS src, 'src/m' || (t % 16) || '/g' || t || '.ts' AS dst
  FROM links WHERE t < n)"""
ORACLE["import_edges_typescript"] = _LINKS + " SELECT src, dst FROM edges"
ORACLE["import_cycle"] = _LINKS + """
SELECT DISTINCT least(a.src, a.dst) || ' -> ' || greatest(a.src, a.dst) AS cycle
FROM edges a JOIN edges b ON a.src = b.dst AND a.dst = b.src"""
ORACLE["import_cycle_components"] = ORACLE["import_cycle"]
# The last folder may have fewer files; a cycle is there if its files are.
ORACLE["import_cycle_shapes"] = "WITH folders AS (SELECT doc_id // 8 AS g, count(*) AS m FROM documents GROUP BY ALL) " + " UNION ALL ".join(
    "SELECT " + " || ' -> ' || ".join(f"'src/c' || g || '/h{k}.ts'" for k in ring) + f" AS cycle FROM folders WHERE m > {needs}"
    for ring, needs in (((0, 1, 2), 2), ((2, 3), 3), ((5, 6, 7), 7), ((6, 7), 7)))

# ----------------------------------------------------------- whole scans and commands
_PY_ALL = _BASE + ", found AS (" + " UNION ALL ".join(
    f"SELECT '{detector}' AS detector, * FROM ({_rows(_PY, *parts)})"
    for detector, parts in (("unused_imports", _PY_IMPORTS), ("dead_code", _PY_FUNCTIONS + _PY_CLASSES),
                            ("size", _PY_LONG + _PY_GOD + _PY_LARGE))) + ")"
_PY_COPIES = ("(SELECT 'duplication' AS detector, {p} AS file FROM base WHERE i % 11 = 0 "
              "AND (SELECT count(*) FROM base WHERE i % 11 = 0) >= 3)").format(p=_PY)
_ALL_FILES = f"(SELECT detector, file FROM found UNION ALL SELECT * FROM {_PY_COPIES})"
ORACLE["scan_by_detector"] = f"{_PY_ALL} SELECT detector, count(*) AS findings FROM {_ALL_FILES} GROUP BY detector"
ORACLE["union_findings"] = f"""{_PY_ALL} SELECT detector, category, file, line, {_HASH} AS hash FROM (
  SELECT detector, category, file, line FROM found
  UNION ALL SELECT 'duplication', 'duplicated_function', {_PY}, CAST(k + 20 AS INTEGER) FROM base
  WHERE i % 11 = 0 AND (SELECT count(*) FROM base WHERE i % 11 = 0) >= 3)"""
ORACLE["rescan_findings"] = ORACLE["union_findings"]
ORACLE["allowlist"] = f"""{_PY_ALL} SELECT detector, count(*) AS findings FROM {_ALL_FILES}
WHERE NOT (detector = 'dead_code' AND file LIKE 'src/m1/%')
  AND NOT (detector = 'size' AND (file LIKE 'src/m2/%' OR file LIKE '%/f7.py')) GROUP BY detector"""

_FOUND = f"""WITH found AS ({_large(5)}), decisions AS (
  SELECT hash, 'resolved' AS status FROM found WHERE substr(hash, 1, 1) IN ('0', '1', '2')
  UNION ALL SELECT hash, 'skipped' FROM found WHERE substr(hash, 1, 1) IN ('2', '3', '4')
), listed AS (
  SELECT *, CASE WHEN substr(hash, 1, 1) IN ('0', '1', '2') THEN 'resolved'
                 WHEN substr(hash, 1, 1) IN ('3', '4') THEN 'skipped' ELSE 'pending' END AS status FROM found
), numbered AS (SELECT *, row_number() OVER (ORDER BY string_split(file, '/')) AS seq FROM listed)"""
ORACLE["pending"] = _FOUND + " SELECT hash, file FROM listed WHERE status = 'pending'"
ORACLE["list_findings"] = _FOUND + " SELECT hash, status, file, line, message FROM listed"
ORACLE["status_matrix"] = _FOUND + """
SELECT detector, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'resolved') AS resolved,
       count(*) FILTER (status = 'skipped') AS skipped, count(*) AS total FROM listed GROUP BY detector"""
ORACLE["status_totals"] = _FOUND + """
SELECT total, resolved, skipped, total - resolved - skipped AS pending FROM (
  SELECT (SELECT count(*) FROM found) AS total,
         (SELECT count(*) FROM found WHERE hash IN (SELECT hash FROM decisions WHERE status = 'resolved')) AS resolved,
         (SELECT count(*) FROM found WHERE hash IN (SELECT hash FROM decisions WHERE status = 'skipped')) AS skipped)"""
ORACLE["report_sequence"] = _FOUND + " SELECT seq, file FROM numbered"
ORACLE["next_finding"] = _FOUND + """, cursor AS (SELECT max(hash) AS hash FROM found)
SELECT seq, hash, file, (SELECT count(*) FROM listed WHERE status = 'pending'
                         AND hash <> (SELECT hash FROM cursor)) AS remaining
FROM numbered WHERE status = 'pending' AND hash <> (SELECT hash FROM cursor)
  AND seq > coalesce((SELECT min(seq) FROM numbered WHERE status = 'pending'
                      AND hash = (SELECT hash FROM cursor)), 0)
ORDER BY seq LIMIT 1"""
ORACLE["findings_json"] = f"SELECT hash, detector, category, message, file, line FROM ({_large(5)})"
ORACLE["review_changed"] = f"""
SELECT file, hash FROM ({_large(5)}) WHERE file IN (
  SELECT {_DOC_PATH} FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))"""
_VERSIONS = """WITH listing AS (SELECT CAST(doc_id AS VARCHAR) AS file, CAST(n_chars AS DOUBLE) AS mtime FROM documents),
cached AS (
  SELECT CASE WHEN toxic = 1 THEN 'gone' || d.doc_id ELSE CAST(d.doc_id AS VARCHAR) END AS file,
         CAST(n_chars + quality AS DOUBLE) AS mtime
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""
ORACLE["incremental_hits"] = _VERSIONS + """ SELECT file, mtime FROM listing l
WHERE EXISTS (SELECT 1 FROM cached c WHERE c.file = l.file AND c.mtime = l.mtime)"""
ORACLE["incremental_misses"] = _VERSIONS + """ SELECT file, mtime FROM listing l
WHERE NOT EXISTS (SELECT 1 FROM cached c WHERE c.file = l.file AND c.mtime = l.mtime)"""
ORACLE["incremental_stale"] = _VERSIONS + """ SELECT file, mtime FROM cached c
WHERE NOT EXISTS (SELECT 1 FROM listing l WHERE c.file = l.file)"""
ORACLE["fix_preview"] = f"""{_BASE}
SELECT {_TS} AS file, CAST(k + 1 AS INTEGER) AS line, true AS several FROM base
UNION ALL SELECT {_TS}, CAST(k + 7 AS INTEGER), false FROM base WHERE i % 5 = 0 AND (3 * i + 1) % n <> i"""
ORACLE["fix_rewrite"] = f"""{_BASE}, counted AS (
  SELECT *, (i % 3 = 0)::INTEGER + (i % 2 = 1)::INTEGER + (i % 4 = 0 AND {_FAR} <> i)::INTEGER AS removed FROM base)
SELECT {_PY} AS file, removed, CAST({_PY_TOTAL} - removed AS INTEGER) AS lines FROM counted WHERE removed > 0"""
ORACLE["definition_candidates"] = f"""{_BASE}
SELECT {_PY} AS file, 'function' AS kind, '_helper' || i || 'x' AS name FROM base
UNION ALL SELECT {_PY}, 'function', '_m' || i || 'x' FROM base
UNION ALL SELECT {_PY}, 'class', '_Base' || i || 'x' FROM base"""
