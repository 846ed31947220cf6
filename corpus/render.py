"""Documents -> source files, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codevitals.schema import LANGUAGE_SUFFIXES

from .templates import COMMENT, TEMPLATES


# What is no ASCII letter, digit, blank or line feed; ``_`` itself may stay. Written as ranges it takes ten times as long.
_MARK = r"[^\w \n]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, dealt out by doc_id: a small table has fewer row groups than there are cores."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").repartition("doc_id")


def prose(text: Column, prefix: str) -> Column:
    """The whole document as line comments; punctuation becomes ``_``."""
    plain = F.regexp_replace(text, _MARK, "_")
    return F.regexp_replace(F.concat(F.lit("\n"), plain), "\\n", "\n" + prefix)


def source_file(docs: DataFrame, repo_id, file: Column, suffix, text: Column) -> DataFrame:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return docs.select(
        as_col(repo_id).alias("repo_id"), file.alias("file"), as_col(suffix).alias("suffix"),
        text.alias("text"), F.lit(True).alias("utf8_ok"), F.lit(0.0).alias("mtime"))


def template_files(docs: DataFrame, lang: str) -> DataFrame:
    """Every document as one source file of ``lang``; the code follows the prose."""
    suffix = LANGUAGE_SUFFIXES[lang][0]
    code = F.replace(F.lit(TEMPLATES[lang][0]), F.lit("{i}"), F.col("doc_id").cast("string"))
    text = F.concat(F.substring(prose(F.col("text"), COMMENT[lang]), 2, 2_000_000_000), F.lit("\n"), code)
    return source_file(docs, "documents", F.concat(F.col("doc_id").cast("string"), F.lit(suffix)), suffix, text)


def mixed_files(docs: DataFrame) -> DataFrame:
    """Document i as a file of language i mod 20, in one pass."""
    langs = sorted(TEMPLATES)
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % len(langs) + 1).cast("int"))
    suffix = pick([LANGUAGE_SUFFIXES[lang][0] for lang in langs])
    code = F.replace(pick([TEMPLATES[lang][0] for lang in langs]), F.lit("{i}"), F.col("doc_id").cast("string"))
    plain = F.regexp_replace(F.concat(F.lit("\n"), F.col("text")), _MARK, "_")
    header = F.replace(plain, F.lit("\n"), F.concat(F.lit("\n"), pick([COMMENT[lang] for lang in langs])))
    text = F.concat(F.substring(header, 2, 2_000_000_000), F.lit("\n"), code)
    return source_file(docs, "documents", F.concat(F.col("doc_id").cast("string"), suffix), suffix, text)


def template_oracle(lang: str) -> str:
    """DuckDB SQL for the symbols of ``template_files``: arithmetic on doc_id and line counts."""
    def text(v):
        return "NULL::VARCHAR" if v is None else "'" + v.replace("'", "''") + "'"

    def num(v):
        return "NULL::INTEGER" if v is None else str(v)

    rows = ",\n    ".join(
        f"({text(k)}, {text(n)}, {num(l)}, {num(e)}, {num(c)}, {text(s)}, {text(a)}, {text(t)})"
        for k, n, l, e, c, s, a, t in TEMPLATES[lang][1])
    fill = lambda c: f"replace({c}, '{{i}}', CAST(doc_id AS VARCHAR)) AS {c}"
    return f"""
WITH base AS (
  SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + 1 AS k FROM documents
), expected(kind, name, line, end_line, n, source, alias, tag) AS (VALUES
    {rows}
)
SELECT doc_id, kind, {fill('name')}, CAST(line + k AS INTEGER) AS line,
       CAST(end_line + k AS INTEGER) AS end_line, n, {fill('source')}, {fill('alias')}, tag
FROM base CROSS JOIN expected
"""
