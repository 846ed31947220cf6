"""fix: remove the lines of unused imports that name nothing else."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import split_lines, strip

# Imports whose "unused" verdict does not mean the line is safe to delete.
_NO_FIX_SUFFIX = r"\.(c|h|cpp|cc|cxx|hpp|hxx|erl|hrl)$"


def names_several(line: Column) -> Column:
    """Does an import line bind more than one name?"""
    text = strip(line)
    after_import = F.regexp_replace(F.regexp_extract(text, r" import (.*)$", 1), "#.*$", "")
    bare = F.regexp_replace(F.regexp_replace(F.regexp_extract(text, r"^import (.*)$", 1), "#.*$", ""), "//.*$", "")
    braces = F.regexp_extract(bare, r"\{([^}]*)\}", 1)
    default_and_braces = bare.rlike(r"^[^{'\"]*,[^{]*\{")
    comma = lambda c: F.contains(c, F.lit(","))
    return (
        F.when(F.startswith(text, F.lit("from ")) & F.contains(text, F.lit(" import ")), comma(after_import))
        .when(F.startswith(text, F.lit("import ")),
              F.when(bare.rlike(r"\{[^}]*\}"), comma(braces) | default_and_braces).otherwise(comma(bare)))
        .otherwise(F.lit(False))
    )


def stands_alone(line: Column) -> Column:
    """Do all brackets that open on a line close on it, and does no code follow a semicolon?"""
    bare = F.regexp_replace(line, r"""(["'])(?:(?!\1).)*+\1""", "_")
    count = lambda chars: F.length(bare) - F.length(F.translate(bare, chars, ""))
    closed = (count("(") == count(")")) & (count("[") == count("]")) & (count("{") == count("}"))
    return closed & ~bare.rlike(r";\s*[^\s;#/]")


def line_uses(symbols: DataFrame) -> DataFrame:
    """(repo_id, file, line, imports, others): how many imports, and how much else, each import line holds."""
    kind, name = F.col("kind"), F.col("name")
    other = kind.isin("call", "function", "class") & (name != "require")
    return (
        symbols.filter(kind.isin("import", "call", "function", "class") & F.col("line").isNotNull())
        .groupBy("repo_id", "file", "line")
        .agg(F.count(F.when(kind == "import", 1)).alias("imports"), F.count(F.when(other, 1)).alias("others"))
        .filter("imports > 0")
    )


def fixable(findings: DataFrame, symbols: DataFrame) -> DataFrame:
    """Findings of unused imports, with ``several`` where the line must stay.

    A line may go only if it holds this one import and nothing else: that is for the symbols to say, not for the line's
    spelling. ``symbols`` should be a stored table.
    """
    side_effect = F.startswith(F.col("message"), F.lit("'*' is imported"))
    rows = (
        findings.filter((F.col("detector") == "unused_imports") & F.col("line").isNotNull()
                        & F.col("snippet").isNotNull())
        .filter(~F.col("file").rlike(_NO_FIX_SUFFIX) & ~side_effect)
    )
    uses = rows.join(line_uses(symbols), ["repo_id", "file", "line"], "left")
    alone = (F.coalesce("imports", F.lit(0)) == 1) & (F.coalesce("others", F.lit(0)) == 0) & stands_alone(F.col("snippet"))
    return uses.withColumn("several", names_several(F.col("snippet")) | ~alone).drop("imports", "others")


def preview(findings: DataFrame, symbols: DataFrame) -> DataFrame:
    """Lines that would be removed, last line of a file first."""
    return removable(findings, symbols).orderBy("repo_id", "file", F.desc("line"))


def removable(findings: DataFrame, symbols: DataFrame) -> DataFrame:
    return fixable(findings, symbols).filter(~F.col("several")).select(
        "repo_id", "file", "line", strip(F.col("snippet")).alias("text"))


def rewritten(files: DataFrame, findings: DataFrame, symbols: DataFrame) -> DataFrame:
    """(repo_id, file, text, removed): new texts of files that lose at least one line.

    A line is removed only if it still equals the finding's snippet.
    """
    wanted = removable(findings, symbols).groupBy("repo_id", "file").agg(
        F.collect_set(F.struct("line", "text")).alias("wanted"))
    lines = F.split(F.col("text"), "\n", -1)
    removed = lambda line, i: F.exists("wanted", lambda w: (w["line"] == i + 1) & (w["text"] == strip(line)))
    kept = F.filter(lines, lambda line, i: ~removed(line, i))
    return (
        files.filter("utf8_ok").join(wanted, ["repo_id", "file"])
        .select("repo_id", "file", F.array_join(kept, "\n").alias("new_text"),
                (F.size(lines) - F.size(kept)).alias("removed"))
        .filter("removed > 0").withColumnRenamed("new_text", "text")
    )


def summary(rewrites: DataFrame) -> DataFrame:
    return rewrites.agg(F.coalesce(F.sum("removed"), F.lit(0)).alias("fixed_lines"),
                        F.count("*").alias("fixed_files"))
