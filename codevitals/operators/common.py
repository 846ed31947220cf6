"""Shape shared by all findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import FINDING_COLUMNS


def finding(df: DataFrame, detector: str, category, message: Column, kind_ord: int = 0,
            line: Column | None = None, snippet: Column | None = None,
            related: Column | None = None, group_id: Column | None = None,
            ord_: Column | None = None) -> DataFrame:
    """Project ``df`` (with repo_id and file) to finding rows."""
    as_text = lambda c: F.lit(None).cast("string") if c is None else c
    return df.select(
        "repo_id", F.lit(detector).alias("detector"),
        (category if isinstance(category, Column) else F.lit(category)).alias("category"),
        message.alias("message"), "file",
        (F.lit(None) if line is None else line).cast("int").alias("line"),
        as_text(snippet).alias("snippet"),
        (F.array().cast("array<string>") if related is None else related).alias("related"),
        as_text(group_id).alias("group_id"), F.lit("high").alias("confidence"),
        F.lit(kind_ord).alias("kind_ord"),
        (F.lit(0) if ord_ is None else ord_).cast("int").alias("ord"),
    ).select(FINDING_COLUMNS)


def first_lines(snippet: Column, count: int) -> Column:
    return F.array_join(F.slice(F.split(snippet, "\n"), 1, count), "\n")


def finding_columns(findings: DataFrame) -> DataFrame:
    """Findings with the columns of all of them, in one order."""
    return findings.select(FINDING_COLUMNS)
