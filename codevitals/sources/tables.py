"""Files held in tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import unify_newlines
from .filters import suffix


def from_documents(docs: DataFrame, path: Column, text: Column, repo_id="documents") -> DataFrame:
    """Any table with a path and a text as a files table."""
    return docs.select(
        F.lit(repo_id).alias("repo_id"), path.alias("file"), suffix(path).alias("suffix"),
        unify_newlines(text).alias("text"), F.lit(True).alias("utf8_ok"), F.lit(0.0).alias("mtime"))


def write_bucketed(files: DataFrame, table: str, buckets: int, path: str | None = None) -> None:
    """Store files bucketed by (repo_id, file), the key of every per-file step.

    Reading such a table, parsing, the per-file windows and the join of functions with
    their text all keep the bucketing: texts are not shuffled again.
    """
    writer = (files.write.mode("overwrite").format("parquet")
              .bucketBy(buckets, "repo_id", "file").sortBy("repo_id", "file"))
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
