"""Decisions on findings: pending, next, list, stats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DECISIONS = "hash string, status string"


def decision(spark: SparkSession, hash_: str, status: str) -> DataFrame:
    return spark.createDataFrame([(hash_, status)], DECISIONS)


def effective(decisions: DataFrame) -> DataFrame:
    """One status per hash: resolved wins over skipped."""
    return decisions.groupBy("hash").agg(F.min("status").alias("status"))


def with_status(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    return findings.join(effective(decisions), "hash", "left").withColumn(
        "status", F.coalesce("status", F.lit("pending")))


def pending(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    return findings.join(decisions.select("hash").distinct(), "hash", "left_anti")


def list_findings(findings: DataFrame, decisions: DataFrame, only_pending: bool = False,
                  detector: str | None = None) -> DataFrame:
    out = with_status(findings, decisions)
    if only_pending:
        out = out.filter("status = 'pending'")
    if detector:
        out = out.filter(F.col("detector") == detector)
    return out


def next_finding(findings: DataFrame, decisions: DataFrame, cursor: str | None = None,
                 detector: str | None = None) -> DataFrame:
    """The first pending finding after the cursor, with ``remaining``; at most one row.

    With a cursor that is not pending the first pending one is next; with the cursor on
    the last pending one there is none. ``findings`` carries ``seq``.
    """
    open_ = pending(findings, decisions)
    if detector:
        open_ = open_.filter(F.col("detector") == detector)
    at_cursor = F.coalesce(F.col("hash") == F.lit(cursor), F.lit(False))
    # two numbers, whatever the size of the findings
    cursor_seq, remaining = open_.agg(
        F.min(F.when(at_cursor, F.col("seq"))), F.count(F.when(~at_cursor, 1))).first()
    if cursor_seq is not None:
        open_ = open_.filter((F.col("seq") > cursor_seq) & ~at_cursor)
    return open_.orderBy("seq").limit(1).withColumn("remaining", F.lit(remaining).cast("bigint"))


def status_matrix(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Per detector: pending, resolved, skipped, total."""
    return with_status(findings, decisions).groupBy("detector").agg(
        F.count_if(F.col("status") == "pending").alias("pending"),
        F.count_if(F.col("status") == "resolved").alias("resolved"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count("*").alias("total"))


def totals(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Overall counts; a hash both resolved and skipped counts in both, as in the status file."""
    both = decisions.groupBy("hash").agg(
        F.max(F.col("status") == "resolved").alias("resolved"),
        F.max(F.col("status") == "skipped").alias("skipped"))
    joined = findings.join(both, "hash", "left")
    counts = joined.agg(
        F.count("*").alias("total"),
        F.count_if(F.coalesce("resolved", F.lit(False))).alias("resolved"),
        F.count_if(F.coalesce("skipped", F.lit(False))).alias("skipped"))
    return counts.withColumn("pending", F.col("total") - F.col("resolved") - F.col("skipped"))
