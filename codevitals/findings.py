"""Findings: identity, order, allowlist, reports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.names import finding_hash

# Detectors in reporting order.
DETECTORS = ["unused_imports", "dead_code", "size", "secrets", "cycles", "duplication"]


def with_hash(findings: DataFrame) -> DataFrame:
    """Adds ``hash`` (stable across scans) and ``finding_id`` (also tells apart equal hashes)."""
    key = finding_hash(F.col("detector"), F.col("category"), F.col("file"), F.col("line"))
    return findings.withColumn("hash", key).withColumn(
        "finding_id", F.substring(F.sha2(F.concat_ws(":", "repo_id", key, "message"), 256), 1, 16))


def report_order() -> list[Column]:
    """Detectors in their order, then files by path parts, then position in the file."""
    rank = F.array_position(F.array(*map(F.lit, DETECTORS)), F.col("detector"))
    group = F.when(F.col("detector") == "duplication", F.col("group_id")).otherwise("")
    return [F.col("repo_id"), rank, group, F.split("file", "/"), F.col("kind_ord"),
            F.col("line"), F.col("ord"), F.col("message")]


def with_seq(findings: DataFrame) -> DataFrame:
    """Adds ``seq``: the 1-based position in the report of all repositories.

    The report is sorted by range over all tasks and stored once; the number of rows in
    each sorted part (one number per part) turns positions within parts into ``seq``.
    """
    from .session import stored
    at = F.monotonically_increasing_id()
    ordered = stored(findings.orderBy(*report_order()).withColumn("at", at), "report")
    part = F.shiftright("at", 33)
    sizes = ordered.groupBy(part.alias("part")).count()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    return (ordered.withColumn("part", part).join(F.broadcast(offsets), "part")
            .withColumn("seq", F.col("offset") + F.col("at") - F.shiftleft("part", 33) + 1)
            .drop("part", "offset", "at"))


def glob_to_regex(pattern: str) -> str:
    """A shell glob as a regular expression; ``*`` crosses ``/``."""
    out = []
    for token in re.findall(r"\[!?\]?[^\]]*\]|.", pattern, flags=re.S):
        if token == "*":
            out.append(".*")
        elif token == "?":
            out.append(".")
        elif len(token) > 1:
            body = token[1:-1].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "\\&\\&")
            out.append("[" + ("^" + body[1:] if body.startswith("!") else body) + "]")
        else:
            out.append(re.escape(token))
    return "(?s)^" + "".join(out) + "$"


def apply_allowlist(findings: DataFrame, allowlist: dict[str, list[str]]) -> DataFrame:
    """Drop findings whose hash, or file by glob, is listed for their detector.

    The list comes from a project's configuration file. Hashes meet the findings in an
    anti-join; globs become one predicate per detector.
    """
    spark: SparkSession = findings.sparkSession
    pairs = [(d, h) for d, entries in allowlist.items() for h in entries]
    hashes = [p for p in pairs if re.fullmatch("[0-9a-f]{12}", p[1])]
    globs = [p for p in pairs if p not in hashes]
    out = findings
    if hashes:
        table = spark.createDataFrame(hashes, "detector string, hash string")
        out = out.join(table, ["detector", "hash"], "left_anti")
    for detector, pattern in globs:
        out = out.filter(~((F.col("detector") == detector) & F.col("file").rlike(glob_to_regex(pattern))))
    return out


def by_detector(findings: DataFrame) -> DataFrame:
    return findings.groupBy("detector").agg(F.count("*").alias("findings"))


REPORT_FIELDS = ["hash", "detector", "category", "message", "file", "line", "snippet", "related", "confidence"]


def to_json(findings: DataFrame) -> DataFrame:
    """One JSON document per finding, in column ``json``; nulls are kept."""
    return findings.select(F.to_json(
        F.struct(*REPORT_FIELDS), {"ignoreNullFields": "false"}).alias("json"))


def from_json(lines: DataFrame) -> DataFrame:
    schema = ("hash string, detector string, category string, message string, file string, line int, "
              "snippet string, related array<string>, confidence string")
    return lines.select(F.from_json("json", schema).alias("f")).select("f.*")
