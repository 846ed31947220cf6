"""A project's state: findings, decisions, cursor and the last scan's tables, as append-only Spark tables below any URI that Spark reads and writes.

A save appends its rows under a new version and then appends the version to the table ``versions``; readers take the newest version listed there, so a save that
did not end is not seen. Nothing is overwritten, so writers don't lose each other's rows.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import fields
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import triage
from .config import STATE_DIR
from .plans.rescan import ScanState
from .schema import SYMBOLS

_FINDINGS = ("repo_id string, detector string, category string, message string, file string, line int, "
             "snippet string, related array<string>, group_id string, confidence string, kind_ord int, "
             "ord int, hash string, finding_id string, seq bigint")
_KEY = "repo_id string, file string"
_SCAN = {
    "listing": f"{_KEY}, mtime double", "symbols": ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SYMBOLS),
    "usage": "repo_id string, name string, calls bigint, importers bigint",
    "bodies": f"{_KEY}, line int, ord int, name string, snippet string, group_id string",
    "edges": "repo_id string, src string, dst string", "findings": _FINDINGS.partition(", hash")[0]}
_VERSIONS = "label string, version string, note string"


class Store:
    """The state of the project at ``project``, a path or a URI."""

    def __init__(self, spark: SparkSession, project: str | Path):
        self.spark = spark
        self.root = f"{str(project).rstrip('/')}/{STATE_DIR}/tables"

    def _read(self, label: str, schema: str) -> DataFrame:
        """All rows of a table; none if nothing was saved yet."""
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{label}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _newest(self, label: str) -> tuple[str, str] | None:
        """Version and note of the last save."""
        row = self._read("versions", _VERSIONS).filter(F.col("label") == label).orderBy(F.desc("version")).first()
        return row and (row.version, row.note)

    def _save(self, label: str, tables: dict[str, DataFrame], note: str = "") -> None:
        version = f"{time.time_ns():020d}-{uuid.uuid4().hex}"  # versions sort by time
        for name, df in tables.items():
            df.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(f"{self.root}/{name}")
        self.spark.createDataFrame([(label, version, note)], _VERSIONS).coalesce(1).write.mode("append").parquet(f"{self.root}/versions")

    def _load(self, name: str, schema: str, version: str | None) -> DataFrame:
        rows = self._read(name, f"{schema}, version string")
        return rows.filter(F.col("version") == version).drop("version")

    def findings(self) -> DataFrame:
        newest = self._newest("report")
        return self._load("report", _FINDINGS, newest and newest[0])

    def save_findings(self, findings: DataFrame) -> DataFrame:
        names = [part.split()[0] for part in _FINDINGS.split(", ")]
        self._save("report", {"report": findings.select(names)})
        return self.findings()

    def scan_state(self, settings: str) -> ScanState | None:
        """The tables of the last scan, if it had the same settings."""
        newest = self._newest("scan")
        if newest is None or newest[1] != settings:
            return None
        return ScanState(*(self._load(f"scan-{f.name}", _SCAN[f.name], newest[0]) for f in fields(ScanState)))

    def save_scan_state(self, state: ScanState, settings: str) -> None:
        """All tables of one scan become current at once."""
        self._save("scan", {f"scan-{f.name}": getattr(state, f.name) for f in fields(ScanState)}, settings)

    def decisions(self) -> DataFrame:
        return self._read("decisions", triage.DECISIONS)

    def decide(self, hash_: str, status: str) -> None:
        triage.decision(self.spark, hash_, status).write.mode("append").parquet(f"{self.root}/decisions")

    def cursor(self) -> str | None:
        newest = self._newest("cursor")
        return newest and newest[1]

    def set_cursor(self, hash_: str) -> None:
        self._save("cursor", {}, hash_)

    def next(self, detector: str | None = None, cursor: str | None = None):
        """The next finding as a Row, or None; moves the cursor."""
        found = triage.next_finding(self.findings(), self.decisions(), cursor, detector).first()
        if found:
            self.set_cursor(found["hash"])
        return found


def ensure_gitignore(folder: str | Path) -> bool:
    """Add the state folder to ``.gitignore``; True when the file changed."""
    path, entry = Path(folder) / ".gitignore", f"{STATE_DIR}/"
    text = path.read_text() if path.exists() else ""
    if entry in (line.strip() for line in text.splitlines()):
        return False
    path.write_text(text + ("" if not text or text.endswith("\n") else "\n") + entry + "\n")
    return True


