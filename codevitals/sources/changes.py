"""The change set of a git working tree."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession


def _git(project: str, *args: str) -> list[str]:
    done = subprocess.run(["git", *args], cwd=project, capture_output=True, text=True)
    return [p for p in done.stdout.split("\0") if p] if done.returncode == 0 else []


def changed_paths(project: str, base: str = "main") -> list[str]:
    """Changed against ``base``, else against HEAD, else per status; relative to ``project``."""
    diff = ["diff", "--name-only", "-z", "--relative"]
    found = _git(project, *diff, f"{base}...HEAD") or _git(project, *diff, "HEAD")
    if found:
        return found
    paths, entries = [], iter(_git(project, "status", "--porcelain", "-z", "--", "."))
    for entry in entries:
        paths.append(entry[3:])
        if entry[0] in "RC":
            next(entries, None)
    prefix = (_git(project, "rev-parse", "--show-prefix") or [""])[0].strip()
    return [p.removeprefix(prefix) for p in paths]


def changed_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.createDataFrame([(p,) for p in paths], "file string").distinct()
