"""Which paths are scanned, as Column predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..findings import glob_to_regex
from ..schema import SUPPORTED_SUFFIXES

# Fixed values
SKIPPED_ENDINGS = [".d.ts", ".d.tsx", ".min.js", ".min.css"]


def suffix(path: Column) -> Column:
    """The last extension of the file name; names that start with their only dot have none."""
    return F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)


def supported(path: Column) -> Column:
    return suffix(path).isin(*SUPPORTED_SUFFIXES)


def skipped_ending(path: Column) -> Column:
    found = F.lit(False)
    for ending in SKIPPED_ENDINGS:
        found = found | F.endswith(path, F.lit(ending))
    return found


def path_prefixes(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def is_ignored(path: Column, ignore: list[str]) -> Column:
    """Some glob matches the path or one of its leading parts."""
    if not ignore:
        return F.lit(False)
    one = "|".join(f"(?:{glob_to_regex(g)})" for g in ignore)
    return F.exists(path_prefixes(path), lambda p: p.rlike(one))


def skipped_directories(ignore: list[str]) -> list[str]:
    """Directory names pruned at any depth: globs without ``/`` or ``*`` once their ends are cut."""
    names = [g.rstrip("/*") for g in ignore]
    return [n for n in names if "/" not in n and n == n.strip("*")]


def in_pruned_directory(path: Column, ignore: list[str]) -> Column:
    """A directory of the path is skipped by name or starts with a dot."""
    folders = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    names = skipped_directories(ignore)
    return F.exists(folders, lambda d: d.isin(*names) | F.startswith(d, F.lit(".")))


def is_source_file(path: Column, ignore: list[str]) -> Column:
    return (supported(path) & ~skipped_ending(path) & ~in_pruned_directory(path, ignore)
            & ~is_ignored(path, ignore))


def path_order(path: Column) -> Column:
    """Sort key: paths compare part by part."""
    return F.split(path, "/")
