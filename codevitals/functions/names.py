"""Predicates and transforms on symbol names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def local_name(name: Column, alias: Column) -> Column:
    """The name an import binds in its file."""
    return F.coalesce(F.nullif(alias, F.lit("")), name)


def prefixes(name: Column) -> Column:
    """``a.b.c`` -> [a, a.b, a.b.c]."""
    parts = F.split(name, "\\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), ".")
    )


def call_references(name: Column) -> Column:
    """Every name a call refers to: its prefixes and the form without self./cls."""
    bare = F.regexp_replace(name, "^(self|cls)\\.", "")
    return F.array_distinct(F.concat(prefixes(name), F.array(bare)))


def is_pascal_case(name: Column) -> Column:
    head = F.substring(name, 1, 1)
    return (
        (F.upper(head) == head) & (F.lower(head) != head)
        & (F.upper(name) != name) & ~F.contains(name, F.lit("_"))
    )


def is_all_caps(name: Column) -> Column:
    return (
        (F.upper(name) == name) & (F.length(name) > 1)
        & F.regexp_replace(name, "_", "").rlike("^\\p{L}+$")
    )


def finding_hash(detector: Column, category: Column, file: Column, line: Column) -> Column:
    """Stable 12-hex-digit identity; a missing line is written as ``None``."""
    key = F.concat_ws(":", detector, category, file, F.coalesce(line.cast("string"), F.lit("None")))
    return F.substring(F.sha2(key, 256), 1, 12)
