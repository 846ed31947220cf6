"""Re-scan: reuse the symbols of files whose modification time did not change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..parsing.symbols import present_languages, symbols

KEY = ["repo_id", "file"]


def hits(listing: DataFrame, cached: DataFrame) -> DataFrame:
    """Listed files whose cached modification time is equal."""
    return listing.join(cached.select(*KEY, "mtime"), [*KEY, "mtime"], "left_semi")


def misses(listing: DataFrame, cached: DataFrame) -> DataFrame:
    """Listed files to parse: new or changed."""
    return listing.join(cached.select(*KEY, "mtime"), [*KEY, "mtime"], "left_anti")


def stale(listing: DataFrame, cached: DataFrame) -> DataFrame:
    """Cached files that are no longer listed."""
    return cached.join(listing.select(*KEY), KEY, "left_anti")


def refresh(files: DataFrame, cached_files: DataFrame, cached_symbols: DataFrame,
            langs: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(files, symbols) of the new cache: kept rows of unchanged files plus parsed rest.

    Only the columns of the join key and ``mtime`` meet the cache; texts of unchanged
    files are not read by the parser.
    """
    listing = files.select(*KEY, "mtime")
    same = hits(listing, cached_files)
    changed = misses(files, cached_files)
    langs = present_languages(changed) if langs is None else langs
    kept = cached_symbols.join(same.select(*KEY), KEY, "left_semi")
    return listing, kept.unionByName(symbols(changed, langs)) if langs else kept
