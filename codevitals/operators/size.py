"""Oversized files, functions and classes: plain filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Thresholds
from ..functions.text import raw_lines
from .common import finding, first_lines


def large_files(files: DataFrame, limits: Thresholds) -> DataFrame:
    count = raw_lines(F.col("text"))
    rows = files.select("repo_id", "file", count.alias("n")).filter(F.col("n") > limits.max_file_lines)
    return finding(
        rows, "size", "large_file",
        F.format_string(f"File is %d lines (threshold: {limits.max_file_lines})", "n"), line=F.lit(1))


def large_functions(symbols: DataFrame, limits: Thresholds) -> DataFrame:
    count = F.col("end_line") - F.col("line") + 1
    rows = symbols.filter((F.col("kind") == "function") & (count > limits.max_function_lines))
    return finding(
        rows, "size", "large_function",
        F.format_string(f"Function '%s' is %d lines (threshold: {limits.max_function_lines})", "name", count),
        1, F.col("line"), first_lines(F.col("snippet"), 3), ord_=F.col("ord"))


def god_classes(symbols: DataFrame, limits: Thresholds) -> DataFrame:
    rows = symbols.filter((F.col("kind") == "class") & (F.col("n") >= limits.max_class_methods))
    return finding(
        rows, "size", "god_class",
        F.format_string(f"Class '%s' has %d methods (threshold: {limits.max_class_methods})", "name", "n"),
        2, F.col("line"), first_lines(F.col("snippet"), 3), ord_=F.col("ord"))


def size(files: DataFrame, symbols: DataFrame, limits: Thresholds) -> DataFrame:
    return (large_files(files, limits).unionByName(large_functions(symbols, limits))
            .unionByName(god_classes(symbols, limits)))
