"""Text helpers as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Line separators recognised when splitting decoded text into lines.
LINE_BREAKS = "[\\n\\u000b\\u000c\\u001c\\u001d\\u001e\\u0085\\u2028\\u2029]"
# Characters removed by strip(): ASCII white space.
BLANKS = " \t\n\r\u000b\u000c\u001c\u001d\u001e\u001f\u0085 "


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also inside lambda functions."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unify_newlines(text: Column) -> Column:
    """``\\r\\n`` and ``\\r`` become ``\\n``, as a text-mode reader does."""
    return F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)


def raw_lines(text: Column) -> Column:
    """Newline count, plus one for an unterminated last line."""
    newlines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    tail = F.when((text != "") & ~F.endswith(text, F.lit("\n")), 1).otherwise(0)
    return (newlines + tail).cast("int")


def split_lines(text: Column) -> Column:
    """Lines of a text; a terminator at the very end adds no empty line."""
    parts = F.split(text, LINE_BREAKS, -1)
    return F.when(
        F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)
    ).otherwise(parts)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def lstrip(text: Column) -> Column:
    return F.regexp_replace(text, "^(?U)\\s+", "")


def indent(text: Column) -> Column:
    return F.length(text) - F.length(lstrip(text))


def snippet(lines: Column, line: Column, count: int) -> Column:
    """``count`` lines starting at 1-based ``line``, joined with newlines."""
    return F.array_join(F.slice(lines, F.greatest(line, F.lit(1)), count), "\n")


def name_in_other_line(lines: Column, name: Column, line: Column) -> Column:
    """True when ``name`` is a plain substring of any line except ``line``."""
    def found(name: Column) -> Column:
        holds = lambda text: F.contains(text, name)
        return F.exists(F.slice(lines, 1, line - 1), holds) | F.exists(F.slice(lines, line + 1, F.size(lines)), holds)

    return let(name, found)  # an expression would be worked out anew for each line


def retoken(text: Column, pattern: str, change) -> Column:
    """Cut ``text`` into the matches of ``pattern`` and rewrite each with ``change``."""
    return F.array_join(
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), change), ""
    )


def only_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "[^\\n]+", "")


def last_part(text: Column, sep: str) -> Column:
    return F.substring_index(text, sep, -1)


def first_is_upper(text: Column) -> Column:
    head = F.substring(text, 1, 1)
    return (F.upper(head) == head) & (F.lower(head) != head)


def comma_count(params: Column) -> Column:
    """Non-blank comma-separated parts."""
    return F.size(F.filter(F.split(params, ","), lambda p: strip(p) != ""))


def nested_comma_count(params: Column, openers: str, closers: str) -> Column:
    """Parts separated by commas outside brackets; 0 for a blank string."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(1).alias("parts"))

    def step(acc: Column, ch: Column) -> Column:
        return F.struct(
            (acc["depth"]
             + F.when(F.contains(F.lit(openers), ch), 1)
             .when(F.contains(F.lit(closers), ch), -1).otherwise(0)).alias("depth"),
            (acc["parts"] + F.when((ch == ",") & (acc["depth"] == 0), 1).otherwise(0)).alias("parts"),
        )

    chars = F.filter(F.split(params, ""), lambda c: c != "")
    return F.when(strip(params) == "", 0).otherwise(
        F.aggregate(chars, start, step, lambda acc: acc["parts"])
    )
