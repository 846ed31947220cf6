"""Builders for line events: what one source line contributes to the symbol table.

A rule set turns a line into arrays of event structs. Decisions that need other
lines (block ends, nesting, visibility) are left to window functions over the
events of one file, see ``symbols.py``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EVENT = ("struct<kind:string,name:string,a:string,b:string,own:string,"
         "n:int,pos:int>")
EVENTS = f"array<{EVENT}>"

# Position of an event inside its line: class before function before other
# declarations before brackets before end-of-line markers.
AT_CLASS, AT_DECL, AT_LINE, AT_EOL = -2, -1, 0, 1_000_000


def _as(value, kind: str) -> Column:
    column = value if isinstance(value, Column) else F.lit(value)
    return column.cast(kind)


def ev(kind: str, name=None, a=None, b=None, own=None, n=None, pos=AT_LINE) -> Column:
    return F.struct(
        _as(kind, "string").alias("kind"), _as(name, "string").alias("name"),
        _as(a, "string").alias("a"), _as(b, "string").alias("b"),
        _as(own, "string").alias("own"), _as(n, "int").alias("n"),
        _as(pos, "int").alias("pos"),
    )


class Checked:
    """Import and variable events: the file's text is searched for other uses of the name.

    They are built on whole files (inside ``transform``), so the search needs no join.
    """

    def __init__(self, column: Column):
        self.column = column


def none() -> Column:
    return F.array().cast(EVENTS)


def joined(*arrays: Column) -> Column:
    """Arrays of events one after the other; ``concat`` makes a lazy list for each line, which takes longer than most rules."""
    return F.flatten(F.array(*arrays))


def either(condition: Column, then: Column, other: Column) -> Column:
    """``if``: inside ``transform``, where nothing is compiled, CASE goes through a list of its branches and takes several times as long."""
    return F.call_function("if", condition, then, other)


def hit(condition: Column, *events: Column) -> Column:
    return either(condition, F.array(*events), none())


def hits(condition: Column, events: Column) -> Column:
    return either(condition, events, none())


def first_of(*cases: tuple[Column, Column]) -> Column:
    """The events of the first case whose condition holds."""
    out = none()
    for condition, events in reversed(cases):
        out = either(condition, events, out)
    return out


def rx(pattern: str) -> str:
    """Unicode-aware character classes, as in Python's ``re``."""
    return "(?U)" + pattern


def has(text: Column, pattern: str) -> Column:
    return text.rlike(rx(pattern))


def grab(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(text, rx(pattern), group)


def grab_opt(text: Column, pattern: str, group: int) -> Column:
    """A group that may be absent: NULL instead of an empty string."""
    return F.nullif(grab(text, pattern, group), F.lit(""))


def grab_all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(rx(pattern)), F.lit(group))


def calls(names: Column, keep=None, rename=None) -> Column:
    if keep is not None:
        names = F.filter(names, keep)
    return F.transform(names, lambda x: ev("call", rename(x) if rename else x))


def brackets(line: Column, opener: str = "{", closer: str = "}") -> Column:
    found = F.regexp_extract_all(line, F.lit("[{}]"), F.lit(0))
    return F.transform(found, lambda x, i: ev(x, pos=i + 1))


def function(name, params, end="block", **more) -> Column:
    return ev("function", name, a=end, n=params, pos=AT_DECL, **more)


def klass(name, own_line_methods=0, end="block", **more) -> Column:
    return ev("class", name, a=end, n=own_line_methods, pos=AT_CLASS, **more)


def export(name, kind: str, **more) -> Column:
    return ev("export", name, a=kind, **more)


def last_dotted(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


__all__ = [n for n in dir() if not n.startswith("_")]
