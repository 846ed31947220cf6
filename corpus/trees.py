"""Two source trees derived from ``documents``: one of Python, one of TypeScript files.

Names, imports and copies follow arithmetic on ``doc_id`` so that the findings are
known; every file starts with its document's whole text as comments. ``t`` and ``u``
are the ids of other files a file refers to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .render import prose, source_file

PY_CODE = """import os{i}x
from pkg import load{i}x as ld{i}x
{far}
X{i}x = 1
def _helper{i}x(a):
    return a
@wrap

# note
def _deco{i}x():
    return 1
def public{i}x(b):
    {call}
    {use}
    return "{text}"
class _Base{i}x:
    pass
class Kid{i}x:
    def _m{i}x(self): return {base}
def {dup}(a):
    b = a + {i}
    c = "text {i}"
    # comment {i}
    d = {{'k{i}': b}}
    return [b, c, d]
def long{i}x():
{long}    return 2
class God{i}x:
{god}    z = 1
"""
# line of each part, relative to the code
PY_LINES = {"os": 1, "load": 2, "far": 3, "helper": 5, "deco": 10, "public": 12, "base": 16, "kid": 18,
            "dup": 20, "long": 26}

TS_CODE = """import { a{i}x, b{i}x as c{i}x } from './lib{i}';
import d{t}x from '../m{tm}/g{t}';
const kept{i}x = d{t}x(1);
let idle{i}x = 2;
// {mention}
export const pub{i}x = 3;
{imp}
export default function main{i}x() { return {use}(); }
function priv{i}x(p, q) {
  return p;
}
{callpriv}
"""


def _fill(template: str, **values: Column) -> Column:
    out = F.lit(template.replace("{{", "\u0001").replace("}}", "\u0002"))
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return F.replace(F.replace(out, F.lit("\u0001"), F.lit("{")), F.lit("\u0002"), F.lit("}"))


def _when(test: Column, a, b) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.when(test, as_col(a)).otherwise(as_col(b))


def python_tree(docs: DataFrame) -> DataFrame:
    i = F.col("doc_id")
    s = i.cast("string")
    rows = docs.withColumn("n_docs", F.lit(docs.count()))
    t = F.pmod(i * 7 + 3, F.col("n_docs")).cast("string")
    code = _fill(
        PY_CODE,
        far=_when(i % 4 == 0, F.concat(F.lit("from far import _helper"), t, F.lit("x")), "pass"),
        call=_when(i % 5 == 0, "_helper{i}x(b)", "b"),
        use=_when(i % 3 != 0, "os{i}x.go()", "b"),
        text=_when(i % 2 == 0, "uses ld{i}x", "none"),
        base=_when(i % 6 == 0, "_Base{i}x()", "1"),
        dup=_when(i % 11 == 0, "dup", "solo{i}x"),
        long=F.repeat(F.lit("    z = 1\n"), (F.lit(90) + i % 20).cast("int")),
        god=F.repeat(F.lit("    def m(self): pass\n"), (F.lit(15) + i % 10).cast("int")),
        i=s)
    text = F.concat(F.substring(prose(F.col("text"), "# "), 2, 2_000_000_000), F.lit("\n"), code)
    file = F.concat(F.lit("src/m"), (i % 16).cast("string"), F.lit("/f"), s, F.lit(".py"))
    return source_file(rows, "tree", file, ".py", text)


def typescript_tree(docs: DataFrame) -> DataFrame:
    i = F.col("doc_id")
    s = i.cast("string")
    rows = docs.withColumn("n_docs", F.lit(docs.count()))
    pair = F.floor(i / 2) % 7 == 0
    t = F.when(pair, F.when(i % 2 == 0, i + 1).otherwise(i - 1)).otherwise(i + 1)
    u = F.pmod(i * 3 + 1, F.col("n_docs")).cast("string")
    code = _fill(
        TS_CODE,
        tm=(t % 16).cast("string"), t=t.cast("string"),
        mention=_when(i % 4 == 0, "idle{i}x", "nothing"),
        imp=_when(i % 5 == 0, F.concat(F.lit("import { pub"), u, F.lit("x } from './x';")), ""),
        use=_when(i % 3 == 0, "a{i}x", "c{i}x"),
        callpriv=_when(i % 2 == 0, "priv{i}x(1, 2);", ""),
        i=s)
    text = F.concat(F.substring(prose(F.col("text"), "// "), 2, 2_000_000_000), F.lit("\n"), code)
    file = F.concat(F.lit("src/m"), (i % 16).cast("string"), F.lit("/g"), s, F.lit(".ts"))
    return source_file(rows, "tree", file, ".ts", text)


#: What file k of a folder imports: a ring of three with a ring of two on it, entered from outside in the middle, that
#: leads to another ring of three with a shortcut.
RINGS = {0: [1], 1: [2], 2: [0, 3], 3: [2, 5], 4: [1], 5: [6], 6: [7], 7: [5, 6]}


def ring_tree(docs: DataFrame) -> DataFrame:
    """Eight documents make a folder of TypeScript files that import each other as in ``RINGS``."""
    i = F.col("doc_id")
    lines = F.lit("")
    for k, targets in RINGS.items():
        lines = F.when(i % 8 == k, "".join(f"import {{ a{t} }} from './h{t}';\n" for t in targets)).otherwise(lines)
    text = F.concat(F.substring(prose(F.col("text"), "// "), 2, 2_000_000_000), F.lit("\n"), lines)
    file = F.concat(F.lit("src/c"), F.floor(i / 8).cast("string"), F.lit("/h"), (i % 8).cast("string"), F.lit(".ts"))
    return source_file(docs, "rings", file, ".ts", text)
