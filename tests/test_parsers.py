"""Parsers against hand-derived symbols: one template per language, then the odd cases."""

from collections import Counter

import pytest

from codevitals.parsing.pyast import file_symbols, parse_errors
from codevitals.parsing.symbols import symbols
from codevitals.schema import LANGUAGE_SUFFIXES
from corpus.templates import TEMPLATES

COLUMNS = ["kind", "name", "line", "end_line", "n", "source", "alias", "tag"]


def short(rows, *fields):
    return sorted((tuple(row[COLUMNS.index(f)] for f in fields) for row in rows.elements()), key=str)


BLOCKS = [
    ("go", "func a() {\n  if x {\n  }\n", [("a", 1, 1)]),
    # a bracket in a string counts
    ("java", "class A {\n  // }\n  void f() {\n    String s = \"}\";\n  }\n}\n", [("f", 3, 4)]),
    ("scala", "/* a\nb */\ndef f(a: Int) = 1\n", [("f", 2, 2)]),
    ("nim", "proc f() =\n  if x:\n    y()\n\nproc g() =\n  z()\n", [("f", 1, 3), ("g", 5, 6)]),
    ("nim", "#[ a #[ b ]# proc x() = 1\n]#\nproc y() = discard\n", [("y", 3, 3)]),
    ("ruby", "def f\n  if a\n  end\nend\n", [("f", 1, 4)]),
    ("lua", "function f()\n  repeat\n  until x\nend\n", [("f", 1, 4)]),
    ("erlang", "f(1) -> a;\nf(2) ->\n  b.\ng() -> c.\n", [("f", 1, 3), ("g", 4, 4)]),
    ("elixir", "def f(a) do\n  case a do\n    1 -> 2\n  end\nend\n", [("f", 1, 5)]),
    ("shell", "f() {\n  echo '}'\n}\n", [("f", 1, 3)]),
    ("solidity", "contract A {\n\n  function f() public {}\n}\n", [("f", 2, 3)]),
    ("objc", "- (void)a\n{\n  x();\n}\n", [("a", 1, 4)]),
    ("dart", "int f() =>\n  1;\n", [("f", 1, 2)]),
    ("javascript", "function f(a) {\n  if (a) { g({x: 1}); }\n}\n", [("f", 1, 3)]),
    ("java", 'class A {\n  String u = "http://x";\n  int g() { return 1; }\n}\n', [("g", 3, 3)]),
]
IMPORTS = [
    ("zig", 'const c = @import("config.zig");\n', [("conf", "config.zig", "c")]),
    ("rust", "use a::*;\nuse x::{y, z as w};\n", [("a", "a::*", None), ("y", "x::y", None), ("z", "x::z", "w")]),
    ("go", 'import (\n\tx "a/b"\n)\nimport "c/d"\n', [("b", "a/b", "x"), ("d", "c/d", None)]),
    ("erlang", "-module(m).\n", [("m", None, None)]),
    ("lua", "local j = require 'a.b'\n", []),
    ("javascript", "import type { A } from 'x';\nimport B, * as C from \"y\";\n",
     [("*", "y", "C"), ("A", "x", None), ("B", "y", None)]),
    ("scala", "import a.b.{C => D, E}\nimport f._\n", [("C", "a.b", "D"), ("E", "a.b", None), ("_", "f", None)]),
]
LONG_OBJC = "static " + "word " * 30000 + "run(int a) {\n}\n"
JS = ("class A {\n  m() {\n    this.a.b();\n    new Foo();\n    x?.y();\n  }\n}\n"
      "const s = 'call(no)'; // other(no)\nexport { p as q };\n")
CPP = "int a = 1; /* open\nint b = 2;\n"


@pytest.fixture(scope="module")
def parsed(spark, make_files):
    """All odd cases as files of one plan: {file stem: rows}."""
    cases = [(f"block{i}", lang, text) for i, (lang, text, _) in enumerate(BLOCKS)]
    cases += [(f"import{i}", lang, text) for i, (lang, text, _) in enumerate(IMPORTS)]
    cases += [("js", "javascript", JS), ("cpp", "cpp", CPP), ("long", "objc", LONG_OBJC)]
    fill = lambda v: v.replace("{i}", "7")
    cases += [(f"template-{lang}", lang, fill(text)) for lang, (text, _) in TEMPLATES.items()]
    files = make_files({stem + LANGUAGE_SUFFIXES[lang][0]: text for stem, lang, text in cases})
    out: dict = {}
    for row in symbols(files).collect():
        out.setdefault(row.file.rsplit(".", 1)[0], Counter())[tuple(row[c] for c in COLUMNS)] += 1
    return out


def only(rows, kind):
    return Counter({r: n for r, n in rows.items() if r[0] == kind})


@pytest.mark.parametrize("lang", sorted(TEMPLATES))
def test_template(parsed, lang):
    fill = lambda v: v.replace("{i}", "7") if isinstance(v, str) else v
    assert parsed[f"template-{lang}"] == Counter(tuple(fill(v) for v in row) for row in TEMPLATES[lang][1])


@pytest.mark.parametrize("i", range(len(BLOCKS)))
def test_block_ends(parsed, i):
    assert short(only(parsed[f"block{i}"], "function"), "name", "line", "end_line") == BLOCKS[i][2]


@pytest.mark.parametrize("i", range(len(IMPORTS)))
def test_imports(parsed, i):
    rows = short(only(parsed.get(f"import{i}", Counter()), "import"), "name", "source", "alias")
    assert sorted(rows, key=str) == sorted(IMPORTS[i][2], key=str)


def test_very_long_line(parsed):
    assert short(only(parsed["long"], "function"), "name", "line", "end_line", "n") == [("run", 1, 2, 1)]


def test_unfinished_comment(parsed):
    assert short(only(parsed["cpp"], "variable"), "name") == [("a",)]


def test_javascript_calls_and_classes(parsed):
    rows = parsed["js"]
    assert short(only(rows, "call"), "name") == [("a.b",), ("x.y",)]
    assert short(only(rows, "export"), "name", "tag") == [("p", "variable")]
    assert ("A", 1, 7, 1) in short(only(rows, "class"), "name", "line", "end_line", "n")


JS_STATEMENTS = """const a = 1, m: Map<string, number> = new Map<string, number>(), f = x => x + 1, C = class {};
const b = start(1)
  .next({
    k: inner(2),
  })
  .last(), c = 2;
class K {
  run(a) { return fetch(a)
    .then(r => {
      return r.json()
        .also();
    });
  }
}
items.map(({ id }) => id)?.filter(Boolean);
"""


def test_javascript_statements(make_files):
    """Several declarators, chains over lines and where their calls count."""
    rows = symbols(make_files({"s.ts": JS_STATEMENTS}), ["javascript"]).collect()
    by = lambda kind: sorted((r.line, r.name) for r in rows if r.kind == kind)
    assert by("variable") == [(1, "a"), (1, "m"), (2, "b"), (2, "c")]
    assert by("function") == [(1, "f"), (8, "run")]
    assert by("call") == sorted([
        (2, "start"), (2, "next"), (2, "last"), (4, "inner"), (8, "fetch"), (8, "then"), (10, "r.json"), (10, "also"),
        (15, "items.map"), (15, "filter")])


def test_javascript_long_lines(make_files):
    """A minified megabyte, open brackets and very many declarators, each in one line."""
    texts = {"calls.js": "f(" * 100_000 + "\n", "min.js": "var a=1;" + "g(x,{y:[1,2]}).h();" * 20_000 + "\n",
             "many.js": "let " + ", ".join(f"v{i} = {i}" for i in range(2_000)) + ";\n", "dots.js": ".a()" * 50_000 + "\n"}
    rows = symbols(make_files(texts), ["javascript"], ["variable", "function"])
    assert {(r.file, r["count"]) for r in rows.groupBy("file").count().collect()} == {("min.js", 1), ("many.js", 2_000)}


def test_python_syntax_errors_are_reported(make_files):
    assert [r["kind"] for r in file_symbols("def f(:\n")] == ["parse_error"]
    files = make_files({"bad.py": "x = 1\ndef f(:\n", "good.py": "x = 1\n", "bad.go": "func {"})
    assert symbols(files, ["python"]).filter("file = 'bad.py'").count() == 0
    assert [(r.file, r.error, r.line) for r in parse_errors(files).collect()] == [("bad.py", "SyntaxError", 2)]


def test_invalid_utf8_has_no_text_search(spark):
    from codevitals.schema import FILES
    rows = [("r", "a.py", ".py", "import os\n", False, 0.0), ("r", "b.rb", ".rb", "require 'x'\n", False, 0.0)]
    found = symbols(spark.createDataFrame(rows, FILES), ["python", "ruby"]).collect()
    assert {(r.name, r.in_text, r.snippet) for r in found} == {("os", None, None), ("x", None, None)}


def test_crlf_and_exotic_line_breaks(spark, make_files):
    from pyspark.sql import functions as F
    from codevitals.functions.text import raw_lines, split_lines, unify_newlines
    texts = ["", "a", "a\n", "a\nb", "a\r\nb\rc", "a\x0bb\x0cc\x1cd\x85e\u2028f", "\n\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = unify_newlines(F.col("t"))
    got = df.select(split_lines(t).alias("l"), raw_lines(t).alias("n")).collect()
    for text, row in zip(texts, got):
        plain = text.replace("\r\n", "\n").replace("\r", "\n")
        assert row.l == plain.splitlines()
        assert row.n == plain.count("\n") + (1 if plain and not plain.endswith("\n") else 0)


LONG_CALLS = {"A.java": "class A {\n void f() {\n  %s();\n }\n}\n", "a.cpp": "void f() {\n  %s();\n}\n", "a.js": "function f() {\n  %s();\n}\n",
              "a.sol": "contract A {\n function f() public {\n  %s();\n }\n}\n", "a.rb": "def f\n  %s()\nend\n"}


def test_long_chains(make_files):
    """Ten thousand names in a call."""
    chain = ".".join(f"n{i}" for i in range(10_000))
    files = make_files({name: text % chain for name, text in LONG_CALLS.items()})
    names = {r.file: r.name for r in symbols(files, kinds=["call"]).filter("length(name) > 1000").collect()}
    assert set(names) == set(LONG_CALLS) and set(names.values()) == {chain}


def test_objc_functions_of_any_length(make_files):
    head = "static __attribute__(always_inline) int run(int a) {"
    files = make_files({"short.m": head + " }\n", "long.m": head + " " + "a = 1; " * 15_000 + "}\n"})
    rows = symbols(files, ["objc"], ["function", "export"]).collect()
    assert sorted((r.file, r.kind, r.name) for r in rows) == [
        ("long.m", "export", "run"), ("long.m", "function", "run"), ("short.m", "export", "run"), ("short.m", "function", "run")]
