"""Import edges evaluate the rules of imports alone, with the same imports."""

from codevitals.parsing import rules
from codevitals.parsing.symbols import symbols

CODE = """import a, { b as c } from './m';
import './bare';
const d = require('./d'), e = 1, f = require('./f');
function g() {
  const no = require('./no');
  if (x) { import h from './no2'; }
}
const k = ({ a, b }) => {
  return [a, b].map((q) => { return q; });
};
const l = require('./l'); let m = () => { return 1 }
class N { o() { const p = require('./no3'); } }
import r from './r';
"""


def test_imports_alone_are_the_same(spark, make_files, monkeypatch):
    files = make_files({"a.ts": CODE, "b.js": CODE.replace("function g() {", "function g(\n  x,\n) {")})
    columns = ["file", "name", "line", "source", "alias", "in_text"]
    whole = symbols(files, ["javascript"]).filter("kind = 'import'").select(columns).collect()

    def never(line):
        raise AssertionError("all rules are evaluated")

    monkeypatch.setitem(rules.RULES, "javascript", never)
    alone = symbols(files, ["javascript"], ["import"]).select(columns).collect()
    assert sorted(map(str, alone)) == sorted(map(str, whole))
    assert {"./m", "./bare", "./d", "./f", "./l", "./r"} == {r["source"] for r in alone}


def test_statements_are_flattened_once(spark, make_files):
    """What several rules look at is made once for a line, not again in each rule."""
    rows = symbols(make_files({"a.ts": "const a = (b) => { c(b); };\n"}), ["javascript"])
    assert rows._jdf.queryExecution().analyzed().toString().count(r"\([^()]*\)") == 3
