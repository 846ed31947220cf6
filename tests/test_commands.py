"""Sources, incremental scans, triage, fix and the stream."""

import os
import subprocess

from codevitals import triage
from codevitals.cli import main
from codevitals.config import Config, Thresholds
from codevitals.findings import with_hash, with_seq
from codevitals.operators.size import large_files
from codevitals.operators.unused_imports import unused_imports
from codevitals.parsing.symbols import symbols
from codevitals.plans import fix, incremental
from codevitals.session import stored
from codevitals.sources import list_tree, read_files, read_tree
from codevitals.sources.changes import changed_paths
from codevitals.sources.tree import TreeReader, _Share
from codevitals.store import Store, ensure_gitignore
from codevitals.streaming.rescan import merge_batch, read_file_stream
from pyspark.sql import functions as F


def write(root, texts):
    for path, text in texts.items():
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(text if isinstance(text, bytes) else text.encode())


def test_tree_source(spark, tmp_path):
    write(tmp_path, {
        "pkg/__init__.py": "a\r\nb", "_private/x.py": "", ".hidden/x.py": "", ".dot.py": "", "[id].tsx": "",
        "with space.go": "", "deep/build/x.py": "", "x.d.ts": "", "a.min.js": "", "a/b/c/d/e.rs": "",
        "node_modules/m/x.js": "", "note.txt": "", "bad.py": b"x = '\xff'\n", "gen/x.py": ""})
    rows = {r.file: r for r in read_tree(spark, tmp_path, Config.from_mapping({"ignore": ["gen/**"]}).ignore).collect()}
    assert set(rows) == {"pkg/__init__.py", "_private/x.py", ".dot.py", "[id].tsx", "with space.go",
                         "a/b/c/d/e.rs", "bad.py"}
    assert rows["pkg/__init__.py"].text == "a\nb"
    assert not rows["bad.py"].utf8_ok and rows["bad.py"].text == "x = '\ufffd'\n"
    assert rows["bad.py"].mtime == os.stat(tmp_path / "bad.py").st_mtime


def test_listing_filters_and_errors(spark, tmp_path):
    """A listing keeps to a folder and to newer files; what can't be read is listed with its error."""
    write(tmp_path, {"a/x.py": "1", "a/y.py": "22", "b/c/d/z.go": "333", "b/gone.py": "4", "b/old.py": "5", "gen/i.py": "6"})
    os.utime(tmp_path / "b/old.py", (1, 1))
    listing = list_tree(spark, tmp_path, ["gen/**"], "r")
    got = {r.file: (r.size, r.error) for r in listing.collect()}
    assert got == {"a/x.py": (1, None), "a/y.py": (2, None), "b/c/d/z.go": (3, None), "b/gone.py": (1, None), "b/old.py": (1, None)}
    for options, files in (({"newer_than": 1.0}, {"a/x.py", "a/y.py", "b/c/d/z.go", "b/gone.py"}), ({"under": "a"}, {"a/x.py", "a/y.py"}),
                           ({"under": "b/", "newer_than": 1.0}, {"b/c/d/z.go", "b/gone.py"}), ({"under": "b/c"}, {"b/c/d/z.go"}), ({"under": "none"}, set())):
        assert {r.file for r in list_tree(spark, tmp_path, ["gen/**"], "r", **options).collect()} == files
    kept = stored(listing, "listing")
    (tmp_path / "b/gone.py").unlink()
    read = {r.file: r for r in read_files(kept, tmp_path).collect()}
    assert read["b/gone.py"].text is None and "gone.py" in read["b/gone.py"].error and not read["b/gone.py"].utf8_ok
    assert read["a/y.py"].text == "22" and read["a/y.py"].error is None and len(read) == 5
    reader = TreeReader({"path": str(tmp_path), "ignore": "", "shares": "3"})
    (tmp_path / "b/c").rename(tmp_path / "b/moved")
    rows = [r for share in [*reader.partitions(), _Share([("b/c", True)])] for r in reader.read(share)]
    assert {r[0] for r in rows if r[3]} == {"b/c"} and len(rows) == 6  # five files, one folder that is gone


def test_config_defaults():
    config = Config.from_mapping({"thresholds": {"max_file_lines": 9}, "ignore": ["x"], "detectors": None})
    assert config.thresholds == Thresholds(max_file_lines=9) and config.ignore[-1] == "x"
    assert Config.from_mapping({"thresholds": None}).thresholds == Thresholds()


def test_incremental_refresh(spark, make_files):
    old = make_files({"same.py": "import a\n", "changed.py": "import b\n", "gone.py": "import c\n"})
    cache = stored(symbols(old, ["python"]), "cache")
    new = (make_files({"same.py": "import never_parsed\n", "changed.py": "import d\n", "new.py": "import e\n"})
           .withColumn("mtime", F.when(F.col("file") == "changed.py", 1.0).otherwise(0.0)))
    listing, table = incremental.refresh(new, old.select("repo_id", "file", "mtime"), cache)
    assert {(r.file, r.name) for r in table.collect()} == {("same.py", "a"), ("changed.py", "d"), ("new.py", "e")}
    assert listing.count() == 3


def findings(spark, make_files, n=4):
    files = make_files({f"f{i}.py": "x\n" * 9 for i in range(n)})
    return stored(with_seq(with_hash(large_files(files, Thresholds(max_file_lines=5)))), "found")


def test_triage(spark, make_files):
    found = findings(spark, make_files)
    h = [r.hash for r in found.orderBy("seq").collect()]
    assert [r.seq for r in found.orderBy("seq").collect()] == [1, 2, 3, 4]
    done = spark.createDataFrame([(h[0], "resolved"), (h[0], "skipped"), (h[2], "skipped")], triage.DECISIONS)
    nxt = lambda cursor: [(r.hash, r.remaining) for r in triage.next_finding(found, done, cursor).collect()]
    assert nxt(None) == [(h[1], 2)]
    assert nxt(h[1]) == [(h[3], 1)]
    assert nxt(h[0]) == [(h[1], 2)]   # a decided cursor starts over
    assert nxt(h[3]) == []            # nothing after the last one
    assert triage.status_matrix(found, done).first().asDict() == {
        "detector": "size", "pending": 2, "resolved": 1, "skipped": 1, "total": 4}
    assert triage.totals(found, done).first().asDict() == {"total": 4, "resolved": 1, "skipped": 2, "pending": 1}


def test_store(spark, make_files, tmp_path):
    store = Store(spark, tmp_path)
    assert store.next() is None and store.findings().count() == 0
    store.save_findings(findings(spark, make_files, 2))
    first = store.next()
    store.decide(first["hash"], "resolved")
    assert store.cursor() == first["hash"]
    second = store.next(cursor=store.cursor())
    assert second["hash"] != first["hash"] and second["remaining"] == 1
    assert ensure_gitignore(tmp_path) and not ensure_gitignore(tmp_path)


def test_store_of_several_writers(spark, make_files, tmp_path):
    """Two writers at a URI lose no decision; a save that did not end is not seen."""
    uri = f"file://{tmp_path}"
    one, two = Store(spark, uri), Store(spark, uri)
    found = one.save_findings(findings(spark, make_files, 3))
    hashes = [r.hash for r in found.orderBy("seq").collect()]
    one.decide(hashes[0], "resolved")
    two.decide(hashes[1], "skipped")
    assert {(r.hash, r.status) for r in one.decisions().collect()} == {(hashes[0], "resolved"), (hashes[1], "skipped")}
    assert one.next()["hash"] == hashes[2] and two.cursor() == hashes[2]
    found.limit(1).withColumn("version", F.lit("9")).write.mode("append").partitionBy("version").parquet(f"{one.root}/report")
    assert two.findings().count() == 3
    two.save_findings(found.limit(2))
    assert one.findings().count() == 2


def test_commands(spark, tmp_path, capsys):
    """init, scan, next, resolve, skip, list, stats and fix on a small project."""
    write(tmp_path, {"a.py": "import os\nimport re\nx = 1\n", "b.py": "def _gone():\n    return 1\n"})
    at = str(tmp_path)

    def run(*args):
        code = main(list(args))
        return code, capsys.readouterr().out

    assert run() [1].startswith("usage") and run("init", at)[1].startswith("Created") and run("init", at)[1].startswith("Config already")
    assert run("resolve", "--state", at) == (1, "No current finding. Run `codevitals next` first.\n")
    out = run("scan", at, "--state", at)[1]
    assert "2  unused imports" in out and "1  dead code" in out and "3 findings" in out
    assert (tmp_path / ".gitignore").read_text().strip()
    out = run("next", "--state", at)[1]
    assert "'os' is imported but never used" in out and "a.py:1" in out and "    import os" in out and "3 remaining" in out
    out = run("resolve", "--state", at)[1]
    assert out.startswith("Resolved") and "'re' is imported" in out
    assert "'_gone'" in run("skip", "--state", at)[1]
    assert len(run("list", "--state", at)[1].splitlines()) == 3 and len(run("list", "--pending", "--state", at)[1].splitlines()) == 1
    assert run("list", "--detector", "size", "--state", at)[1] == "No findings match your filters.\n"
    assert [line.split() for line in run("stats", "--state", at)[1].splitlines()[1:]] == [["dead_code", "1", "0", "0", "1"], ["unused_imports", "0", "1", "1", "2"]]
    assert "Would fix 2 unused imports across 1 files." in run("fix", at, "--dry-run")[1] and "import os" in (tmp_path / "a.py").read_text()
    assert "Fixed 2" in run("fix", at)[1] and (tmp_path / "a.py").read_text() == "x = 1\n"


def test_fix(spark, make_files):
    text = "import re\nfrom a import b\nfrom a import c, d\nimport { e }\nx = 1\n"
    files = make_files({"a.py": text.replace("import { e }\n", ""), "k.c": "#include <q.h>\n"})
    table = stored(symbols(files, ["python", "cpp"]), "symbols")
    out = fix.rewritten(files, with_hash(unused_imports(table)), table).collect()
    assert [(r.file, r.text, r.removed) for r in out] == [("a.py", "from a import c, d\nx = 1\n", 2)]
    lines = {"import os": False, "import os, sys": True, "from a import b as c": False, "from a import b, c": True,
             "from a import b # x, y": False, "import { a, b } from 'x'": True, "import { a } from 'x'": False,
             "import A, { b } from 'x'": True, "import a // b, c": False, "use a, b;": False}
    df = spark.createDataFrame([(t,) for t in lines], "t string")
    assert [r[0] for r in df.select(fix.names_several(F.col("t"))).collect()] == list(lines.values())


def test_fix_keeps_lines_that_hold_more(make_files):
    """Groups of names, code after a semicolon, and statements that go on in the next line."""
    texts = {
        "g.rs": "use a::{bee, cee};\nuse d::eee;\nfn main() {\n  cee();\n}\n", "s.py": "import zed; setup()\nimport gone\n",
        "o.py": "from x import (\n    why,\n)\nimport gone\n", "m.js": "import {\n  aaa\n} from 'x';\nimport gone from 'y';\n",
        "r.js": "const { one, two } = require('x');\nimport gone from 'y';\ntwo();\n", "e.ex": "alias A.{Bee, Cee}\nalias D.Eee\nCee.run()\n"}
    files = make_files(texts)
    table = stored(symbols(files), "symbols")
    out = {r.file: r.text for r in fix.rewritten(files, with_hash(unused_imports(table)), table).collect()}
    for name in texts:
        kept = out.get(name, texts[name])
        first = texts[name].split("\n")[0]
        assert kept.startswith(first), (name, kept)
    assert "gone" not in out["s.py"] and "gone" not in out["o.py"] and "setup()" in out["s.py"]


def test_changed_paths(tmp_path):
    def git(*args):
        subprocess.run(["git", "-c", "user.email=a@b", "-c", "user.name=n", *args], cwd=tmp_path, check=True,
                       capture_output=True)
    git("init", "-q", "-b", "main")
    write(tmp_path, {"sub/a.py": "1", "b.py": "1"})
    assert sorted(changed_paths(str(tmp_path))) == ["b.py", "sub/"]
    git("add", "-A")
    git("commit", "-qm", "x")
    assert changed_paths(str(tmp_path)) == []
    write(tmp_path, {"sub/a.py": "2"})
    assert changed_paths(str(tmp_path)) == ["sub/a.py"]
    assert changed_paths(str(tmp_path / "sub")) == ["a.py"]


def test_stream(spark, make_files, tmp_path):
    seen = {}

    def note(files, table, batch_id):
        seen[batch_id] = {(r.file, r.name) for r in table.collect()}

    inbox = str(tmp_path / "in")
    make_files({"a.py": "import x\n", "b.py": "import y\n"}).write.parquet(inbox)
    run = merge_batch(str(tmp_path / "store"), ["python"], note)
    query = lambda: (read_file_stream(spark, inbox).writeStream.foreachBatch(run)
                     .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
                     .awaitTermination())
    query()
    make_files({"a.py": "import z\n"}).withColumn("mtime", F.lit(1.0)).write.mode("append").parquet(inbox)
    query()
    make_files({"a.py": "import late\n"}).withColumn("mtime", F.lit(0.5)).write.mode("append").parquet(inbox)
    query()
    newest = {("a.py", "z"), ("b.py", "y")}
    assert seen == {0: {("a.py", "x"), ("b.py", "y")}, 1: newest, 2: newest}


def test_stream_batches_rewrite_their_parts_only(spark, make_files, tmp_path):
    """What a batch writes follows the batch; a replay changes nothing; an emptied file leaves no symbols."""
    seen = {}
    run = merge_batch(str(tmp_path), ["python"], lambda files, table, n: seen.update({n: sorted((r.file, r.name) for r in table.collect())}), parts=64)
    run(make_files({f"f{i}.py": f"import m{i}\n" for i in range(40)}), 0)
    written = lambda: {p.relative_to(tmp_path): p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    before = written()
    edit = make_files({"f7.py": "import other\n", "f9.py": "\n"}).withColumn("mtime", F.lit(1.0))
    run(edit, 1)
    changed = set(written()) - set(before)
    assert 0 < len({p.parent for p in changed}) <= 4  # two parts of two tables
    assert seen[1] == sorted([(f"f{i}.py", f"m{i}") for i in range(40) if i not in (7, 9)] + [("f7.py", "other")])
    run(edit, 1)
    assert seen[1] == sorted([(f"f{i}.py", f"m{i}") for i in range(40) if i not in (7, 9)] + [("f7.py", "other")])
    assert len({p.parent for p in written()}) == len({p.parent for p in before})
