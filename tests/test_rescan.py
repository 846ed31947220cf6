"""Re-scans of changed files against fresh scans."""

import json
import os
import random

from codevitals.cli import main
from codevitals.config import Config, Thresholds
from codevitals.plans.rescan import first_scan, rescan
from codevitals.plans.scan import scan
from codevitals.session import stored
from pyspark.sql import functions as F

LANGS = ["javascript", "python"]
CONFIG = Config(thresholds=Thresholds(max_file_lines=14, max_function_lines=6, max_class_methods=2, duplication_min_copies=2))


def module(rng, i, n):
    """A random file: imports of other files, calls, definitions, copies, secrets."""
    lines = []
    if i % 2:
        for j in rng.sample(range(n), 2):
            lines.append(f"from m{j} import _f{j}, k{rng.randrange(4)}")
        lines += [f"def _f{i}(a):", "    return a", f"def _g{rng.randrange(3)}(a):"] + [f"    a = a + {rng.randrange(2)}"] * rng.randint(1, 8) + ["    return a"]
        lines += ["class _K:", "    def m(self): pass", "    def n(self): pass"] * rng.randrange(2)
        lines.append(f"print(_f{rng.randrange(n)}(1), k{rng.randrange(4)})")
        lines += ['token = "abcdefgh12345678abcdefgh"'] * rng.randrange(2)
        return f"m{i}.py", "\n".join(lines) + "\n"
    for j in rng.sample(range(0, n, 2), 2):
        lines.append(f"import {{ e{j} }} from './t{j}';")
    lines += [f"export const e{i} = 1;", f"let v{rng.randrange(3)} = 2;", f"function p{rng.randrange(3)}(a) {{", "  return a;", "}"]
    lines.append(f"p{rng.randrange(3)}(e{rng.randrange(n)});")
    return f"t{i}.ts", "\n".join(lines) + "\n"


def rows(findings):
    return sorted(str([r[c] for c in sorted(r.asDict()) if c not in ("hash", "finding_id")]) for r in findings.collect())


def test_rescan_equals_fresh_scan(spark, make_files):
    rng, n, seen = random.Random(4), 14, set()
    tree = dict(module(rng, i, n) for i in range(n))
    state = first_scan(stored(make_files(tree), "files"), CONFIG, LANGS)
    assert rows(state.findings) == rows(scan(stored(make_files(tree), "files"), CONFIG, LANGS))
    for edit in range(2):
        changed = dict(module(rng, rng.randrange(n), n) for _ in range(3 if edit else 0))  # the first edit only takes files away
        gone = [f for f in rng.sample(sorted(tree), 2) if f not in changed]
        tree = {f: t for f, t in tree.items() if f not in gone} | changed
        frame = stored(make_files(changed).withColumn("mtime", F.lit(float(edit))), "changed")
        state = rescan(state, frame, spark.createDataFrame([("r", f) for f in gone], "repo_id string, file string"), CONFIG, LANGS)
        want = rows(scan(stored(make_files(tree), "files"), CONFIG, LANGS))
        assert rows(state.findings) == want
        seen |= {r.detector for r in state.findings.collect()}
        assert state.listing.count() == len(tree)
        assert state.usage.filter("calls < 0 OR importers < 0").count() == 0
    assert {"unused_imports", "dead_code", "size", "cycles"} <= seen


def test_scan_command_opens_changed_files_only(spark, tmp_path, capsys):
    """scan, edit, scan again: the report equals a fresh one, and only edited files are read."""
    project, state = tmp_path / "p", tmp_path / "s"
    project.mkdir()
    (project / "a.py").write_text("import os\nfrom b import _x\n_x()\n")
    (project / "b.py").write_text("def _x():\n    return 1\ndef _y():\n    return 2\n")

    def report(*flags):
        assert main(["scan", str(project), "--state", str(state), "--json", *flags]) == 0
        out, err = capsys.readouterr()
        return json.loads(out)["findings"], err

    state.mkdir()
    first, _ = report()
    assert [f["message"] for f in first] == ["'os' is imported but never used", "Function '_y' is defined but never called"]
    time = (project / "a.py").stat().st_mtime
    (project / "b.py").write_text("def _z():\n    return 2\n")
    (project / "a.py").write_text("import never_read\n")  # its time says that it is as before, so it isn't opened
    os.utime(project / "a.py", (time, time))
    again, _ = report()
    assert [f["message"] for f in again] == ["'os' is imported but never used", "Function '_z' is defined but never called"]
    (project / "gone").mkdir()
    fresh, err = report("--fresh")
    assert [f["message"] for f in fresh][0] == "'never_read' is imported but never used" and err.count("Not read") == 0
