"""Plans that must not shuffle texts or read more than they need."""

from codevitals.operators.dead_code import usage
from codevitals.operators.secrets import secret_lines
from codevitals.operators.unused_imports import unused_imports
from codevitals.parsing.symbols import symbols
from codevitals.session import stored
from codevitals.sources import write_bucketed


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_files_are_not_shuffled(spark, make_files, tmp_path):
    files = make_files({f"d{i}/f.go": "import \"a\"\nfunc f() {\n}\n" for i in range(40)})
    files = files.unionByName(make_files({"x.go": "import \"b\"\n"}, "other"))
    write_bucketed(files, "bucketed_files", 8, str(tmp_path / "t"))
    table = spark.table("bucketed_files")
    parsed = symbols(table, ["go"])
    assert "Exchange" not in plan(parsed)
    assert "Exchange" not in plan(unused_imports(parsed))
    assert parsed.filter("kind = 'function'").count() == 40


def test_stored_symbols_are_pruned(spark, make_files):
    table = stored(symbols(make_files({"a.py": "import os\nos.x()\n"}), ["python"]), "s", partition_by=["kind"])
    text = plan(usage(table))
    assert "PartitionFilters" in text and "kind" in text.split("PartitionFilters")[1][:80]
    scanned = text.split("ReadSchema: struct<")[1].split(">")[0]
    assert "snippet" not in scanned and "name:string" in scanned


def test_languages_go_through_their_own_windows(spark, make_files):
    files = make_files({"a.java": "class A {\n}\n", "b.nim": "proc f(a: int) =\n  discard\n", "c.rb": "def f\nend\n"})
    windows = lambda *langs: plan(symbols(files, list(langs))).count("Window [")
    assert windows("java") == 2  # counts that run ahead in one pass, ends of blocks
    assert windows("java", "nim", "ruby") == windows("java") + windows("nim") + windows("ruby")


def test_texts_are_turned_to_lower_case_once(spark, make_files):
    files = stored(make_files({"a.py": "token = \"0123456789abcdef0\"\n"}), "files")
    reads = plan(secret_lines(files)).split("Scan parquet")[0].split("Generate")[-1]
    assert reads.count("lower(text") == 1
    assert secret_lines(files).count() == 1
