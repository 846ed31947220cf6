"""What a Python worker holds does not follow the size of its partition."""

import pyarrow as pa

from codevitals.parsing import pyast
from codevitals.parsing.symbols import symbols


def test_symbols_leave_in_bounded_batches(monkeypatch):
    monkeypatch.setattr(pyast, "OUT_ROWS", 10)
    texts = ["import a\nx = 1\ndef f(): g(h())\n"] * 50
    batch = pa.RecordBatch.from_pydict({
        "repo_id": ["r"] * 50, "file": [f"{i}.py" for i in range(50)], "text": texts, "utf8_ok": [True] * 50})
    out = list(pyast._parse_batches(iter([batch])))
    assert max(b.num_rows for b in out) <= 10
    assert sum(b.num_rows for b in out) == 50 * len(pyast.file_symbols(texts[0]))


def test_long_snippets_leave_early(monkeypatch):
    monkeypatch.setattr(pyast, "OUT_CHARS", 100)
    text = "import a  # " + "x" * 200
    batch = pa.RecordBatch.from_pydict({
        "repo_id": ["r"] * 3, "file": ["a.py", "b.py", "c.py"], "text": [text] * 3, "utf8_ok": [True] * 3})
    assert [b.num_rows for b in pyast._parse_batches(iter([batch]))] == [1, 1, 1]


def test_texts_arrive_in_bounded_batches(spark, make_files):
    files = make_files({f"{i}.py": f"x{i} = '{'y' * 1_000_000}'\n" for i in range(40)}).coalesce(1)
    symbols(files, ["python"])  # settles the size of batches

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    seen = [r.n for r in files.select("text").mapInArrow(sizes, "n long").collect()]
    assert sum(seen) == 40 and max(seen) <= 20
