"""The registered queries: every one reads whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codevitals import triage
from codevitals.config import DEFAULT_IGNORE, Config, Thresholds
from codevitals.findings import (
    apply_allowlist, by_detector, from_json, to_json, with_hash, with_seq,
)
from codevitals.functions import names
from codevitals.functions.text import raw_lines, split_lines
from codevitals.operators.cycles import all_cycles, import_cycles
from codevitals.operators.dead_code import candidates, dead_code
from codevitals.operators.duplication import duplicate_members
from codevitals.operators.import_graph import import_edges
from codevitals.operators.secrets import secret_lines, secrets
from codevitals.operators.size import god_classes, large_files, large_functions
from codevitals.operators.unused_imports import unused_imports
from codevitals.parsing.symbols import language, symbols
from codevitals.plans import fix, incremental
from codevitals.plans.rescan import first_scan, rescan
from codevitals.plans.scan import detect, parse, review
from codevitals.session import stored
from codevitals.sources import filters, from_documents

from .render import documents, mixed_files, template_files
from .templates import TEMPLATES
from .trees import python_tree, ring_tree, typescript_tree

QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _doc_path():
    return F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))


def text_files(spark, sf_dir) -> DataFrame:
    """Documents as plain files."""
    return from_documents(documents(spark, sf_dir), _doc_path(), F.col("text"))


def _doc_id(path="file"):
    return F.regexp_extract(path, r"(\d+)\.\w+$", 1).cast("bigint").alias("doc_id")


# ------------------------------------------------------------ parsers, one per language

def _parser_query(lang):
    def run(spark, sf_dir):
        rows = symbols(template_files(documents(spark, sf_dir), lang), [lang])
        return rows.select(_doc_id(), "kind", "name", "line", "end_line", "n", "source", "alias", "tag")
    return run


for _lang in TEMPLATES:
    QUERIES[f"parser_{_lang}"] = _parser_query(_lang)


@query
def symbol_profile(spark, sf_dir):
    """All twenty languages in one plan: document i is a file of language i mod 20."""
    files = mixed_files(documents(spark, sf_dir))
    return symbols(files).groupBy("lang", "kind").agg(F.count("*").alias("symbols"))


# ------------------------------------------------------------------------- documents

@query
def large_file(spark, sf_dir):
    found = with_hash(large_files(text_files(spark, sf_dir), Thresholds(max_file_lines=20)))
    return found.select("file", "line", "message", "hash")


@query
def raw_lines_profile(spark, sf_dir):
    docs = documents(spark, sf_dir)
    n = raw_lines(F.col("text"))
    return docs.groupBy("source", "lang").agg(
        F.count("*").alias("files"), F.sum(n).alias("lines"), F.max(n).alias("longest"))


def _document_bodies(spark, sf_dir):
    """Documents as functions that span their whole text."""
    files = text_files(spark, sf_dir)
    spans = files.select(
        "repo_id", "file", F.lit("function").alias("kind"), F.lit("body").alias("name"),
        F.lit(1).alias("line"), F.size(split_lines(F.col("text"))).alias("end_line"),
        F.lit(0).alias("ord"), F.lit("").alias("snippet"))
    return stored(duplicate_members(files, spans, min_copies=3), "members")


@query
def duplicate_bodies(spark, sf_dir):
    return _document_bodies(spark, sf_dir).select(_doc_id(), "copies")


@query
def duplicate_others(spark, sf_dir):
    """Each member's group, by its first member: what a reader looks the others up with."""
    members = _document_bodies(spark, sf_dir).withColumn("doc_id", _doc_id())
    first = members.groupBy("group_id").agg(F.min("doc_id").alias("first_doc"))
    return members.join(first, "group_id").select("doc_id", "copies", "first_doc")


@query
def secret_documents(spark, sf_dir):
    return secret_lines(text_files(spark, sf_dir)).select(_doc_id(), "line", "category", "secret")


@query
def secret_findings(spark, sf_dir):
    return with_hash(secrets(text_files(spark, sf_dir))).select("file", "line", "category", "message", "hash")


def _with_keys(text):
    """A text and a line with two keys and a password made from all of it."""
    key = F.md5(text)
    return F.concat(F.col(text), F.lit("\ntoken = \""), key, F.lit("\"; token: \""), F.md5(key),
                    F.lit("\" PASSWORD=\"pw"), F.length(text).cast("string"), F.lit("!secret\""))


@query
def secret_pages(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages")
    files = from_documents(pages, F.concat(F.col("page_id").cast("string"), F.lit(".html")), _with_keys("html"))
    return secret_lines(files).select(
        F.regexp_extract("file", r"^(\d+)", 1).cast("bigint").alias("page_id"), "line", "category", "secret")


@query
def secret_conversations(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations")
    path = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return secret_lines(from_documents(turns, path, _with_keys("text"))).select("file", "line", "category", "secret")


# ----------------------------------------------------------------------------- paths

def _paths(spark, sf_dir):
    """A made-up but deterministic path per document, covering every rule."""
    i = F.col("doc_id")
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (i % len(xs) + 1).cast("int"))
    folder = pick("src", "node_modules", "build", "pkg/dist", ".hidden", "lib/env", "app")
    name = pick("main.py", "app.min.js", "types.d.ts", "__init__.py", "util.go", "Makefile", ".dot.py",
                "a.b.rs", "page.tsx", "README.md", "x.min.css")
    return documents(spark, sf_dir).select("doc_id", F.concat(
        folder, F.lit("/d"), (i % 5).cast("string"), F.lit("/"), i.cast("string"), F.lit("_"), name).alias("path"))


@query
def extension_filter(spark, sf_dir):
    return _paths(spark, sf_dir).filter(filters.supported(F.col("path")))


@query
def skip_suffix(spark, sf_dir):
    return _paths(spark, sf_dir).filter(~filters.skipped_ending(F.col("path")))


@query
def ignore_filter(spark, sf_dir):
    ignore = DEFAULT_IGNORE + ["src/d1/**", "*/d2/*_util.go", "app/d[34]"]
    return _paths(spark, sf_dir).filter(~filters.is_ignored(F.col("path"), ignore))


@query
def pruned_directories(spark, sf_dir):
    return _paths(spark, sf_dir).filter(~filters.in_pruned_directory(F.col("path"), DEFAULT_IGNORE))


@query
def source_files(spark, sf_dir):
    return _paths(spark, sf_dir).filter(filters.is_source_file(F.col("path"), DEFAULT_IGNORE))


@query
def parser_dispatch(spark, sf_dir):
    lang = language(filters.suffix(F.col("path")))
    return (_paths(spark, sf_dir).groupBy(lang.alias("language")).agg(F.count("*").alias("files"))
            .filter("language IS NOT NULL"))


@query
def path_order(spark, sf_dir):
    """Each path with its predecessor inside its top directory, in part-by-part order."""
    from pyspark.sql import Window
    top = F.substring_index("path", "/", 2)
    w = Window.partitionBy(top).orderBy(filters.path_order(F.col("path")))
    return _paths(spark, sf_dir).select("path", F.lag("path").over(w).alias("previous"))


# ----------------------------------------------------------------------------- names

def _words(spark, sf_dir):
    """Distinct ASCII words of all documents, as identifiers."""
    words = F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)))
    return documents(spark, sf_dir).select(words.alias("w")).distinct()


@query
def name_prefixes(spark, sf_dir):
    dotted = F.concat(F.lit("self."), "w", F.lit("."), F.reverse("w"))
    return _words(spark, sf_dir).select(
        dotted.alias("name"), F.explode(names.call_references(dotted)).alias("reference"))


@query
def name_case(spark, sf_dir):
    w = F.col("w")
    words = _words(spark, sf_dir).select(F.explode(F.array(
        w, F.upper(w), F.concat(F.upper(w), F.lit("_2")), F.concat(F.lit("_"), w),
        F.concat(F.upper(w), F.lit("_X")))).alias("name")).distinct()
    return words.select("name", names.is_pascal_case(F.col("name")).alias("pascal"),
                        names.is_all_caps(F.col("name")).alias("caps"))


# ------------------------------------------------------------------------- detectors

def _python(spark, sf_dir):
    return python_tree(documents(spark, sf_dir))


def _typescript(spark, sf_dir):
    return typescript_tree(documents(spark, sf_dir))


def _finding_columns(df):
    return df.select("file", "category", "message", "line")


@query
def unused_import_python(spark, sf_dir):
    return _finding_columns(unused_imports(symbols(_python(spark, sf_dir), ["python"])))


@query
def unused_import_typescript(spark, sf_dir):
    return _finding_columns(unused_imports(symbols(_typescript(spark, sf_dir), ["javascript"])))


@query
def import_text_fallback(spark, sf_dir):
    """Imports that only the text search keeps."""
    rows = symbols(_python(spark, sf_dir), ["python"], ["import"])
    return rows.select("file", "name", "line", "in_text")


def _dead(files, lang, category):
    table = stored(symbols(files, [lang]), "symbols", partition_by=["kind"])
    return _finding_columns(dead_code(table).filter(F.col("category") == category))


@query
def unused_function(spark, sf_dir):
    return _dead(_python(spark, sf_dir), "python", "unused_function")


@query
def unused_class(spark, sf_dir):
    return _dead(_python(spark, sf_dir), "python", "unused_class")


@query
def unused_export(spark, sf_dir):
    return _dead(_typescript(spark, sf_dir), "javascript", "unused_export")


@query
def unused_variable(spark, sf_dir):
    return _dead(_typescript(spark, sf_dir), "javascript", "unused_variable")


@query
def unused_function_typescript(spark, sf_dir):
    return _dead(_typescript(spark, sf_dir), "javascript", "unused_function")


@query
def decorated_exempt(spark, sf_dir):
    rows = symbols(_python(spark, sf_dir), ["python"], ["function"])
    return rows.filter("decorated").select("file", "name", "line")


@query
def large_function(spark, sf_dir):
    rows = symbols(_python(spark, sf_dir), ["python"], ["function"])
    return _finding_columns(large_functions(rows, Thresholds()))


@query
def god_class(spark, sf_dir):
    rows = symbols(_python(spark, sf_dir), ["python"], ["class"])
    return _finding_columns(god_classes(rows, Thresholds()))


@query
def duplicated_function(spark, sf_dir):
    files = stored(_python(spark, sf_dir), "files")
    table = stored(symbols(files, ["python"], ["function"]), "symbols")
    return duplicate_members(files, table, 3).select("file", "name", "line", "copies")


def _edges(spark, sf_dir):
    files = _typescript(spark, sf_dir)
    return stored(import_edges(files, symbols(files, ["javascript"], ["import"])), "edges")


@query
def import_edges_typescript(spark, sf_dir):
    return _edges(spark, sf_dir).select("src", "dst")


@query
def import_cycle(spark, sf_dir):
    return all_cycles(_edges(spark, sf_dir)).select(F.array_join("cycle", " -> ").alias("cycle"))


@query
def import_cycle_components(spark, sf_dir):
    """Cycles as the findings report them."""
    found = import_cycles(_edges(spark, sf_dir))
    cycle = F.concat(F.array("file"), F.col("related"))
    return found.select(F.array_join(cycle, " -> ").alias("cycle"))


@query
def import_cycle_shapes(spark, sf_dir):
    """Cycles of three files, nested and entered ones, and components that lead to each other."""
    files = ring_tree(documents(spark, sf_dir))
    edges = stored(import_edges(files, symbols(files, ["javascript"], ["import"])), "edges")
    return all_cycles(edges).select(F.array_join("cycle", " -> ").alias("cycle"))


# ----------------------------------------------------------- whole scans and commands

def _scan(spark, sf_dir):
    """All detectors over the Python tree."""
    files = stored(_python(spark, sf_dir), "files")
    return stored(detect(files, parse(files, ["python"]), Config()), "findings")


@query
def scan_by_detector(spark, sf_dir):
    return by_detector(_scan(spark, sf_dir))


@query
def union_findings(spark, sf_dir):
    return _scan(spark, sf_dir).select(
        "detector", "category", "file", "line", "hash")


@query
def rescan_findings(spark, sf_dir):
    """A tree is scanned, then files change, come and go: the findings of the re-scan."""
    now = stored(_python(spark, sf_dir), "files")
    i = _doc_id()
    was = now.filter(i % 5 != 1).withColumn("text", F.when(i % 3 == 0, F.replace(
        F.replace("text", F.lit("_helper"), F.lit("_older")), F.lit("class God"), F.lit("class Small"))).otherwise(F.col("text")))
    gone = now.filter(i % 4 == 2).withColumn("file", F.replace("file", F.lit("src/"), F.lit("old/")))
    state = first_scan(stored(was.unionByName(gone), "files"), langs=["python"])
    changed = stored(now.filter((i % 5 == 1) | (i % 3 == 0)), "changed")
    state = rescan(state, changed, gone.select("repo_id", "file"), langs=["python"])
    return with_hash(state.findings).select("detector", "category", "file", "line", "hash")


@query
def allowlist(spark, sf_dir):
    found = _scan(spark, sf_dir)
    listed = {"dead_code": ["src/m1/*"], "size": ["src/m2/*", "*/f7.py"]}
    return by_detector(apply_allowlist(found, listed))


def _large(spark, sf_dir):
    """Document-size findings, the input of the triage queries."""
    limits = Thresholds(max_file_lines=5)
    return with_hash(large_files(text_files(spark, sf_dir), limits))


def _decisions(found):
    """Decisions derived from the findings: by the first digit of their hash."""
    digit = F.substring("hash", 1, 1)
    resolved = found.filter(digit.isin("0", "1", "2")).select("hash", F.lit("resolved").alias("status"))
    skipped = found.filter(digit.isin("2", "3", "4")).select("hash", F.lit("skipped").alias("status"))
    return resolved.unionByName(skipped)


@query
def pending(spark, sf_dir):
    found = _large(spark, sf_dir)
    return triage.pending(found, _decisions(found)).select("hash", "file")


@query
def list_findings(spark, sf_dir):
    found = _large(spark, sf_dir)
    return triage.list_findings(found, _decisions(found), detector="size").select(
        "hash", "status", "file", "line", "message")


@query
def status_matrix(spark, sf_dir):
    found = _large(spark, sf_dir)
    return triage.status_matrix(found, _decisions(found))


@query
def status_totals(spark, sf_dir):
    found = _large(spark, sf_dir)
    return triage.totals(found, _decisions(found))


@query
def report_sequence(spark, sf_dir):
    return with_seq(_large(spark, sf_dir)).select("seq", "file")


@query
def next_finding(spark, sf_dir):
    found = stored(with_seq(_large(spark, sf_dir)), "seq")
    cursor = found.agg(F.max("hash")).first()[0]
    return triage.next_finding(found, _decisions(found), cursor).select("seq", "hash", "file", "remaining")


@query
def findings_json(spark, sf_dir):
    """Findings through their JSON form and back."""
    return from_json(to_json(_large(spark, sf_dir))).select("hash", "detector", "category", "message", "file", "line")


@query
def review_changed(spark, sf_dir):
    """Findings of large files among labelled documents, the change set."""
    labels = _table(spark, sf_dir, "labels").select("doc_id")
    changed = documents(spark, sf_dir).join(labels, "doc_id", "left_semi").select(_doc_path().alias("file"))
    return review(_large(spark, sf_dir), changed).select("file", "hash")


def _versions(spark, sf_dir):
    """A listing (documents) and an older cache of it (labels: other times, gone and new files)."""
    docs = documents(spark, sf_dir)
    listing = docs.select(F.lit("r").alias("repo_id"), F.col("doc_id").cast("string").alias("file"),
                          F.col("n_chars").cast("double").alias("mtime"))
    labels = _table(spark, sf_dir, "labels").join(docs.select("doc_id", "n_chars"), "doc_id")
    cached = labels.select(
        F.lit("r").alias("repo_id"),
        F.when(F.col("toxic") == 1, F.concat(F.lit("gone"), "doc_id")).otherwise(F.col("doc_id").cast("string")).alias("file"),
        (F.col("n_chars") + F.col("quality")).cast("double").alias("mtime"))
    return listing, cached


@query
def incremental_hits(spark, sf_dir):
    return incremental.hits(*_versions(spark, sf_dir)).select("file", "mtime")


@query
def incremental_misses(spark, sf_dir):
    return incremental.misses(*_versions(spark, sf_dir)).select("file", "mtime")


@query
def incremental_stale(spark, sf_dir):
    return incremental.stale(*_versions(spark, sf_dir)).select("file", "mtime")


@query
def fix_preview(spark, sf_dir):
    table = stored(symbols(_typescript(spark, sf_dir), ["javascript"]), "symbols")
    return fix.fixable(with_hash(unused_imports(table)), table).select("file", "line", "several")


@query
def fix_rewrite(spark, sf_dir):
    files = stored(_python(spark, sf_dir), "files")
    table = stored(symbols(files, ["python"]), "symbols")
    out = fix.rewritten(files, with_hash(unused_imports(table)), table)
    return out.select("file", F.col("removed").cast("int").alias("removed"),
                      raw_lines(F.col("text")).alias("lines"))


@query
def definition_candidates(spark, sf_dir):
    """Definitions their own file gives no reason to keep, before looking at other files."""
    rows = candidates(symbols(_python(spark, sf_dir), ["python"],
                              ["function", "class", "variable", "export"]))
    return rows.select("file", "kind", "name")
