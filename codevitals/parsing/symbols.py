"""The symbol table: one row per import, export, function, class, variable and call.

Files are exploded into lines, rules turn a line into events, and what depends on
other lines (where a block ends, whether a line is inside a function) is decided by
window functions over the events of one file. All windows share the partitioning
(repo_id, file), so the events are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import local_name
from ..functions.text import name_in_other_line, split_lines, strip
from ..schema import LANGUAGE_SUFFIXES, SYMBOLS
from ..session import small_parts
from . import lex, rules
from .events import Checked, either, joined, none
from .pyast import python_symbols

KINDS = ["import", "export", "function", "class", "variable", "call"]
FAR = 2_147_483_647
FILE = ["repo_id", "file"]

# languages that need a given decision
_BLOCKS = set(rules.RULES) - {"erlang", "nim"}
_STOPS = {"dart", "objc", "erlang", "javascript"}
_OWNERS = {"go", "rust", "cpp", "nim"}
_REGIONS = {"zig", "shell", "nim"}
# languages that are parsed in one plan: its rows go through all windows that any of them needs
_TOGETHER = [{"java", "php", "swift", "kotlin", "elixir", "scala", "solidity"}, {"go", "cpp", "rust"}, {"ruby", "lua"},
             {"zig", "shell", "nim"}, {"dart", "objc", "erlang"}, {"javascript"}]
_COUNT_INSIDE_ONLY = ["ruby", "php", "swift", "kotlin", "elixir", "zig"]


def language(suffix: Column) -> Column:
    out = None
    for lang, suffixes in LANGUAGE_SUFFIXES.items():
        test = suffix.isin(*suffixes)
        out = F.when(test, lang) if out is None else out.when(test, lang)
    return out


def _by_language(lang: Column, branches: dict[str, Column], default: Column, whole: bool) -> Column:
    """A CASE over the language; ``whole`` when all rows are of one language."""
    if whole and branches:
        return next(iter(branches.values()))
    out = None
    for name, column in branches.items():
        out = F.when(lang == name, column) if out is None else out.when(lang == name, column)
    return default if out is None else out.otherwise(default)


def line_events(files: DataFrame, langs: list[str], only_imports: bool = False) -> DataFrame:
    """One row per event of every line; with ``only_imports``, events that imports do not need may be missing."""
    made = rules.RULES | (rules.IMPORT_RULES if only_imports else {})
    lang, text, t, raw = F.col("lang"), F.col("text"), F.col("t"), F.col("raw")
    no_lines = F.array().cast("array<string>")

    def pick(branches):
        chosen = {k: v for k, v in branches.items() if k in langs}
        return _by_language(lang, chosen, no_lines, whole=len(langs) == 1)

    def rule_branches(line: rules.Line, checked: bool) -> Column:
        branches = {}
        for name in langs:
            arrays = [a for a in made[name](line) if isinstance(a, Checked) == checked]
            found = joined(*[a.column if checked else a for a in arrays])
            branches[name] = either(line.s == "", none(), found) if name in rules.NOTHING_IN_BLANK else found
        return _by_language(lang, branches, none(), whole=len(langs) == 1)

    def finished(e: Column, line: Column) -> Column:
        """A checked event with its line, the text search and its snippet."""
        name = either(e["kind"] == "import", local_name(e["name"], e["b"]), e["name"])
        looked_up = e["kind"].isin("import", "variable")
        length = either(e["kind"] == "import", F.lit(1), either(e["kind"] == "variable", F.lit(2), F.lit(4)))
        return F.struct(
            *[e[f].alias(f) for f in ("kind", "name", "a", "b", "own", "n", "pos")],
            line.cast("int").alias("at"),
            either(looked_up & F.col("utf8_ok"), name_in_other_line(raw, name, line), F.lit(None).cast("boolean")).alias("in_text"),
            F.lit(None).cast("boolean").alias("decorated"),
            F.when(F.col("utf8_ok"), F.array_join(F.slice(raw, line, length), "\n")).alias("snippet"),
        )

    def file_events() -> Column:
        zipped = F.arrays_zip("t", "s", "r", "d", "v")

        def on_line(z: Column, i: Column) -> Column:
            fields = [F.coalesce(z[f], F.lit("")) for f in ("t", "s", "r", "d", "v")]
            found = rule_branches(rules.Line(*fields, F.col("names")), checked=True)
            return F.transform(found, lambda e: finished(e, i + 1))

        return F.flatten(F.transform(zipped, on_line))

    clean = {name: lex.clean_lines(name, text) for name in langs}
    arrays = (
        files.filter(lang.isin(*langs)).where(text.isNotNull())
        .select("repo_id", "file", "lang", "text", "utf8_ok", pick(clean).alias("t"),
                split_lines(text).alias("raw"),
                split_lines(lex.mark_decorated(text)).alias("m"))
        .select(
            "repo_id", "file", "lang", "utf8_ok", "t", "raw", "m", F.transform(t, strip).alias("s"),
            pick({"java": raw, "cpp": raw, "nim": F.transform(t, lex.nim_line), "solidity": F.split(text, "\n", -1)}).alias("r"),
            pick({"go": split_lines(rules.go_marked(text)),
                  "nim": split_lines(rules.nim_marked(lex.nim_blocks(text))),
                  "solidity": F.split(lex.fold(lex.solidity(text), rules.SOL_FOLD_DECL), "\n", -1),
                  "javascript": F.split(lex.fold(F.array_join(t, "\n"), lex.JS_STATEMENTS), "\n", -1)}).alias("d"),
            pick({"solidity": F.split(lex.fold(lex.solidity(text), rules.SOL_FOLD_VAR), "\n", -1)}).alias("v"),
            pick({"shell": rules.shell_functions(t), "lua": rules.lua_module(t),
                  "nim": rules.nim_decl_indents(t)}).alias("names"),
        )
        .withColumns({} if "javascript" not in langs else {
            "r": F.when(lang == "javascript", F.transform("d", rules.javascript_flat)).otherwise(F.col("r")),
            "v": F.when(lang == "javascript", F.transform("d", strip)).otherwise(F.col("v"))})
        # events of whole files travel with the first line
        .withColumn("whole", F.array(file_events()))
        .withColumns({f"raw{k}": F.slice(raw, k + 1, F.greatest(F.size(raw) - k, F.lit(0))) for k in (1, 2, 3)})
    )
    lines = arrays.select(
        "repo_id", "file", "lang", "utf8_ok", "names", F.size("t").alias("n_lines"),
        F.posexplode(F.arrays_zip("t", "s", "r", "d", "v", "whole", "m", "raw", "raw1", "raw2", "raw3")).alias("i", "l"),
    ).select(
        "repo_id", "file", "lang", "names", "n_lines", (F.col("i") + 1).alias("line"), "l.whole",
        *[F.coalesce(f"l.{f}", F.lit("")).alias(f) for f in ("t", "s", "r", "d", "v")],
        (F.startswith(F.coalesce("l.m", F.lit("")), F.lit(lex.DECORATED)) & F.col("utf8_ok")).alias("decorated"),
        F.when(F.col("utf8_ok"), F.concat_ws("\n", "l.raw", "l.raw1", "l.raw2", "l.raw3")).alias("snippet"),
    )
    here = rules.Line(*[F.col(c) for c in ("t", "s", "r", "d", "v", "names")])

    def on_line(e: Column) -> Column:
        shown = e["kind"].isin("function", "class", "export")
        return F.struct(
            *[e[f].alias(f) for f in ("kind", "name", "a", "b", "own", "n", "pos")],
            F.col("line").alias("at"), F.lit(None).cast("boolean").alias("in_text"),
            F.when(e["kind"] == "function", F.col("decorated")).alias("decorated"),
            F.when(shown, F.col("snippet")).alias("snippet"),
        )

    events = F.transform(rule_branches(here, checked=False), on_line)
    return lines.select(
        "repo_id", "file", "lang", "n_lines",
        F.posexplode(F.when(F.col("whole").isNull(), events).otherwise(F.concat("whole", events))).alias("idx", "e"),
    ).select("repo_id", "file", "lang", "n_lines", "idx", "e.*").withColumnRenamed("at", "line")


def _is(kind: str) -> Column:
    return F.col("kind") == kind


def _running(*order: Column):
    return Window.partitionBy(*FILE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def resolve(events: DataFrame, langs: list[str]) -> DataFrame:
    """Events -> symbol rows."""
    here = set(langs)
    forward = [F.asc("line"), F.asc("pos"), F.asc("idx")]
    backward = [F.desc("line"), F.desc("pos"), F.desc("idx")]
    ahead, behind = _running(*forward), _running(*backward)
    lang, line, kind, own = F.col("lang"), F.col("line"), F.col("kind"), F.col("own")
    df = events

    # 1. nesting depth and running counts; what needs nothing of another window is taken in one pass
    bracket = F.when(_is("{"), 1).when(_is("}"), -1).otherwise(0)
    counted = _is("method") | (lang.isin("java", "cpp") & _is("function"))
    running = {"depth": F.sum(bracket).over(ahead).cast("int")}
    last_nonblank = F.last(F.when(_is("nonblank"), line), True).over(ahead)
    running["last_nonblank"] = last_nonblank if "nim" in here else F.lit(None).cast("int")
    if "javascript" in here:
        running["row_sum"] = F.sum(F.when(_is("row"), F.col("n")).otherwise(0)).over(ahead)
        counted |= (lang == "javascript") & _is("function") & (own == "member") & (F.col("depth") == 1)
    methods = {"methods": F.sum(F.when(counted, 1).otherwise(0)).over(ahead).cast("int")}
    nested = [name for name, users in (("depth2", {"ruby", "lua"}), ("depth3", {"ruby"})) if here & users]
    for name in nested:
        running[f"{name}_sum"] = F.sum(F.when(_is(name), F.col("n")).otherwise(0)).over(ahead)
    if "javascript" not in here:
        running |= methods
    df = df.withColumns(running)
    if "javascript" in here:
        df = df.withColumns(methods)
    df = df.withColumns({
        name: F.col(f"{name}_sum") - F.least(F.lit(0), F.min(f"{name}_sum").over(ahead)) if name in nested else F.lit(0)
        for name in ("depth2", "depth3")})
    if "ruby" in here:
        state = (F.when(F.col("a") == "private", 1)
                 .when((F.col("a") == "end") & (F.col("depth2") <= 0), None).otherwise(0))
        df = df.withColumn("private", F.coalesce(
            F.last(F.when(_is("mark"), state), True).over(ahead), F.lit(0)))
    else:
        df = df.withColumn("private", F.lit(0))

    # 2. where things end
    at = F.struct(line.alias("line"), F.col("methods").alias("methods"),
                  F.col("last_nonblank").alias("body"))
    if here & _BLOCKS:
        df = df.withColumn("level", F.when(_is("{"), F.col("depth")).otherwise(F.col("depth") + 1))
        per_level = (Window.partitionBy(*FILE, "level").orderBy(*backward)
                     .rowsBetween(Window.unboundedPreceding, 0))
        df = df.withColumn("close", F.last(F.when(_is("}"), at), True).over(per_level))
    else:
        df = df.withColumn("close", F.lit(None).cast("struct<line:int,methods:int,body:int>"))
    if here & _STOPS:
        df = df.withColumn("stop", F.last(F.when(_is("stop"), at), True).over(behind))
    else:
        df = df.withColumn("stop", F.lit(None).cast("struct<line:int,methods:int,body:int>"))
    if here & {"objc", "zig"}:
        df = df.withColumn("next_open", F.last(F.when(_is("{"), line), True).over(behind))
    else:
        df = df.withColumn("next_open", F.lit(None).cast("int"))
    if "nim" in here:
        per_indent = (Window.partitionBy(*FILE, "b").orderBy(*backward)
                      .rowsBetween(Window.unboundedPreceding, 0))
        df = df.withColumn("dedent", F.last(F.when(_is("dedent"), at), True).over(per_indent))
        df = df.withColumn("last_body", F.first("last_nonblank", True).over(behind))
    else:
        df = df.withColumn("dedent", F.lit(None).cast("struct<line:int,methods:int,body:int>"))
        df = df.withColumn("last_body", F.lit(None).cast("int"))

    a = F.col("a")
    close, stop = F.col("close.line"), F.col("stop.line")
    indented = F.greatest(line, F.when(F.col("dedent").isNotNull(), F.col("dedent.body"))
                          .otherwise(F.col("last_body")))
    end = (
        F.when(a == "block", F.coalesce(close, line))
        .when(a == "block or eof", F.coalesce(close, F.col("n_lines")))
        .when(a == "near block", F.when(F.col("next_open") <= line + 2, F.coalesce(close, line)).otherwise(line))
        .when(a == "stop", F.coalesce(stop, line))
        .when(a == "indent", indented)
        .otherwise(line)
    )
    df = df.withColumn("end_line", F.when(kind.isin("function", "class"), end).cast("int"))

    # 3. inside what
    if here & _REGIONS:
        region_end = F.when(_is("region"), (
            F.when((lang == "nim"), indented)
            .when(lang == "shell", F.coalesce(close, line))
            .when(a == "line", line)
            .when((a == "next") & (F.coalesce(F.col("next_open"), F.lit(FAR)) != line + 1), line + 1)
            .otherwise(F.coalesce(close, F.lit(FAR)))))
        df = df.withColumn("in_function", F.coalesce(F.max(region_end).over(ahead), F.lit(0)) >= line)
    else:
        df = df.withColumn("in_function", F.lit(False))
    if "rust" in here:
        impl = F.last(F.when(_is("impl"), F.struct(
            line.alias("line"), F.col("name").alias("name"),
            F.coalesce(close, F.lit(FAR)).alias("end"))), True).over(ahead)
        df = df.withColumn("impl", impl)
        inside = (lang == "rust") & _is("function") & (F.col("impl.line") < line) & (line < F.col("impl.end"))
        df = df.withColumn("bare", F.when(_is("impl"), None).otherwise(F.col("name")))
        df = df.withColumn("own", F.when((lang == "rust") & inside, F.col("impl.name"))
                           .when((lang == "rust") & _is("class"), F.col("name")).otherwise(own))
        df = df.withColumn("name", F.when(inside, F.concat("impl.name", F.lit("."), "name")).otherwise(F.col("name")))
    else:
        df = df.withColumn("bare", F.col("name"))
    if "javascript" in here:
        class_end = F.max(F.when((lang == "javascript") & _is("class") & (F.col("depth") == 0),
                                 F.coalesce(close, line))).over(ahead)
        df = df.withColumn("in_class", (F.col("depth") == 1) & (F.coalesce(class_end, F.lit(0)) >= line))
        # where a chain of calls starts: the last line at its bracket depth that begins with something else
        is_row, n = _is("row"), F.col("n")
        depth_here = F.col("row_sum") - F.when(is_row, n).otherwise(0)
        df = df.withColumn("chain_depth", depth_here - F.when(own == "chain", n).otherwise(0))
        per_depth = Window.partitionBy(*FILE, "chain_depth").orderBy(*forward).rowsBetween(Window.unboundedPreceding, 0)
        start = F.last(F.when(is_row & (a == "start"), line), True).over(per_depth)
        df = df.withColumn("chain_start", F.when(own == "chain", F.coalesce(start, line)))
    else:
        df = df.withColumn("in_class", F.lit(False)).withColumn("chain_start", F.lit(None).cast("int"))

    # 4. facts shared by rows of one name inside a file
    if here & _OWNERS:
        per_owner = Window.partitionBy(*FILE, "own")
        members = F.count(F.when(_is("member") | _is("function"), 1)).over(per_owner)
        df = df.withColumn("members", F.when(own.isNotNull() & lang.isin(*_OWNERS), members).otherwise(0))
    else:
        df = df.withColumn("members", F.lit(0))
    if here & {"rust", "ruby"}:
        key = F.concat_ws(":", F.when(_is("public"), a).otherwise(kind),
                          F.when(lang == "ruby", F.col("own")).otherwise(F.col("bare")))
        df = df.withColumn("key", key)
        per_key = Window.partitionBy(*FILE, "key")
        df = df.withColumn("is_public", F.max(F.when(_is("public"), 1).otherwise(0)).over(per_key) == 1)
        df = df.withColumn("is_private", F.max("private").over(per_key) == 1)
    else:
        df = df.withColumn("is_public", F.lit(False)).withColumn("is_private", F.lit(False))
    df = df.filter(kind.isin(*KINDS))
    if "erlang" in here:
        clauses = Window.partitionBy(*FILE, "kind", "own", "name")
        df = df.withColumn("end_line", F.when(
            own == "clauses", F.max(F.struct("line", "end_line")).over(clauses)["end_line"]
        ).otherwise(F.col("end_line")))
    if here & {"erlang", "zig"}:
        first = F.row_number().over(Window.partitionBy(*FILE, "kind", "own", "name").orderBy(*forward))
        df = df.withColumn("nth", first).filter(
            ~F.coalesce(own, F.lit("")).isin("clauses", "first", "once at line 0") | (F.col("nth") == 1))
    if "nim" in here:
        rank = F.when(a == "variable", 2).when(a == "class", 1).otherwise(0)
        df = df.filter((F.coalesce(own, F.lit("")) != "last outside function") | ~F.col("in_function"))
        latest = F.row_number().over(
            Window.partitionBy(*FILE, "kind", F.startswith(F.coalesce(own, F.lit("")), F.lit("last")), "name")
            .orderBy(rank.desc(), F.desc("line"), F.desc("idx")))
        df = df.withColumn("latest", latest).filter(
            ~F.startswith(F.coalesce(own, F.lit("")), F.lit("last")) | (F.col("latest") == 1))
    if "objc" in here:
        started = F.row_number().over(
            Window.partitionBy(*FILE, "kind", F.col("stop.line")).orderBy(*forward))
        df = df.withColumn("nth_class", started).filter(
            (lang != "objc") | ~_is("class") | F.col("stop").isNull() | (F.col("nth_class") == 1))

    # 5. rows that only count in a certain place
    place = F.coalesce(own, F.lit(""))
    df = df.filter(
        ((place != "outside block") | (F.col("depth2") == 0))
        & ((place != "outside method") | (F.col("depth3") == 0))
        & ((place != "outside function") | ~F.col("in_function"))
        & ((place != "inside function") | F.col("in_function"))
        & ((lang != "javascript") | (place != "top") | (F.col("depth") == 0))
        & ((lang != "javascript") | (place != "member") | F.col("in_class"))
        & ((lang != "dart") | ~_is("variable") | (F.col("depth") <= 1))
    )

    # 6. final columns
    held = F.coalesce(F.col("close.methods"), F.col("methods")) - F.col("methods")
    method_count = (
        F.when(lang.isin("go", "rust", "nim"), F.col("members"))
        .when(lang == "cpp", F.when(close.isNull(), F.col("n")).otherwise(held) + F.col("members"))
        .when(lang == "java", F.when(close.isNull(), F.col("n")).otherwise(held))
        .when(lang == "objc", F.coalesce(F.col("stop.methods"), F.col("methods")) - F.col("methods"))
        .when(lang.isin(*_COUNT_INSIDE_ONLY), F.when(close > line, held - F.col("n")).otherwise(0))
        .otherwise(held)
    )
    tag = (
        F.when(_is("export"), a)
        .when(_is("variable") & (a == "nesting"), F.when(F.col("depth") == 0, "module").otherwise("class"))
        .when(_is("variable") & (place == "function or module"),
              F.when(F.col("in_function"), "function").otherwise("module"))
        .when(_is("variable"), a)
    )
    row = df.select(
        *FILE, "lang", "kind", "name",
        F.when(place == "once at line 0", 0).when(place == "chain", F.col("chain_start")).otherwise(line).cast("int").alias("line"), "end_line",
        F.when(_is("class"), method_count).when(_is("function"), F.col("n")).cast("int").alias("n"),
        F.when(_is("import"), a).alias("source"), F.when(_is("import"), F.col("b")).alias("alias"),
        tag.alias("tag"), F.col("idx").cast("int").alias("ord"), "in_text", "decorated", "snippet",
        (
            ((lang == "rust") & kind.isin("function", "class", "variable") & F.col("is_public"))
            | ((lang == "objc") & _is("class"))
            | ((lang == "ruby") & _is("function") & ~F.col("is_private"))
            | ((lang == "dart") & _is("variable") & (F.col("depth") == 0)
               & ~F.startswith(F.col("name"), F.lit("_")))
        ).alias("exported"),
    )
    if not here & {"rust", "ruby", "dart", "objc"}:
        return row.drop("exported")
    nothing = F.lit(None)
    own_row = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SYMBOLS])
    as_export = F.struct(*[
        {"kind": F.lit("export"), "tag": F.col("kind"), "end_line": nothing, "n": nothing,
         "in_text": nothing}
        .get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in SYMBOLS])
    return row.select(F.inline(
        F.when(F.col("exported"), F.array(own_row, as_export)).otherwise(F.array(own_row))))


def present_languages(files: DataFrame) -> list[str]:
    """Languages with at least one file: the plan then holds no rules for the others."""
    seen = {r[0] for r in files.filter(language(F.col("suffix")).isNotNull())
            .select("suffix").distinct().collect()}  # at most one row per supported suffix
    return [name for name, suffixes in LANGUAGE_SUFFIXES.items() if seen & set(suffixes)]


def symbols(files: DataFrame, langs: list[str] | None = None,
            kinds: list[str] | None = None) -> DataFrame:
    """Symbol rows of ``files``; ``langs`` and ``kinds`` restrict the work, not just the output."""
    langs = list(LANGUAGE_SUFFIXES) if langs is None else langs
    kinds = KINDS if kinds is None else kinds
    files = files.withColumn("lang", language(F.col("suffix")))
    parts = []
    for together in _TOGETHER:
        ruled = [name for name in langs if name in together]
        if not ruled:
            continue
        small_parts(files.sparkSession)
        events = line_events(files, ruled, kinds == ["import"])
        if "call" not in kinds:
            events = events.filter(~F.col("kind").isin("call", "row"))
        if "import" not in kinds:
            events = events.filter(F.col("kind") != "import")
        parts.append(resolve(events, ruled))
    if "python" in langs:
        parts.append(python_symbols(files.filter(F.col("lang") == "python")))
    out = parts[0].select(SYMBOLS.fieldNames())
    for part in parts[1:]:
        out = out.unionByName(part.select(SYMBOLS.fieldNames()))
    return out.filter(F.col("kind").isin(*kinds))
