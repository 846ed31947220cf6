"""Schemas shared by sources, parsers, detectors and sinks."""

from pyspark.sql import types as T

FILES = T.StructType([
    T.StructField("repo_id", T.StringType(), False),
    T.StructField("file", T.StringType(), False),
    T.StructField("suffix", T.StringType(), False),
    T.StructField("text", T.StringType(), True),
    T.StructField("utf8_ok", T.BooleanType(), False),
    T.StructField("mtime", T.DoubleType(), True),
])

# One row per symbol; the six relations are slices of this table by ``kind``.
#   import   name, source, alias, line
#   export   name, tag = function | class | variable | default
#   function name, line, end_line, n = parameter count
#   class    name, line, end_line, n = method count
#   variable name, line, tag = module | class | function
#   call     name, line
# ``in_text`` tells for imports and variables whether another line of the file
# contains the name (NULL when the file is not valid UTF-8); ``decorated`` tells for
# functions whether an @ line stands above; ``snippet`` holds up to four source lines from ``line`` on.
SYMBOLS = T.StructType([
    T.StructField("repo_id", T.StringType()),
    T.StructField("file", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("end_line", T.IntegerType()),
    T.StructField("n", T.IntegerType()),
    T.StructField("source", T.StringType()),
    T.StructField("alias", T.StringType()),
    T.StructField("tag", T.StringType()),
    T.StructField("ord", T.IntegerType()),
    T.StructField("in_text", T.BooleanType()),
    T.StructField("decorated", T.BooleanType()),
    T.StructField("snippet", T.StringType()),
])

FINDING_COLUMNS = [
    "repo_id", "detector", "category", "message", "file", "line", "snippet",
    "related", "group_id", "confidence", "kind_ord", "ord",
]

LANGUAGE_SUFFIXES = {
    "python": [".py"],
    "javascript": [".js", ".jsx", ".ts", ".tsx"],
    "solidity": [".sol"],
    "go": [".go"],
    "rust": [".rs"],
    "java": [".java"],
    "cpp": [".c", ".h", ".cpp", ".cc", ".cxx", ".hpp", ".hxx"],
    "ruby": [".rb"],
    "php": [".php"],
    "swift": [".swift"],
    "kotlin": [".kt", ".kts"],
    "dart": [".dart"],
    "lua": [".lua"],
    "elixir": [".ex", ".exs"],
    "zig": [".zig"],
    "shell": [".sh", ".bash", ".zsh"],
    "nim": [".nim", ".nims"],
    "scala": [".scala", ".sc"],
    "objc": [".m", ".mm"],
    "erlang": [".erl", ".hrl"],
}
SUPPORTED_SUFFIXES = [s for group in LANGUAGE_SUFFIXES.values() for s in group]
