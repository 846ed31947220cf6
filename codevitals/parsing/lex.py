"""Comment removal and statement folding on whole texts, as Column expressions.

Every function maps a text column to a text column. Where a language needs line
numbers to stay put, newlines inside a removed comment are kept.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import only_newlines, retoken, split_lines

_DOUBLE = r'"[^"\\\n]*+(?:\\[^\n][^"\\\n]*+)*+\\?"?'
_SINGLE = r"'[^'\\\n]*+(?:\\[^\n][^'\\\n]*+)*+\\?'?"
_BLOCK = r"/\*(?:[^*]++|\*(?!/))*+(?:\*/)?"
_CLOSED_BLOCK = r"/\*(?:[^*]++|\*(?!/))*+\*/"


def c_like(text: Column, single_quotes: bool) -> Column:
    """Drop // and /* */ outside string literals."""
    strings = _DOUBLE + ("|" + _SINGLE if single_quotes else "")
    stops = "\"'/" if single_quotes else "\"/"
    tokens = f"{strings}|//[^\\n]*+|{_BLOCK}|[^{stops}]++|/"
    with_blocks = retoken(
        text, tokens,
        lambda t: F.when(F.startswith(t, F.lit("//")), F.lit(""))
        .when(F.startswith(t, F.lit("/*")), only_newlines(t)).otherwise(t),
    )
    simple = F.regexp_replace(text, f"({strings})|//[^\\n]*+", "$1")
    return F.when(F.contains(text, F.lit("/*")), with_blocks).otherwise(simple)


def c_like_plain(text: Column) -> Column:
    """Drop /* */ then // without looking at string literals."""
    blocks = retoken(
        text, f"{_BLOCK}|[^/]++|/",
        lambda t: F.when(F.startswith(t, F.lit("/*")), only_newlines(t)).otherwise(t),
    )
    kept = F.when(F.contains(text, F.lit("/*")), blocks).otherwise(text)
    return F.regexp_replace(kept, "//[^\\n]*+", "")


def c_like_shrinking(text: Column) -> Column:
    """Drop closed /* */ together with their newlines, then //."""
    kept = F.regexp_replace(text, _CLOSED_BLOCK, "")
    return F.regexp_replace(kept, "//[^\\n]*+", "")


def solidity(text: Column) -> Column:
    blocks = retoken(
        text, f"{_CLOSED_BLOCK}|[^/]++|/",
        lambda t: F.when(t.rlike("^/\\*"), only_newlines(t)).otherwise(t),
    )
    kept = F.when(F.contains(text, F.lit("/*")), blocks).otherwise(text)
    return F.regexp_replace(kept, "//[^\\n]*+", "")


def ruby(text: Column) -> Column:
    """Blank =begin/=end blocks, then drop # comments that are not #{."""
    block = (r"(?m)^[ \t]*=begin[^\n]*+(?:\n(?![ \t]*=end[ \t]*$)[^\n]*+)*+(?:\n[^\n]*+)?"
             r"|[^\n]*+\n|[^\n]++")
    blanked = retoken(
        text, block,
        lambda t: F.when(t.rlike("^[ \\t]*=begin"), only_newlines(t)).otherwise(t),
    )
    kept = F.when(F.contains(text, F.lit("=begin")), blanked).otherwise(text)
    return F.regexp_replace(kept, "#[^{\\n][^\\n]*+", "")


def lua(text: Column) -> Column:
    kept = F.regexp_replace(text, r"(?s)--\[(=*)\[.*?\]\1\]", "")
    kept = F.regexp_replace(kept, r"--[^\[\n][^\n]*", "")
    return F.regexp_replace(kept, r"(?m)--$", "")


def nim_blocks(text: Column) -> Column:
    """Drop nested #[ ... ]# comments but keep their newlines."""
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        opens = t == "#["
        closes = (t == "]#") & (acc["depth"] > 0)
        return F.struct(
            (acc["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)).alias("depth"),
            F.concat(
                acc["out"],
                F.when(opens | closes, F.lit(""))
                .when(acc["depth"] > 0, only_newlines(t)).otherwise(t),
            ).alias("out"),
        )

    tokens = F.regexp_extract_all(text, F.lit(r"(?s)#\[|\]#|(?:(?!#\[|\]#).)++"), F.lit(0))
    stripped = F.aggregate(tokens, start, step, lambda acc: acc["out"])
    return F.when(F.contains(text, F.lit("#[")), stripped).otherwise(text)


def nim_line(line: Column) -> Column:
    return F.regexp_extract(line, r'^((?:[^"#]++|"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\\?$))*+)', 1)


def shell_line(line: Column) -> Column:
    """Drop a # comment; keeps a leading #!, $# and ${#."""
    return F.regexp_extract(
        line,
        r"""^((?:[^#"'\\]++|\\.|\\$|'[^']*+(?:'|$)|"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\\?$)|(?<=[${])#|^#(?=!))*+)""",
        1,
    )


def shell_unquoted(line: Column) -> Column:
    return F.regexp_replace(line, r"""\\.|'[^']*+'?|"[^"\\]*+(?:\\.[^"\\]*+)*+"?""", "")


def javascript(text: Column) -> Column:
    """Drop comments; blank string contents except in import/export/require.

    Template literals keep only what is inside ``${ }``; regular-expression
    literals after an operator are blanked. Newlines are kept.
    """
    template = r"`[^`\\]*+(?:\\.[^`\\]*+)*+`?"
    regex = r"(?:(?<=[=(,:;!&|?{}\[\n])|(?<=return))[ \t]*+/(?![/*])(?:[^/\\\n\[]++|\\.|\[(?:[^\]\\\n]++|\\.)*+\])++/[a-z]*+"
    linked = (r"(?:\bfrom|\bimport|\brequire\s*\()\s*(?:\"[^\"\n]*+\"|'[^'\n]*+')")
    # text in which nothing of the above can begin is one token: names that open no ``linked``, blanks with no slash behind, other characters
    plain = r"(?:(?!from|import|require)[A-Za-z0-9_$]++|[ \t]++(?!/)|[^\"'`/ \tA-Za-z0-9_$]++)++"
    tokens = (f"(?s){linked}|{_DOUBLE}|{_SINGLE}|{template}|//[^\\n]*+|{_BLOCK}|{regex}|{plain}"
              r"|[A-Za-z0-9_$]++|[^\"'`/A-Za-z0-9_$]|.")

    def change(t: Column) -> Column:
        # what stands in ${ } stays on its line, between operators
        held = F.transform(F.regexp_extract_all(t, F.lit(r"\$\{[^}]*+\}|\n"), F.lit(0)),
                           lambda p: F.regexp_replace(p, r"^\$\{|\}\z", ""))
        return (
            F.when(F.startswith(t, F.lit("//")), F.lit(""))
            .when(F.startswith(t, F.lit("/*")), only_newlines(t))
            .when(F.startswith(t, F.lit("`")),
                  F.when(F.size(held) == 0, F.lit('""')).otherwise(
                      F.concat(F.lit('"" + '), F.array_join(held, " + "), F.lit(' + ""'))))
            .when(F.startswith(t, F.lit('"')) | F.startswith(t, F.lit("'")), F.lit('""'))
            .when(F.contains(t, F.lit("/")) & t.rlike("^[ \\t]*/[^/*]"), F.lit('""'))
            .otherwise(t)
        )

    return retoken(text, tokens, change)


def fold(text: Column, pattern: str) -> Column:
    """Put every multi-line match of ``pattern`` on its first line.

    The newlines it spanned follow it, so later line numbers do not move.
    """
    def change(t: Column) -> Column:
        return F.when(
            t.rlike("\\n[^\\n]"),
            F.concat(F.regexp_replace(t, "\\s*\\n\\s*", " "), only_newlines(t)),
        ).otherwise(t)

    return retoken(text, f"(?mU)(?:{pattern})|(?-U)[^\\n]*+\\n|[^\\n]++", change)


def mark_region(text: Column, start: str, stays: str, mark: str) -> Column:
    """Prefix with ``mark`` the lines after a ``start`` line for as long as ``stays`` matches."""
    region = f"(?m)^{start}[^\\n]*+\\n(?:{stays}[^\\n]*+(?:\\n|\\z))*+"

    def change(t: Column) -> Column:
        return F.when(
            t.rlike("\\A" + start), F.regexp_replace(t, "\\n(?=[^\\n]|\\n)", "\n" + mark)
        ).otherwise(t)

    marked = retoken(text, f"{region}|[^\\n]*+\\n|[^\\n]++", change)
    return F.when(text.rlike("(?m)^" + start), marked).otherwise(text)


DECORATED = "\u0003"


def mark_decorated(text: Column) -> Column:
    """Mark the first code line after an @ line; blank and # lines may stand between."""
    token = (r"(?m)^[ \t]*@[^\n]*+\n(?:[ \t]*+(?:#[^\n]*+)?\n)*+(?![ \t]*[@#])[^\n]++"
             r"|[^\n]*+\n|[^\n]++")
    marked = retoken(text, token, lambda t: F.when(
        t.rlike(r"\n[^\n]"), F.regexp_replace(t, r"\n([^\n]+)\z", "\n" + DECORATED + "$1")).otherwise(t))
    return F.when(F.contains(text, F.lit("@")), marked).otherwise(text)


def nested(kinds: str, depth: int, also: str = "") -> str:
    """Balanced brackets of ``kinds`` up to a depth, and any other character but those in ``also``."""
    inside = ""
    for level in range(depth):
        groups = [rf"\{o}{inside}\{c}" for o, c in ("()", "[]", "{}") if o in kinds] if level else []
        stops = "".join("\\" + c for o, c in zip("([{([{", "([{)]}") if o in kinds) + (also if level == depth - 1 else "")
        inside = "(?:" + "|".join([f"[^{stops}]++", *groups]) + ")*+"
    return inside


JS_FOLD = (r"^[ \t]*(?:import|export)\b[^;'\"()=]*?\bfrom\s*['\"][^'\"]*['\"]"
           r"|^[ \t]*export\s*\{[^}]*\}")
_JS_NAME = r"[A-Za-z_$][\w$]*+"
_JS_PARAMS = rf"(?:<[^()<>]*+(?:<[^()<>]*+>[^()<>]*+)*+>\s*+)?+\({nested('({', 4, ';')}\)\s*+"
_JS_TYPE = r"(?::[^={;\n]*+(?:\{[^{}]*+\})?+\s*+)?+"
_JS_MODIFIERS = r"(?:(?:public|private|protected|static|async|override|readonly|get|set)\s++)*+"
# one declarator whose value is no function and no class: those keep their lines
_JS_VALUE = (r"(?:[^,;\n(){}\[\]=fc]++|(?!=>|\bfunction\b|\bclass\b)[=fc]"
             rf"|\({nested('([{', 4)}\)|\[{nested('([{', 4)}\]|\{{{nested('([{', 4)}\}})*+")
JS_STATEMENTS = "|".join([
    # heads of functions, bound functions and methods whose parameters span lines
    rf"^[ \t]*+(?:export\s++(?:default\s++)?)?+(?:async\s++)?+function\b\s*+\*?+\s*+(?:{_JS_NAME})?+\s*+{_JS_PARAMS}[^\n]*+",
    rf"^[ \t]*+(?:export\s++)?+(?:const|let|var)\s++{_JS_NAME}\s*+(?::[^=\n;]*+(?:=>[^=\n;]*+)?+)?+=\s*+(?:async\b\s*+)?+"
    rf"(?:function\b\s*+\*?+\s*+(?:{_JS_NAME})?+\s*+)?+{_JS_PARAMS}{_JS_TYPE}(?:=>|\{{)[^\n]*+",
    rf"^[ \t]*+(?!(?:if|for|while|switch|catch|with|return|function)\b){_JS_MODIFIERS}\*?+\s*+\#?+{_JS_NAME}\s*+{_JS_PARAMS}{_JS_TYPE}\{{[^\n]*+",
    # declarations with further declarators, or a value, on later lines
    rf"^[ \t]*+(?:export\s++)?+(?:const|let|var)\s++{_JS_VALUE}(?:\s*+,\s*+{_JS_VALUE}|(?<=[=+?:&|][ \t]{{0,9}})\n\s*+{_JS_VALUE}|\n\s*+(?=[.?:&|+]){_JS_VALUE})*+[^\n]*+",
])


def clean_lines(lang: str, text: Column) -> Column:
    """The lines a language's rules look at."""
    if lang in ("java",):
        return split_lines(c_like(text, single_quotes=False))
    if lang == "cpp":
        return split_lines(c_like(text, single_quotes=True))
    if lang in ("php", "swift", "kotlin"):
        return split_lines(c_like_plain(text))
    if lang in ("scala", "dart", "objc"):
        return split_lines(c_like_shrinking(text))
    if lang == "solidity":
        return F.split(solidity(text), "\n", -1)
    if lang == "ruby":
        return split_lines(ruby(text))
    if lang == "elixir":
        return split_lines(F.regexp_replace(text, "#(?!\\{)[^\\n]*+", ""))
    if lang == "zig":
        return split_lines(F.regexp_replace(text, "//[^\\n]*+", ""))
    if lang == "erlang":
        return split_lines(F.regexp_replace(text, "%[^\\n]*+", ""))
    if lang == "lua":
        return split_lines(lua(text))
    if lang == "shell":
        return F.transform(split_lines(text), shell_line)
    if lang == "nim":
        return split_lines(nim_blocks(text))
    if lang == "javascript":
        return split_lines(fold(javascript(text), JS_FOLD))
    return split_lines(text)
