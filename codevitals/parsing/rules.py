"""Line rules of the regex-parsed languages.

Each rule set is a function ``(line columns) -> [event array, ...]``;
``Checked`` arrays hold imports and variables. The patterns
and word lists are fixed values: results depend on them literally.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import (
    comma_count, first_is_upper, indent, last_part, let, nested_comma_count, strip,
)
from . import lex
from .events import (
    AT_CLASS, AT_DECL, AT_EOL, AT_LINE, Checked, brackets, calls, ev, export, first_of, flag,
    function, grab, grab_all, grab_opt, has, hit, hits, joined, klass, last_dotted, none,
)


class Line:
    """Columns of one source line: cleaned, stripped, raw, and two aligned variants."""

    def __init__(self, t: Column, s: Column, r: Column, d: Column, v: Column, names: Column):
        self.t, self.s, self.r, self.d, self.v, self.names = t, s, r, d, v, names


def _not_in(words):
    return lambda x: ~x.isin(*words)


def _base_not_in(words):
    return lambda x: ~last_dotted(x).isin(*words)


# --------------------------------------------------------------------- Go
# Fixed values
GO_IMPORT = r'^import\s+"([^"]+)"'
GO_IMPORT_ITEM = r'^\s*(?:(\w+)\s+)?"([^"]+)"'
GO_FUNC = r"^func\s+(?:\((\w+)\s+\*?(\w+)\)\s+)?(\w+)\s*\(([^)]*)\)"
GO_STRUCT = r"^type\s+(\w+)\s+struct\b"
GO_VAR = r"^(?:var|const)\s+(\w+)\b"
GO_VAR_BLOCK = r"^(?:var|const)\s*\("
GO_BLOCK_NAME = r"^\s*(\w+)\b"
GO_CALL = r"([\w.]+)\s*\("
GO_NOT_CALLS = ["func", "if", "for", "switch", "select", "return", "go", "defer", "range"]
GO_REGION_IMPORT, GO_REGION_VAR = "\u0001", "\u0002"


def go_marked(text: Column) -> Column:
    stays = r"(?![ \t]*\)[ \t]*(?:\n|\z))"
    text = lex.mark_region(text, r"[ \t]*import[ \t]*\(", stays, GO_REGION_IMPORT)
    return lex.mark_region(text, r"[ \t]*(?:var|const)[ \t]*\(", stays, GO_REGION_VAR)


def go(x: Line) -> list[Column]:
    in_import = F.startswith(x.d, F.lit(GO_REGION_IMPORT))
    in_vars = F.startswith(x.d, F.lit(GO_REGION_VAR))
    receiver = grab(x.s, GO_FUNC, 2)
    short = grab(x.s, GO_FUNC, 3)
    name = F.when(receiver != "", F.concat(receiver, F.lit("."), short)).otherwise(short)
    item = grab(x.s, GO_IMPORT_ITEM, 2)
    one = grab(x.s, GO_IMPORT)
    struct, block_var, var = grab(x.s, GO_STRUCT), grab(x.s, GO_BLOCK_NAME), grab(x.s, GO_VAR)

    def with_export(event, name, kind, shown=None):
        shown = name if shown is None else shown
        return F.when(first_is_upper(shown), F.array(event, export(name, kind))).otherwise(F.array(event))

    return [
        Checked(first_of(
            (in_import & has(x.s, GO_IMPORT_ITEM),
             F.array(ev("import", last_part(item, "/"), item, grab_opt(x.s, GO_IMPORT_ITEM, 1)))),
            (in_import, none()),
            (has(x.s, GO_IMPORT), F.array(ev("import", last_part(one, "/"), one))),
        )),
        hits(has(x.s, GO_FUNC), with_export(
            function(name, comma_count(grab(x.s, GO_FUNC, 4)),
                     own=F.when(receiver != "", receiver)), name, "function", short)),
        hits(has(x.s, GO_STRUCT), with_export(klass(struct, own=struct), struct, "class")),
        Checked(first_of(
            (in_vars & has(x.s, GO_BLOCK_NAME), with_export(ev("variable", block_var, "module"), block_var, "variable")),
            (in_vars | has(x.s, GO_VAR_BLOCK), none()),
            (has(x.s, GO_VAR), with_export(ev("variable", var, "module"), var, "variable")),
        )),
        calls(grab_all(x.t, GO_CALL), _not_in(GO_NOT_CALLS)),
        brackets(x.t),
    ]


# ------------------------------------------------------------------- Rust
# Fixed values
RUST_USE = r"^\s*use\s+(.+);"
RUST_GROUP = r"^(.+)::\{(.+)\}"
RUST_IMPL = r"^\s*impl(?:<[^>]*>)?\s+(\w+)"
RUST_FN = (r"^\s*(?:pub(?:\s*\([^)]*\))?\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+\"[^\"]*\"\s+)?"
           r"fn\s+(\w+)\s*(?:<[^>]*>)?\s*\(([^)]*)\)")
RUST_TYPE = r"^\s*(?:pub(?:\s*\([^)]*\))?\s+)?(?:struct|enum|trait)\s+(\w+)"
RUST_STATIC = r"^\s*(?:pub(?:\s*\([^)]*\))?\s+)?static\s+(?:mut\s+)?(\w+)\s*:"
RUST_CONST = r"^\s*(?:pub(?:\s*\([^)]*\))?\s+)?const\s+(\w+)\s*:"
RUST_PUB_FN = r"^\s*pub(?:\s*\([^)]*\))?\s+(?:async\s+)?(?:unsafe\s+)?fn\s+(\w+)"
RUST_PUB_TYPE = r"^\s*pub(?:\s*\([^)]*\))?\s+(?:struct|enum|trait)\s+(\w+)"
RUST_PUB_VAR = r"^\s*pub(?:\s*\([^)]*\))?\s+(?:static\s+(?:mut\s+)?|const\s+)(\w+)"
RUST_CALL = r"([\w:.]+)\s*[!]?\s*\("
RUST_NOT_CALLS = [
    "fn", "if", "for", "while", "match", "loop", "return", "let", "mut", "pub", "use", "mod",
    "struct", "enum", "trait", "impl", "async", "await", "unsafe", "where",
]


def rust(x: Line) -> list[Column]:
    path = strip(grab(x.t, RUST_USE))
    base = F.regexp_extract(path, RUST_GROUP, 1)
    items = F.filter(
        F.transform(F.split(F.regexp_extract(path, RUST_GROUP, 2), ","), strip), lambda i: i != "")

    def item_event(item):
        name = strip(F.element_at(F.split(F.substring_index(item, "::", 1), " as "), 1))
        alias = F.when(F.contains(item, F.lit(" as ")), strip(F.get(F.split(item, " as "), F.lit(1))))
        return ev("import", name, F.concat(base, F.lit("::"), name), alias)

    tail = strip(last_part(path, "::"))
    aliased = F.contains(tail, F.lit(" as "))
    bare = F.when(aliased, strip(F.substring_index(tail, " as ", 1))).otherwise(tail)
    parts = F.split(path, "::")
    name = F.when((bare == "*") & (F.size(parts) > 1), F.element_at(parts, -2)).otherwise(bare)
    alias = F.when(aliased, strip(F.regexp_extract(tail, " as (.*)$", 1)))
    single = ev("import", name, strip(F.substring_index(path, " as ", 1)), alias)

    fn_name, type_name = grab(x.s, RUST_FN), grab(x.s, RUST_TYPE)
    params = F.regexp_replace(grab(x.s, RUST_FN, 2), "<[^>]*>", "")
    impl_line = has(x.s, RUST_IMPL) & F.contains(x.s, F.lit("{"))
    return [
        Checked(hits(has(x.t, RUST_USE),
             F.when(path.rlike(RUST_GROUP), F.transform(items, item_event)).otherwise(F.array(single)))),
        first_of(
            (impl_line, F.array(ev("impl", grab(x.s, RUST_IMPL), "block", pos=AT_CLASS))),
            (has(x.s, RUST_FN), F.array(function(fn_name, comma_count(params)))),
        ),
        hit(has(x.s, RUST_TYPE), klass(type_name)),
        Checked(first_of(
            (has(x.t, RUST_STATIC), F.array(ev("variable", grab(x.t, RUST_STATIC), "module"))),
            (has(x.t, RUST_CONST), F.array(ev("variable", grab(x.t, RUST_CONST), "module"))),
        )),
        hit(has(x.t, RUST_PUB_FN), ev("public", grab(x.t, RUST_PUB_FN), "function")),
        hit(has(x.t, RUST_PUB_TYPE), ev("public", grab(x.t, RUST_PUB_TYPE), "class")),
        hit(has(x.t, RUST_PUB_VAR), ev("public", grab(x.t, RUST_PUB_VAR), "variable")),
        calls(grab_all(x.t, RUST_CALL), _not_in(RUST_NOT_CALLS)),
        brackets(x.t),
    ]


# ------------------------------------------------------------------- Java
# Fixed values
JAVA_IMPORT = r"^\s*import\s+(static\s+)?([\w.*]+)\s*;"
JAVA_METHOD = (
    r"^\s*(?:(?:public|private|protected|static|final|abstract|native|synchronized|strictfp|default|"
    r"transient|volatile)\s+){0,40}(?:<[^>]+>\s+)?(?:[\w\[\]<>,\s?]+)\s+(\w+)\s*\(([^)]*)\)"
    r"\s*(?:throws\s+[\w,\s]+)?\s*[{;]")
JAVA_CTOR = (r"^\s*(?:(?:public|private|protected)\s+)?([A-Z]\w*)\s*\(([^)]*)\)\s*"
             r"(?:throws\s+[\w,\s]+)?\s*\{")
JAVA_NOT_METHODS = ["if", "for", "while", "switch", "catch", "return", "new", "class"]
JAVA_CLASS = (r"^\s*(?:(?:public|private|protected|static|final|abstract|strictfp)\s+){0,40}"
              r"(?:class|interface|enum|record|@interface)\s+(\w+)")
JAVA_FIELD = (r"^\s*(?:(?:public|private|protected|static|final|transient|volatile)\s+)+"
              r"(?:[\w\[\]<>,\s?]+)\s+(\w+)\s*[;=]")
# Chains of names are matched possessively and from their first name only: one pass, whatever their length.
JAVA_CALL = r"(?<!\w)(?<!\w\.)((?:\w++\.)*+\w++)\s*+\("
JAVA_NEW = r"\bnew\s+([\w.]+)\s*\("
JAVA_NOT_CALLS = [
    "if", "for", "while", "switch", "catch", "return", "class", "interface", "enum", "record",
    "import", "package", "throws", "extends", "implements", "super", "assert",
]


def java(x: Line) -> list[Column]:
    path = grab(x.r, JAVA_IMPORT, 2)
    possible = (x.s != "") & ~F.startswith(x.s, F.lit("@")) & F.contains(x.t, F.lit("("))
    is_method = possible & has(x.t, JAVA_METHOD)
    method, ctor = grab(x.t, JAVA_METHOD), grab(x.t, JAVA_CTOR)
    counted = is_method & ~method.isin(*JAVA_NOT_METHODS)
    end = F.when(F.contains(x.t, F.lit("{")), "block").otherwise("line")
    is_ctor = possible & ~is_method & has(x.t, JAVA_CTOR)
    name = grab(x.t, JAVA_CLASS)

    def callable_(c):
        base = last_dotted(c)
        return ~base.isin(*JAVA_NOT_CALLS) & (~first_is_upper(base) | F.contains(c, F.lit(".")))

    return [
        Checked(hit(has(x.r, JAVA_IMPORT),
            ev("import", last_dotted(path), path,
               F.when(grab(x.r, JAVA_IMPORT, 1) != "", "static")))),
        hit(has(x.t, JAVA_CLASS), klass(name, flag(counted | is_ctor)), export(name, "class")),
        first_of(
            (is_method & ~counted, none()),
            (counted, F.array(function(method, comma_count(grab(x.t, JAVA_METHOD, 2)), end),
                              export(method, "function"))),
            (is_ctor, F.array(function(ctor, comma_count(grab(x.t, JAVA_CTOR, 2))), export(ctor, "function"))),
        ),
        Checked(hit(has(x.t, JAVA_FIELD), ev("variable", grab(x.t, JAVA_FIELD), "class"))),
        F.transform(grab_all(x.t, JAVA_NEW), lambda c: ev("call", F.concat(F.lit("new "), c))),
        calls(grab_all(x.t, JAVA_CALL), callable_),
        brackets(x.t),
    ]


# ------------------------------------------------------------------ C/C++
# Fixed values
CPP_INCLUDE = r'^\s*#\s*include\s+([<"])([^>"]+)[>"]'
CPP_USING_NS = r"^\s*using\s+namespace\s+([\w:]+)\s*;"
CPP_USING = r"^\s*using\s+([\w:]+)\s*;"
CPP_FUNC = (
    r"^\s*(?:(?:static|inline|virtual|explicit|constexpr|extern|friend)\s+){0,40}(?:[\w:*&<>,\s]+?)\s+"
    r"(~?(?:\w++::)*+\w++)\s*\(([^)]*)\)(?:\s*(?:const|override|final|noexcept|->[\w\s:&*<>]+))*\s*\{")
CPP_NOT_FUNCS = [
    "if", "for", "while", "switch", "catch", "return", "else", "do", "sizeof", "typeof", "alignof",
    "decltype", "static_assert",
]
CPP_CLASS = (
    r"^\s*(?:template\s*<[^>]*>\s*)?(?:class|struct)\s+(?:__\w+\s+)?(\w+)"
    r"(?:\s*(?:final\s*)?(?::\s*(?:public|private|protected)?\s*[\w:<>,\s]+)?)?\s*\{")
CPP_VAR = (r"^\s*(?:(?:static|extern|const|constexpr|volatile|thread_local|mutable)\s+){0,40}"
           r"(?:[\w:*&<>,\s]+?)\s+(\w+)\s*[;=]")
CPP_NOT_VARS = [
    "if", "for", "while", "switch", "catch", "return", "else", "do", "class", "struct", "enum",
    "union", "namespace", "template", "typedef", "using", "include", "define", "pragma",
]
CPP_CALL = r"(?<!\w)(?<!\w(?:::|\.|->))((?:\w++(?:::|\.|->))*+\w++)\s*+\("
CPP_NOT_CALLS = [
    "if", "for", "while", "switch", "catch", "return", "else", "do", "sizeof", "typeof", "alignof",
    "decltype", "static_assert", "class", "struct", "enum", "union", "namespace", "template",
    "typedef", "using", "define", "include",
]
CPP_STATIC = r"^\s*static\s+"


def cpp(x: Line) -> list[Column]:
    include, ns, using = grab(x.r, CPP_INCLUDE, 2), grab(x.r, CPP_USING_NS), grab(x.r, CPP_USING)
    code = (x.s != "") & ~F.startswith(x.s, F.lit("#"))
    name = grab(x.t, CPP_FUNC)
    base = F.regexp_replace(last_part(name, "::"), "^~+", "")
    params = grab(x.t, CPP_FUNC, 2)
    count = F.when(strip(params) == "void", 0).otherwise(comma_count(params))
    is_func = (code & F.contains(x.t, F.lit("(")) & F.contains(x.t, F.lit("{"))
               & has(x.t, CPP_FUNC) & ~base.isin(*CPP_NOT_FUNCS))
    class_name, var = grab(x.t, CPP_CLASS), grab(x.t, CPP_VAR)
    visible = ~has(x.t, CPP_STATIC)
    owner = F.when(F.contains(name, F.lit("::")), F.substring_index(name, "::", 1))
    is_var = (
        code & (indent(x.t) <= 4) & x.t.rlike("[;=]") & has(x.t, CPP_VAR) & ~var.isin(*CPP_NOT_VARS)
        & ~(F.contains(x.t, F.lit("{"))
            & ~F.contains(F.substring_index(x.t, "{", 1), F.lit("="))))

    def shown(event, name, kind):
        return F.when(visible, F.array(event, export(name, kind))).otherwise(F.array(event))

    return [
        Checked(first_of(
            (has(x.r, CPP_INCLUDE), F.array(ev("import", include, include))),
            (has(x.r, CPP_USING_NS), F.array(ev("import", ns, ns))),
            (has(x.r, CPP_USING), F.array(ev("import", using, using))),
        )),
        hit(has(x.t, CPP_CLASS), klass(class_name, flag(is_func), own=class_name),
            export(class_name, "class")),
        hits(is_func, shown(function(name, count, own=owner), name, "function")),
        Checked(hits(is_var, shown(ev("variable", var, "module"), var, "variable"))),
        calls(grab_all(x.t, CPP_CALL),
              lambda c: ~F.regexp_replace(c, r"^.*(::|\.|->)", "").isin(*CPP_NOT_CALLS)),
        brackets(x.t),
    ]


# ------------------------------------------------------------------- Ruby
# Fixed values
RUBY_REQUIRE = r"""require(?:_relative)?\s+['"]([^'"]+)['"]"""
RUBY_INCLUDE = r"^(?:include|extend)\s+(\w[\w:]*)"
RUBY_DEF = r"^(\s*)def\s+(self\.)?(\w+[?!=]?)\s*(\([^)]*\))?"
RUBY_OPENER = r"^\s*(?:def|class|module|if|unless|while|until|for|case|begin|do)\b"
RUBY_DO = r"\bdo\s*(\|[^|]*\|)?\s*$"
RUBY_END = r"^\s*end\b"
RUBY_END_ONLY = r"^\s*end\s*$"
RUBY_CLASS = r"^\s*(?:class|module)\s+(\w+)"
RUBY_CLASS_OPEN = r"^\s*(?:class|module)\b"
RUBY_METHOD = r"^\s*def\s+"
RUBY_CONSTANT = r"^\s*([A-Z][A-Z0-9_]*)\s*="
RUBY_CLASS_VAR = r"^\s*(@@\w+)\s*="
RUBY_INSTANCE_VAR = r"^\s*(@\w+)\s*="
RUBY_CALL = r"(?<![\w.:])([\w.:]++)\s*+\("
RUBY_NEW = r"(\w[\w:]*)\.(new)\b"
RUBY_NOT_CALLS = [
    "def", "class", "module", "if", "unless", "while", "until", "for", "case", "when", "begin",
    "rescue", "ensure", "end", "return", "yield", "raise", "require", "require_relative", "include",
    "extend", "puts", "print",
]


def ruby(x: Line) -> list[Column]:
    source, mixed = grab(x.s, RUBY_REQUIRE), grab(x.s, RUBY_INCLUDE)
    bare = grab(x.t, RUBY_DEF, 3)
    name = F.concat(grab(x.t, RUBY_DEF, 2), bare)
    inner = F.regexp_replace(grab(x.t, RUBY_DEF, 4), "^[()]+|[()]+$", "")
    opener = has(x.t, RUBY_OPENER)
    class_name = grab(x.t, RUBY_CLASS)
    return [
        Checked(first_of(
            (has(x.s, RUBY_REQUIRE), F.array(ev("import", last_part(source, "/"), source))),
            (has(x.s, RUBY_INCLUDE), F.array(ev("import", mixed))),
        )),
        hit(has(x.t, RUBY_CLASS), klass(class_name), export(class_name, "class")),
        hit(has(x.t, RUBY_DEF), function(name, comma_count(inner), own=bare)),
        hit(has(x.t, RUBY_METHOD), ev("method", pos=AT_EOL)),
        Checked(first_of(
            (has(x.s, RUBY_CONSTANT), F.array(ev("variable", grab(x.s, RUBY_CONSTANT), "module"))),
            (has(x.s, RUBY_CLASS_VAR), F.array(ev("variable", grab(x.s, RUBY_CLASS_VAR), "class"))),
            (has(x.s, RUBY_INSTANCE_VAR),
             F.array(ev("variable", grab(x.s, RUBY_INSTANCE_VAR), "class", own="outside method"))),
        )),
        hit(opener | has(x.t, RUBY_DO), ev("{", pos=1)),
        hit(has(x.t, RUBY_END), ev("}", pos=2)),
        # running counters that never go below zero: open classes, open methods
        first_of(
            (has(x.t, RUBY_CLASS_OPEN), F.array(ev("depth2", n=1, pos=AT_EOL), ev("mark", a="class", pos=AT_EOL))),
            (has(x.t, RUBY_END_ONLY), F.array(ev("depth2", n=-1, pos=AT_EOL), ev("mark", a="end", pos=AT_LINE))),
            (has(x.t, r"^\s*private\s*$"), F.array(ev("mark", a="private", pos=AT_EOL))),
            (has(x.t, r"^\s*(?:public|protected)\s*$"), F.array(ev("mark", a="public", pos=AT_EOL))),
        ),
        first_of(
            (has(x.t, r"^\s*def\b"), F.array(ev("depth3", n=1, pos=AT_EOL))),
            (opener, none()),
            (has(x.t, RUBY_END), F.array(ev("depth3", n=-1, pos=AT_EOL))),
        ),
        calls(grab_all(x.t, RUBY_CALL), _base_not_in(RUBY_NOT_CALLS)),
        F.transform(grab_all(x.t, RUBY_NEW), lambda c: ev("call", F.concat(c, F.lit(".new")))),
    ]


# -------------------------------------------------------------------- PHP
# Fixed values
PHP_USE = r"use\s+([\w\\]+)(?:\s+as\s+(\w+))?\s*;"
PHP_REQUIRE = r"""(?:require|require_once|include|include_once)\s*[\(]?\s*['"]([^'"]+)['"]\s*[\)]?\s*;"""
PHP_FUNC = (r"(?:(?:public|private|protected)\s+)?(?:(?:static|abstract|final)\s+){0,40}"
            r"function\s+(\w+)\s*\(([^)]*)\)")
PHP_CLASS = r"(?:(?:abstract|final)\s+)?(?:class|interface|trait|enum)\s+(\w+)"
PHP_METHOD = r"\bfunction\s+\w+\s*\("
PHP_PROPERTY = r"(?:(?:public|private|protected)\s+)?(?:(?:static|readonly)\s+){0,40}\$(\w+)\s*[;=]"
PHP_CONST = r"(?:(?:public|private|protected)\s+)?const\s+(\w+)\s*="
PHP_CALL = r"(\w+)\s*\("
PHP_METHOD_CALL = r"(?:\$\w+|self|static|parent|\w+)->(\w+)\s*\("
PHP_STATIC_CALL = r"(\w+::\w+)\s*\("
PHP_NOT_CALLS = [
    "function", "if", "elseif", "else", "for", "foreach", "while", "switch", "case", "catch", "class",
    "interface", "trait", "enum", "return", "echo", "print", "new", "throw", "use", "require",
    "require_once", "include", "include_once", "isset", "unset", "empty", "list", "array", "match",
]


def php(x: Line) -> list[Column]:
    used, required = grab(x.s, PHP_USE), grab(x.s, PHP_REQUIRE)
    name, class_name = grab(x.t, PHP_FUNC), grab(x.s, PHP_CLASS)
    is_method = has(x.t, PHP_METHOD)
    return [
        Checked(first_of(
            (has(x.s, PHP_USE), F.array(ev("import", last_part(used, "\\"), used, grab_opt(x.s, PHP_USE, 2)))),
            (has(x.s, PHP_REQUIRE), F.array(ev("import", last_part(required, "/"), required))),
        )),
        hit(has(x.s, PHP_CLASS), klass(class_name, flag(is_method)), export(class_name, "class")),
        hit(has(x.t, PHP_FUNC), function(name, comma_count(grab(x.t, PHP_FUNC, 2))), export(name, "function")),
        hit(is_method, ev("method", pos=AT_EOL)),
        Checked(first_of(
            (has(x.s, r"\bfunction\b"), none()),
            (has(x.s, PHP_PROPERTY),
             F.array(ev("variable", F.concat(F.lit("$"), grab(x.s, PHP_PROPERTY)), "class"))),
            (has(x.s, PHP_CONST), F.array(ev("variable", grab(x.s, PHP_CONST), "class"))),
        )),
        calls(grab_all(x.t, PHP_STATIC_CALL)),
        calls(grab_all(x.t, PHP_METHOD_CALL)),
        calls(grab_all(x.t, PHP_CALL), _not_in(PHP_NOT_CALLS)),
        brackets(x.t),
    ]


# ------------------------------------------------------------------ Swift
# Fixed values
SWIFT_IMPORT = r"(?:@testable\s+)?import\s+(\w[\w.]*)"
SWIFT_FUNC = (r"(?:(?:public|private|fileprivate|internal|open)\s+)?"
              r"(?:(?:static|class|override|mutating|final)\s+){0,40}func\s+(\w+)\s*(?:<[^>]*>)?\s*\(([^)]*)\)")
SWIFT_INIT = (r"(?:(?:public|private|fileprivate|internal|open)\s+)?"
              r"(?:(?:required|convenience|override)\s+){0,40}(init)\s*(?:\?|!)?\s*\(([^)]*)\)")
SWIFT_DEINIT = r"(?:(?:public|private|fileprivate|internal|open)\s+)?(deinit)\s*\{"
SWIFT_CLASS = (r"(?:(?:public|private|fileprivate|internal|open)\s+)?(?:(?:final)\s+)?"
               r"(?:class|struct|enum|protocol|actor|extension)\s+(\w+)")
SWIFT_METHOD = r"\bfunc\s+\w+|(?:required\s+|convenience\s+|override\s+)*init\s*[\((?]"
SWIFT_PROPERTY = (r"(?:(?:public|private|fileprivate|internal|open)\s+)?"
                  r"(?:(?:static|class|lazy|weak|unowned)\s+){0,40}(?:var|let)\s+(\w+)")
SWIFT_PRIVATE = r"(?:^|\s)(?:private|fileprivate)\s"
SWIFT_NOT_CALLS = [
    "func", "if", "else", "guard", "for", "while", "switch", "case", "return", "throw", "try", "catch",
    "import", "let", "var", "class", "struct", "enum", "protocol", "actor", "extension", "init",
    "deinit", "where", "in", "as", "is", "print", "debugPrint",
]
DOTTED_CALL = r"([\w.]+)\s*\("


def _shown_unless(private: Column, event: Column, name: Column, kind: str) -> Column:
    return F.when(private, F.array(event)).otherwise(F.array(event, export(name, kind)))


def swift(x: Line) -> list[Column]:
    private = has(x.t, SWIFT_PRIVATE)
    name, init = grab(x.s, SWIFT_FUNC), F.lit("init")
    imported, class_name, prop = grab(x.s, SWIFT_IMPORT), grab(x.s, SWIFT_CLASS), grab(x.s, SWIFT_PROPERTY)
    is_method = has(x.t, SWIFT_METHOD)
    return [
        Checked(hit(has(x.s, SWIFT_IMPORT), ev("import", imported, imported))),
        hits(has(x.s, SWIFT_CLASS),
             _shown_unless(private, klass(class_name, flag(is_method)), class_name, "class")),
        first_of(
            (has(x.s, SWIFT_FUNC),
             _shown_unless(private, function(name, comma_count(grab(x.s, SWIFT_FUNC, 2))), name, "function")),
            (has(x.s, SWIFT_INIT),
             _shown_unless(private, function(init, comma_count(grab(x.s, SWIFT_INIT, 2))), init, "function")),
            (has(x.s, SWIFT_DEINIT),
             _shown_unless(private, function("deinit", 0), F.lit("deinit"), "function")),
        ),
        hit(is_method, ev("method", pos=AT_EOL)),
        Checked(first_of(
            (has(x.s, r"^(?:func|init|deinit)\b"), none()),
            (has(x.s, SWIFT_PROPERTY), _shown_unless(
                private, ev("variable", prop, F.when(indent(x.t) > 0, "class").otherwise("module")),
                prop, "variable")),
        )),
        calls(grab_all(x.t, DOTTED_CALL), _base_not_in(SWIFT_NOT_CALLS)),
        brackets(x.t),
    ]


# ----------------------------------------------------------------- Kotlin
# Fixed values
KOTLIN_IMPORT = r"import\s+([\w.]+)(?:\s+as\s+(\w+))?"
KOTLIN_FUN = (
    r"(?:(?:public|private|protected|internal)\s+)?(?:(?:suspend|inline|infix|operator|tailrec|override|"
    r"open|abstract|final|external)\s+){0,40}fun\s+(?:<[^>]*>\s+)?(\w+)\s*\(([^)]*)\)")
KOTLIN_CLASS = (
    r"(?:(?:public|private|protected|internal)\s+)?(?:(?:abstract|sealed|open|final|inner|data|value|"
    r"annotation)\s+){0,40}(?:class|interface|object|enum\s+class)\s+(\w+)")
KOTLIN_METHOD = r"\bfun\s+"
KOTLIN_PROPERTY = (r"(?:(?:public|private|protected|internal)\s+)?"
                   r"(?:(?:const|lateinit|override|open|abstract)\s+){0,40}(?:val|var)\s+(\w+)")
KOTLIN_PRIVATE = r"(?:^|\s)(?:private|internal)\s"
KOTLIN_NOT_CALLS = [
    "fun", "if", "else", "for", "while", "when", "return", "throw", "try", "catch", "finally", "import",
    "package", "class", "interface", "object", "val", "var", "in", "is", "as", "data", "sealed", "enum",
    "abstract", "open", "inner", "override", "suspend", "inline", "infix", "operator", "println", "print",
]


def kotlin(x: Line) -> list[Column]:
    private = has(x.t, KOTLIN_PRIVATE)
    path, name = grab(x.s, KOTLIN_IMPORT), grab(x.t, KOTLIN_FUN)
    class_name, prop = grab(x.s, KOTLIN_CLASS), grab(x.s, KOTLIN_PROPERTY)
    is_method = has(x.t, KOTLIN_METHOD)
    return [
        Checked(hit(has(x.s, KOTLIN_IMPORT), ev("import", last_dotted(path), path, grab_opt(x.s, KOTLIN_IMPORT, 2)))),
        hits(has(x.s, KOTLIN_CLASS),
             _shown_unless(private, klass(class_name, flag(is_method)), class_name, "class")),
        hits(has(x.t, KOTLIN_FUN),
             _shown_unless(private, function(name, comma_count(grab(x.t, KOTLIN_FUN, 2))), name, "function")),
        hit(is_method, ev("method", pos=AT_EOL)),
        Checked(first_of(
            (has(x.s, r"\bfun\b"), none()),
            (has(x.s, KOTLIN_PROPERTY), _shown_unless(
                private, ev("variable", prop, F.when(indent(x.t) > 0, "class").otherwise("module")),
                prop, "variable")),
        )),
        calls(grab_all(x.t, DOTTED_CALL), _base_not_in(KOTLIN_NOT_CALLS)),
        brackets(x.t),
    ]


# ------------------------------------------------------------------- Dart
# Fixed values
DART_IMPORT = (r"^(?:import|export|part(?:\s+of)?)\s+'([^']+)'(?:\s+as\s+(\w+))?"
               r"(?:\s+(?:show|hide)\s+([\w,\s]+))?\s*;")
DART_FUNC = (r"^(?:(?:static|external|abstract|override|async)\s+){0,40}(?:(?:[\w<>,\s\?]+)\s+)?"
             r"(?:(?:get|set)\s+)?(\w+)\s*\(([^)]*)\)\s*(?:async\s*)?(?:\{|=>|;)")
DART_GETTER = (r"^(?:(?:static|external|abstract|override)\s+){0,40}(?:(?:[\w<>,\s\?]+)\s+)?"
               r"get\s+(\w+)\s*(?:=>|\{)")
DART_NOT_FUNCS = [
    "if", "else", "for", "while", "switch", "catch", "return", "throw", "assert", "await", "yield",
    "import", "export", "class", "enum", "mixin", "extension", "typedef",
]
DART_CLASS = (r"^(?:(?:abstract|sealed|base|final|interface)\s+){0,40}(?:class|mixin|enum|extension)\s+(\w+)")
DART_VAR = (r"^(?:(?:static|late|external)\s+){0,40}(?:(?:final|const|var)\s+)(?:(?:[\w<>,\?\s]+)\s+)?"
            r"(\w+)\s*[=;]")
DART_TYPED_VAR = r"^(?:(?:static|late|external)\s+){0,40}([\w<>,\?]+)\s+(\w+)\s*[=;]"
DART_NOT_VARS = [
    "class", "enum", "mixin", "extension", "import", "export", "if", "else", "for", "while", "switch",
    "return", "void", "abstract", "sealed", "base", "final", "interface", "part", "typedef", "throw",
    "assert", "catch", "try",
]
DART_NOT_TYPES = [
    "return", "throw", "if", "else", "for", "while", "switch", "catch", "try", "class", "void", "import",
    "export", "abstract", "sealed", "base", "final", "interface",
]
DART_CALL = r"(?:\.\.|\b)([\w.]+)\s*[<\w,\s>]*\("
DART_NOT_CALLS = [
    "if", "else", "for", "while", "switch", "catch", "return", "throw", "assert", "import", "export",
    "class", "enum", "mixin", "extension", "void", "super", "this",
]


def dart(x: Line) -> list[Column]:
    source = grab(x.s, DART_IMPORT)
    short = F.regexp_replace(last_part(source, "/"), r"\.dart$", "")
    getter, name = grab(x.s, DART_GETTER), grab(x.s, DART_FUNC)
    params = F.regexp_replace(grab(x.s, DART_FUNC, 2), "<[^>]*>", "")
    # commas inside { } or [ ] do not separate parameters
    params = lex.retoken(params, r"\{[^}]*\}|\[[^\]]*\]|[^{\[]+|[{\[]",
                         lambda t: F.when(t.rlike(r"^[\[{].*[\]}]$"), F.replace(t, F.lit(","), F.lit(";"))).otherwise(t))
    brace = F.contains(x.s, F.lit("{"))
    arrow = F.contains(x.s, F.lit("=>")) & ~F.contains(F.substring_index(x.s, "=>", 1), F.lit("{"))
    end = F.when(arrow, "stop").when(brace, "block").otherwise("line")
    var, typed, type_name = grab(x.s, DART_VAR), grab(x.s, DART_TYPED_VAR, 2), grab(x.s, DART_TYPED_VAR)
    class_name = grab(x.s, DART_CLASS)
    code = x.s != ""
    is_getter = code & has(x.s, DART_GETTER)
    is_func = code & ~is_getter & has(x.s, DART_FUNC) & ~name.isin(*DART_NOT_FUNCS)

    def public(event, name, kind):
        return _shown_unless(F.startswith(name, F.lit("_")), event, name, kind)

    return [
        Checked(hits(has(x.s, DART_IMPORT), F.when(
            F.startswith(x.s, F.lit("export ")),
            F.array(ev("import", short, source, grab_opt(x.s, DART_IMPORT, 2)), export(short, "default")),
        ).otherwise(F.array(ev("import", short, source, grab_opt(x.s, DART_IMPORT, 2)))))),
        hits(has(x.s, DART_CLASS), public(klass(class_name), class_name, "class")),
        first_of(
            (is_getter & ~getter.isin(*DART_NOT_FUNCS),
             public(function(getter, 0, F.when(brace, "block").otherwise("line")), getter, "function")),
            (is_getter, none()),
            (is_func, public(function(name, comma_count(params), end), name, "function")),
        ),
        hit((is_getter & ~getter.isin(*DART_NOT_FUNCS)) | is_func, ev("method", pos=AT_LINE)),
        Checked(first_of(
            (code & has(x.s, DART_VAR) & ~var.isin(*DART_NOT_VARS), F.array(ev("variable", var, "nesting"))),
            (code & has(x.s, DART_TYPED_VAR) & ~type_name.isin(*DART_NOT_TYPES) & ~typed.isin(*DART_NOT_VARS),
             F.array(ev("variable", typed, "nesting"))),
        )),
        hit(F.contains(x.t, F.lit(";")), ev("stop", pos=AT_LINE)),
        calls(grab_all(x.t, DART_CALL),
              lambda c: (F.regexp_replace(c, r"^\.\.", "") != "")
              & ~F.regexp_replace(c, r"^\.\.", "").isin(*DART_NOT_CALLS),
              lambda c: F.regexp_replace(c, r"^\.\.", "")),
        brackets(x.t),
    ]


# -------------------------------------------------------------------- Lua
# Fixed values
LUA_REQUIRE = r"""(?:local\s+(\w+)\s*=\s*)?require\s*[\("]\s*(["\']?)([^"\')\s]+)\2\s*["\')]?"""
LUA_FUNC = r"^(?:local\s+)?function\s+([\w.:]+)\s*\(([^)]*)\)"
LUA_FUNC_ASSIGN = r"^(?:local\s+)?([\w.]+)\s*=\s*function\s*\(([^)]*)\)"
LUA_OPEN = r"\b(?:function|if|for|while|do)\b"
LUA_LOCAL = r"^local\s+(\w+)\s*="
LUA_TABLE = r"^(\w+\.\w+)\s*=\s*(?!function\b)"
LUA_GLOBAL = r"^(\w+)\s*=\s*(?!function\b)"
LUA_NOT_VARS = [
    "if", "else", "elseif", "then", "end", "for", "while", "do", "repeat", "until", "return", "local",
    "function", "true", "false", "nil", "and", "or", "not", "in", "break", "goto",
]
LUA_CALL = r'([\w.:]+)\s*[("]'
LUA_NOT_CALLS = [
    "function", "if", "elseif", "for", "while", "return", "local", "and", "or", "not", "end", "do",
    "then", "else", "repeat", "until", "in", "true", "false", "nil",
]
LUA_RETURN = r"^return\s+(\w+)\s*$"


def lua_module(lines: Column) -> Column:
    """[name] of the table returned on the last non-blank line, else []."""
    last = F.element_at(F.filter(F.transform(lines, strip), lambda l: l != ""), -1)
    return F.filter(F.array(grab(last, LUA_RETURN)), lambda n: n != "")


def lua(x: Line) -> list[Column]:
    found = grab_all(x.s, LUA_REQUIRE, 0)

    def require(text):
        module = grab(text, LUA_REQUIRE, 3)
        return ev("import", last_dotted(module), module, grab_opt(text, LUA_REQUIRE, 1))

    opens = F.regexp_count(x.s, F.lit(LUA_OPEN))
    ends = F.regexp_count(x.s, F.lit(r"\bend\b"))
    delta = (opens + F.regexp_count(x.s, F.lit(r"\brepeat\b")) - ends
             - F.regexp_count(x.s, F.lit(r"\buntil\b")))
    module = F.get(x.names, F.lit(0))

    def declared(name, params):
        dotted = F.concat(module, F.lit("."))
        colon = F.concat(module, F.lit(":"))
        event = function(name, comma_count(params))
        member = F.startswith(name, dotted) | F.startswith(name, colon)
        short = F.when(F.contains(name, F.lit(".")), F.regexp_extract(name, r"^[^.]*\.(.*)$", 1)).otherwise(
            F.regexp_extract(name, r"^[^:]*:(.*)$", 1))
        free = ~F.contains(name, F.lit(".")) & ~F.contains(name, F.lit(":")) & ~F.startswith(name, F.lit("_"))
        return (F.when(module.isNotNull() & member, F.array(event, export(short, "function")))
                .when(module.isNull() & free, F.array(event, export(name, "function")))
                .otherwise(F.array(event)))

    local, table, glob = grab(x.s, LUA_LOCAL), grab(x.s, LUA_TABLE), grab(x.s, LUA_GLOBAL)
    code = x.s != ""
    is_definition = has(x.s, r"^(?:local\s+)?function\b") | has(x.s, r"^(?:local\s+)?\w+\s*=\s*function\b")
    return [
        Checked(F.transform(found, require)),
        first_of(
            (has(x.s, LUA_FUNC), declared(grab(x.s, LUA_FUNC), grab(x.s, LUA_FUNC, 2))),
            (has(x.s, LUA_FUNC_ASSIGN), declared(grab(x.s, LUA_FUNC_ASSIGN), grab(x.s, LUA_FUNC_ASSIGN, 2))),
        ),
        Checked(first_of(
            (~code | is_definition, none()),
            (has(x.s, LUA_LOCAL) & ~local.isin(*LUA_NOT_VARS), F.array(ev("variable", local, "module", own="outside block"))),
            (has(x.s, LUA_TABLE), F.when(
                module.isNotNull() & F.startswith(table, F.concat(module, F.lit("."))),
                F.array(ev("variable", table, "module", own="outside block"),
                        export(last_dotted(table), "variable", own="outside block")),
            ).otherwise(F.array(ev("variable", table, "module", own="outside block")))),
            (has(x.s, LUA_GLOBAL) & ~glob.isin(*LUA_NOT_VARS), F.array(ev("variable", glob, "module", own="outside block"))),
        )),
        hit(delta != 0, ev("depth2", n=delta, pos=AT_EOL)),
        F.transform(F.array_repeat(F.lit("{"), opens), lambda b, i: ev("{", pos=i + 1)),
        F.transform(F.array_repeat(F.lit("}"), ends), lambda b, i: ev("}", pos=i + 1000)),
        calls(grab_all(x.t, LUA_CALL), lambda c: ~c.isin(*LUA_NOT_CALLS) & ~c.rlike("^\\p{Nd}+$")),
    ]


# ----------------------------------------------------------------- Elixir
# Fixed values
ELIXIR_IMPORT = r"^\s*(?:import|require|use)\s+([\w.]+)"
ELIXIR_ALIAS = r"^\s*alias\s+([\w.]+)\s*$"
ELIXIR_ALIAS_MANY = r"^\s*alias\s+([\w.]+)\.\{([^}]+)\}"
ELIXIR_DEF = r"^\s*(?:defmacrop|defmacro|defp|def)\s+(\w+[?!]?)\s*(\([^)]*\))?"
ELIXIR_ONE_LINE = r",\s*do:"
ELIXIR_OPENER = (r"^\s*(?:defmodule|defprotocol|defimpl|defmacrop|defmacro|defp|def|if|unless|case|cond|"
                 r"with|for|try|receive|fn)\b")
ELIXIR_MODULE = r"^\s*defmodule\s+([\w.]+)"
ELIXIR_METHOD = r"^\s*(?:defmacrop|defmacro|defp|def)\s+\w+"
ELIXIR_ATTR = r"^\s*@(\w+)\s+"
ELIXIR_PRIVATE = r"^\s*(?:defp|defmacrop)\s+"
ELIXIR_PIPE = r"\|>\s*([\w.]+)"
ELIXIR_NOT_CALLS = [
    "def", "defp", "defmodule", "defmacro", "defmacrop", "defprotocol", "defimpl", "defstruct",
    "defguard", "defguardp", "defdelegate", "defexception", "defoverridable", "if", "unless", "case",
    "cond", "with", "for", "try", "receive", "fn", "quote", "unquote", "raise", "import", "alias",
    "require", "use",
]


def elixir(x: Line) -> list[Column]:
    mod, full, base = grab(x.s, ELIXIR_IMPORT), grab(x.s, ELIXIR_ALIAS), grab(x.s, ELIXIR_ALIAS_MANY)
    many = F.filter(F.transform(F.split(grab(x.s, ELIXIR_ALIAS_MANY, 2), ","), strip), lambda n: n != "")
    name, module = grab(x.t, ELIXIR_DEF), grab(x.t, ELIXIR_MODULE)
    inner = F.regexp_replace(grab(x.t, ELIXIR_DEF, 2), "^[()]+|[()]+$", "")
    one_line = has(x.t, ELIXIR_ONE_LINE)
    opener = has(x.t, ELIXIR_OPENER)
    return [
        Checked(first_of(
            (has(x.s, r"^\s*import\s+[\w.]+"), F.array(ev("import", mod, mod))),
            (has(x.s, ELIXIR_ALIAS_MANY), F.transform(
                many, lambda n: ev("import", F.concat(base, F.lit("."), n), base, n))),
            (has(x.s, ELIXIR_ALIAS), F.array(ev("import", full, full, last_dotted(full)))),
            (has(x.s, ELIXIR_IMPORT), F.array(ev("import", mod, mod))),
        )),
        hit(has(x.t, ELIXIR_MODULE), klass(module), export(module, "class")),
        hits(has(x.t, ELIXIR_DEF), _shown_unless(
            has(x.t, ELIXIR_PRIVATE),
            function(name, comma_count(inner), F.when(one_line, "line").otherwise("block")), name, "function")),
        hit(has(x.t, ELIXIR_METHOD), ev("method", pos=AT_EOL)),
        Checked(hit(has(x.t, ELIXIR_ATTR), ev("variable", F.concat(F.lit("@"), grab(x.t, ELIXIR_ATTR)), "module"))),
        first_of(
            (opener & one_line, none()),
            (opener | has(x.t, r"\bdo\s*$"), F.array(ev("{", pos=1))),
        ),
        hit(has(x.t, r"^\s*end\b"), ev("}", pos=2)),
        calls(grab_all(x.t, DOTTED_CALL), _base_not_in(ELIXIR_NOT_CALLS)),
        calls(grab_all(x.t, ELIXIR_PIPE), _base_not_in(ELIXIR_NOT_CALLS)),
    ]


# -------------------------------------------------------------------- Zig
# Fixed values
ZIG_IMPORT = r'^\s*(?:pub\s+)?const\s+(\w+)\s*=\s*@import\(\s*"([^"]+)"\s*\)'
ZIG_USING = r"^\s*(?:pub\s+)?usingnamespace\s+([\w.]+)\s*;"
ZIG_FN = r"^\s*(?:pub\s+)?(?:export\s+)?(?:inline\s+)?(?:comptime\s+)?fn\s+(\w+)\s*\(([^)]*)\)"
ZIG_FN_START = r"^\s*(?:pub\s+)?(?:export\s+)?(?:inline\s+)?(?:comptime\s+)?fn\s+"
ZIG_FN_NAME = r"^\s*(?:pub\s+)?(?:export\s+)?(?:inline\s+)?(?:comptime\s+)?fn\s+(\w+)"
ZIG_STRUCT = r"^\s*(?:pub\s+)?const\s+(\w+)\s*=\s*(?:packed\s+|extern\s+)?(?:struct|enum|union)"
ZIG_METHOD = r"^\s*(?:pub\s+)?(?:inline\s+)?fn\s+\w+"
ZIG_VAR = r"^\s*(?:pub\s+)?(const|var)\s+(\w+)\s*"
ZIG_NOT_VAR = r"=\s*@import\(|=\s*(?:packed\s+|extern\s+)?(?:struct|enum|union)\b"
ZIG_PUB_FN = r"^\s*pub\s+(?:export\s+)?(?:inline\s+)?(?:comptime\s+)?fn\s+(\w+)"
ZIG_PUB_STRUCT = r"^\s*pub\s+const\s+(\w+)\s*=\s*(?:packed\s+|extern\s+)?(?:struct|enum|union)"
ZIG_PUB_VAR = r"^\s*pub\s+(?:const|var)\s+(\w+)"
ZIG_CALL = r"(?<![.@\w])([\w][\w.]*)\s*\("
ZIG_CHAIN = r"\)\s*\.\s*(\w+)\s*\("
ZIG_BUILTIN = r"(@\w+)\s*\("
ZIG_NOT_CALLS = [
    "fn", "if", "else", "while", "for", "switch", "return", "const", "var", "pub", "struct", "enum",
    "union", "try", "catch", "comptime", "inline", "export", "test", "defer", "errdefer", "unreachable",
]


def zig(x: Line) -> list[Column]:
    source, ns = grab(x.t, ZIG_IMPORT, 2), grab(x.t, ZIG_USING)
    name, struct, declared = grab(x.t, ZIG_FN), grab(x.t, ZIG_STRUCT), grab(x.t, ZIG_FN_NAME)
    opens = F.regexp_count(x.t, F.lit(r"\{"))
    closes = F.regexp_count(x.t, F.lit(r"\}"))
    region = F.when(opens == 0, "next").when(opens <= closes, "line").otherwise("block")
    return [
        Checked(first_of(
            (has(x.t, ZIG_IMPORT),
             F.array(ev("import", F.regexp_replace(source, "[.zig]+$", ""), source, grab(x.t, ZIG_IMPORT)))),
            (has(x.t, ZIG_USING), F.array(ev("import", ns, ns))),
        )),
        hit(has(x.t, ZIG_STRUCT), klass(struct, flag(has(x.t, ZIG_METHOD)))),
        hit(has(x.t, ZIG_FN), function(name, comma_count(grab(x.t, ZIG_FN, 2)))),
        hit(has(x.t, ZIG_METHOD), ev("method", pos=AT_EOL)),
        hit(has(x.t, ZIG_FN_START), ev("region", a=region, pos=AT_DECL)),
        Checked(hit((x.s != "") & has(x.t, ZIG_VAR) & ~x.t.rlike(ZIG_NOT_VAR),
            ev("variable", grab(x.t, ZIG_VAR, 2), "module", own="outside function"))),
        first_of(
            (has(x.t, ZIG_PUB_FN), F.array(export(grab(x.t, ZIG_PUB_FN), "function", own="first"))),
            (has(x.t, ZIG_PUB_STRUCT), F.array(export(grab(x.t, ZIG_PUB_STRUCT), "class", own="first"))),
            (has(x.t, ZIG_PUB_VAR), F.array(export(grab(x.t, ZIG_PUB_VAR), "variable", own="first"))),
        ),
        calls(grab_all(x.t, ZIG_BUILTIN)),
        calls(grab_all(x.t, ZIG_CALL),
              lambda c: ~last_dotted(c).isin(*ZIG_NOT_CALLS) & (c != declared)),
        calls(grab_all(x.t, ZIG_CHAIN), _not_in(ZIG_NOT_CALLS)),
        brackets(x.t),
    ]


# ------------------------------------------------------------------ Shell
# Fixed values
SHELL_SOURCE = r"""^(?:source|\.)\s+(?:["\'](.*?)["\']|(\S+))"""
SHELL_FUNC = r"^(?:function\s+(\w[\w-]*)\s*(?:\(\s*\))?\s*\{?|(\w[\w-]*)\s*\(\s*\)\s*\{?)"
SHELL_ASSIGN = r"^(?:export\s+|readonly\s+|declare\s+(?:-\w+\s+)*)?([A-Za-z_]\w*)="
SHELL_LOCAL = r"^local\s+([A-Za-z_]\w*)="
SHELL_SUBSTITUTION = r"\$\((\w[\w-]*)"
SHELL_BACKTICK = r"`(\w[\w-]*)"


def _shell_name(line: Column) -> Column:
    return F.concat(grab(line, SHELL_FUNC, 1), grab(line, SHELL_FUNC, 2))


def shell_functions(lines: Column) -> Column:
    """Distinct function names of a file, longest first."""
    named = F.filter(F.transform(lines, lambda l: _shell_name(strip(l))), lambda n: n != "")
    return F.transform(
        F.reverse(F.array_sort(F.transform(
            F.array_distinct(named), lambda n: F.struct(F.length(n).alias("size"), n.alias("name"))))),
        lambda p: p["name"])


def shell(x: Line) -> list[Column]:
    quoted = grab(x.s, SHELL_SOURCE, 1)
    path = F.when(quoted != "", quoted).otherwise(grab(x.s, SHELL_SOURCE, 2))
    name = _shell_name(x.s)
    local, var = grab(x.s, SHELL_LOCAL), grab(x.s, SHELL_ASSIGN)
    words = F.concat(F.lit("(?U)\\b("), F.array_join(x.names, "|"), F.lit(")\\b"))
    unknown = lambda c: ~F.array_contains(x.names, c)
    return [
        Checked(hit(has(x.s, SHELL_SOURCE),
            ev("import", last_part(F.regexp_replace(path, "/+$", ""), "/"), path))),
        hit(has(x.s, SHELL_FUNC), function(name, 0), export(name, "function")),
        hit(has(x.s, SHELL_FUNC), ev("region", a="function", pos=AT_DECL)),
        Checked(hit(has(x.s, SHELL_LOCAL), ev("variable", local, "function", own="inside function"))),
        Checked(hit(has(x.s, SHELL_ASSIGN), ev("variable", var, "module", own="outside function"),
            export(var, "variable", own="outside function"))),
        F.when(F.size(x.names) > 0,
               calls(F.regexp_extract_all(x.t, words, F.lit(1)))).otherwise(none()),
        calls(grab_all(x.t, SHELL_SUBSTITUTION), unknown),
        calls(grab_all(x.t, SHELL_BACKTICK), unknown),
        brackets(lex.shell_unquoted(x.t)),
    ]


# -------------------------------------------------------------------- Nim
# Fixed values
NIM_CALLABLES = "proc|func|method|template|macro|iterator|converter"
NIM_IMPORT = r"^import\s+([\w/]+)(?:\s+except\s+(.+))?"
NIM_FROM = r"^from\s+([\w/]+)\s+import\s+(.+)"
NIM_INCLUDE = r"^include\s+([\w/]+)"
NIM_PROC = rf"^({NIM_CALLABLES})\s+(\w+)(\*?)\s*(?:\[.*?\])?\s*\(([^)]*)\)"
NIM_METHOD = rf"^(?:{NIM_CALLABLES})\s+\w+\*?\s*(?:\[.*?\])?\s*\(\s*\w+\s*:\s*(?:var\s+)?(\w+)\b"
NIM_TYPE_LINE = r"^type\s+(.+)"
NIM_TYPE = r"(\w+)(\*?)\s*=\s*(?:ref\s+)?(object|enum|distinct\s+\w+|tuple)"
NIM_VAR = r"^(var|let|const)\s+(\w+)(\*?)\s*(?::\s*[\w\[\], ]+)?(?:\s*=.*)?$"
NIM_VAR_BLOCK = r"^(var|let|const)\s*$"
NIM_BLOCK_ITEM = r"^\s+(\w+)(\*?)\s*(?::\s*[\w\[\], ]+)?(?:\s*=.*)?$"
NIM_CALL = r"(?:(\w+)\.)?(\w+)\s*\("
NIM_NOT_CALLS = [
    "proc", "func", "method", "template", "macro", "iterator", "converter", "if", "elif", "else", "when",
    "while", "for", "case", "of", "import", "from", "include", "type", "var", "let", "const", "return",
    "yield", "discard", "block", "try", "except", "finally", "raise", "defer",
]
NIM_REGION_TYPE, NIM_REGION_VAR = "\u0001", "\u0002"


def nim_marked(text: Column) -> Column:
    """Mark the bodies of ``type`` and ``var``/``let``/``const`` blocks by their indentation."""
    stays = r"(?:(?=\1[ \t])|(?=[ \t]*(?:#[^\n]*)?(?:\n|\z)))"
    head = r"([ \t]*)(?:%s)[ \t]*(?:#[^\n]*)?(?=\n)"
    text = lex.mark_region(text, head % "type", stays, NIM_REGION_TYPE)
    return lex.mark_region(text, head % "var|let|const", stays, NIM_REGION_VAR)


def nim_decl_indents(lines: Column) -> Column:
    """Indentations (as text) at which a block that needs an end is declared."""
    decl = F.filter(
        lines, lambda l: l.rlike(rx_any(rf"^\s*(?:{NIM_CALLABLES})\s|=\s*(?:ref\s+)?(?:object|enum|distinct|tuple)")))
    return F.array_distinct(F.transform(decl, lambda l: indent(l).cast("string")))


def rx_any(pattern: str) -> str:
    return "(?U)" + pattern


def nim(x: Line) -> list[Column]:
    line = x.r  # without its line comment
    s = strip(line)
    in_type = F.startswith(x.d, F.lit(NIM_REGION_TYPE))
    in_var = F.startswith(x.d, F.lit(NIM_REGION_VAR))
    module, included = grab(s, NIM_IMPORT), grab(s, NIM_INCLUDE)
    from_names = F.filter(F.transform(F.split(grab(s, NIM_FROM, 2), ","), strip), lambda n: n != "")
    name = grab(s, NIM_PROC, 2)
    params = grab(s, NIM_PROC, 4)
    groups = F.transform(F.split(params, ";"), lambda g: comma_count(
        F.when(F.contains(g, F.lit(":")), F.substring_index(g, ":", 1)).otherwise(g)))
    count = F.aggregate(groups, F.lit(0), lambda a, g: a + g)
    one_line_type = has(s, NIM_TYPE_LINE)
    body = F.when(one_line_type, strip(grab(s, NIM_TYPE_LINE))).otherwise(s)
    type_name = grab(body, "^" + NIM_TYPE)
    is_type = (one_line_type | in_type) & has(body, "^" + NIM_TYPE)
    depth = indent(x.t)
    nonblank = s != ""
    item, var = grab(x.t, NIM_BLOCK_ITEM), grab(s, NIM_VAR, 2)

    def starred(event, shown, name, kind):
        return F.when(shown == "*", F.array(event, export(name, kind, own="last"))).otherwise(F.array(event))

    def starred_var(name, star):
        event = ev("variable", name, "module", own="function or module")
        return F.when(star == "*", F.array(event, export(name, "variable", own="last outside function"))).otherwise(F.array(event))

    return [
        Checked(first_of(
            (has(s, NIM_FROM), F.transform(from_names, lambda n: ev("import", n, grab(s, NIM_FROM)))),
            (has(s, NIM_IMPORT), F.array(ev("import", last_part(module, "/"), module))),
            (has(s, NIM_INCLUDE), F.array(ev("import", last_part(included, "/"), included))),
        )),
        hits(is_type, starred(klass(type_name, end="indent", own=type_name, b=depth),
                              grab(body, "^" + NIM_TYPE, 2), type_name, "class")),
        hits(has(s, NIM_PROC), starred(
            ev("function", name, "indent", depth, n=count, pos=AT_DECL),
            grab(s, NIM_PROC, 3), name, "function")),
        hit(has(s, NIM_PROC), ev("region", a="function", b=depth, pos=AT_DECL)),
        hit(has(s, NIM_METHOD), ev("member", own=grab(s, NIM_METHOD))),
        Checked(first_of(
            (has(s, NIM_VAR_BLOCK), none()),
            (in_var & (s == ""), none()),
            (in_var & has(x.t, NIM_BLOCK_ITEM), starred_var(item, grab(x.t, NIM_BLOCK_ITEM, 2))),
            (in_var, none()),
            (has(s, NIM_VAR), starred_var(var, grab(s, NIM_VAR, 3))),
        )),
        hit(nonblank, ev("nonblank", pos=AT_EOL)),
        hits(nonblank, F.transform(
            F.filter(x.names, lambda b: b.cast("int") >= depth),
            lambda b: ev("dedent", b=b, pos=AT_CLASS - 1))),
        calls(grab_all(line, NIM_CALL, 0),
              lambda c: ~grab(c, NIM_CALL, 2).isin(*NIM_NOT_CALLS),
              lambda c: F.regexp_replace(c, rx_any(r"\s*\($"), "")),
    ]


# ------------------------------------------------------------------ Scala
# Fixed values
SCALA_IMPORT = r"^import\s+([\w.]+)\.(\{[^}]+\}|_|\w+)"
SCALA_RENAME = r"^(\w+)\s*=>\s*(\w+)"
SCALA_DEF = (r"^(?:(?:private|protected|override|final|abstract|implicit|inline)\s+){0,40}"
             r"def\s+(\w+)\s*(?:\[.*?\])?\s*(?:\((.*?)\))?")
SCALA_CLASS = (r"^(?:(?:private|protected|sealed|abstract|final|implicit|lazy|case)\s+){0,40}"
               r"(class|object|trait|enum)\s+(\w+)")
SCALA_METHOD = (r"^\s+(?:(?:private|protected|override|final|abstract|implicit|inline)\s+){0,40}def\s+\w+")
SCALA_VAR = r"^(?:(?:private|protected|override|final|implicit|lazy)\s+){0,40}(val|var)\s+(\w+)"
SCALA_CALL = r"(?:new\s+)?([\w.]+)\s*\("
SCALA_INFIX = r"\w+\s+(::|\+:|\+\+|::\:)\s+\w+"
SCALA_NOT_CALLS = [
    "if", "else", "for", "while", "match", "case", "return", "yield", "throw", "try", "catch", "finally",
    "class", "trait", "object", "def", "val", "var", "import", "package", "extends", "with", "new",
    "type", "sealed", "abstract", "override", "private", "protected", "implicit", "lazy", "enum",
]


def scala(x: Line) -> list[Column]:
    base, imported = grab(x.s, SCALA_IMPORT), grab(x.s, SCALA_IMPORT, 2)
    inner = F.regexp_replace(imported, "^[{}]+|[{}]+$", "")
    parts = F.filter(F.transform(F.split(inner, ","), strip), lambda p: p != "")

    def part(p):
        renamed = has(p, SCALA_RENAME)
        return ev("import", F.when(renamed, grab(p, SCALA_RENAME)).otherwise(p), base,
                  F.when(renamed, grab(p, SCALA_RENAME, 2)))

    name, class_name, var = grab(x.s, SCALA_DEF), grab(x.s, SCALA_CLASS, 2), grab(x.s, SCALA_VAR, 2)
    brace = F.contains(x.t, F.lit("{"))
    end = F.when(~brace & F.contains(x.s, F.lit("=")), "line").otherwise("block")
    shallow = indent(x.t) <= 2
    return [
        Checked(first_of(
            (has(x.s, SCALA_IMPORT) & F.startswith(imported, F.lit("{")), F.transform(parts, part)),
            (has(x.s, SCALA_IMPORT), F.array(ev("import", imported, base))),
        )),
        hit(has(x.s, SCALA_CLASS), ev("class", class_name, "block", n=0, pos=AT_LINE), export(class_name, "class")),
        hit(has(x.s, SCALA_DEF),
            function(name, nested_comma_count(grab(x.s, SCALA_DEF, 2), "([{", ")]}"), end),
            export(name, "function")),
        hit(has(x.t, SCALA_METHOD), ev("method", pos=AT_DECL)),
        Checked(hits(has(x.s, SCALA_VAR), F.when(
            shallow, F.array(ev("variable", var, "module"), export(var, "variable"))
        ).otherwise(F.array(ev("variable", var, "class"))))),
        calls(grab_all(x.t, SCALA_CALL), _base_not_in(SCALA_NOT_CALLS)),
        calls(grab_all(x.t, SCALA_INFIX)),
        brackets(x.t),
    ]


# ------------------------------------------------------------ Objective-C
# Fixed values
OBJC_ANGLE = r"^#(?:import|include)\s+<([^>]+)>"
OBJC_QUOTE = r'^#(?:import|include)\s+"([^"]+)"'
OBJC_AT = r"^@import\s+([\w.]+)\s*;"
OBJC_METHOD = r"^[+-]\s*\([^)]*\)\s*(\w[\w:]*+(?:\s*+\([^)]*+\)\s*+\w++\s*+\w*+[\w:]*+)*+)"
OBJC_AFTER_RETURN = r"^[+-]\s*\([^)]*\)\s*(.*)"
OBJC_C_FUNC = (
    r"^(?:(?:static|inline|extern|void|int|float|double|char|long|short|unsigned|signed|NSInteger|"
    r"NSUInteger|CGFloat|BOOL|id|instancetype|NSString|NSArray|NSDictionary|__attribute__\([^)]*+\))\s++(?=\w))*+"
    r"(?:\w++(?:\s*+\*\s++|\s++)(?=\w))*+(\w++)\s*+\(([^)]*+)\)\s*+\{")
OBJC_NOT_FUNCS = ["if", "for", "while", "switch", "return", "sizeof"]
OBJC_INTERFACE = r"^@(?:interface|implementation)\s+(\w+)\s*(?:\((\w*)\))?"
OBJC_PROTOCOL = r"^@protocol\s+(\w+)"
OBJC_SIGNATURE = r"^\s*[+-]\s*\("
OBJC_PROPERTY = r"^@property\s*\([^)]*\)\s+[\w\s]+\s*\*?\s*(\w+)\s*;"
OBJC_STATIC = r"^static\s+[\w\s]+\s*\*\s*(?:const\s+)?(\w+)\s*="
OBJC_SEND = r"\[(\w+)\s+(\w+)"
OBJC_CALL = r"(\w+)\s*\("
OBJC_NOT_CALLS = [
    "if", "for", "while", "switch", "return", "sizeof", "typeof", "static", "extern", "const", "void",
    "int", "float", "double", "char", "long", "short", "unsigned", "signed", "struct", "enum", "union",
    "typedef", "case", "default", "else",
]


def objc(x: Line) -> list[Column]:
    angle, quote, at = grab(x.s, OBJC_ANGLE), grab(x.s, OBJC_QUOTE), grab(x.s, OBJC_AT)
    rest = F.regexp_replace(
        strip(F.substring_index(grab(x.s, OBJC_AFTER_RETURN), "{", 1)), ";+$", "")
    words = F.filter(F.split(F.regexp_replace(rest, r"\([^)]*\)", ""), "(?U)\\s+"), lambda w: w != "")
    selector = F.array_join(F.transform(words, lambda w, i: (
        F.when(F.endswith(w, F.lit(":")), w)
        .when(F.contains(w, F.lit(":")), F.concat(F.substring_index(w, ":", 1), F.lit(":")))
        .when(i == 0, w).otherwise(F.lit("")))), "")
    colons = F.length(selector) - F.length(F.replace(selector, F.lit(":"), F.lit("")))
    is_method = has(x.s, OBJC_METHOD)
    c_name, c_params = grab(x.s, OBJC_C_FUNC), grab(x.s, OBJC_C_FUNC, 2)
    is_c = F.contains(x.s, F.lit("(")) & F.contains(x.s, F.lit("{")) & has(x.s, OBJC_C_FUNC)
    c_count = F.when(strip(c_params) == "void", 0).otherwise(comma_count(c_params))
    is_interface = has(x.s, OBJC_INTERFACE)
    category = grab(x.s, OBJC_INTERFACE, 2)
    base = F.when(is_interface, grab(x.s, OBJC_INTERFACE)).otherwise(grab(x.s, OBJC_PROTOCOL))
    class_name = F.when(is_interface & (category != ""), F.concat(base, F.lit("("), category, F.lit(")"))).otherwise(base)
    hidden = lambda n: F.startswith(strip(F.regexp_replace(n, "^[+-]+", "")), F.lit("_"))
    return [
        Checked(first_of(
            (has(x.s, OBJC_ANGLE), F.array(ev("import", last_part(angle, "/"), angle))),
            (has(x.s, OBJC_QUOTE), F.array(ev("import", last_part(quote, "/"), quote))),
            (has(x.s, OBJC_AT), F.array(ev("import", at, at))),
        )),
        hit(is_interface | has(x.s, OBJC_PROTOCOL), klass(class_name, end="stop")),
        first_of(
            (is_method, _shown_unless(
                hidden(selector),
                function(selector, colons, F.when(F.contains(x.t, F.lit("{")), "block").otherwise("near block")),
                selector, "function")),
            (is_c & ~c_name.isin(*OBJC_NOT_FUNCS),
             _shown_unless(hidden(c_name), function(c_name, c_count), c_name, "function")),
        ),
        hit(has(x.t, OBJC_SIGNATURE), ev("method", pos=AT_EOL)),
        Checked(first_of(
            (has(x.s, OBJC_PROPERTY), F.array(ev("variable", grab(x.s, OBJC_PROPERTY), "class"))),
            (has(x.s, OBJC_STATIC), F.array(ev("variable", grab(x.s, OBJC_STATIC), "module"),
                                            export(grab(x.s, OBJC_STATIC), "variable"))),
        )),
        hit(has(x.s, r"^@end\b"), ev("stop", pos=AT_LINE)),
        calls(grab_all(x.t, OBJC_SEND, 0), None, lambda c: F.concat(
            F.lit("["), grab(c, OBJC_SEND, 1), F.lit(" "), grab(c, OBJC_SEND, 2), F.lit("]"))),
        calls(grab_all(x.t, OBJC_CALL), _not_in(OBJC_NOT_CALLS)),
        brackets(x.t),
    ]


# ----------------------------------------------------------------- Erlang
# Fixed values
ERLANG_MODULE = r"^-module\((\w+)\)\."
ERLANG_INCLUDE = r'^-include(?:_lib)?\("([^"]+)"\)\.'
ERLANG_IMPORT = r"^-import\((\w+),\s*\[([^\]]*)\]\)\."
ERLANG_ARITY = r"(\w+)/(\d+)"
ERLANG_FUNC = r"^(\w+)\(([^)]*)\)\s*(?:when\s+.*)?->"
ERLANG_NOT_FUNCS = ["if", "case", "receive", "try", "begin", "fun", "query"]
ERLANG_DEFINE = r"^-define\((\w+)"
ERLANG_EXPORT = r"^-export\(\[([^\]]*)\]\)\."
ERLANG_EXPORT_ALL = r"^-compile\(export_all\)\."
ERLANG_REMOTE = r"(\w+:\w+)\s*\("
ERLANG_LOCAL = r"(?<![\w:])(\w+)\s*\("
ERLANG_NOT_CALLS = [
    "if", "case", "receive", "try", "begin", "fun", "end", "when", "of", "catch", "after", "query",
    "not", "and", "or", "xor", "band", "bor", "bxor", "bsl", "bsr", "div", "rem", "spec", "type",
    "export", "module", "import", "include", "include_lib", "define", "ifdef", "ifndef", "else",
    "endif", "undef", "record", "behaviour", "behavior", "callback", "compile",
]


def erlang(x: Line) -> list[Column]:
    path = grab(x.s, ERLANG_INCLUDE)
    directive = F.startswith(x.s, F.lit("-"))
    name = grab(x.s, ERLANG_FUNC)
    return [
        Checked(first_of(
            (has(x.s, ERLANG_MODULE), F.array(ev("import", grab(x.s, ERLANG_MODULE)))),
            (has(x.s, ERLANG_INCLUDE), F.array(ev("import", last_part(path, "/"), path))),
            (has(x.s, ERLANG_IMPORT), F.transform(
                grab_all(grab(x.s, ERLANG_IMPORT, 2), ERLANG_ARITY),
                lambda n: ev("import", n, grab(x.s, ERLANG_IMPORT)))),
        )),
        hit(~directive & has(x.s, ERLANG_FUNC) & ~name.isin(*ERLANG_NOT_FUNCS),
            function(name, nested_comma_count(grab(x.s, ERLANG_FUNC, 2), "([{<", ")]}>"), "stop", own="clauses")),
        hit(x.t.rlike("[.;]\\s*$"), ev("stop", pos=AT_LINE)),
        Checked(hit(has(x.s, ERLANG_DEFINE), ev("variable", grab(x.s, ERLANG_DEFINE), "module"))),
        first_of(
            (has(x.s, ERLANG_EXPORT_ALL), F.array(export("__export_all__", "function", own="once at line 0"))),
            (has(x.s, ERLANG_EXPORT), F.transform(
                grab_all(grab(x.s, ERLANG_EXPORT), ERLANG_ARITY), lambda n: export(n, "function"))),
        ),
        hits(~directive, calls(grab_all(x.t, ERLANG_REMOTE))),
        hits(~directive, calls(grab_all(x.t, ERLANG_LOCAL), _not_in(ERLANG_NOT_CALLS))),
    ]


# --------------------------------------------------------------- Solidity
# Fixed values
SOL_IMPORT_PLAIN = r"""import\s+["']([^"']+)["']\s*;"""
SOL_IMPORT_NAMED = r"""import\s*\{([^}]+)\}\s*from\s*["']([^"']+)["']\s*;"""
SOL_IMPORT_STAR = r"""import\s*\*\s+as\s+(\w+)\s+from\s*["']([^"']+)["']\s*;"""
SOL_IMPORT_ALIAS = r"""import\s+["']([^"']+)["']\s+as\s+(\w+)\s*;"""
SOL_CONTRACT = r"^(?:abstract\s+)?(?:contract|interface|library)\s+(\w+)"
SOL_FUNCTION = r"^(\s*)function\s+(\w+)\s*\(([^)]*)\)"
SOL_SPECIAL = r"^\s*(constructor|fallback|receive)\s*\(([^)]*)\)"
SOL_VAR = (r"^\s+(?:mapping\s*\([^)]*\)|[a-zA-Z_]\w*(?:\[\])*)\s+"
           r"(?:(?:public|private|internal|constant|immutable|override)\s+){0,40}(\w+)\s*[;=]")
SOL_NOT_VARS = [
    "returns", "return", "public", "private", "internal", "external", "view", "pure", "payable",
    "override", "virtual", "memory", "storage", "calldata", "true", "false",
]
SOL_CALL = r"(?:emit\s+)?(\b[a-zA-Z_]\w*+(?:\.\w++)*+)\s*+\("
SOL_NOT_CALLS = [
    "if", "for", "while", "require", "assert", "revert", "function", "contract", "interface", "library",
    "mapping", "returns", "return", "new", "delete", "type", "catch", "try",
]
SOL_FOLD_DECL = (r"^\s*function\s+\w+\s*\([^)]*\)|^\s*(?:constructor|fallback|receive)\s*\([^)]*\)"
                 r"|import\s*\{[^}]+\}\s*from\s*[\"'][^\"']+[\"']\s*;")
SOL_FOLD_VAR = SOL_VAR


def solidity(x: Line) -> list[Column]:
    named_source = grab(x.d, SOL_IMPORT_NAMED, 2)
    names = F.filter(F.transform(F.split(grab(x.d, SOL_IMPORT_NAMED), ","), strip), lambda n: n != "")

    def named(n):
        parts = F.split(n, "\\s+as\\s+")
        return ev("import", strip(F.element_at(parts, 1)), named_source,
                  F.when(F.size(parts) > 1, strip(F.get(parts, F.lit(1)))))

    contract, name, special = grab(x.t, SOL_CONTRACT), grab(x.d, SOL_FUNCTION, 2), grab(x.d, SOL_SPECIAL)
    var = grab(x.v, SOL_VAR)
    raw_method = has(x.r, r"^\s*function\s+\w+\s*\(") | has(x.r, r"^\s*(?:constructor|fallback|receive)\s*\(")
    return [
        Checked(first_of(
            (has(x.t, SOL_IMPORT_STAR),
             F.array(ev("import", "*", grab(x.t, SOL_IMPORT_STAR, 2), grab(x.t, SOL_IMPORT_STAR)))),
            (has(x.d, SOL_IMPORT_NAMED), F.transform(names, named)),
            (has(x.t, SOL_IMPORT_ALIAS),
             F.array(ev("import", "*", grab(x.t, SOL_IMPORT_ALIAS), grab(x.t, SOL_IMPORT_ALIAS, 2)))),
            (has(x.t, SOL_IMPORT_PLAIN), F.array(ev("import", "*", grab(x.t, SOL_IMPORT_PLAIN)))),
        )),
        hit(has(x.t, SOL_CONTRACT), klass(contract, flag(raw_method), end="block or eof"), export(contract, "class")),
        first_of(
            (has(x.d, SOL_FUNCTION),
             F.array(function(name, comma_count(grab(x.d, SOL_FUNCTION, 3)), "block or eof"), export(name, "function"))),
            (has(x.d, SOL_SPECIAL),
             F.array(function(special, comma_count(grab(x.d, SOL_SPECIAL, 2)), "block or eof"))),
        ),
        hit(raw_method, ev("method", pos=AT_DECL)),
        Checked(hit(has(x.v, SOL_VAR) & ~var.isin(*SOL_NOT_VARS), ev("variable", var, "module"))),
        calls(grab_all(x.t, SOL_CALL), _base_not_in(SOL_NOT_CALLS)),
        brackets(x.r),
    ]


# ------------------------------------------------- JavaScript / TypeScript
JS_NAME = r"[A-Za-z_$][\w$]*"
JS_EXPORT = r"^export\s+(?:default\s+)?"
JS_FUNCTION = rf"^(?:export\s+(?:default\s+)?)?(?:async\s+)?function\s+({JS_NAME})\s*(?:<[^(]*>)?\s*\("
JS_BOUND = (rf"^(?:export\s+)?(?:const|let|var)\s+({JS_NAME})\s*(?::[^=]*(?:=>[^=]*)?)?=\s*"
            rf"(?:async\s+)?(?:function\b(?!\s*\*)|(?:<[^(]*>\s*)?\(|{JS_NAME}\s*=>)")
JS_ARROW = r"=>"
JS_CLASS = rf"^(?:export\s+(?:default\s+)?)?class\s+({JS_NAME})"
JS_VARIABLE = rf"^(?:export\s+)?(?:const|let|var)\s+({JS_NAME}|\{{[^}}]*\}}|\[[^\]]*\])"
JS_METHOD = (rf"^(?:(?:public|private|protected|static|async|override|readonly|get|set)\s+){{0,40}}\*?\s*"
             rf"(#?{JS_NAME})\s*(?:<[^(]*>)?\s*\(")
JS_METHOD_HEAD = (rf"^(?:(?:public|private|protected|static|async|override|readonly|get|set)\s+){{0,40}}\*?\s*"
                  rf"#?{JS_NAME}\s*(?:<[^(]*>)?\s*(?::[^{{]*)?\{{")
JS_PARAMS = rf"\(({lex.nested('(', 4)})\)"
JS_REST = rf"(?:[^,;()\[\]{{}}<]++|<[\w\s,.|\[\]]*+>|<|\({lex.nested('([{', 4)}\)|\[{lex.nested('([{', 4)}\]|\{{{lex.nested('([{', 4)}\}})*+"
JS_BINDING = rf"({JS_NAME}|\{{[^}}]*\}}|\[[^\]]*\])"
JS_DECLARATOR = rf"(?:^(?:export\s+)?(?:const|let|var)\b|\G(?!^),)\s*+{JS_BINDING}{JS_REST}"
JS_FURTHER = rf"^,\s*{JS_BINDING}\s*(?::[^=]*(?:=>[^=]*)?)?=?\s*(.*)$"
JS_VALUE_FUNCTION = rf"^(?:async\b\s*)?(?:function\b(?!\s*\*)|{JS_NAME}\s*=>|(?:<[^(]*>\s*)?\({lex.nested('(', 4)}\)\s*(?::[^=]*)?=>)"
JS_VALUE_REQUIRE = r"""^require\s*\(\s*["']([^"']*)["']"""
JS_LINK = rf"(?:\A[\s)\]}}]*+|\G(?!\A))\s*+(?:\?\.|\.)#?+([\w$]++(?:\??\.[\w$]++)*+)\s*+(\({lex.nested('([{', 4)}\)|\()"
JS_IMPORT = r"""^import\s+(?:type\s+)?([^"']*?)\s*\bfrom\s*["']([^"']*)["']"""
JS_IMPORT_BARE = r"""^import\s*["']([^"']*)["']"""
JS_REQUIRE = rf"""^(?:const|let|var)\s+({JS_NAME}|\{{[^}}]*\}})\s*=\s*require\s*\(\s*["']([^"']*)["']"""
JS_CALL = rf"(?<![\w$.#])((?:{JS_NAME}+)(?:(?:\?\.|\.)#?[\w$]++)*+)\s*+(?:<[\w\s,.\[\]|]*+>)?+\("
JS_CHAINED_CALL = r"(?:(?<=[)\]\"])\s*|^\s*)(?:\?\.|\.)([\w$]++(?:\.[\w$]++)*+)\s*+\("
JS_NEW = rf"\bnew\s+({JS_NAME}+(?:\.[\w$]++)*+)\s*+(?:<[^()]*>)?\("
JS_NOT_CALLS = [
    "if", "for", "while", "switch", "catch", "function", "return", "typeof", "await", "async", "super",
    "import", "constructor", "with", "void", "delete", "throw", "yield", "in", "of", "do", "else", "case", "new",
]


def _starts(s: Column, *words: str) -> Column:
    """Whether ``s`` begins with one of ``words``: what a pattern needs to match is looked for before it is tried."""
    out = F.startswith(s, F.lit(words[0]))
    for word in words[1:]:
        out = out | F.startswith(s, F.lit(word))
    return out


def _holds(s: Column, *parts: str) -> Column:
    """Whether all of ``parts`` occur in ``s``."""
    out = F.contains(s, F.lit(parts[0]))
    for part in parts[1:]:
        out = out & F.contains(s, F.lit(part))
    return out


def javascript_flat(statement: Column) -> Column:
    """A statement without what stands in parentheses."""
    flat = statement
    for _ in range(3):
        flat = F.regexp_replace(flat, r"\([^()]*\)", "")
    return F.when(_holds(statement, "(", ")"), flat).otherwise(statement)


def _javascript_further(s: Column) -> Column:
    """``, b = 2, f = (x) => x`` after the first declarator: name and value; for statements that ``_declares``."""
    return F.transform(
        F.slice(grab_all(s, JS_DECLARATOR, 0), 2, 1_000_000),
        lambda d: F.struct(grab(d, JS_FURTHER).alias("name"), grab(d, JS_FURTHER, 2).alias("value")))


def _declares(s: Column) -> Column:
    return _starts(s, "const", "let", "var", "export")


def _javascript_imports(s: Column) -> list[Checked]:
    """The imports of a statement, and those of its further declarators."""
    clause, source = grab(s, JS_IMPORT), grab(s, JS_IMPORT, 2)
    default = F.regexp_extract(clause, rf"^({JS_NAME})\s*(?:,|$)", 1)
    star = F.regexp_extract(clause, rf"\*\s*as\s+({JS_NAME})", 1)
    specs = F.filter(
        F.transform(F.split(F.regexp_extract(clause, r"\{([^}]*)\}", 1), ","),
                    lambda p: strip(F.regexp_replace(p, r"^\s*type\s+", ""))), lambda p: p != "")
    imported = F.concat(
        hit(default != "", ev("import", default, source)),
        hit(star != "", ev("import", "*", source, star)),
        F.transform(specs, lambda p: ev(
            "import", F.regexp_extract(p, r"^([\w$]+)", 1), source,
            F.nullif(F.regexp_extract(p, r"\sas\s+([\w$]+)$", 1), F.lit("")))),
    )
    more_imports = F.transform(
        F.filter(_javascript_further(s), lambda d: has(d["value"], JS_VALUE_REQUIRE)),
        lambda d: ev("import", d["name"], grab(d["value"], JS_VALUE_REQUIRE), own="top"))
    return [
        Checked(hits(_starts(s, "import", "const", "let", "var"), first_of(
            (has(s, JS_IMPORT_BARE), F.array(ev("import", "*", grab(s, JS_IMPORT_BARE), own="top"))),
            (has(s, JS_IMPORT), imported),
            (has(s, JS_REQUIRE), F.array(ev("import", grab(s, JS_REQUIRE), grab(s, JS_REQUIRE, 2), own="top"))),
        ))),
        Checked(hits(_declares(s) & _holds(s, ",", "require"), more_imports)),
    ]


def _javascript_brackets(flat: Column) -> Column:
    return hits(_holds(flat, "{") | _holds(flat, "}"), brackets(flat))


def javascript_imports(x: Line) -> list[Column]:
    """The rules that imports need: their own, and the brackets that tell nesting."""
    return [*_javascript_imports(x.v), _javascript_brackets(x.r)]


def javascript(x: Line) -> list[Column]:
    flat = x.r  # statements over several lines stand on their first one; calls keep their own lines in x.t
    flat_s = strip(flat)
    s = x.v  # top-level statements may be indented; nesting decides
    declares, names_function = _declares(s), _starts(s, "function", "async", "export")

    def n_params(listed):
        return nested_comma_count(F.regexp_replace(listed, r",\s*$", ""), "([{", ")]}")

    params = n_params(grab(s, JS_PARAMS))
    fn = F.when(names_function, grab(s, JS_FUNCTION)).otherwise(F.lit(""))
    bound, klass_name, var = grab(s, JS_BOUND), grab(s, JS_CLASS), grab(s, JS_VARIABLE)
    value = F.regexp_extract(s, r"=\s*((?:async\s+)?(?:function|\(|<|[\w$]+\s*=>).*)$", 1)
    is_bound = declares & has(s, JS_BOUND) & (
        has(s, r"=\s*(?:async\s+)?function\b")
        | F.regexp_replace(flat_s, r"^.*?[^=!<>]=\s*(?=[^=>])", "").rlike(r"^(?:async\s*)?(?:<[^>]*>\s*)?(?::[^=]*)?(?:[\w$]+\s*)?=>"))
    arrow_params = F.when(
        has(s, rf"=\s*(?:async\s+)?{JS_NAME}\s*=>"), F.lit(0)
    ).otherwise(n_params(F.regexp_extract(value, JS_PARAMS, 1)))
    bound_end = (F.when(s.rlike(r"=>\s*\{|=\s*(?:async\s+)?function\b"), "block")
                 .when(s.rlike(r"=>\s*\(?\s*$"), "stop").otherwise("line"))
    method = grab(s, JS_METHOD)
    is_method = (_holds(s, "(") & _holds(flat, "{") & has(s, JS_METHOD) & ~method.isin(*[k for k in JS_NOT_CALLS if k != "constructor"])
                 & flat_s.rlike(JS_METHOD_HEAD))
    not_method_call = F.when(is_method, method).otherwise(F.lit(""))

    imports, more_imports = _javascript_imports(s)
    exported = F.filter(
        F.transform(F.split(F.regexp_extract(s, r"^export\s*(?:type\s*)?\{([^}]*)\}", 1), ","),
                    lambda p: F.regexp_extract(strip(p), r"^(?!default\b)([\w$]+)", 1)), lambda p: p != "")
    kind = F.when(has(s, r"^export\s+default\b"), "default")
    default_name = F.regexp_extract(s, rf"^export\s+default\s+({JS_NAME})\s*;?\s*$", 1)
    # what every call of a line is compared with, once for the line
    made = F.when(_holds(x.t, "new"), F.array_distinct(grab_all(x.t, JS_NEW))).otherwise(F.array().cast("array<string>"))
    own = F.struct(made.alias("made"), not_method_call.alias("method"), fn.alias("fn"))

    def called(k):
        return calls(grab_all(x.t, JS_CALL), lambda c: (
            ~c.isin(*JS_NOT_CALLS) & (c != k["method"]) & (c != k["fn"]) & ~F.array_contains(k["made"], c)), spelled)

    further = _javascript_further(s)
    makes_function = lambda d: has(d["value"], JS_VALUE_FUNCTION)
    more_functions = F.transform(F.filter(further, makes_function), lambda d: function(
        d["name"], F.when(has(d["value"], rf"^(?:async\s+)?{JS_NAME}\s*=>"), F.lit(0)).otherwise(n_params(grab(d["value"], JS_PARAMS))),
        # a block left open is the last declarator's, and the match of its value stops before the bracket
        F.when(d["value"].rlike(r"=>\s*$|^(?:async\s+)?function\b[^=]*\)\s*$"), "block").otherwise("line"), own="top"))
    more_variables = F.transform(
        F.filter(further, lambda d: ~makes_function(d) & ~has(d["value"], r"^class\b")), lambda d: ev("variable", d["name"], "module", own="top"))

    # calls chained to what earlier lines began count where the chain starts
    linked = _holds(x.t, ".") & x.t.rlike(r"^[\s)\]}]*+(?:\?\.|\.)(?!\.)")
    closed = F.when(_starts(x.s, ")", "]", "}"), F.length(F.regexp_replace(F.regexp_extract(x.t, r"^([\s)\]}]*+)", 1), r"\s+", ""))).otherwise(0)
    nested = F.regexp_replace(x.t, r"[^(\[{)\]}]+", "")
    chain = F.struct(linked.alias("linked"), closed.alias("closed"), nested.alias("nested"))

    def chained(k):
        net = 2 * F.length(F.translate(k["nested"], ")]}", "")) - F.length(k["nested"])
        links = F.transform(grab_all(x.t, JS_LINK), lambda c: ev("call", F.replace(c, F.lit("?."), F.lit(".")), own="chain", n=k["closed"]))
        rest = F.when(k["linked"], F.regexp_replace(x.t, JS_LINK, "$2")).otherwise(x.t)
        return joined(
            hits(k["linked"], links),
            hits(_holds(x.t, ".", "("), calls(grab_all(rest, JS_CHAINED_CALL))),
            _javascript_brackets(flat),
            hit(x.s != "", ev("row", a=F.when(~k["linked"] & (k["closed"] == 0), "start"), n=net, pos=AT_EOL)),
            hit(net + k["closed"] > 0, ev("row", a="start", n=0, pos=AT_EOL + 1)),  # what follows a bracket left open
        )

    def spelled(c):
        return F.regexp_replace(F.replace(c, F.lit("?."), F.lit(".")), r"^(this|super)\.", "")

    return [
        imports,
        more_imports,
        hit(_starts(s, "class", "export") & has(s, JS_CLASS), klass(klass_name, flag(F.lit(False)), own="top"),),
        first_of(
            (names_function & has(s, JS_FUNCTION), F.array(function(fn, params, own="top"))),
            (is_bound, F.array(function(bound, arrow_params, bound_end, own="top"))),
            (is_method, F.array(function(method, params, own="member"))),
        ),
        Checked(hit(declares & has(s, JS_VARIABLE) & ~is_bound & ~has(s, r"^[^,]*?=\s*class\b"), ev("variable", var, "module", own="top"))),
        Checked(hits(declares & _holds(s, ","), more_variables)),
        hits(declares & _holds(s, ","), more_functions),
        hits(_starts(s, "export"), first_of(
            (has(s, r"^export\b") & has(s, JS_FUNCTION),
             F.array(ev("export", fn, F.coalesce(kind, F.lit("function")), own="top"))),
            (has(s, r"^export\b") & has(s, JS_CLASS),
             F.array(ev("export", klass_name, F.coalesce(kind, F.lit("class")), own="top"))),
            (has(s, r"^export\s+(?:const|let|var)\b"), F.concat(
                F.array(ev("export", var, "variable", own="top")),
                F.transform(further, lambda d: ev("export", d["name"], "variable", own="top")))),
            (has(s, r"^export\s*(?:type\s*)?\{"), F.transform(exported, lambda n: ev("export", n, "variable", own="top"))),
            ((default_name != "") & ~default_name.isin("function", "class", "async", "null", "true", "false"),
             F.array(ev("export", default_name, "default", own="top"))),
        )),
        hit(_starts(s, ")"), ev("stop", pos=AT_LINE)),
        hits(_holds(x.t, "("), let(own, called)),
        let(chain, chained),
    ]


RULES = {
    "go": go, "rust": rust, "java": java, "cpp": cpp, "ruby": ruby, "php": php, "swift": swift,
    "kotlin": kotlin, "dart": dart, "lua": lua, "elixir": elixir, "zig": zig, "shell": shell,
    "nim": nim, "scala": scala, "objc": objc, "erlang": erlang, "solidity": solidity,
    "javascript": javascript,
}

# Languages whose rules look at cleaned lines alone and find nothing in a blank one.
NOTHING_IN_BLANK = {"ruby", "php", "swift", "kotlin", "dart", "lua", "elixir", "zig", "shell", "scala", "objc", "erlang"}

# Languages whose imports need few of their rules.
IMPORT_RULES = {"javascript": javascript_imports}
