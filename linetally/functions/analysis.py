r"""Per-file text measures that do not need the lexemes, as column expressions.

These read valid UTF-8 text. Java's ``\s`` is ASCII, so the patterns that must accept
every Unicode space use the White_Space property.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linetally.functions.paths import extension_of
from linetally.functions.text import without_final_newline

_WS = r"\p{IsWhite_Space}"
_IDENT = r"\w"  # ASCII letters, digits and ``_``

# Words that add one to the line-based complexity when a space stands on
# both sides, and signs that add one anywhere.
KEYWORDS = ["if", "for", "while", "case", "catch", "try", "except"]
SIGNS = ["&&", "||", "?:"]
# Words that, followed by a space, start a function.
FUNCTION_WORDS = ["def", "function", "fn"]
# To-do words of the line-based measure.
TODO_WORDS = ["todo", "fixme"]
# Patterns for names, docstrings and type hints.
FUNCTION_NAME = rf"(?:fn|def|function){_WS}+(\w+)"
CLASS_NAME = rf"class{_WS}+(\w+)"
DOCSTRING = rf'(?md)^[{_WS}&&[^\n]]*+(?:///|#|""")'
TYPE_HINT = rf"(?::|->){_WS}*+[a-zA-Z_]"

# Comments and literals of .rs files. A lone quote is a lifetime, not a string.
RUST_NOISE = (
    r"//[^\n]*+|/\*[\s\S]*?(?:\*/|\z)"
    r'|\bb?r##"[\s\S]*?(?:"##|\z)|\bb?r#"[\s\S]*?(?:"#|\z)|\bb?r"[^"]*+(?:"|\z)'
    r'|"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+(?:"|\\?\z)'
    r"|'(?:\\.[^'\n]*+|[^'\\\n])'"
)
# A definition has a body: parameters and result hold no ``;`` outside of brackets.
RUST_FUNCTION = r"\bfn\s+([A-Za-z0-9_]+)[^;{\[]*+(?:\[[^\]]*+\][^;{\[]*+)*+\{"


def _any(words: list[str]) -> str:
    return "|".join(words)


def is_ext(path: Column, *extensions: str) -> Column:
    """Case-sensitive extension test, false when there is no extension."""
    return F.coalesce(extension_of(path).isin(*extensions), F.lit(False))


def spaced_lines(content: Column) -> Column:
    """The text with one space on both sides of every line."""
    inner = F.regexp_replace(without_final_newline(content), "\r?\n", " \n ")
    return F.concat(F.lit(" "), inner, F.lit(" "))


def keyword_complexity(spaced: Column) -> Column:
    """Line-based complexity. A space already taken by a function word or by the keyword
    before cannot serve a second keyword."""
    signs = "|".join(s.replace("|", r"\|").replace("?", r"\?") for s in SIGNS)
    firsts = "".join(dict.fromkeys(w[0] for w in KEYWORDS))
    rests = "|".join(f"(?<={w[0]}){w[1:]}" for w in KEYWORDS)
    taken = rf"(?<!(?:{_any(FUNCTION_WORDS)}) (?:{_any(KEYWORDS)}) )"
    pattern = rf"(?i) [{firsts}](?:{rests}) {taken}|{signs}"
    return F.regexp_count(spaced, F.lit(pattern)).cast("double")


def function_words(spaced: Column) -> Column:
    words = _any(FUNCTION_WORDS)
    pattern = rf"(?i)(?:{words}) (?<![{_IDENT}](?:{words}) )"
    return F.regexp_count(spaced, F.lit(pattern)).cast("bigint")


def rust_function_names(content: Column) -> Column:
    """Names of functions defined (with a body) in Rust source, as an array.

    A pattern on comment-free and literal-free text stands in for a syntax tree.
    """
    bare = F.regexp_replace(content, RUST_NOISE, " ")
    return F.regexp_extract_all(bare, F.lit(RUST_FUNCTION), F.lit(1))


def functions_count(path: Column, content: Column, spaced: Column) -> Column:
    return (
        F.when(is_ext(path, "rs"), F.size(rust_function_names(content)))
        .otherwise(function_words(spaced))
        .cast("bigint")
    )


def todo_words(content: Column) -> Column:
    words = _any(TODO_WORDS)
    pattern = rf"(?i)(?:{words})(?![{_IDENT}])(?<![{_IDENT}](?:{words}))"
    return F.regexp_count(content, F.lit(pattern)).cast("bigint")


def docstring_count(path: Column, content: Column) -> Column:
    found = F.regexp_count(content, F.lit(DOCSTRING))
    return F.when(is_ext(path, "rs", "py"), found).otherwise(F.lit(0)).cast("bigint")


def typehint_count(path: Column, content: Column) -> Column:
    found = F.regexp_count(content, F.lit(TYPE_HINT))
    return F.when(is_ext(path, "rs", "py"), found).otherwise(F.lit(0)).cast("bigint")


def naming_violations(path: Column, content: Column) -> Column:
    """``ARRAY<STRUCT<kind, name, rule>>``: function names of .rs/.py files that are not
    snake_case, and class names of any file that do not start with a capital.

    The words have no left boundary (``undef x`` names a function), and extensions are
    compared case-sensitively.
    """

    def broken(pattern: str, allowed: str, kind: str, rule: str) -> Column:
        names = F.regexp_extract_all(content, F.lit(pattern), F.lit(1))
        bad = F.filter(names, lambda n: ~n.rlike(allowed))
        return F.transform(bad, lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name"), F.lit(rule).alias("rule")))

    none = F.array().cast("array<struct<kind:string,name:string,rule:string>>")
    functions = broken(FUNCTION_NAME, "^[a-z0-9_]*$", "Function", "snake_case")
    classes = broken(CLASS_NAME, "^[A-Z]", "Class", "PascalCase")
    return F.concat(F.when(is_ext(path, "rs", "py"), functions).otherwise(none), classes)


def defined_names(path: Column, content: Column) -> Column:
    """Function names defined in a file (array, with repeats)."""
    named = F.regexp_extract_all(content, F.lit(FUNCTION_NAME), F.lit(1))
    return F.when(is_ext(path, "rs"), rust_function_names(content)).otherwise(named)


def identifiers(content: Column) -> Column:
    return F.regexp_extract_all(content, F.lit(r"\w+"), F.lit(0))


def snake_case(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "(?<!^)([A-Z])", "_$1"))


def pascal_case(name: Column) -> Column:
    parts = F.transform(
        F.split(name, "_"),
        lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30)),
    )
    return F.array_join(parts, "")


def rename_suggestion(name: Column, rule: Column) -> Column:
    return F.when(rule == "snake_case", snake_case(name)).otherwise(pascal_case(name))
