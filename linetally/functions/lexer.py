r"""Line, complexity, TODO and secret counters from one pass of lexemes.

A file is cut into a small number of *chunks*: whole comments, whole quoted strings,
and runs of plain code between them. Cutting at comment and quote openers only (not at
every word) keeps the array short, so memory and time follow the number of comments
and strings rather than the number of characters. The counters then come from three
short derived texts:

* the skeleton: comment text collapses to ``c``, code and string text to ``x``, newlines
  stay, which makes the line kinds countable;
* the code text: the code chunks alone;
* the note text: the comment chunks alone.

Rules worth knowing: a quote opens a string in every file type; strings and block
comments run over line ends; ``-`` is a word character; a closing ``-->`` sticks to the
word characters behind it; a line with nothing but ``\r`` inside a block comment is blank.

Every function returns SQL expression text (arguments are SQL text as well): the whole
scanner reaches the JVM in a few parses instead of thousands of calls.
"""

from __future__ import annotations

from collections.abc import Callable

# Word characters inside a class: ASCII letters, digits, ``_`` and ``-``. Java matches the
# predefined class several times faster than the same ranges spelled out.
WORD = r"\w-"

# Code words that add one to the complexity.
BRANCH_WORDS = ["if", "for", "while", "match", "catch", "case", "try", "except"]
# Note words (any case) that count as a TODO.
NOTE_WORDS = ["todo", "hack", "fixme"]
# Word prefixes that count as a secret.
SECRET_PREFIXES = ["AKIA", "ghp_", "sk_live_", "xoxb-"]


def raw(pattern: str) -> str:
    """A regular expression as a raw SQL literal (single quotes in hexadecimal)."""
    return "r'" + pattern.replace("'", r"\x27") + "'"


def _quoted(q: str) -> str:
    # An escape is a backslash, any carriage returns, and one more character. The
    # possessive loops keep the Java matcher from recursing on long strings.
    return rf"{q}[^{q}\\]*+(?:\\\r*[\s\S][^{q}\\]*+)*+(?:{q}|\\?\z)"


_STRINGS = "|".join(_quoted(q) for q in "\"'`")

COMMENTS = {
    "c": r"//[^\n]*+|/\*[\s\S]*?(?:\*/|\z)",
    "p": r'"""[\s\S]*?(?:"""|\z)' + r"|'''[\s\S]*?(?:'''|\z)" + r"|#[^\n]*+",
    "h": rf"<!--[\s\S]*?(?:-->[{WORD}]*+|\z)",
    "n": "",
}

_CODE = {
    "c": r"""[^"'`/]++|/""",
    "p": r"""[^"'`#]++""",
    "h": r"""[^"'`<]++|<""",
    "n": r"""[^"'`]++""",
}

CHUNKS = {
    style: "|".join(part for part in (COMMENTS[style], _STRINGS, _CODE[style]) if part) for style in COMMENTS
}

# Chunks that start like this are comments. Code never starts with a quote, ``#``, ``//``,
# ``/*`` or ``<!--``, so the first characters tell the three kinds apart.
_COMMENT_TEST = {
    "c": "left({0}, 2) IN ('//', '/*')",
    "p": "left({0}, 1) = '#' OR left({0}, 3) IN ('\"\"\"', repeat(chr(39), 3))",
    "h": "left({0}, 4) = '<!--'",
    "n": "false",
}
_QUOTE_LITERALS = ["'\"'", "chr(39)", "'`'"]
_STRING_TEST = f"left({{0}}, 1) IN ({', '.join(_QUOTE_LITERALS)})"


def _by_style(style: str, build: Callable[[str], str]) -> str:
    """One branch per style, so that every pattern in the plan is a constant."""
    branches = " ".join(f"WHEN '{s}' THEN {build(s)}" for s in "cph")
    return f"CASE {style} {branches} ELSE {build('n')} END"


def _is_comment(chunk: str, style: str) -> str:
    return f"({_COMMENT_TEST[style].format(chunk)})"


def _is_string(chunk: str) -> str:
    return f"({_STRING_TEST.format(chunk)})"


def _html_note(chunk: str) -> str:
    """Text of an html comment as words see it: no opener, ``-->word`` cut to ``--``."""
    inner = f"substring({chunk}, 5)"
    return f"CASE WHEN contains({inner}, '-->') THEN substring_index({inner}, '-->', 1) || '--' ELSE {inner} END"


def chunks(content: str, style: str) -> str:
    """``ARRAY<STRING>`` of comments, strings and code runs, in file order.

    Text without a quote in a file type without comments is one chunk as it stands.
    """

    def cut(s: str) -> str:
        pieces = f"regexp_extract_all({content}, {raw(CHUNKS[s])}, 0)"
        if s != "n":
            return pieces
        quoted = " OR ".join(f"contains({content}, {q})" for q in _QUOTE_LITERALS)
        return f"CASE WHEN {quoted} THEN {pieces} ELSE array({content}) END"

    return _by_style(style, cut)


def skeleton(pieces: str, style: str) -> str:
    """Comment text as ``c``, code and string text as ``x``, line ends kept."""
    run = raw(r"[^\r\n]++")
    noted, quoted = f"regexp_replace(t, {run}, 'c')", f"regexp_replace(t, {run}, 'x')"
    plain = f"regexp_replace(t, {raw(r'[^ \t\r\n][^\n]*+')}, 'x')"
    glued = "CASE WHEN contains(substring(t, 5), '-->') AND NOT endswith(t, '-->') THEN 'x' ELSE '' END"

    def shaped(s: str) -> str:
        comment = f"{noted} || {glued}" if s == "h" else noted
        one = f"CASE WHEN {_is_comment('t', s)} THEN {comment} WHEN {_is_string('t')} THEN {quoted} ELSE {plain} END"
        return f"array_join(transform({pieces}, t -> {one}), '')"

    return _by_style(style, shaped)


def code_text(pieces: str, style: str) -> str:
    """Code chunks joined by a space, with one space in front."""

    def code(s: str) -> str:
        return f"array_join(filter({pieces}, t -> NOT ({_is_comment('t', s)} OR {_is_string('t')})), ' ')"

    return f"' ' || {_by_style(style, code)}"


def note_text(pieces: str, style: str) -> str:
    """Comment chunks joined by a newline."""

    def notes(s: str) -> str:
        if s == "n":
            return "''"
        found = f"filter({pieces}, t -> {_is_comment('t', s)})"
        if s == "h":
            found = f"transform({found}, t -> {_html_note('t')})"
        return f"array_join({found}, '\n')"

    return _by_style(style, notes)


def occurrences(text: str, sign: str) -> str:
    """Count of a one-byte character without a regular expression."""
    return f"(octet_length({text}) - octet_length(replace({text}, '{sign}', '')))"


def line_count(content: str) -> str:
    ended = f"{content} = '' OR endswith({content}, '\n')"
    return f"cast({occurrences(content, chr(10))} + CASE WHEN {ended} THEN 0 ELSE 1 END AS bigint)"


def _count(text: str, pattern: str, as_type: str = "bigint") -> str:
    return f"cast(regexp_count({text}, {raw(pattern)}) AS {as_type})"


def code_lines(skel: str) -> str:
    return _count(skel, r"x[^\n]*+")


def comment_lines(skel: str) -> str:
    return _count(skel, r"(?md)^[^x\n]*c[^x\n]*$")


def complexity(code: str) -> str:
    """Branch words, ``?``, and every ``&`` or ``|`` followed by the same sign."""
    # A non-word character, the first letter, and only then the rest of each word: most
    # positions fail at once. The last test turns away a leading ``-``.
    firsts = "".join(dict.fromkeys(w[0] for w in BRANCH_WORDS))
    rests = "|".join(f"(?<={w[0]}){w[1:]}" for w in BRANCH_WORDS)
    words = _count(code, rf"\W[{firsts}](?:{rests})(?![{WORD}])(?<!-(?:{'|'.join(BRANCH_WORDS)}))")

    def doubled(pair: str, pattern: str) -> str:
        return f"CASE WHEN contains({code}, '{pair}') THEN {_count(code, pattern)} ELSE 0 END"

    total = f"{words} + {occurrences(code, '?')} + {doubled('&&', '&(?=&)')} + {doubled('||', '[|](?=[|])')}"
    return f"cast({total} AS double)"


def todo_count(notes: str) -> str:
    words = "|".join(NOTE_WORDS)
    return _count(notes, rf"(?i)(?:{words})(?![{WORD}])(?<![{WORD}](?:{words}))")


def secret_count(content: str, pieces: str, style: str) -> str:
    """Words that start with a secret prefix, in code, strings and comments alike.

    Files without any prefix (nearly all) leave after four substring tests.
    """
    prefixes = "|".join(SECRET_PREFIXES)
    pattern = rf"(?:{prefixes})(?<![{WORD}](?:{prefixes}))"
    suspect = " OR ".join(f"contains({content}, '{p}')" for p in SECRET_PREFIXES)
    html = f"transform({pieces}, t -> CASE WHEN {_is_comment('t', 'h')} THEN ' ' || {_html_note('t')} ELSE t END)"
    html_words = f"array_join({html}, '')"
    return (
        f"CASE WHEN NOT ({suspect}) THEN 0L WHEN {style} = 'h' THEN {_count(html_words, pattern)} "
        f"ELSE {_count(content, pattern)} END"
    )
