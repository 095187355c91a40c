"""Language and comment-style labels derived from the path (and, rarely, a shebang)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linetally.functions.paths import base_name_sql, extension_sql

# Label by whole lower-cased file name.
NAME_LABELS = {
    "makefile": "Makefile",
    "gnumakefile": "Makefile",
    "cmakelists.txt": "Makefile",
    "dockerfile": "Dockerfile",
    "docker-compose.yml": "Docker Compose",
    "docker-compose.yaml": "Docker Compose",
    "license": "License",
    "license.txt": "License",
    "license.md": "License",
    "cargo.toml": "Cargo (Rust)",
    "cargo.lock": "Cargo Lock",
    "package.json": "NPM Package",
    "package-lock.json": "NPM Lock",
    "yarn.lock": "Yarn Lock",
    "gemfile": "Ruby Gemfile",
    "gemfile.lock": "Ruby Gemfile Lock",
    ".gitignore": "Git Config",
    ".gitattributes": "Git Config",
    ".gitmodules": "Git Config",
    "requirements.txt": "Python Requirements",
}

# Label by lower-cased extension.
EXTENSION_LABELS = {
    "rs": "Rust",
    "py": "Python",
    "pyw": "Python",
    "js": "JavaScript",
    "mjs": "JavaScript",
    "cjs": "JavaScript",
    "ts": "TypeScript",
    "mts": "TypeScript",
    "cts": "TypeScript",
    "jsx": "JavaScript JSX",
    "tsx": "TypeScript JSX",
    "c": "C",
    "h": "C Header",
    "cpp": "C++",
    "cxx": "C++",
    "cc": "C++",
    "hpp": "C++ Header",
    "hxx": "C++ Header",
    "hh": "C++ Header",
    "cs": "C#",
    "java": "Java",
    "go": "Go",
    "rb": "Ruby",
    "php": "PHP",
    "swift": "Swift",
    "kt": "Kotlin",
    "kts": "Kotlin",
    "scala": "Scala",
    "html": "HTML",
    "htm": "HTML",
    "css": "CSS",
    "scss": "SCSS",
    "sass": "Sass",
    "less": "Less",
    "md": "Markdown",
    "markdown": "Markdown",
    "json": "JSON",
    "xml": "XML",
    "yaml": "YAML",
    "yml": "YAML",
    "toml": "TOML",
    "sh": "Shell",
    "bash": "Shell",
    "zsh": "Shell",
    "bat": "Shell",
    "cmd": "Shell",
    "ps1": "Shell",
    "sql": "SQL",
    "vue": "Vue",
    "svelte": "Svelte",
    "dart": "Dart",
    "r": "R",
    "lua": "Lua",
    "pl": "Perl",
    "pm": "Perl",
    "t": "Perl",
    "txt": "Text",
    "ini": "INI",
    "cfg": "Config",
    "conf": "Config",
    "config": "Config",
    "csv": "CSV",
    "env": "Dotenv",
}

# Shebang words, tried in this order.
SHEBANG_LABELS = {
    "python": "Python",
    "node": "JavaScript",
    "sh": "Shell",
    "ruby": "Ruby",
    "perl": "Perl",
}

# Lower-cased extensions of each comment style.
STYLE_EXTENSIONS = {
    "c": ["c", "cpp", "h", "hpp", "js", "ts", "jsx", "tsx", "java", "rs", "go", "cs", "swift", "kt", "php"],
    "p": ["py", "sh", "rb", "pl", "yml", "yaml"],
    "h": ["html", "xml", "vue", "svelte", "md"],
}

UNKNOWN = "Unknown"
SHEBANG_BYTES = 64


def _lookup(table: dict[str, str], key: str) -> str:
    pairs = ", ".join(f"'{k}', '{v}'" for k, v in table.items())
    return f"try_element_at(map({pairs}), {key})"


def shebang_sql(content: str) -> str:
    head = f"cast(substring(cast({content} AS binary), 1, {SHEBANG_BYTES}) AS string)"
    tests = " ".join(f"WHEN contains({head}, '{word}') THEN '{label}'" for word, label in SHEBANG_LABELS.items())
    return f"CASE WHEN startswith({content}, '#!') THEN CASE {tests} END END"


def language_sql(path: str, content: str) -> str:
    """Label by file name, else by extension, else by shebang, else ``Unknown``.

    An unlisted extension labels itself with its first letter in upper case. ``lua``
    files are labelled "Lua".
    """
    ext = f"lower({extension_sql(path)})"
    own = f"CASE WHEN {ext} = '' THEN '{UNKNOWN}' ELSE upper(left({ext}, 1)) || substring({ext}, 2) END"
    by_name = _lookup(NAME_LABELS, f"lower({base_name_sql(path)})")
    return f"coalesce({by_name}, {_lookup(EXTENSION_LABELS, ext)}, {own}, {shebang_sql(content)}, '{UNKNOWN}')"


def style_sql(path: str) -> str:
    """``c``, ``p``, ``h`` or ``n`` (no comments), by lower-cased extension."""
    listed = {style: ", ".join(f"'{e}'" for e in exts) for style, exts in STYLE_EXTENSIONS.items()}
    tests = " ".join(f"WHEN lower({extension_sql(path)}) IN ({exts}) THEN '{style}'" for style, exts in listed.items())
    return f"CASE {tests} ELSE 'n' END"


def language_of(path: str = "path", content: str = "content") -> Column:
    return F.expr(language_sql(path, content))


def shebang_language(content: str = "content") -> Column:
    """Label named by the ``#!`` line in the first 64 bytes; null when there is none."""
    return F.expr(shebang_sql(content))


def comment_style(path: str = "path") -> Column:
    return F.expr(style_sql(path))
