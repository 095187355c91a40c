r"""SQL twins of the registered queries, for DuckDB over the same tables.

The scanner twin takes the text apart word by word, unlike the engine, which cuts it at
comment and quote openers only, so the two check each other.
"""

from __future__ import annotations

from linetally.functions.language import EXTENSION_LABELS, NAME_LABELS, STYLE_EXTENSIONS
from linetally.functions.text import WHITE_SPACE
from linetally.plans import bindings as B
from linetally.plans.catalog import AS_OF_EPOCH, DOC_REGEXES, GREP_PATTERN, INDEXED_PATTERN, RETURN_PATTERN, SKIP_AUTHOR

NL = "chr(10)"
BASE = "regexp_extract(path, '[^/]*$')"
DOTTED = f"regexp_matches({BASE}, '^.+\\.[^.]*$')"
EXT = f"CASE WHEN {DOTTED} THEN regexp_extract({BASE}, '[^.]*$') END"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(quote(v) for v in values) + ")"


def case(expr: str, table: dict[str, str], default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in table.items())
    return f"CASE {expr} {whens} ELSE {default} END"


# Corpora

CODE = f"SELECT 'code' AS root, {B.PART_PATH} AS path, {B.PART_CONTENT} AS content FROM part"
PAGES = f"SELECT 'site' AS root, {B.PAGE_PATH} AS path, html AS content FROM pages"
DOCS = f"SELECT 'prose' AS root, {B.DOC_PATH} AS path, text AS content FROM documents"
APPS = f"SELECT 'apps' AS root, {B.ARTIFACT_PATH} AS path, {B.ARTIFACT_CONTENT} AS content FROM part"
SAMPLES = f"SELECT 'samples' AS root, {B.SAMPLE_PATH} AS path, {B.SAMPLE_CONTENT} AS content FROM part"
RETURNS = f"SELECT root, path, replace(content, '.', '.' || chr(13)) AS content FROM ({PAGES})"
ALL = f"{CODE} UNION ALL {PAGES} UNION ALL {DOCS}"

LINES = (
    f"(CASE WHEN content = '' THEN 0 ELSE length(content) - length(replace(content, {NL}, '')) + "
    f"CASE WHEN content LIKE '%' || {NL} THEN 0 ELSE 1 END END)::BIGINT"
)
BODY = "regexp_replace(content, '\\r?\\n\\z', '')"
LINE_LIST = f"(CASE WHEN content = '' THEN [] ELSE string_split_regex({BODY}, '\\r?\\n') END)"

# Shebang words and labels.
SHEBANG = (
    "CASE WHEN content LIKE '#!%' THEN CASE WHEN contains(left(content, 64), 'python') THEN 'Python' "
    "WHEN contains(left(content, 64), 'node') THEN 'JavaScript' WHEN contains(left(content, 64), 'sh') THEN 'Shell' "
    "WHEN contains(left(content, 64), 'ruby') THEN 'Ruby' WHEN contains(left(content, 64), 'perl') THEN 'Perl' END END"
)
OWN = f"CASE WHEN {EXT} = '' THEN 'Unknown' ELSE upper(left(lower({EXT}), 1)) || substr(lower({EXT}), 2) END"
LANGUAGE = f"coalesce({case(f'lower({BASE})', NAME_LABELS)}, {case(f'lower({EXT})', EXTENSION_LABELS)}, {OWN}, {SHEBANG}, 'Unknown')"
STYLE = (
    "CASE " + " ".join(f"WHEN lower({EXT}) IN {in_list(v)} THEN '{k}'" for k, v in STYLE_EXTENSIONS.items()) + " ELSE 'n' END"
)

# Scanner


def _string(q: str) -> str:
    return rf"{q}[^{q}\\]*(?:\\\r*[\s\S][^{q}\\]*)*(?:{q}|\\?\z)"


TAIL = "|".join(_string(q) for q in "\"'`") + r"|[A-Za-z0-9_-]+|&+|\|+|[\s\S]"
OPENERS = {
    "c": r"//[^\n]*|/\*[\s\S]*?(?:\*/|\z)|",
    "p": r'"""[\s\S]*?(?:"""|\z)|' + r"'''[\s\S]*?(?:'''|\z)|#[^\n]*|",
    "h": r"<!--[\s\S]*?(?:-->[A-Za-z0-9_-]*|\z)|",
    "n": "",
}
TOKENS = (
    "CASE style "
    + " ".join(f"WHEN '{s}' THEN regexp_extract_all(content, {quote(OPENERS[s] + TAIL)})" for s in "cph")
    + f" ELSE regexp_extract_all(content, {quote(TAIL)}) END"
)
IS_COMMENT = (
    "((style = 'c' AND (t LIKE '//%' OR t LIKE '/*%')) OR (style = 'p' AND (t LIKE '#%' OR t LIKE '\"\"\"%' OR t LIKE '''''''%')) "
    "OR (style = 'h' AND t LIKE '<!--%'))"
)
IS_STRING = "left(t, 1) IN ('\"', '''', '`')"
SHAPE = (
    f"CASE WHEN {IS_COMMENT} THEN regexp_replace(t, '[^\\r\\n]', 'c', 'g') || "
    "CASE WHEN style = 'h' AND regexp_matches(t, '-->[A-Za-z0-9_-]+\\z') THEN 'x' ELSE '' END "
    f"WHEN {IS_STRING} THEN regexp_replace(t, '[^\\r\\n]', 'x', 'g') "
    "ELSE regexp_replace(t, '[^ \\t\\r\\n]', 'x', 'g') END"
)
SKELETON_LINES = f"string_split(regexp_replace(skeleton, '\\n\\z', ''), {NL})"
INNER = "regexp_replace(CASE WHEN style = 'h' AND t LIKE '<!--%' THEN substr(t, 5) ELSE t END, '-->[A-Za-z0-9_-]*\\z', '--')"
NOTE_WORDS = f"list_concat([''], flatten(list_transform(list_filter(tok, lambda t: {IS_COMMENT}), lambda t: regexp_extract_all({INNER}, '[A-Za-z0-9_-]+'))))"
ALL_WORDS = (
    "flatten(list_transform(tok, lambda t: regexp_extract_all("
    f"CASE WHEN {IS_COMMENT} THEN {INNER} ELSE t END, '[A-Za-z0-9_-]+')))"
)
BRANCHES = in_list(["if", "for", "while", "match", "catch", "case", "try", "except", "?"])
COMPLEXITY = (
    f"list_sum(list_concat([0], list_transform(list_filter(tok, lambda t: NOT ({IS_COMMENT} OR {IS_STRING})), "
    f"lambda t: CASE WHEN t IN {BRANCHES} THEN 1 WHEN left(t, 1) IN ('&', '|') THEN length(t) - 1 ELSE 0 END)))::DOUBLE"
)


def scanned(files: str, extra: str = "") -> str:
    """CTE ``stats`` over a corpus SELECT."""
    return f"""WITH files AS ({files}),
styled AS (SELECT *, {STYLE} AS style FROM files),
lexed AS (SELECT *, {TOKENS} AS tok FROM styled),
shaped AS (SELECT *, array_to_string(list_transform(tok, lambda t: {SHAPE}), '') AS skeleton FROM lexed),
counted AS (SELECT *, {LINES} AS lines,
  CASE WHEN content = '' THEN 0 ELSE len(list_filter({SKELETON_LINES}, lambda l: contains(l, 'x'))) END::BIGINT AS code_lines,
  CASE WHEN content = '' THEN 0 ELSE len(list_filter({SKELETON_LINES}, lambda l: contains(l, 'c') AND NOT contains(l, 'x'))) END::BIGINT AS comment_lines
  FROM shaped),
stats AS (SELECT root, path, content, {LANGUAGE} AS language, lines, lines - code_lines - comment_lines AS blank_lines,
  comment_lines, code_lines, {COMPLEXITY} AS complexity,
  len(list_filter({NOTE_WORDS}, lambda w: upper(w) IN ('TODO', 'HACK', 'FIXME')))::BIGINT AS todo_count,
  len(list_filter({ALL_WORDS}, lambda w: regexp_matches(w, '^(AKIA|ghp_|sk_live_|xoxb-)')))::BIGINT AS secrets_found,
  octet_length(encode(content))::BIGINT AS size_bytes FROM counted){extra}
"""


def sized(files: str, extra: str = "") -> str:
    """CTE ``stats`` with path, language and lines only."""
    return f"WITH files AS ({files}), stats AS (SELECT root, path, {LANGUAGE} AS language, {LINES} AS lines FROM files){extra}\n"


SUMS = ", ".join(
    f"sum({c})::{'DOUBLE' if c == 'complexity' else 'BIGINT'} AS {c}"
    for c in ("lines", "blank_lines", "comment_lines", "code_lines", "complexity", "todo_count", "secrets_found")
)

# Line-based analysis

PADDED = f"(' ' || regexp_replace({BODY}, '\\r?\\n', ' ' || {NL} || ' ', 'g') || ' ')"
KEYWORD_HITS = (
    f"regexp_extract_all({PADDED}, '(?i)def |function |fn | (?:if|for|while|case|catch|try|except) |&&|\\|\\||\\?:')"
)
KEYWORD_COMPLEXITY = (
    f"len(list_filter({KEYWORD_HITS}, lambda h: lower(h) NOT IN ('def ', 'function ', 'fn ')))::DOUBLE"
)
FUNCTION_WORDS = f"len(regexp_extract_all({PADDED}, '(?i)(?:^|[^A-Za-z0-9_])(?:def |function |fn )'))"
RUST_NOISE = (
    r"//[^\n]*|/\*[\s\S]*?(?:\*/|\z)"
    r'|\bb?r##"[\s\S]*?(?:"##|\z)|\bb?r#"[\s\S]*?(?:"#|\z)|\bb?r"[^"]*(?:"|\z)'
    r'|"[^"\\]*(?:\\[\s\S][^"\\]*)*(?:"|\\?\z)'
    r"|'(?:\\.[^'\n]*|[^'\\\n])'"
)
RUST_NAMES = (
    f"regexp_extract_all(regexp_replace(content, {quote(RUST_NOISE)}, ' ', 'g'), "
    r"'\bfn\s+([A-Za-z0-9_]+)[^;{\[]*(?:\[[^\]]*\][^;{\[]*)*\{', 1)"
)
FUNCTIONS = f"(CASE WHEN {EXT} = 'rs' THEN len({RUST_NAMES}) ELSE {FUNCTION_WORDS} END)::BIGINT"
TODO_WORDS = f"len(list_filter(regexp_extract_all(content, '[A-Za-z0-9_]+'), lambda w: lower(w) IN ('todo', 'fixme')))::BIGINT"
RS_PY = f"coalesce({EXT} IN ('rs', 'py'), false)"
DOCSTRINGS = f"(CASE WHEN {RS_PY} THEN len(regexp_extract_all(content, '(?m)^\\s*(///|#|\"\"\")')) ELSE 0 END)::BIGINT"
TYPEHINTS = f"(CASE WHEN {RS_PY} THEN len(regexp_extract_all(content, '(?m)(:\\s*[a-zA-Z_]|->\\s*[a-zA-Z_])')) ELSE 0 END)::BIGINT"
# Patterns of names and definitions.
FUNC_NAMES = r"regexp_extract_all(content, '(?:fn|def|function)\s+([a-zA-Z0-9_]+)', 1)"
CLASS_NAMES = r"regexp_extract_all(content, 'class\s+([a-zA-Z0-9_]+)', 1)"


def violations(files: str) -> str:
    return f"""SELECT root, path, 'Function' AS kind, name, 'snake_case' AS rule
  FROM (SELECT root, path, unnest({FUNC_NAMES}) AS name FROM ({files}) WHERE {RS_PY}) WHERE NOT regexp_full_match(name, '[a-z0-9_]*')
UNION ALL SELECT root, path, 'Class', name, 'PascalCase'
  FROM (SELECT root, path, unnest({CLASS_NAMES}) AS name FROM ({files})) WHERE NOT regexp_matches(name, '^[A-Z]')"""


SNAKE = r"lower(left(name, 1) || regexp_replace(substr(name, 2), '([A-Z])', '_\1', 'g'))"
PASCAL = "array_to_string(list_transform(string_split(name, '_'), lambda p: upper(left(p, 1)) || substr(p, 2)), '')"
ANALYSIS = (
    f"SELECT root, path, {KEYWORD_COMPLEXITY} AS keyword_complexity, {FUNCTIONS} AS functions_count, {TODO_WORDS} AS todo_words, "
    f"{DOCSTRINGS} AS docstrings_count, {TYPEHINTS} AS typehints_count FROM ({ALL})"
)
NUMBERED = f"SELECT root, path, unnest({LINE_LIST}) AS line, unnest(range(1, len({LINE_LIST}) + 1)) AS line_no FROM ({ALL})"
TRIM = quote(WHITE_SPACE)
STYLE_ISSUES = f"""WITH numbered AS ({NUMBERED})
SELECT root, path, line_no::BIGINT AS line_no, 'Trailing whitespace' AS issue FROM numbered WHERE regexp_matches(line, '[ \\t]\\z')
UNION ALL SELECT root, path, line_no::BIGINT, 'Line exceeds 100 characters' FROM numbered WHERE length(line) > 100
UNION ALL SELECT root, path, 0::BIGINT, 'Missing newline at end of file' FROM ({ALL}) WHERE content <> '' AND right(content, 1) <> {NL}"""
GREP = f"SELECT root, path, line_no::BIGINT AS line_no, trim(line, {TRIM}) AS line FROM ({NUMBERED}) WHERE regexp_matches(line, {quote(GREP_PATTERN)})"
DEAD = f"""SELECT name FROM (SELECT DISTINCT unnest(CASE WHEN {EXT} = 'rs' THEN {RUST_NAMES} ELSE {FUNC_NAMES} END) AS name FROM ({ALL}))
JOIN (SELECT unnest(regexp_extract_all(content, '[A-Za-z0-9_]+')) AS name FROM ({ALL})) USING (name) GROUP BY name HAVING count(*) = 1"""


def blocks(files: str) -> str:
    """CTE ``blocks``: root, path, line_no and text of each block of five kept lines."""
    return f"""WITH numbered AS ({NUMBERED.replace(ALL, files)}),
kept AS (SELECT root, path, line_no, trim(line, {TRIM}) AS line FROM numbered WHERE octet_length(encode(trim(line, {TRIM}))) > 3),
windows AS (SELECT root, path, line_no, list(line) OVER w AS block, count(*) OVER w AS n FROM kept
  WINDOW w AS (PARTITION BY root, path ORDER BY line_no ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
blocks AS (SELECT root, path, line_no::BIGINT AS line_no, block FROM windows WHERE n = 5)
"""


# History

COMMITS = "SELECT o_orderkey::VARCHAR AS commit_id, c_name AS author, o_orderdate AS ts FROM orders LEFT JOIN customer ON o_custkey = c_custkey"
CHANGES = (
    f"SELECT l_orderkey::VARCHAR AS commit_id, {B.PART_PATH} AS path, l_quantity::BIGINT AS insertions, l_linenumber::BIGINT AS deletions "
    "FROM lineitem JOIN part ON l_partkey = p_partkey"
)
KEEP_AUTHOR = f"NOT contains(lower(coalesce(author, 'Unknown')), {quote(SKIP_AUTHOR)})"
HISTORY = f"WITH commits AS (SELECT commit_id, coalesce(author, 'Unknown') AS author, ts FROM ({COMMITS}) WHERE {KEEP_AUTHOR}), changes AS ({CHANGES})\n"
SNAPSHOTS = "SELECT turn::VARCHAR AS commit_id, make_timestamp((1700000000 + turn * 3600) * 1000000) AS ts, conv_id::VARCHAR AS path, text AS content FROM conversations"
AGE = (
    "CASE WHEN {0} < 0 THEN '-' WHEN {0} < 60 THEN {0} || 's ago' WHEN {0} < 3600 THEN {0} // 60 || 'm ago' "
    "WHEN {0} < 86400 THEN {0} // 3600 || 'h ago' ELSE {0} // 86400 || 'd ago' END"
)
MODIFIED = AGE.format(f"({AS_OF_EPOCH} - (1700000000 + doc_id * 977))")
CREATED = AGE.format(f"({AS_OF_EPOCH} - (1690000000 + doc_id))")

# Ids, levels and messages of findings.
FINDINGS = """SELECT root, path, 'CS-001' AS rule_id, 'error' AS level,
  'Found ' || secrets_found || ' potential secret(s) (e.g. API keys) in this file.' AS message FROM stats WHERE secrets_found > 0
UNION ALL SELECT root, path, 'CS-002', 'warning', 'High cyclomatic complexity (' || printf('%.1f', complexity) || '). Consider refactoring.'
  FROM stats WHERE complexity > 15"""

# Limits, weights, grades and advice.
HEALTH_RATES = """SELECT {0} count(*)::BIGINT AS files, sum(complexity) / count(*) AS avg_complexity,
  sum(comment_lines)::DOUBLE / sum(lines)::DOUBLE AS comment_density, sum(blank_lines)::DOUBLE / sum(lines)::DOUBLE AS blank_density
  FROM stats {1}"""
HEALTH = """SELECT *, CASE WHEN score >= 90 THEN 'Excellent' WHEN score >= 75 THEN 'Good' WHEN score >= 60 THEN 'Fair' ELSE 'Needs Improvement' END AS status,
  concat_ws('; ', CASE WHEN avg_complexity > 5 THEN printf('Average complexity is high (%.1f). Consider refactoring complex functions.', avg_complexity) END,
    CASE WHEN comment_density < 0.1 THEN printf('Comment density is low (%.1f%%). Consider adding more documentation.', comment_density * 100) END,
    CASE WHEN blank_density < 0.05 THEN printf('Blank line density is low (%.1f%%). Consider adding blank lines to separate logical blocks.', blank_density * 100) END)
    AS suggestions,
  CASE WHEN avg_complexity < 3 THEN 'brightgreen' WHEN avg_complexity < 5 THEN 'yellow' ELSE 'red' END AS sustainability
FROM (SELECT *, round(greatest(100.0::DOUBLE - CASE WHEN avg_complexity > 5 THEN least((avg_complexity - 5) * 2, 30) ELSE 0 END
  - CASE WHEN comment_density < 0.1 THEN least((0.1::DOUBLE - comment_density) * 200, 20) ELSE 0 END
  - CASE WHEN blank_density < 0.05 THEN least((0.05::DOUBLE - blank_density) * 200, 10) ELSE 0 END, 0), 6) AS score FROM rates)"""

SHARES = (
    "SELECT {0} language, count(*)::BIGINT AS files, count(*) * 100.0::DOUBLE / sum(count(*)) OVER ({1}) AS files_pct, "
    "sum(lines)::BIGINT AS lines, sum(lines)::DOUBLE / (sum(sum(lines)) OVER ({1}))::DOUBLE * 100.0::DOUBLE AS lines_pct FROM stats GROUP BY {0} language"
)

PARTS = "string_split(path, '/')"
PREFIXES = f"SELECT root, path AS file, {PARTS} AS parts, unnest(range(1, len({PARTS}) + 1)) AS n FROM ({ALL})"
NODE = "translate({0}, '/.-\\', '____')"

POLICY = "(VALUES ('code', 6, 2.0, 1, false), ('prose', 120, 20.0, 50, true)) AS p(root, max_lines, max_cx, max_todo, allow)"

ORACLE: dict[str, str] = {
    "read_corpus": f"SELECT root, path, content, octet_length(encode(content))::BIGINT AS size_bytes, true AS valid_utf8 FROM ({CODE})",
    "read_many": f"SELECT root, count(*)::BIGINT AS files, sum(octet_length(encode(content)))::BIGINT AS size_bytes FROM ({ALL}) GROUP BY root",
    "change_log_commits": "SELECT o_orderkey::VARCHAR AS commit_id, CASE WHEN o_custkey % 10 <> 0 THEN 'dev ' || o_custkey END AS author, "
    "make_timestamp((1000000000 + o_orderkey * 60) * 1000000) AS ts FROM orders",
    "change_log_changes": "SELECT o_orderkey::VARCHAR AS commit_id, 'src/m' || (o_orderkey % 100) || '.rs' AS path, (o_custkey % 40)::BIGINT AS insertions, "
    "(o_orderkey % 7)::BIGINT AS deletions FROM orders UNION ALL "
    "SELECT o_orderkey::VARCHAR, 'img/logo' || (o_orderkey % 9) || '.png', 0::BIGINT, 0::BIGINT FROM orders UNION ALL "
    "SELECT o_orderkey::VARCHAR, 'docs/café \"' || (o_orderkey % 5) || '\".md', 3::BIGINT, 1::BIGINT FROM orders",
    "incremental": scanned(DOCS, ", numbered AS (SELECT *, regexp_extract(path, '([0-9]+)[.]txt$', 1)::BIGINT AS n FROM stats)")
    + "SELECT root, path, language, lines, code_lines, size_bytes, "
    "CASE WHEN n % 2 = 0 AND n % 3 <> 0 THEN -1::BIGINT ELSE secrets_found END AS secrets_found FROM numbered",
    "lang_json_report": scanned(ALL) + f"SELECT language, count(*)::BIGINT AS files, {SUMS} FROM stats GROUP BY language",
    "lang_csv_report": scanned(ALL)
    + 'SELECT language AS "Extension", count(*)::BIGINT AS "Files", sum(lines)::BIGINT AS "Lines", sum(code_lines)::BIGINT AS "Code", '
    'sum(comment_lines)::BIGINT AS "Comments", sum(blank_lines)::BIGINT AS "Blanks" FROM stats GROUP BY language',
    "details_csv_report": scanned(ALL)
    + "SELECT replace(path, ',', ';') AS \"Path\", language AS \"Extension\", lines AS \"Lines\", code_lines AS \"Code\", "
    "comment_lines AS \"Comments\", blank_lines AS \"Blanks\", printf('%.1f', complexity) AS \"Complexity\" FROM stats",
    "dir_csv_report": scanned(ALL)
    + "SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS \"Directory\", count(*)::BIGINT AS \"Files\", sum(lines)::BIGINT AS \"Lines\", "
    'sum(code_lines)::BIGINT AS "Code", sum(comment_lines)::BIGINT AS "Comments" FROM stats GROUP BY 1',
    "findings": scanned(ALL) + FINDINGS,
    "sarif_results": scanned(ALL) + FINDINGS,
    "exclude_components": f"SELECT root, path FROM ({ALL}) WHERE NOT list_has_any({PARTS}, ['.git', 'Brand_7', 'de', '3.html'])",
    "filter_ext": f"SELECT root, path FROM ({ALL}) WHERE path LIKE '%.rs' OR path LIKE '%.html'",
    "filter_path_regex": f"SELECT root, path FROM ({ALL}) WHERE regexp_matches(path, {quote(DOC_REGEXES[0])}) OR regexp_matches(path, {quote(DOC_REGEXES[2])})",
    "min_lines": f"SELECT root, path, {LINES} AS lines FROM ({ALL}) WHERE {LINES} >= 20",
    "failures_only": scanned(ALL) + "SELECT root, path, lines, complexity FROM stats WHERE lines > 100 OR complexity >= 3",
    "uncommitted": f"SELECT root, path, {LINES} AS lines FROM ({DOCS}) WHERE path IN (SELECT {B.DOC_PATH} FROM documents "
    "WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0))",
    "large_files": f"SELECT root, path, {LINES} AS lines FROM ({ALL}) WHERE {LINES} > 100",
    "grep": GREP,
    "grep_total": f"SELECT count(*)::BIGINT AS hits FROM ({GREP})",
    "drop_small_shares": sized(ALL) + f"SELECT * FROM ({SHARES.format('', '')}) WHERE NOT (lines_pct < 10 AND lines > 0)",
    "language_labels": f"SELECT path, {LANGUAGE} AS language FROM ({SAMPLES})",
    "extensions": f"SELECT path, {EXT} AS extension, {STYLE} AS style FROM ({SAMPLES})",
    "shebang_labels": f"SELECT path, {SHEBANG} AS language FROM ({SAMPLES})",
    "line_counts": scanned(ALL) + "SELECT root, path, lines, blank_lines, comment_lines, code_lines FROM stats",
    "complexity": scanned(ALL) + "SELECT root, path, complexity FROM stats",
    "todo_count": scanned(ALL) + "SELECT root, path, todo_count FROM stats",
    "secret_count": scanned(ALL) + "SELECT root, path, secrets_found FROM stats",
    "keyword_complexity": f"SELECT root, path, keyword_complexity FROM ({ANALYSIS})",
    "functions_count": f"SELECT root, path, functions_count FROM ({ANALYSIS})",
    "todo_words": f"SELECT root, path, todo_words FROM ({ANALYSIS})",
    "naming_violations": violations(ALL),
    "docstring_count": f"SELECT root, path, docstrings_count FROM ({ANALYSIS}) WHERE docstrings_count > 0",
    "typehint_count": f"SELECT root, path, typehints_count FROM ({ANALYSIS}) WHERE typehints_count > 0",
    "style_issues": STYLE_ISSUES,
    "rename_suggestions": f"SELECT *, CASE rule WHEN 'snake_case' THEN {SNAKE} ELSE {PASCAL} END AS suggestion FROM ({violations(CODE)})",
    "rename_titles": f"SELECT c_custkey, {SNAKE} AS snake, {PASCAL} AS pascal FROM (SELECT c_custkey, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) "
    "|| '_' || substring(c_mktsegment, 1, 3) || c_custkey || 'aB' AS name FROM customer)",
    "age_buckets": f"SELECT {B.DOC_PATH} AS path, {MODIFIED} AS modified, {CREATED} AS created FROM documents",
    "complexity_bands": scanned(ALL)
    + "SELECT root, path, complexity, CASE WHEN complexity < 2 THEN '.' WHEN complexity < 5 THEN 'o' WHEN complexity < 10 THEN 'O' ELSE '@' END AS band FROM stats",
    "cost_estimate": scanned(ALL)
    + "SELECT code_lines, round(e, 3) AS effort, round(m, 3) AS months, round(e / m, 3) AS people, round(e * 8000, 3) AS cost FROM "
    "(SELECT *, 2.5 * pow(e, 0.38::DOUBLE) AS m FROM (SELECT sum(code_lines)::BIGINT AS code_lines, "
    "3.2 * pow(sum(code_lines)::DOUBLE / 1000, 1.05::DOUBLE) AS e FROM stats))",
    "coverage_rates": f"""SELECT path, CASE WHEN r IS NULL THEN 'missing' WHEN try_cast(r AS DOUBLE) IS NULL THEN 'not a number' ELSE 'ok' END AS status,
  round(try_cast(r AS DOUBLE) * 100, 6) AS line_coverage FROM (SELECT path, regexp_extract_all(content, '<coverage[^>]*line-rate="([^"]+)"', 1)[1] AS r
  FROM ({APPS}) WHERE path LIKE '%coverage.xml')""",
    "dependency_counts": f"""WITH files AS ({APPS}), named AS (SELECT *, {BASE} AS kind, {LINE_LIST} AS ls FROM files)
SELECT root, path, kind, len(list_filter(ls, lambda l: trim(l) = '[[package]]'))::BIGINT AS dependencies FROM named WHERE kind = 'Cargo.lock'
UNION ALL SELECT root, path, kind, len(list_filter(ls, lambda l: trim(l) <> '' AND NOT starts_with(trim(l), '#')))::BIGINT FROM named WHERE kind = 'requirements.txt'
UNION ALL SELECT root, path, kind, (len(json_keys(content, '$.packages')) - 1)::BIGINT FROM named
  WHERE kind = 'package-lock.json' AND json_valid(content) AND json_exists(content, '$.packages')
UNION ALL SELECT root, path, kind, (SELECT count(*) FROM json_tree(content) j WHERE regexp_matches(j.path, '(^|[.])"?dependencies"?$'))::BIGINT FROM named
  WHERE kind = 'package-lock.json' AND json_valid(content) AND NOT json_exists(content, '$.packages')""",
    "api_routes": f"""SELECT DISTINCT root, route, method FROM (SELECT root,
  unnest(regexp_extract_all(content, '@app\\.(get|post|put|delete|patch)\\(["'']([^"'']+)["'']\\)', 1)) AS method,
  unnest(regexp_extract_all(content, '@app\\.(get|post|put|delete|patch)\\(["'']([^"'']+)["'']\\)', 2)) AS route FROM ({APPS}) WHERE path LIKE '%.py')""",
    "compare_corpora": f"""WITH a AS (SELECT {LANGUAGE} AS language, count(*) AS f, sum({LINES}) AS l FROM ({DOCS} UNION ALL {PAGES}) GROUP BY 1),
b AS (SELECT {LANGUAGE} AS language, count(*) AS f, sum({LINES}) AS l FROM ({CODE} UNION ALL {PAGES}) GROUP BY 1),
j AS (SELECT coalesce(a.language, b.language) AS language, coalesce(a.f, 0)::BIGINT AS files_1, coalesce(b.f, 0)::BIGINT AS files_2,
  coalesce(a.l, 0)::BIGINT AS lines_1, coalesce(b.l, 0)::BIGINT AS lines_2, false AS is_total FROM a FULL OUTER JOIN b ON a.language = b.language),
u AS (SELECT * FROM j UNION ALL SELECT 'Total', sum(files_1)::BIGINT, sum(files_2)::BIGINT, sum(lines_1)::BIGINT, sum(lines_2)::BIGINT, true FROM j)
SELECT *, files_2 - files_1 AS files_diff, lines_2 - lines_1 AS lines_diff FROM u""",
    "hotspot_risk": scanned(CODE, f", changes AS ({CHANGES})")
    + """SELECT *, CASE WHEN score > 50 THEN 'High' WHEN score > 20 THEN 'Medium' ELSE 'Low' END AS risk FROM (
  SELECT h.path, commits, coalesce(complexity, 0) AS complexity, commits * coalesce(complexity, 0) AS score FROM
  (SELECT path, count(DISTINCT commit_id)::BIGINT AS commits FROM changes GROUP BY path ORDER BY 2 DESC, 1 LIMIT 15) h LEFT JOIN stats s ON s.path = h.path)""",
    "dead_code": DEAD,
    "file_report": scanned(
        ALL,
        f", analysis AS ({ANALYSIS}), bad AS (SELECT root, path, count(*)::BIGINT AS n FROM ({violations(ALL)}) GROUP BY 1, 2)",
    )
    + """SELECT s.root, s.path, language, lines, blank_lines, comment_lines, code_lines, complexity, todo_count, secrets_found, size_bytes,
  keyword_complexity, functions_count, todo_words, docstrings_count, typehints_count, coalesce(n, 0)::BIGINT AS naming_violations,
  true AS has_stats, true AS has_analysis FROM stats s JOIN analysis a USING (root, path) LEFT JOIN bad USING (root, path)""",
    "check_policy": scanned(ALL, f", j AS (SELECT * FROM stats JOIN {POLICY} USING (root))")
    + """SELECT root, path, 'max_lines_per_file' AS rule, lines::DOUBLE AS actual, max_lines::DOUBLE AS allowed FROM j WHERE lines > max_lines
UNION ALL SELECT root, path, 'max_complexity', complexity, max_cx::DOUBLE FROM j WHERE complexity > max_cx
UNION ALL SELECT root, path, 'max_todo_count', todo_count::DOUBLE, max_todo::DOUBLE FROM j WHERE todo_count > max_todo
UNION ALL SELECT root, path, 'allow_secrets', secrets_found::DOUBLE, 0::DOUBLE FROM j WHERE NOT allow AND secrets_found > 0""",
    "lang_stats": scanned(ALL) + f"SELECT root, language, count(*)::BIGINT AS files, {SUMS} FROM stats GROUP BY root, language",
    "lang_summary": scanned(ALL)
    + f"SELECT language, count(*)::BIGINT AS files, {SUMS}, false AS is_total FROM stats GROUP BY language "
    f"UNION ALL SELECT 'Total', count(*)::BIGINT, {SUMS}, true FROM stats",
    "lang_summary_by_todos": scanned(CODE)
    + f"SELECT language, count(*)::BIGINT AS files, {SUMS}, false AS is_total FROM stats GROUP BY language "
    f"UNION ALL SELECT 'Total', count(*)::BIGINT, {SUMS}, true FROM stats",
    "lang_shares": sized(ALL) + SHARES.format("root,", "PARTITION BY root"),
    "dir_stats": scanned(ALL)
    + "SELECT root, regexp_extract(path, '^(.*)/[^/]*$', 1) AS directory, count(*)::BIGINT AS files, sum(lines)::BIGINT AS lines, "
    "sum(code_lines)::BIGINT AS code_lines, sum(comment_lines)::BIGINT AS comment_lines FROM stats GROUP BY 1, 2",
    "health_score": scanned(ALL, f", rates AS ({HEALTH_RATES.format('root,', 'GROUP BY root')})") + HEALTH,
    "project_health": scanned(ALL, f", rates AS ({HEALTH_RATES.format('', '')})") + f"SELECT score, status, sustainability FROM ({HEALTH})",
    "hotspots": f"SELECT path, count(DISTINCT commit_id)::BIGINT AS commits FROM ({CHANGES}) GROUP BY path ORDER BY 2 DESC, 1 LIMIT 15",
    "recent_churn": f"""SELECT path, count(DISTINCT commit_id)::BIGINT AS commits FROM ({CHANGES}) WHERE commit_id IN (SELECT commit_id FROM ({COMMITS})
  WHERE ts >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAY) GROUP BY path ORDER BY 2 DESC, 1 LIMIT 20""",
    "contributors": HISTORY
    + "SELECT author, count(*)::BIGINT AS commits, false AS is_total FROM commits GROUP BY author UNION ALL SELECT 'Total', count(*)::BIGINT, true FROM commits",
    "contributor_impact": HISTORY
    + """, c AS (SELECT author, count(*)::BIGINT AS commits FROM commits GROUP BY author),
d AS (SELECT author, sum(insertions)::BIGINT AS insertions, sum(deletions)::BIGINT AS deletions, count(DISTINCT path)::BIGINT AS files_changed
  FROM changes JOIN commits USING (commit_id) GROUP BY author),
m AS (SELECT author, commits, coalesce(insertions, 0) AS insertions, coalesce(deletions, 0) AS deletions, coalesce(files_changed, 0) AS files_changed FROM c LEFT JOIN d USING (author)),
s AS (SELECT *, (commits * 20 + insertions + deletions * 0.5 + files_changed * 5)::DOUBLE AS score FROM m)
SELECT *, round(score / sum(score) OVER () * 100, 9) AS impact_pct, false AS is_total FROM s
UNION ALL SELECT 'Total', sum(commits)::BIGINT, sum(insertions)::BIGINT, sum(deletions)::BIGINT, -1, sum(score), 100, true FROM s""",
    "line_ownership": f"""WITH o AS (SELECT path, author, sum(lines)::BIGINT AS lines FROM (SELECT {B.PART_PATH} AS path, s_name AS author, l_quantity::BIGINT AS lines
  FROM lineitem JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey) WHERE {KEEP_AUTHOR} GROUP BY path, author)
SELECT path, author, lines, false AS is_total FROM o UNION ALL SELECT path, 'Total', sum(lines)::BIGINT, true FROM o GROUP BY path""",
    "duplicate_blocks": blocks(ALL)
    + f"""SELECT '*' AS scope, occurrences, f.root AS root, f.path AS path, f.line_no AS line_no, array_to_string(block, {NL}) AS preview FROM (
  SELECT block, count(*)::BIGINT AS occurrences, arg_min({{'root': root, 'path': path, 'line_no': line_no}}, (path, root, line_no)) AS f
  FROM blocks GROUP BY block HAVING count(*) > 1)""",
    "duplicate_block_ranking": blocks(ALL)
    + """SELECT root AS scope, block_rank, occurrences FROM (SELECT root, occurrences,
  row_number() OVER (PARTITION BY root ORDER BY occurrences DESC)::INTEGER AS block_rank
  FROM (SELECT root, block, count(*)::BIGINT AS occurrences FROM blocks GROUP BY root, block HAVING count(*) > 1)) WHERE block_rank <= 10""",
    "duplicate_locations": blocks(DOCS)
    + """SELECT root, occurrences, location_no, path, line_no FROM (SELECT *, count(*) OVER (PARTITION BY block)::BIGINT AS occurrences,
  row_number() OVER (PARTITION BY block ORDER BY path, line_no)::INTEGER AS location_no FROM blocks) WHERE occurrences > 1 AND location_no <= 5""",
    "duplicate_report": blocks(ALL)
    + f"""SELECT root, block_rank, occurrences, location_no, path, line_no, array_to_string(block, {NL}) AS preview FROM (
  SELECT *, row_number() OVER (PARTITION BY root, block ORDER BY path, line_no)::INTEGER AS location_no FROM blocks) JOIN (
  SELECT root, block, occurrences, row_number() OVER (PARTITION BY root ORDER BY occurrences DESC, path, line_no)::INTEGER AS block_rank FROM (
    SELECT root, block, count(*)::BIGINT AS occurrences, arg_min(path, (path, line_no)) AS path, arg_min(line_no, (path, line_no)) AS line_no
    FROM blocks GROUP BY root, block HAVING count(*) > 1)) USING (root, block) WHERE block_rank <= 10 AND location_no <= 5""",
    "binary_corpus": f"""SELECT 'site' AS root, {B.PAGE_PATH} AS path, html || CASE WHEN page_id % 5 = 0 THEN chr(65533) ELSE '' END AS content,
  strlen(html) + CASE WHEN page_id % 5 = 0 THEN 1 ELSE 0 END AS size_bytes, page_id % 5 <> 0 AS valid_utf8 FROM pages""",
    "grep_carriage_returns": f"SELECT root, path, line_no::BIGINT AS line_no FROM ({NUMBERED.replace(ALL, RETURNS)}) WHERE regexp_matches(line, {quote(RETURN_PATTERN)})",
    "analysis_totals": f"SELECT sum(docstrings_count)::BIGINT AS docstrings_count, sum(typehints_count)::BIGINT AS typehints_count, "
    f"sum(functions_count)::BIGINT AS functions_count, (SELECT count(*) FROM ({violations(ALL)}))::BIGINT AS naming_violations FROM ({ANALYSIS})",
    "style_totals": f"SELECT root, issue, count(*)::BIGINT AS issues FROM ({STYLE_ISSUES}) GROUP BY root, issue",
    "quality_gate": f"""WITH analysis AS ({ANALYSIS}), bad AS ({violations(ALL)}),
unused AS (SELECT DISTINCT root FROM (SELECT root, name FROM (SELECT DISTINCT root, unnest(CASE WHEN {EXT} = 'rs' THEN {RUST_NAMES} ELSE {FUNC_NAMES} END) AS name FROM ({ALL}))
  JOIN (SELECT root, unnest(regexp_extract_all(content, '[A-Za-z0-9_]+')) AS name FROM ({ALL})) USING (root, name) GROUP BY root, name HAVING count(*) = 1)),
checks AS (SELECT root, bool_or({LINES} > 300) AS large_file FROM ({ALL}) GROUP BY root),
g AS (SELECT root, large_file, (SELECT bool_or(keyword_complexity >= 4) FROM analysis a WHERE a.root = checks.root) AS high_complexity,
  root IN (SELECT root FROM bad) AS naming_violation, root IN (SELECT root FROM unused) AS dead_code FROM checks)
SELECT *, large_file OR high_complexity OR naming_violation OR dead_code AS has_issues FROM g""",
    "last_author": HISTORY + "SELECT path, arg_max(author, (ts, commit_id)) AS author FROM changes JOIN commits USING (commit_id) GROUP BY path",
    "line_trend": f"""SELECT path, recency, ts, commit_id, lines FROM (SELECT path, ts, commit_id, {LINES} AS lines,
  row_number() OVER (PARTITION BY path ORDER BY ts DESC, commit_id DESC)::INTEGER AS recency FROM ({SNAPSHOTS})) WHERE recency <= 5""",
    "project_trend": f"SELECT ts, commit_id, count(*)::BIGINT AS files, sum({LINES})::BIGINT AS lines FROM ({SNAPSHOTS}) GROUP BY ts, commit_id ORDER BY ts DESC, commit_id DESC LIMIT 5",
    "file_extremes": f"""SELECT root, b.path AS largest_path, b.lines AS largest_lines, s.path AS smallest_path, s.lines AS smallest_lines FROM (
  SELECT root, arg_max({{'path': path, 'lines': lines}}, (lines, path)) AS b, arg_min({{'path': path, 'lines': lines}}, (lines, path)) AS s
  FROM (SELECT root, path, {LINES} AS lines FROM ({ALL})) GROUP BY root)""",
    "top_files": scanned(ALL)
    + f"""SELECT root, path, language, lines, code_lines AS code, comment_lines AS comments, blank_lines AS blanks, complexity, size_bytes,
  coalesce(modified, '-') AS modified, coalesce(created, '-') AS created FROM (SELECT * FROM stats ORDER BY lines DESC, path, root LIMIT 20)
  LEFT JOIN (SELECT 'prose' AS root, {B.DOC_PATH} AS path, {MODIFIED} AS modified, {CREATED} AS created FROM documents) USING (root, path)""",
    "top_complex_files": scanned(ALL)
    + "SELECT root, path, complexity, complexity / max(complexity) OVER () AS relative FROM (SELECT * FROM stats ORDER BY complexity DESC, path, root LIMIT 15)",
    "primary_language": sized(ALL) + "SELECT language, count(*)::BIGINT AS files, sum(lines)::BIGINT AS lines FROM stats GROUP BY language ORDER BY 3 DESC, 1 LIMIT 1",
    "top_languages": sized(ALL) + "SELECT language, count(*)::BIGINT AS files, sum(lines)::BIGINT AS lines FROM stats GROUP BY language ORDER BY 3 DESC, 1 LIMIT 5",
    "issues": scanned(ALL)
    + f"""SELECT root, path, 'Large File' AS issue_type, 'File has ' || lines || ' lines (threshold: 100)' AS description FROM stats WHERE lines > 100
UNION ALL SELECT root, path, 'High Complexity', 'Complexity is ' || printf('%.1f', complexity) || ' (threshold: 3.0)' FROM stats WHERE complexity >= 3
UNION ALL SELECT root, path, 'Naming Violation', kind || ' ''' || name || ''' in "' || path || '" should be ' || rule FROM ({violations(ALL)})""",
    "refactor_candidates": scanned(ALL)
    + """SELECT root, path, lines, complexity, concat_ws(', ', CASE WHEN lines > 100 THEN 'High lines' END, CASE WHEN complexity >= 3 THEN 'High complexity' END) AS reasons,
  concat_ws(' ', CASE WHEN lines > 100 THEN 'Has ' || lines || ' lines (threshold: 100). Consider breaking it into smaller files.' END,
    CASE WHEN complexity >= 3 THEN 'Has high complexity (' || printf('%.1f', complexity) || ' >= 3.0). Consider simplifying logic or extracting functions.' END) AS advice
  FROM stats WHERE lines > 100 OR complexity >= 3""",
    "structure_edges": f"""WITH e AS (SELECT root, CASE WHEN n = 1 THEN 'root' ELSE array_to_string(parts[1:n - 1], '/') END AS parent,
  array_to_string(parts[1:n], '/') AS child, parts[n] AS name, CASE WHEN n = len(parts) THEN 'file' ELSE 'directory' END AS kind FROM ({PREFIXES}))
SELECT DISTINCT *, {NODE.format('parent')} AS parent_id,
  CASE kind WHEN 'file' THEN {NODE.format('parent')} || '_' || {NODE.format('name')} ELSE {NODE.format('child')} END AS child_id FROM e""",
    "tree_listing": f"SELECT DISTINCT root, array_to_string(parts[1:n], '/') AS path, parts[n] AS name, n::BIGINT AS depth, "
    f"CASE WHEN n = len(parts) THEN 'file' ELSE 'directory' END AS kind FROM ({PREFIXES})",
}
ORACLE["openapi_operations"] = (
    "SELECT root, '3.0.0' AS openapi, route, method, 'Auto-generated ' || route || ' route' AS summary FROM (" + ORACLE["api_routes"] + ")"
)
ORACLE["sarif_files"] = ORACLE["sarif_results"]
ORACLE["openapi_files"] = ORACLE["openapi_operations"]
ORACLE["block_stats"] = (
    scanned(ALL)
    + "SELECT path, root, language, lines, blank_lines, comment_lines, code_lines, complexity, todo_count, secrets_found, size_bytes FROM stats"
)
FOLDER = "'lang=' || lang || '/source=' || source AS folder"
ORACLE["directory_corpus"] = (
    f"SELECT {FOLDER}, sum(length(text) - length(replace(text, {NL}, '')) + 1)::BIGINT AS lines, "
    "sum(octet_length(encode(text)) + 1)::BIGINT AS size_bytes FROM documents GROUP BY 1"
)
ORACLE["directory_blocks"] = ORACLE["directory_corpus"]
ORACLE["skipped_files"] = f"SELECT DISTINCT {FOLDER}, 'larger than 0 bytes' AS reason FROM documents"
ORACLE["grep_indexed"] = GREP.replace(quote(GREP_PATTERN), quote(INDEXED_PATTERN))
ORACLE["rolled_churn"] = ORACLE["recent_churn"]
ORACLE["rolled_impact"] = ORACLE["contributor_impact"]
