"""Chat formatting: a small template language, compiled to Python closures.

A template is parsed into a syntax tree, constant parts are folded, and the tree becomes
nested closures that write a conversation into a list and note which stretches the model
is to be trained on (``{% generation %} ... {% endgeneration %}``).

    {{ expression }}                      text, a number, or nothing for none
    {% for name in expression %} ... {% endfor %}       with loop.index, .first, .last
    {% if e %} ... {% elif e %} ... {% else %} ... {% endif %}

Expressions: strings, whole numbers, true, false, none, names, ``a.b`` and ``a['b']``
(items of mappings and lists only), ``not and or in == != < <= > >= + ~``, brackets, and
filters ``|escape |escape_name |trim |upper |lower |length |default('x')``. There are no
calls and no attributes of Python objects, so a template reaches nothing but its data.
``< <= > >=`` are false between values of different kinds (or of none). Expressions and
blocks nest ``MOST_LEVELS`` deep, and an expression has ``MOST_TOKENS`` tokens at most; whatever
is against the rules is a ``TemplateError`` when the template is compiled.
"""

from __future__ import annotations

import hashlib
import operator
import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linetally.llm.batches import quoted, table, tidy

#: How deep expressions and blocks nest, and how long an expression is, at most.
MOST_LEVELS = 40
MOST_TOKENS = 300
_MOST_DIGITS = 18
#: Conversations that are handed on together, at most, and the characters of their texts.
_BATCH_ROWS, _BATCH_CHARS = 256, 1 << 20
#: A turn opens with a heading and closes with a mark.
OPEN, COLON, CLOSE = "### ", ": ", "</turn>"
TURNS = "{% for m in messages %}### {{ m.role | escape_name }}: {% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}</turn>\n{% endfor %}"

_CONTROL = re.compile(r"\\|#(?=##)|<(?=/turn>)")
_NAME_CONTROL = re.compile(r"\\|#(?=##)|<(?=/turn>)|:")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*+): ((?:[^\\<]|\\.|<(?!/turn>))*+)</turn>\n", re.DOTALL)


def escape(text: str) -> str:
    """A backslash before every backslash and every place where a control string begins."""
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def escape_name(text: str) -> str:
    return _NAME_CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class TemplateError(ValueError):
    pass


_FILTERS: dict[str, Callable] = {
    "escape": lambda x: escape(_text(x)),
    "escape_name": lambda x: escape_name(_text(x)),
    "trim": lambda x: _text(x).strip(),
    "upper": lambda x: _text(x).upper(),
    "lower": lambda x: _text(x).lower(),
    "length": lambda x: len(x) if isinstance(x, (str, list, tuple, dict)) else 0,
    "default": lambda x, other="": other if x is None else x,
}
#: Arguments that a filter takes at most.
_ARGUMENTS = {"default": 1}


def _ordered(compare: Callable) -> Callable[[Any, Any], bool]:
    def run(a: Any, b: Any) -> bool:
        alike = isinstance(a, str) and isinstance(b, str) or isinstance(a, int) and isinstance(b, int)
        return alike and compare(a, b)

    return run


_COMPARE = {"==": operator.eq, "!=": operator.ne, **{w: _ordered(f) for w, f in (("<", operator.lt), ("<=", operator.le), (">", operator.gt), (">=", operator.ge))}}
_LEX = re.compile(r"\s*(?:(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<mark>==|!=|<=|>=|[<>+~|.\[\](),]))")
_PARTS = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}|\{#.*?#\}", re.DOTALL)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _text(x: Any) -> str:
    if x is None:
        return ""
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, (str, int)):
        return str(x)
    raise TemplateError(f"no text: a {type(x).__name__}")


def _item(x: Any, key: Any) -> Any:
    if isinstance(x, dict):
        return x.get(key) if isinstance(key, (str, int)) else None
    if isinstance(x, (list, tuple)) and isinstance(key, int) and not isinstance(key, bool):
        return x[key] if -len(x) <= key < len(x) else None
    return None


def _joined(a: Any, b: Any) -> Any:
    if isinstance(a, int) and isinstance(b, int):
        return a + b
    return _text(a) + _text(b)


def _within(a: Any, b: Any) -> bool:
    if isinstance(b, str):
        return _text(a) in b
    if isinstance(b, dict):
        return isinstance(a, (str, int)) and a in b
    return a in b if isinstance(b, (list, tuple)) else False


class _Expression:
    """Recursive descent; nodes are ("const", x), ("name", n) and (function, node, ...)."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, Any]] = []
        self.level = 0
        at, source = 0, source.strip()
        while at < len(source):
            m = _LEX.match(source, at)
            if not m:
                raise TemplateError(f"not understood: {source[at:]!r}")
            kind = m.lastgroup
            word = m[kind]
            if len(self.tokens) >= MOST_TOKENS:
                raise TemplateError(f"an expression of more than {MOST_TOKENS} tokens")
            if kind == "number":
                if len(word) > _MOST_DIGITS:
                    raise TemplateError(f"a number of more than {_MOST_DIGITS} digits")
                self.tokens.append(("const", int(word)))
            elif kind == "string":
                self.tokens.append(("const", re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), word[1:-1], flags=re.DOTALL)))
            else:
                self.tokens.append((kind, word))
            at = m.end()
        self.at = 0

    def peek(self) -> Any:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "const" else None

    def take(self, *wanted: str) -> str | None:
        word = self.peek()
        if word in wanted:
            self.at += 1
            return word
        return None

    def need(self, word: str) -> None:
        if not self.take(word):
            raise TemplateError(f"{word!r} is missing")

    def whole(self) -> tuple:
        node = self.either()
        if self.at != len(self.tokens):
            raise TemplateError(f"too much: {self.tokens[self.at :]}")
        return node

    def deeper(self, rule: Callable[[], tuple]) -> tuple:
        self.level += 1
        if self.level > MOST_LEVELS:
            raise TemplateError(f"an expression of more than {MOST_LEVELS} levels")
        node = rule()
        self.level -= 1
        return node

    def either(self) -> tuple:
        node = self.deeper(self.both)
        while self.take("or"):
            node = ("or", node, self.deeper(self.both))
        return node

    def both(self) -> tuple:
        node = self.negated()
        while self.take("and"):
            node = ("and", node, self.negated())
        return node

    def negated(self) -> tuple:
        return (operator.not_, self.deeper(self.negated)) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        node = self.summed()
        while word := self.take(*_COMPARE, "in"):
            node = (_within if word == "in" else _COMPARE[word], node, self.summed())
        return node

    def summed(self) -> tuple:
        node = self.filtered()
        while self.take("+", "~"):
            node = (_joined, node, self.filtered())
        return node

    def filtered(self) -> tuple:
        node = self.reached()
        while self.take("|"):
            name = self.peek()
            if name not in _FILTERS:
                raise TemplateError(f"no such filter: {name}")
            self.at += 1
            more = []
            if self.take("("):
                while not self.take(")"):
                    more.append(self.either())
                    self.take(",")
            if len(more) > _ARGUMENTS.get(name, 0):
                raise TemplateError(f"{name} takes fewer arguments")
            node = (_FILTERS[name], node, *more)
        return node

    def reached(self) -> tuple:
        node = self.simple()
        while word := self.take(".", "["):
            if word == ".":
                if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
                    raise TemplateError("a name is missing after a dot")
                key = ("const", self.tokens[self.at][1])
                self.at += 1
            else:
                key = self.either()
                self.need("]")
            node = (_item, node, key)
        return node

    def simple(self) -> tuple:
        if self.take("("):
            node = self.either()
            self.need(")")
            return node
        if self.at >= len(self.tokens):
            raise TemplateError("an expression is missing")
        kind, word = self.tokens[self.at]
        self.at += 1
        if kind == "const":
            return ("const", word)
        if kind == "name":
            constants = {"true": True, "false": False, "none": None}
            return ("const", constants[word]) if word in constants else ("name", word)
        raise TemplateError(f"unexpected {word!r}")


def fold(node: tuple) -> tuple:
    """An expression with every part that has no name replaced by its value."""
    head, *parts = node
    if head in ("const", "name"):
        return node
    parts = [fold(p) for p in parts]
    if head in ("and", "or") and parts[0][0] == "const":
        return parts[1] if bool(parts[0][1]) == (head == "and") else parts[0]
    if head not in ("and", "or") and all(p[0] == "const" for p in parts):
        return ("const", head(*[p[1] for p in parts]))
    return (head, *parts)


def _value(node: tuple) -> Callable[[dict], Any]:
    head, *parts = node
    if head == "const":
        constant = parts[0]
        return lambda names: constant
    if head == "name":
        name = parts[0]
        return lambda names: names.get(name)
    inner = [_value(p) for p in parts]
    if head == "and":
        return lambda names: inner[0](names) and inner[1](names)
    if head == "or":
        return lambda names: inner[0](names) or inner[1](names)
    if len(inner) == 1:
        only = inner[0]
        return lambda names: head(only(names))
    if len(inner) == 2:
        a, b = inner
        return lambda names: head(a(names), b(names))
    return lambda names: head(*[f(names) for f in inner])


def parse(template: str) -> list[tuple]:
    """The syntax tree: ("text", s), ("out", e), ("for", name, e, body), ("if", [(e, body)]), ("generation", body)."""
    top: list[tuple] = []
    stack: list[tuple[str, list]] = [("", top)]
    at = 0

    def close(kind: str) -> None:
        if stack[-1][0] != kind:
            raise TemplateError(f"end of {kind!r} inside {stack[-1][0]!r}")
        stack.pop()

    for m in _PARTS.finditer(template):
        if m.start() > at:
            stack[-1][1].append(("text", template[at : m.start()]))
        at = m.end()
        if len(stack) > MOST_LEVELS:
            raise TemplateError(f"blocks of more than {MOST_LEVELS} levels")
        if m[1] is not None:
            stack[-1][1].append(("out", _Expression(m[1]).whole()))
        elif m[2] is not None:
            word, _, rest = m[2].strip().partition(" ")
            body: list[tuple] = []
            if word == "for":
                found = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.*)", rest, re.DOTALL)
                if not found:
                    raise TemplateError(f"not understood: for {rest}")
                stack[-1][1].append(("for", found[1], _Expression(found[2]).whole(), body))
                stack.append(("for", body))
            elif word == "if":
                stack[-1][1].append(("if", [(_Expression(rest).whole(), body)]))
                stack.append(("if", body))
            elif word in ("elif", "else"):
                close("if")
                stack[-1][1][-1][1].append((_Expression(rest).whole() if word == "elif" else ("const", True), body))
                stack.append(("if", body))
            elif word == "generation":
                stack[-1][1].append(("generation", body))
                stack.append(("generation", body))
            elif word in ("endfor", "endif", "endgeneration"):
                close(word[3:])
            else:
                raise TemplateError(f"no such statement: {word}")
    if at < len(template):
        stack[-1][1].append(("text", template[at:]))
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]!r} has no end")
    return top


def fold_tree(body: list[tuple]) -> list[tuple]:
    """The tree with constants folded, branches that can't be taken left out, and texts joined."""
    out: list[tuple] = []

    def add(node: tuple) -> None:
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        elif node != ("text", ""):
            out.append(node)

    for node in body:
        if node[0] == "out":
            e = fold(node[1])
            add(("text", _text(e[1])) if e[0] == "const" else ("out", e))
        elif node[0] == "for":
            add(("for", node[1], fold(node[2]), fold_tree(node[3])))
        elif node[0] == "if":
            arms = []
            for e, inner in node[1]:
                e = fold(e)
                if e[0] == "const" and not e[1]:
                    continue
                arms.append((e, fold_tree(inner)))
                if e[0] == "const":
                    break
            if arms and arms[0][0][0] == "const":
                for x in arms[0][1]:
                    add(x)
            elif arms:
                add(("if", arms))
        elif node[0] == "generation":
            add(("generation", fold_tree(node[1])))
        else:
            add(node)
    return out


class _Output:
    def __init__(self):
        self.parts: list[str] = []
        self.chars = 0
        self.spans: list[tuple[int, int]] = []

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.chars += len(text)


def _writer(body: list[tuple]) -> Callable[[_Output, dict], None]:
    steps = [_step(node) for node in body]
    if len(steps) == 1:
        return steps[0]

    def run(out: _Output, names: dict) -> None:
        for step in steps:
            step(out, names)

    return run


def _step(node: tuple) -> Callable[[_Output, dict], None]:
    kind = node[0]
    if kind == "text":
        text = node[1]
        return lambda out, names: out.write(text)
    if kind == "out":
        value = _value(node[1])
        return lambda out, names: out.write(_text(value(names)))
    if kind == "generation":
        inner = _writer(node[1])

        def marked(out: _Output, names: dict) -> None:
            start = out.chars
            inner(out, names)
            out.spans.append((start, out.chars))

        return marked
    if kind == "if":
        arms = [(_value(e), _writer(inner)) for e, inner in node[1]]

        def choose(out: _Output, names: dict) -> None:
            for test, inner in arms:
                if test(names):
                    inner(out, names)
                    return

        return choose
    _, name, source, inner = node
    items, each = _value(source), _writer(inner)

    def loop(out: _Output, names: dict) -> None:
        found = items(names)
        found = list(found) if isinstance(found, (list, tuple)) else []
        for i, x in enumerate(found):
            each(out, names | {name: x, "loop": {"index": i + 1, "index0": i, "first": i == 0, "last": i == len(found) - 1}})

    return loop


def compile_template(template: str) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """A function from the template's data to ``(text, spans under the loss mask)``, in code points."""
    write = _writer(fold_tree(parse(template)))

    def render(names: dict) -> tuple[str, list[tuple[int, int]]]:
        out = _Output()
        write(out, names)
        return "".join(out.parts), out.spans

    return render


def _batched(rows: Iterator[tuple], chars: Callable[[tuple], int], types: list[tuple[str, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded size."""
    waiting: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        columns = zip(*waiting, strict=True)
        return table([pa.array(c, t) for c, (_, t) in zip(columns, types, strict=True)], [n for n, _ in types])

    for row in rows:
        waiting.append(row)
        size += chars(row)
        if len(waiting) >= _BATCH_ROWS or size >= _BATCH_CHARS:
            yield batch()
            waiting, size = [], 0
    if waiting:
        yield batch()


def _conversations(batches) -> Iterator[tuple[int | None, list[dict]]]:
    """Runs of rows of one conversation; they may reach over batches."""
    known, now, messages = False, None, []
    for batch in batches:
        for conv, role, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if known and conv != now:
                yield now, messages
                messages = []
            known, now = True, conv
            messages.append({"role": role or "", "text": text or ""})
    if known:
        yield now, messages


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def format_conversations(turns: DataFrame, template: str = TURNS, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, n_turns, text, loss)`` of each conversation: its text, and spans of code points to train on.

    Rows are ordered by turn, ties by role and text; null roles and texts are empty; rows
    without a conversation id are one conversation. Rows are dealt by conversation, sorted
    and streamed, so a task holds one conversation at a time.
    """
    compile_template(template)  # errors show here, not in a task
    rows = turns.select(quoted(conv_col).cast("long").alias("conv"), quoted(turn_col).cast("long").alias("turn"), quoted(role_col).cast("string").alias("role"), quoted(text_col).cast("string").alias("text"))

    def run(batches):
        render = compile_template(template)

        def formatted() -> Iterator[tuple]:
            for conv, messages in _conversations(batches):
                text, spans = render({"messages": messages})
                yield conv, len(messages), text, [{"start": a, "end": b} for a, b in spans]

        yield from _batched(formatted(), lambda row: len(row[2]), [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("text", pa.string()), ("loss", _SPAN)])

    ordered = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text")
    return ordered.mapInArrow(tidy(run), "conv_id long, n_turns long, text string, loss array<struct<start: long, end: long>>")


def read_turns(text: str) -> list[tuple[str, str]]:
    """``(role, text)`` of each turn, from what the ``TURNS`` template wrote."""
    out, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def read_back(formatted: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)`` from formatted texts."""

    def digests(batches) -> Iterator[tuple]:
        for batch in batches:
            for conv, text, spans in zip(*[batch.column(k) for k in range(3)], strict=True):
                text = text.as_py()
                turns = read_turns(text)
                whole = hashlib.sha256()
                for role, own in turns:
                    whole.update(f"{role}\n{own}\n".encode())
                loss, chars = hashlib.sha256(), 0
                for span in spans.as_py():
                    own = unescape(text[span["start"] : span["end"]])
                    loss.update(own.encode())
                    chars += len(own)
                yield conv.as_py(), len(turns), whole.hexdigest(), chars, loss.hexdigest(), len(text)

    kinds = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]

    def run(batches):
        yield from _batched(digests(batches), lambda row: 0, kinds)

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("conv_id", "text", "loss").mapInArrow(tidy(run), schema)
