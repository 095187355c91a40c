"""An independent account of the scanner rules in plain Python.

The text is first cut into labelled spans by searching for the next opener and its
closer; all counters are then read off the labels. Nothing here is shared with the
engine's patterns.
"""

from __future__ import annotations

import string

WORD_CHARS = set(string.ascii_letters + string.digits + "_-")
CODE, TEXT, NOTE = "code", "text", "note"
LINE_OPENERS = {"c": ["//"], "p": ["#"], "h": [], "n": []}
BLOCK_OPENERS = {
    "c": [("/*", "*/")],
    "p": [('"""', '"""'), ("'''", "'''")],
    "h": [("<!--", "-->")],
    "n": [],
}
KEYWORDS = {"if", "for", "while", "match", "catch", "case", "try", "except"}
SECRETS = ("AKIA", "ghp_", "sk_live_", "xoxb-")


def string_end(text: str, start: int) -> int:
    quote, i = text[start], start + 1
    while i < len(text):
        if text[i] == "\\":
            i += 1
            while i < len(text) and text[i] == "\r":
                i += 1
            i += 1
        elif text[i] == quote:
            return i + 1
        else:
            i += 1
    return len(text)


def spans(text: str, style: str):
    """``(start, end, label, opener length, closer length)`` covering the text."""
    at = 0
    while at < len(text):
        found = []
        for rank, opener in enumerate(LINE_OPENERS[style]):
            found.append((text.find(opener, at), 0, rank, opener, None))
        for rank, (opener, closer) in enumerate(BLOCK_OPENERS[style]):
            found.append((text.find(opener, at), 0, rank, opener, closer))
        for rank, quote in enumerate("\"'`"):
            found.append((text.find(quote, at), 1, rank, quote, quote))
        found = sorted(f for f in ((p, *rest) for p, *rest in found) if f[0] >= 0)
        if not found:
            yield at, len(text), CODE, 0, 0
            return
        start, kind, _, opener, closer = found[0]
        if start > at:
            yield at, start, CODE, 0, 0
        if kind == 1:
            end = string_end(text, start)
            yield start, end, TEXT, 0, 0
        elif closer is None:
            end = text.find("\n", start)
            end = len(text) if end < 0 else end
            yield start, end, NOTE, 0, 0
        else:
            close = text.find(closer, start + len(opener))
            end = len(text) if close < 0 else close + len(closer)
            yield start, end, NOTE, len(opener), len(closer) if close >= 0 else 0
        at = end


def counters(text: str, style: str) -> tuple:
    labels = [CODE] * len(text)
    stream: list[tuple[str, str]] = []
    for start, end, label, opened, closed in spans(text, style):
        labels[start:end] = [label] * (end - start)
        if style == "h" and label == NOTE:
            stream.append((" ", label))
            stream += [(c, label) for c in text[start + opened : end - closed]]
            stream += [("-", CODE), ("-", CODE)] if closed else []
        else:
            stream += [(c, label) for c in text[start:end]]

    lines = text.split("\n")
    if lines[-1] == "":
        lines.pop()
    blank = comment = code = at = 0
    for line in lines:
        marks = {
            NOTE if labels[at + i] == NOTE else CODE
            for i, c in enumerate(line)
            if c != "\r" and (labels[at + i] != CODE or c not in " \t")
        }
        code += CODE in marks
        comment += marks == {NOTE}
        blank += not marks
        at += len(line) + 1

    words, word, last = [], "", CODE
    for c, label in [*stream, ("\n", CODE)]:
        if c in WORD_CHARS:
            word, last = word + c, label
        elif word:
            words.append((word, last))
            word = ""
    branches = sum(label == CODE and w in KEYWORDS for w, label in words)
    for i, c in enumerate(text):
        if labels[i] == CODE:
            branches += c == "?" or (c in "&|" and text[i + 1 : i + 2] == c)
    todos = sum(label == NOTE and w.lower() in ("todo", "hack", "fixme") for w, label in words)
    secrets = sum(w.startswith(SECRETS) for w, _ in words)
    return len(lines), blank, comment, code, float(branches), todos, secrets
