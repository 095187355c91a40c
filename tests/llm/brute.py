"""Plain Python accounts of what the operators must give, written without their helpers."""

from __future__ import annotations

import hashlib
import re

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower(text: str | None) -> str:
    return (text or "").translate(LOWER)


def shingles(text: str | None, k: int = 4) -> frozenset:
    words = SPACED.findall(lower(text))
    if len(words) < k:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def components(rows: list[tuple[int, str | None]], k: int = 4, percent: int = 85) -> list[tuple[int, int, int]]:
    sets = [shingles(t, k) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both, union = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if union and 100 * both >= percent * union:
                label[find(i)] = find(j)
    smallest = {}
    for i, (d, _) in enumerate(rows):
        smallest[find(i)] = min(d, smallest.get(find(i), d))
    return sorted((d, len(sets[i]), smallest[find(i)]) for i, (d, _) in enumerate(rows))


def contamination(text: str | None, items: list[tuple[int, str | None]], window: int = 10) -> tuple:
    words = PLAIN.findall(lower(text))
    hit, ids = set(), set()
    for item, own in items:
        own = PLAIN.findall(lower(own))
        m = min(window, len(own))
        windows = {tuple(own[i : i + m]) for i in range(len(own) - m + 1)} if m else set()
        for i in range(len(words) - m + 1):
            if tuple(words[i : i + m]) in windows:
                hit.update(range(i, i + m))
                ids.add(str(item))
    digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
    return len(words), len(hit), len(ids), digest, bool(hit)


def line_key(line: str) -> str:
    return lower(line.strip(" \t\n\x0b\x0c\r"))


def kept_lines(rows: list[tuple[int, str | None]], least_chars: int = 20, least_docs: int = 3) -> list[tuple[int, int, int, str]]:
    holders: dict[str, set[int]] = {}
    for d, text in rows:
        for line in (text or "").split("\n"):
            if d is not None and len(line_key(line)) >= least_chars:
                holders.setdefault(line_key(line), set()).add(d)
    out = []
    for d, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(line_key(x)) < least_chars or len(holders.get(line_key(x), ())) < least_docs or max(holders[line_key(x)]) == d]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def base_quality(text: str | None) -> tuple:
    words = SPACED.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if SPACED.search(line):
            dup += line in seen
            seen.add(line)
    places: dict[tuple, list[int]] = {}
    for i in range(len(words) - 7):
        places.setdefault(tuple(words[i : i + 8]), []).append(i)
    repeat = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(8)}
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    failed = len(words) < 20 or 100 * len(repeat) > 30 * len(words)
    return len(words), sum(map(len, words)), symbols, dup, len(repeat), failed


def base_licences(text: str | None) -> tuple:
    words = PLAIN.findall(lower(text))
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    places, labels = [], set()
    for phrase, label in phrases.items():
        own = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(own)] == own]
        places += at
        if at:
            labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))
