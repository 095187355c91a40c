"""Repeated searches: a table of trigrams that names the files worth reading.

The table has one row for each trigram and group of files: the numbers of the files in the group that
hold it, in folders by a hash of the trigram and sorted by it within. Each task makes groups of the files it reads and
writes their rows where they arise, so nothing is shuffled, and a file's name is stored once, in a row for
its group. A search takes the texts that every match must hold from the pattern, reads the few folders of
their trigrams, and scans only files that have them all; with places (``places.with_place``)
these are read where they lie. A pattern that demands no three characters scans all files.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linetally.operators.places import only_listed
from linetally.operators.search import grep

GRAM = 3
BUCKETS = 32
#: Folder of the rows that hold the names of a group's files.
NAMES = -1
KEY = ["root", "path"]
#: A group of files is closed at so many characters or files; a step looks at so many characters.
GROUP_CHARS, GROUP_FILES, STEP_CHARS = 1 << 22, 1 << 16, 1 << 20
_HASH_BITS, _FILE_BITS = 40, 24
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_ROWS = "bucket int, gram bigint, part string, files array<int>, names array<struct<root:string,path:string>>"
_NAME = pa.struct([("root", pa.string()), ("path", pa.string())])


def _hashes(codes: np.ndarray) -> np.ndarray:
    """40 bits of each run of three code points."""
    c = codes.astype(np.uint64)
    x = c[:-2] | c[1:-1] << np.uint64(21) | c[2:] << np.uint64(42)
    for by in _MIX:
        x = (x ^ x >> np.uint64(32)) * np.uint64(by)
    return x >> np.uint64(64 - _HASH_BITS)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _distinct(pairs: np.ndarray) -> np.ndarray:
    """In order, by sorting: several times faster than ``np.unique``, which hashes."""
    pairs = np.sort(pairs)
    return pairs[np.r_[True, pairs[1:] != pairs[:-1]]] if len(pairs) else pairs


def _held(texts: list[tuple[int, str]]) -> np.ndarray:
    """Distinct pairs of a trigram within a line and the number of the text, in order, as one number each."""
    codes = _codes("\n".join(text for _, text in texts))
    if len(codes) < GRAM:
        return np.zeros(0, np.uint64)
    number = np.repeat(np.array([n for n, _ in texts], np.uint64), [len(text) + 1 for _, text in texts])
    ends = codes == 10
    within = ~(ends[:-2] | ends[1:-1] | ends[2:])
    return _distinct(_hashes(codes)[within] << np.uint64(_FILE_BITS) | number[: len(codes) - 2][within])


class _Group:
    """Files that are indexed together: their names, and the trigrams found so far."""

    def __init__(self):
        self.names: list[tuple[str, str]] = []
        self.waiting: list[tuple[int, str]] = []
        self.chars = self.step = 0
        self.held = np.zeros(0, np.uint64)

    def add(self, root: str, path: str, content: str) -> None:
        # A piece of a long text begins with the last characters of the one before.
        for at in range(0, max(len(content), 1), STEP_CHARS):
            piece = content[max(at - GRAM + 1, 0) : at + STEP_CHARS]
            self.waiting.append((len(self.names), piece))
            self.step += len(piece) + 1
            if self.step >= STEP_CHARS:
                self.look()
        self.names.append((root, path))
        self.chars += len(content)

    def look(self) -> None:
        if self.waiting:
            found = _held(self.waiting)
            self.held = _distinct(np.concatenate([self.held, found]))
            self.waiting, self.step = [], 0

    @property
    def full(self) -> bool:
        return self.chars >= GROUP_CHARS or len(self.names) >= GROUP_FILES

    def rows(self, part: str) -> pa.RecordBatch:
        self.look()
        grams = self.held >> np.uint64(_FILE_BITS)
        first = np.flatnonzero(np.r_[len(grams) > 0, grams[1:] != grams[:-1]]) if len(grams) else np.zeros(0, np.int64)
        gram, n = grams[first].astype(np.int64), len(first)
        files = (self.held & np.uint64((1 << _FILE_BITS) - 1)).astype(np.int32)
        bounds = pa.array(np.r_[first, len(files), len(files)].astype(np.int32))
        names = pa.array([None] * n + [[{"root": r, "path": p} for r, p in self.names]], pa.list_(_NAME))
        columns = [
            pa.array(np.r_[_bucket(gram), NAMES].astype(np.int32)),
            pa.array(np.r_[gram, 0]),
            pa.array([part] * (n + 1)),
            pa.ListArray.from_arrays(bounds, pa.array(files)),
            names,
        ]
        return pa.RecordBatch.from_arrays(columns, names=["bucket", "gram", "part", "files", "names"])


def _bucket(gram):
    return gram * BUCKETS >> _HASH_BITS


def _grouped(run: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, made, task = _Group(), 0, TaskContext.get().partitionId()
        for batch in batches:
            for root, path, content in zip(*[column.to_pylist() for column in batch.columns], strict=True):
                if content:
                    group.add(root, path, content)
                if group.full:
                    yield group.rows(f"{run}-{task}-{made}")
                    group, made = _Group(), made + 1
        if group.names:
            yield group.rows(f"{run}-{task}-{made}")

    return rows


def postings(files: DataFrame) -> DataFrame:
    """``bucket, gram, part, files, names``: for a group of files (``part``), the numbers of those that hold a
    trigram (a hash of three characters within a line), and in one row more their names.

    Groups are made as rows come: store the table before parts of it are used.
    """
    return files.select(*KEY, F.make_valid_utf8("content")).mapInArrow(_grouped(uuid.uuid4().hex[:16]), _ROWS)


def write_index(files: DataFrame, location: str, mode: str = "errorifexists") -> None:
    """Store the trigrams of a corpus. New files are added by ``mode="append"``."""
    postings(files).sortWithinPartitions("bucket", "gram").write.mode(mode).partitionBy("bucket").parquet(location)


def required_texts(pattern: str) -> list[str]:
    """Texts that every match of a pattern holds, each a run of plain characters.

    Only what stands at the top of the pattern counts: groups, classes and what a quantifier
    may leave out are passed over. Alternatives at the top, flags and quoted runs demand nothing.
    """
    runs, run, i = [], "", 0

    def closing(at: int) -> int:
        """Behind the group or class that opens at ``at``; the end if it never closes."""
        depth, inside = 0, False
        while at < len(pattern):
            c = pattern[at]
            if c == "\\":
                at += 1
            elif inside:
                inside = c != "]"
            elif c == "[":
                inside = True
            elif c == "(":
                depth += 1
            elif c == ")":
                depth -= 1
            at += 1
            if not inside and depth == 0:
                return at
        return len(pattern)

    while i < len(pattern):
        c = pattern[i]
        if c == "|" or (c == "(" and pattern[i + 1 : i + 2] == "?" and pattern[i + 2 : i + 3] not in (":", "=", "!", "<", ">")):
            return []
        if c in "[(":
            # A class in a class, or a bracket right behind the opening one, is beyond this scan.
            end = closing(i)
            if c == "[" and any(x in pattern[i + 1 : end] for x in ("[", "&&")) or pattern[i + 1 : i + 2] == "]" or pattern[i + 1 : i + 3] == "^]":
                return []
            if c == "(" and "[" in pattern[i:end]:
                return []
            runs.append(run)
            run, i = "", end
        elif c == "\\":
            if pattern[i + 1 : i + 2].isalnum():
                if pattern[i + 1] not in "bBdDsSwWhHvVRAzZG":
                    return []
                runs.append(run)
                run = ""
            else:
                run += pattern[i + 1 : i + 2]
            i += 2
        elif c in "*?{":
            runs.append(run[:-1])
            run = ""
            i = pattern.find("}", i) + 1 if c == "{" else i + 1
            if i == 0:
                return []
        elif c in "+.^$":
            runs.append(run)
            run, i = "", i + 1
        else:
            run += c
            i += 1
    return [r for r in [*runs, run] if len(r) >= GRAM]


def candidates(index: DataFrame, pattern: str) -> DataFrame | None:
    """``root, path`` of files that hold all trigrams a match needs; None if it needs none."""
    grams = sorted({text[i : i + GRAM] for text in required_texts(pattern) for i in range(len(text) - GRAM + 1)})
    if not grams:
        return None
    wanted = sorted({int(_hashes(_codes(g))[0]) for g in grams})
    rows = index.where(F.col("bucket").isin(sorted({_bucket(w) for w in wanted})) & F.col("gram").isin(wanted))
    found = rows.groupBy("part").agg(F.collect_list("files").alias("lists")).where(F.size("lists") == len(wanted))
    both = F.aggregate("lists", F.col("lists")[0], F.array_intersect)
    held = found.select("part", both.alias("files")).where(F.size("files") > 0)
    names = index.where(F.col("bucket") == NAMES).select("part", "names")
    listed = held.join(names, "part").select("names", F.explode("files").alias("file"))
    return listed.select(F.get("names", F.col("file")).alias("name")).select("name.*")


def grep_indexed(files: DataFrame, index: DataFrame, pattern: str) -> DataFrame:
    """The lines that ``search.grep`` finds, from the files that the index names."""
    named = candidates(index, pattern)
    return grep(files if named is None else only_listed(files, named, KEY), pattern)
