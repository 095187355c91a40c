"""Jaccard self-join of shingle sets by size: subsets for small sets, inverted lists for large ones.

Two sets link when ``100 * common >= percent * union`` (``PERCENT``, if not given), so a
pair of sizes (a, b) needs ``c = ceil(percent * (a + b) / (100 + percent))`` common elements.

* Equal sets are one node from the start; everything below is about different sets.
* Small sets list all subsets of the c elements that they could share with a set of each
  fitting size. Two small sets link exactly if they list a subset in common, and a
  subset's sets are chained to one of them, not to each other.
* Large sets go into inverted lists, rarest elements first. The first
  ``n - ceil(percent / 100 * n) + 1`` elements of a set (and a few more) meet those of every set it
  links with, and a pair must meet there a number of times that follows from both sizes.
* The boundary between the two is where their estimated costs, over the sizes of all
  sets, are least.
* List entries that can't belong to a link are dropped: rare elements come first, and a set
  with too many that no other set lists is out of reach of every other.
* Lists are walked several times. First every set is compared with that head of its lists
  which it meets most often; this joins near copies, however many, with one comparison
  each. Last, only pairs whose sets are not connected yet are counted, and those that meet
  often enough are compared. Sets are compared whole.

Set elements are 64-bit hashes of shingles; nodes are 64-bit hashes of sets. Two of a
billion sets share one with a chance of 3 %, two shingles of one text of a million words
with a chance below 10^-7.
"""

from __future__ import annotations

import itertools
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linetally.llm.batches import LOWER, NOT_SPACE, Texts, id_and_bytes, mixed, slices, table, tidy, window_hashes, window_starts, word_hashes, words
from linetally.llm.store import shared_folder, written
from linetally.operators.places import PLACE, at_masks, write_masks

#: Words of a shingle, and the similarity from which sets link, where a caller names no others.
SHINGLE = 4
PERCENT = 85
#: Sets up to this size may be small; above, the number of subsets explodes.
MOST_SMALL = 16
#: What looking at one list entry costs, in emitted subsets.
ENTRY_COST = 4.0
#: Frequent shingles whose order is known, at most (16 bytes each in every task).
FREQUENT = 1 << 20
#: Rounds in which list entries are dropped, walks along heads, and heads of a list in each.
PRUNINGS, WALKS, HEADS = 2, 2, 3
_CHUNK = 1 << 21
_CHUNK_LEAST = 3
#: Bits of the filters that spare texts a shuffle: fixed, so they may be broadcast.
FILTER_BITS = 24
_SALT = np.uint64(0x2545F4914F6CDD1D)


def common_needed(a, b, percent: int = PERCENT):
    """Common elements of a pair of sizes that link."""
    return -(-percent * (a + b) // (100 + percent))


def list_length(n: int, percent: int = PERCENT) -> int:
    """Elements of a set of n that go into lists: enough to meet, and a few to meet more often."""
    return min(n, n - -(-percent * n // 100) + 1 + n // 50)


def shingle_sets(texts: Texts, k: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingles of each row; a row of fewer words is one shingle."""
    buf = LOWER[texts.buf]
    found = words(buf, texts.offsets, NOT_SPACE)
    hashes = word_hashes(buf, found)
    starts, bounds = window_starts(found.first, k)
    windows = window_hashes(hashes, k)[starts] if len(starts) else np.empty(0, np.uint64)
    out = []
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        if b > a:
            own = np.sort(windows[a:b])
            keep = np.ones(b - a, dtype=bool)
            keep[1:] = own[1:] != own[:-1]
            out.append(own[keep])
        else:
            first, end = found.first[i], found.first[i + 1]
            out.append(window_hashes(hashes[first:end], int(end - first)) + np.uint64(end - first) if end > first else np.empty(0, np.uint64))
    return out


def set_keys(own: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set that don't depend on order."""
    two = np.array([mixed(own).sum(dtype=np.uint64), mixed(own ^ _SALT).sum(dtype=np.uint64)]) + np.uint64(len(own))
    a, b = mixed(two).view(np.int64).tolist()
    return a, b


def fitting_sizes(n: int, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Sizes of sets that one of n can link with, and how many elements they share at least."""
    sizes = range(-(-percent * n // 100), 100 * n // percent + 1)
    return [(m, common_needed(n, m, percent)) for m in sizes if m > 0 and common_needed(n, m, percent) <= min(n, m)]


def subsets_listed(n: int, boundary: int, percent: int = PERCENT) -> int:
    return sum(math.comb(n, c) for m, c in fitting_sizes(n, percent) if m <= boundary)


def subset_keys(own: np.ndarray, boundary: int, percent: int = PERCENT) -> np.ndarray:
    """Keys of all subsets that a small set could share with another small one.

    Odd keys are for a pair of different sizes: they link sets of both, not two of one.
    """
    n = len(own)
    part = mixed(own)
    whole = part.sum(dtype=np.uint64)
    out = []
    for m, c in fitting_sizes(n, percent):
        if m > boundary:
            continue
        low, high = min(n, m), max(n, m)
        tag = np.uint64((low << 40) | (high << 20) | c)
        left_out = [sum((int(part[i]) for i in gone), 0) & (1 << 64) - 1 for gone in itertools.combinations(range(n), n - c)]
        key = mixed((whole - np.array(left_out, dtype=np.uint64)) ^ mixed(np.array([tag])))
        out.append(key & ~np.uint64(1) | np.uint64(low != high))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def choose_boundary(sizes: dict[int, int], entry_cost: float = ENTRY_COST, percent: int = PERCENT) -> int:
    """The size up to which listing subsets is cheaper than list entries, for these numbers of sets."""

    def cost(x: int) -> float:
        small = sum(k * subsets_listed(n, x, percent) for n, k in sizes.items() if n <= x)
        return small + sum(k * list_length(n, percent) * entry_cost for n, k in sizes.items() if n >= in_lists_from(x, percent))

    return min(range(MOST_SMALL + 1), key=cost)


def in_lists_from(boundary: int, percent: int = PERCENT) -> int:
    """The smallest size that can link with one above the boundary, and so must be in lists too."""
    return -(-percent * (boundary + 1) // 100)


def _profile(docs: DataFrame, id_col: str, text_col: str, k: int) -> tuple[dict[int, int], np.ndarray, np.ndarray]:
    """``(numbers of small sizes, frequent shingles, their counts)`` over all documents.

    Tasks count shingles of some thousand documents at a time and hand on those found a few
    times; a shingle of a large share of documents is among them everywhere.
    """

    def run(batches):
        held, size, sizes = [], 0, np.zeros(MOST_SMALL * 2 + 1, dtype=np.int64)

        def counted():
            distinct, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= _CHUNK_LEAST
            return table([pa.array(np.zeros(often.sum(), np.int32)), distinct[often].view(np.int64), n[often]], ["kind", "key", "n"])

        for batch in batches:
            for texts, _, _ in slices(batch):
                for own in shingle_sets(texts, k):
                    if 0 < len(own) < len(sizes):
                        sizes[len(own)] += 1
                    held.append(own)
                    size += len(own)
                if size >= _CHUNK:
                    yield counted()
                    held, size = [], 0
        if size:
            yield counted()
        yield table([pa.array(np.ones(len(sizes), np.int32)), np.arange(len(sizes)), sizes], ["kind", "key", "n"])

    found = written(id_and_bytes(docs, id_col, text_col).mapInArrow(tidy(run), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "shingle-counts")
    sizes = {row.key: row.n for row in found.where("kind = 1 and n > 0").collect()}
    often = found.where("kind = 0").orderBy(F.desc("n"), "key").limit(FREQUENT).select("key", "n").toArrow()
    key = often.column("key").to_numpy().view(np.uint64)
    order = np.argsort(key)
    return sizes, key[order], often.column("n").to_numpy()[order]


class _Order:
    """Elements by how frequent they are, then by hash."""

    def __init__(self, key: np.ndarray, n: np.ndarray):
        self.key = key
        self.rank = np.floor(np.log2(np.maximum(n, 1))).astype(np.uint64) + np.uint64(1)
        self.some = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.some[(key >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def first(self, own: np.ndarray, length: int) -> np.ndarray:
        if not len(self.key):
            return own[:length]
        maybe = np.flatnonzero(self.some[(own >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        if not len(maybe):
            return own[:length]
        at = np.minimum(np.searchsorted(self.key, own[maybe]), len(self.key) - 1)
        rank = np.zeros(len(own), dtype=np.uint64)
        rank[maybe] = np.where(self.key[at] == own[maybe], self.rank[at], np.uint64(0))
        return own[np.argsort(rank, kind="stable")[:length]]


def _sets(docs: DataFrame, boundary: int, key: np.ndarray, n: np.ndarray, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """``(id, n, node, check, listed, subsets)`` of every row; repeats of a set in a task list nothing."""
    shared = docs.sparkSession.sparkContext.broadcast((key, n))
    names = ["id", "n", "node", "check", "listed", "subsets"]
    least = in_lists_from(boundary, percent)

    def run(batches):
        order, seen = _Order(*shared.value), set()
        none = np.empty(0, np.int64)
        for batch in batches:
            for texts, _, _ in slices(batch):
                size, node, check, listed, subsets = [], [], [], [], []
                for x, own in zip(texts.ids.to_pylist(), shingle_sets(texts, k), strict=True):
                    a, b = set_keys(own)
                    size.append(len(own))
                    node.append(a)
                    check.append(b)
                    new = len(own) > 0 and x is not None and a not in seen
                    listed.append(order.first(own, list_length(len(own), percent)).view(np.int64) if new and len(own) >= least else none)
                    subsets.append(np.unique(subset_keys(own, boundary, percent)).view(np.int64) if new and len(own) <= boundary else none)
                    if len(seen) > 1_000_000:
                        seen.clear()
                    if new:
                        seen.add(a)
                longs = pa.list_(pa.int64())
                yield table([texts.ids, pa.array(size, pa.int64()), pa.array(node, pa.int64()), pa.array(check, pa.int64()), pa.array(listed, longs), pa.array(subsets, longs)], names)

    schema = "id long, n long, node long, check long, listed array<long>, subsets array<long>"
    return written(id_and_bytes(docs, id_col, text_col).mapInArrow(tidy(run), schema), "sets")


def bit_filter(df: DataFrame, value: str) -> np.ndarray:
    """A bit array of fixed size in which every hash in the column ``value`` has its bit (true for others by chance)."""
    bits = df.select(F.shiftrightunsigned(F.col(value), 64 - FILTER_BITS).alias("bit"))
    word = bits.selectExpr("cast(shiftright(bit, 6) as int) as at", "shiftleft(1L, cast(bit % 64 as int)) as bits")
    rows = word.groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), dtype=np.uint64)
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def in_filter(bits: np.ndarray, value: np.ndarray) -> np.ndarray:
    bit = value >> np.uint64(64 - FILTER_BITS)
    return (bits[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) != 0


def _compared(docs: DataFrame, pairs: DataFrame, one_of: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` of nodes that link: their sets are made again from one text each and compared whole.

    ``one_of``: ``(node, id)``. Texts of other nodes are passed over by a filter of fixed size.
    """
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(one_of, "node")
    wanted = written(nodes.select("node", "id", F.xxhash64("node", "id").alias("mark")), "wanted-sets")
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(wanted.select(F.xxhash64("id").alias("mark")), "mark"))
    source = id_and_bytes(docs, id_col, text_col).where("id is not null").withColumn("mark", F.xxhash64("id"))

    def run(batches):
        for batch in batches:
            keep = in_filter(shared.value, batch.column(2).to_numpy().view(np.uint64))
            if not keep.any():
                continue
            for texts, _, _ in slices(batch.filter(pa.array(keep))):
                made = shingle_sets(texts, k)
                yield table([texts.ids, pa.array([set_keys(x)[0] for x in made], pa.int64()), pa.array([x.view(np.int64) for x in made], pa.list_(pa.int64()))], ["id", "node", "elements"])

    made = source.mapInArrow(tidy(run), "id long, node long, elements array<long>")
    sets = written(made.join(wanted.select("node", "id"), ["node", "id"]).dropDuplicates(["node"]).select("node", "elements"), "wanted-elements")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("elements").alias("ea")), "a").join(sets.select(F.col("node").alias("b"), F.col("elements").alias("eb")), "b")
    common = F.size(F.array_intersect("ea", "eb"))
    return both.where((100 + percent) * common >= percent * (F.size("ea") + F.size("eb"))).select("a", "b")


def connected(links: DataFrame) -> DataFrame:
    """``(node, label)`` of every node with a link; nodes of a component share a label.

    Every node takes its smallest neighbour, chains are followed, and the links are drawn
    again between labels until none is left. Nodes are hashes, so each round takes away a
    constant share of the links.
    """
    links = written(links.where("a <> b").select("a", "b").distinct(), "links")
    if links.isEmpty():
        return links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = None
    while True:
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label"))
        for _ in range(2):
            on = step.select(F.col("node").alias("label"), F.col("label").alias("next"))
            step = step.join(on, "label").select("node", F.col("next").alias("label"))
        step = written(step, "labels")
        if labels is None:
            labels = step
        else:
            further = labels.join(step.select(F.col("node").alias("label"), F.col("label").alias("next")), "label", "left")
            labels = written(further.select("node", F.coalesce("next", "label").alias("label")), "labels")
        to = step.select(F.col("node"), F.col("label"))
        left = links.join(to.toDF("a", "la"), "a").join(to.toDF("b", "lb"), "b").where("la <> lb")
        links = written(left.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "links")
        if links.isEmpty():
            return labels


def _links(docs: DataFrame, sets: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """Links between nodes that connect all that link: not every link is listed."""
    one_of = sets.where("n > 0 and id is not null").groupBy("node").agg(F.min("id").alias("id"))

    # small sets: a subset's sets are tied to one of them; of an odd key, if both sizes are there
    listed = sets.where("size(subsets) > 0").select("node", "n", F.explode("subsets").alias("key")).distinct()
    heads = listed.groupBy("key").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("k"), F.min("n").alias("least"), F.max("n").alias("most"))
    heads = heads.where("k > 1 and (key % 2 = 0 or least < most)").select("key", "head")
    small = written(listed.join(heads, "key").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct(), "small-links")

    lists = _pruned_lists(sets, percent)

    # first walks: of the heads of its lists, the one that a set meets most often
    found = small
    for walk in range(WALKS):
        labels = connected(found)
        apart = _apart(lists, labels, walk)
        # heads: sets with the fewest elements of their own, of which a group's others are variants; and one by chance
        own = F.expr("n - 1 - after - before")
        order = [F.struct(own if i + 1 < HEADS else F.lit(0), F.xxhash64("node", F.lit(walk * HEADS + i))) for i in range(HEADS)]
        heads = apart.groupBy("key").agg(*[F.min_by(F.struct("node", "n", "before", "after", "label"), o).alias(f"head{i}") for i, o in enumerate(order)])
        heads = heads.select("key", F.explode(F.array_distinct(F.array(*[f"head{i}" for i in range(HEADS)]))).alias("h"))
        met = apart.join(heads.select("key", *[F.col(f"h.{c}").alias(f"h_{c}") for c in ("node", "n", "before", "after", "label")]), "key")
        met = met.where(f"label <> h_label and {_may_link('', 'h_', percent)}").groupBy("node", "n", "h_node", "h_n").agg(F.count(F.lit(1)).alias("k"))
        best = met.where(f"k >= {_meetings('n', 'h_n', percent)}").groupBy("node").agg(F.max(F.struct("k", "h_node")).alias("best"))
        pairs = written(best.select(F.col("best.h_node").alias("a"), F.col("node").alias("b")), "head-pairs")
        found = written(found.union(_compared(docs, pairs, one_of, id_col, text_col, k, percent)), "head-links")

    # last walk: every pair of sets that is not connected yet
    apart = _apart(lists, connected(found), WALKS)
    left, right = (apart.select("key", *[F.col(c).alias(side + c) for c in ("node", "n", "before", "after", "label")]) for side in ("a_", "b_"))
    # two sets that meet k times have k - 1 meetings before the last, which alone tells them
    times = _meetings("a_n", "b_n", percent)
    met = left.join(right, "key").where(f"a_label <> b_label and a_node < b_node and least(a_before, b_before) + 1 >= {times} and {_may_link('a_', 'b_', percent)}")
    met = written(met.select("a_node", "a_n", "b_node", "b_n").distinct(), "late-meetings")
    keys = apart.groupBy("node").agg(F.collect_set("key").alias("keys"))
    both = met.join(keys.toDF("a_node", "a_keys"), "a_node").join(keys.toDF("b_node", "b_keys"), "b_node")
    pairs = both.where(f"size(array_intersect(a_keys, b_keys)) >= {times}")
    pairs = written(pairs.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")), "last-pairs")
    return found.union(_compared(docs, pairs, one_of, id_col, text_col, k, percent))


def _meetings(a: str, b: str, percent: int) -> str:
    """In SQL: how often two sets of these sizes meet in lists at least, if they link."""
    length = f"least({{0}}, {{0}} - ceil({percent} * {{0}} / 100) + 1 + floor({{0}} / 50))"
    need = f"ceil({percent} * ({a} + {b}) / {100 + percent})"
    return f"least({length.format(a)} - {a} + {need}, {length.format(b)} - {b} + {need})"


def _may_link(a: str, b: str, percent: int) -> str:
    """In SQL: whether two sets that meet at an element can share enough.

    Of the elements before it in order only those can be common that are in lists of
    several sets, of those after it any. So every meeting of two sets that link passes.
    """
    share = f"least({a}before, {b}before) + 1 + least({a}after, {b}after)"
    return f"{100 + percent} * ({share}) >= {percent} * ({a}n + {b}n)"


def _pruned_lists(sets: DataFrame, percent: int) -> DataFrame:
    """``(key, node, n, before, after)``: entries of inverted lists at which sets may link.

    ``before``: elements of the set ahead of this one that are in lists of several sets (an
    element in no other set's list can't be shared with a set that has a later one in its
    lists); ``after``: all its elements behind this one. Entries whose set could not share
    ``percent`` of its elements at all are left out, and lists of one entry with them.
    """
    entries = sets.where("size(listed) > 0").select("node", "n", F.posexplode("listed").alias("at", "key"))
    for _ in range(PRUNINGS):
        shared = entries.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("key")
        several = entries.join(shared, "key").select("key", "node", "n", "at").distinct()
        order = W.partitionBy("node").orderBy("at")
        placed = several.withColumn("before", F.row_number().over(order) - 1).withColumn("after", F.col("n") - F.col("at") - 1)
        entries = written(placed.where(f"100 * (before + 1 + after) >= {percent} * n"), "lists")
    return entries.select("key", "node", "n", "before", "after")


def _apart(lists: DataFrame, labels: DataFrame, walk: int) -> DataFrame:
    """Entries of lists that hold sets of several components, with the components' labels."""
    known = written(lists.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), f"labelled-lists-{walk}")
    several = known.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    return written(known.join(several, "key"), f"lists-apart-{walk}")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``(id, n_shingles, component_id)`` of every row: the smallest id that links reach from its set.

    Rows with equal sets share a component, whatever their ids. A null or empty text has an
    empty set and its own id. A row without id has the component of rows with an equal set,
    if there are any, and links nothing. Sets are of shingles of ``k`` words, and link from
    a Jaccard similarity of ``percent`` / 100.
    """
    sizes, key, n = _profile(docs, id_col, text_col, k)
    boundary = choose_boundary(sizes) if percent == PERCENT else choose_boundary(sizes, percent=percent)
    sets = _sets(docs, boundary, key, n, id_col, text_col, k, percent)
    labels = connected(_links(docs, sets, id_col, text_col, k, percent))
    nodes = sets.where("n > 0").groupBy("node").agg(F.min("id").alias("own"))
    labelled = nodes.join(labels, "node", "left").select("node", "own", F.coalesce("label", "node").alias("label"))
    smallest = labelled.groupBy("label").agg(F.min("own").alias("component_id"))
    of_node = labelled.join(smallest, "label").select("node", "component_id")
    rows = sets.select("id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("node")).alias("node"))
    return rows.join(of_node, "node", "left").select("id", "n_shingles", F.coalesce("component_id", "id").alias("component_id"))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of each component's smallest id, with all their columns.

    Rows of equal id are one document, of which the first by a hash of its text stays; rows
    without id stay. Rows that carry their ``place`` (``operators.places``) are chosen by id and
    place alone and then read where they lie, so no text is shuffled, however many documents
    go. Of other frames, texts of documents that surely stay are told by a filter of fixed
    size, and the few others are joined.
    """
    found = written(components(docs, id_col, text_col, k, percent).where("id is not null").groupBy("id").agg(F.max(F.col("component_id") == F.col("id")).alias("stays"), F.count(F.lit(1)).alias("k")), "components")
    names = [f"c{i}" for i in range(len(docs.columns))]
    own = names[docs.columns.index(id_col)]
    text = names[docs.columns.index(text_col)]
    if PLACE in docs.columns:
        lying = docs.toDF(*names).withColumnRenamed(names[docs.columns.index(PLACE)], PLACE)
        keys = lying.select(PLACE, F.col(own).cast("long").alias("id"), F.xxhash64(F.col(text).cast("string")).alias("h"))
        first = keys.join(found.where("stays").select("id"), "id").groupBy("id").agg(F.min(F.struct("h", PLACE)).alias("first"))
        kept = first.select(f"first.{PLACE}.*").unionByName(keys.where("id is null").select(f"{PLACE}.*"))
        location = f"{shared_folder(docs.sparkSession)}/kept-{uuid.uuid4().hex}"
        write_masks(kept, location)
        return at_masks(lying, location).toDF(*docs.columns)
    doubtful = found.where("not stays or k > 1")
    bits = bit_filter(doubtful.select(F.xxhash64("id").alias("mark")), "mark")
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def maybe(mark):
        return pa.array(in_filter(shared.value, mark.to_numpy().view(np.uint64))).to_pandas()

    marked = docs.toDF(*names).withColumn("maybe", maybe(F.xxhash64(F.col(own).cast("long"))) & F.col(own).isNotNull())
    sure = marked.where("not maybe").drop("maybe")
    rest = marked.where("maybe").drop("maybe").join(found.where("stays").select(F.col("id").alias("kept")), F.col(own).cast("long") == F.col("kept"), "left_semi")
    rest = rest.withColumn("k", F.row_number().over(W.partitionBy(own).orderBy(F.xxhash64(F.col(text).cast("string")), text))).where("k = 1").drop("k")
    return sure.unionByName(rest).toDF(*docs.columns)
