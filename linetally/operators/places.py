"""Row-position masks: the listed rows of a corpus, found where they lie.

A corpus read from Parquet can carry each row's ``place`` (file and row number). Which rows
are listed is then decided on keys and places alone; the places become bitmaps of
32,768 rows, written once to the session's shared folder, and every task looks up the bitmaps
of the file it is reading. Only places pass through Python, content stays in the JVM, and nothing
of a row is shuffled, however many keys are listed: a task holds the bitmaps of one file.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linetally.operators.rows import semi_join_filtered
from linetally.sources.store import new_location

PLACE = "place"
#: Rows that a bitmap of Spark's bitmap functions covers.
BLOCK_ROWS = 1 << 15
#: Folders that masks are dealt out to, so that a look-up reads few of them.
SLOTS = 1024


def with_place(df: DataFrame) -> DataFrame:
    """Add ``place``, a struct of ``file`` and ``row``, to a frame that reads Parquet files."""
    return df.withColumn(PLACE, F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")))


def placed(df: DataFrame) -> DataFrame | None:
    """``with_place``, or None for a frame that does not read Parquet files row by row."""
    try:
        out = with_place(df)
        out.schema  # noqa: B018
    except AnalysisException:
        return None
    return out


def _slot(file: Column) -> Column:
    return F.pmod(F.xxhash64(file), F.lit(SLOTS)).cast("int")


def write_masks(places: DataFrame, location: str) -> None:
    """Write bitmaps of ``places(file, row)``, ordered by file, in a folder for each slot."""
    number = F.col("row") + 1  # Spark's bitmaps number from 1
    masks = places.groupBy("file", F.bitmap_bucket_number(number).alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits")
    )
    dealt = masks.withColumn("slot", _slot(F.col("file"))).repartition("slot").sortWithinPartitions("slot", "file")
    dealt.write.partitionBy("slot").parquet(location)


class _Masks:
    """Bitmaps of one file at a time, read where a task needs them."""

    def __init__(self, location: str):
        uri = location if "://" in location or location.startswith("file:") else os.path.abspath(location)
        self.store, self.base = fs.FileSystem.from_uri(uri)
        self.file: str | None = None
        self.blocks: dict[int, np.ndarray] = {}

    def _open(self, file: str, slot: int) -> None:
        folder = f"{self.base.rstrip('/')}/slot={slot}"
        self.file, self.blocks = file, {}
        if self.store.get_file_info(folder).type == fs.FileType.NotFound:
            return
        found = pq.read_table(folder, columns=["block", "bits"], filters=[("file", "=", file)], filesystem=self.store, partitioning=None)
        for block, bits in zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True):
            self.blocks[block] = np.frombuffer(bits, np.uint8)

    def listed(self, file: str, slot: int, rows: np.ndarray) -> np.ndarray:
        if file != self.file:
            self._open(file, slot)
        out = np.zeros(len(rows), dtype=bool)
        block, bit = rows // BLOCK_ROWS + 1, rows % BLOCK_ROWS
        for b in np.unique(block).tolist():
            if b in self.blocks:
                at = np.flatnonzero(block == b)
                out[at] = self.blocks[b][bit[at] >> 3] >> (bit[at] & 7) & 1
        return out


def _look_up(location: str):
    @F.arrow_udf("boolean")
    def listed(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        masks = _Masks(location)
        for file, slot, row in batches:
            if file.null_count or row.null_count:
                raise ValueError("a row without a place can't be looked up")
            coded = file.dictionary_encode()
            code, rows, slots = coded.indices.to_numpy(), row.to_numpy(), slot.to_numpy()
            out = np.zeros(len(rows), dtype=bool)
            for i, name in enumerate(coded.dictionary.to_pylist()):
                at = np.flatnonzero(code == i)
                out[at] = masks.listed(name, int(slots[at[0]]), rows[at])
            yield pa.array(out)

    return listed


def at_masks(df: DataFrame, location: str) -> DataFrame:
    """The rows of ``df`` whose place is in the masks at ``location``, found where they lie."""
    file = F.col(f"{PLACE}.file")
    return df.filter(_look_up(location)(file, _slot(file), F.col(f"{PLACE}.row")))


def only_listed(big: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """``big LEFT SEMI keys`` that moves no row of ``big`` if it has places.

    The keys are compared at once (a narrow job that writes the masks); the result reads each
    file with its own mask. Without places the rows are joined, behind a filter of the keys.
    """
    if PLACE not in big.columns:
        return semi_join_filtered(big, keys, on)
    location = new_location(big.sparkSession, "masks")
    found = big.select(PLACE, *on).join(keys.select(*on).distinct(), list(on), "left_semi")
    write_masks(found.select(f"{PLACE}.file", f"{PLACE}.row"), location)
    return at_masks(big, location)
