"""Token counts of documents in flat token files that have no index.

A flat file is token ids of fixed width, documents one after another, each closed by an
end-of-document id. It is read in blocks that begin and end anywhere. One vectorised
search finds the end ids of a block; of each block only three numbers go on (ends, first
and last end). A prefix scan over these tells each block how many documents ended before
it and where the last one ended, which closes the documents that cross a border.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linetally.llm.batches import id_and_bytes, slices, table, tidy
from linetally.llm.bpe import Encoder, Vocabulary, vocabulary_source
from linetally.llm.store import shared_folder, written
from linetally.sources.directory import list_files, location_uri

#: Tokens of a block.
BLOCK_TOKENS = 1 << 20
#: Tokens of a file after which a writer begins the next one.
FILE_TOKENS = 1 << 24
_BLOCKS = "file string, block long, first_token long, data binary"


def file_blocks(spark: SparkSession, path: str, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``(file, block, first_token, data)`` of the raw token files below a folder; files are named from there.

    Files have no index and any size and name: their sizes are listed, ranges of them are dealt out as
    rows, and each task reads its ranges by seeking. Bytes after the last whole token are left
    out; a file without a token gives no row. Folders that Arrow's file systems open.
    """
    size = width * block_tokens
    uri = location_uri(path)
    files = list_files(spark, path).where("reason IS NULL").select(F.col("path").alias("file"), F.floor(F.col("size_bytes") / width).alias("tokens"))
    blocks = files.where("tokens > 0").select("file", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("tokens") - 1) / block_tokens))).alias("block"))
    first = F.col("block") * block_tokens
    ranges = blocks.select("file", "block", first.alias("first_token"), F.least(F.lit(block_tokens).cast("long"), F.col("tokens") - first).alias("n")).repartition("file", "block")

    def run(batches):
        store, base = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for i, (file, block, n) in enumerate(zip(*[batch.column(k).to_pylist() for k in (0, 1, 3)], strict=True)):
                with store.open_input_file(f"{base.rstrip('/')}/{file}") as source:
                    source.seek(block * size)
                    data = source.read(n * width)
                row = batch.slice(i, 1)
                yield table([row.column(0), row.column(1), row.column(2), pa.array([data], pa.binary())], ["file", "block", "first_token", "data"])

    return ranges.mapInArrow(tidy(run), _BLOCKS)


def write_tokens(docs: DataFrame, vocabulary: str, eod: int, width: int = 2, file_tokens: int = FILE_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> tuple[str, DataFrame]:
    """A folder of flat files of the encoded documents, and ``(file, doc_no, id)``: which document is which.

    Each task writes its documents, in the order it reads them, to raw files of its own of about
    ``file_tokens`` tokens, in the shared folder. Names are new in every attempt of a task, so files
    of attempts that failed are not in the list and disturb nothing.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary_source(vocabulary))
    kind = np.dtype(f"<u{width}")
    folder = f"{shared_folder(docs.sparkSession)}/flat-{uuid.uuid4().hex}"
    uri = location_uri(folder)
    names = ["file", "doc_no", "id"]

    def run(batches):
        encoder = Encoder(Vocabulary(shared.value), spelt_special=False)  # else a text could hold an end id
        if len(encoder.vocabulary.token_size) - 1 > np.iinfo(kind).max + 1 or eod > np.iinfo(kind).max:
            raise ValueError("ids need more bytes")
        store, base = fs.FileSystem.from_uri(uri)
        store.create_dir(base, recursive=True)
        out, name, docs_in, at = None, "", 0, 0
        for batch in batches:
            for texts, _, _ in slices(batch):
                if out is None:
                    name, docs_in, at = f"{uuid.uuid4().hex}.bin", 0, 0
                    out = store.open_output_stream(f"{base}/{name}")
                tokens, bounds = encoder.encode(texts)
                closed = np.insert(tokens, bounds[1:], eod).astype(kind)
                out.write(closed.tobytes())
                yield table([pa.array([name] * len(texts)), pa.array(range(docs_in, docs_in + len(texts)), pa.int64()), texts.ids], names)
                docs_in += len(texts)
                at += len(closed)
                if at >= file_tokens:
                    out.close()
                    out = None
        if out is not None:
            out.close()

    listed = written(id_and_bytes(docs, id_col, text_col).mapInArrow(tidy(run), "file string, doc_no long, id long"), "flat-files")
    store, base = fs.FileSystem.from_uri(uri)
    store.create_dir(base, recursive=True)  # without any document there is no file
    return folder, listed


def token_counts(blocks: DataFrame, eod: int, width: int = 2) -> DataFrame:
    """``(file, doc_no, n_tokens)`` of every document that an end id closes, and of a rest after the last.

    ``n_tokens`` is without the end id; two end ids side by side close an empty document.
    Documents are numbered from 0 in each file. Blocks without data count as empty.
    """
    kind = np.dtype(f"<u{width}")
    names = ["file", "block", "first_token", "n", "ends"]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                value = batch.column(3)[i]
                tokens = np.frombuffer(value.as_buffer(), kind) if value.is_valid else np.empty(0, kind)
                start = batch.column(2)[i].as_py()
                ends = (np.flatnonzero(tokens == eod) + start).astype(np.int64)
                yield table([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), batch.column(2).slice(i, 1), pa.array([len(tokens)], pa.int64()), pa.array([ends], pa.list_(pa.int64()))], names)

    found = written(blocks.select("file", "block", "first_token", "data").mapInArrow(tidy(run), "file string, block long, first_token long, n long, ends array<long>"), "token-ends")
    # the scan: one small row for each block; files are scanned side by side
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    stop = F.col("first_token") + F.col("n")
    scan = found.select("file", "block", F.size("ends").cast("long").alias("k"), F.try_element_at("ends", F.lit(-1)).alias("last"), stop.alias("stop"))
    scan = scan.select(
        "file",
        F.col("block"),
        F.coalesce(F.sum("k").over(before), F.lit(0)).alias("docs_before"),
        F.coalesce(F.max("last").over(before), F.lit(-1)).alias("last_before"),
        (F.lead("block").over(W.partitionBy("file").orderBy("block")).isNull()).alias("is_last"),
        "stop",
    )
    joined = found.drop("n", "first_token").join(scan, ["file", "block"])
    rest = F.when(F.col("is_last") & (F.coalesce(F.try_element_at("ends", F.lit(-1)), F.col("last_before")) + 1 < F.col("stop")), F.array("stop")).otherwise(F.array().cast("array<bigint>"))
    places = F.concat(F.array("last_before"), "ends", rest)
    counts = F.transform(F.slice(places, F.lit(2), F.size(places) - 1), lambda x, i: F.struct((F.col("docs_before") + i).alias("doc_no"), (x - F.get(places, i) - 1).alias("n_tokens")))
    return joined.select("file", F.inline(counts))


def document_token_counts(docs: DataFrame, vocabulary: str, eod: int, width: int = 2, block_tokens: int = BLOCK_TOKENS, **options) -> DataFrame:
    """``(id, n_tokens)`` of every document, counted in flat files that are written first.

    Null and empty texts have no tokens. Rows of one id, or without, each give a row.
    """
    folder, ids = write_tokens(docs, vocabulary, eod, width, **options)
    blocks = file_blocks(docs.sparkSession, folder, width, block_tokens)
    return token_counts(blocks, eod, width).join(ids, ["file", "doc_no"]).select("id", "n_tokens")
