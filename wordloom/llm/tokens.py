"""Count tokens in flat token files by scanning for the end-of-document id.

Token files are flat arrays without an index. Blocks of bytes are searched for the separator independently of each other; a prefix
scan over the blocks' summaries (separators so far, place of the last one) then stitches documents that
lie across blocks and numbers them within the file.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh_path, slices, written

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: how this vocabulary's text is split before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 50256
DTYPE = "<u2"
BLOCK_BYTES = 4 << 20
#: Characters of a text that are encoded at one time.
PIECE = 1 << 17

_encodings: dict = {}


def encoding(vocabulary: str = VOCABULARY):
    """The tokenizer of a rank file, loaded once in a process."""
    if vocabulary not in _encodings:
        import tiktoken

        with open(vocabulary, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        _encodings[vocabulary] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[vocabulary]


def encoded(text: str | None, vocabulary: str = VOCABULARY) -> Iterator[list[int]]:
    """Token ids of a whole text, in lists. Long texts are cut before a blank after a letter, where tokens never join."""
    text, at, encode = text or "", 0, encoding(vocabulary).encode_ordinary
    while len(text) - at > PIECE:
        cut = text.rfind(" ", at + 1, at + PIECE)
        while cut > at and not text[cut - 1].isalpha():
            cut = text.rfind(" ", at + 1, cut)
        if cut <= at:
            cut = next((k for k in range(at + PIECE, len(text)) if text[k] == " " and text[k - 1].isalpha()), len(text))
        yield encode(text[at:cut])
        at = cut
    yield encode(text[at:])


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, end: int = END, dtype: str = DTYPE) -> DataFrame:
    """Write the token ids of every row, each followed by ``end``; returns ``file``, ``ordinal``, ``id``.

    Each task attempt writes a file of its own, and only files in the returned table count. Null and empty texts are a bare separator.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(path)
        fs.create_dir(base, recursive=True)
        name, ordinal, out = f"{uuid.uuid4().hex}.tokens", 0, None
        mark = np.array([end], dtype).tobytes()
        for piece in slices(batches):
            if out is None:
                out = fs.open_output_stream(f"{base}/{name}", compression=None)
            for text in piece.column(1):
                for ids in encoded(text.as_py(), vocabulary):
                    out.write(np.array(ids, dtype).tobytes())
                out.write(mark)
            n = piece.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(ordinal, ordinal + n)), piece.column(0)], names=["file", "ordinal", "id"])
            ordinal += n
        if out is not None:
            out.close()

    return written(docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "file string, ordinal long, id long"), "token-rows")


def scan_separators(files: DataFrame, path: str, end: int = END, dtype: str = DTYPE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``file``, ``ordinal``, ``start``, ``n_tokens``, ``closed`` of every document in the token files.

    ``files`` has the column ``file``, once a file. Tokens after the last separator are a document that isn't closed. An empty
    file has no documents, and separators in a row enclose empty ones.
    """
    size = np.dtype(dtype).itemsize
    block_bytes -= block_bytes % size

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(path)
        for batch in batches:
            found = fs.get_file_info([f"{base}/{n}" for n in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([i.size for i in found], pa.int64())], names=["file", "bytes"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for name, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{base}/{name}") as file:
                    tokens = np.frombuffer(file.read_at(block_bytes, block * block_bytes), dtype)
                first = block * block_bytes // size
                at = np.flatnonzero(tokens == end) + first
                # The last row is the block's own: where it ends.
                place = np.append(at, first + len(tokens))
                before = np.append(np.append(-1, at[:-1]) if len(at) else at, -1)
                number = np.append(np.arange(len(at)), -1)
                n = len(place)
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array([block] * n, pa.int64()), pa.array(number), pa.array(place), pa.array(before)], names=["file", "block", "k", "at", "before"])

    blocks = files.select("file").mapInArrow(sizes, "file string, bytes long").where("bytes > 0")
    blocks = blocks.select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / block_bytes))).alias("block"))
    found = written(blocks.repartition("file", "block").mapInArrow(search, "file string, block long, k long, at long, before long"), "separators")
    inside = F.col("k") >= 0
    summary = found.groupBy("file", "block").agg(F.count_if(inside).alias("n"), F.max(F.when(inside, F.col("at"))).alias("last"), F.max("at").alias("end"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scan = summary.select("file", "block", "end", "n", "last", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("passed"), F.coalesce(F.max("last").over(earlier), F.lit(-1)).alias("carry"))
    scan = written(scan, "blocks")
    start = F.when(F.col("k") > 0, F.col("before")).otherwise(F.col("carry")) + 1
    closed = found.where(inside).join(scan.select("file", "block", "passed", "carry"), ["file", "block"])
    closed = closed.select("file", (F.col("passed") + F.col("k")).alias("ordinal"), start.alias("start"), (F.col("at") - start).alias("n_tokens"), F.lit(True).alias("closed"))
    tail = scan.groupBy("file").agg(F.sum("n").alias("ordinal"), (F.coalesce(F.max("last"), F.lit(-1)) + 1).alias("start"), F.max("end").alias("end"))
    tail = tail.where("end > start").select("file", "ordinal", "start", (F.col("end") - F.col("start")).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(tail)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``id``, ``n_tokens`` of every row, counted in token files written for them.

    Null and empty texts have 0. Rows with repeated or null ids are counted each. An empty table gives no rows. Other columns are not read.
    """
    path = fresh_path(docs.sparkSession, "tokens")
    rows = write_tokens(docs, path, id_col, text_col, vocabulary)
    found = scan_separators(rows.select("file").distinct(), path, block_bytes=block_bytes)
    return rows.join(found, ["file", "ordinal"]).select("id", "n_tokens")


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")


QUERIES = {"op9_token_counts": op9_token_counts}
ORACLE_SQL: dict[str, str] = {}
