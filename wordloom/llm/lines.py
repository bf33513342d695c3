"""Line dedup by content-defined chunks.

A text's lines are hashed, and a rolling hash over the last few line hashes decides after which lines a
chunk ends, so that the same lines are cut alike wherever they stand. Lines without a word don't count, and go with
the chunk before them. Chunks of several lines that occur
more than once in the corpus are removed, but for their first occurrence, after their bytes were compared.

Only hashes are shuffled to find what repeats. The text of repeated chunks follows, grouped by its bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from xxhash import xxh64_intdigest

from .common import SEPARATORS, map_rows, window_codes, written

#: Lines of the rolling hash; one in MEAN windows ends a chunk of MIN_LINES or more.
SPAN, MEAN, MIN_LINES = 2, 3, 2
_FACTOR = 0x9E3779B97F4A7C15


def chunk_ends(lines: list[str], span: int = SPAN, mean: int = MEAN, min_lines: int = MIN_LINES) -> list[int]:
    """Ends (exclusive) of a text's chunks: all but the last have ``min_lines`` lines with a word. Before the first of these the rolling hash sees nothing."""
    worded = [k for k, x in enumerate(lines) if x.strip(SEPARATORS)]
    hashes = np.fromiter((xxh64_intdigest(lines[k]) for k in worded), np.uint64, len(worded))
    rolling = window_codes(np.concatenate([np.zeros(span - 1, np.uint64), hashes]), span)
    ends, last = [], 0
    for k in (np.flatnonzero((rolling * np.uint64(_FACTOR) >> np.uint64(32)) % np.uint64(mean) == 0) + 1).tolist():
        if k - last >= min_lines:
            ends.append(k)
            last = k
    ends = [worded[k] if k < len(worded) else len(lines) for k in ends]
    return ends if ends and ends[-1] == len(lines) else [*ends, len(lines)]


def chunks(text: str | None, min_lines: int = MIN_LINES) -> Iterator[tuple[int, int, str]]:
    """First line, number of lines and text of the chunks that have several lines with a word; the text is that from the first to the last of them."""
    if not text:
        return
    lines, first = text.split("\n"), 0
    for end in chunk_ends(lines, min_lines=min_lines):
        own = lines[first:end]
        worded = [k for k, x in enumerate(own) if x.strip(SEPARATORS)]
        if len(worded) >= min_lines:
            yield first, end - first, "\n".join(own[worded[0] : worded[-1] + 1])
        first = end


def without_lines(text: str | None, gone: list | None) -> tuple[str | None, int]:
    """The text without stretches ``(first line, number of lines)``, and how many lines went."""
    if not gone:
        return text, 0
    lines, drop = text.split("\n"), set()
    for first, n in gone:
        drop.update(range(first, first + n))
    return "\n".join(x for k, x in enumerate(lines) if k not in drop), len(drop)


def _code(chunk: str) -> int:
    return xxh64_intdigest(chunk) - (1 << 63)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", code: Callable[[str], int] = _code) -> DataFrame:
    """All columns of docs, the text without repeated chunks, and ``removed_lines``.

    The occurrence with the smallest id stays (null ids count as larger than all; where only rows with null ids hold a chunk, each keeps its first). Repeated rows of that id all keep it. Null and
    empty texts, texts of one line and lines without a word stay as they are. An empty table gives no
    rows. A column ``removed_lines`` of docs gives way to the new one; names beginning with two underscores are the operator's own.

    The texts are shuffled once, to meet the hashes they share with others; only texts that share
    some go on to have their chunks compared. ``code`` hashes a chunk to 64 bits; where two chunks share one by accident, their bytes still tell them apart.
    """
    docs = docs.drop("removed_lines")
    key = F.struct(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("body")).alias("__key")

    def codes(ids: list, bodies: list, texts: list) -> Iterator[tuple]:
        for i, body, text in zip(ids, bodies, texts, strict=True):
            for _, _, chunk in chunks(text):
                yield i, body, code(chunk)

    slim = docs.select(key, text_col).select("__key.*", text_col)
    slim = written(map_rows(slim, codes, "id long, body long, hash long"), "codes")
    repeated = slim.groupBy("hash").count().where("count > 1").select("hash")
    repeated = written(repeated, "repeated")  # apart from its aggregate, Spark may split the join where a hash is very common
    shared = slim.join(repeated, "hash").groupBy(F.struct("id", "body").alias("__of")).agg(F.collect_set("hash").alias("__shared"))
    shared = written(shared, "shared")  # as above, for an id that repeats very often
    keyed = docs.select("*", key)
    # Texts are many times larger than what they meet, at any scale that matters: always a merge join.
    both = keyed.join(shared.hint("merge"), F.col("__key").eqNullSafe(F.col("__of")), "left").drop("__of")
    both = written(both, "sharing")
    alone, sharing = both.where("__shared is null").drop("__shared", "__key"), both.where("__shared is not null")

    def cut(ids: list, bodies: list, hashes: list, texts: list) -> Iterator[tuple]:
        for i, body, wanted, text in zip(ids, bodies, hashes, texts, strict=True):
            wanted, seen = set(wanted), set()
            for first, n, chunk in chunks(text):
                if code(chunk) in wanted:
                    yield i, body, first, n, chunk not in seen, chunk
                    seen.add(chunk)

    found = map_rows(sharing.select("__key.*", "__shared", text_col), cut, "id long, body long, first_line int, n_lines int, first_here boolean, chunk string")
    found = written(found, "chunks")
    same = found.groupBy("chunk").agg(F.min("id").alias("lead"), F.count("*").alias("n")).where("n > 1").drop("n")
    same = written(same, "repeated-chunks")
    later = F.coalesce(F.col("id") > F.col("lead"), F.col("lead").isNotNull()) | ~F.col("first_here")
    gone = found.join(same.hint("merge"), "chunk").where(later)
    gone = gone.groupBy(F.struct("id", "body").alias("__of")).agg(F.collect_set(F.struct("first_line", "n_lines")).alias("__gone"))
    gone = written(gone, "gone")
    sharing = sharing.drop("__shared").join(gone.hint("merge"), F.col("__key").eqNullSafe(F.col("__of")), "left").drop("__of", "__key")
    return alone.withColumn("removed_lines", F.lit(0)).unionByName(_cleaned(sharing, docs.columns.index(text_col)))


def _cleaned(both: DataFrame, at: int) -> DataFrame:
    """Column ``at`` without the stretches of lines in the last column, which gives way to their number."""
    schema = StructType([*both.schema.fields[:-1], StructField("removed_lines", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *columns, gone = batch.columns
            removed, texts = np.zeros(batch.num_rows, np.int32), []
            for k in np.flatnonzero(gone.is_valid().to_numpy(zero_copy_only=False)).tolist():
                text, removed[k] = without_lines(columns[at][k].as_py(), [(g["first_line"], g["n_lines"]) for g in gone[k].as_py()])
                texts.append(text)
            if texts:
                columns[at] = pc.replace_with_mask(columns[at], gone.is_valid(), pa.array(texts, columns[at].type))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(removed)], names=[f.name for f in schema])

    return both.mapInArrow(run, schema)


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    found = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "removed_lines", "text")


QUERIES = {"op1_line_dedup": op1_line_dedup}
ORACLE_SQL: dict[str, str] = {}
