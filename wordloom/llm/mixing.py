"""Mix sources to target weights with a low-discrepancy schedule.

Slot k of the mix looks up the point ``frac((k + 1) * golden ratio)`` in the cumulative weights of the
sources, so that every stretch of the mix holds the sources in nearly their shares. Slots are ranked within their
source, and each source's documents, laid end to end in a shuffled order, are cut into blocks of equally
many words; slot r of a source takes block r, and the source starts over when its blocks run out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_rows, word_count, written

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: A source may be repeated this often.
MAX_EPOCHS = 3
#: Words of a block.
BLOCK = 1024
#: Slots numbered together, and parts of a source's order summed together.
RUN, PARTS = 1 << 14, 1024
#: 2 ** 64 over the golden ratio.
GOLDEN = 11400714819323198485
#: The weights come as a table on the driver; more sources are an error.
MAX_SOURCES = 100_000


def targets(sizes: list[int], weights: list[int], epochs: int = MAX_EPOCHS) -> list[float]:
    """Words for each source: shares by weight of all words, at most ``epochs`` times its own.

    What a capped source leaves goes to the others by weight, until none is above its cap.
    """
    left, open_, out = sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        over = {i for i in open_ if weights[i] * left > epochs * sizes[i] * total}
        for i in over or open_:
            out[i] = float(epochs * sizes[i]) if over else weights[i] * left / total
        if not over:
            break
        left -= sum(epochs * sizes[i] for i in over)
        open_ -= over
    return out


def shuffled(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``id``, ``source``, ``size``, ``start``: each row's place in the shuffled order of its source."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    key = F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")))
    rows = rows.withColumn("key", key).withColumn("part", F.conv(F.substring("key", 1, 5), 16, 10).cast("int") % PARTS)
    rows = written(rows, "sizes")
    parts = rows.groupBy("source", "part").agg(F.sum("size").alias("words"))
    parts = parts.withColumn("before", F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    parts = parts.select(F.col("source").alias("of"), F.col("part").alias("p"), "before")
    within = Window.partitionBy("source", "part").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("here", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(parts, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("p")))
    return placed.select("id", "source", "size", (F.col("before") + F.col("here")).alias("start"))


def schedule(spark, blocks: list[int]) -> DataFrame:
    """``slot``, ``s`` (number of the source), ``rank``: the slots of the mix, until source s has ``blocks[s]``.

    Cumulative weights are the blocks each source is to give, so every source has a stretch of the unit
    interval that the sequence meets. Slots of a source that has all its blocks are left out.
    """
    total = sum(blocks)
    if not total:
        return spark.createDataFrame([], "slot long, s int, rank long")
    ends = np.cumsum([0, *blocks]).tolist()
    highs = np.array([min((1 << 64) - 1, (e << 64) // total) for e in ends[1:]], np.uint64)
    # A stretch of length x is met at least once in 2.7 / x points, and in n points n * x times, give or take 16.
    needed = max(min((b + 16) * total // b, 27 * total // 10 + 4) for b in blocks if b) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column(0).to_numpy()
            point = (slot.astype(np.uint64) + np.uint64(1)) * np.uint64(GOLDEN)
            s = np.minimum(np.searchsorted(highs, point, "right"), len(highs) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(s.astype(np.int32))], names=["slot", "s"])

    slots = spark.range(needed).mapInArrow(run, "slot long, s int").withColumn("run", F.floor(F.col("slot") / RUN))
    runs = slots.groupBy("s", "run").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("s").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("s", "run", F.coalesce(before, F.lit(0)).alias("before"))
    slots = slots.withColumn("at", F.row_number().over(Window.partitionBy("s", "run").orderBy("slot")) - 1)
    return slots.join(runs, ["s", "run"]).select("slot", "s", (F.col("before") + F.col("at")).alias("rank"))


def mix(docs: DataFrame, weights: dict | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", epochs: int = MAX_EPOCHS, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix as three tables: pieces, rows and sources.

    Pieces: ``slot``, ``id``, ``source``, ``size``, ``from_word``, ``n_words`` (in slot order they are the mix). Rows: every row of docs as ``id``,
    ``source``, ``size``, ``start``. Sources: ``source``, ``s``, ``source_size``, ``target``. ``weights`` maps sources to
    whole weights; without it :data:`WEIGHTS` go round the sources by code point, null last. Null and
    wordless texts have size 0 and are in no piece. Rows that repeat an id are mixed each. An empty table
    gives empty tables. Sources of no words get no slots. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = written(shuffled(docs, id_col, text_col, source_col), "places")
    found = bounded_rows(rows.groupBy("source").agg(F.sum("size").alias("words")), MAX_SOURCES, "sources of a mix")
    found.sort(key=lambda r: (r.source is None, r.source or ""))
    own = [weights[r.source] for r in found] if weights is not None else [WEIGHTS[k % len(WEIGHTS)] for k in range(len(found))]
    table = []
    for n, (r, target) in enumerate(zip(found, targets([r.words for r in found], own, epochs), strict=True)):
        words = int(target)  # whole words to take; a source's epoch has so many blocks, the last being short
        each = -(-r.words // block)
        full, rest = divmod(words, r.words) if r.words else (0, 0)
        table.append({"s": n, "source": r.source, "source_size": r.words, "target": target, "quota": words, "epoch": each, "blocks": full * each + -(-rest // block)})
    sources = spark.createDataFrame([tuple(x.values()) for x in table], "s int, source string, source_size long, target double, quota long, epoch long, blocks long")
    slots = schedule(spark, [x["blocks"] for x in table])
    here = sources.select("s", F.col("source").alias("of"), "source_size", "quota", "epoch", "blocks")
    if len(table) <= 10_000:  # else Spark decides by the size
        here = F.broadcast(here)
    last = F.col("start") + F.col("size") - 1
    cut = rows.where("size > 0").join(here, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    cut = cut.withColumn("b", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor(last / block))))
    taken = slots.join(here.select("s", F.col("epoch").alias("e"), F.col("blocks").alias("most")), "s").where("rank < most")
    taken = taken.select("slot", "s", (F.col("rank") % F.col("e")).alias("b"), F.floor(F.col("rank") / F.col("e")).alias("round"))
    both = cut.join(taken, ["s", "b"])
    first = F.greatest(F.col("start"), F.col("b") * block)
    end = F.least(F.col("start") + F.col("size"), (F.col("b") + 1) * block, F.col("quota") - F.col("round") * F.col("source_size"))
    pieces = both.select("slot", "id", "source", "size", "start", (first - F.col("start")).alias("from_word"), (end - first).alias("n_words")).where("n_words > 0")
    return pieces, rows, sources


def taken_words(docs: DataFrame, **how) -> DataFrame:
    """``id``, ``source``, ``size``, ``source_size``, ``target``, ``taken`` for every row."""
    pieces, rows, sources = mix(docs, **how)
    sums = pieces.groupBy("source", "start", "size", "id").agg(F.sum("n_words").alias("taken"))
    sums = sums.select(F.col("source").alias("of"), F.col("start").alias("st"), F.col("taken"))
    here = sources.select(F.col("source").alias("of"), "source_size", "target")
    full = rows.join(here, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    words, none = full.where("size > 0"), full.where("size = 0")
    words = words.join(sums, F.col("source").eqNullSafe(F.col("of")) & (F.col("start") == F.col("st")), "left")
    columns = ["id", "source", "size", "source_size", "target"]
    return words.select(*columns, F.coalesce("taken", F.lit(0)).alias("taken")).unionByName(none.select(*columns, F.lit(0).cast("long").alias("taken")))


def op6_source_mix(spark, sf_dir: str) -> DataFrame:
    found = taken_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


QUERIES = {"op6_source_mix": op6_source_mix}
ORACLE_SQL = {
    "op6_source_mix": r"""
WITH rows_ AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY ('0x' || key[1:5])::BIGINT % 1024, key, doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM rows_),
named AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM rows_ GROUP BY source),
weighed AS (SELECT source, source_size, CASE k % 3 WHEN 1 THEN 5 WHEN 2 THEN 2 ELSE 1 END::BIGINT AS w FROM named),
ordered AS (
  SELECT *, 3 * source_size AS cap,
    sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER o, 0) AS rest,
    sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS share
  FROM weighed WINDOW o AS (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT rest::BIGINT AS rest, share::BIGINT AS share FROM ordered WHERE NOT w * rest > cap * share ORDER BY 3 * source_size / w, source NULLS LAST LIMIT 1),
goals AS (
  SELECT source, source_size, CASE WHEN w * level.rest > cap * level.share THEN cap::DOUBLE
    ELSE (w * level.rest)::DOUBLE / level.share::DOUBLE END AS target FROM weighed JOIN ordered USING (source, source_size, w), level),
split AS (SELECT *, floor(target)::BIGINT // greatest(source_size, 1) AS f, floor(target)::BIGINT % greatest(source_size, 1) AS rest FROM goals)
SELECT p.doc_id, p.size, s.source_size, s.target,
  (p.size * s.f + greatest(0, least(p.start + p.size, s.rest) - p.start))::BIGINT AS taken
FROM placed p JOIN split s ON p.source IS NOT DISTINCT FROM s.source"""
}
