"""From raw documents to shards of a training mix.

Each stage takes (spark, docs, sf_dir), works on all documents its predecessor kept, and, but for the last,
returns the columns of documents. Up to decontamination each row is judged by itself, whatever its id; the mix takes
rows of one ``doc_id`` equally often.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.common import written
from wordloom.llm.decontaminate import clean_documents
from wordloom.llm.mixing import taken_words
from wordloom.llm.quality import kept_documents
from wordloom.llm.sharding import sharded
from wordloom.llm.simhash import similar_documents

SHARDS = 16


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule and whose host isn't rejected."""
    return kept_documents(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by a similarity of 0.8 (five words): one with the smallest id, null being the largest."""
    rows = written(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    found = written(similar_documents(rows, "__row"), "components")
    named = found.join(rows.select("__row", "doc_id"), found["id"] == rows["__row"])
    best = named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")).alias("best"))
    best = written(best.select(F.col("best.__row").alias("__row")), "best")
    # Rows stay in large part, so the join is never by broadcast.
    return rows.join(best.hint("merge"), "__row", "left_semi").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, by words and rounded; a source above its share gives up documents."""
    taken = taken_words(docs).where("size > 0").select(F.col("id").alias("__id"), F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias("__copies"))
    taken = written(taken.groupBy("__id").agg(F.max("__copies").alias("__copies")).where("__copies > 0"), "copies")
    both = docs.join(taken.hint("merge"), docs["doc_id"].eqNullSafe(taken["__id"]))
    return both.withColumn("__copy", F.explode(F.sequence(F.lit(1), "__copies"))).select(*(docs[c] for c in docs.columns))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard``, ``slot``."""
    return sharded(docs, SHARDS).withColumnRenamed("id", "doc_id")


STAGES = [("quality rules", quality), ("SimHash near-dedup", near_copies), ("benchmark decontamination", decontaminate), ("mixing to target weights", mixture), ("sharding", shards)]

#: SQL has no XXH64 and no edit distance within a span; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
