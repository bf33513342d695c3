"""Append documents to a corpus as they arrive.

Every micro-batch writes its own partition, ``batch=N``, and writes it again in full if it is retried, so each document counts once. Documents
whose id an earlier batch holds are left out; within a batch the first by id and text stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..model import Corpus


def append_batch(path: str, id_col: str, text_col: str):
    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/docs")
        docs = batch.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(text_col).alias("text"))
        if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            earlier = spark.read.schema("id string, text string, batch long").parquet(f"{path}/docs").where(F.col("batch") < number)
            docs = docs.join(earlier.select(F.col("id").alias("old")), F.col("id").cast("string") == F.col("old"), "left_anti")
        docs.select(F.col("id").cast("string").alias("id"), "text").write.mode("overwrite").parquet(f"{path}/docs/batch={number}")

    return run


def ingest(stream: DataFrame, path: str, checkpoint: str, id_col: str = "doc_id", text_col: str = "text", available_now: bool = True) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(append_batch(path, id_col, text_col)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def grown(spark: SparkSession, path: str) -> Corpus:
    """The corpus as far as it has come."""
    return Corpus.from_text(spark.read.schema("id string, text string, batch long").parquet(f"{path}/docs"), "id", "text")
