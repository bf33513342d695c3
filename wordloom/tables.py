"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Of rows dealt out by :func:`dealt`, about so many go to a task.
ROWS_A_TASK = 500_000


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``. Where that is unset, a temporary folder serves in local mode; on a cluster it is an error."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="wordloom-"))
        base = sc.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder and read them back.

    Tasks lost with an executor then start again from the files. The folder belongs to the cluster,
    which clears it like any checkpoint directory.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """The rows dealt out by some keys to as many tasks as about ``rows`` rows need. Their number is stated, so Spark doesn't merge them: a task's memory
    doesn't grow with the table."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK)), *keys)


def running_total(df: DataFrame, value: Column, order: list[str], name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The rows with the total of ``value`` so far, their own included, within the groups ``by`` and in the order of some columns.

    The rows are cut into ranges of the order, which are summed side by side; only one sum a range and group is added up in one
    task, so neither a group nor the table has to fit one. Names beginning with two underscores are its own.
    """
    ranged = df.withColumn("__value", value).repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id())
    ranged = written(ranged, "ranges")  # fixed, as two plans read it
    sums = ranged.groupBy(*by, "__part").agg(F.sum("__value").alias("__sum"))
    before = F.sum("__sum").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    sums = written(sums.select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("__part").alias("__at"), F.coalesce(before, F.lit(0)).alias("__before")), "sums")
    same = F.col("__part") == F.col("__at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    here = F.sum("__value").over(Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ranged.join(sums, same).withColumn(name, F.col("__before") + here).select(*df.columns, name)


def latest(df: DataFrame, value: str, order: list[str], name: str, by: tuple[str, ...], large: DataFrame | None = None) -> DataFrame:
    """The rows with the latest ``value`` that isn't null, their own included, within the groups ``by`` and in the order of some columns.

    A group is read by one task, but those listed in ``large`` are cut into ranges as in :func:`running_total`.
    """
    so_far = lambda keys: F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    if large is None:
        return df.withColumn(name, so_far(by))
    small = df.join(large, list(by), "left_anti").withColumn(name, so_far(by))
    ranged = df.join(large, list(by), "left_semi").select(*df.columns).repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id())
    ranged = written(ranged, "ranges")  # fixed, as two plans read it
    ends = ranged.where(F.col(value).isNotNull()).groupBy(*by, "__part").agg(F.max_by(value, F.struct(*order)).alias("__end"))
    ends = ranged.select(*by, "__part").distinct().join(ends, [*by, "__part"], "left")
    before = F.last("__end", ignorenulls=True).over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    ends = written(ends.select(*by, "__part", before.alias("__before")), "ends")
    here = ranged.withColumn("__here", so_far((*by, "__part"))).join(ends, [*by, "__part"])
    return small.unionByName(here.withColumn(name, F.coalesce("__here", "__before")).select(*df.columns, name))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """The rows numbered from 1 in the order of some columns."""
    return running_total(df, F.lit(1).cast("long"), order, name)
