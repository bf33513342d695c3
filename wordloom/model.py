"""Corpora: a sparse matrix of rows (documents) and cols (words) in long form, with what hangs on the rows.

Everything that can be derived (document and term frequencies, sizes) is derived, so appending and deleting leave
exact statistics behind.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import counted, nfkc, words
from .tables import dealt, numbered, written

#: Keys that the corpus keeps itself.
RESERVED = ("name", "created", "stemmer", "servers", "properties", "number-of-articles")
#: Corpus names: printable ASCII without blanks and slashes, not starting with a dot.
NAME = r"(?!\.)[!-.0-\[\]-~]+"


def check_name(name: str) -> str:
    if not re.fullmatch(NAME, name):
        raise ValueError(f"not a corpus name: {name!r}")
    return name


@dataclass(frozen=True)
class Corpus:
    """``postings(row, col, tf)`` with one line a pair, ``rows(row, name, props)`` for every row even if it has no postings.

    ``segments(row, segid, text)`` and ``info(key, value)`` are optional. Ids are any orderable values; equal scores are ordered by them.
    """

    postings: DataFrame
    rows: DataFrame
    segments: DataFrame | None = None
    info: DataFrame | None = None
    #: Dimensions of rows and cols, if they are stored or not those of the postings at hand.
    dims: tuple[DataFrame, DataFrame] | None = None
    #: The rows are those that have postings, and follow from them.
    implied: bool = False

    @property
    def spark(self) -> SparkSession:
        return self.postings.sparkSession

    @staticmethod
    def from_counts(counts: DataFrame, rows: DataFrame | None = None, about: int | None = None) -> Corpus:
        """Sums up ``(row, col, tf)``; pairs may repeat. Rows without elements come from ``rows(row)``.

        ``about``, a number of counts if it is known, says to how many tasks they are dealt, a row to one. Without it a task sums up what its part of the input holds.
        """
        known = counts.where("row is not null and col is not null")
        postings = (known if about is None else dealt(known, about, "row")).groupBy("row", "col").agg(F.sum("tf").cast("long").alias("tf")).where("tf > 0")
        return Corpus(postings, _named((postings if rows is None else rows).select("row").distinct()), implied=rows is None)

    @staticmethod
    def from_text(docs: DataFrame, id_col: str, text_col: str, props: tuple[str, ...] = (), first_by: str | None = None, normalise: bool = False) -> Corpus:
        """Tokens of the text as cols; the text is segment 0.

        Where ids repeat, the row with the least value of ``first_by`` (then of the text) wins; without it their words are added up. ``normalise``
        brings texts to Unicode's compatibility composition first, as record lines are. Words are counted within their text; only those of ids that repeat are shuffled.
        """
        if first_by is not None:
            docs = _first_rows(docs, id_col, [first_by, text_col])
        if normalise:
            docs = docs.withColumn(text_col, nfkc(F.col(text_col)))
        once, again = (docs, None) if first_by is not None else _by_repetition(docs, id_col)
        postings = counted(once.select(F.col(id_col).alias("row"), F.col(text_col).alias("text")), words(F.col("text")), "row")
        if again is not None:
            each = counted(again.select(F.col(id_col).alias("row"), F.col(text_col).alias("text")), words(F.col("text")), "row")
            postings = postings.unionByName(each.groupBy("row", "col").agg(F.sum("tf").alias("tf")))
        pairs = [x for p in props for x in (F.lit(p), F.col(p).cast("string"))]
        rows = docs.select(F.col(id_col).alias("row"), F.col(id_col).cast("string").alias("name"), F.create_map(*pairs).cast("map<string,string>").alias("props"))
        return Corpus(postings, rows, docs.select(F.col(id_col).alias("row"), F.lit(0).alias("segid"), F.col(text_col).alias("text")))

    def stored(self) -> Corpus:
        """The same corpus with its postings and dimensions written to the shared folder: what made them isn't done again."""
        own = replace(self, postings=written(self.postings, "postings"), dims=None)
        rows, cols = self.dims or (own._row_sums if self.implied else own.row_dims, own.col_dims)
        rows, cols = written(rows, "rows"), written(cols, "cols")
        return replace(own, rows=_named(rows.select(F.col("id").alias("row"))) if self.implied else self.rows, dims=(rows, cols))

    @property
    def _row_sums(self) -> DataFrame:
        return self.postings.groupBy(F.col("row").alias("id")).agg(F.count("*").alias("df"), F.sum("tf").alias("tf_sum"))

    @cached_property
    def row_dims(self) -> DataFrame:
        """``id``, ``df`` (elements), ``tf_sum`` of every row, with 0 for rows without elements."""
        if self.dims:
            return self.dims[0]
        return self.rows.select(F.col("row").alias("id")).join(self._row_sums, "id", "left").na.fill(0, ["df", "tf_sum"])

    @cached_property
    def col_dims(self) -> DataFrame:
        if self.dims:
            return self.dims[1]
        return self.postings.groupBy(F.col("col").alias("id")).agg(F.count("*").alias("df"), F.sum("tf").alias("tf_sum"))

    @cached_property
    def stats(self) -> dict:
        """Sizes of both sides, totals and maxima: a handful of numbers, gathered once."""
        rows = self.row_dims.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum("df"), F.lit(0)).alias("total_df"), F.coalesce(F.sum("tf_sum"), F.lit(0)).alias("total_tf"), F.coalesce(F.max("df"), F.lit(0)).alias("max_df_row"), F.coalesce(F.max("tf_sum"), F.lit(0)).alias("max_tf_row")).first()
        cols = self.col_dims.agg(F.count("*").alias("n_cols"), F.coalesce(F.max("df"), F.lit(0)).alias("max_df_col"), F.coalesce(F.max("tf_sum"), F.lit(0)).alias("max_tf_col")).first()
        return rows.asDict() | cols.asDict()

    def side(self, result: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Postings as ``(t, id, tf)`` from the query side to the result side, and the dimensions of both."""
        if result == "rows":
            return self.postings.select(F.col("col").alias("t"), F.col("row").alias("id"), "tf"), self.col_dims, self.row_dims
        if result == "cols":
            return self.postings.select(F.col("row").alias("t"), F.col("col").alias("id"), "tf"), self.row_dims, self.col_dims
        raise ValueError("result is rows or cols")

    def masked(self, include: DataFrame | None = None, exclude: DataFrame | None = None) -> Corpus:
        """Confine the vectors to some (or without some) ``row`` ids. Scores go on using the frequencies of the whole corpus."""
        postings = self.postings
        if include is not None:
            postings = postings.join(include.select("row").distinct(), "row", "left_semi")
        if exclude is not None:
            postings = postings.join(exclude.select("row").distinct(), "row", "left_anti")
        return replace(self, postings=postings, dims=(self.row_dims, self.col_dims), implied=False)

    def deleted(self, names: DataFrame) -> Corpus:
        """Without the rows of these ``name``s; unknown names do nothing."""
        gone = self.rows.join(names.select("name").distinct(), "name", "left_semi").select("row")
        without = lambda df: df.join(gone, "row", "left_anti") if df is not None else None
        return replace(self, postings=without(self.postings), rows=without(self.rows), segments=without(self.segments), dims=None, implied=False)

    def appended(self, other: Corpus) -> Corpus:
        """With the rows of another corpus whose names are new; the first holder of a name wins.

        Where new rows have ids that this corpus uses, all new rows are numbered on from its highest id, in the order of their own. Ids that aren't whole numbers must not clash.
        """
        new = other.rows.join(self.rows.select("name"), "name", "left_anti")
        if new.join(self.rows.select("row"), "row", "left_semi").limit(1).count():
            if dict(self.rows.dtypes)["row"] not in ("int", "bigint") or dict(other.rows.dtypes)["row"] not in ("int", "bigint"):
                raise ValueError("row ids of the two corpora clash")
            highest = self.rows.agg(F.max("row").cast("long")).first()[0]
            new = numbered(new.withColumnRenamed("row", "__old"), ["__old"], "__number").withColumn("row", F.col("__number") + highest)
            new = written(new.drop("__number"), "new-rows")
        else:
            new = new.withColumn("__old", F.col("row"))
        ids = new.select("__old", "row")

        def keep(df: DataFrame | None) -> DataFrame | None:
            return df if df is None else df.withColumnRenamed("row", "__old").join(ids, "__old").select(*df.columns)

        segments = keep(other.segments) if self.segments is None else self.segments if other.segments is None else self.segments.unionByName(keep(other.segments))
        return replace(self, postings=self.postings.unionByName(keep(other.postings)), rows=self.rows.unionByName(new.select(*self.rows.columns)), segments=segments, dims=None, implied=False)

    def vector(self, of: str, ids: DataFrame) -> DataFrame:
        """Elements of the rows (or cols) with an ``id`` in the table."""
        return self.postings.join(ids.select(F.col("id").alias(of)).distinct(), of, "left_semi")

    def save(self, path: str) -> None:
        """Write as Parquet, postings ordered by col, so that the files' statistics lead a search to its words. A word in very many rows takes several files."""
        self.postings.repartitionByRange("col", "row").sortWithinPartitions("col", "row").write.mode("overwrite").parquet(f"{path}/postings")
        self.rows.write.mode("overwrite").parquet(f"{path}/rows")
        stored = replace(self, postings=self.spark.read.schema(self.postings.schema).parquet(f"{path}/postings"))
        for name, table in (("segments", self.segments), ("info", self.info), ("row_dims", stored.row_dims), ("col_dims", stored.col_dims)):
            if table is not None:
                table.write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Corpus:
        def optional(name: str) -> DataFrame | None:
            place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
            there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
            return spark.read.parquet(f"{path}/{name}") if there else None

        return Corpus(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/rows"), optional("segments"), optional("info"), (spark.read.parquet(f"{path}/row_dims"), spark.read.parquet(f"{path}/col_dims")))


def _named(rows: DataFrame) -> DataFrame:
    """Rows that have no name but their id, and no properties."""
    return rows.select("row", F.col("row").cast("string").alias("name"), F.create_map().cast("map<string,string>").alias("props"))


def _by_repetition(docs: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame | None]:
    """The rows whose id is theirs alone, and those with ids that repeat, or None."""
    many = written(docs.groupBy(F.col(id_col).alias("__id")).count().where("count > 1").select("__id"), "repeated-ids")
    if many.isEmpty():
        return docs, None
    same = F.col(id_col).eqNullSafe(F.col("__id"))
    return docs.join(many, same, "left_anti"), docs.join(many, same, "left_semi")


def _first_rows(docs: DataFrame, id_col: str, order: list[str]) -> DataFrame:
    """One row of each id. Only ids that repeat have their rows gathered, one at a time in an aggregate."""
    once, again = _by_repetition(docs, id_col)
    if again is None:
        return once
    least = again.groupBy(id_col).agg(F.min_by(F.struct(*docs.columns), F.struct(*order)).alias("__row"))
    return once.unionByName(least.select("__row.*"))


def _hadoop(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


@dataclass(frozen=True)
class Library:
    """The corpora in a folder, one sub-folder each."""

    spark: SparkSession
    root: str

    def open(self, name: str) -> Corpus:
        return Corpus.load(self.spark, f"{self.root}/{check_name(name)}")

    def save(self, name: str, corpus: Corpus) -> None:
        corpus.save(f"{self.root}/{check_name(name)}")

    def drop(self, name: str) -> bool:
        fs, place = _hadoop(self.spark, f"{self.root}/{check_name(name)}")
        return fs.delete(place, True)

    def rename(self, old: str, new: str) -> bool:
        fs, place = _hadoop(self.spark, f"{self.root}/{check_name(old)}")
        return fs.rename(place, _hadoop(self.spark, f"{self.root}/{check_name(new)}")[1])

    def names(self) -> list[str]:
        """The corpora in the folder: those that have postings."""
        fs, place = _hadoop(self.spark, self.root)
        found = [f.getPath().getName() for f in fs.listStatus(place) if f.isDirectory()] if fs.exists(place) else []
        return sorted(n for n in found if fs.exists(_hadoop(self.spark, f"{self.root}/{n}/postings")[1]))

    def catalogue(self) -> DataFrame:
        """``corpus``, ``key``, ``value`` of every corpus, in the order of their ``index.key``, those without one last. A corpus without information has one row of nulls."""
        every = self.spark.createDataFrame([(n,) for n in self.names()], "corpus string")
        named = self.spark.createDataFrame([], "of string, key string, value string")
        for name in self.names():
            if _hadoop(self.spark, self.root)[0].exists(_hadoop(self.spark, f"{self.root}/{name}/info")[1]):
                own = self.spark.read.schema("key string, value string").parquet(f"{self.root}/{name}/info")
                named = named.unionByName(own.select(F.lit(name).alias("of"), "key", "value"))
        order = named.where("key = 'index.key'").groupBy(F.col("of").alias("ranked")).agg(F.max("value").alias("rank"))
        found = every.join(named, F.col("corpus") == F.col("of"), "left").join(order, F.col("corpus") == F.col("ranked"), "left")
        return found.orderBy(F.col("rank").asc_nulls_last(), "corpus", "key").select("corpus", "key", "value")
