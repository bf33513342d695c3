"""Similarities between listed items: pairs and cross-reference matrices.

The lists are results of earlier stages and bounded by their sizes; their vectors meet in an equi-join on the shared elements.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Corpus
from ..tables import written


def row_vectors(corpus: Corpus, ids: DataFrame) -> DataFrame:
    """``id``, ``t``, ``tf``, ``n`` (elements), ``total`` of the listed rows."""
    return _vectors(corpus.postings.select(F.col("row").alias("id"), F.col("col").alias("t"), "tf"), ids)


def col_vectors(corpus: Corpus, ids: DataFrame) -> DataFrame:
    """The listed cols by their rows."""
    return _vectors(corpus.postings.select(F.col("col").alias("id"), F.col("row").alias("t"), "tf"), ids)


def _vectors(elements: DataFrame, ids: DataFrame) -> DataFrame:
    """Both are written: of a short list Spark then knows that it is short, and the postings are read once."""
    own = written(elements.join(written(ids.select("id").distinct(), "listed"), "id", "left_semi"), "vectors")
    return own.join(own.groupBy("id").agg(F.count("*").alias("n"), F.sum("tf").alias("total")), "id")


def unit_vectors(words_found: DataFrame) -> DataFrame:
    """Words as vectors of themselves, with the frequency their stage found."""
    return words_found.select("id", F.col("id").alias("t"), F.col("tf_d").alias("tf"), F.lit(1).cast("long").alias("n"), F.col("tf_d").alias("total"))


def _plus(x):
    return 1 + F.ln(x)


def cross_reference(corpus: Corpus, first: DataFrame, second: DataFrame, elements: str = "cols") -> DataFrame:
    """``i``, ``j``, ``sim`` for the vectors of two lists that share elements (of the side ``elements``).

    Not symmetric: the norm goes by the second one's length. Pairs that share nothing have similarity 0 and no row.
    """
    s = corpus.stats
    size, dims, mean = (s["n_rows"], corpus.col_dims, s["total_tf"] / max(1, s["n_rows"])) if elements == "cols" else (s["n_cols"], corpus.row_dims, s["total_tf"] / max(1, s["n_cols"]))
    known = dims.select(F.col("id").alias("t"), F.col("df").alias("df_t"))
    a = first.select(F.col("id").alias("i"), "t", F.col("tf").alias("tf1"), F.col("n").alias("n1"), F.col("total").alias("total1"))
    b = second.select(F.col("id").alias("j"), "t", F.col("tf").alias("tf2"), F.col("n").alias("n2"), F.col("total").alias("total2"))
    both = a.join(known, "t").join(b, "t")
    part = _plus(F.col("tf1")) * _plus(F.col("tf2")) * F.log1p(F.lit(float(size)) / F.col("df_t"))
    sums = both.groupBy("i", "j").agg(F.sum(part).alias("s"), *[F.first(c).alias(c) for c in ("n1", "total1", "n2", "total2")])
    norm = (0.8 * mean + 0.2 * F.col("n2")) * _plus(F.col("total1") / F.col("n1")) * _plus(F.col("total2") / F.col("n2"))
    return sums.select("i", "j", (F.col("s") / norm).alias("sim"))


def transposed(matrix: DataFrame) -> DataFrame:
    return matrix.select(F.col("j").alias("i"), F.col("i").alias("j"), "sim")


def dot_product(first: DataFrame, second: DataFrame) -> DataFrame:
    """``i``, ``j``, ``dot``: the plain product of two lists of vectors."""
    a, b = first.select(F.col("id").alias("i"), "t", F.col("tf").alias("x")), second.select(F.col("id").alias("j"), "t", F.col("tf").alias("y"))
    return a.join(b, "t").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
