"""Similarities as Spark columns: a weight per query entity, a weight per element, a norm per candidate.

The columns they may use. Per query: ``nq`` (query entities), ``sum_tfq``, and the statistics ``n_result`` and ``n_query`` (sizes of the result and the
query side), ``mean_df`` (mean number of elements of a result entity), ``avg_tf`` (mean sum of frequencies), ``max_df_r max_tf_r max_df_q max_tf_q``. Per query entity:
``df_t``, ``tf_t``, ``tf_q``, ``weight``, ``idf`` = log1p(n_result / df_t). Per element: ``tf``. Per candidate: ``df``, ``tf_sum`` (all its elements), ``df_d``, ``tf_d``
(the elements that the query met), ``norm_q``, ``norm_d``.
"""

from __future__ import annotations

import inspect
import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def _ratio(a: str, b: str) -> Column:
    """a / b, 1 where b is 0: its logarithm then counts as none."""
    return F.when(F.col(b) != 0, F.col(a) / F.when(F.col(b) != 0, F.col(b))).otherwise(F.lit(1.0))


def _ln_plus(x: Column) -> Column:
    return 1 + F.ln(x)


def _length_norm() -> Column:
    return F.when(F.col("df") != 0, (F.col("mean_df") + 0.2 * (F.col("df") - F.col("mean_df"))) * _ln_plus(_ratio("tf_sum", "df"))).otherwise(F.lit(1.0))


def _smart_query() -> Column:
    mean = F.when(F.col("nq") != 0, F.col("sum_tfq") / F.when(F.col("nq") != 0, F.col("nq")))
    good = (F.col("df_t") != 0) & (F.col("tf_q") > 0) & (mean > 0)
    return F.when(good, _ln_plus(F.when(good, F.col("tf_q"))) / _ln_plus(F.when(good, mean)) * F.col("idf")).otherwise(F.lit(0.0))


def _bm25() -> Column:
    n, d = F.col("n_result"), F.col("df_t")
    idf = F.ln((n - d + 0.5) / (d + 0.5))
    return idf * F.col("tf") * 3 / (F.col("tf") + 2 * (0.25 + 0.75 * F.col("tf_sum") / F.col("avg_tf")))


@dataclass(frozen=True)
class Similarity:
    """``query`` times ``element`` is summed over the elements met; the sum is divided by ``norm`` unless either is 0.

    ``norm_of`` names the vectors whose lengths ``norm_q`` and ``norm_d`` are: ``tf`` or ``tf_idf``. ``needs_candidate`` is set where ``element`` uses the
    candidate's statistics. ``scale`` multiplies the sum instead.
    """

    query: Column
    element: Column
    norm: Column | None = None
    norm_of: str | None = None
    needs_candidate: bool = False
    scale: Column | None = None


def built_in(name: str) -> Similarity:
    """By name; names are case-sensitive, and those without a method are refused."""
    ln_tf, tf, one = _ln_plus(F.col("tf")), F.col("tf").cast("double"), F.lit(1.0)
    tf_q, idf = F.col("tf_q").cast("double"), F.col("idf")
    cosine = F.col("norm_q") * F.col("norm_d")
    if name == "WT_SMARTWA":
        return Similarity(F.col("weight"), ln_tf, _length_norm())
    if name == "WT_SMARTAW":
        good = F.col("df_t") != 0
        return Similarity(F.when(good, 1 / _ln_plus(_ratio("tf_t", "df_t"))).otherwise(F.lit(0.0)), ln_tf, F.when(F.col("df") != 0, F.col("nq") / F.log1p(F.col("n_result") / F.when(F.col("df") != 0, F.col("df")))).otherwise(one))
    if name == "WT_SMART":
        return Similarity(_smart_query(), ln_tf, _length_norm())
    if name == "WT_COSINE":
        return Similarity(tf_q, tf, cosine, "tf")
    if name == "WT_DOT_PRODUCT":
        return Similarity(tf_q, tf)
    if name == "WT_COSINE_TFIDF":
        return Similarity(tf_q * idf, tf * idf, cosine, "tf_idf")
    if name == "WT_DOT_PRODUCT_TFIDF":
        return Similarity(tf_q * idf, tf * idf)
    if name == "WT_Okapi_BM25":
        return Similarity(one, _bm25(), needs_candidate=True)
    raise ValueError(f"unsupported similarity: {name}")


def expression(inner: str, outer: str = "1") -> Similarity:
    """A similarity of one's own in Spark SQL: the sum of ``inner`` over the elements met, times ``outer``.

    ``inner`` may use every column above but those known only after the sum (``df_d``, ``tf_d``); ``outer`` those per query and per candidate. Besides Spark's own
    functions both may use those of :func:`with_functions`, once they are registered.
    """
    return Similarity(F.lit(1.0), F.expr(inner).cast("double"), needs_candidate=True, scale=F.expr(outer).cast("double"))


#: Expressions of well-known similarities; the first three equal built-in ones.
EXPRESSIONS = {
    "smartwa": ("weight * (1 + ln(tf))", "1 / ((mean_df + 0.2 * (df - mean_df)) * (1 + ln(tf_sum / df)))"),
    "smartaw": ("(1 + ln(tf)) / (1 + ln(tf_t / df_t))", "log1p(n_result / df) / nq"),
    "smart": ("(1 + ln(tf_q)) / (1 + ln(sum_tfq / nq)) * idf * (1 + ln(tf))", "1 / ((mean_df + 0.2 * (df - mean_df)) * (1 + ln(tf_sum / df)))"),
    "tf": ("tf_q * tf", "1"),
    "tfidf": ("tf_q * tf * idf", "1"),
    "hits": ("1", "1"),
}


def with_functions(spark: SparkSession) -> None:
    """Register the mathematical functions that Spark lacks: ``erf``, ``erfc``, ``lgamma``, ``tgamma``, ``fmod``, ``remainder``, ``copysign``, ``nextafter``, ``trunc0`` (towards
    zero), ``fdim``, ``ilogb``, ``logb`` and the Bessel functions ``j0``, ``j1``, ``jn``, ``y0``, ``y1``, ``yn``. They run batch by batch in Python; null gives null, and so does what is undefined.
    """

    def register(name: str, one) -> None:
        def safe(*values):
            try:
                return None if any(v is None or v != v for v in values) else float(one(*values))
            except (ValueError, OverflowError, ZeroDivisionError):
                return None

        if len(inspect.signature(one).parameters) == 1:

            @F.pandas_udf("double")
            def run(a: pd.Series) -> pd.Series:
                return pd.Series([safe(x) for x in a], dtype="float64")

        else:

            @F.pandas_udf("double")
            def run(a: pd.Series, b: pd.Series) -> pd.Series:
                return pd.Series([safe(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

        spark.udf.register(name, run)

    for name, one in MORE_FUNCTIONS.items():
        register(name, one)


def _bessel(n: int, x: float) -> float:
    """J_n(x) by the trapezoidal rule on its integral over a period, which converges faster than any power."""
    steps = 64 + 4 * (abs(n) + int(abs(x)))
    return sum(math.cos(n * t - x * math.sin(t)) for t in (math.pi * (k + 0.5) / steps for k in range(steps))) / steps


def _neumann(n: int, x: float) -> float:
    """Y_n(x) for x > 0, by upward recurrence from its integrals for 0 and 1."""
    if x <= 0:
        raise ValueError("positive numbers only")
    if n < 0:
        return (-1) ** n * _neumann(-n, x)

    def whole(m: int) -> float:
        steps = 400 + 8 * int(x)
        first = _simpson(lambda t: math.sin(x * math.sin(t) - m * t), 0.0, math.pi, steps) / math.pi
        top = math.asinh(800.0 / x)
        second = _simpson(lambda t: (math.exp(m * t) + (-1) ** m * math.exp(-m * t)) * math.exp(-x * math.sinh(t)), 0.0, top, 4000) / math.pi
        return first - second

    low, high = whole(0), whole(1)
    for k in range(1, n):
        low, high = high, 2 * k / x * high - low
    return low if n == 0 else high


def _simpson(f, a: float, b: float, steps: int) -> float:
    h = (b - a) / steps
    return h / 3 * (f(a) + f(b) + 4 * sum(f(a + k * h) for k in range(1, steps, 2)) + 2 * sum(f(a + k * h) for k in range(2, steps, 2)))


MORE_FUNCTIONS = {
    "erf": lambda x: math.erf(x),
    "erfc": lambda x: math.erfc(x),
    "lgamma": lambda x: math.lgamma(x),
    "tgamma": lambda x: math.gamma(x),
    "fmod": lambda x, y: math.fmod(x, y),
    "remainder": lambda x, y: math.remainder(x, y),
    "copysign": lambda x, y: math.copysign(x, y),
    "nextafter": lambda x, y: math.nextafter(x, y),
    "fdim": lambda x, y: max(x - y, 0.0),
    "trunc0": lambda x: math.trunc(x),
    "logb": lambda x: math.frexp(abs(x))[1] - 1 if x else math.nan,
    "ilogb": lambda x: math.frexp(abs(x))[1] - 1 if x else math.nan,
    "j0": lambda x: _bessel(0, x),
    "j1": lambda x: _bessel(1, x),
    "jn": lambda n, x: _bessel(int(n), x),
    "y0": lambda x: _neumann(0, x),
    "y1": lambda x: _neumann(1, x),
    "yn": lambda n, x: _neumann(int(n), x),
}
