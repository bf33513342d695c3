"""Quality rules with host verdicts.

Rules fail single documents. Failures are then added up by host (domain), each host's failure rate is
shrunk towards a beta prior fitted to all hosts by the method of moments, and hosts that fail far more often than the mean of all
take their documents with them. What counts is the lower end of the rate's posterior, so small hosts need much more
evidence than large ones; where hosts differ no more than chance lets them, none is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from .common import SEPARATORS, map_rows, slices, written

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
#: Percent of the words that may stand in repeated windows.
MAX_REPEATED = 20
#: A host is rejected if the odds of failing, at so many standard deviations below its shrunk rate, are so many times those of the mean host.
HOST_ODDS, DEVIATIONS = 10.0, 2.0


def repeated_words(words: list, width: int = WINDOW) -> int:
    """Words that stand in a window of ``width`` words found twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    seen: dict = {}
    number = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    code, top = number[:n].copy(), len(seen)
    span = top
    for k in range(1, width):
        if span > (1 << 62) // top:  # number the windows so far anew, so that codes stay exact
            code = np.unique(code, return_inverse=True)[1]
            span = int(code.max()) + 1
        code = code * top + number[k : k + n]
        span *= top
    order = np.sort(code)
    if not (order[1:] == order[:-1]).any():
        return 0
    twice = np.isin(code, order[1:][order[1:] == order[:-1]])
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def measures(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    text = text or ""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(SEPARATORS)]
    return len(words), len(text) - sum(map(text.count, SEPARATORS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def rule_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``id``, ``host``, the five measures and ``base_failed`` for every row."""

    def make(ids: list, hosts: list, texts: list) -> Iterator[tuple]:
        for i, host, text in zip(ids, hosts, texts, strict=True):
            yield i, host, *measures(text)

    found = map_rows(docs.select(F.col(id_col).cast("long"), F.col(host_col).cast("string"), text_col), make, "id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    return found.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))


def base_failed(n_words, n_repeat_words):
    """Whether a text with these measures fails a rule: numbers or columns."""
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEATED * n_words)


def host_verdicts(rules: DataFrame, odds: float = HOST_ODDS, deviations: float = DEVIATIONS) -> DataFrame:
    """``host``, ``n_docs``, ``n_failed``, ``rate`` (shrunk), ``rejected``: one row a host, null being one.

    The prior has the mean of the hosts' rates and the variance that is left after the variance expected
    from sampling; where none is left (or one host alone) hosts are alike: all have the mean rate, and none is rejected.
    """
    hosts = rules.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(F.avg(rate).alias("m"), F.coalesce(F.var_pop(rate), F.lit(0.0)).alias("v"), F.avg(1 / F.col("n_docs")).alias("inverse")).first()
    m = prior.m or 0.0
    between = prior.v - m * (1 - m) * (prior.inverse or 0.0)
    if between <= 0:
        return hosts.select("host", "n_docs", "n_failed", F.lit(m).alias("rate"), F.lit(False).alias("rejected"))
    weight = max(m * (1 - m) / between - 1, 0.0)
    found = hosts.withColumn("rate", (F.col("n_failed") + m * weight) / (F.col("n_docs") + weight))
    low = F.col("rate") - deviations * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n_docs") + weight + 1))
    return found.withColumn("rejected", low * (1 - m) > odds * m * (1 - low))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", odds: float = HOST_ODDS) -> DataFrame:
    """All columns of :func:`rule_table`, with ``host_rate`` and ``kept``.

    Null, empty and blank texts have no words and fail. Rows with a null host form one host. Repeated
    rows are judged each and count each. An empty table gives no rows. Other columns are not read.
    """
    rules = written(rule_table(docs, id_col, text_col, host_col), "rules")
    verdicts = host_verdicts(rules, odds).select(F.col("host").alias("judged_host"), F.col("rate").alias("host_rate"), "rejected")
    verdicts = written(verdicts, "verdicts")  # apart from its aggregate, Spark may split the join where a host is very large
    found = rules.join(verdicts, F.col("host").eqNullSafe(F.col("judged_host")), "left").drop("judged_host")
    return found.withColumn("kept", ~(F.col("base_failed") | F.col("rejected"))).drop("rejected")


def kept_documents(docs: DataFrame, text_col: str = "text", host_col: str = "source", odds: float = HOST_ODDS) -> DataFrame:
    """The rows of docs, with all their columns, that :func:`judged` keeps: each by its own text and host, whatever its id.

    Names beginning with two underscores are the operator's own.
    """
    at, names = docs.columns.index(text_col), [*docs.columns, "__failed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            failed = [base_failed(n, repeated) for n, *_, repeated in map(measures, piece.column(at).to_pylist())]
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(failed, pa.bool_())], names=names)

    rows = written(docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("__failed", BooleanType())])), "judged")
    verdicts = host_verdicts(rows.select(F.col(host_col).cast("string").alias("host"), F.col("__failed").alias("base_failed")), odds)
    rejected = written(verdicts.where("rejected").select(F.col("host").alias("__host")), "rejected")  # apart from its aggregate, Spark may split the join where a host is very large
    rows = rows.where("not __failed")
    return rows.join(rejected, rows[host_col].cast("string").eqNullSafe(rejected["__host"]), "left_anti").drop("__failed")


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    found = judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {"op5_quality_rules": op5_quality_rules}
ORACLE_SQL = {
    "op5_quality_rules": r"""
WITH numbered AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
listed AS (SELECT r, doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM numbered),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM listed),
windows AS (
  SELECT r, p, CASE WHEN lead(word, 4) OVER o IS NOT NULL
    THEN concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) END AS win
  FROM words WINDOW o AS (PARTITION BY r ORDER BY p)),
twice AS (SELECT r, p, win IS NOT NULL AND count(*) OVER (PARTITION BY r, win) > 1 AS two FROM windows),
covered AS (SELECT r, max(two::INT) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c FROM twice),
repeats AS (SELECT r, sum(c)::BIGINT AS n_repeat_words FROM covered GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM numbered),
dups AS (SELECT r, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
rules AS (
  SELECT l.doc_id, l.source, len(l.w)::BIGINT AS n_words,
    length(regexp_replace(l.text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(l.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(d.n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(p.n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM listed l LEFT JOIN dups d USING (r) LEFT JOIN repeats p USING (r)),
failed AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM rules),
hosts AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS f FROM failed GROUP BY source),
moments AS (SELECT avg(f / n) AS m, coalesce(var_pop(f / n), 0) - avg(f / n) * (1 - avg(f / n)) * avg(1 / n) AS between_ FROM hosts),
prior AS (SELECT m, CASE WHEN between_ > 0 THEN greatest(m * (1 - m) / between_ - 1, 0) END AS weight FROM moments),
shrunk AS (SELECT source, n, m, weight, (f + m * weight) / (n + weight) AS rate FROM hosts, prior),
low AS (SELECT source, m, rate - 2 * sqrt(rate * (1 - rate) / (n + weight + 1)) AS low FROM shrunk),
bad AS (SELECT source, coalesce(low * (1 - m) > 10 * m * (1 - low), false) AS rejected FROM low)
SELECT f.doc_id, f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, f.base_failed,
  NOT (f.base_failed OR b.rejected) AS kept
FROM failed f LEFT JOIN bad b ON f.source IS NOT DISTINCT FROM b.source"""
}
