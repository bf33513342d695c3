"""Substring search over the segments of documents.

A search is an OR of joins, a join an AND of patterns and excluded patterns. One scan of the segments
computes a flag for each pattern and one aggregate brings them to the document, since patterns match per document.
"""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import fold, matches, parse_options, parse_segments
from ..model import Corpus
from ..tables import numbered, written
from .associate import Filters


@dataclass(frozen=True)
class Pattern:
    """A text to find, with options and segments of its own; those replace what the search says."""

    text: str
    options: str | None = None
    segments: str | None = None


@dataclass(frozen=True)
class Join:
    positive: tuple[Pattern, ...] = ()
    negative: tuple[Pattern, ...] = ()
    options: str | None = None
    segments: str | None = None


@dataclass(frozen=True)
class Search:
    joins: tuple[Join, ...]
    options: str | None = None
    segments: str | None = None
    #: Folding of the corpus's index: a pattern must match under these options too.
    index_options: str | None = None
    #: Patterns are brought to Unicode's compatibility composition, as segments are.
    normalise: bool = True

    def _text(self, pattern: Pattern) -> str:
        return unicodedata.normalize("NFKC", pattern.text) if self.normalise else pattern.text

    def _flag(self, join: Join, pattern: Pattern) -> Column:
        options = next((o for o in (pattern.options, join.options, self.options) if o is not None), None)
        segments = parse_segments(next((s for s in (pattern.segments, join.segments, self.segments) if s is not None), None))
        found = matches(F.col("text"), self._text(pattern), options)
        if self.index_options:
            found = found & matches(F.col("text"), self._text(pattern), parse_options(self.index_options) - {"match-head", "match-tail"})
        return F.coalesce(found & F.col("segid").isin(list(segments)), F.lit(False))

    def flags(self, corpus: Corpus) -> DataFrame:
        """``id``, ``found`` (some join with a positive pattern holds) and ``outside`` (excluded by every join without one)."""
        flags, found, outside = [], F.lit(False), None
        for k, join in enumerate(self.joins):
            own = {}
            for kind, patterns in (("p", join.positive), ("n", join.negative)):
                for i, pattern in enumerate(patterns):
                    own[f"{kind}{k}_{i}"] = F.max(self._flag(join, pattern)).alias(f"{kind}{k}_{i}")
            flags += own.values()
            yes, no = F.lit(True), F.lit(False)
            for name in own:
                yes, no = (yes & F.col(name), no) if name[0] == "p" else (yes, no | F.col(name))
            if join.positive:
                found = found | (yes & ~no)
            elif join.negative:
                outside = no if outside is None else outside & no
        rows = corpus.segments.groupBy(F.col("row").alias("id")).agg(*flags)
        return rows.select("id", found.alias("found"), (F.lit(False) if outside is None else outside).alias("outside"))

    @property
    def has_outside(self) -> bool:
        return any(j.negative and not j.positive for j in self.joins)

    def run(self, corpus: Corpus, limit: int | None = None, downsample: bool = False) -> DataFrame:
        """Found documents by id: ``query`` 0, ``id``, ``score`` 1, ``total``. Joins without a positive pattern add none. ``limit`` takes the first, or an even sample."""
        hits = self.flags(corpus).where("found").select(F.lit(0).alias("query"), "id", F.lit(1.0).alias("score"))
        # One row a query, so never a join of all hits on their one value of ``query``.
        out = hits.join(F.broadcast(hits.groupBy("query").agg(F.count("*").alias("total"))), "query")
        if limit is None:
            return out
        if downsample:
            return downsampled(out, limit)
        return out.orderBy("id").limit(limit)

    def filters(self, corpus: Corpus) -> Filters:
        """As a filter: keep the found, or, with joins of exclusions alone, all that these leave in."""
        flags = self.flags(corpus)
        include = flags.where("found").select("id")
        return Filters(include=include, exclude=flags.where("outside").select("id") if self.has_outside else None)

    def places(self, corpus: Corpus, pattern: Pattern) -> DataFrame:
        """First match of one pattern in each segment: ``id``, ``segid``, ``disp`` (bytes of the folded text before it)."""
        options = parse_options(pattern.options if pattern.options is not None else self.options)
        folded = fold(F.col("text"), options)
        what = fold(F.lit(self._text(pattern)), options)
        at = F.length(folded) - F.length(what) + 1 if "match-tail" in options else F.position(what, folded)
        rows = corpus.segments.where(self._flag(Join(), pattern))
        return rows.select(F.col("row").alias("id"), "segid", F.octet_length(F.substring(folded, F.lit(1), at - 1)).alias("disp"))

    def first_places(self, corpus: Corpus, pattern: Pattern) -> DataFrame:
        """The first match of each document, by segment and place."""
        best = self.places(corpus, pattern).groupBy("id").agg(F.min(F.struct("segid", "disp")).alias("at"))
        return best.select("id", "at.segid", "at.disp")

    def all_places(self, corpus: Corpus, pattern: Pattern) -> DataFrame:
        """Every match of one pattern, overlapping ones too: ``id``, ``segid``, ``disp`` as in :meth:`places`; hits are ordered by these three."""
        options = parse_options(pattern.options if pattern.options is not None else self.options)
        if options & {"match-head", "match-tail"} or not pattern.text:
            return self.places(corpus, pattern)
        spark = corpus.spark
        what = spark.range(1).select(fold(F.lit(self._text(pattern)), options)).first()[0]  # of the pattern alone
        rows = corpus.segments.where(self._flag(Join(), pattern)).select(F.col("row").alias("id"), "segid", fold(F.col("text"), options).alias("text"), F.monotonically_increasing_id().alias("__of"))
        # Cut before every match: each piece but the first is one, and its place is the length of those before.
        before = "(?=" + re.sub(r"([^\w\s])", r"\\\1", what) + ")"
        cut = rows.select("id", "segid", "__of", F.startswith("text", F.lit(what)).alias("head"), F.posexplode(F.split("text", before)).alias("k", "piece"))
        earlier = Window.partitionBy("id", "segid", "__of").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
        found = cut.withColumn("disp", F.coalesce(F.sum(F.octet_length("piece")).over(earlier), F.lit(0)).cast("int"))
        return found.where("k > 0 or head").select("id", "segid", "disp")


def downsampled(rows: DataFrame, n: int, order: str = "id") -> DataFrame:
    """An even sample of n rows in the order of a column: of m rows, rank x stays if a line of slope n / m steps there. No task orders all rows."""
    ranked = written(numbered(rows, [order], "__rank"), "ranked")
    m = ranked.count()

    def step(rank: Column) -> Column:
        return F.greatest(F.lit(0), F.ceil((2 * n * (rank + 1) - m) / (2 * m)))

    x = F.col("__rank") - 1
    return (ranked if m <= n else ranked.where(step(x) > step(x - 1))).drop("__rank")


def sample_ranks(m: int, n: int) -> list[int]:
    """The ranks that :func:`downsampled` keeps."""
    step = lambda x: max(0, math.ceil((2 * n * (x + 1) - m) / (2 * m)))
    return list(range(m)) if m <= n else [x for x in range(m) if step(x) > step(x - 1)]


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").distinct().join(b, "id", "left_semi")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").distinct().join(b, "id", "left_anti")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").union(b.select("id")).distinct()
