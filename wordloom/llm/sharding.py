"""Minimax contiguous sharding of atomic groups.

Equal texts form a group that is never split. Groups have a fixed order (by the MD5 of the text, so it
mixes sources and every run agrees), and shards are contiguous stretches of that order. The smallest
capacity with which a greedy walk needs no more than ``n`` shards is found by binary search; the walk at
that capacity makes the cuts.

The groups stay in Spark. The driver walks over a summary: totals of all groups whose MD5 starts with
the same digits. A stretch of several groups can be cut nowhere, or anywhere, which bounds the capacity
from both sides; only stretches that a cut can fall into are opened, two digits at a time, until they
are single groups and both bounds meet.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

#: Digits of the first summary (16 ** 4 stretches at most), digits opened each time, stretches opened at once.
DIGITS, MORE, OPEN = 4, 2, 512
#: Parts of a shard that number their rows by themselves.
PARTS = 256


class _Summary:
    """Stretches of groups in order: the digits that they share, their total, how many groups."""

    def __init__(self, rows: list[tuple[str, int, int]]):
        self.rows = sorted(rows)
        self.ends = list(accumulate((r[1] for r in self.rows), initial=0))

    def cuts(self, capacity: int, divisible: bool) -> list[int]:
        """Ends of the shards of a greedy walk, as sums from the start.

        Where stretches are divisible, those of several groups can be cut anywhere. Where they are not,
        a stretch of several groups above the capacity stops the walk, and what has been cut is returned.
        """
        at, out, total = 0, [], self.ends[-1]
        while at < total:
            limit = at + capacity
            k = bisect_right(self.ends, limit) - 1  # stretches before k fit whole
            end = self.ends[k]
            if divisible and k < len(self.rows) and self.rows[k][2] > 1:
                end = limit
            if end <= at:
                break
            out.append(end)
            at = end
        return out

    def shards(self, capacity: int, divisible: bool) -> float:
        cuts = self.cuts(capacity, divisible)
        done = (cuts[-1] if cuts else 0) >= self.ends[-1]
        return len(cuts) if done else float("inf")

    def least(self, low: int, high: int, n: int, divisible: bool) -> int:
        """Smallest capacity from low to high whose walk needs n shards at most; high is known to do."""
        while low < high:
            middle = (low + high) // 2
            if self.shards(middle, divisible) <= n:
                high = middle
            else:
                low = middle + 1
        return low

    def open_at(self, low: int, high: int, n: int) -> list[str]:
        """Stretches of several groups that a cut may fall into at a capacity from low to high; largest first."""
        early, late = self.cuts(low, False), self.cuts(high, True)
        found = {}
        for k in range(n):
            last = early[-1] if early else 0
            first, end = early[k] if k < len(early) else last, late[k] if k < len(late) else self.ends[-1]
            for i in range(max(0, bisect_right(self.ends, first) - 1), len(self.rows)):
                if self.ends[i] > end:
                    break
                if self.rows[i][2] > 1:
                    found[self.rows[i][0]] = self.rows[i][1]
        return sorted(found, key=lambda k: -found[k])[:OPEN]


def minimax_cuts(groups: DataFrame, n: int) -> tuple[int, list[str]]:
    """The least capacity for ``n`` shards of the rows ``key`` (32 hex digits, unique), ``size`` (positive) and the keys' prefixes at which shards 1, 2, ... begin."""

    def summary(rows: DataFrame, digits: int) -> list[tuple[str, int, int]]:
        found = rows.groupBy(F.substring("key", 1, digits).alias("k")).agg(F.sum("size").alias("t"), F.count("*").alias("c"))
        return [(r.k, r.t, r.c) for r in found.collect()]  # at most 16 ** DIGITS, then OPEN * 16 ** MORE

    whole = groups.agg(F.sum("size").alias("t"), F.max("size").alias("m")).first()
    if not whole.t:
        return 0, []
    found = _Summary(summary(groups, DIGITS))
    low, high = max(whole.m, -(-whole.t // n)), whole.m - (-whole.t // n)
    while True:
        low = found.least(low, high, n, True)
        if found.shards(high, False) <= n:
            high = found.least(low, high, n, False)
        opened = found.open_at(low, high, n) if low < high else []
        if not opened:
            # No cut of any capacity in question falls into a stretch of several groups: both walks agree.
            ends = found.cuts(high, False)
            return high, [found.rows[bisect_right(found.ends, e) - 1][0] for e in ends[:-1]]
        more = []
        for digits in sorted({len(k) for k in opened}):
            wanted = [k for k in opened if len(k) == digits]
            more += summary(groups.where(F.substring("key", 1, digits).isin(wanted)), digits + MORE)
        gone = set(opened)
        found = _Summary([r for r in found.rows if r[0] not in gone] + more)


def sharded(docs: DataFrame, n: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``size``, ``text_crc32``, ``shard``, ``slot`` for every row.

    Size is the UTF-8 bytes of the text plus 1. Null and empty texts are alike: no bytes, one group,
    checksum 0. Rows of one text share a shard, repeated rows each having a slot. Slots number a shard's rows from 0 without gaps. A group larger
    than an even share makes its shard as large as the group. An empty table gives no rows. Other columns
    are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), (F.octet_length(text) + F.lit(1).cast("long")).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("key")
    )
    rows = written(rows, "sizes")
    groups = written(rows.groupBy("key").agg(F.sum("size").alias("size")), "groups")
    _, starts = minimax_cuts(groups, n)
    shard = F.lit(0)
    for start in starts:
        shard = shard + (F.col("key") >= F.lit(start)).cast("int")
    part = F.pmod(F.xxhash64("id", "key"), F.lit(PARTS)).cast("int")
    rows = rows.select("id", "size", "text_crc32", "key", shard.alias("shard"), part.alias("part"))
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))  # n * PARTS rows at most
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("shard", "part", F.coalesce(before, F.lit(0)).alias("before"))
    here = F.row_number().over(Window.partitionBy("shard", "part").orderBy("id", "key")) - 1
    numbered = rows.withColumn("here", here).join(F.broadcast(counts), ["shard", "part"])
    return numbered.select("id", "size", "text_crc32", "shard", (F.col("before") + F.col("here")).alias("slot"))


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    found = sharded(spark.read.parquet(f"{sf_dir}/documents.parquet"), 16)
    return found.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op3_sharding": op3_sharding}
ORACLE_SQL: dict[str, str] = {}
