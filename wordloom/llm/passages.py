"""Repeated passages by sparse suffix arrays.

Of all word positions only minimisers are kept: positions whose small gram has the least hash in some window of
``window`` neighbours. What they hold depends on the words alone, so equal passages of ``key_words + window - 1`` words
keep a position in common. The kept suffixes are sorted by their first ``key_words`` words, which leaves those that
have a neighbour with the same words; these are sorted again by the words that follow, and once more by the words
before, read backwards. In a sorted order all suffixes that agree in some more words stand together, so the least of
them, by document and position, is found by comparing neighbours: it, or the neighbour before where
all agree, is the suffix's lead. Ranges of the order are worked on side by side, and short summaries of
their edges are stitched. Suffixes of one document that lie at one distance from those of another make one match, which is
extended left and right, word by word.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import map_rows, slices, window_codes, written

#: Every passage of KEY_WORDS + WINDOW - 1 = 50 words is met, and none under KEY_WORDS is reported.
KEY_WORDS, WINDOW = 35, 16
#: Words of the gram whose hash picks the minimisers.
GRAM = 4
#: Words to which stretches of leads are rounded, so that matches share them.
ROUND = 64
#: Sorted suffixes that a task holds at one time.
BLOCK = 1 << 18
#: No suffix: greater than all.
NONE = np.iinfo(np.int64).max


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every ``width`` neighbours."""
    span = 1
    while 2 * span <= width:
        values, span = pick(values[:-span], values[span:]), 2 * span
    return values if span == width else pick(values[: len(values) - (width - span)], values[width - span :])


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def suffixes(hashes: np.ndarray, key_words: int = KEY_WORDS, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Minimiser positions, and a code of the ``key_words`` words from each."""
    n = len(hashes) - key_words + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    order = window_codes(hashes, min(GRAM, key_words))[:n] * np.uint64(0xD6E8FEB86659FD93)
    order ^= order >> np.uint64(32)
    width = min(window, n)
    least = sliding(order, width, np.minimum)
    pad = np.zeros(width - 1, np.uint64)
    kept = np.flatnonzero(sliding(np.concatenate([pad, least, pad]), width, np.maximum) == order)
    return kept, window_codes(hashes, key_words)[kept]


def contexts(hashes: np.ndarray, at: np.ndarray, key_words: int, depth: int) -> list[np.ndarray]:
    """16 bits of each of the ``depth`` words after the keys, then of those before them, read backwards: four words to a number, the first on top. Beyond the text's ends 0."""
    wide = -(-depth // 4) * 4
    bits = np.concatenate([np.zeros(wide, np.uint64), hashes >> np.uint64(48), np.zeros(wide + key_words, np.uint64)]).astype(">u2")
    out = []
    for first, step in ((at + wide + key_words, 1), (at + wide - 1, -1)):
        here = bits[first[:, None] + step * np.arange(wide)]
        here[:, depth:] = 0
        out += list(np.ascontiguousarray(here).view(">i8").astype(np.int64).T)
    return out


def suffix_table(rows: DataFrame, key_words: int, window: int) -> DataFrame:
    """``key``, ``id``, ``body``, ``pos``: the kept suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            found = [suffixes(word_hashes((t or "").encode().split()), key_words, window) for t in piece.column(2).to_pylist()]
            n = [len(at) for at, _ in found]
            columns = [np.concatenate([k for _, k in found]).view(np.int64), *(np.repeat(piece.column(c).to_numpy(), n) for c in (0, 1)), np.concatenate([at for at, _ in found]).astype(np.int32)]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["key", "id", "body", "pos"])

    return rows.mapInArrow(run, "key long, id long, body int, pos int")


def repeated(table: DataFrame) -> DataFrame:
    """``id``, ``body``, ``pos``: the suffixes with a neighbour of the same key in sorted order, and the first and last of each range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = None, True  # the last row so far, and whether it is like the one before it
        for batch in batches:
            if not batch.num_rows:
                continue
            own = [c.to_numpy() for c in batch.columns]
            if held is not None:
                own = [np.concatenate(x) for x in zip(held, own, strict=True)]
            like = np.r_[before, own[0][1:] == own[0][:-1]]
            held, before = [c[-1:] for c in own], like[-1]
            good = np.flatnonzero(like[:-1] | like[1:])
            yield pa.RecordBatch.from_arrays([pa.array(c[good]) for c in own[1:]], names=["id", "body", "pos"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[1:]], names=["id", "body", "pos"])

    order = ["key", "id", "body", "pos"]
    return table.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "id long, body int, pos int")


def context_table(rows: DataFrame, needs: DataFrame, key_words: int, depth: int) -> DataFrame:
    """``key``, ``id``, ``body``, ``pos`` and the contexts (``r0``, ... after, ``l0``, ... before) of the positions that each row of ``needs`` lists."""
    names = ["key", "id", "body", "pos", *(f"{side}{k}" for side in "rl" for k in range(-(-depth // 4)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            parts = []
            for i, body, text, at in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                hashes, at = word_hashes(text.encode().split()), np.array(sorted(at), np.int64)
                parts.append([window_codes(hashes, key_words)[at].view(np.int64), np.full(len(at), i, np.int64), np.full(len(at), body, np.int32), at.astype(np.int32), *contexts(hashes, at, key_words, depth)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names=names)

    both = rows.join(needs.hint("merge"), ["id", "body"]).select("id", "body", "text", "at")
    return both.mapInArrow(run, ", ".join(f"{n} {'int' if n in ('body', 'pos') else 'long'}" for n in names))


def _words(columns: list[np.ndarray], depth: int) -> np.ndarray:
    """A row of ``depth`` words for each suffix, from the numbers that hold four."""
    return np.stack(columns, axis=1).astype(">i8").view(">u2")[:, :depth].astype(np.uint16)


def _agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words from the start in which rows agree."""
    return np.logical_and.accumulate(a == b, axis=1).sum(axis=1)


class Range:
    """Neighbours in sorted order: for each suffix the lead that agrees with it in most words, and what the edges tell the next range.

    ``own`` has a row (document, body, position) for each suffix.
    """

    def __init__(self, key: np.ndarray, words: np.ndarray, own: np.ndarray):
        n, depth = words.shape
        self.key, self.words, self.own, self.depth = key, words, own, depth
        like = np.full(n, -1)  # words in which a suffix agrees with the one before it; -1 if not even in the key
        like[1:] = np.where(key[1:] == key[:-1], _agreeing(words[1:], words[:-1]), -1)
        order = np.lexsort(own.T[::-1])
        self.rank = np.empty(n, np.int64)
        self.rank[order] = np.arange(n)
        self.order = order
        self.lead, self.agree = np.full(n, -1), np.full(n, -1)
        same = np.flatnonzero(like == depth)
        self.lead[same], self.agree[same] = same - 1, depth
        for d in range(depth - 1, -1, -1):
            cut = like < d
            least = np.minimum.reduceat(self.rank, np.flatnonzero(cut))[np.cumsum(cut) - 1]
            hit = np.flatnonzero((self.lead < 0) & (least < self.rank))
            self.lead[hit], self.agree[hit] = order[least[hit]], d
        ends = np.flatnonzero(like < 0)
        self.first_end, self.last_start = int(ends[1]) if len(ends) > 1 else n, int(ends[-1])
        self.to_first, self.to_last = np.full(n, -1), np.full(n, -1)
        self.to_first[: self.first_end] = np.minimum.accumulate(np.r_[depth, like[1 : self.first_end]])
        self.to_last[self.last_start :] = np.minimum.accumulate(np.r_[like[self.last_start + 1 :], depth][::-1])[::-1]
        #: Suffixes for which another range may hold a better lead, or a smaller one that is as good.
        near = np.maximum(self.to_first, self.to_last)
        self.open = (near >= np.maximum(self.agree, 0)) & (self.agree < depth)

    def least(self, near: np.ndarray) -> np.ndarray:
        """For each number of words the least suffix that agrees with an edge in as many; for all words, the suffix at the edge."""
        out = np.full((self.depth + 1, 3), NONE)
        at = np.flatnonzero(near >= 0)
        at = at[np.argsort(self.rank[at])]
        for d in range(self.depth + 1):
            here = np.flatnonzero(near[at] >= d)
            if len(here):
                out[d] = self.own[at[here[-1 if d == self.depth else 0]]]
        return out

    def edges(self) -> Iterator[tuple[int, bytes]]:
        """Key and summary of the stretches of one key at the two ends; one if they are the same."""
        nothing = np.full((self.depth + 1, 3), NONE)
        if self.first_end == len(self.key):
            yield int(self.key[0]), _packed(self.words[0], self.words[-1], self.least(self.to_first), self.least(self.to_last))
        else:
            yield int(self.key[0]), _packed(self.words[0], self.words[self.first_end - 1], self.least(self.to_first), nothing)
            yield int(self.key[-1]), _packed(self.words[self.last_start], self.words[-1], nothing, self.least(self.to_last))


def _packed(first: np.ndarray, last: np.ndarray, to_first: np.ndarray, to_last: np.ndarray) -> bytes:
    return np.concatenate([first.astype(np.int64), last.astype(np.int64), to_first.ravel(), to_last.ravel()]).tobytes()


def stitched(summaries: list[bytes]) -> Iterator[bytes]:
    """For the ranges of one key, in order, the least suffixes before and after them that agree with their edge in so many words; in all words, the nearest before."""
    rows = [np.frombuffer(s, np.int64) for s in summaries]
    depth = (len(rows[0]) - 6) // 8
    first, last = [r[:depth] for r in rows], [r[depth : 2 * depth] for r in rows]
    to_first, to_last = [r[2 * depth : 5 * depth + 3].reshape(-1, 3) for r in rows], [r[5 * depth + 3 :].reshape(-1, 3) for r in rows]
    agree = lambda a, b: int(_agreeing(a[None], b[None])[0])

    def passed(order: range, near: list, far: list, to_far: list) -> dict:
        """``far`` is the edge of a range that the next one in the order meets with its edge ``near``."""
        out, known = {}, np.full((depth + 1, 3), NONE)
        for k, j in zip(order, [*order[1:], None], strict=True):
            out[k] = known
            if j is None:
                break
            through, met = agree(near[k], far[k]), agree(far[k], near[j])
            new = np.full((depth + 1, 3), NONE)
            for d in range(met + 1):
                new[d] = to_far[k][d] if d == depth else min(tuple(to_far[k][d]), tuple(known[d]) if d <= through else (NONE,) * 3)
            known = new
        return out

    n = len(rows)
    before, after = passed(range(n), first, last, to_last), passed(range(n - 1, -1, -1), last, first, to_first)
    for k in range(n):
        yield before[k].tobytes() + after[k].tobytes()


def leads(table: DataFrame, side: str, depth: int, block: int) -> DataFrame:
    """``id``, ``body``, ``pos``, ``lead``, ``lead_body``, ``at``: for each suffix the least (by document, body and position) of those before it that agree with it in the key and in as many words of the ``side`` as any such, or the one right before it where that agrees in all; whatever the bounds of the ranges."""
    numbers = [c for c in table.columns if c[0] == side and c[1:].isdigit()]
    order = ["key", *numbers, "id", "body", "pos"]
    names = ["id", "body", "pos", "lead", "lead_body", "at", "agree", "unit", "key", "to_first", "to_last", "summary"]
    schema = "id long, body int, pos int, lead long, lead_body int, at int, agree int, unit long, key long, to_first int, to_last int, summary binary"

    def compared(columns: list[np.ndarray], unit: int) -> Iterator[pa.RecordBatch]:
        key, own = columns[0], np.stack(columns[-3:], axis=1).astype(np.int64)
        here = Range(key, _words(columns[1:-3], depth), own)
        good = np.flatnonzero((here.lead >= 0) | here.open)
        lead, none, still = own[here.lead[good]], here.lead[good] < 0, here.open[good]
        kinds = (pa.int64(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [
                *(pa.array(own[good, k], t) for k, t in enumerate(kinds)), *(pa.array(lead[:, k], t, mask=none) for k, t in enumerate(kinds)), pa.array(here.agree[good], pa.int32()),
                pa.array(np.full(len(good), unit), pa.int64(), mask=~still), pa.array(key[good], mask=~still), pa.array(here.to_first[good], pa.int32(), mask=~still), pa.array(here.to_last[good], pa.int32(), mask=~still), pa.nulls(len(good), pa.binary()),
            ],
            names=names,
        )
        edges = list(here.edges())
        empty = [pa.nulls(len(edges), t) for t in (*kinds, *kinds, pa.int32())]
        yield pa.RecordBatch.from_arrays([*empty, pa.array([unit] * len(edges)), pa.array([k for k, _ in edges]), pa.nulls(len(edges), pa.int32()), pa.nulls(len(edges), pa.int32()), pa.array([s for _, s in edges])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, size, last = TaskContext.get().partitionId() << 32, [], 0, None

        def joined() -> list[np.ndarray]:
            """The rows held, without those that repeat the one before."""
            nonlocal last
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            own = np.stack([columns[0], *columns[-3:]], axis=1)
            new = np.r_[last is None or (own[0] != last).any(), (own[1:] != own[:-1]).any(axis=1)]
            last = own[-1]
            return [c[new] for c in columns]

        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns])
            size += batch.num_rows
            if size >= block:
                columns = joined()
                if len(columns[0]):
                    yield from compared(columns, unit)
                unit, held, size = unit + 1, [], 0
        if size:
            columns = joined()
            if len(columns[0]):
                yield from compared(columns, unit)

    found = written(table.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema), f"leads-{side}")

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("unit")
        return pd.DataFrame({"unit": rows["unit"], "key": rows["key"], "outside": list(stitched(rows["summary"].tolist()))})

    # Two summaries a range, so that even a key that fills a third of all ranges gathers few rows.
    outside = written(found.where("summary is not null").select("unit", "key", "summary").groupBy("key").applyInPandas(fold, "unit long, key long, outside binary"), "outside")

    def choose(ids: list, bodies: list, positions: list, lead_ids: list, lead_bodies: list, ats: list, agrees: list, firsts: list, lasts: list, others: list) -> Iterator[tuple]:
        for i, body, pos, lead, lead_body, at, agree, to_first, to_last, other in zip(ids, bodies, positions, lead_ids, lead_bodies, ats, agrees, firsts, lasts, others, strict=True):
            known = np.frombuffer(other, np.int64).reshape(2, -1, 3)
            best = (agree, None if lead is None else (lead, lead_body, at))
            for least, reach in zip(known.tolist(), (to_first, to_last), strict=True):
                for d in range(reach, max(best[0], 0) - 1, -1):
                    if (met := tuple(least[d])) < (i, body, pos):
                        best = min(best, (d, met), key=lambda b: (-b[0], b[1] or ()))
                        break
            if best[1]:
                yield i, body, pos, *best[1]

    columns = ["id", "body", "pos", "lead", "lead_body", "at"]
    sure = found.where("summary is null and unit is null").select(*columns)
    still = found.where("summary is null and unit is not null").join(outside, ["unit", "key"]).select(*columns, "agree", "to_first", "to_last", "outside")
    return sure.unionByName(map_rows(still, choose, "id long, body int, pos int, lead long, lead_body int, at int"))


def equal_runs(own: list, lead: list, least: int) -> Iterator[tuple[int, int]]:
    """Start and length of the stretches of at least so many equal words."""
    n = min(len(own), len(lead))
    same = np.zeros(n + 2, np.int8)
    same[1 : n + 1] = np.fromiter(map(operator.eq, own[:n], lead[:n]), bool, n)
    edges = np.flatnonzero(np.diff(same))
    for start, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if end - start >= least:
            yield start, end - start


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_words: int = KEY_WORDS, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """``id``, ``start``, ``n_words``, ``lead_id``, ``lead_start``: passages that stand in the text of a smaller id, or earlier in their own.

    Every passage of ``key_words + window - 1`` words that repeats is found whole, though maybe in two overlapping rows with
    different leads: one that agrees furthest to the right, and one to the left. (Words are compared by 16 bits each to choose these leads, and as bytes
    afterwards; where such hashes deceive, up to ``window - 1`` words at an end may be missing.) Some shorter passages are found too, none under ``key_words``. White
    space doesn't count. Null ids, null and empty texts, and texts under ``key_words`` words are not in the result. Repeated rows of an id count as one document,
    reported each. Rows of one id with different texts are documents of their own, ordered by a hash of their texts, so a passage's lead may have
    its own id. Empty tables give no rows. Other columns are not read.
    """
    body = F.shiftright(F.xxhash64(text_col), 32).cast("int").alias("body")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), body, F.col(text_col).alias("text")).where("id is not null")
    table = written(suffix_table(rows, key_words, window), "suffixes")
    needs = written(repeated(table).groupBy("id", "body").agg(F.collect_set("pos").alias("at")), "needs")
    near = written(context_table(rows, needs, key_words, max(1, window - 1)), "contexts")
    matches = leads(near, "r", max(1, window - 1), block).unionByName(leads(near, "l", max(1, window - 1), block))
    shift = (F.col("pos") - F.col("at")).alias("shift")
    chains = matches.groupBy("id", "body", "lead", "lead_body", shift).agg(F.min("pos").alias("low"), F.max("pos").alias("high"))
    low = F.greatest(F.col("low") - window, F.lit(0))
    high = F.col("high") + key_words + window
    lead_low = F.greatest(F.floor((low - F.col("shift")) / ROUND) * ROUND, F.lit(0)).cast("int")
    lead_high = (F.ceil((high - F.col("shift")) / ROUND) * ROUND).cast("int")
    chains = chains.select("id", "body", "lead", "lead_body", "shift", low.alias("low"), high.alias("high"), lead_low.alias("lead_low"), lead_high.alias("lead_high"))
    chains = written(chains, "matches")
    own = chains.groupBy("id", "body").agg(F.collect_list(F.struct("lead", "lead_body", "shift", "low", "high", "lead_low", "lead_high")).alias("own"))
    other = chains.groupBy(F.col("lead").alias("id"), F.col("lead_body").alias("body")).agg(F.collect_set(F.struct("lead_low", "lead_high")).alias("other"))
    needs = written(own.join(other, ["id", "body"], "full"), "needs")

    def cut(texts: list, ids: list, bodies: list, owns: list, others: list) -> Iterator[tuple]:
        for text, i, of, mine, asked in zip(texts, ids, bodies, owns, others, strict=True):
            words = (text or "").encode().split()
            for m in mine or ():
                yield i, m["lead"], m["lead_body"], m["shift"], m["low"], m["lead_low"], m["lead_high"], b" ".join(words[m["low"] : m["high"]]).decode()
            for m in asked or ():
                yield None, i, of, None, None, m["lead_low"], m["lead_high"], b" ".join(words[m["lead_low"] : m["lead_high"]]).decode()

    texts = rows.join(needs.hint("merge"), ["id", "body"]).select("text", "id", "body", "own", "other")
    pieces = written(map_rows(texts, cut, "id long, lead long, lead_body int, shift int, low int, lead_low int, lead_high int, words string"), "stretches")
    stretch = ["lead", "lead_body", "lead_low", "lead_high"]
    lead = pieces.where("id is null").select(*stretch, F.col("words").alias("lead_words")).dropDuplicates(stretch)
    lead = written(lead, "leads")  # apart from its aggregate, Spark may split the join where one text leads very many
    both = pieces.where("id is not null").join(lead, stretch)

    def extend(ids: list, lead_ids: list, shifts: list, lows: list, lead_lows: list, owns: list, others: list) -> Iterator[tuple]:
        for i, lead_id, shift, low, lead_low, mine, theirs in zip(ids, lead_ids, shifts, lows, lead_lows, owns, others, strict=True):
            begin = low - shift - lead_low  # where, in the other's words, this stretch's first one should stand
            a, b = mine.split(" "), theirs.split(" ")
            skip = max(0, -begin)
            for start, n in equal_runs(a[skip:], b[max(0, begin) :], key_words):
                at = low + skip + start
                yield i, at, n, lead_id, at - shift

    return map_rows(both.select("id", "lead", "shift", "low", "lead_low", "words", "lead_words"), extend, "id long, start int, n_words int, lead_id long, lead_start int")


def op8_repeated_passages(spark, sf_dir: str) -> DataFrame:
    found = repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), F.col("start").alias("start_word"), "n_words", F.col("lead_id").alias("lead_doc_id"), F.col("lead_start").alias("lead_start_word"))


QUERIES = {"op8_repeated_passages": op8_repeated_passages}
ORACLE_SQL: dict[str, str] = {}
