"""Benchmark decontamination by the q-gram lemma.

Two strings within edit distance ``e`` whose shorter one has length L share at least ``L - q + 1 - q * e`` q-grams, and
all of them lie on at most ``2 e + 1`` neighbouring diagonals. Documents stream once past an index of the
benchmark's q-grams, which is broadcast. A sliding count of q-grams known to
the index leaves few places; there, shared q-grams are counted item by item in overlapping bands of
diagonals, bands that meet the bound become regions, and a banded alignment verifies each. Of a large benchmark only
the tables for the sliding count are held against all documents; the few that some block of items can still touch
are written, and each block's index, of bounded size, is held against its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .common import map_rows, slices, window_codes, written

Q = 10
#: Edits allowed, as a share of the item's length.
ERROR_RATE = 0.08
#: Characters of benchmark texts in one broadcast index of about 16 bytes each; more items make more blocks.
BLOCK_CHARS = 2 << 20
#: Characters of a document looked at together; pieces overlap, so a text of any length needs no more memory.
PIECE = 1 << 20


def normalized(text: str | None) -> str:
    """Lower case, white space as single blanks."""
    return " ".join((text or "").lower().split())


def gram_codes(text: str, q: int = Q) -> np.ndarray:
    """A 64-bit code for each q-gram; equal grams have equal codes."""
    return window_codes(np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1), q)


def edit_budget(length: int, q: int = Q, rate: float = ERROR_RATE) -> int:
    """Edits allowed for an item, lowered for short ones so that the lemma still asks for a shared q-gram."""
    return max(0, min(int(rate * length), (length - q) // q))


class Sieve:
    """What the sliding count needs of some items: a table of the top bits of their q-gram codes, the longest stretch an item can take, and the fewest q-grams of any."""

    def __init__(self, code: np.ndarray, reach: int, least: int, short: list[str], q: int):
        self.bits, self.reach, self.least, self.short, self.q = max(16, min(26, len(code).bit_length() + 5)), reach, least, short, q
        known = np.zeros(1 << self.bits, np.uint8)
        known[(code >> np.uint64(64 - self.bits)).astype(np.int64)] = 1
        self.known = np.packbits(known, bitorder="little")

    def places(self, codes: np.ndarray) -> np.ndarray:
        """Positions of known q-grams with enough of them within reach."""
        if not len(codes) or not self.reach:
            return np.zeros(0, np.int64)
        top = (codes >> np.uint64(64 - self.bits)).astype(np.int64)
        flag = self.known[top >> 3] >> (top & 7).astype(np.uint8) & 1
        seen = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
        width = min(self.reach, len(codes))
        if int((seen[width:] - seen[:-width]).max()) < self.least:
            return np.zeros(0, np.int64)
        at = np.flatnonzero(flag)
        near = seen[np.minimum(at + self.reach, len(codes))] - seen[np.maximum(at - self.reach, 0)]
        return at[near >= self.least]

    def touched(self, text: str) -> bool:
        """Whether the normalised text may hold one of the items."""
        step = max(PIECE, 4 * self.reach)
        return any(len(self.places(gram_codes(text[at : at + step + self.reach + self.q], self.q))) for at in range(0, max(1, len(text)), step)) or any(s in text for s in self.short)


class Index:
    """q-grams of some benchmark items: sorted codes with their items and offsets."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, rate: float = ERROR_RATE):
        self.q = q
        self.short = [(i, t) for i, t in items if 0 < len(t) < q]
        kept = [(i, t) for i, t in items if len(t) >= q]
        self.ids, self.texts = [i for i, _ in kept], [t for _, t in kept]
        self.budgets = [edit_budget(len(t), q, rate) for t in self.texts]
        self.needs = [len(t) - q + 1 - q * e for t, e in zip(self.texts, self.budgets, strict=True)]
        codes = [gram_codes(t, q) for t in self.texts]
        code = np.concatenate([np.zeros(0, np.uint64), *codes])
        item = np.repeat(np.arange(len(codes), dtype=np.int32), [len(c) for c in codes])
        offset = np.concatenate([np.zeros(0, np.int32), *(np.arange(len(c), dtype=np.int32) for c in codes)])
        order = np.argsort(code, kind="stable")
        self.code, self.item, self.offset = code[order], item[order], offset[order]
        self.reach = max((len(t) + e for t, e in zip(self.texts, self.budgets, strict=True)), default=0)
        self.sieve = Sieve(self.code, self.reach, min(self.needs, default=1), [t for _, t in self.short], q)

    def regions(self, text: str) -> Iterator[tuple[int, int, int]]:
        """Item, and first and last diagonal, of each band whose shared q-grams meet the bound."""
        codes = gram_codes(text, self.q)
        at = self.sieve.places(codes)
        if not len(at):
            return
        first, end = np.searchsorted(self.code, codes[at], "left"), np.searchsorted(self.code, codes[at], "right")
        count = end - first
        position = np.repeat(at, count)
        entry = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(len(position)) if len(position) else np.zeros(0, np.int64)
        item, diagonal = self.item[entry], position - self.offset[entry]
        order = np.lexsort((diagonal, item))
        item, diagonal = item[order], diagonal[order]
        for k, start, stop in zip(*_runs(item), strict=True):
            wide, d = 2 * self.budgets[k] + 1, diagonal[start:stop]
            if len(d) < self.needs[k]:
                continue
            # Band [x, x + wide) from every diagonal x that has a q-gram: bands overlap in all ways.
            inside = np.searchsorted(d, d + wide, "left") - np.arange(len(d))
            good = np.flatnonzero(inside >= self.needs[k])
            if not len(good):
                continue
            breaks = np.flatnonzero(np.diff(d[good]) > wide)
            for a, b in zip(np.r_[0, breaks + 1], np.r_[breaks, len(good) - 1], strict=True):
                yield int(k), int(d[good[a]]), int(d[good[b]]) + wide - 1


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(values):
        return values, values, values
    start = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    return values[start], start, np.r_[start[1:], len(values)]


def banded(item: str, text: str, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """Least edits to find the whole item in the text on diagonals low to high, with start and end; None above the budget.

    Of equally good places the one with the smallest start, then end. Cell (i, d) stands for i characters of the item and i + d of the text;
    only diagonals from ``low - budget`` to ``high + budget`` are filled in, a row at a time: a cell holds edits, and below
    them the start. A row above the budget ends the search.
    """
    low, high = max(low - budget, -len(item)), min(high + budget, len(text))
    wide = high - low + 1
    if wide <= 0:
        return None
    edit, none = np.int64(1 << 32), np.int64((budget + 1) << 32)
    x, n = np.arange(wide), len(text)
    letters = np.frombuffer(item.encode("utf-32-le", "surrogatepass"), np.uint32)
    near = text[max(low, 0) : max(0, min(n, len(item) + high))]
    codes = np.zeros(len(item) + wide, np.uint32)  # the text from ``low`` on; 0 outside
    shift = max(low, 0) - low
    own = np.frombuffer(near.encode("utf-32-le", "surrogatepass"), np.uint32)[: len(codes) - shift]
    codes[shift : shift + len(own)] = own
    row = np.where((low + x >= 0) & (low + x <= n), low + x, none)
    ramp = edit * x
    for i, letter in enumerate(letters):
        new = row + edit * (codes[i : i + wide] != letter)
        np.minimum(new[:-1], row[1:] + edit, out=new[:-1])
        first, end = -(i + 1 + low), n - (i + 1 + low) + 1  # cells within the text
        if first > 0:
            new[:first] = none
        if end < wide:
            new[max(0, end) :] = none
        new -= ramp
        row = np.minimum.accumulate(new, out=new) + ramp
        if end < wide:
            row[max(0, end) :] = none
        if int(row.min()) >= none:
            return None
    k = int(row.argmin())
    return int(row[k] >> 32), int(row[k] & 0xFFFFFFFF), len(item) + low + k


def matches(index: Index, text: str) -> Iterator[tuple[int, int, int, int]]:
    """Item id, start, end (in the normalised text) and edits of the best place of every item found."""
    found: dict[int, tuple[int, int, int]] = {}
    step = max(PIECE, 4 * index.reach)
    for at in range(0, max(1, len(text)), step):
        piece = text[at : at + step + index.reach + index.q]
        for k, low, high in index.regions(piece):
            item, budget = index.texts[k], index.budgets[k]
            exact = piece.find(item, max(0, low))
            if 0 <= exact <= high:
                hit = 0, at + exact, at + exact + len(item)
            else:
                hit = banded(item, piece, low, high, budget)
                hit = hit and (hit[0], at + hit[1], at + hit[2])
            if hit and (k not in found or hit < found[k]):
                found[k] = hit
    for k, (edits, start, end) in sorted(found.items()):
        yield index.ids[k], start, end, edits
    for i, item in index.short:
        start = text.find(item)
        if start >= 0:
            yield i, start, start + len(item), 0


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", q: int = Q, rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``id``, ``item_id``, ``start``, ``end``, ``edits``: each benchmark item found in each document, at its best place.

    An item is found if its whole text stands in the document's with at most ``rate`` of its length in edits;
    case and white space don't count. Places are characters of the normalised document. Null and blank texts and items
    match nothing; items under q characters must stand exactly. Repeated rows are each reported. Empty tables give no
    rows. Other columns are not read. Every block of the benchmark is held against all documents.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, item_id long, start long, end long, edits int"
    blocks = list(_blocks(benchmark.select(F.col(item_id_col).cast("long"), item_text_col), block_chars))
    found = spark.createDataFrame([], schema)
    for own, items in _suspects(rows, "text", blocks, q, rate):
        index = spark.sparkContext.broadcast(Index(items, q, rate))

        def make(ids: list, texts: list, index=index) -> Iterator[tuple]:
            for i, text in zip(ids, texts, strict=True):
                if text:
                    for hit in matches(index.value, normalized(text)):
                        yield i, *hit

        part = map_rows(own.select("id", "text"), make, schema)
        found = part if len(blocks) == 1 else found.unionByName(part)
    return found


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", q: int = Q, rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs, with all their columns, in which :func:`contaminated` finds no item. Nothing is shuffled.

    Names beginning with two underscores are the operator's own.
    """
    spark, schema = docs.sparkSession, docs.schema
    at, names = docs.columns.index(text_col), docs.columns
    blocks = list(_blocks(benchmark.select(F.col(item_id_col).cast("long"), item_text_col), block_chars))

    def without(rows: DataFrame, items: list) -> DataFrame:
        index = spark.sparkContext.broadcast(Index(items, q, rate))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for piece in slices(batches):
                clean = [next(matches(index.value, normalized(t)), None) is None for t in piece.column(at).to_pylist()]
                yield piece.filter(pa.array(clean, pa.bool_()))

        return rows.mapInArrow(run, rows.schema)

    if len(blocks) < 2:
        return without(docs, blocks[0]) if blocks else docs
    flagged = written(_flagged(docs, text_col, blocks, q, rate), "flagged")
    rest = flagged.where("size(__blocks) > 0")
    for k, items in enumerate(blocks):  # few rows, written again for each block, so that a worker holds one index at a time
        rest = written(rest.where(~F.array_contains("__blocks", k)).unionByName(without(rest.where(F.array_contains("__blocks", k)), items)), "suspects")
    return flagged.where("size(__blocks) = 0").unionByName(rest).select(*names).to(schema)


def _flagged(rows: DataFrame, text_col: str, blocks: list[list[tuple[int, str]]], q: int, rate: float) -> DataFrame:
    """The rows with ``__blocks``: which blocks' sieves let them through. In all the sieves take a few bytes for each character of the benchmark."""
    sieves = rows.sparkSession.sparkContext.broadcast([Index(items, q, rate).sieve for items in blocks])
    at = rows.columns.index(text_col)
    schema = StructType([*rows.schema.fields, StructField("__blocks", ArrayType(IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            texts = [normalized(t) for t in piece.column(at).to_pylist()]
            touched = [[k for k, s in enumerate(sieves.value) if text and s.touched(text)] for text in texts]
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(touched, pa.list_(pa.int32()))], names=[f.name for f in schema])

    return rows.mapInArrow(run, schema)


def _suspects(rows: DataFrame, text_col: str, blocks: list[list[tuple[int, str]]], q: int, rate: float) -> Iterator[tuple[DataFrame, list[tuple[int, str]]]]:
    """Each block with the rows that may hold one of its items: all of them where there is one block."""
    if len(blocks) == 1:
        yield rows, blocks[0]
    elif blocks:
        flagged = written(_flagged(rows, text_col, blocks, q, rate).where("size(__blocks) > 0"), "suspects")
        for k, items in enumerate(blocks):
            yield flagged.where(F.array_contains("__blocks", k)), items


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items, normalised, in lists of at most so many characters (or of one item)."""
    block, size = [], 0
    for i, text in benchmark.dropna().toLocalIterator():
        text = normalized(text)
        if block and size + len(text) > block_chars:
            yield block
            block, size = [], 0
        if text:
            block.append((i, text))
            size += len(text)
    if block:
        yield block


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    found = contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "start", "end", "edits")


QUERIES = {"op7_decontamination": op7_decontamination}
ORACLE_SQL: dict[str, str] = {}
