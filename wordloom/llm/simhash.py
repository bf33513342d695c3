"""SimHash near-duplicates by bit-sliced comparison of 64-bit fingerprints.

Candidates come from the pigeonhole principle: 64 bits are cut into ``radius + k`` blocks, and two
fingerprints that differ in at most ``radius`` bits agree in ``k`` whole blocks at least, so every
choice of ``k`` blocks makes one bucket key. The number of fingerprints chooses ``k``: more of them ask for longer keys. Buckets too large for a task are cut into tiles, and pairs
of tiles become tasks of their own, so a bucket of any size is compared whole. Within a task bit
planes lie vertically (64 fingerprints a word); carry-save counters add up differing bits, and words
in which all pairs exceed the radius are given up early. A task hands on a spanning star for each
group it links, never its pairs. Components follow from alternating large and small stars.

A radius that stands for a similarity of 0.8 is too wide for the pigeonhole principle, so :func:`similar_documents`
takes fingerprints of 256 bits, whose distance tells the similarity more closely, and finds candidates by
many keys, each made of a few bits from all over the fingerprint. The number of texts chooses the bits of a key, and these the number of keys. The comparison is the same, with a radius that
lets nearly all similar texts through. Then the texts of each group of candidates meet, and only
those whose shingles are similar enough are linked.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import map_rows, slices, written

#: Shingles hashed at one time, so that a very long text needs no more memory.
CHUNK = 1 << 16
#: Fingerprints of a tile; a bucket with more is split.
TILE = 2048
#: Groups up to this size are compared together with their neighbours, by offset.
SMALL = 32
#: Rows of a group of more than CROWD that are compared with all the others first.
PIVOTS, CROWD = 4, 1024
#: Wide fingerprints: words of 64 bits, fingerprints of a tile.
WORDS, WIDE_TILE = 4, 4096
#: Fingerprints of a bucket that keys are made for, were the bits even: in tens of thousands of buckets, and in few large ones of wide fingerprints.
BUCKET, WIDE_BUCKET = 64, 512
#: Keys in which two similar texts agree on average.
MET = 9.6
#: Words of 64 pairs that are compared at one time.
GRID = 1 << 14
#: Standard deviations of the distance that the radius for a similarity allows above its mean.
SLACK = 4.5
#: Texts, and their bytes, of a tile of a group of candidates.
TEXT_TILE, TEXT_BYTES = 512, 1 << 23


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash over lower-cased (A-Z) word shingles; without words 0."""
    return int(wide_fingerprint(text, width, seed, 1)[0])


def wide_fingerprint(text: str | None, width: int, seed: int, n: int) -> np.ndarray:
    """``n`` words of 64 bits; the first is :func:`fingerprint`, further ones vote with scrambled hashes."""
    return _vote(_hashes(text, width, seed), n)


def _hashes(text: str | None, width: int, seed: int) -> Iterator[np.ndarray]:
    """Hashes of the text's shingles, in order, a part at a time; none without words."""
    words = (text or "").encode().lower().split()
    for at in range(0, max(1, len(words) - width + 1) if words else 0, CHUNK):
        part = words[at : at + CHUNK + width - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
        yield np.fromiter(map(xxh64_intdigest, shingles, repeat(seed)), np.uint64)


def shingle_codes(text: str | None, width: int, seed: int) -> np.ndarray:
    """Hashes of the text's different shingles, sorted."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *_hashes(text, width, seed)]))


def _vote(parts: Iterable[np.ndarray], n: int) -> np.ndarray:
    """``n`` words of 64 bits, each bit set if it is in most of the hashes; without hashes 0."""
    total, counts = 0, np.zeros(64 * n, np.int64)
    for hashes in parts:
        total += len(hashes)
        hashes = np.stack([hashes, *(_scrambled(hashes, k) for k in range(1, n))], axis=1)
        bits = np.unpackbits(hashes.view(np.uint8), axis=1, bitorder="little")
        for start in range(0, len(bits), 255):  # as many as a byte can count
            counts += bits[start : start + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > total, bitorder="little").view(np.uint64)


def _scrambled(hashes: np.ndarray, k: int) -> np.ndarray:
    mixed = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) & (1 << 64) - 1)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ (mixed >> np.uint64(32))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42) -> DataFrame:
    """``id``, ``fp`` (signed 64 bits) of every row; null and wordless texts have 0."""

    def make(ids: list, texts: list) -> Iterator[tuple]:
        for i, text in zip(ids, texts, strict=True):
            f = fingerprint(text, width, seed)
            yield i, f - (1 << 64) if f >> 63 else f

    return map_rows(docs.select(F.col(id_col).cast("long"), text_col), make, "id long, fp long")


def _added(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry and sum of three words, bit by bit."""
    half = a ^ b
    carry = (a & b) | (half & c)
    half ^= c
    return carry, half


def close_words(plane: Callable[[int, tuple | None], np.ndarray], n: int, radius: int, bits: int = 64, at: tuple | None = None) -> tuple[tuple, np.ndarray]:
    """Masks of the pairs within the radius, over ``n`` words of 64 pairs.

    ``plane(b, at)`` gives the words of difference bits of plane ``b`` at the positions ``at``, arrays of their places; None stands for all, in order. Eight planes at a time go through a tree of carry-save
    adders into the counters. Returns the positions that were not given up and a word for each, with a set bit where the distance is small enough.
    """
    size = max(3, radius.bit_length())
    low, over = [np.zeros(n, np.uint64) for _ in range(size)], np.zeros(n, np.uint64)

    def above() -> np.ndarray:
        """over, or the counter is greater than the radius."""
        more, same = np.zeros(len(over), np.uint64), ~np.zeros(len(over), np.uint64)
        for k in reversed(range(size)):
            if radius >> k & 1:
                same = same & low[k]
            else:
                more |= same & low[k]
                same = same & ~low[k]
        return over | more

    looks = {bits * k // 16 for k in (4, 6, 8, 10, 11, 12)}
    for b in range(0, bits, 8):
        fours = []
        for half in (b, b + 4):
            two, low[0] = _added(low[0], plane(half, at), plane(half + 1, at))
            more, low[0] = _added(low[0], plane(half + 2, at), plane(half + 3, at))
            four, low[1] = _added(low[1], two, more)
            fours.append(four)
        carry, low[2] = _added(low[2], *fours)
        for k in range(3, size):
            carry, low[k] = low[k] & carry, low[k] ^ carry
        over |= carry
        if b + 8 in looks:
            alive = np.flatnonzero(~above())
            if len(alive) < 0.8 * len(over):
                at = (alive,) if at is None else tuple(a[alive] for a in at)
                low, over = [c[alive] for c in low], over[alive]
                if not len(over):
                    break
    return (np.arange(n),) if at is None else at, ~above()


def _planes(values: np.ndarray) -> np.ndarray:
    """A row of words for each bit: bit b of value i (a row of words itself) is bit i % 64 of word i // 64 in row b."""
    values = values if values.ndim == 2 else values[:, None]
    padded = np.zeros((-(-len(values) // 64) * 64, values.shape[1]), np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def _set_bits(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each set bit: the index of its word, and the bit."""
    bits = np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.nonzero(bits)


def _links_by_offset(fp: np.ndarray, group: np.ndarray, radius: int) -> tuple[list, list]:
    """Pairs in small groups: rows i and i + d of one group, for each d."""
    left, right = [], []
    for d in range(1, SMALL):
        i = np.flatnonzero(group[d:] == group[:-d])
        if not len(i):
            break
        planes = _planes(fp[i] ^ fp[i + d])
        (w,), close = close_words(lambda b, at, p=planes: p[b] if at is None else p[b][at[0]], planes.shape[1], radius, len(planes))
        word, bit = _set_bits(close)
        pair = w[word] * 64 + bit
        pair = i[pair[pair < len(i)]]
        left.append(pair), right.append(pair + d)
    return left, right


def _links_by_block(a: np.ndarray, b: np.ndarray, radius: int, same: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a large group: blocks of queries against the vertical planes of all the others; where both are the same rows, of those not before them."""
    every = _planes(b)
    for q in range(0, len(a), 256):
        skipped = q // 64 if same else 0
        ones, planes = _planes_of_queries(a[q : q + 256]), every[:, skipped:]
        wide = planes.shape[1]

        def plane(p: int, at: tuple | None, ones=ones, planes=planes, wide=wide) -> np.ndarray:
            return (ones[p][:, None] ^ planes[p]).ravel() if at is None else ones[p][at[0] // wide] ^ planes[p][at[0] % wide]

        (at,), close = close_words(plane, ones.shape[1] * wide, radius, len(planes))
        word, bit = _set_bits(close)
        i, j = at[word] // wide, (at[word] % wide + skipped) * 64 + bit
        yield q + i[j < len(b)], j[j < len(b)]


def _links_of_groups(fp: np.ndarray, sizes: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within groups of these sizes, one after the other in ``fp``: so many groups at one time that short arrays don't cost more than their work."""
    ends = np.cumsum(sizes)
    while len(sizes):
        k = max(1, int(np.searchsorted(np.cumsum(sizes * (sizes // 64 + 1)) // 2, GRID, "right")))
        here, sizes = sizes[:k], sizes[k:]
        first, last, ends = int(ends[0] - here[0]), int(ends[k - 1]), ends[k:]
        words = -(-here // 64)
        row = np.arange(last - first)
        offset = row - np.repeat(np.cumsum(here) - here, here)
        begin = np.repeat(np.cumsum(words) - words, here)  # the first word of each row's group
        padded = np.zeros((int(words.sum()) * 64, fp.shape[1]), np.uint64)
        padded[begin * 64 + offset] = fp[first:last]
        row_of = np.full(len(padded), -1)
        row_of[begin * 64 + offset] = row
        ones, planes = _planes_of_queries(fp[first:last]), _planes(padded)
        count = np.repeat(words, here) - offset // 64  # words not before the row's own
        query = np.repeat(row, count)
        word = np.arange(len(query)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin + offset // 64, count)
        at, close = close_words(lambda p, at, o=ones, s=planes: o[p][at[0]] ^ s[p][at[1]], len(query), radius, len(planes), (query, word))
        w, bit = _set_bits(close)
        i, j = at[0][w], row_of[at[1][w] * 64 + bit]
        good = j > i
        yield first + i[good], first + j[good]


def _planes_of_queries(values: np.ndarray) -> np.ndarray:
    """A row for each bit: for each query a word of all ones where its bit is set."""
    bits = np.unpackbits(np.ascontiguousarray(values).view(np.uint8), axis=1, bitorder="little")
    return np.uint64(0) - np.ascontiguousarray(bits.T).astype(np.uint64)


class _Forest:
    """Smallest linked row of each row, over links that come in batches."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, left: np.ndarray, right: np.ndarray) -> None:
        root = self.root
        while len(left):
            a, b = root[left], root[right]
            differ = a != b
            if not differ.any():
                return
            left, right, a, b = left[differ], right[differ], a[differ], b[differ]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root[:] = root[root]


def stars(fp: np.ndarray, group: np.ndarray, tile: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the rows of each group (equal neighbours in ``group``) within the radius, as row numbers.

    ``fp`` has a row of words for each. In a group of two tiles only links between them matter.
    """
    forest = _Forest(len(fp))
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(fp) else np.zeros(0, int)
    sizes = np.diff(np.r_[starts, len(fp)])
    rows = np.flatnonzero(np.repeat(sizes <= SMALL, sizes))
    if len(rows):
        left, right = _links_by_offset(fp[rows], group[rows], radius)
        if left:
            forest.link(rows[np.concatenate(left)], rows[np.concatenate(right)])

    whole = np.add.reduceat(tile, starts) == 0 if len(fp) else np.zeros(0, bool)  # of one tile
    middle = (sizes > SMALL) & (sizes <= CROWD) & whole
    rows = np.flatnonzero(np.repeat(middle, sizes))
    for left, right in _links_of_groups(fp[rows], sizes[middle], radius):
        forest.link(rows[left], rows[right])

    def compare(a: np.ndarray, b: np.ndarray) -> None:
        if len(a) and len(b):
            for i, j in _links_by_block(fp[a], fp[b], radius, a is b):
                forest.link(a[i], b[j])

    large = (sizes > SMALL) & ~middle
    for start, size in zip(starts[large], sizes[large], strict=True):
        here = np.arange(start, start + size)
        rest, core = here, np.zeros(size, bool)
        for _ in range(PIVOTS if size > CROWD else 0):
            compare(rest[:1], here)
            roots, counts = np.unique(forest.root[here], return_counts=True)
            core = forest.root[here] == roots[np.argmax(counts)]
            rest = here[~core]
            if not len(rest):
                break
        # The core hangs together already: only pairs with one of the rest can add a link.
        second, core = here[tile[here] == 1], here[core]
        if len(second):
            compare(rest[tile[rest] == 0], second)
            compare(rest[tile[rest] == 1], core[tile[core] == 0])
        else:
            compare(rest, here)
    leaf = np.flatnonzero(forest.root != np.arange(len(fp)))
    return leaf, forest.root[leaf]


def blocks_alike(n: int, radius: int) -> int:
    """In how many blocks of ``radius + k`` two fingerprints must agree, so that their bits tell ``n`` fingerprints apart."""
    k = 2
    while 64 * k // (radius + k) < math.log2(max(1, n) / BUCKET) and 64 * (k + 1) / (radius + k + 1) <= 44 and math.comb(radius + k + 1, k + 1) <= 1024:
        k += 1
    return k


def block_keys(fp: Column, radius: int, alike: int = 2) -> Column:
    """Array of bucket keys: for each choice of ``alike`` of the ``radius + alike`` blocks of bits its number and their bits."""
    n = radius + alike
    cuts = [64 * k // n for k in range(n + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(n), alike)):
        key = F.lit(number).cast("long")
        for k in chosen:
            wide = cuts[k + 1] - cuts[k]
            key = F.shiftleft(key, wide).bitwiseOR(F.shiftrightunsigned(fp, cuts[k]).bitwiseAND(F.lit((1 << wide) - 1)))
        keys.append(key)
    return F.array(*keys)


def links(prints: DataFrame, radius: int = 4, tile: int = TILE, alike: int | None = None) -> DataFrame:
    """``a``, ``b``: links that span all pairs of distinct ``fp`` within the radius (bits that differ)."""
    if not 1 <= radius <= 14:
        raise ValueError("radius must be from 1 to 14")
    alike = blocks_alike(prints.count(), radius) if alike is None else alike
    keyed = prints.select("fp", F.explode(block_keys(F.col("fp"), radius, alike)).alias("key"))
    sizes = keyed.groupBy("key").count().where("count > 1").select("key", F.ceil(F.col("count") / tile).cast("int").alias("tiles"))
    sizes = written(sizes, "buckets")  # apart from its aggregate, Spark may split the join where a bucket is very large
    return _compared(keyed.join(sizes, "key"), ["fp"], radius)


def _dealt(keyed: DataFrame, columns: list[str]) -> DataFrame:
    """``key``, ``p``, ``q``, ``tile``, columns: the rows of each ``key`` once for each pair of its ``tiles`` they belong to, sorted by pair."""
    one = keyed.withColumn("own", F.pmod(F.xxhash64(columns[0]), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    jobs = one.select("key", *columns, "own", other.alias("other")).select(
        "key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("own") > F.col("other")).cast("int").alias("tile"), *columns
    )
    return jobs.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "tile")


def _compared(keyed: DataFrame, columns: list[str], radius: int) -> DataFrame:
    """``a``, ``b``: links between the rows of each ``key``, dealt over its ``tiles``.

    Rows are named by the first of the columns; their fingerprint is in the last ones, in all but the first if there are several.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in _then_none(batches):
            if batch is not None:
                new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            if held is None or not len(held[0]):
                continue
            key, p, q, side, *rest = held
            new = np.r_[True, (key[1:] != key[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])]
            end = len(key) if batch is None else int(np.flatnonzero(new)[-1])
            fp = np.stack([x[:end].view(np.uint64) for x in rest[-max(1, len(rest) - 1) :]], axis=1)
            a, b = stars(fp, np.cumsum(new)[:end], side[:end], radius)
            held = [x[end:] for x in held]
            if len(a):
                yield _named_links(rest[0], a, b)

    return _dealt(keyed, columns).mapInArrow(run, "a long, b long").distinct()


def _named_links(names: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Stars of rows as links of each row's name with the least name of its star, which the buckets that share a large group mostly have in common."""
    least = names.copy()
    np.minimum.at(least, b, names[a])
    ends = np.unique(b)
    left, right = np.r_[names[a], names[ends]], np.r_[least[b], least[ends]]
    good = left != right
    return pa.RecordBatch.from_arrays([pa.array(left[good]), pa.array(right[good])], names=["a", "b"])


def _verified(keyed: DataFrame, width: int, similarity: float, seed: int) -> DataFrame:
    """``a``, ``b``: links that span all pairs of ``node`` of one ``key``, dealt over its ``tiles``, whose ``text`` is similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, nodes, sets = None, [], []
        for piece in _then_none(slices(batches)):
            rows = zip(*(c.to_pylist() for c in piece.columns), strict=True) if piece is not None else [(None,) * 6]
            for key, p, q, _, node, text in rows:
                if (key, p, q) != job:
                    if len(sets) > 1:
                        yield _named_links(np.array(nodes, np.int64), *alike(sets, similarity))
                    job, nodes, sets = (key, p, q), [], []
                nodes.append(node)
                sets.append(shingle_codes(text, width, seed))

    return _dealt(keyed, ["node", "text"]).mapInArrow(run, "a long, b long").distinct()


def alike(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links, as row numbers, of all pairs of sets whose Jaccard similarity is at least as asked for; empty sets are alike."""
    n, forest = len(sets), _Forest(len(sets))
    sizes = np.array([len(x) for x in sets])
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    bounds, starts = np.r_[0, np.cumsum(sizes)], np.r_[0, np.cumsum(np.bincount(code))]
    holders = np.repeat(np.arange(n), sizes)[np.argsort(code, kind="stable")]

    def ask(rows: np.ndarray) -> None:
        """Link these rows with all the like ones, by the holders of each of their members."""
        for i in rows.tolist():
            own = code[bounds[i] : bounds[i + 1]]
            held = starts[own + 1] - starts[own]
            ends = np.cumsum(held)
            at = np.arange(held.sum()) + np.repeat(starts[own] - (ends - held), held)
            common = np.bincount(holders[at], minlength=n)
            union = sizes[i] + sizes - common
            near = np.flatnonzero((common / np.maximum(union, 1) >= similarity) | (union == 0))
            forest.link(np.full(len(near), i), near)

    rest = np.arange(n)
    for _ in range(PIVOTS):
        ask(rest[:1])
        roots, counts = np.unique(forest.root, return_counts=True)
        rest = np.flatnonzero(forest.root != roots[np.argmax(counts)])
        if not len(rest):
            break
    ask(rest)  # the core hangs together already
    leaf = np.flatnonzero(forest.root != np.arange(n))
    return leaf, forest.root[leaf]


def _then_none(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root``: the smallest node reachable, for every node of the links ``a``, ``b``.

    Alternating stars: each node hangs its larger neighbours, then its smaller ones, on the least of
    them. Both are an aggregate with map-side combining and a join that Spark may split where a node
    has very many links; the number of rounds grows with the logarithm of the longest chain.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    pairs = written(pairs.distinct(), "links")
    before = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        least = written(least, "least")  # as above, for a node with very many links
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u <> v").distinct(), "links")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        pairs = written(small, "links")
        state = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42, radius: int = 4) -> DataFrame:
    """``id``, ``fp``, ``component`` for every row: the least id reachable over links within ``radius`` bits.

    Equal fingerprints are always linked, so equal, empty and null texts share a component with their
    like. Rows with a null id get a component but never name one; where a whole component lacks ids it is
    null. Repeated rows come back repeated. An empty table gives no rows. Other columns are not read.
    """
    prints = written(fingerprints(docs, id_col, text_col, width, seed), "prints")
    nodes = prints.groupBy("fp").agg(F.min("id").alias("first"))
    nodes = written(nodes, "nodes")
    roots = components(links(nodes.select("fp"), radius))
    member = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    member = written(member, "members")
    linked = roots.select("root").distinct()
    named = member.join(linked, "root", "left_semi").groupBy("root").agg(F.min("first").alias("least"))
    named = member.join(named, "root", "left").select("fp", F.coalesce("least", "first").alias("component"))
    return prints.join(named, "fp").select("id", "fp", "component")


def share_of_bits(similarity: float) -> float:
    """Mean share of the bits that differ between texts of this Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def radius_of(similarity: float, bits: int) -> int:
    """Differing bits up to which texts of this Jaccard similarity are linked: their mean number, and some slack."""
    share = share_of_bits(similarity)
    return round(bits * share + SLACK * math.sqrt(bits * share * (1 - share)))


def key_plan(n: int, similarity: float) -> tuple[int, int]:
    """Number of keys and bits of each for ``n`` texts: buckets stay of one size as tables grow, and similar texts agree in :data:`MET` keys on average."""
    size = max(0, math.ceil(math.log2(max(1, n) / WIDE_BUCKET)))
    return (math.ceil(MET / (1 - share_of_bits(similarity)) ** size), size) if size else (1, 0)


def bit_keys(fp: np.ndarray, keys: int, size: int) -> np.ndarray:
    """A row of keys for each row of words: key k holds ``size`` bits at an odd step, and k itself above them."""
    bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8), axis=1, bitorder="little")
    weights = np.int64(1) << np.arange(size, dtype=np.int64)
    at = [(37 * k + (2 * k + 1) * np.arange(size)) % bits.shape[1] for k in range(keys)]
    return np.stack([bits[:, x] @ weights + (np.int64(k) << np.int64(44)) for k, x in enumerate(at)], axis=1)


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, seed: int = 42, tile: int = WIDE_TILE) -> DataFrame:
    """``id``, ``component`` for every row with an id: the least id reachable over links of texts as similar as asked for.

    The similarity is the Jaccard similarity of the sets of word shingles, and every link is a pair that has it. Candidates are met
    by 256-bit fingerprints of these sets: a pair has to agree in one of the keys (:func:`key_plan`) and lie within the radius (:func:`radius_of`), or be
    joined by such pairs. By the binomial law of the bits 999 of 1000 pairs of similarity 0.8 do so directly in tables of up to a million texts, and more of closer ones;
    the rest can be missed. Equal texts always share a component, as do null, empty and blank ones. Rows that repeat
    an id have the components of their own texts. Rows with a null id are left out. An empty table gives no rows. Other columns are not read.

    Of the texts, one of each kind that has a candidate is shuffled to its group; a large group is cut into tiles and compared whole.
    """
    names = [f"f{k}" for k in range(WORDS)]
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("body"), F.col(text_col).alias("text")).where("id is not null")

    def make(ids: list, bodies: list, texts: list) -> Iterator[tuple]:
        for i, body, text in zip(ids, bodies, texts, strict=True):
            yield i, body, *_vote([shingle_codes(text, width, seed)], WORDS).view(np.int64).tolist()

    prints = written(map_rows(texts, make, "id long, body long, " + ", ".join(f"{n} long" for n in names)), "prints")
    nodes = prints.groupBy("body", *names).agg(F.min("id").alias("first"))
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("node"), "first", "body", *names), "nodes")

    n_keys, size = key_plan(nodes.count(), similarity)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            columns = [c.to_numpy(zero_copy_only=False) for c in piece.columns]
            keys = bit_keys(np.stack(columns[1:], axis=1), n_keys, size)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *(pa.array(np.repeat(c, n_keys)) for c in columns)], names=["key", "node", *names])

    keyed = nodes.select("node", *names).mapInArrow(spread, "key long, node long, " + ", ".join(f"{n} long" for n in names))
    large = keyed.groupBy("key").count().where(F.col("count") > tile).select("key", F.ceil(F.col("count") / tile).cast("int").alias("tiles"))
    large = written(large, "large")  # few or none: Spark broadcasts them if their size is below its threshold
    keyed = keyed.join(large, "key", "left").select("key", "node", *names, F.coalesce("tiles", F.lit(1)).alias("tiles"))
    groups = components(_compared(keyed, ["node", *names], radius_of(similarity, 64 * WORDS)))
    groups = groups.unionByName(groups.select("root").distinct().select(F.col("root").alias("node"), "root"))
    groups = written(nodes.join(groups, "node").select(F.col("root").alias("key"), "node", F.col("first").alias("id"), "body"), "groups")
    texts = texts.join(groups.hint("merge"), ["id", "body"]).dropDuplicates(["id", "body"]).select("key", "node", "text")
    texts = written(texts, "texts")
    tiles = F.ceil(F.greatest(F.count("*") / min(tile, TEXT_TILE), F.sum(F.octet_length("text")) / TEXT_BYTES)).cast("int")
    large = written(texts.groupBy("key").agg(tiles.alias("tiles")).where("tiles > 1"), "large")
    texts = texts.join(large, "key", "left").select("key", "node", "text", F.coalesce("tiles", F.lit(1)).alias("tiles"))
    roots = components(_verified(texts, width, similarity, seed))
    member = nodes.join(roots, "node", "left").select("body", *names, "first", F.coalesce("root", "node").alias("root"))
    member = written(member, "members")
    least = written(member.groupBy("root").agg(F.min("first").alias("component")), "least")  # as above, for a very large group
    member = member.join(least, "root").select("body", *names, "component")
    return prints.join(member, ["body", *names]).select("id", "component")


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


QUERIES = {"op10_simhash": op10_simhash}
ORACLE_SQL: dict[str, str] = {}
