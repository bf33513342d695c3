"""Cluster the items of a result: hierarchical Bayesian clustering and K-means.

Items are the best of a query, a few hundred at most, and bounded by the request. Spark computes their features and groups them by
query; each query's items are then merged in one task, any number of queries side by side.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import Similarity
from ..model import Corpus
from ..tables import written
from .associate import associate, entities

FEATURES, LABEL_WORDS = 256, 128
ROUNDS = 128
MAX_ITEMS = 1000


def features(corpus: Corpus, items: DataFrame, similarity: str | Similarity | None = "WT_SMART") -> DataFrame:
    """``query``, ``item``, ``rank``, ``weight``, ``t``, ``tf``: for each item its 256 best words, or without a similarity its whole vector."""
    if similarity is None:
        found = corpus.postings.select(F.col("row").alias("item"), F.col("col").alias("t"), "tf")
        return items.select("query", F.col("id").alias("item"), "rank", F.col("score").alias("weight")).join(found, "item")
    each = items.select(F.struct("query", F.col("id").alias("item"), "rank", F.col("score").alias("weight")).alias("query"), "id")
    found = associate(corpus, "cols", similarity, FEATURES, entities(each))
    return found.select("query.*", F.col("id").alias("t"), F.col("tf_d").alias("tf"))


def _matrix(rows: pd.DataFrame) -> tuple[list, np.ndarray, np.ndarray]:
    """Items in order of rank, their weights, and their feature counts."""
    order = rows[["rank", "item", "weight"]].drop_duplicates("item").sort_values("rank")
    items = order["item"].tolist()
    at, terms = {x: k for k, x in enumerate(items)}, {t: k for k, t in enumerate(sorted(rows["t"].unique()))}
    counts = np.zeros((len(items), len(terms)))
    np.add.at(counts, ([at[x] for x in rows["item"]], [terms[t] for t in rows["t"]]), rows["tf"].to_numpy(float))
    return items, order["weight"].to_numpy(float), counts


def bayesian(counts: np.ndarray, weights: np.ndarray, k: int) -> list[list[int]]:
    """Merge the pair of clusters whose union loses least of sum log P(item | its cluster), until k are left.

    P(d|c) = sum over t of P(t|d) P(t|c) / P(t). The first best pair wins; in a union, the side of the higher
    mean weight stands first. Clusters are in the order of their first item.
    """
    share = counts / counts.sum(1, keepdims=True)
    lift = share / (counts.sum(0) / counts.sum())  # P(t|d) / P(t)
    clusters, sums = [[i] for i in range(len(counts))], [row for row in counts]

    def fit(members: list[int], total: np.ndarray) -> float:
        return float(np.log(lift[members] @ (total / total.sum())).sum())

    own = [fit(c, s) for c, s in zip(clusters, sums, strict=True)]
    gain = {(i, j): fit(clusters[i] + clusters[j], sums[i] + sums[j]) - own[i] - own[j] for i in range(len(clusters)) for j in range(i + 1, len(clusters))}
    live = list(range(len(clusters)))
    while len(live) > k:
        top, pair = -np.inf, None
        for a, i in enumerate(live):
            for j in live[a + 1 :]:
                if gain[i, j] > top:
                    top, pair = gain[i, j], (i, j)
        i, j = pair
        first, second = (i, j) if weights[clusters[i]].mean() >= weights[clusters[j]].mean() else (j, i)
        clusters[i], sums[i] = clusters[first] + clusters[second], sums[i] + sums[j]
        own[i] = fit(clusters[i], sums[i])
        live.remove(j)
        for m in live:
            if m != i:
                a, b = min(i, m), max(i, m)
                gain[a, b] = fit(clusters[a] + clusters[b], sums[a] + sums[b]) - own[a] - own[b]
    return sorted((clusters[i] for i in live), key=min)


def k_means(counts: np.ndarray, k: int) -> list[list[int]]:
    """Items start in turn in each cluster and go to the nearest mean (the first of equals), at most 128 times. Empty clusters stay empty."""
    label = np.arange(len(counts)) % k
    for _ in range(ROUNDS):
        means = np.array([counts[label == c].mean(0) if (label == c).any() else np.full(counts.shape[1], np.inf) for c in range(k)])
        distance = np.stack([((counts - m) ** 2).sum(1) for m in means], axis=1)  # a cluster at a time: no more room than the counts take
        new = distance.argmin(1)
        if (new == label).all():
            break
        label = new
    return [np.flatnonzero(label == c).tolist() for c in range(k)]


def clusters(corpus: Corpus, items: DataFrame, k: int, method: str = "hbc", similarity: str | Similarity | None = "WT_SMART") -> DataFrame:
    """``query``, ``cluster`` (from 0), ``place`` (within it), ``id``. ``items`` is a result of an association.

    With one cluster, or as many as items, items stay as they are. Items without features go to the last cluster. More items than
    :data:`MAX_ITEMS` in a query are an error. Bayesian clustering needs a similarity.
    """
    if method == "hbc" and similarity is None:
        raise ValueError("Bayesian clustering needs a similarity for its features")
    ids = dict(items.dtypes)
    schema = f"query {ids['query']}, cluster int, place int, id {ids['id']}"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        if rows["item"].nunique() > MAX_ITEMS:
            raise ValueError(f"more than {MAX_ITEMS} items to cluster")
        known = rows[rows["t"].notna()]
        found, weights, counts = _matrix(known) if len(known) else ([], np.zeros(0), np.zeros((0, 0)))
        n = min(k, len(found))
        groups = [list(range(len(found)))] if n <= 1 else bayesian(counts, weights, n) if method == "hbc" else k_means(counts, n)
        named = [[found[i] for i in g] for g in groups]
        bare = rows[~rows["item"].isin(found)].sort_values("rank")["item"].drop_duplicates().tolist()
        if bare:
            named[-1] = named[-1] + bare
        out = [(rows["query"].iloc[0], c, p, x) for c, g in enumerate(named) for p, x in enumerate(g)]
        return pd.DataFrame(out, columns=["query", "cluster", "place", "id"])

    items = written(items, "items")  # a few, read twice
    shown = items.select("query", F.col("id").alias("item"), "rank", F.col("score").alias("weight"))
    rows = shown.join(features(corpus, items, similarity).select("query", "item", "t", "tf"), ["query", "item"], "left")
    return rows.groupBy("query").applyInPandas(run, schema)


def label_words(corpus: Corpus, grouped: DataFrame, similarity: str | Similarity = "WT_SMART", k: int = LABEL_WORDS) -> DataFrame:
    """The best words of each cluster: ``query`` is a struct of the query and the cluster."""
    each = grouped.select(F.struct("query", "cluster").alias("query"), "id")
    return associate(corpus, "cols", similarity, k, entities(each))
