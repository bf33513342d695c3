import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, size long, hash long, score double, words string, key string, shard int"


def prose(rng, n, vocabulary=400):
    """Lines of words from a small vocabulary."""
    words = [f"w{rng.randrange(vocabulary)}" for _ in range(n)]
    lines, at = [], 0
    while at < n:
        k = rng.randint(5, 15)
        lines.append(" ".join(words[at : at + k]))
        at += k
    return "\n".join(lines)


def make_rows():
    """Documents with nulls, empty, blank and very long texts, copies, near copies, shared passages, repeated rows and columns named like the operators' own."""
    rng = random.Random(7)
    passage, texts = prose(rng, 80), []
    for k in range(40):
        text = prose(rng, rng.randint(1, 300))
        texts.append(text)
        if k % 4 == 0:
            texts.append(text)
        if k % 5 == 0:
            words = text.split(" ")
            words[rng.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
        if k % 6 == 0:
            texts.append(prose(rng, 60) + "\n" + passage + "\n" + prose(rng, 30))
    texts += [None, None, "", " \n\t\n ", "one", "a\x1cb c\xa0d # $ %", "same line\n" * 30, "again and " * 400, prose(rng, 20_000, 5000), "x" * 50_000]
    rows = [(100 + 3 * i, t, "en", [None, "a", "b", "big", "big", "big"][i % 6], len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "nobody owns this " * 20, "en", "a", 1), (None, None, None, None, None), (5, texts[0], "en", "c", 1)]
    return [(*r, 1, 2, 3, 4.0, "clash", "clash", 7) for r in rows]


@pytest.fixture(scope="session")
def rows():
    return [(r[0], r[1], r[3]) for r in make_rows()]


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(make_rows(), SCHEMA).repartition(5).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
