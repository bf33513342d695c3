"""Sixteen documents whose id tells which of the words A, B, C, D they hold; expected values follow from the formulas."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.functions.presence import EVERY, NONE, has
from wordloom.functions.similarity import EXPRESSIONS, built_in, expression
from wordloom.operators import associate as A
from wordloom.operators import cluster, matrix
from wordloom.operators.fulltext import Join, Pattern, Search, sample_ranks
from wordloom.sources.formats import corpus_from_lines


@pytest.fixture(scope="module")
def lattice(spark, tmp_path_factory):
    lines = ["@title=a small test data"]
    for n in range(16):
        name = f"{n:04b}"
        lines += [f"i{name}", f"#title=T{name}", f"#link=L{name}", f"!{name}", *[f" {w}" for w, bit in zip("DCBA", name, strict=True) if bit == "1"]]
    path = tmp_path_factory.mktemp("lattice") / "lattice.txt"
    path.write_text("\n".join(lines))
    from wordloom.sources.formats import record_lines

    return corpus_from_lines(record_lines(spark, str(path))).stored()


def rows(spark, corpus, names):
    return A.entities(corpus.rows.where(F.col("name").isin(names)).select(F.col("row").alias("id")))


def cols(spark, names, **more):
    return A.entities(spark.createDataFrame([(n,) for n in names], "id string").select("id", *[F.lit(v).alias(k) for k, v in more.items()]))


def named(corpus, found):
    return {r.name: round(r.score, 6) for r in found.join(corpus.rows.select(F.col("row").alias("id"), "name"), "id").collect()}


def test_statistics(lattice):
    s = lattice.stats
    assert (s["n_rows"], s["n_cols"], s["total_df"], s["total_tf"]) == (16, 4, 32, 32)
    assert {r.df for r in lattice.col_dims.collect()} == {8}
    assert lattice.rows.where("name = '0101'").first().props == {"title": "T0101", "link": "L0101"}


@pytest.mark.parametrize(
    "kind, expected",
    [
        ("WT_SMARTWA", {"0011": 1.0, "0111": 0.909091, "1011": 0.909091, "1111": 0.833333, "0001": 0.555556, "0010": 0.555556}),
        ("WT_SMART", {"0011": 1.098612, "0111": 0.998738, "1011": 0.998738, "1111": 0.915510, "0001": 0.610340, "0010": 0.610340}),
        ("WT_COSINE", {"0011": 1.0, "0111": 0.816497, "1011": 0.816497, "1111": 0.707107, "0001": 0.707107, "0010": 0.707107}),
    ],
)
def test_words_to_documents(spark, lattice, kind, expected):
    found = A.associate(lattice, "rows", kind, 20, cols(spark, ["A", "B"]))
    assert found.first().total == 12
    got = named(lattice, found)
    assert {k: got[k] for k in expected} == expected


def test_bm25_of_a_word_in_half_of_all(spark, lattice):
    found = A.associate(lattice, "rows", "WT_Okapi_BM25", 20, cols(spark, ["A"])).collect()
    assert len(found) == 8 and all(r.score == 0 and r.total == 8 for r in found)


def test_documents_to_words(spark, lattice):
    found = A.associate(lattice, "cols", "WT_SMARTAW", 10, rows(spark, lattice, ["0011", "0111"])).collect()
    assert {r.id: round(r.score, 6) for r in found} == {"A": 0.405465, "B": 0.405465, "C": 0.202733}
    assert found[0].total == 3


def test_stages(spark, lattice):
    out = A.Request(n_rows=20, n_cols=5, topic_items=2).run(lattice, rows(spark, lattice, ["0011"]))
    assert {r.id: round(r.score, 6) for r in out["summary"].collect()} == {"A": 0.405465, "B": 0.405465}
    got = named(lattice, out["rows"])
    assert len(got) == 12 and got["0011"] == 0.405465 and got["1011"] == 0.368605 and got["1111"] == 0.337888 and got["0001"] == 0.225258
    topics = {r.id: (round(r.score, 6), r.tf_d) for r in out["cols"].collect()}
    assert topics == {"A": (0.405465, 2), "B": (0.405465, 2), "C": (0.202733, 1)}


def test_cross_reference(spark, lattice):
    words = spark.createDataFrame([("A", 2)], "id string, tf_d long")
    vectors = matrix.row_vectors(lattice, lattice.rows.where("name = '0011'").select(F.col("row").alias("id")))
    assert round(matrix.cross_reference(lattice, vectors, matrix.unit_vectors(words)).first().sim, 6) == 0.610340


@pytest.mark.parametrize(
    "having, total",
    [(has("C"), 6), (~has("C"), 6), (has("zzz"), 0), (~has("zzz"), 12), (EVERY, 12), (NONE, 0), (has("C") & ~has("D"), 3), (~(has("C") | has("D")), 3)],
)
def test_presence(spark, lattice, having, total):
    assert A.associate(lattice, "rows", "WT_SMART", 20, cols(spark, ["A", "B"]), filters=A.Filters(having=having)).count() == total


def test_masks(spark, lattice):
    ids = lambda *names: lattice.rows.where(F.col("name").isin(*names)).select(F.col("row").alias("id"))
    run = lambda f: set(named(lattice, A.associate(lattice, "rows", "WT_SMART", 20, cols(spark, ["A"]), filters=f)))
    everyone = {f"{n:04b}" for n in range(16) if n & 1}
    assert run(A.Filters(include=ids("0001", "0010"))) == {"0001"}
    assert run(A.Filters(exclude=ids("0001"))) == everyone - {"0001"}
    assert run(A.Filters(include=ids("0001"), exclude=ids("0001", "0011"))) == everyone - {"0011"}


def test_cutoffs(spark, lattice):
    assert [A.default_cutoff(n) for n in (16, 10_000, 100_000, 1_000_000)] == [16, 10_000, 12_500, 15_625]
    count = lambda cutoff: A.summary(lattice, rows(spark, lattice, ["0011"]), cutoff=cutoff).count()
    assert (count(8), count(9), count(0)) == (0, 2, 2)


def test_search(spark, lattice):
    run = lambda *p, **k: set(named(lattice, Search((Join(tuple(Pattern(x) for x in p)),), **k).run(lattice)))
    assert run("01") == {f"{n:04b}" for n in range(16) if "01" in f"{n:04b}"}
    assert run("01", options="match-head") == {"0100", "0101", "0110", "0111"}
    assert run("01", options="match-tail") == {"0001", "0101", "1001", "1101"}
    assert run("01", segments="1-3") == set()
    assert Search((Join((), (Pattern("01"),)),)).run(lattice).count() == 0


def test_search_as_filter(spark, lattice):
    search = Search((Join((), (Pattern("11"),)),))
    got = named(lattice, A.associate(lattice, "rows", "WT_SMART", 20, cols(spark, ["A"]), filters=search.filters(lattice)))
    assert set(got) == {"0001", "0101", "1001"}


def test_sample_is_even():
    assert sample_ranks(16, 4) == [2, 6, 10, 14]
    assert all(len(sample_ranks(m, n)) == n for m in range(2, 40) for n in range(1, m))


def test_ties_by_id(spark, lattice):
    found = A.associate(lattice, "rows", "WT_DOT_PRODUCT", 2, cols(spark, ["A"]))
    assert [r.id for r in found.orderBy("rank").collect()] == [2, 4]


def test_clusters(spark, lattice):
    names = ["0001", "0011", "0100", "1100"]
    items = lattice.rows.where(F.col("name").isin(names)).select(F.lit(0).alias("query"), F.col("row").alias("id"), F.lit(1.0).alias("score"), F.col("row").alias("rank"))
    back = {r.row: r.name for r in lattice.rows.collect()}
    found = cluster.clusters(lattice, items, 2).collect()
    groups = {frozenset(back[r.id] for r in found if r.cluster == c) for c in {r.cluster for r in found}}
    assert groups == {frozenset(names[:2]), frozenset(names[2:])}
    assert {r.id for r in cluster.clusters(lattice, items, 2, "kmeans", None).collect()} == {r.id for r in items.collect()}
    near = np.array([[0.0, 1], [9, 9], [0, 2], [9, 8], [1, 1]])
    assert cluster.k_means(near, 2) == [[0, 2, 4], [1, 3]]
    counts = np.array([[1, 0, 0, 0], [1, 1, 0, 0], [0, 0, 1, 0], [0, 0, 1, 1]], float)
    assert cluster.bayesian(counts, np.ones(4), 2) == [[0, 1], [2, 3]]
    with pytest.raises(ValueError):
        cluster.clusters(lattice, items, 2, "hbc", None)


def test_delete_and_append(spark, lattice):
    less = lattice.deleted(spark.createDataFrame([("1111",), ("none",)], "name string"))
    assert (less.stats["n_rows"], less.stats["total_df"]) == (15, 28)
    assert {r.df for r in less.col_dims.collect()} == {7}
    assert less.appended(lattice).stats == lattice.stats
    assert lattice.appended(less).stats == lattice.stats


@pytest.mark.parametrize("name, kind, side", [("smartwa", "WT_SMARTWA", "rows"), ("smart", "WT_SMART", "rows"), ("smartaw", "WT_SMARTAW", "cols")])
def test_expressions_equal_built_ins(spark, lattice, name, kind, side):
    inputs = cols(spark, ["A", "B"]) if side == "rows" else rows(spark, lattice, ["0011", "0111"])
    run = lambda s: {r.id: round(r.score, 9) for r in A.scored(lattice, side, s, inputs).collect()}
    assert run(expression(*EXPRESSIONS[name])) == run(kind)


def test_dot_product_commutes_with_transposition(spark, lattice):
    forth = A.scored(lattice, "rows", "WT_DOT_PRODUCT", cols(spark, ["C"])).collect()
    for r in forth:
        back = A.scored(lattice, "cols", "WT_DOT_PRODUCT", A.entities(spark.createDataFrame([(r.id,)], "id long"))).where("id = 'C'").first()
        assert back.score == r.score


def test_unknown_things_are_refused(spark, lattice):
    for name in ("WT_NONE", "WT_HITS", "wt_smart"):
        with pytest.raises(ValueError):
            built_in(name)
    with pytest.raises(ValueError):
        A.Request().with_defaults("nothing=1")
    assert A.Request().with_defaults("n_rows=3\nsimilarities=WT_SMART,WT_SMART,WT_SMART").n_rows == 3


def test_batch_equals_single(spark, lattice):
    one = {w: named(lattice, A.associate(lattice, "rows", "WT_SMARTWA", 3, cols(spark, [w]))) for w in "ABC"}
    both = A.entities(spark.createDataFrame([(w, w) for w in "ABC"], "query string, id string"))
    found = A.associate(lattice, "rows", "WT_SMARTWA", 3, both).join(lattice.rows.select(F.col("row").alias("id"), "name"), "id").collect()
    assert {w: {r.name: round(r.score, 6) for r in found if r.query == w} for w in "ABC"} == one


def test_empty_results(spark, lattice):
    assert A.associate(lattice, "rows", "WT_SMART", 5, cols(spark, ["none"])).count() == 0
    texts = spark.createDataFrame([(0, "a", "nothing known"), (0, "b", None)], "query int, input string, text string")
    assert A.summary(lattice, vectors=A.text_inputs(lattice, texts)).count() == 0
    assert math.isclose(lattice.stats["total_tf"] / lattice.stats["n_rows"], 2)
