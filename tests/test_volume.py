"""What is shuffled, and that it changes no result."""

import pytest
from pyspark.sql import functions as F

from wordloom.functions.text import words
from wordloom.model import Corpus
from wordloom.operators import associate as A
from wordloom.operators import matrix

TEXTS = [(1, "b a b, A c"), (2, ""), (3, None), (4, "c"), (4, "c d"), (5, "x y z a")]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_are_counted_within_their_text(spark):
    docs = spark.createDataFrame(TEXTS, "id long, text string")
    got = {(r.row, r.col): r.tf for r in Corpus.from_text(docs, "id", "text").postings.collect()}
    plain = docs.select("id", F.explode(words(F.col("text"))).alias("w")).groupBy("id", "w").count().collect()
    assert got == {(r.id, r.w): r["count"] for r in plain} and got[4, "c"] == 2
    assert "Exchange" not in plan(Corpus.from_text(docs.where("id <> 4"), "id", "text").postings)


def test_counts_are_made_once(spark, tmp_path):
    spark.createDataFrame([(1, 2, 1), (1, 2, 1), (3, 2, 1)], "row long, col long, tf long").write.parquet(f"{tmp_path}/counts")
    c = Corpus.from_counts(spark.read.parquet(f"{tmp_path}/counts")).stored()
    assert not any(f"{tmp_path.name}/counts" in f for f in c.rows.inputFiles())
    assert sorted((r.row, r.name, r.props) for r in c.rows.collect()) == [(1, "1", {}), (3, "3", {})]
    assert sorted(c.row_dims.collect()) == [(1, 1, 2), (3, 1, 1)]
    masked = c.masked(exclude=spark.createDataFrame([(1,)], "row long")).stored()
    assert masked.rows.count() == 2 and sorted(masked.row_dims.collect()) == [(1, 1, 2), (3, 1, 1)]


@pytest.fixture
def small_broadcasts(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_few_inputs_go_to_the_postings(spark, small_broadcasts):
    docs = spark.range(3000).select("id", F.concat_ws(" ", *[(F.col("id") * k % 997).cast("string") for k in range(1, 9)]).alias("text"))
    c = Corpus.from_text(docs, "id", "text").stored()
    inputs = A.entities(spark.createDataFrame([("5",), ("8",), ("13",)], "id string"))
    for kind in ("WT_SMARTWA", "WT_COSINE"):
        assert "hashpartitioning(t#" not in plan(A.scored(c, "rows", kind, inputs))
    # a list that only a whole query makes out
    listed = A.best(A.scored(c, "rows", "WT_SMARTWA", inputs), 5)
    assert "SortMergeJoin" not in plan(matrix.row_vectors(c, listed))


def test_a_task_counts_a_bounded_number_of_pairs(spark, monkeypatch):
    from wordloom import tables

    monkeypatch.setattr(tables, "ROWS_A_TASK", 200)
    counts = spark.range(10_000).select((F.col("id") % 1999).alias("row"), (F.col("id") % 7).alias("col"), F.lit(1).cast("long").alias("tf"))
    c = Corpus.from_counts(counts, about=10_000)
    assert plan(c.postings).count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan(c.postings)
    sizes = c.postings.groupBy(F.spark_partition_id()).agg(F.sum("tf").alias("n")).collect()
    assert len(sizes) > 40 and max(r.n for r in sizes) < 600
    assert sorted(c.postings.collect()) == sorted(Corpus.from_counts(counts).postings.collect())


def test_few_ids_are_remapped_without_a_shuffle_of_names(spark, small_broadcasts, monkeypatch):
    counts = spark.range(60_000).select((F.col("id") % 20_000).alias("row"), (F.col("id") % 30_011).alias("col"), F.lit(1).cast("long").alias("tf"))
    source, target = Corpus.from_counts(counts).stored(), Corpus.from_counts(counts.where("row % 2 = 0 and col % 3 <> 0")).stored()
    plans, write = [], A.written
    monkeypatch.setattr(A, "written", lambda df, name: (plans.append(plan(df)), write(df, name))[1])
    ids = spark.createDataFrame([(5,), (8,)], "id long")
    pairs = {(k % 20_000, k % 30_011) for k in range(60_000)}
    kept = {(r, c) for r, c in pairs if r % 2 == 0 and c % 3 != 0}
    for of, k in (("rows", 0), ("cols", 1)):
        got = A.remapped(source, ids, target, of)
        known = {p[1 - k] for p in kept}
        assert {(int(r.input), r.id) for r in got.collect()} == {(p[k], p[1 - k]) for p in pairs if p[k] in (5, 8) and p[1 - k] in known}
        plans.append(plan(got))
    assert len(plans) > 4 and not any("SortMergeJoin" in p or "hashpartitioning(row" in p for p in plans)


def test_few_inputs_go_to_the_table_of_all_entities(spark, small_broadcasts, monkeypatch):
    docs = spark.range(3000).select("id", F.concat_ws(" ", *[(F.col("id") * 8 + k).cast("string") for k in range(8)]).alias("text"))
    c = Corpus.from_text(docs, "id", "text").stored()
    plans, write = [], A.written
    monkeypatch.setattr(A, "written", lambda df, name: (plans.append(plan(df)), write(df, name))[1])
    inputs = A.entities(spark.createDataFrame([("5",), ("8",), ("13",)], "id string"))
    assert sorted(r.id for r in A.scored(c, "rows", "WT_SMARTWA", inputs).collect()) == [0, 1]
    assert plans and not any("hashpartitioning(t#" in p or "hashpartitioning(id#" in p for p in plans)


def test_few_candidates_go_to_the_table_of_all_entities(spark, small_broadcasts):
    docs = spark.range(3000).select("id", F.concat_ws(" ", *[(F.col("id") * 8 + k).cast("string") for k in range(8)]).alias("text"))
    c = Corpus.from_text(docs, "id", "text").stored()
    found = A.scored(c, "cols", "WT_SMARTAW", A.entities(spark.createDataFrame([(5,), (8,)], "id long")))
    assert "hashpartitioning(id#" not in plan(found) and "SortMergeJoin" not in plan(found)
    assert sorted((int(r.id), r.tf_d, r.df) for r in found.collect()) == [(d * 8 + k, 1, 1) for d in (5, 8) for k in range(8)]


@pytest.mark.parametrize("name", ["crossref_wa", "cluster_hbc", "offset_window", "stage12_associate"])
def test_a_query_of_few_results_shuffles_no_table_of_all_entities(spark, small_broadcasts, monkeypatch, tmp_path, name):
    from wordloom.plans import queries

    words = [F.concat(F.lit("w"), F.col("doc_id") * 8 + k) for k in range(8)]
    texts = F.concat_ws(" ", *words, F.lit("de"), F.when(F.col("doc_id") % 3 == 0, "the the"), F.when(F.col("doc_id") % 50 == 3, "est and"))
    spark.range(3000).withColumnRenamed("id", "doc_id").select("doc_id", texts.alias("text"), F.lit("x").alias("lang"), F.lit("y").alias("source")).write.parquet(f"{tmp_path}/documents.parquet")
    plans, write = [], A.written
    monkeypatch.setattr(A, "written", lambda df, name: (plans.append(plan(df)) if name == "scored" else None, write(df, name))[1])
    assert queries.QUERIES[name](spark, str(tmp_path)).count() > 0
    assert len(plans) == 2 and not any("SortMergeJoin" in p or "hashpartitioning(id#" in p for p in plans)


def test_frequencies_of_frequent_and_rare_words(spark, monkeypatch):
    docs = spark.createDataFrame([(k, " ".join(f"w{j}" for j in range(1, 40) if k % j == 0) + " w1") for k in range(1, 80)], "id long, text string")
    c = Corpus.from_text(docs, "id", "text").stored()
    inputs = A.entities(spark.createDataFrame([("w2",), ("w3",)], "id string"))
    found = []
    for n in (1, 20, 10**9):
        monkeypatch.setattr(A, "FREQUENT", n)
        found.append([(r.id, round(r.score, 9)) for r in A.associate(c, "rows", "WT_COSINE_TFIDF", 30, inputs).orderBy("rank").collect()])
    assert len(found[0]) == 30 and found[0] == found[1] == found[2]


def test_a_file_is_parsed_in_pieces(spark, tmp_path, monkeypatch):
    import gzip

    from wordloom.sources import formats

    (tmp_path / "t").mkdir()
    text = "i\tb1\n" + "".join(f"{k}\t{'word ' * 30_000 if k == 7 else f'x{k}'}\n" for k in range(50))
    (tmp_path / "t" / "one.csv.gz").write_bytes(gzip.compress(text.encode("utf-16")))
    monkeypatch.setattr(formats, "PIECE", 10)
    assert [len(p) for p in formats._pieces(iter(["12345", "12345", "1"]))] == [2, 1]
    c = formats.corpus_from_lines(formats.tsv_lines(spark, f"{tmp_path}/t"))
    got = {r.name: (r.col, r.tf) for r in c.postings.join(c.rows, "row").collect()}
    assert got == {str(k): ("word", 30_000) if k == 7 else (f"x{k}", 1) for k in range(50)}


def test_large_files_are_cut_and_give_the_same_corpus(spark, monkeypatch):
    from wordloom.sources import formats

    lines = [("f", 0, "@title=x")] + [(f, k * 4 + j, t) for f in ("f", "g") for k in range(1, 60) for j, t in enumerate([f"i{f if k % 5 else 'same'}{k % 50}", "#title=t", f"b1a b{k} a", f"{k} b{k}"])]
    table = spark.createDataFrame(lines, "file string, line int, text string").repartition(5)

    def content():
        c = formats.corpus_from_lines(table)
        return sorted(c.postings.collect()), sorted((r.row, r.name, r.props["title"]) for r in c.rows.collect()), c.info.collect()

    whole = content()
    monkeypatch.setattr(formats, "FILE_LINES", 10)
    assert content() == whole
    first = {}
    for k, (f, at, t) in enumerate(lines):
        if t[0] == "i":
            first.setdefault(t[1:], (f, at))
    assert [r[1] for r in whole[1]] == sorted(first, key=first.get)
    assert ("same5" in first) and sum(p.tf for p in whole[0]) == sum(3 + (first[n][1] // 4) for n in first)


def test_first_words_are_cut_from_each_line(spark):
    from wordloom.sources import formats

    lines = spark.createDataFrame([("f", 0, "ia"), ("f", 1, "b1" + "x y " * 5), ("f", 2, "b1" + "z " * 1000)], "file string, line int, text string")
    found = formats.corpus_from_lines(lines, max_words=12).postings
    assert {r.col: r.tf for r in found.collect()} == {"x": 5, "y": 5, "z": 2}
    assert "slice(" in plan(found)


def test_names_are_quoted_as_json_does(spark):
    import json

    from wordloom.sources import formats

    names = ["a", "ß9", "𝒳", 'say "x"', "back\\slash", "tab\t", "\x01", "a/b", " ", ""]
    got = formats.vector_literal(spark.createDataFrame([(1, n, 2) for n in names], "query int, id string, tf long")).first().vector
    assert sorted(json.loads(got)) == sorted([n, 2] for n in names)
    found = formats._quoted(F.col("id"))
    plain = F.to_json(F.array("id"))
    assert spark.createDataFrame([(n,) for n in names], "id string").where(found != plain.substr(F.lit(2), F.length(plain) - 2)).count() == 0
