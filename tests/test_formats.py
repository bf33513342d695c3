import pytest
from pyspark.sql import functions as F

from wordloom.model import Corpus, Library
from wordloom.sources import formats

RECORDS = """﻿@title=small
@name=reserved
$ioptions=ignore-case
ia
#title=One
#title= more
#other=ignored
 x
3 x
2 y z
!ｆｕｌｌ
+ｖerb

ib
#body=Some text, some
b1text again
ia
 late
"""


def postings(c):
    return {(r.name, r.col): r.tf for r in c.postings.join(c.rows, "row").collect()}


def test_records(spark, tmp_path):
    (tmp_path / "r").write_text(RECORDS.replace("\n", "\r\n"))
    lines = formats.record_lines(spark, str(tmp_path / "r"))
    c = formats.corpus_from_lines(lines)
    assert postings(c) == {("a", "x"): 4, ("a", "y z"): 2, ("b", "some"): 2, ("b", "text"): 2, ("b", "again"): 1}
    assert {r.name: r.props for r in c.rows.collect()} == {"a": {"title": "One more"}, "b": {}}
    assert {(r.row, r.segid): r.text for r in c.segments.collect()} == {(1, 0): "full", (1, 1): "ｖerb", (2, 0): "Some text, some"}
    assert {r.key: r.value for r in c.info.collect()} == {"title": "small", "ioptions": "ignore-case"}
    assert {(r.n_segments, r.n_rows) for r in formats.segment_counts(c).collect()} == {(1, 1), (2, 1)}
    assert postings(formats.corpus_from_lines(lines, max_words=1))[("a", "x")] == 1
    assert [r.text for r in formats.sampled(lines, 2, 1).where("text like 'i%'").collect()] == ["ib"]


def test_malformed(spark, tmp_path):
    (tmp_path / "r").write_text("ia\nwhat is this\n")
    with pytest.raises(ValueError):
        formats.corpus_from_lines(formats.record_lines(spark, str(tmp_path / "r")))
    with pytest.raises(ValueError):
        formats.corpus_from_lines(formats.record_lines(spark, str(tmp_path / "r")), ("bad name",))


@pytest.mark.parametrize("encoding", ["utf-16", "utf-8"])
def test_table(spark, tmp_path, encoding):
    (tmp_path / "t").write_bytes('@title\tsmall\ni\t#title\t!\tb1\n a \t"One\n""two"""\t\tx y x\nb\t\tseg\t\n'.encode(encoding))
    c = formats.corpus_from_lines(formats.tsv_lines(spark, str(tmp_path / "t")))
    assert postings(c) == {("a", "x"): 2, ("a", "y"): 1}
    assert {r.name: r.props.get("title") for r in c.rows.collect()} == {"a": 'One "two"', "b": None}
    assert {(r.row, r.segid): r.text for r in c.segments.collect()} == {(1, 0): "", (2, 0): "seg"}


def test_feed(spark, tmp_path):
    (tmp_path / "x").write_text(
        '<e:envelope xmlns:e="urn:e" xmlns="urn:a"><e:meta type="title">T</e:meta><entry><id>a</id><title>One</title><link href="http://a"/>'
        '<e:data><vectors><vector count="3">w</vector><vector>v</vector></vectors><snippets><snippet>w text</snippet></snippets><e:fss>segment</e:fss></e:data></entry></e:envelope>'
    )
    c = formats.corpus_from_lines(formats.xml_lines(spark, str(tmp_path / "x")))
    assert postings(c) == {("a", "w"): 4, ("a", "v"): 1, ("a", "text"): 1}
    assert c.rows.first().props == {"title": "One", "link": "http://a"}


def test_vectors(spark):
    frame = spark.createDataFrame([(0, r'[["xyzzy",3],["xyzzy",5],["\"",1],["a\\b",8]]')], "query int, vector string")
    found = formats.parse_vectors(frame)
    assert {r.id: r.tf for r in found.collect()} == {"xyzzy": 8, '"': 1, "a\\b": 8}
    assert {r.id: r.tf for r in formats.parse_vectors(formats.vector_literal(found)).collect()} == {"xyzzy": 8, '"': 1, "a\\b": 8}


def test_library(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b"), (3, None)], "doc_id long, text string")
    c = Corpus.from_text(docs, "doc_id", "text")
    library = Library(spark, str(tmp_path))
    library.save("one", Corpus(c.postings, c.rows, c.segments, spark.createDataFrame([("index.key", "2")], "key string, value string")))
    library.save("two", Corpus(c.postings, c.rows, info=spark.createDataFrame([("index.key", "1")], "key string, value string")))
    assert library.open("one").stats == c.stats and library.open("two").segments is None
    assert [r.corpus for r in library.catalogue().collect()] == ["two", "one"]
    assert library.rename("two", "three") and library.drop("three") and not library.drop("three")
    for bad in ("", ".x", "a/b", "a b"):
        with pytest.raises(ValueError):
            library.open(bad)


def test_stream(spark, tmp_path):
    from wordloom.streaming.ingest import grown, ingest

    source = str(tmp_path / "in")
    docs = spark.createDataFrame([(i, f"word{i % 3} common") for i in range(10)], "doc_id long, text string")
    docs.where("doc_id < 6").write.parquet(source)
    run = lambda: ingest(spark.readStream.schema(docs.schema).parquet(source), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    run()
    docs.where("doc_id >= 4").write.mode("append").parquet(source)
    run()
    c = grown(spark, str(tmp_path / "out"))
    assert c.stats["n_rows"] == 10 and {r.id: r.df for r in c.col_dims.collect()}["common"] == 10
    assert c.rows.groupBy("row").count().where(F.col("count") > 1).count() == 0
