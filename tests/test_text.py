"""Folding: each option's rule on made-up words, built from the rule table, and the order of folded texts."""

import pytest
from pyspark.sql import functions as F

from wordloom.functions import text as T
from wordloom.functions.text import compare, fold, nfkc, parse_options, parse_segments, words

#: Around a rule's characters: nothing here is touched by any rule.
BEFORE, AFTER = "モ", "ネ"


def rules():
    """``(options, text, fold)``."""
    around = lambda x: f"{BEFORE}{x}{AFTER}"
    for option, pairs in T.JOINED.items():
        for pair, one in pairs.items():
            yield option, around(pair), around(one)
    for small, large in zip(T.SMALL_KANA, T.LARGE_KANA, strict=True):
        yield "collapse-qy", around(small), around(large)
    for dash in T.DASHES:
        yield "collapse-dash", around(dash), around("-")
    for counter in T.COUNTERS:
        yield "collapse-ka", around(counter), around("箇")
    for code in range(0x3041, 0x3095):
        yield "collapse-hirakata", chr(code), chr(code + 0x60)
    for kana in T.BEFORE_YA:
        yield "collapse-ay", around(kana + "ヤ"), around(kana + "ア")
    for kana in "サシスセソ":
        yield "collapse-kx", around("ク" + kana), around("キ" + kana)
    for small in "ュユ":
        yield "collapse-hf", around("フ" + small), around("ヒ" + small)
        yield "collapse-hf", around("ヴ" + small), around("ビ" + small)
    for a, b in ("ヂジ", "ヅズ"):
        yield "collapse-zdz", around(a), around(b)
    for space in " \t\n\r  　":
        yield "ignore-space", around(space), around("")
    for mark in "!/:;@[`{~¿‖‥※、】〔":
        yield "ignore-punct", around(mark), around("")
    for lower in "amzｋｚ":
        yield "ignore-case", around(lower), around(lower.upper())
    # What the rules leave alone: the same characters with other neighbours, letters outside the ranges, several options at once.
    for option, text in (("collapse-ay", "カヤ"), ("collapse-kx", "クタ"), ("collapse-hf", "フモ"), ("collapse-bv", "ヴモ"), ("ignore-case", "éß"), ("collapse-qy", "ァィ"), ("collapse-hirakata", "ゝ"), ("collapse-zdz", "ぢ"), ("ignore-space", "_"), ("ignore-punct", "モー")):
        yield option, text, text
    yield "collapse-hirakata,collapse-qy", "ゃモっ", "ヤモツ"
    yield "collapse-hirakata,collapse-bv", "ゔぁモ", "バモ"
    yield "ignore-space,ignore-case,ignore-punct", "n o, n!o", "NONO"
    yield "collapse-qy,collapse-ay", "ニャモ", "ニアモ"
    yield "", "n O ヂ-", "n O ヂ-"


def test_folding(spark):
    by_options = {}
    for options, text, want in rules():
        by_options.setdefault(options, []).append((text, want))
    assert sum(map(len, by_options.values())) > 150
    wrong = []
    for options, own in by_options.items():
        frame = spark.createDataFrame(own, "a string, b string")
        wrong += [(options, *r) for r in frame.where(fold(F.col("a"), options) != F.col("b")).collect()]
        if options:
            apart = frame.where("a <> b").where((compare(F.col("a"), F.col("b"), options) != 0) | (compare(F.col("a"), F.col("b"), "") == 0))
            wrong += [(options, *r) for r in apart.collect()]
    assert not wrong


def test_order_of_folds(spark):
    frame = spark.createDataFrame([("n", "o", -1, -1), ("o", "N", 1, 1), ("n", "N", 1, 0), ("モ", "ヒ", 1, 1), ("", "n", -1, -1), ("no", "n", 1, 1), ("o", "P", 1, -1)], "a string, b string, plain int, folded int")
    found = frame.select(compare(F.col("a"), F.col("b"), ""), "plain", compare(F.col("a"), F.col("b"), "ignore-case"), "folded").collect()
    assert all(r[0] == r[1] and r[2] == r[3] for r in found)


def test_lists():
    assert parse_options("Ignore-Case, word-boundary") == {"ignore-case", "word-boundary"}
    assert parse_segments("0,2-4") == (0, 2, 3, 4) and len(parse_segments(None)) == 32
    for bad in ("32", "4-2"):
        with pytest.raises(ValueError):
            parse_segments(bad)
    with pytest.raises(ValueError):
        parse_options("no-such")


def test_words_and_normal_form(spark):
    frame = spark.createDataFrame([("The Été, 2nd  ﬁne",), (None,), ("",)], "t string")
    assert [r[0] for r in frame.select(words(F.col("t"))).collect()] == [["the", "été", "2nd", "ﬁne"], [], []]
    assert [r[0] for r in frame.select(nfkc("t")).collect()] == ["The Été, 2nd  fine", None, ""]
