"""Tokens, normal forms and folding of text, as Spark columns.

Folding is a chain of Spark's own string functions. Each option rewrites a few characters, some of them
depending on the neighbour; two texts are alike under some options if their folds are equal.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words are runs of letters and digits, in lower case.
WORD_BREAK = "[^\\p{L}\\p{N}]+"

# What the folding options ignore, replace and join.
IGNORE_SPACE = "[\\t\\n\\r \\u00a0\\u2000-\\u200a\\u202f\\u205f\\u3000]"
IGNORE_PUNCT = "[!-/:-@\\[-`{-~\\u00a1-\\u00bf\\u2016-\\u2027\\u2030-\\u2057\\u3001-\\u3011\\u3014-\\u3020]"
DASHES = "­‐‑‒–—―−ー－"
SMALL_KANA, LARGE_KANA = "ッャュョっゃゅょ", "ツヤユヨつやゆよ"
COUNTERS = "个ヶヵ"
#: Two characters become one.
JOINED = {
    "collapse-bv": {"ヴァ": "バ", "ヴィ": "ビ", "ヴェ": "ベ", "ヴォ": "ボ"},
    "collapse-tts": {"ツィ": "チ", "ティ": "チ", "ディ": "ジ"},
    "collapse-ssh": {"シェ": "セ", "ジェ": "ゼ"},
}
#: Kana after which ya becomes a.
BEFORE_YA = "イキギシジチヂニヒビピミリヰ"

OPTIONS = {
    "match-head", "match-tail", "ignore-case", "ignore-space", "ignore-punct", "collapse-hirakata", "collapse-qy", "collapse-zdz", "collapse-bv",
    "collapse-tts", "collapse-ssh", "collapse-hf", "collapse-kx", "collapse-ay", "collapse-dash", "collapse-ka",
    "word-boundary", "collapse-noma", "collapse-kanji-variant", "collapse-kana-variant", "collapse-ps-mark", "collapse-eshk",
}


def parse_options(names: str | None) -> frozenset[str]:
    """A comma list of option names, in any case. Unknown names are an error; some known ones have no effect."""
    found = frozenset(x.strip().lower() for x in (names or "").split(",") if x.strip())
    if unknown := found - OPTIONS:
        raise ValueError(f"unknown options: {', '.join(sorted(unknown))}")
    return found


def parse_segments(ranges: str | None) -> tuple[int, ...]:
    """Segment numbers of a list like ``0,2-4``; none means all 32. Above 31 and backwards are errors."""
    if not ranges:
        return tuple(range(32))
    found: set[int] = set()
    for part in ranges.split(","):
        low, _, high = part.partition("-")
        first, last = int(low), int(high or low)
        if not 0 <= first <= last <= 31:
            raise ValueError(f"bad segments: {part}")
        found.update(range(first, last + 1))
    return tuple(sorted(found))


def words(text: Column) -> Column:
    """Array of the words of a text; null gives none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_BREAK), lambda w: w != "")


def counted(texts: DataFrame, found: Column, *keep: str) -> DataFrame:
    """The columns ``keep`` with ``col`` and ``tf``: of an array of words each word once, and how often it occurs there. Nothing is shuffled.

    Words are put in order, so that equal ones stand together, and cut where a new one begins. Both arrays are columns of their own; within the
    lambdas they would be made anew for each element.
    """
    out = texts.select(*keep, F.sort_array(found).alias("__words"))
    begins = F.filter(F.transform("__words", lambda w, i: F.when((i == 0) | (w != F.get("__words", i - 1)), i)), lambda i: i.isNotNull())
    out = out.withColumn("__begins", begins)
    pair = lambda a, k: F.struct(F.get("__words", a).alias("col"), (F.coalesce(F.get("__begins", k + 1), F.size("__words")) - a).cast("long").alias("tf"))
    return out.select(*keep, F.inline(F.transform("__begins", pair)).alias("col", "tf"))


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility composition, for which Spark has no function."""
    return text.map(lambda s: s if s is None else unicodedata.normalize("NFKC", s))


def _range(first: int, last: int) -> str:
    return "".join(map(chr, range(first, last + 1)))


def fold(text: Column, options: str | frozenset[str] | None) -> Column:
    """The text as it compares under the options. Null stays null."""
    on = parse_options(options) if not isinstance(options, frozenset) else options
    out = text
    if "collapse-hirakata" in on:
        out = F.translate(out, _range(0x3041, 0x3094), _range(0x30A1, 0x30F4))
    if "collapse-qy" in on:
        out = F.translate(out, SMALL_KANA, LARGE_KANA)
    if "ignore-space" in on:
        out = F.regexp_replace(out, IGNORE_SPACE, "")
    if "ignore-punct" in on:
        out = F.regexp_replace(out, IGNORE_PUNCT, "")
    for option, pairs in JOINED.items():
        if option in on:
            for pair, one in pairs.items():
                out = F.replace(out, F.lit(pair), F.lit(one))
    if "collapse-hf" in on:
        out = F.regexp_replace(F.regexp_replace(out, "フ(?=[ュユ])", "ヒ"), "ヴ(?=[ュユ])", "ビ")
    elif "collapse-qy" in on:
        out = F.regexp_replace(F.regexp_replace(out, "フ(?=ユ)", "ヒ"), "ヴ(?=ユ)", "ビ")
    if "collapse-kx" in on:
        out = F.regexp_replace(out, "ク(?=[サシスセソ])", "キ")
    if "collapse-ay" in on:
        out = F.regexp_replace(out, f"(?<=[{BEFORE_YA}])ヤ", "ア")
    if "collapse-zdz" in on:
        out = F.translate(out, "ヂヅ", "ジズ")
    if "collapse-dash" in on:
        out = F.translate(out, DASHES, "-" * len(DASHES))
    if "collapse-ka" in on:
        out = F.translate(out, COUNTERS, "箇" * len(COUNTERS))
    if "ignore-case" in on:  # ASCII and full-width letters only
        out = F.translate(out, _range(0x61, 0x7A) + _range(0xFF41, 0xFF5A), _range(0x41, 0x5A) + _range(0xFF21, 0xFF3A))
    return out


def compare(a: Column, b: Column, options: str | None) -> Column:
    """-1, 0 or 1: the order of the folds by code point."""
    x, y = fold(a, options), fold(b, options)
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def matches(text: Column, pattern: str, options: str | frozenset[str] | None) -> Column:
    """The folded text contains the folded pattern: at its start with ``match-head``, at its end with ``match-tail``."""
    on = parse_options(options) if not isinstance(options, frozenset) else options
    where, what = fold(text, on), fold(F.lit(pattern), on)
    if {"match-head", "match-tail"} <= on:
        return where == what
    if "match-head" in on:
        return F.startswith(where, what)
    return F.endswith(where, what) if "match-tail" in on else F.contains(where, what)
