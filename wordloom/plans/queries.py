"""One query for each operator, over the whole test tables, with the SQL that gives the same rows.

Scores are published with six digits, as sums of doubles differ in their last bits with the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.presence import EVERY, NONE, has
from ..functions.similarity import EXPRESSIONS, expression, with_functions
from ..functions.text import compare, fold
from ..model import Corpus, Library
from ..operators import associate as A
from ..operators import cluster, matrix
from ..operators.fulltext import Join, Pattern, Search, difference, intersection, union
from ..sources import formats
from ..tables import dealt, shared_path, written
from . import sql
from .sql import SHOWN, scored, terms, with_

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def corpus(spark: SparkSession, d: str, name: str, where: str = "true") -> Corpus:
    """Matrices as in :data:`sql.COUNTS`, stored, so that a query's several plans don't count words again."""
    if name == "documents":
        return Corpus.from_text(table(spark, d, name).where(where), "doc_id", "text", ("lang", "source")).stored()
    if name == "conversations":
        found = Corpus.from_text(table(spark, d, name), "conv_id", "text")
        return Corpus(found.postings, found.rows.dropDuplicates(["row"])).stored()
    lines = table(spark, d, "events" if name == "events" else "lineitem")
    about = lines.count()  # from the footers of its files
    if name == "events":
        pairs = lines.select(F.col("user_id").alias("row"), F.col("event_type").alias("col"))
    elif name == "orders":
        pairs = lines.select(F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("col"))
    else:
        orders, lines = table(spark, d, "orders").select("o_orderkey", "o_custkey"), lines.select("l_orderkey", "l_partkey")
        both = dealt(orders, about, "o_orderkey").join(dealt(lines, about, "l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))
        pairs = both.select(F.col("o_custkey").alias("row"), F.col("l_partkey").alias("col"))
    return Corpus.from_counts(pairs.withColumn("tf", F.lit(1).cast("long")), about=about).stored()


def listed(spark: SparkSession, values: list, tf_q: dict | None = None, weight: dict | None = None, cutoff: int | None = None) -> DataFrame:
    kind = "string" if isinstance(values[0], str) else "long"
    return A.entities(spark.createDataFrame([(v, (tf_q or {}).get(v, 1), (weight or {}).get(v, 1.0), cutoff) for v in values], f"id {kind}, tf_q long, weight double, cutoff long"))


def shown(found: DataFrame) -> DataFrame:
    return found.select("id", F.round("score", 6).alias("score"), "tf_d", "df_d", "total", "rank")


WORDS, TF_Q, WEIGHT = ["the", "and", "est", "de"], {"the": 2, "est": 3}, {"the": 0.5, "and": 1.25, "est": 2.0}
ITEMS = [1, 2, 3, 5, 8]
DOCS = [3, 4, 7, 11, 42]


def _add_similarities() -> None:
    for key, kind in (("smartwa_words_to_docs", "WT_SMARTWA"), ("smart", "WT_SMART"), ("cosine", "WT_COSINE"), ("dot", "WT_DOT_PRODUCT"), ("cosine_tfidf", "WT_COSINE_TFIDF"), ("dot_tfidf", "WT_DOT_PRODUCT_TFIDF"), ("bm25", "WT_Okapi_BM25")):
        oracle = with_(sql.matrix("documents"), scored("s", kind, "rows", terms(WORDS, TF_Q, WEIGHT))) + f" SELECT {SHOWN} FROM s"
        query(f"assoc_{key}", oracle)(lambda spark, d, kind=kind: shown(A.associate(corpus(spark, d, "documents"), "rows", kind, 10, listed(spark, WORDS, TF_Q, WEIGHT))))
    oracle = with_(sql.matrix("documents"), scored("s", "WT_SMARTAW", "cols", terms(DOCS), k=20)) + f" SELECT {SHOWN} FROM s"
    query("assoc_smartaw_docs_to_words", oracle)(lambda spark, d: shown(A.associate(corpus(spark, d, "documents"), "cols", "WT_SMARTAW", 20, listed(spark, DOCS))))
    oracle = with_(sql.matrix("orders"), scored("s", "WT_DOT_PRODUCT", "rows", terms(ITEMS, {1: 2, 8: 4}), k=50)) + f" SELECT {SHOWN} FROM s"
    query("assoc_dot_orders", oracle)(lambda spark, d: shown(A.associate(corpus(spark, d, "orders"), "rows", "WT_DOT_PRODUCT", 50, listed(spark, ITEMS, {1: 2, 8: 4}))))
    oracle = with_(sql.matrix("events"), scored("s", "WT_DOT_PRODUCT", "rows", "SELECT 0 AS qy, id AS t, 1 AS tfq, 1.0 AS w, NULL::BIGINT AS cut FROM cd", k=30)) + f" SELECT {SHOWN} FROM s"

    @query("assoc_ties", oracle)
    def _(spark, d):
        c = corpus(spark, d, "events")
        return shown(A.associate(c, "rows", "WT_DOT_PRODUCT", 30, A.entities(c.col_dims.select("id"))))

    for key in ("tf", "tfidf", "hits"):
        oracle = with_(sql.matrix("documents"), scored("s", key, "rows", terms(WORDS, TF_Q))) + f" SELECT {SHOWN} FROM s"
        query(f"expr_{key}", oracle)(lambda spark, d, key=key: shown(A.associate(corpus(spark, d, "documents"), "rows", expression(*EXPRESSIONS[key]), 10, listed(spark, WORDS, TF_Q))))
    for key, kind in (("smartwa", "WT_SMARTWA"), ("smart", "WT_SMART")):
        oracle = with_(sql.matrix("documents"), scored("s", kind, "rows", terms(WORDS, TF_Q, WEIGHT))) + f" SELECT {SHOWN} FROM s"
        query(f"expr_{key}", oracle)(lambda spark, d, key=key: shown(A.associate(corpus(spark, d, "documents"), "rows", expression(*EXPRESSIONS[key]), 10, listed(spark, WORDS, TF_Q, WEIGHT))))
    oracle = with_(sql.matrix("documents"), scored("s", "WT_SMARTAW", "cols", terms(DOCS))) + f" SELECT {SHOWN} FROM s"
    query("expr_smartaw", oracle)(lambda spark, d: shown(A.associate(corpus(spark, d, "documents"), "cols", expression(*EXPRESSIONS["smartaw"]), 10, listed(spark, DOCS))))
    oracle = with_(sql.matrix("documents"), scored("s", "custom", "rows", terms(WORDS, TF_Q))) + f" SELECT {SHOWN} FROM s"
    query("expr_custom", oracle)(lambda spark, d: shown(A.associate(corpus(spark, d, "documents"), "rows", expression("tf / (tf + 1) * idf", "df_d / nq"), 10, listed(spark, WORDS, TF_Q))))


_add_similarities()


# Dimensions and layout


@query("corpus_stats", with_(sql.matrix("documents")) + " SELECT rows_::BIGINT AS n_rows, cols_::BIGINT AS n_cols, tdf::BIGINT AS total_df, ttf::BIGINT AS total_tf, (SELECT max(df) FROM rd) AS max_df_row, (SELECT max(tf) FROM rd) AS max_tf_row, (SELECT max(df) FROM cd) AS max_df_col, (SELECT max(tf) FROM cd) AS max_tf_col FROM st")
def _(spark, d):
    return spark.createDataFrame([corpus(spark, d, "documents").stats]).select("n_rows", "n_cols", "total_df", "total_tf", "max_df_row", "max_tf_row", "max_df_col", "max_tf_col")


@query("row_dims", with_(sql.matrix("documents")) + " SELECT id, df, tf AS tf_sum FROM rd")
def _(spark, d):
    return corpus(spark, d, "documents").row_dims


@query("col_dims", with_(sql.matrix("documents")) + " SELECT id, df, tf AS tf_sum FROM cd")
def _(spark, d):
    return corpus(spark, d, "documents").col_dims


@query("transpose_col_vectors", with_(sql.matrix("orders")) + " SELECT c AS col, string_agg(r || ':' || tf, ',' ORDER BY r) AS vector FROM p GROUP BY c")
def _(spark, d):
    pairs = F.transform(F.sort_array(F.collect_list(F.struct("row", "tf"))), lambda x: F.concat(x["row"].cast("string"), F.lit(":"), x["tf"].cast("string")))
    return corpus(spark, d, "orders").postings.groupBy("col").agg(F.array_join(pairs, ",").alias("vector"))


@query("dup_word_sum", "SELECT l_orderkey AS row, l_partkey AS col, sum(l_linenumber)::BIGINT AS tf FROM lineitem GROUP BY 1, 2")
def _(spark, d):
    return Corpus.from_counts(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("col"), F.col("l_linenumber").alias("tf"))).postings


def as_lines(docs: DataFrame, *texts: F.Column) -> DataFrame:
    """Record lines of one file: for each document, in the order of ids, these texts."""
    parts = F.array(*[F.struct(F.struct("doc_id", F.lit(k).alias("part")).alias("line"), t.alias("text")) for k, t in enumerate(texts)])
    return docs.select(F.explode(parts).alias("x")).select(F.lit("one").alias("file"), "x.line", "x.text")


@query("first_doc_wins", "SELECT source AS name, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def _(spark, d):
    lines = as_lines(table(spark, d, "documents"), F.concat(F.lit("i"), "source"), F.concat(F.lit("#title="), F.col("doc_id").cast("string")))
    return formats.corpus_from_lines(lines).rows.select("name", F.col("props")["title"].cast("long").alias("doc_id"))


@query("append_corpus", with_(sql.matrix("documents")) + " SELECT id, df, tf AS tf_sum FROM cd")
def _(spark, d):
    first, rest = corpus(spark, d, "documents", "doc_id < 700"), corpus(spark, d, "documents", "doc_id >= 300")
    return first.appended(rest).col_dims


@query("delete_docs", with_(sql.matrix("documents", where="r NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")) + " SELECT id, df, tf AS tf_sum FROM cd")
def _(spark, d):
    return corpus(spark, d, "documents").deleted(table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("name"))).col_dims


@query("masked_vectors", with_(sql.matrix("documents", where="r IN (SELECT doc_id FROM labels WHERE quality = 1)")) + " SELECT c AS id, count(*) AS df, sum(tf)::BIGINT AS tf_sum FROM p GROUP BY 1")
def _(spark, d):
    return corpus(spark, d, "documents").masked(include=table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("row"))).postings.groupBy(F.col("col").alias("id")).agg(F.count("*").alias("df"), F.sum("tf").alias("tf_sum"))


@query("truncated_vectors", f"SELECT doc_id AS row, c AS col, count(*) AS tf FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '{sql.BREAK}'), lambda w: w <> '')[1:20]) AS c FROM documents) GROUP BY 1, 2")
def _(spark, d):
    lines = as_lines(table(spark, d, "documents"), F.concat(F.lit("i"), F.col("doc_id").cast("string")), F.concat(F.lit("b1"), F.regexp_replace(F.coalesce("text", F.lit("")), r"[\r\n]", " ")))
    found = formats.corpus_from_lines(lines, max_words=20)
    return found.postings.join(found.rows.select("row", "name"), "row").select(F.col("name").cast("long").alias("row"), "col", "tf")


# Filters

_DOC_FILTERS = {
    "bool_and": (has("est") & has("de"), "g.id IN (SELECT r FROM p WHERE c = 'est') AND g.id IN (SELECT r FROM p WHERE c = 'de')"),
    "bool_or_not": (has("est") | ~has("and"), "g.id IN (SELECT r FROM p WHERE c = 'est') OR g.id NOT IN (SELECT r FROM p WHERE c = 'and')"),
    "bool_unknown_word": (~has("no such word") & ~(has("est") & has("no such word")), "TRUE"),
    "bool_true": (EVERY, "TRUE"),
    "bool_false": (NONE, "FALSE"),
}


def _add_filters() -> None:
    for key, (having, where) in _DOC_FILTERS.items():
        oracle = with_(sql.matrix("documents"), scored("s", "WT_SMART", "rows", terms(WORDS, TF_Q), where, k=20)) + f" SELECT {SHOWN} FROM s"
        query(key, oracle)(lambda spark, d, having=having: shown(A.associate(corpus(spark, d, "documents"), "rows", "WT_SMART", 20, listed(spark, WORDS, TF_Q), filters=A.Filters(having=having))))
    good, bad = "SELECT doc_id FROM labels WHERE quality = 1", "SELECT doc_id FROM labels WHERE toxic = 1"
    for key, where, include, exclude in (("mask_positive", f"g.id IN ({good})", True, False), ("mask_negative", f"g.id NOT IN ({bad})", False, True), ("mask_either", f"g.id IN ({good}) OR g.id NOT IN ({bad})", True, True)):
        oracle = with_(sql.matrix("documents"), scored("s", "WT_SMART", "rows", terms(WORDS, TF_Q), where, k=20)) + f" SELECT {SHOWN} FROM s"

        def run(spark, d, include=include, exclude=exclude):
            labels = table(spark, d, "labels").withColumnRenamed("doc_id", "id")
            own = A.Filters(include=labels.where("quality = 1") if include else None, exclude=labels.where("toxic = 1") if exclude else None)
            return shown(A.associate(corpus(spark, d, "documents"), "rows", "WT_SMART", 20, listed(spark, WORDS, TF_Q), filters=own))

        query(key, oracle)(run)
    oracle = with_(sql.matrix("documents"), scored("s", "WT_SMART", "rows", terms(WORDS, TF_Q), "x.tf > 100 AND g.df_d >= 2", k=20)) + f" SELECT {SHOWN} FROM s"
    query("predicate_filter", oracle)(lambda spark, d: shown(A.associate(corpus(spark, d, "documents"), "rows", "WT_SMART", 20, listed(spark, WORDS, TF_Q), filters=A.Filters(predicate=F.expr("tf_sum > 100 and df_d >= 2")))))
    cut = terms(DOCS, cut="(SELECT CASE WHEN rows_ <= 10000 THEN rows_ ELSE 0.125 ** (log10(rows_) - 4) * rows_ END::BIGINT FROM st)")
    oracle = with_(sql.matrix("documents"), scored("s", "WT_SMARTAW", "cols", cut, k=30)) + f" SELECT {SHOWN} FROM s"

    @query("cutoff_default", oracle)
    def _(spark, d):
        return shown(A.summary(corpus(spark, d, "documents"), listed(spark, DOCS), k=30))

    limits = {v: n for v, n in zip(DOCS, (50, 20, 200, 10, 100), strict=True)}
    cases = "CASE t " + " ".join(f"WHEN {v} THEN {n}" for v, n in limits.items()) + " END"
    oracle = with_(sql.matrix("documents"), scored("s", "WT_SMARTAW", "cols", terms(DOCS, cut=cases), k=30)) + f" SELECT {SHOWN} FROM s"

    @query("cutoff_per_input", oracle)
    def _(spark, d):
        own = A.entities(spark.createDataFrame(list(limits.items()), "id long, cutoff long"))
        return shown(A.associate(corpus(spark, d, "documents"), "cols", "WT_SMARTAW", 30, own))

    oracle = with_(sql.matrix("documents"), scored("s", "WT_SMARTAW", "cols", terms(DOCS, cut="0"), k=30)) + f" SELECT {SHOWN} FROM s"
    query("cutoff_zero_keeps", oracle)(lambda spark, d: shown(A.associate(corpus(spark, d, "documents"), "cols", "WT_SMARTAW", 30, listed(spark, DOCS, cutoff=0))))


_add_filters()


# Full text

_FIND = {
    "fss_contains": (Search((Join((Pattern("the"),)),)), "contains(text, 'the')"),
    "fss_join_pp": (Search((Join((Pattern("the"), Pattern("ing"))),)), "contains(text, 'the') AND contains(text, 'ing')"),
    "fss_join_pn": (Search((Join((Pattern("the"),), (Pattern("ing"),)),)), "contains(text, 'the') AND NOT contains(text, 'ing')"),
    "fss_union": (Search((Join((Pattern("est"),)), Join((Pattern("the"),), (Pattern("and"),)), Join((), (Pattern("de"),)))), "contains(text, 'est') OR contains(text, 'the') AND NOT contains(text, 'and')"),
    "fss_ignore_case": (Search((Join((Pattern("THE OR"),)),), "ignore-case"), "contains(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), 'THE OR')"),
    "fss_ignore_space": (Search((Join((Pattern("theor"),)),), "ignore-space"), r"contains(regexp_replace(text, '[\t\n\r \x{a0}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]', '', 'g'), 'theor')"),
    "fss_ignore_punct": (Search((Join((Pattern("the and"),)),), "ignore-punct"), r"contains(regexp_replace(text, '[!-/:-@\[-`{-~\x{a1}-\x{bf}\x{2016}-\x{2027}\x{2030}-\x{2057}\x{3001}-\x{3011}\x{3014}-\x{3020}]', '', 'g'), 'the and')"),
    "fss_match_head": (Search((Join((Pattern("the"),)),), "match-head,ignore-case"), "starts_with(lower(text), 'the')"),
    "fss_match_tail": (Search((Join((Pattern("ing."), Pattern("THE", "ignore-case"))),), "match-tail"), "ends_with(text, 'ing.') AND contains(lower(text), 'the')"),
    "fss_index_options": (Search((Join((Pattern("The"),)),), "ignore-case", index_options="ignore-space"), "contains(lower(text), 'the') AND contains(replace(text, ' ', ''), 'The')"),
}


def _add_fulltext() -> None:
    for key, (search, where) in _FIND.items():
        query(key, f"SELECT doc_id AS id, 1.0::DOUBLE AS score, count(*) OVER () AS total FROM documents WHERE {where}")(lambda spark, d, search=search: search.run(corpus(spark, d, "documents")).select("id", "score", "total"))
    chosen = "SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) - 1 AS x, count(*) OVER () AS m FROM documents WHERE contains(text, 'the')"
    t = "greatest(0, ceil((2 * 25 * (x + {}) - m) / (2 * m)))"
    oracle = f"SELECT id FROM ({chosen}) WHERE m <= 25 OR {t.format(1)} > {t.format(0)}"
    query("fss_downsample", oracle)(lambda spark, d: Search((Join((Pattern("the"),)),)).run(corpus(spark, d, "documents"), 25, True).select("id"))
    query("fss_limit", "SELECT doc_id AS id FROM documents WHERE contains(text, 'the') ORDER BY doc_id LIMIT 25")(lambda spark, d: Search((Join((Pattern("the"),)),)).run(corpus(spark, d, "documents"), 25).select("id"))
    query("fss_nfkc", "SELECT doc_id AS id, 1.0::DOUBLE AS score, count(*) OVER () AS total FROM documents WHERE contains(text, 'the ')")(lambda spark, d: Search((Join((Pattern("ｔｈｅ　"),)),)).run(corpus(spark, d, "documents")).select("id", "score", "total"))
    oracle = """SELECT doc_id AS id, 0 AS segid, (sum(octet_length(encode(piece)) + 3) OVER (PARTITION BY doc_id ORDER BY k) - 3)::BIGINT AS disp
FROM (SELECT doc_id, unnest(string_split(text, 'the')) AS piece, generate_subscripts(string_split(text, 'the'), 1) AS k FROM documents) QUALIFY k < count(*) OVER (PARTITION BY doc_id)"""
    query("fss_positions", oracle)(lambda spark, d: Search(()).all_places(corpus(spark, d, "documents"), Pattern("the")).withColumn("disp", F.col("disp").cast("long")))
    query("fss_places", "SELECT doc_id AS id, 0 AS segid, (octet_length(encode(substr(text, 1, strpos(text, 'the') - 1))))::BIGINT AS disp FROM documents WHERE contains(text, 'the')")(lambda spark, d: Search(()).places(corpus(spark, d, "documents"), Pattern("the")).withColumn("disp", F.col("disp").cast("long")))
    where = "(g.id IN (SELECT doc_id FROM documents WHERE contains(text, 'est')) OR g.id NOT IN (SELECT doc_id FROM documents WHERE contains(text, 'ing') OR contains(text, 'ung')))"
    oracle = with_(sql.matrix("documents"), scored("s", "WT_SMART", "rows", terms(WORDS, TF_Q), where, k=20)) + f" SELECT {SHOWN} FROM s"

    @query("fss_filter_assoc", oracle)
    def _(spark, d):
        c = corpus(spark, d, "documents")
        search = Search((Join((Pattern("est"),)), Join((), (Pattern("ing"), Pattern("ung")))))
        return shown(A.associate(c, "rows", "WT_SMART", 20, listed(spark, WORDS, TF_Q), filters=search.filters(c)))

    sets = {"ids_intersection": (intersection, "INTERSECT"), "ids_difference": (difference, "EXCEPT"), "ids_union": (union, "UNION")}
    for key, (f, word) in sets.items():
        oracle = f"SELECT doc_id AS id FROM labels WHERE quality = 1 {word} SELECT doc_id FROM labels WHERE toxic = 1"
        query(key, oracle)(lambda spark, d, f=f: f(*(table(spark, d, "labels").where(w).select(F.col("doc_id").alias("id")) for w in ("quality = 1", "toxic = 1"))).select("id"))
    query("segment_fetch", "SELECT doc_id AS id, doc_id::VARCHAR AS name, coalesce(text, '') AS \"fss.0\", coalesce(lang, '') AS lang, '' AS nothing FROM documents")(lambda spark, d: (lambda c: A.properties(c, c.rows.select(F.col("row").alias("id")), ("fss.0", "lang", "nothing")))(corpus(spark, d, "documents")))


_add_fulltext()

#: Made-up words: two texts, and options under which they may be alike.
KANA = [
    ("モヂネ", "モジネ", "collapse-zdz"), ("ヴェモノ", "ベモノ", "collapse-bv"), ("ディネモ", "ジネモ", "collapse-tts"), ("モシェネ", "モセネ", "collapse-ssh"), ("ヴュモ", "ビュモ", "collapse-hf"), ("フュネ", "ヒネ", "collapse-hf"),
    ("ネクスモ", "ネキスモ", "collapse-kx"), ("ネクタモ", "ネキタモ", "collapse-kx"), ("三个", "三箇", "collapse-ka"), ("モニャ", "モニア", "collapse-qy,collapse-ay"), ("もっと", "モツト", "collapse-qy,collapse-hirakata"), ("n  o", " n p", "ignore-space"),
]
_FOLDED = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, '{o}' AS options, CASE WHEN encode({sql.folded(f"'{a}'", o)}) < encode({sql.folded(f"'{b}'", o)}) THEN -1 WHEN encode({sql.folded(f"'{a}'", o)}) > encode({sql.folded(f"'{b}'", o)}) THEN 1 ELSE 0 END AS sign, {sql.folded(f"'{a}'", o)} AS folded"
    for a, b, o in KANA
)


@query("fss_fold_kana", _FOLDED)
def _(spark, d):
    out = None
    for a, b, options in KANA:
        row = spark.createDataFrame([(a, b, options)], "a string, b string, options string").withColumn("sign", compare(F.col("a"), F.col("b"), options)).withColumn("folded", fold(F.col("a"), options))
        out = row if out is None else out.unionByName(row)
    return out


# Stages and compositions

_CUT = "(SELECT CASE WHEN rows_ <= 10000 THEN rows_ ELSE 0.125 ** (log10(rows_) - 4) * rows_ END::BIGINT FROM st)"
_STAGE1 = scored("s1", "WT_SMARTAW", "cols", terms(DOCS, cut=_CUT), k=70)
_STAGE2 = scored("s2", "WT_SMARTWA", "rows", "SELECT qy, id AS t, tf_d AS tfq, score AS w, NULL::BIGINT AS cut FROM s1", k=20)
_STAGE3 = scored("s3", "WT_SMARTAW", "cols", "SELECT qy, id AS t, 1 AS tfq, 1.0 AS w, NULL::BIGINT AS cut FROM s2 WHERE rank <= 10", k=25)


@query("stage1_summary", with_(sql.matrix("documents"), _STAGE1) + f" SELECT {SHOWN} FROM s1")
def _(spark, d):
    return shown(A.Request(stage=1).run(corpus(spark, d, "documents"), listed(spark, DOCS))["summary"])


@query("stage12_associate", with_(sql.matrix("documents"), _STAGE1, _STAGE2) + f" SELECT {SHOWN} FROM s2")
def _(spark, d):
    return shown(A.Request(n_rows=20).run(corpus(spark, d, "documents"), listed(spark, DOCS))["rows"])


@query("stage123_topic_words", with_(sql.matrix("documents"), _STAGE1, _STAGE2, _STAGE3) + f" SELECT {SHOWN} FROM s3")
def _(spark, d):
    return shown(A.Request(n_rows=20, n_cols=25).run(corpus(spark, d, "documents"), listed(spark, DOCS))["cols"])


@query("offset_window", with_(sql.matrix("documents"), _STAGE1, _STAGE2) + f" SELECT {SHOWN} FROM s2 WHERE rank > 5 AND rank <= 12")
def _(spark, d):
    return shown(A.Request(n_rows=7, offset=5).run(corpus(spark, d, "documents"), listed(spark, DOCS))["rows"])


_GIVEN = "SELECT 0 AS qy, t, tfq, w::DOUBLE AS w, NULL::BIGINT AS cut FROM (VALUES ('the', 2, 0.5), ('est', 3, 2.0), ('de', 1, 1.0)) v(t, tfq, w)"


@query("stage2_given_summary", with_(sql.matrix("documents"), scored("s", "WT_SMARTWA", "rows", _GIVEN, k=15)) + f" SELECT {SHOWN} FROM s")
def _(spark, d):
    given = spark.createDataFrame([(0, "the", 2, 0.5), (0, "est", 3, 2.0), (0, "de", 1, 1.0)], "query int, id string, tf_d long, score double")
    return shown(A.Request(n_rows=15, stage=2).run(corpus(spark, d, "documents"), summary_given=given)["rows"])


@query("search_topic_words", with_(sql.matrix("documents"), scored("s", "WT_SMARTAW", "cols", "SELECT 0 AS qy, doc_id AS t, 1 AS tfq, 1.0 AS w, NULL::BIGINT AS cut FROM documents WHERE contains(text, 'the') QUALIFY row_number() OVER (ORDER BY doc_id) <= 10", k=20)) + f" SELECT {SHOWN} FROM s")
def _(spark, d):
    c = corpus(spark, d, "documents")
    return shown(A.Request(n_rows=10, n_cols=20).run(c, found=Search((Join((Pattern("the"),)),)).run(c).drop("total"))["cols"])


@query("label_words", with_(sql.matrix("documents"), scored("s", "WT_SMART", "cols", "SELECT r % 3 AS qy, r AS t, 1 AS tfq, 1.0 AS w, NULL::BIGINT AS cut FROM ar WHERE r < 60", k=12)) + f" SELECT qy AS cluster, {SHOWN} FROM s")
def _(spark, d):
    c = corpus(spark, d, "documents")
    grouped = c.rows.where("row < 60").select(F.lit(0).alias("query"), (F.col("row") % 3).alias("cluster"), F.col("row").alias("id"))
    found = cluster.label_words(c, grouped, k=12)
    return found.select("query.cluster", "id", F.round("score", 6).alias("score"), "tf_d", "df_d", "total", "rank")


_FREE = f"""ft AS (SELECT item_id AS qy, c, count(*) AS tf FROM (SELECT item_id, unnest(regexp_split_to_array(lower(text), '{sql.BREAK}')) AS c FROM benchmark) WHERE c <> '' AND c IN (SELECT id FROM cd) GROUP BY ALL),
fs AS (SELECT qy, count(*) AS n, sum(tf) AS s FROM ft GROUP BY 1)"""


@query(
    "freetext_query",
    with_(sql.matrix("documents"), _FREE)
    + """, g AS (SELECT ft.qy, ft.c AS id, (1 + ln(ft.tf)) / (1 + ln(fs.s / fs.n)) / CASE WHEN 1 = 1 THEN 1 / ln(1 + cols_ / cd.df) END AS score, ft.tf AS tf_d, cd.df
  FROM ft JOIN fs USING (qy) JOIN cd ON cd.id = ft.c, st WHERE cd.df < (SELECT CASE WHEN rows_ <= 10000 THEN rows_ ELSE 0.125 ** (log10(rows_) - 4) * rows_ END::BIGINT FROM st)),
k AS (SELECT *, row_number() OVER (PARTITION BY qy ORDER BY round(score, 10) DESC, id) AS rank, count(*) OVER (PARTITION BY qy) AS total FROM g)
SELECT qy AS query, id, round(score, 6) AS score, tf_d, total, rank FROM k WHERE rank <= 70""",
)
def _(spark, d):
    c = corpus(spark, d, "documents")
    texts = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.lit("text").alias("input"), "text")
    found = A.summary(c, vectors=A.text_inputs(c, texts))
    return found.select("query", "id", F.round("score", 6).alias("score"), "tf_d", "total", "rank")


@query(
    "cross_corpus_remap",
    with_(sql.matrix("customers"), sql.matrix("orders", "o_"))
    + """, v AS (SELECT p.r, p.c AS id, p.tf FROM p WHERE p.r IN (1, 2, 4, 7) AND p.c IN (SELECT id FROM o_cd)),
g AS (SELECT id, sum(tf)::BIGINT AS tf_d, count(*) AS df_d, sum(tf)::DOUBLE AS score FROM v GROUP BY 1)
SELECT id, round(score, 6) AS score, tf_d, df_d, total, rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank, count(*) OVER () AS total FROM g) WHERE rank <= 40""",
)
def _(spark, d):
    source, target = corpus(spark, d, "customers"), corpus(spark, d, "orders")
    vectors = A.remapped(source, spark.createDataFrame([(1,), (2,), (4,), (7,)], "id long"), target)
    return shown(A.associate(target, "cols", "WT_DOT_PRODUCT", 40, vectors=vectors))


@query("remapped_cols", with_(sql.matrix("orders"), sql.matrix("customers", "o_")) + " SELECT 0 AS query, c::VARCHAR AS input, r AS id, tf FROM p WHERE c IN (1, 2, 3, 5, 8) AND r IN (SELECT id FROM o_rd)")
def _(spark, d):
    return A.remapped(corpus(spark, d, "orders"), spark.createDataFrame([(i,) for i in ITEMS], "id long"), corpus(spark, d, "customers"), "cols")


@query(
    "two_hop",
    with_(sql.matrix("documents"), sql.matrix("customers", "o_"), scored("s1", "WT_SMARTAW", "cols", terms(DOCS, cut=_CUT), k=70), scored("s2", "WT_SMARTWA", "rows", "SELECT qy, id AS t, tf_d AS tfq, score AS w, NULL::BIGINT AS cut FROM s1", k=200))
    + ", nm AS (SELECT qy, id, count(*) AS tfq FROM s2 GROUP BY 1, 2), "
    + scored("s3", "WT_DOT_PRODUCT", "rows", "SELECT qy, id AS t, tfq, 1.0 AS w, NULL::BIGINT AS cut FROM nm", x="o_", k=20)
    + f" SELECT {SHOWN} FROM s3",
)
def _(spark, d):
    return shown(A.two_hop(corpus(spark, d, "documents"), listed(spark, DOCS), corpus(spark, d, "customers"), 20))


_TOP = scored("d", "WT_SMARTWA", "rows", terms(WORDS, TF_Q, WEIGHT), k=10)
_MEAN = "(SELECT ttf / rows_ AS mean, rows_ AS N FROM st)"


_AW = (
    with_(sql.matrix("documents"), _TOP, scored("w", "WT_SMARTAW", "cols", "SELECT qy, id AS t, 1 AS tfq, 1.0 AS w, NULL::BIGINT AS cut FROM d", k=15))
    + f""" SELECT d.id AS i, w.id AS j, round((1 + ln(p.tf)) * (1 + ln(w.tf_d)) * ln(1 + N / cd.df) / ((0.8 * mean + 0.2) * (1 + ln(rd.tf / rd.df)) * (1 + ln(w.tf_d))), 6) AS sim
FROM d JOIN p ON p.r = d.id JOIN w ON w.id = p.c JOIN cd ON cd.id = p.c JOIN rd ON rd.id = d.id, {_MEAN}"""
)


@query("crossref_aw", _AW)
def _(spark, d):
    return documents_by_words(spark, d)


@query("crossref_wa", f"SELECT j AS i, i AS j, sim FROM ({_AW})")
def _(spark, d):
    return matrix.transposed(documents_by_words(spark, d))


def documents_by_words(spark: SparkSession, d: str) -> DataFrame:
    c = corpus(spark, d, "documents")
    docs = A.associate(c, "rows", "WT_SMARTWA", 10, listed(spark, WORDS, TF_Q, WEIGHT))
    docs = written(docs, "documents")
    topics = A.topics(c, docs, 15)
    return matrix.cross_reference(c, matrix.row_vectors(c, docs), matrix.unit_vectors(topics)).withColumn("sim", F.round("sim", 6))


@query(
    "crossref_aa",
    with_(sql.matrix("documents"), _TOP)
    + f""" SELECT a.r AS i, b.r AS j, round(sum((1 + ln(a.tf)) * (1 + ln(b.tf)) * ln(1 + N / cd.df)) / ((0.8 * any_value(mean) + 0.2 * any_value(y.df)) * (1 + ln(any_value(x.tf / x.df))) * (1 + ln(any_value(y.tf / y.df)))), 6) AS sim
FROM p a JOIN p b ON a.c = b.c JOIN cd ON cd.id = a.c JOIN rd x ON x.id = a.r JOIN rd y ON y.id = b.r, {_MEAN} WHERE a.r IN (SELECT id FROM d) AND b.r IN (SELECT id FROM d) GROUP BY 1, 2""",
)
def _(spark, d):
    c = corpus(spark, d, "documents")
    own = matrix.row_vectors(c, A.associate(c, "rows", "WT_SMARTWA", 10, listed(spark, WORDS, TF_Q, WEIGHT)))
    return matrix.cross_reference(c, own, own).withColumn("sim", F.round("sim", 6))


@query(
    "pair_similarity",
    with_(sql.matrix("documents"))
    + f""" SELECT a.r AS i, b.r AS j, round(sum((1 + ln(a.tf)) * (1 + ln(b.tf)) * ln(1 + N / cd.df)) / ((0.8 * any_value(mean) + 0.2 * any_value(y.df)) * (1 + ln(any_value(x.tf / x.df))) * (1 + ln(any_value(y.tf / y.df)))), 6) AS sim
FROM p a JOIN p b ON a.c = b.c JOIN cd ON cd.id = a.c JOIN rd x ON x.id = a.r JOIN rd y ON y.id = b.r, {_MEAN} WHERE a.r = 3 AND b.r = 11 GROUP BY 1, 2""",
)
def _(spark, d):
    c = corpus(spark, d, "documents")
    one, other = (matrix.row_vectors(c, spark.createDataFrame([(i,)], "id long")) for i in (3, 11))
    return matrix.cross_reference(c, one, other).withColumn("sim", F.round("sim", 6))


@query(
    "crossref_ww",
    with_(sql.matrix("orders"), "w AS (SELECT c AS id, r AS t, tf, count(*) OVER (PARTITION BY c) AS n, sum(tf) OVER (PARTITION BY c) AS s FROM p WHERE c IN (1, 2, 3, 5, 8))")
    + """ SELECT a.id AS i, b.id AS j, round(sum((1 + ln(a.tf)) * (1 + ln(b.tf)) * ln(1 + cols_ / rd.df)) / ((0.8 * any_value(ttf / cols_) + 0.2 * any_value(b.n)) * (1 + ln(any_value(a.s / a.n))) * (1 + ln(any_value(b.s / b.n)))), 6) AS sim
FROM w a JOIN w b ON a.t = b.t JOIN rd ON rd.id = a.t, st GROUP BY 1, 2""",
)
def _(spark, d):
    c = corpus(spark, d, "orders")
    own = matrix.col_vectors(c, spark.createDataFrame([(i,) for i in ITEMS], "id long"))
    return matrix.cross_reference(c, own, own, "rows").withColumn("sim", F.round("sim", 6))


@query("pairwise_dot", with_(sql.matrix("documents")) + f" SELECT a.r AS i, b.r AS j, sum(a.tf * b.tf)::BIGINT AS dot FROM p a JOIN p b ON a.c = b.c WHERE a.r IN {tuple(DOCS)} AND b.r IN {tuple(DOCS)} GROUP BY 1, 2")
def _(spark, d):
    c = corpus(spark, d, "documents")
    own = matrix.row_vectors(c, spark.createDataFrame([(i,) for i in DOCS], "id long"))
    return matrix.dot_product(own, own)


@query("getvec", with_(sql.matrix("documents")) + f" SELECT r AS row, c AS col, tf FROM p WHERE r IN {tuple(DOCS)}")
def _(spark, d):
    return corpus(spark, d, "documents").vector("row", spark.createDataFrame([(i,) for i in [*DOCS, -1]], "id long")).select("row", "col", "tf")


@query("getprop", f"SELECT doc_id AS id, doc_id::VARCHAR AS name, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents WHERE doc_id IN {tuple(DOCS)}")
def _(spark, d):
    return A.properties(corpus(spark, d, "documents"), spark.createDataFrame([(i,) for i in DOCS], "id long"), ("lang", "source"))


@query("catalogue", "SELECT coalesce(lang, 'none') AS corpus, 'number-of-documents' AS key, count(*)::VARCHAR AS value FROM documents GROUP BY 1")
def _(spark, d):
    library = Library(spark, shared_path(spark, "library"))
    docs = table(spark, d, "documents").withColumn("lang", F.coalesce("lang", F.lit("none")))
    for lang, n in docs.groupBy("lang").count().toLocalIterator():  # a corpus each
        own = docs.where(F.col("lang") == lang).select(F.col("doc_id").alias("row"), F.lit("document").alias("col"), F.lit(1).alias("tf"))
        info = spark.createDataFrame([("number-of-documents", str(n))], "key string, value string")
        library.save(lang, replace(Corpus.from_counts(own), info=info))
    return library.catalogue()


@query("vector_codec", with_(sql.matrix("documents")) + " SELECT r AS query, c AS id, (2 * tf)::BIGINT AS tf FROM p")
def _(spark, d):
    vectors = formats.vector_literal(corpus(spark, d, "documents").postings.select(F.col("row").alias("query"), F.col("col").alias("id"), "tf"))
    return formats.parse_vectors(vectors.unionByName(vectors))


@query("second_corpus", with_(sql.matrix("conversations"), scored("s", "WT_SMARTAW", "cols", terms([1, 2, 3, 5]), k=25)) + f" SELECT {SHOWN} FROM s")
def _(spark, d):
    return shown(A.associate(corpus(spark, d, "conversations"), "cols", "WT_SMARTAW", 25, listed(spark, [1, 2, 3, 5])))


@query("batch_topk", with_(sql.matrix("orders"), scored("s", "WT_COSINE", "rows", "SELECT o_custkey AS qy, l_partkey AS t, count(*) AS tfq, 1.0 AS w, NULL::BIGINT AS cut FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey % 50 = 0 GROUP BY 1, 2", k=5)) + " SELECT qy AS query, id, round(score, 6) AS score, tf_d, df_d, total, rank FROM s")
def _(spark, d):
    c = corpus(spark, d, "orders")
    asked = table(spark, d, "orders").where("o_custkey % 50 = 0").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    inputs = A.entities(asked.groupBy(F.col("o_custkey").alias("query"), F.col("l_partkey").alias("id")).agg(F.count("*").alias("tf_q")))
    return A.associate(c, "rows", "WT_COSINE", 5, inputs).select("query", "id", F.round("score", 6).alias("score"), "tf_d", "df_d", "total", "rank")


_XML = "'<result status=\"OK\" total=\"' || max(total) || '\">' || string_agg('<item name=\"' || id || '\" score=\"' || printf('%e', score) || '\" TFd=\"' || tf_d || '\" DFd=\"' || df_d || '\"/>', '' ORDER BY rank) || '</result>'"


@query("result_xml", with_(sql.matrix("documents"), scored("s", "WT_SMARTWA", "rows", terms(WORDS), k=10)) + f" SELECT 0 AS query, {_XML} AS xml FROM s")
def _(spark, d):
    return formats.result_xml(A.associate(corpus(spark, d, "documents"), "rows", "WT_SMARTWA", 10, listed(spark, WORDS)))


@query("cluster_hbc")
def _(spark, d):
    c = corpus(spark, d, "documents")
    found = A.associate(c, "rows", "WT_SMARTWA", 40, listed(spark, WORDS, TF_Q, WEIGHT))
    return cluster.clusters(c, found, 4)


@query("cluster_kmeans")
def _(spark, d):
    c = corpus(spark, d, "documents")
    found = A.associate(c, "rows", "WT_SMARTWA", 40, listed(spark, WORDS, TF_Q, WEIGHT))
    return cluster.clusters(c, found, 4, "kmeans", None)


@query("records_roundtrip", with_(sql.matrix("documents")) + " SELECT r::VARCHAR AS name, c AS col, tf FROM p")
def _(spark, d):
    c = corpus(spark, d, "documents")
    lines = formats.to_lines(Corpus(c.postings, c.rows)).withColumn("line", F.struct("part", "k")).select(F.col("row").cast("string").alias("file"), "line", "text")
    back = formats.corpus_from_lines(lines, ("lang", "source"))
    return back.postings.join(back.rows, "row").select("name", "col", "tf")


@query("sampled_records", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents) WHERE n % 3 = 1")
def _(spark, d):
    lines = table(spark, d, "documents").select(F.lit("one").alias("file"), F.col("doc_id").alias("line"), F.concat(F.lit("i"), F.col("doc_id").cast("string")).alias("text"))
    return formats.sampled(lines, 3, 1).select(F.substring("text", 2, 20).cast("long").alias("doc_id"))


@query("tsv_corpus", with_(sql.matrix("documents")) + " SELECT r::VARCHAR AS name, c AS col, tf FROM p")
def _(spark, d):
    path = shared_path(spark, "tables")
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("i"), F.col("lang").alias("#title"), F.coalesce("text", F.lit("")).alias("b1"))
    docs.write.option("maxRecordsPerFile", 20_000).option("sep", "\t").option("header", True).option("escape", '"').option("compression", "gzip").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    found = formats.corpus_from_lines(formats.tsv_lines(spark, f"{path}/*.csv.gz"))
    return found.postings.join(found.rows, "row").select("name", "col", "tf")


@query("xml_feed_properties", "SELECT item_id::VARCHAR AS name, 'item ' || item_id AS title, trim(regexp_replace(text, '\\s*[\\r\\n]+\\s*', ' ', 'g')) AS segment FROM benchmark")
def _(spark, d):
    path = shared_path(spark, "feeds")
    items = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("title"), F.struct(F.col("text").alias("fss")).alias("data"))
    items.write.format("xml").option("rootTag", "feed").option("rowTag", "entry").save(path)
    found = formats.corpus_from_lines(formats.xml_lines(spark, f"{path}/*.xml"))
    rows = found.rows.select("row", "name", F.col("props")["title"].alias("title"))
    return rows.join(found.segments.select("row", F.col("text").alias("segment")), "row").drop("row")


@query("expr_lgamma", with_(sql.matrix("documents"), scored("s", "lgamma", "rows", terms(WORDS, TF_Q))) + f" SELECT {SHOWN} FROM s")
def _(spark, d):
    with_functions(spark)
    return shown(A.associate(corpus(spark, d, "documents"), "rows", expression("lgamma(tf + 2) * idf"), 10, listed(spark, WORDS, TF_Q)))
