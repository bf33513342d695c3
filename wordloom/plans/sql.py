"""Builders for the SQL that the queries' results are held against."""

from __future__ import annotations

from ..functions import text as T

BREAK = r"[^\p{L}\p{N}]+"

#: Matrices of the test tables: counts (r, c, tf), and all rows (r).
COUNTS = {
    "documents": (f"SELECT doc_id AS r, c, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '{BREAK}')) AS c FROM documents) WHERE c <> '' GROUP BY ALL", "SELECT DISTINCT doc_id AS r FROM documents"),
    "conversations": (f"SELECT conv_id AS r, c, count(*) AS tf FROM (SELECT conv_id, unnest(regexp_split_to_array(lower(text), '{BREAK}')) AS c FROM conversations) WHERE c <> '' GROUP BY ALL", "SELECT DISTINCT conv_id AS r FROM conversations"),
    "orders": ("SELECT l_orderkey AS r, l_partkey AS c, count(*) AS tf FROM lineitem GROUP BY ALL", "SELECT DISTINCT l_orderkey AS r FROM lineitem"),
    "customers": ("SELECT o_custkey AS r, l_partkey AS c, count(*) AS tf FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL", "SELECT DISTINCT o_custkey AS r FROM orders JOIN lineitem ON l_orderkey = o_orderkey"),
    "events": ("SELECT user_id AS r, event_type AS c, count(*) AS tf FROM events GROUP BY ALL", "SELECT DISTINCT user_id AS r FROM events"),
}


def matrix(name: str, prefix: str = "", where: str = "TRUE") -> str:
    """CTEs p(r, c, tf), rd(id, df, tf), cd(id, df, tf), st(one row of sizes)."""
    counts, rows = COUNTS[name]
    x = prefix
    return f"""{x}p AS (SELECT * FROM ({counts}) WHERE {where}), {x}ar AS (SELECT * FROM ({rows}) WHERE {where}),
{x}rd AS (SELECT {x}ar.r AS id, count({x}p.c) AS df, coalesce(sum({x}p.tf), 0)::BIGINT AS tf FROM {x}ar LEFT JOIN {x}p ON {x}p.r = {x}ar.r GROUP BY 1),
{x}cd AS (SELECT c AS id, count(*) AS df, sum(tf)::BIGINT AS tf FROM {x}p GROUP BY 1),
{x}st AS (SELECT (SELECT count(*) FROM {x}rd)::DOUBLE AS rows_, (SELECT count(*) FROM {x}cd)::DOUBLE AS cols_, (SELECT coalesce(sum(df), 0) FROM {x}rd)::DOUBLE AS tdf, (SELECT coalesce(sum(tf), 0) FROM {x}rd)::DOUBLE AS ttf)"""


_LENGTH = "CASE WHEN x.df = 0 THEN 1.0 ELSE (L + 0.2 * (x.df - L)) * (1 + ln(x.tf / x.df)) END"
#: Per similarity: query weight, element weight, norm, what vector lengths are over, scale.
KINDS = {
    "WT_SMARTWA": ("h.w", "1 + ln(h.tf)", _LENGTH, None, "1"),
    "WT_SMARTAW": ("CASE WHEN h.tdf = 0 THEN 0 ELSE 1 / (1 + ln(h.ttf / h.tdf)) END", "1 + ln(h.tf)", "CASE WHEN x.df = 0 THEN 1.0 ELSE nq / ln(1 + N / x.df) END", None, "1"),
    "WT_SMART": ("(1 + ln(h.tfq)) / (1 + ln(stq / nq)) * h.idf", "1 + ln(h.tf)", _LENGTH, None, "1"),
    "WT_COSINE": ("h.tfq", "h.tf", "nrm * len", "tf", "1"),
    "WT_DOT_PRODUCT": ("h.tfq", "h.tf", "1.0", None, "1"),
    "WT_COSINE_TFIDF": ("h.tfq * h.idf", "h.tf * h.idf", "nrm * len", "tf_idf", "1"),
    "WT_DOT_PRODUCT_TFIDF": ("h.tfq * h.idf", "h.tf * h.idf", "1.0", None, "1"),
    "WT_Okapi_BM25": ("1", "ln((N - h.tdf + 0.5) / (h.tdf + 0.5)) * h.tf * 3 / (h.tf + 2 * (0.25 + 0.75 * x.tf / A))", "1.0", None, "1"),
    "hits": ("1", "1", "1.0", None, "1"),
    "tf": ("h.tfq", "h.tf", "1.0", None, "1"),
    "tfidf": ("h.tfq", "h.tf * h.idf", "1.0", None, "1"),
    "lgamma": ("1", "lgamma(h.tf + 2) * h.idf", "1.0", None, "1"),
    "custom": ("1", "h.tf / (h.tf + 1) * h.idf", "1.0", None, "g.df_d / nq"),
}


def scored(n: str, kind: str, result: str, inputs: str, where: str = "TRUE", x: str = "", k: int = 10, offset: int = 0) -> str:
    """CTEs up to ``n``: qy, id, score, tf_d, df_d, df, tf, rank, total. ``inputs`` selects qy, t, tfq, w, cut; ``where`` may use g and x."""
    cand, term, cdim, tdim, size = ("r", "c", f"{x}rd", f"{x}cd", "rows_") if result == "rows" else ("c", "r", f"{x}cd", f"{x}rd", "cols_")
    wq, wd, norm, over, scale = KINDS[kind]
    sizes = f"(SELECT {size} AS N, tdf / {size} AS L, ttf / {size} AS A FROM {x}st)"
    square = "k.tfq * k.idf" if over == "tf_idf" else "k.tfq"
    weight = "p.tf * ln(1 + N / t.df)" if over == "tf_idf" else "p.tf"
    lengths = f"LEFT JOIN (SELECT p.{cand} AS lid, sqrt(sum(({weight})::DOUBLE * ({weight}))) AS len FROM {x}p p JOIN {tdim} t ON t.id = p.{term}, {sizes} GROUP BY 1) ON lid = g.id" if over else ""
    return f"""{n}_i AS ({inputs}),
{n}_k AS (SELECT i.*, d.df AS tdf, d.tf AS ttf, ln(1 + N / d.df) AS idf FROM {n}_i i JOIN {tdim} d ON d.id = i.t, {sizes} WHERE d.df > 0),
{n}_q AS (SELECT qy, count(*) AS nq, sum(tfq) AS stq, sqrt(sum(({square})::DOUBLE * ({square}))) AS nrm FROM {n}_k k GROUP BY qy),
{n}_h AS (SELECT k.*, p.{cand} AS cand, p.tf AS tf FROM {n}_k k JOIN {x}p p ON p.{term} = k.t),
{n}_g AS (SELECT h.qy, h.cand AS id, sum(({wq}) * ({wd}))::DOUBLE AS ws, sum(h.tf)::BIGINT AS tf_d, count(*) AS df_d, max(cut) AS most, min(cut) AS least, count(cut) AS limits
  FROM {n}_h h JOIN {n}_q USING (qy) JOIN {cdim} x ON x.id = h.cand, {sizes} GROUP BY 1, 2),
{n}_s AS (SELECT g.qy, g.id, CASE WHEN ws <> 0 AND {norm} <> 0 THEN ws / ({norm}) ELSE ws END * ({scale}) AS score, tf_d, df_d, x.df, x.tf
  FROM {n}_g g JOIN {n}_q USING (qy) JOIN {cdim} x ON x.id = g.id {lengths}, {sizes}
  WHERE (limits = 0 OR least = 0 OR x.df < most) AND ({where})),
{n} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qy ORDER BY round(score, 10) DESC, id) AS rank, count(*) OVER (PARTITION BY qy) AS total FROM {n}_s) WHERE rank > {offset} AND rank <= {offset + k})"""


def terms(values: list, tfq: dict | None = None, w: dict | None = None, cut: str = "NULL::BIGINT") -> str:
    rows = ", ".join(f"({v!r}, {(tfq or {}).get(v, 1)}, {(w or {}).get(v, 1.0)})" for v in values)
    return f"SELECT 0 AS qy, t, tfq, w::DOUBLE AS w, {cut} AS cut FROM (VALUES {rows}) v(t, tfq, w)"


#: What queries publish of a result.
SHOWN = "id, round(score, 6) AS score, tf_d, df_d, total, rank"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes)


def folded(text: str, options: str) -> str:
    """The fold of a text under those options that the queries use."""
    on = T.parse_options(options)
    if "collapse-hirakata" in on:
        text = f"translate({text}, '{T._range(0x3041, 0x3094)}', '{T._range(0x30A1, 0x30F4)}')"
    if "collapse-qy" in on:
        text = f"translate({text}, '{T.SMALL_KANA}', '{T.LARGE_KANA}')"
    if "ignore-space" in on:
        text = rf"regexp_replace({text}, '[\t\n\r \x{{a0}}\x{{2000}}-\x{{200a}}\x{{202f}}\x{{205f}}\x{{3000}}]', '', 'g')"
    for option, pairs in T.JOINED.items():
        if option in on:
            for pair, one in pairs.items():
                text = f"replace({text}, '{pair}', '{one}')"
    if "collapse-hf" in on:
        for a in "ュユ":
            text = f"replace(replace({text}, 'フ{a}', 'ヒ{a}'), 'ヴ{a}', 'ビ{a}')"
    if "collapse-kx" in on:
        text = f"regexp_replace({text}, 'ク([サシスセソ])', 'キ\\1', 'g')"
    if "collapse-ay" in on:
        text = f"regexp_replace({text}, '([{T.BEFORE_YA}])ヤ', '\\1ア', 'g')"
    if "collapse-zdz" in on:
        text = f"translate({text}, 'ヂヅ', 'ジズ')"
    if "collapse-ka" in on:
        text = f"translate({text}, '{T.COUNTERS}', '{'箇' * len(T.COUNTERS)}')"
    return text
