"""Allow and block lists for URLs: a trie over reversed host labels and path segments.

A rule is a host and a path. It fits the host and its subdomains, where the URL's path starts with the
rule's. Of the rules that fit, the one deepest in the trie decides: most host labels, then the longest path.
The trie is broadcast if it has no more than a stated number of nodes; larger lists are joined to the URLs' possible
keys instead, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: Nodes (labels and path segments of all rules) up to which the trie is broadcast: about half a kilobyte each in every Python worker.
BROADCAST_NODES = 50_000
#: Keys of a node for its rules and for its path children; neither can be a host label or a path segment.
RULES, PATH = "/rules", "/path"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
UPPER_LETTERS, LOWER_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path; both empty for null and for texts without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    for mark in "?#":
        rest = rest.partition(mark)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


def build_trie(rules: list[tuple[str, str, str]]) -> dict:
    """Nested dicts of rules ``(host, path, verdict)``.

    A node of whole host labels, then of whole path segments, keeps the beginnings of the next segment
    that its rules ask for. Of rules with one host and path a block wins.
    """
    root: dict = {}
    for host, path, verdict in sorted(rules, key=lambda r: r[2] == "block"):
        node = root
        for label in reversed(host.split(".")):
            node = node.setdefault(label, {})
        *segments, rest = path.split("/")
        node = node.setdefault(PATH, {})
        for segment in segments:
            node = node.setdefault("s" + segment, {})
        node.setdefault(RULES, {})[rest] = (host + path, verdict)
    return root


def look_up(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """Rule text and verdict of the deepest rule that fits, or None."""
    node, nodes = trie, []
    for label in reversed(host.split(".")):
        node = node.get(label)
        if node is None:
            break
        nodes.append(node)
    parts = path.split("/")
    for node in reversed(nodes):
        found, here, at = None, node.get(PATH), 0
        while here is not None:
            rest = parts[at]
            own = here.get(RULES, {})
            longest = next((rest[:k] for k in range(len(rest), -1, -1) if rest[:k] in own), None)
            if longest is not None:
                found = own[longest]
            if at + 1 >= len(parts):
                break
            here, at = here.get("s" + rest), at + 1
        if found:
            return found
    return None


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path as in :func:`split_url`, in Spark's own functions."""
    rest = F.when(F.locate("://", url) > 0, F.regexp_replace(F.substring(url, F.locate("://", url) + 3, F.length(url)), "[?#](?s).*$", "")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.substring_index(rest, "/", 1)
    return F.translate(host, UPPER_LETTERS, LOWER_LETTERS), F.substring(rest, F.length(host) + 1, F.length(rest))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """``id``, ``host``, ``path``, ``rule``, ``verdict`` for every row of pages.

    ``rules`` has ``host``, ``path`` and ``verdict`` (allow or block). Without a fitting rule, ``rule`` is null and the verdict
    is the default. Null URLs and those without ``://`` have an empty host and path. Rules with a null host, path or verdict fit
    nothing; where rules repeat, a block wins. Repeated pages are judged each, other columns are not read,
    and empty tables give no rows, or the default everywhere.
    """
    spark = pages.sparkSession
    rules = rules.select("host", "path", "verdict").dropna().distinct()
    nodes = rules.agg(F.sum(F.size(F.split("host", r"\.")) + F.size(F.split("path", "/"))).alias("n"), F.sum(F.octet_length("host") + F.octet_length("path")).alias("b")).first()
    if (nodes.n or 0) > broadcast_nodes or (nodes.b or 0) > 64 * broadcast_nodes:
        return _judged_by_join(pages, rules, id_col, url_col, default)
    trie = spark.sparkContext.broadcast(build_trie([tuple(r) for r in rules.collect()]))

    def make(ids: list, urls: list) -> Iterator[tuple]:
        for i, url in zip(ids, urls, strict=True):
            host, path = split_url(url)
            rule, verdict = look_up(trie.value, host, path) or (None, default)
            yield i, host, path, rule, verdict

    return map_rows(pages.select(F.col(id_col).cast("long"), url_col), make, "id long, host string, path string, rule string, verdict string")


def _judged_by_join(pages: DataFrame, rules: DataFrame, id_col: str, url_col: str, default: str) -> DataFrame:
    """Rules of any number: join each URL's host suffixes with the rules, keep those whose path fits, take the deepest."""
    host, path = url_parts(F.col(url_col))
    urls = pages.select(F.col(id_col).cast("long").alias("id"), host.alias("host"), path.alias("path"))
    distinct = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, F.size(labels) - k + 1, k), "."))
    beginnings = F.transform(F.sequence(F.lit(0), F.length("path")), lambda k: F.substring(F.col("path"), F.lit(1), k))
    keys = distinct.select("host", "path", F.explode(suffixes).alias("h")).select("host", "path", "h", F.explode(beginnings).alias("p"))
    one = rules.groupBy(F.col("host").alias("h"), F.col("path").alias("p")).agg(F.max("verdict").alias("v"))  # block > allow
    deep = F.struct(F.size(F.split("h", r"\.")).alias("labels"), F.length("p").alias("n"), F.concat("h", "p").alias("rule"), F.col("v").alias("v"))
    best = keys.join(one, ["h", "p"]).groupBy("host", "path").agg(F.max(deep).alias("best"))
    return urls.join(best, ["host", "path"], "left").select("id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.v", F.lit(default)).alias("verdict"))


#: Fixed rules of the query.
OP4_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(OP4_RULES, "host string, path string, verdict string")
    found = judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)
    return found.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


QUERIES = {"op4_url_filter": op4_url_filter}
ORACLE_SQL = {
    "op4_url_filter": r"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_replace(substr(url, instr(url, '://') + 3), '(?s)[?#].*$', '') ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(split_part(coalesce(rest, ''), '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    substr(coalesce(rest, ''), length(split_part(coalesce(rest, ''), '/', 1)) + 1) AS path FROM cut),
rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
numbered AS (SELECT row_number() OVER () AS r, * FROM parts),
fits AS (
  SELECT r, h || p AS rule, v, row_number() OVER (PARTITION BY r ORDER BY length(h) - length(replace(h, '.', '')) DESC, length(p) DESC) AS k
  FROM numbered JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM numbered LEFT JOIN (SELECT * FROM fits WHERE k = 1) USING (r)"""
}
