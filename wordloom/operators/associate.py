"""Association: score the entities of one side of a corpus against weighted entities of the other.

Inputs are a table, so any number of queries runs as one job: ``query`` names the query, ``input`` the input vector
within it. Candidates are gathered by one join and one aggregate; the best of each query follow from a
rank, which Spark limits before it shuffles. Scores are ranked as rounded to ten digits, so that the order of a sum
can't change a result; equal ones are ordered by id.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.presence import Presence
from ..functions.similarity import Similarity, built_in
from ..functions.text import words
from ..model import Corpus
from ..tables import written

#: Defaults of a request: words of a summary, items summarised for topics, and the three similarities.
SUMMARY_WORDS, TOPIC_ITEMS = 70, 10
STAGES = ("WT_SMARTAW", "WT_SMARTWA", "WT_SMARTAW")
#: A number of entities that any machine holds.
FREQUENT = 200_000


def default_cutoff(n: int) -> int:
    """Candidates with this document frequency or more are dropped from summaries of a corpus of n documents."""
    return n if n <= 10_000 else int(0.125 ** (math.log10(n) - 4) * n)


def entities(ids: DataFrame) -> DataFrame:
    """Inputs that are entities of the corpus. ``ids`` has ``id``; ``query``, ``tf_q``, ``weight`` and ``cutoff`` have defaults."""
    given = {c: F.col(c) for c in ids.columns}
    return ids.select(
        given.get("query", F.lit(0)).alias("query"), F.col("id").cast("string").alias("input"), F.col("id").alias("t"), given.get("tf_q", F.lit(1)).cast("long").alias("tf_q"),
        given.get("weight", F.lit(1.0)).cast("double").alias("weight"), given.get("cutoff", F.lit(None)).cast("long").alias("cutoff"),
    )


def named_inputs(corpus: Corpus, names: DataFrame, of: str = "rows") -> DataFrame:
    """Inputs by ``name`` of rows, or by the words themselves (of = cols), with the other columns that :func:`entities` takes. A name the corpus doesn't know is an error."""
    if of == "rows":
        known = corpus.rows.select("name", F.col("row").alias("id"))
    else:
        known = corpus.col_dims.select(F.col("id").cast("string").alias("name"), "id")
    unknown = names.select("name").distinct().join(known, "name", "left_anti").limit(1).collect()
    if unknown:
        raise ValueError(f"unknown name: {unknown[0].name!r}")
    return entities(names.join(known, "name").drop("name"))


def text_inputs(corpus: Corpus, texts: DataFrame) -> DataFrame:
    """Free texts as vectors of known words. ``texts`` has ``query``, ``input``, ``text``; result: ``query``, ``input``, ``id``, ``tf``. Texts without a known word give none."""
    tokens = texts.select("query", F.col("input").cast("string").alias("input"), F.explode(words(F.col("text"))).alias("id"))
    return tokens.join(corpus.col_dims.select("id"), "id", "left_semi").groupBy("query", "input", "id").agg(F.count("*").alias("tf"))


def remapped(source: Corpus, ids: DataFrame, target: Corpus, of: str = "rows") -> DataFrame:
    """Vectors of another corpus's rows (or cols) as inputs for this one: elements are matched by name, unknown ones dropped.

    Ids and elements are written: of few ones Spark then knows that they are few, and shuffles neither the postings nor the names of both corpora.
    """
    t = "row" if of == "rows" else "col"
    found = written(source.postings.join(written(ids, "asked").withColumnRenamed("id", t), t), "elements")
    if of == "rows":
        found = found.join(target.col_dims.select(F.col("id").alias("col")), "col", "left_semi")
        return found.select(F.col("query") if "query" in ids.columns else F.lit(0).alias("query"), F.col("row").cast("string").alias("input"), F.col("col").alias("id"), "tf")
    found = written(found.join(source.rows.select("row", "name"), "row"), "named").join(target.rows.select(F.col("row").alias("to"), "name"), "name")
    return found.select(F.col("query") if "query" in ids.columns else F.lit(0).alias("query"), F.col("col").cast("string").alias("input"), F.col("to").alias("id"), "tf").groupBy("query", "input", "id").agg(F.sum("tf").alias("tf"))


@dataclass(frozen=True)
class Filters:
    """What candidates must pass. ``include`` and ``exclude`` have ``id``: kept is who is included, or, if exclude is given, not excluded."""

    having: Presence | None = None
    include: DataFrame | None = None
    exclude: DataFrame | None = None
    predicate: Column | None = None
    cutoff: bool = True


def _marked(found: DataFrame, filters: Filters) -> DataFrame:
    """The mask, as semi and anti joins where one suffices."""
    if filters.include is None and filters.exclude is None:
        return found
    if filters.exclude is None:
        return found.join(filters.include.select("id").distinct(), "id", "left_semi")
    if filters.include is None:
        return found.join(filters.exclude.select("id").distinct(), "id", "left_anti")
    yes = filters.include.select("id").distinct().withColumn("__yes", F.lit(True))
    no = filters.exclude.select("id").distinct().withColumn("__no", F.lit(True))
    return found.join(yes, "id", "left").join(no, "id", "left").where("__yes is not null or __no is null").drop("__yes", "__no")


def scored(corpus: Corpus, result: str, similarity: str | Similarity, inputs: DataFrame | None = None, vectors: DataFrame | None = None, filters: Filters = Filters()) -> DataFrame:
    """Every candidate that passes: ``query``, ``id``, ``score``, ``tf_d``, ``df_d``, ``df``, ``tf_sum``.

    ``inputs`` as by :func:`entities`, of the side that isn't the result; ``vectors`` as by :func:`text_inputs`, with
    frequencies of their own (a vector's elements stand for its document frequency). Inputs without elements are skipped.
    """
    kind = built_in(similarity) if isinstance(similarity, str) else similarity
    elements, query_dims, result_dims = corpus.side(result)
    s = corpus.stats
    n_result, n_query = (s["n_rows"], s["n_cols"]) if result == "rows" else (s["n_cols"], s["n_rows"])
    r, q = ("row", "col") if result == "rows" else ("col", "row")
    parts = []
    # Written, so that Spark knows their size before it plans: where they are few, the table of all entities isn't shuffled to meet them.
    inputs, vectors = (x if x is None else written(x, "given") for x in (inputs, vectors))
    if inputs is not None:
        dims = query_dims.select(F.col("id").alias("t"), F.col("df").alias("df_t"), F.col("tf_sum").alias("tf_t")).where("df_t > 0")
        parts.append(inputs.join(dims, "t"))
    if vectors is not None:
        own = vectors.groupBy("query", "input").agg(F.count("*").alias("df_t"), F.sum("tf").alias("tf_t"))
        given = {c: F.max(c).alias(c) for c in ("tf_q", "weight", "cutoff") if c in vectors.columns}
        if given:
            own = own.join(vectors.groupBy("query", "input").agg(*given.values()), ["query", "input"])
        add = {"tf_q": F.lit(1).cast("long"), "weight": F.lit(1.0), "cutoff": F.lit(None).cast("long")}
        parts.append(own.select("query", "input", "df_t", "tf_t", *[F.col(c) if c in given else v.alias(c) for c, v in add.items()]))
    idf = F.log1p(F.lit(float(n_result)) / F.col("df_t"))
    columns = ["query", "input", "df_t", "tf_t", "tf_q", "weight", "cutoff", "idf"]
    known = [p.withColumn("idf", idf) for p in parts]
    everyone = known[0].select(*columns)
    for p in known[1:]:
        everyone = everyone.unionByName(p.select(*columns))
    square = F.col("tf_q") * (F.col("idf") if kind.norm_of == "tf_idf" else F.lit(1.0))
    per_query = everyone.groupBy("query").agg(F.count("*").alias("nq"), F.sum("tf_q").alias("sum_tfq"), F.sqrt(F.sum(square * square)).alias("norm_q"))
    # Joined to the inputs, which are few: above the postings ``query`` may be one value for all rows. Written, as Spark then knows
    # their size before it plans: where they are few they go to the postings, which aren't shuffled.
    known = [written(p.join(per_query, "query"), "inputs") for p in known]
    columns += ["nq", "sum_tfq", "norm_q"]
    hits, k = None, 0
    if inputs is not None:
        hits, k = known[0].join(elements, "t").select(*columns, "id", "tf"), 1
    if vectors is not None:
        more = known[k].join(vectors.select("query", "input", "id", "tf"), ["query", "input"]).select(*columns, "id", "tf")
        hits = more if hits is None else hits.unionByName(more)
    hits = _marked(hits, filters)
    constants = {
        "n_result": float(n_result), "n_query": float(n_query), "mean_df": s["total_df"] / max(1, n_result), "avg_tf": s["total_tf"] / max(1, n_result),
        "max_df_r": s[f"max_df_{r}"], "max_tf_r": s[f"max_tf_{r}"], "max_df_q": s[f"max_df_{q}"], "max_tf_q": s[f"max_tf_{q}"],
    }
    hits = hits.withColumns({name: F.lit(value) for name, value in constants.items()})
    candidate = result_dims.select("id", "df", "tf_sum")
    if kind.needs_candidate:
        hits = hits.join(candidate, "id")
    gathered = [
        F.sum(kind.query * kind.element).alias("ws"), F.sum("tf").alias("tf_d"), F.count("*").alias("df_d"), F.max("cutoff").alias("most"), F.min("cutoff").alias("least"), F.count("cutoff").alias("limits"),
        *[F.first(c).alias(c) for c in ("nq", "sum_tfq", "norm_q")], *([F.first(c).alias(c) for c in ("df", "tf_sum")] if kind.needs_candidate else []),
    ]
    # Written for the same reason: a few candidates meet the table of all entities, or its vectors' lengths, where these lie.
    found = written(hits.groupBy("query", "id").agg(*gathered), "gathered").withColumns({name: F.lit(value) for name, value in constants.items()})
    if filters.having is not None:
        found = _present(found, elements, filters.having)
    if not kind.needs_candidate:
        found = found.join(candidate, "id")
    if filters.cutoff:
        found = found.where((F.col("limits") == 0) | (F.col("least") == 0) | (F.col("df") < F.col("most")))
    if filters.predicate is not None:
        found = found.where(filters.predicate)
    if kind.norm_of:
        weight, vectors_d = F.col("tf").cast("double"), elements
        if kind.norm_of == "tf_idf":
            weight, vectors_d = weight * idf, _with_frequency(elements, query_dims, s["total_df"])
        # Of all entities: summed up where they lie, they make a row each, and the postings needn't be shuffled to meet the candidates.
        found = found.join(vectors_d.groupBy("id").agg(F.sqrt(F.sum(weight * weight)).alias("norm_d")), "id")
    score = F.col("ws")
    if kind.norm is not None:
        good = (F.col("ws") != 0) & (kind.norm != 0)
        score = F.when(good, F.col("ws") / F.when(good, kind.norm)).otherwise(score)
    if kind.scale is not None:
        score = score * kind.scale
    return found.select("query", "id", score.alias("score"), "tf_d", "df_d", "df", "tf_sum")


def _with_frequency(elements: DataFrame, query_dims: DataFrame, total_df: int) -> DataFrame:
    """Elements with ``df_t``, the document frequency of their entity.

    That of frequent entities goes to the postings: at most :data:`FREQUENT` ones can hold that share of all postings each. Only the
    postings of the others are shuffled.
    """
    known = query_dims.select(F.col("id").alias("t"), F.col("df").alias("df_t"))
    often = F.col("df_t") >= F.lit(total_df / FREQUENT)
    marked = elements.join(F.broadcast(known.where(often)), "t", "left")
    return marked.where("df_t is not null").unionByName(marked.where("df_t is null").drop("df_t").join(known.where(~often), "t").select(*marked.columns))


def _present(found: DataFrame, elements: DataFrame, having: Presence) -> DataFrame:
    """Candidates for which the filter holds. Its entities are looked up among the candidates alone, so they add none."""
    names = sorted(having.names, key=str)
    if not names:
        return found.where(having.build(lambda _: F.lit(False)))
    flags = elements.where(F.col("t").isin(names)).groupBy("id").agg(*[F.max(F.col("t") == F.lit(n)).alias(f"__has{k}") for k, n in enumerate(names)])
    joined = found.join(flags, "id", "left")
    at = {n: F.coalesce(F.col(f"__has{k}"), F.lit(False)) for k, n in enumerate(names)}
    return joined.where(having.build(lambda n: at[n])).select(*found.columns)


def best(found: DataFrame, k: int, offset: int = 0) -> DataFrame:
    """The k best of each query after the offset, with ``rank`` from 1 and ``total``, the number of all candidates."""
    order = Window.partitionBy("query").orderBy(F.round("score", 10).desc(), F.col("id"))
    top = found.withColumn("rank", F.row_number().over(order)).where((F.col("rank") > offset) & (F.col("rank") <= offset + k))
    return top.join(found.groupBy("query").agg(F.count("*").alias("total")), "query")


def associate(corpus: Corpus, result: str, similarity: str | Similarity, k: int, inputs: DataFrame | None = None, vectors: DataFrame | None = None, filters: Filters = Filters(), offset: int = 0) -> DataFrame:
    """Best candidates: ``query``, ``id``, ``score``, ``tf_d``, ``df_d``, ``df``, ``tf_sum``, ``rank``, ``total``. Queries without candidates have no rows."""
    found = written(scored(corpus, result, similarity, inputs, vectors, filters), "scored")  # as the best and their total both read it
    return best(found, k, offset)


def summary(corpus: Corpus, inputs: DataFrame | None = None, vectors: DataFrame | None = None, k: int = SUMMARY_WORDS, similarity: str | Similarity = STAGES[0], cutoff: int | None = None) -> DataFrame:
    """Stage 1: the words that characterise some rows (or texts). A cutoff of the inputs' own comes first."""
    limit = F.lit(default_cutoff(corpus.stats["n_rows"]) if cutoff is None else cutoff).cast("long")
    if inputs is not None:
        inputs = inputs.withColumn("cutoff", F.coalesce("cutoff", limit))
    if vectors is not None:
        vectors = vectors.withColumn("cutoff", F.coalesce("cutoff", limit) if "cutoff" in vectors.columns else limit)
    return associate(corpus, "cols", similarity, k, inputs, vectors)


def as_inputs(found: DataFrame) -> DataFrame:
    """A result as the next stage's inputs: its scores are weights, ``tf_d`` the frequencies."""
    return entities(found.select("query", "id", F.col("tf_d").alias("tf_q"), F.col("score").alias("weight")))


def similar(corpus: Corpus, words_found: DataFrame, k: int, offset: int = 0, similarity: str | Similarity = STAGES[1], filters: Filters = Filters()) -> DataFrame:
    """Stage 2: the rows most similar to a summary."""
    return associate(corpus, "rows", similarity, k, as_inputs(words_found), filters=filters, offset=offset)


def topics(corpus: Corpus, rows_found: DataFrame, k: int, items: int = TOPIC_ITEMS, similarity: str | Similarity = STAGES[2]) -> DataFrame:
    """Stage 3: the topic words of the best rows."""
    top = rows_found.where(F.col("rank") <= items).select("query", "id")
    return associate(corpus, "cols", similarity, k, entities(top))


@dataclass(frozen=True)
class Request:
    """Parameters of a whole association. ``stage`` 0 is all of it, 1 stops after the summary, 2 takes one."""

    n_rows: int = 0
    n_cols: int = 0
    offset: int = 0
    summary_words: int = SUMMARY_WORDS
    topic_items: int = TOPIC_ITEMS
    stage: int = 0
    similarities: tuple = STAGES
    cutoff: int | None = None

    def run(self, corpus: Corpus, inputs: DataFrame | None = None, vectors: DataFrame | None = None, filters: Filters = Filters(), summary_given: DataFrame | None = None, found: DataFrame | None = None) -> dict[str, DataFrame]:
        """``summary``, ``rows`` and ``cols``, as far as asked for.

        ``found``, documents of a text search with ``query``, ``id`` and ``score``, takes the place of the first two stages; it can't go with inputs or filters.
        """
        if found is not None:
            if inputs is not None or vectors is not None or summary_given is not None or filters != Filters():
                raise ValueError("a text search takes no inputs and no filters")
            second = written(best(found, max(self.offset + self.n_rows, self.topic_items)), "found")
            return self._shown(corpus, {}, second)
        if self.stage == 2 and summary_given is None:
            raise ValueError("stage 2 needs a summary")
        first = summary_given if self.stage == 2 else summary(corpus, inputs, vectors, self.summary_words, self.similarities[0], self.cutoff)
        first = written(first, "summary")  # a few rows a query, which the next stage reads several times
        if self.stage == 1:
            return {"summary": first}
        reach = max(self.offset + self.n_rows, self.topic_items)
        second = similar(corpus, first, reach, 0, self.similarities[1], filters)
        return self._shown(corpus, {"summary": first}, written(second, "found"))

    def _shown(self, corpus: Corpus, out: dict[str, DataFrame], second: DataFrame) -> dict[str, DataFrame]:
        out["rows"] = second.where((F.col("rank") > self.offset) & (F.col("rank") <= self.offset + self.n_rows))
        if self.n_cols:
            out["cols"] = topics(corpus, second, self.n_cols, self.topic_items, self.similarities[2])
        return out

    def with_defaults(self, text: str) -> Request:
        """Overridden by lines ``key=value``; unknown keys and malformed lines are errors."""
        changes = {}
        for line in text.splitlines():
            if line.strip():
                key, equals, value = line.partition("=")
                if not equals or key not in self.__dataclass_fields__:
                    raise ValueError(f"bad default: {line!r}")
                kind = type(getattr(self, key))
                changes[key] = tuple(value.split(",")) if kind is tuple else int(value)
        return replace(self, **changes)


def two_hop(directory: Corpus, inputs: DataFrame, corpus: Corpus, k: int, hits: int = 200) -> DataFrame:
    """Search a directory, and take the names of what it finds, as often as they occur, as the vector of a search in a second corpus."""
    found = written(similar(directory, written(summary(directory, inputs), "summary"), hits), "found")
    named = found.join(directory.rows.select(F.col("row").alias("id"), "name"), "id")
    vector = named.groupBy("query", F.col("name").alias("id")).agg(F.count("*").alias("tf_q"))
    return associate(corpus, "rows", "WT_DOT_PRODUCT", k, entities(written(vector, "vector")))


def query_weights(corpus: Corpus, result: str, inputs: DataFrame, found: DataFrame, similarity: str | Similarity | None = None) -> DataFrame:
    """For a look inside: which inputs each found entity holds, with the frequencies. With a similarity (without a norm by vector lengths) also ``share``, the input's
    part of the score: shares of an entity add up to its score.
    """
    elements, _, _ = corpus.side(result)
    held = found.select("query", F.col("id")).join(elements, "id").join(inputs.select("query", "t", "weight", "tf_q"), ["query", "t"])
    if similarity is None:
        return held
    each = inputs.withColumn("query", F.struct("query", "t"))
    alone = scored(corpus, result, similarity, each, filters=Filters(cutoff=False)).select(F.col("query.query").alias("query"), F.col("query.t").alias("t"), "id", F.col("score").alias("share"))
    alone = held.join(alone, ["query", "t", "id"])
    whole = alone.groupBy("query", "id").agg(F.sum("share").alias("__all"))
    scores = found.select("query", "id", F.col("score").alias("__score"))
    out = alone.join(whole, ["query", "id"]).join(scores, ["query", "id"])
    return out.withColumn("share", F.when(F.col("__all") != 0, F.col("share") * F.col("__score") / F.when(F.col("__all") != 0, F.col("__all"))).otherwise(F.lit(0.0))).drop("__all", "__score")


def properties(corpus: Corpus, ids: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """``id`` and the named properties (``fss.N``: the text of segment N, ``vec``: the elements) of some rows; what is missing is empty."""
    known = corpus.rows.select(F.col("row").alias("id"), "name", "props")
    out = ids.join(known, "id")
    for n in names:
        if n.startswith("fss."):
            own = corpus.segments.where(F.col("segid") == int(n[4:])).select(F.col("row").alias("id"), F.col("text").alias(n))
            out = out.join(own, "id", "left").withColumn(n, F.coalesce(F.col(f"`{n}`"), F.lit("")))
        elif n == "vec":
            own = corpus.postings.groupBy(F.col("row").alias("id")).agg(F.to_json(F.sort_array(F.collect_list(F.struct("col", "tf")))).alias("vec"))
            out = out.join(own, "id", "left").withColumn("vec", F.coalesce("vec", F.lit("")))
        else:
            out = out.withColumn(n, F.coalesce(F.col("props")[n], F.lit("")))
    return out.drop("props")
