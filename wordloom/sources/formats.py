"""Corpora from record lines, TSV and XML; vectors and results as text.

All three formats become record lines, a table ``(file, line, text)``, which Spark's string functions and running totals
turn into a corpus. Files of record lines are split among tasks like any text; a TSV or XML file is read by one task, many side by side, and unpacked
and parsed as a stream.
"""

from __future__ import annotations

import bz2
import csv
import gzip
import io
import lzma
import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import counted, nfkc, words
from ..model import RESERVED, Corpus
from ..tables import latest, numbered, running_total, written

#: One record line of each kind; anything else is malformed.
KINDS = r"^(?:@[^=]+=.*|\$[^=]+=.*|i.+|#[^=]+=.*|b1.*|[!+].*| .+|[1-9][0-9]* .+)?$"
#: Files with more lines or characters are cut into ranges, others read by one task each.
FILE_LINES, FILE_CHARS = 1_000_000, 1 << 27
PROPERTY = r"[A-Za-z_][A-Za-z0-9_.:-]*"


def record_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the record format. A byte order mark and carriage returns are dropped. ``line`` is a place in the file, by which its lines are ordered."""
    begin = F.col("_metadata.file_block_start")
    read = spark.read.option("lineSep", "\n").text(path)
    read = read.select(F.col("_metadata.file_path").alias("file"), F.struct(begin.alias("begin"), F.monotonically_increasing_id().alias("n")).alias("line"), "value")
    marked = F.regexp_replace("value", "\r$", "")
    return read.select("file", "line", F.when(F.col("line.begin") == 0, F.regexp_replace(marked, "^\ufeff", "")).otherwise(marked).alias("text"))


#: How compressed files begin.
PACKED = {b"\x1f\x8b": gzip.open, b"BZh": bz2.open, b"\xfd7zXZ\x00": lzma.open}
#: Characters of lines that are handed on at a time.
PIECE = 1 << 22


def unpacked(content: bytes) -> io.BufferedReader:
    """The content of a gzip, bzip2 or xz file as a stream; others as they are."""
    return io.BufferedReader(next((f(io.BytesIO(content)) for head, f in PACKED.items() if content.startswith(head)), io.BytesIO(content)))


def _pieces(lines: Iterator[str]) -> Iterator[list[str]]:
    piece, size = [], 0
    for line in lines:
        piece.append(line)
        size += len(line)
        if size >= PIECE:
            yield piece
            piece, size = [], 0
    if piece:
        yield piece


def _converted(files: DataFrame, convert) -> DataFrame:
    """Lines that ``convert`` (a stream of bytes to lines) makes of each file, compressed or not. Of a file a task holds its bytes as they lie there, and a piece of its lines."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        csv.field_size_limit(2**31 - 1)
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                n = 0
                for lines in _pieces(convert(unpacked(content))):
                    yield pd.DataFrame({"file": name, "line": range(n, n + len(lines)), "text": lines})
                    n += len(lines)

    return files.select("path", "content").mapInPandas(run, "file string, line int, text string")


def tsv_lines(spark: SparkSession, path: str, separator: str = "\t") -> DataFrame:
    """Tables, in UTF-16 with a byte order mark or UTF-8: rows ``@key`` or ``$key`` first, then a header with one column ``i``, then records."""

    def convert(content: io.BufferedReader) -> Iterator[str]:
        encoding = "utf-16" if content.peek(2)[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-8-sig"
        header = None
        for row in csv.reader(io.TextIOWrapper(content, encoding, newline=""), delimiter=separator):
            cells = [re.sub(r"[\r\n]+", " ", c.strip()) for c in row]
            if header is None:
                if cells and cells[0][:1] in ("@", "$"):
                    yield f"{cells[0]}={cells[1] if len(cells) > 1 else ''}"
                elif any(cells):
                    header = cells
                    if header.count("i") != 1:
                        raise ValueError("the header needs one column i")
            elif any(cells):
                cells += [""] * (len(header) - len(cells))
                yield "i" + cells[header.index("i")]
                for name, cell in zip(header, cells, strict=False):
                    if name.startswith(("!", "+")):
                        yield name[0] + cell  # empty ones keep the numbers of the segments
                    elif cell and name.startswith("#"):
                        yield f"{name}={cell}"
                    elif cell and name != "i":
                        yield name + cell

    return _converted(spark.read.format("binaryFile").load(path), convert)


def xml_lines(spark: SparkSession, path: str) -> DataFrame:
    """Feeds of entries: ``meta`` and ``opt`` (with ``type``), then ``entry`` with ``id``, ``title``, ``link`` and ``data`` of ``vector``s (``count``), ``snippet``s, ``attr``s (``type``) and ``fss``. Namespaces aren't looked at."""

    def convert(content: io.BufferedReader) -> Iterator[str]:
        local = lambda e: e.tag.rpartition("}")[2]
        flat = lambda e: re.sub(r"\s*[\r\n]+\s*", " ", "".join(e.itertext())).strip()
        for _, element in ElementTree.iterparse(content):
            kind = local(element)
            if kind in ("meta", "opt"):
                yield f"{'@' if kind == 'meta' else '$'}{element.get('type')}={flat(element)}"
            elif kind == "entry":
                ids = [flat(e) for e in element.iter() if local(e) == "id"]
                yield "i" + ids[0]
                for e in element.iter():
                    kind = local(e)
                    if kind == "title":
                        yield f"#title={flat(e)}"
                    elif kind == "link":
                        yield f"#link={e.get('href') or flat(e)}"
                    elif kind == "attr":
                        yield f"#{e.get('type')}={flat(e)}"
                    elif kind == "vector":
                        yield f"{int(e.get('count') or 1)} {flat(e)}"
                    elif kind == "snippet":
                        yield "b1" + flat(e)
                    elif kind == "fss":
                        yield "!" + flat(e)
                element.clear()

    return _converted(spark.read.format("binaryFile").load(path), convert)


def corpus_from_lines(lines: DataFrame, properties: tuple[str, ...] = ("title", "link"), max_words: int | None = None) -> Corpus:
    """A corpus from record lines. Rows are numbered from 1 by first appearance, words are their own ids.

    Of records with one id the first wins. Words of a record are summed up; ``max_words`` keeps its first ones, before the sum. Repeated properties are
    joined in order, undeclared ones ignored. ``#body=`` is text for words and a segment. Malformed lines are an error.
    """
    for p in properties:
        if not re.fullmatch(PROPERTY, p):
            raise ValueError(f"not a property name: {p!r}")
    wrong = F.when(~F.col("text").rlike(KINDS), F.col("text"))
    files = written(lines.groupBy("file").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("size"), F.min(wrong).alias("wrong")), "files")
    bad = files.where("wrong is not null").limit(1).collect()
    if bad:
        raise ValueError(f"malformed line in {bad[0].file}: {bad[0].wrong[:80]!r}")
    large = files.where((F.col("n") > FILE_LINES) | (F.col("size") > FILE_CHARS)).select("file")
    large = None if large.isEmpty() else written(large, "large-files")
    starts = F.col("text").rlike("^i")
    heads = written(lines.where(starts).select("file", "line", F.substring("text", 2, 1 << 30).alias("name")), "records")
    first = heads.groupBy("name").agg(F.min(F.struct("file", "line")).alias("at")).select("name", "at.*")
    ids = written(numbered(first, ["file", "line"], "row"), "ids")
    # Where a record begins: its row, 0 for those whose name is taken.
    marks = heads.select("file", "line").join(ids.select("file", "line", "row"), ["file", "line"], "left").select("file", "line", F.coalesce("row", F.lit(0)).alias("__mark"), F.lit(None).cast("string").alias("text"))
    marks = written(marks, "marks")

    def placed(kind: Column) -> DataFrame:
        """Lines of a kind with the row of their record, null before the first."""
        own = lines.where(~starts & kind).select("file", "line", F.lit(None).cast("long").alias("__mark"), "text")
        return latest(own.unionByName(marks), "__mark", ["line"], "row", ("file",), large).where("__mark is null").drop("__mark")

    info = placed(F.col("text").rlike("^[@$]")).where("row is null").select("file", "line", F.regexp_extract("text", r"^[@$]([^=]+)=", 1).alias("key"), F.regexp_extract("text", r"^[^=]+=(.*)$", 1).alias("value"))
    info = info.where(~F.col("key").isin(*RESERVED) & ~F.startswith("key", F.lit("stat."))).groupBy("key").agg(F.max_by("value", F.struct("file", "line")).alias("value"))
    body = F.col("text").rlike("^#body=")
    raw = placed(body | F.col("text").rlike("^(?:b1| |[1-9])")).where("row > 0")
    text = F.when(body, F.substring("text", 7, 1 << 30)).when(F.startswith("text", F.lit("b1")), F.substring("text", 3, 1 << 30))
    word = F.when(text.isNull(), F.regexp_extract("text", r"^[0-9]* (.*)$", 1))
    times = F.greatest(F.coalesce(F.try_to_number(F.regexp_extract("text", "^([0-9]+) ", 1), F.lit("9" * 18)).cast("long"), F.lit(1)), F.lit(1))
    raw = raw.select("file", "row", "line", nfkc(text).alias("told"), word.alias("word"), F.when(text.isNull(), times).otherwise(F.lit(1)).alias("times"))
    found = F.when(F.col("word").isNotNull(), F.array("word")).otherwise(words(F.col("told")))
    if max_words is None:
        elements = counted(raw, found, "file", "row", "times")
    else:  # no line holds more of a record's first words
        each = raw.select("file", "row", "line", "times", F.posexplode(F.slice(found, 1, max_words)).alias("k", "col")).withColumn("tf", F.lit(1))
        elements = each.withColumn("n", F.row_number().over(Window.partitionBy("file", "row").orderBy("line", "k"))).where(F.col("n") <= max_words)
    # Sorted by row and summed in that order: no table of all pairs in memory, and a join by row needs no other shuffle.
    elements = elements.select("row", "col", (F.col("tf") * F.col("times")).alias("tf")).repartition("row")
    same = Window.partitionBy("row", "col").orderBy("tf").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nth = F.row_number().over(Window.partitionBy("row", "col").orderBy("tf"))
    postings = elements.select("row", "col", F.sum("tf").over(same).alias("tf"), nth.alias("__nth")).where("__nth = 1").drop("__nth")
    named = placed(F.col("text").rlike("^#") & ~body).where("row > 0").select("row", "line", F.regexp_extract("text", "^#([^=]+)=", 1).alias("key"), F.regexp_extract("text", "^[^=]+=(.*)$", 1).alias("value"))
    joined = named.where(F.col("key").isin(*properties)).groupBy("row", "key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "value"))), lambda x: x["value"]), "").alias("value"))
    props = joined.where("value <> ''").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("props"))
    rows = ids.select("row", "name").join(props, "row", "left").withColumn("props", F.coalesce("props", F.create_map().cast("map<string,string>")))
    cut = placed(body | F.col("text").rlike("^[!+]")).where("row > 0")
    kept = F.when(F.startswith("text", F.lit("+")), F.substring("text", 2, 1 << 30)).otherwise(nfkc(F.when(body, F.substring("text", 7, 1 << 30)).otherwise(F.substring("text", 2, 1 << 30))))
    segments = cut.select("row", (F.row_number().over(Window.partitionBy("file", "row").orderBy("line")) - 1).alias("segid"), kept.alias("text"))
    return Corpus(postings, rows, segments, info)


def sampled(lines: DataFrame, interval: int, offset: int) -> DataFrame:
    """Every ``interval``-th record, by its number in the file."""
    counted = running_total(lines, F.col("text").rlike("^i").cast("long"), ["line"], "record", ("file",))
    return counted.where((F.col("record") == 0) | (F.pmod(F.col("record") - 1, F.lit(interval)) == offset)).drop("record")


def segment_counts(corpus: Corpus) -> DataFrame:
    """How many documents have how many segments: more than one row hints at misaligned records."""
    return corpus.segments.groupBy("row").count().groupBy(F.col("count").alias("n_segments")).agg(F.count("*").alias("n_rows"))


def to_lines(corpus: Corpus) -> DataFrame:
    """A corpus as record lines, ``row``, ``part``, ``text``; in this order they read back as the same corpus."""
    plain = corpus.postings.select("row", F.lit(3).alias("part"), F.col("col").alias("k"), F.concat(F.col("tf").cast("string"), F.lit(" "), F.col("col")).alias("text"))
    names = corpus.rows.select("row", F.lit(1).alias("part"), F.lit("").alias("k"), F.concat(F.lit("i"), "name").alias("text"))
    props = corpus.rows.select("row", F.explode("props").alias("key", "value")).select("row", F.lit(2).alias("part"), F.col("key").alias("k"), F.concat(F.lit("#"), "key", F.lit("="), "value").alias("text"))
    out = names.unionByName(props).unionByName(plain)
    if corpus.segments is not None:
        out = out.unionByName(corpus.segments.select("row", F.lit(4).alias("part"), F.lpad(F.col("segid").cast("string"), 2, "0").alias("k"), F.concat(F.lit("+"), "text").alias("text")))
    return out


def _quoted(name: Column) -> Column:
    """A JSON string. Letters and digits need no escapes, so that most names needn't go through a JSON writer each."""
    written_out = F.to_json(F.array(name))
    return F.when(name.isNull() | name.rlike(r"[^\p{L}\p{N}]"), written_out.substr(F.lit(2), F.length(written_out) - 2)).otherwise(F.concat(F.lit('"'), name, F.lit('"')))


def vector_literal(found: DataFrame, value: str = "tf") -> DataFrame:
    """``query`` and ``vector``: ``[["name",n],...]`` by name."""
    pairs = F.transform(F.sort_array(F.collect_list(F.struct(F.col("id").cast("string").alias("name"), F.col(value).cast("string").alias("n")))), lambda x: F.concat(F.lit("["), _quoted(x["name"]), F.lit(","), x["n"], F.lit("]")))
    return found.groupBy("query").agg(F.concat(F.lit("["), F.array_join(pairs, ","), F.lit("]")).alias("vector"))


def parse_vectors(vectors: DataFrame, column: str = "vector") -> DataFrame:
    """``query``, ``id``, ``tf`` of vector literals; a name given twice is summed up."""
    pairs = vectors.select("query", F.explode(F.from_json(column, "array<array<string>>")).alias("pair"))
    return pairs.groupBy("query", F.col("pair")[0].alias("id")).agg(F.sum(F.col("pair")[1].cast("long")).alias("tf"))


def result_xml(found: DataFrame, rows: DataFrame | None = None, props: tuple[str, ...] = ("title", "link")) -> DataFrame:
    """``query`` and ``xml`` of a result: its items in order, scores in scientific form, in an envelope with the status and the total.

    With ``rows`` (of the corpus) items carry their names and the listed properties they have.
    """

    def clean(c):
        for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            c = F.replace(c, F.lit(mark), F.lit(entity))
        return c

    own, more = F.col("id").cast("string"), F.lit("")
    if rows is not None:
        found = found.join(rows.select(F.col("row").alias("id"), F.col("name").alias("__name"), "props"), "id", "left")
        own = F.coalesce("__name", own)
        for p in props:
            more = F.concat(more, F.coalesce(F.concat(F.lit(f' {p}="'), clean(F.col("props")[p]), F.lit('"')), F.lit("")))
    item = F.concat(F.lit('<item name="'), clean(own), F.lit('"'), more, F.format_string(' score="%e" TFd="%d" DFd="%d"/>', "score", "tf_d", "df_d"))
    items = F.transform(F.sort_array(F.collect_list(F.struct("rank", item.alias("item")))), lambda x: x["item"])
    return found.groupBy("query").agg(F.concat(F.lit('<result status="OK" total="'), F.first("total").cast("string"), F.lit('">'), F.array_join(items, ""), F.lit("</result>")).alias("xml"))
