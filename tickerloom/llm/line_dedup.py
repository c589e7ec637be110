"""Lines that repeat across documents, kept once.

Only hashes of lines move, not lines.  They are dealt by range of (hash, document) and
sorted by (hash, document, position), so that the documents of a line follow one another and
a line that is very common spreads over many tasks.  Occurrences stream by in that order and
only the first one of a line in a document goes on.  Each range counts a line's documents and
notes its last one; lines that cross a border between ranges are merged.  What comes back is
a run-length bitmap for each document with a dropped line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.plans.stored import stored

MIN_DOCS = 3
MIN_CHARS = 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANKS = " \t\n\x0b\f\r"


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case and nothing else; plain ASCII takes the short way."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, _UPPER, _LOWER))


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """Two hashes, document, copy and position of every line that may be dropped."""
    line = docs.select("doc", "copy", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select(
        "doc", "copy", "pos", F.trim("line", F.lit(_BLANKS)).alias("line")).filter(F.char_length("line") >= min_chars)
    key = ascii_lower(F.col("line"))
    return line.select(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"), "doc", "copy", "pos")


def first_occurrences(lines: DataFrame, parts: int) -> DataFrame:
    """``h1``, ``h2`` and ``doc`` of the first occurrence of each line in each document, in order.

    The window's keys are those of the ranges: rows are sorted where they lie and move no second time.
    """
    dealt = lines.select("h1", "h2", "doc", "pos").repartitionByRange(parts, "h1", "h2", "doc")
    place = F.row_number().over(Window.partitionBy("h1", "h2", "doc").orderBy("pos"))
    return dealt.withColumn("place", place).filter("place = 1").select("h1", "h2", "doc")


def dropped_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """``doc``, ``copy`` (a hash of the text) and ``runs`` of each document that loses lines.

    ``runs`` is the keep bitmap in run lengths: lines kept, dropped, kept, and so on, the
    first of which may be 0.  A null text has one empty line and loses none; a null id counts
    as the smallest; rows of one id are one document, with a bitmap for each text; no rows give
    none; other columns are not read.
    """
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-2 ** 63)).alias("doc"),
                         F.xxhash64(text_col).alias("copy"), F.coalesce(text_col, F.lit("")).alias("text"))
    lines = stored(_lines(source, min_chars), "lines")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    common = first_occurrences(lines, parts).groupBy("h1", "h2").agg(
        F.count("doc").alias("docs"), F.max("doc").alias("last")).filter(F.col("docs") >= min_docs).drop("docs")
    # A written table is a plain side of the join: Spark knows its size and can split a hot line.
    common = stored(common, "common_lines")
    gone = lines.join(common, ["h1", "h2"]).filter("doc <> last").select("doc", "copy", "pos").distinct()
    totals = source.select("doc", "copy", (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
                                           + 1).alias("n")).distinct()
    places = gone.groupBy("doc", "copy").agg(F.array_sort(F.collect_list("pos")).alias("p")).join(totals, ["doc", "copy"])
    return places.select("doc", "copy", F.expr("""
        concat(array(0), flatten(zip_with(
            filter(p, (x, i) -> i = 0 OR get(p, i - 1) <> x - 1),
            transform(filter(p, (x, i) -> i = size(p) - 1 OR get(p, i + 1) <> x + 1), x -> x + 1),
            (a, b) -> array(a, b))), array(n))""").alias("edges")).select("doc", "copy", F.expr(
                "transform(sequence(0, size(edges) - 2), i -> get(edges, i + 1) - get(edges, i))").alias("runs"))


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """``docs`` with the text that stays, and ``line_runs``, null where no line goes.

    Texts are split at line feeds.  A line is compared without blanks at its ends and with
    A-Z in lower case; one of at least ``min_chars`` code points that at least ``min_docs``
    documents hold goes everywhere but in the largest id that holds it, where all its
    repeats stay.  Null and empty texts are one empty line and become empty texts.  Rows of
    one id are one document; a row without id counts as a document below all others.  No
    rows give no rows.  A column named ``line_runs`` is replaced.
    """
    runs = dropped_lines(docs, min_docs, min_chars, id_col, text_col).select(
        F.col("doc").alias("__doc"), F.col("copy").alias("__copy"), F.col("runs").alias("__runs"))
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(-2 ** 63))
    flags = F.expr("flatten(transform(`__runs`, (r, i) -> array_repeat(i % 2 = 0, r)))")
    lines = F.zip_with(F.split(text_col, "\n"), flags, lambda line, keep: F.when(keep, line))
    kept = F.when(F.col("__runs").isNull(), F.coalesce(text_col, F.lit(""))).otherwise(F.array_join(lines, "\n"))
    joined = docs.join(runs, (doc == F.col("__doc")) & (F.xxhash64(text_col) == F.col("__copy")), "left")
    return joined.withColumns({text_col: kept, "line_runs": F.col("__runs")}).drop("__doc", "__copy", "__runs")
