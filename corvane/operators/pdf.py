"""Rules over text and geometry that a PDF reader delivers; reading itself is a hook."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.chunking import lines

# Weights of the quality score and the bounds of the choice.
PRINTABLE, LETTERS, LONG_LINES = 0.45, 0.45, 0.10
GOOD, BETTER = 0.72, 0.08
NUMBERED_TITLE = r"^(?:\d+(?:\.\d+)*|第.+[章节])\s+"


def text_quality(text: Column) -> Column:
    """0 to 1: shares of printable and of letter or digit characters, and of lines longer than a character; 0 below 20 characters."""
    said = F.regexp_replace(text, r"(?U)\s+", "")
    n = F.length(said)
    rows = F.filter(F.transform(lines(F.trim(text)), lambda r: F.trim(r)), lambda r: r != "")
    single = F.when(F.size(rows) > 0, F.size(F.filter(rows, lambda r: F.length(r) <= 1)) / F.size(rows)).otherwise(0.0)
    printable = 1 - F.regexp_count(said, F.lit(r"[\p{C}\p{Z}]")) / n
    letters = F.regexp_count(said, F.lit(r"[\p{L}\p{N}]")) / n
    score = printable * PRINTABLE + letters * LETTERS + (1 - single) * LONG_LINES
    return F.when((F.length(F.trim(text)) < 20) | (n == 0), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)))


def chosen_text(plain: Column, layout: Column) -> Column:
    """The text in layout order where the plain one is poor, or clearly poorer."""
    p, q = text_quality(plain), text_quality(layout)
    return F.when((layout != "") & ((p < GOOD) | ((q > p + BETTER) & (F.lower(layout) != F.lower(plain)))), layout).otherwise(plain)


def promoted(text: Column) -> Column:
    """Lines trimmed, empty ones out; short lines in capitals or with a number in front become headings."""
    rows = F.filter(F.transform(lines(text), lambda r: F.trim(r)), lambda r: r != "")
    upper = lambda r: (r == F.upper(r)) & (r != F.lower(r))
    title = lambda r: (F.length(r) <= 100) & ~r.rlike(r"[.!?。！？]$") & (upper(r) | r.rlike(NUMBERED_TITLE))
    return F.array_join(F.transform(rows, lambda r: F.when(title(r), F.concat(F.lit("## "), r)).otherwise(r)), "\n")


def title_at(elements: DataFrame, offsets: DataFrame) -> DataFrame:
    """doc_id, offset, title_path: the last title path whose element begins before the offset of the joined text (elements joined by
    two line ends), else the document's first. elements: doc_id, seq, size, title_path."""
    w = Window.partitionBy("doc_id").orderBy("seq")
    placed = elements.withColumn("ends", F.sum(F.col("size") + 2).over(w))
    joined = offsets.join(placed, "doc_id").groupBy("doc_id", "offset").agg(
        F.max_by(F.when((F.col("ends") <= F.col("offset")) & (F.col("title_path") != ""), F.col("title_path")), F.when((F.col("ends") <= F.col("offset")) & (F.col("title_path") != ""), F.col("seq"))).alias("last"),
        F.min_by("title_path", F.when(F.col("title_path") != "", F.col("seq"))).alias("first"),
    )
    return joined.select("doc_id", "offset", F.coalesce("last", "first", F.lit("")).alias("title_path"))
