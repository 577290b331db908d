"""Markdown split at its headers, with the headers that are open at each section.

The header stack is a column: per level the last header so far, which counts only if no higher header came after it. Sections and stacks are
windows over a document's lines; no text is walked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.chunking import CHILD_CHARS, CHILD_OVERLAP, fixed_windows

# Levels that split, and what joins a section's lines.
LEVELS, JOINT = 4, "  \n"
BLANKS = " \t\r\f\x0b"
HEADER, FENCE = r"^(#{1,4})(?: (.*))?$", r"^(?:```|~~~)"


def header_sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, seq (from 0), h1 to h4 (null where none is open) and content of each section; lines are stripped and blank ones go.

    Lines in fenced code are no headers. A header without text of its own, whose next line is a lower header, begins that one's section.
    """
    rows = docs.select(docs[id_col].alias("id"), F.posexplode(F.split(F.coalesce(docs[text_col], F.lit("")), "\n", -1)).alias("at", "raw"))
    rows = rows.select("id", (F.col("at") + 1).alias("at"), F.btrim("raw", F.lit(BLANKS)).alias("line")).where("line <> ''")
    so_far = Window.partitionBy("id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    fenced = F.col("line").rlike(FENCE)
    rows = rows.withColumn("code", fenced | (F.sum(F.when(fenced, 1).otherwise(0)).over(so_far) % 2 == 1))
    rows = rows.withColumn("level", F.when(~F.col("code") & F.col("line").rlike(HEADER), F.length(F.regexp_extract("line", HEADER, 1))))
    rows = rows.withColumn("title", F.when(F.col("level").isNotNull(), F.trim(F.regexp_extract("line", HEADER, 2))))
    last = {}
    for level in range(1, LEVELS + 1):
        own = F.when(F.col("level") == level, F.struct("at", "title"))
        last[f"_{level}"] = F.last(own, ignorenulls=True).over(so_far)
    rows = rows.withColumns(last)
    higher, stack = F.lit(0), {}
    for level in range(1, LEVELS + 1):
        at = F.coalesce(F.col(f"_{level}.at"), F.lit(0))
        stack[f"h{level}"] = F.when(at > higher, F.col(f"_{level}.title"))
        higher = F.greatest(higher, at)
    before = F.lag("level").over(Window.partitionBy("id").orderBy("at"))
    begins = F.col("level").isNotNull() & ~F.coalesce(before < F.col("level"), F.lit(False))
    rows = rows.withColumns(stack).withColumn("section", F.sum(F.when(begins, 1).otherwise(0)).over(so_far))
    names = [f"h{level}" for level in range(1, LEVELS + 1)]
    whole = rows.groupBy("id", "section").agg(*[F.max_by(h, "at").alias(h) for h in names], F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), JOINT).alias("content"))
    seq = F.row_number().over(Window.partitionBy("id").orderBy("section")) - 1
    return whole.select(F.col("id").alias(id_col), seq.alias("seq"), *names, "content")


def header_chunks(docs: DataFrame, size: int = CHILD_CHARS, overlap: int = CHILD_OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sections cut into windows of at most `size` characters: id_col, seq, part, h1 to h4, content."""
    rows = header_sections(docs, id_col, text_col)
    names = [c for c in rows.columns if c != "content"]
    return rows.select(*names, F.posexplode(fixed_windows(F.col("content"), size, overlap)).alias("part", "content"))
