"""Documents to typed elements, and what is derived from the order of elements.

Lines are classified by column expressions; title paths, sections and neighbours are windows over a document's lines, so a
document is the unit of work and no state machine is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.chunking import lines

# Line patterns.
TITLE, LIST, IMAGE = r"^(#{1,6})\s+(.+)$", r"^([-*+]|\d+\.)\s+", r"^!\[.*?\]\(.+?\)$"
CAPTION = r"(?i)^(table|figure|fig\.|图|表)\s*[-:：]?\s*\S+"


def line_kind(line: Column) -> Column:
    """Kind of a trimmed line that is not empty."""
    return (
        F.when(line.startswith("|") & line.endswith("|"), "table")
        .when(line.rlike(TITLE), "title")
        .when(line.rlike(LIST), "list")
        .when(line.startswith("```"), "code")
        .when(line.rlike(IMAGE), "image")
        .otherwise("paragraph")
    )


def element_text(kind: Column, line: Column) -> Column:
    return F.when(kind == "title", F.trim(F.regexp_extract(line, TITLE, 2))).when(kind == "list", F.regexp_replace(line, LIST, "")).otherwise(line)


def elements(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, seq (from 0), type, text, markdown, level, title_path of every element, in document order.

    Table lines that follow each other are one element; a blank line ends a table. A title's path holds the titles open at it.
    """
    rows = docs.select(docs[id_col].alias("id"), F.posexplode(lines(docs[text_col])).alias("at", "raw")).withColumn("line", F.btrim("raw", F.lit(" \t\n\r\f\x0b")))
    order = Window.partitionBy("id").orderBy("at")
    rows = rows.withColumn("kind", F.when(F.col("line") == "", "blank").otherwise(line_kind(F.col("line"))))
    rows = rows.withColumn("joins", (F.col("kind") == "table") & (F.lag("kind").over(order) == "table"))
    rows = rows.withColumn("element", F.sum(F.when(F.coalesce("joins", F.lit(False)), 0).otherwise(1)).over(order)).where("kind <> 'blank'")
    whole = rows.groupBy("id", "element").agg(F.first("kind").alias("type"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("markdown"))
    whole = whole.withColumn("level", F.when(F.col("type") == "title", F.length(F.regexp_extract("markdown", TITLE, 1))))
    whole = whole.withColumn("text", F.when(F.col("type") == "table", table_text(F.col("markdown"))).otherwise(element_text(F.col("type"), F.col("markdown"))))
    return with_title_path(whole.withColumn("seq", F.row_number().over(Window.partitionBy("id").orderBy("element")) - 1)).select("id", "seq", "type", "text", "markdown", "level", "title_path")


def with_title_path(rows: DataFrame) -> DataFrame:
    """Adds title_path: the titles open at a row, joined by '/'.

    A title of level L keeps at most L - 1 open titles and stands after them, so the n-th title's depth is the least of n and of
    L_j + (n - j) over the titles j up to it: a running minimum. A title is open until one of its depth or less follows.
    """
    so_far = Window.partitionBy("id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("n", F.sum(F.when(F.col("level").isNotNull(), 1).otherwise(0)).over(so_far))
    rows = rows.withColumn("depth", F.when(F.col("level").isNotNull(), F.col("n") + F.least(F.lit(0), F.min(F.col("level") - F.when(F.col("level").isNotNull(), F.col("n"))).over(so_far))))
    for depth in range(1, 7):
        here = F.when(F.col("depth") == depth, F.struct(F.col("seq").alias("seq"), F.col("text").alias("title")))
        rows = rows.withColumn(f"t{depth}", F.last(here, ignorenulls=True).over(so_far))
    open_, latest = [], F.lit(-1)
    for depth in range(1, 7):
        t = F.col(f"t{depth}")
        open_.append(F.when(t.isNotNull() & (t["seq"] > latest), t["title"]))
        latest = F.greatest(latest, F.coalesce(t["seq"], F.lit(-1)))
    return rows.withColumn("title_path", F.array_join(F.filter(F.array(*open_), lambda x: x.isNotNull()), "/")).drop("n", "depth", *[f"t{d}" for d in range(1, 7)])


def cells(line: Column) -> Column:
    return F.transform(F.split(F.btrim(line, F.lit("|")), r"\|"), lambda c: F.trim(c))


def table_text(markdown: Column) -> Column:
    """A table's cells, rows on lines; empty and dash cells left out."""
    row = lambda line: F.array_join(F.filter(cells(line), lambda c: (c != "") & ~c.rlike(r"^-+$")), " | ")
    return F.array_join(F.filter(F.transform(F.split(markdown, "\n"), row), lambda r: r != ""), "\n")


def table_fields(markdown: Column) -> Column:
    return F.filter(cells(F.split(markdown, "\n")[0]), lambda c: c != "")


def table_rows(markdown: Column) -> Column:
    """Array of maps from field to cell, a row each; missing cells are empty, rule lines are no rows."""
    fields = table_fields(markdown)
    body = F.filter(F.transform(F.slice(F.split(markdown, "\n"), 2, 1 << 30), cells), lambda r: F.exists(r, lambda c: ~c.rlike(r"^[-: ]*$")))
    return F.transform(body, lambda r: F.map_from_arrays(fields, F.transform(fields, lambda _, i: F.coalesce(F.get(r, i), F.lit("")))))


def is_caption(text: Column) -> Column:
    return F.trim(text).rlike(CAPTION)


def neighbours(rows: DataFrame, key: str = "id", order: str = "seq", value: str = "text") -> DataFrame:
    """Adds previous and next: the value of the rows before and after in their document."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("previous", F.lag(value).over(w)).withColumn("next", F.lead(value).over(w))


def sections(rows: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """Adds section: a number that grows at every title of level 1 or 2."""
    breaks = F.when((F.col("type") == "title") & (F.col("level") <= 2), 1).otherwise(0)
    return rows.withColumn("section", F.sum(breaks).over(Window.partitionBy(key).orderBy(order)))


def repeated_lines(pages: DataFrame, key: str = "doc_id", page: str = "page", text: str = "text") -> DataFrame:
    """pages without running heads: the first or last line (80 characters at most) that stands on at least max(2, 60 %) of a
    document's text pages, if it has four of those, goes wherever it stands."""
    rows = pages.select(key, page, F.posexplode(F.transform(F.split(text, "\n"), lambda x: F.trim(x))).alias("at", "line")).where("line <> ''")
    edge = rows.groupBy(key, page).agg(F.min_by("line", "at").alias("head"), F.max_by("line", "at").alias("foot"))
    totals = edge.groupBy(key).agg(F.count(F.lit(1)).alias("pages")).where("pages >= 4")
    seen = edge.select(key, page, F.explode(F.array_distinct(F.array("head", "foot"))).alias("line")).where(F.length("line") <= 80).groupBy(key, "line").agg(F.count(F.lit(1)).alias("n"))
    common = seen.join(totals, key).where(F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("pages") * 0.6))).select(key, "line")
    kept = rows.join(common, [key, "line"], "left_anti")
    return kept.groupBy(key, page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias(text))


def assign_parents(parts: DataFrame, parents: DataFrame) -> DataFrame:
    """part_id, parent_id: among a document's parents with the part's title path, the first whose pages overlap, else the first;
    without such a title, the document's last parent. parts: doc_id, part_id, title_path, page_start, page_end; parents: doc_id,
    parent_id, ord, title_path, page_start, page_end. An equi-join on the document; the page test is a residual condition."""
    p, q = parts.alias("p"), parents.alias("q")
    titled = (F.col("p.title_path") != "") & (F.col("p.title_path") == F.col("q.title_path"))
    overlap = (F.col("q.page_start") <= F.coalesce("p.page_end", "p.page_start")) & (F.col("p.page_start") <= F.coalesce("q.page_end", "q.page_start"))
    rank = F.when(titled & F.coalesce(overlap, F.lit(False)), F.struct(F.lit(0).alias("r"), F.col("q.ord").alias("o"))).when(titled, F.struct(F.lit(1).alias("r"), F.col("q.ord").alias("o"))).otherwise(F.struct(F.lit(2).alias("r"), (-F.col("q.ord")).alias("o")))
    return p.join(q, F.col("p.doc_id") == F.col("q.doc_id")).groupBy(F.col("p.doc_id").alias("doc_id"), "part_id").agg(F.min_by("q.parent_id", rank).alias("parent_id"))


def parent_by_page(images: DataFrame, parents: DataFrame) -> DataFrame:
    """doc_id, image_id, parent_id: the first parent whose pages hold the image's page, else the document's first."""
    inside = F.coalesce(F.col("page").between(F.col("page_start"), F.coalesce("page_end", "page_start")), F.lit(False))
    joined = images.join(parents, "doc_id")
    return joined.groupBy("doc_id", "image_id").agg(F.min_by("parent_id", F.struct((~inside).alias("miss"), F.col("ord"))).alias("parent_id"))
