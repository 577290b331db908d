"""From boxes on pages to elements in reading order.

A page's boxes are cut recursively at white gaps: a region is parted where no box lies across a strip as wide as a gap, first from left to
right, else from top to bottom, until no region can be parted. A page's boxes are one row. Each round is a running maximum over the regions' boxes in the order of one axis,
so that all pages of an Arrow batch are cut at once; the number of rounds is the depth of the deepest page, not a number of pages. Lines are anchored groups: a box belongs to the line of the last
anchor unless it lies lower by more than a tolerance; then it is the next anchor. Coordinates are finite, or null, and those of a page whose origin is at the lower left.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from corvane.storage import light_batches, stored

# Bounds of figures on a page, least tolerance of a line, shares of the average width.
LEAST_SHARE, LEAST_SIDE, LEAST_TOLERANCE = 0.02, 20.0, 3.0
TOLERANCE_SHARE, BLANK_SHARE = 0.8, 0.9
UPPER, LOWER, LEFT, RIGHT = 0.66, 0.33, 0.33, 0.66
#: White strips that part columns, and paragraphs; a title's letters are so much higher than the document's usual ones.
GAP_X, GAP_Y, TITLE_RATIO = 12.0, 8.0, 1.3
PAGE, SIDES = ["doc_id", "page"], ["left", "bottom", "right", "top"]


def area_share(boxes: DataFrame) -> DataFrame:
    """doc_id, page, image_area: the share of the page that boxes of kind image cover, overlaps counted twice. boxes also have page_width and page_height."""
    area = F.abs((F.col("right") - F.col("left")) * (F.col("top") - F.col("bottom")))
    page = F.first("page_width") * F.first("page_height")
    return boxes.groupBy(*PAGE).agg(F.when(page > 0, F.sum(F.when(F.col("kind") == "image", area).otherwise(0.0)) / page).otherwise(0.0).alias("image_area"))


def eligible(boxes: DataFrame, least: float = LEAST_SHARE) -> DataFrame:
    """Images, and vectors (kinds path, shading, form) of some width and height, that cover a share of their page."""
    w, h = F.abs(F.col("right") - F.col("left")), F.abs(F.col("top") - F.col("bottom"))
    share = w * h / F.greatest(F.lit(1.0), F.col("page_width") * F.col("page_height"))
    vector = F.col("kind").isin("path", "shading", "form") & (w >= LEAST_SIDE) & (h >= LEAST_SIDE)
    return boxes.where(((F.col("kind") == "image") | vector) & (share >= least))


def position() -> Column:
    """Where a box's middle lies on its page: top, middle or bottom, and left, center or right."""
    x, y = (F.col("left") + F.col("right")) / 2, (F.col("bottom") + F.col("top")) / 2
    up = F.when(y >= F.col("page_height") * UPPER, "top").when(y <= F.col("page_height") * LOWER, "bottom").otherwise("middle")
    return F.concat_ws("_", up, F.when(x <= F.col("page_width") * LEFT, "left").when(x >= F.col("page_width") * RIGHT, "right").otherwise("center"))


def with_lines(boxes: DataFrame, by: list[str], tolerance: Column | None = None) -> DataFrame:
    """Adds line (from 0, from the top) within each group `by`. tolerance: an aggregate over a group; by default from the average width.

    Whether a box starts a line depends on the last that did, so a group's heights are walked in one array: a page's worth of numbers.
    """
    y = (F.col("bottom") + F.col("top")) / 2
    tolerance = tolerance if tolerance is not None else F.greatest(F.lit(LEAST_TOLERANCE), F.avg(F.greatest(F.lit(0.1), F.col("right") - F.col("left"))) * TOLERANCE_SHARE)
    others = [c for c in boxes.columns if c not in by]
    groups = boxes.groupBy(*by).agg(F.collect_list(F.struct(*others)).alias("boxes"), F.reverse(F.array_sort(F.collect_set(y))).alias("ys"), tolerance.alias("tolerance"))

    def step(acc: Column, at: Column) -> Column:
        new = F.element_at(acc, -1) - at > F.col("tolerance")
        return F.when(new, F.concat(acc, F.array(at))).otherwise(acc)

    anchors = groups.select(*by, "boxes", F.aggregate(F.slice("ys", 2, F.size("ys")), F.slice("ys", 1, 1), step).alias("anchors"))
    line = lambda x: F.size(F.filter("anchors", lambda a: a >= (x["bottom"] + x["top"]) / 2)) - 1
    placed = F.transform("boxes", lambda x: F.struct(*[x[c].alias(c) for c in others], line(x).alias("line")))
    return anchors.select(*by, F.explode(placed).alias("box")).select(*by, "box.*").select(*boxes.columns, "line")


def line_texts(placed: DataFrame, by: list[str], blanks: bool = True, *also: Column) -> DataFrame:
    """by, line, text and what `also` aggregates: boxes from left to right. With blanks, a space stands where the gap to all earlier boxes is wide; else between all boxes."""
    order = Window.partitionBy(*by, "line").orderBy("left", "right", "text")
    reached = F.max("right").over(order.rowsBetween(Window.unboundedPreceding, -1))
    width = F.greatest(F.lit(1.0), F.avg(F.greatest(F.lit(0.1), F.col("right") - F.col("left"))).over(Window.partitionBy(*by, "line")))
    gap = F.coalesce(F.col("left") - reached > width * BLANK_SHARE, F.lit(False)) if blanks else reached.isNotNull()
    rows = placed.withColumn("at", F.row_number().over(order)).withColumn("said", F.concat(F.when(gap, " ").otherwise(""), F.col("text")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "said"))), lambda x: x["said"]), "")
    return rows.groupBy(*by, "line").agg(F.trim(joined).alias("text"), *also)


def page_text(boxes: DataFrame) -> DataFrame:
    """doc_id, page, text: a page of characters as lines, top to bottom; a character is a box without its blanks."""
    lines = line_texts(with_lines(boxes, PAGE), PAGE).where("text <> ''")
    return lines.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"))


def _strips(group: np.ndarray, a: np.ndarray, b: np.ndarray, gap: float) -> np.ndarray:
    """How many white strips lie before each span (a, b) within its group."""
    first, reach = np.where(np.isnan(a), -np.inf, a), np.where(np.isnan(b), -np.inf, b)
    order = np.lexsort((reach, first, group))
    ends, rank = np.unique(reach, return_inverse=True)
    g = group[order]
    farthest = ends[np.maximum.accumulate(g * len(ends) + rank[order]) - g * len(ends)]  # groups ascend, so each begins anew
    same = g[1:] == g[:-1]
    new = np.zeros(len(g), np.int64)
    new[1:] = same & np.isfinite(farthest[:-1]) & (a[order][1:] - farthest[:-1] >= gap)
    before = np.cumsum(new)
    starts = np.flatnonzero(np.append(True, ~same))
    out = np.empty(len(g), np.int64)
    out[order] = before - np.repeat(before[starts], np.diff(np.append(starts, len(g))))
    return out


def numbered(page: np.ndarray, left: np.ndarray, bottom: np.ndarray, right: np.ndarray, top: np.ndarray, gap_x: float = GAP_X, gap_y: float = GAP_Y) -> np.ndarray:
    """Each box's region, numbered from 0 in reading order, page by page. Every round parts all regions that are open; one that was whole in a round stays so."""
    region, at = np.unique(page, return_inverse=True)[1], np.arange(len(page))
    while len(at):
        own = region[at]
        part, parted = _strips(own, left[at], right[at], gap_x), np.zeros(region.max() + 1, bool)
        parted[own[part > 0]] = True
        rest = np.flatnonzero(~parted[own])
        if len(rest):
            part[rest] = _strips(own[rest], -top[at[rest]], -bottom[at[rest]], gap_y)
            parted[own[part > 0]] = True
        place = np.zeros(len(region), np.int64)
        place[at] = part
        region, at = np.unique(region * (place.max() + 1) + place, return_inverse=True)[1], at[parted[own]]
    return region


def _lined(region: np.ndarray, y: np.ndarray, tolerance: np.ndarray) -> np.ndarray:
    """Each box's line in its region: as `with_lines` has it, given every region's tolerance."""
    order, least = np.lexsort((-y, region)), np.maximum(tolerance, 0.0).tolist()
    lines, last, anchor, line = [], -1, 0.0, 0
    for r, at in zip(region[order].tolist(), y[order].tolist(), strict=True):
        if r != last:
            last, anchor, line = r, at, 0
        elif anchor - at > least[r]:
            anchor, line = at, line + 1
        lines.append(line)
    out = np.empty(len(y), np.int64)
    out[order] = lines
    return np.where(np.isnan(y), -1, out)


def _in_lines(region: np.ndarray, line: np.ndarray, left: np.ndarray, right: np.ndarray, text: pa.Array) -> np.ndarray:
    """The order of boxes by region and line, then left, right and text."""
    keys = [region, line, *(np.where(np.isnan(x), -np.inf, x) for x in (left, right))]
    order = np.lexsort(keys[::-1])
    tied = reduce(np.logical_and, (k[order][1:] == k[order][:-1] for k in keys))
    if tied.any():  # only now texts matter
        some = np.flatnonzero(np.append(tied, False) | np.append(False, tied))
        own = order[some]
        said = [b"" if t is None else b"x" + t.encode("utf-8", "surrogatepass") for t in text.take(pa.array(own)).to_pylist()]
        rank = np.unique(np.array(said, object), return_inverse=True)[1]
        order[some] = own[np.lexsort((rank, *(k[own] for k in keys[::-1])))]
    return order


def _sums(group: np.ndarray, x: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """The sum and the number of each group's values that are there."""
    there = ~np.isnan(x)
    return np.bincount(group[there], x[there], groups), np.bincount(group[there], minlength=groups)


def _cuts(ids: np.ndarray, groups: int) -> pa.Array:
    return pa.array(np.searchsorted(ids, np.arange(groups + 1)), pa.int32())


def paged(boxes: DataFrame) -> DataFrame:
    """doc_id, page and boxes, an array of all other columns: a page's boxes in one row, moved once."""
    return boxes.groupBy(*PAGE).agg(F.collect_list(F.struct(*[c for c in boxes.columns if c not in PAGE])).alias("boxes"))


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.StructArray, list[np.ndarray]]:
    """The place of each box's page in a batch of pages, the boxes, and their sides; a side that is null is NaN."""
    lists = batch.column(2)
    rows = lists.flatten()
    sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    named = dict(zip((f.name for f in rows.type), rows.flatten(), strict=True))
    return np.repeat(np.arange(batch.num_rows), sizes), rows, [pc.fill_null(named[c].cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False) for c in SIDES]


def regions(boxes: DataFrame, gap_x: float = GAP_X, gap_y: float = GAP_Y) -> DataFrame:
    """Adds region: a name whose order is the reading order of its page. Boxes move once, to their page."""
    pages = paged(boxes)
    light_batches(boxes.sparkSession)
    kinds = [(f.name, f.dataType) for f in pages.schema["boxes"].dataType.elementType]
    schema = StructType([pages.schema[c] for c in PAGE] + [StructField(n, t) for n, t in kinds] + [StructField("region", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            page, rows, sides = _flat(batch)
            if len(page):
                names = [f"{x:012d}" for x in numbered(page, *sides, gap_x, gap_y).tolist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(page)) for i in (0, 1)), *rows.flatten(), pa.array(names, pa.string())], schema.names)

    return pages.mapInArrow(run, schema)


def page_elements(pages: DataFrame, gap_x: float = GAP_X, gap_y: float = GAP_Y) -> DataFrame:
    """doc_id, page, place (from 0 on a page), text, height of the elements of pages (doc_id, page, boxes: an array of left, bottom, right, top, text).

    heights and times, at a page's first element, tell how many of the page's boxes have which height.
    """
    light_batches(pages.sparkSession)
    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in PAGE)
    names = [*PAGE, "place", "text", "height", "heights", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            page, rows, (left, bottom, right, top) = _flat(batch)
            if not len(page):
                continue
            text, region, height = rows.field("text"), numbered(page, left, bottom, right, top, gap_x, gap_y), top - bottom
            n = int(region.max()) + 1
            total, boxes = _sums(region, height, n)
            mean = np.divide(total, boxes, out=np.full(n, np.nan), where=boxes > 0)
            line = _lined(region, (bottom + top) / 2, mean / 2)
            order = _in_lines(region, line, left, right, text)
            r, k = region[order], line[order]
            of_line = np.cumsum(np.append(True, (r[1:] != r[:-1]) | (k[1:] != k[:-1]))) - 1
            begins = np.flatnonzero(np.append(True, of_line[1:] != of_line[:-1]))
            said = text.take(pa.array(order))
            there = said.is_valid().to_numpy(zero_copy_only=False)
            lines = pc.utf8_trim(pc.binary_join(pa.ListArray.from_arrays(_cuts(of_line[there], len(begins)), said.drop_null()), " "), " ")
            texts = pc.binary_join(pa.ListArray.from_arrays(_cuts(r[begins], n), lines), "\n")
            own = page[order][np.searchsorted(r, np.arange(n))]
            first = np.append(True, own[1:] != own[:-1])
            place = np.arange(n) - np.repeat(np.flatnonzero(first), np.diff(np.append(np.flatnonzero(first), n)))
            measured = ~np.isnan(height)
            values, code = np.unique(height[measured], return_inverse=True)
            pairs, times = np.unique(page[measured] * max(1, len(values)) + code, return_counts=True)
            counted = np.bincount(pairs // max(1, len(values)), minlength=batch.num_rows)
            cuts = pa.array(np.append(0, np.cumsum(np.where(first, counted[own], 0))), pa.int32())
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (values[pairs % max(1, len(values))], times)]
            columns = [*(batch.column(i).take(pa.array(own)) for i in (0, 1)), pa.array(place, pa.int32()), texts, pa.array(mean, mask=boxes == 0), *lists]
            yield pa.RecordBatch.from_arrays(columns, names)

    return pages.select(*PAGE, "boxes").mapInArrow(run, f"{kinds}, place int, text string, height double, heights array<double>, times array<long>")


def document_elements(pages: DataFrame, gap_x: float = GAP_X, gap_y: float = GAP_Y) -> DataFrame:
    """doc_id, page, seq (from 0 in a document), type, text of pages as `page_elements` takes them.

    A region is an element: a title if its letters are higher than the document's median, else a paragraph.
    """
    rows = stored(page_elements(pages, gap_x, gap_y), "layout")
    each = rows.select("doc_id", F.explode(F.arrays_zip("heights", "times")).alias("e")).groupBy("doc_id", F.col("e.heights").alias("height")).agg(F.sum("e.times").alias("n"))
    own = Window.partitionBy("doc_id")
    middle = each.withColumns({"upto": F.sum("n").over(own.orderBy("height")), "all": F.sum("n").over(own)}).where(2 * F.col("upto") >= F.col("all"))
    usual = middle.groupBy("doc_id").agg(F.min("height").alias("usual"))
    seq = F.row_number().over(own.orderBy("page", "place")) - 1
    kind = F.when(F.col("height") >= F.col("usual") * TITLE_RATIO, "title").otherwise("paragraph")
    return rows.join(usual, "doc_id").select("doc_id", "page", seq.alias("seq"), kind.alias("type"), "text")


def elements(boxes: DataFrame, gap_x: float = GAP_X, gap_y: float = GAP_Y) -> DataFrame:
    """`document_elements` of words' boxes (doc_id, page, left, bottom, right, top, text), one a row and in any order."""
    return document_elements(paged(boxes.select(*PAGE, *SIDES, "text")), gap_x, gap_y)
