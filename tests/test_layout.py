"""Layout recovery against a recursive walk, line grouping against the rule, geometry, and office files with known truth."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import layout
from corvane.plans.layouts import docx_file, xlsx_file
from corvane.sources import files, office

BOX = "doc_id string, page int, left double, bottom double, right double, top double, text string"


def walked(boxes):
    """Reading order of (left, bottom, right, top, text) by recursion."""

    def parts(rows, span, gap):
        rows = sorted(rows, key=span)
        out, reach = [[rows[0]]], span(rows[0])[1]
        for r in rows[1:]:
            a, b = span(r)
            if a - reach >= gap:
                out.append([])
            out[-1].append(r)
            reach = max(reach, b)
        return out

    for span, gap in ((lambda r: (r[0], r[2]), layout.GAP_X), (lambda r: (-r[3], -r[1]), layout.GAP_Y)):
        found = parts(boxes, span, gap)
        if len(found) > 1:
            return [x for p in found for x in walked(p)]
    return [boxes]


def test_regions_equal_a_recursive_walk(spark):
    rng, rows, want = random.Random(5), [], {}
    for page in range(25):
        boxes = []
        for i in range(rng.randint(1, 40)):
            x, y = rng.randint(0, 30) * 20.0, rng.randint(0, 30) * 20.0
            boxes.append((x, y, x + rng.choice([10.0, 15.0, 90.0]), y + rng.choice([5.0, 10.0, 60.0]), f"t{i}"))
        rows += [("d", page, *b) for b in boxes]
        want[page] = [sorted(r[4] for r in part) for part in walked(boxes)]
    got = layout.regions(spark.createDataFrame(rows, BOX).repartition(3))
    found = got.groupBy("page", "region").agg(F.array_sort(F.collect_list("text")).alias("t")).orderBy("page", "region").collect()
    assert {p: [r["t"] for r in found if r["page"] == p] for p in want} == want


def test_lines_follow_their_anchor(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for page in range(20):
        ys = [rng.randint(0, 60) / 2 for _ in range(rng.randint(1, 30))]
        tolerance, anchors, own = max(3.0, 4 * 0.8), [], []
        for i, y in sorted(enumerate(ys), key=lambda x: (-x[1], x[0])):
            if not anchors or anchors[-1] - y > tolerance:
                anchors.append(y)
                own.append([])
            own[-1].append(f"b{i}")
        want[page] = [sorted(x) for x in own]
        rows += [("d", page, i * 10.0, y - 1, i * 10.0 + 4, y + 1, f"b{i}") for i, y in enumerate(ys)]
    got = layout.with_lines(spark.createDataFrame(rows, BOX), layout.PAGE).groupBy("page", "line").agg(F.array_sort(F.collect_list("text")).alias("t")).collect()
    assert {p: [t for _, t in sorted((r["line"], r["t"]) for r in got if r["page"] == p)] for p in want} == want


def test_a_title_over_two_columns(spark):
    rows = [("d", 1, 0.0, 700.0, 600.0, 720.0, "Title")]
    rows += [("d", 1, c * 320.0 + w * 50, 680.0 - n * 14, c * 320.0 + w * 50 + 45, 690.0 - n * 14, f"c{c}l{n}w{w}") for c in range(2) for n in range(3) for w in range(4)]
    random.Random(1).shuffle(rows)
    got = layout.elements(spark.createDataFrame(rows, BOX)).orderBy("seq").collect()
    column = lambda c: "\n".join(" ".join(f"c{c}l{n}w{w}" for w in range(4)) for n in range(3))
    assert [(r["seq"], r["type"], r["text"]) for r in got] == [(0, "title", "Title"), (1, "paragraph", column(0)), (2, "paragraph", column(1))]


def test_geometry(spark):
    rows = [("d", 1, "image", 0.0, 0.0, 50.0, 100.0), ("d", 1, "path", 40.0, 40.0, 60.0, 60.0), ("d", 1, "path", 0.0, 90.0, 100.0, 95.0), ("d", 1, "text", 0.0, 0.0, 100.0, 100.0), ("d", 2, "image", 99.0, 99.0, 100.0, 100.0)]
    boxes = spark.createDataFrame(rows, "doc_id string, page int, kind string, left double, bottom double, right double, top double").withColumns({"page_width": F.lit(100.0), "page_height": F.lit(100.0)})
    assert {r["page"]: r["image_area"] for r in layout.area_share(boxes).collect()} == {1: 0.5, 2: 0.0001}
    got = layout.eligible(boxes).withColumn("at", layout.position())
    assert sorted((r["kind"], r["at"]) for r in got.collect()) == [("image", "middle_left"), ("path", "middle_center")]
    assert layout.elements(spark.createDataFrame([], BOX)).count() == 0


def test_office_files(spark):
    word = docx_file(["Head & Co", "", "one <two>"])
    sheet = xlsx_file("S", [["a", "", "c"], ["d & e"], [""]])
    raw = spark.createDataFrame([("w", "docx", word), ("s", "xlsx", sheet), ("x", "docx", b"rubbish"), ("y", "odd", b"")], "path string, ext string, content binary")
    got = {}
    for r in office.elements(raw).collect():
        got.setdefault(r["path"], []).append((r["seq"], r["type"], r["level"], r["text"], (r["error"] or "").split(":")[0]))
    assert got["w"] == [(0, "title", 1, "Head & Co", ""), (1, "paragraph", None, "one <two>", "")]
    assert got["s"] == [(0, "title", 1, "Sheet: S", ""), (1, "table_row", None, "a | c", ""), (2, "table_row", None, "d & e", "")]
    assert got["x"][0][4] == "BadZipFile" and got["y"][0][4] == "KeyError"
    texts = {r["path"]: r["text"] for r in files.load(raw.where("path IN ('w', 's')")).collect()}
    assert texts == {"w": "Head & Co\none <two>", "s": "# Sheet: S\na | c\nd & e"}


def test_sheets_with_gaps_and_a_table_among_paragraphs():
    main, rel = office.SHEET[1:-1], office.REL[1:-1]
    from corvane.plans.layouts import _zip

    sheet = f'<worksheet xmlns="{main}"><sheetData><row><c r="B1" t="str"><v>b</v></c><c r="AA1"><v>27</v></c><c r="AB1" t="b"><v>1</v></c></row><row/></sheetData></worksheet>'
    book = {"xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="One" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<R><x Id="r1" Target="/xl/one.xml"/></R>', "xl/one.xml": sheet}
    ((name, rows),) = office.sheets(_zip(book))
    assert name == "One" and len(rows[0]) == 28 and (rows[0][1], rows[0][26], rows[0][27]) == ("b", "27", "TRUE") and rows[1] == []
    w = office.WORD[1:-1]
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    body = f'<w:document xmlns:w="{w}"><w:body>{p("before")}<w:tbl><w:tr><w:tc>{p("x")}</w:tc><w:tc>{p(" ")}</w:tc><w:tc>{p("y")}</w:tc></w:tr></w:tbl>{p("after")}</w:body></w:document>'
    assert [x[1:] for x in office.docx_elements(_zip({"word/document.xml": body}))] == [("paragraph", None, "before"), ("table_row", None, "x | y"), ("paragraph", None, "after")]
    with pytest.raises(ValueError):
        office.sheet_text(_zip(book | {"xl/one.xml": f'<worksheet xmlns="{main}"><sheetData/></worksheet>'}))


def test_office_files_are_read_a_few_at_a_time(spark, monkeypatch):
    """Ten thousand files and all their elements at once are more than a worker should hold."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.unset(name)
    try:
        from corvane.plans.layouts import _zip

        raw = _zip({"word/document.xml": f'<w:document xmlns:w="{office.WORD[1:-1]}"><w:body><w:p><w:r><w:t>said</w:t></w:r></w:p></w:body></w:document>'})
        rows = spark.createDataFrame([(f"f{i}", "docx", bytearray(raw)) for i in range(70)], "path string, ext string, content binary").coalesce(1)
        assert sorted(r["path"] for r in office.elements(rows).where("text = 'said'").collect()) == sorted(f"f{i}" for i in range(70))
        assert spark.conf.get(name) == str(4 << 20) and office.FILES < 70
    finally:
        spark.conf.set(name, before)


def test_lines_need_no_join(spark):
    rows = spark.createDataFrame([("d", 0, "", 1.0, 10.0, 5.0, 20.0, "b"), ("d", 0, "", 1.0, 50.0, 5.0, 60.0, "a"), ("d", 0, "x", 1.0, 51.0, 5.0, 61.0, "c")], "doc_id string, page int, region string, left double, bottom double, right double, top double, text string")
    got = layout.with_lines(rows, [*layout.PAGE, "region"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert {r["text"]: r["line"] for r in got.collect()} == {"a": 0, "b": 1, "c": 0}


def said(boxes):
    """The text of a region of (left, bottom, right, top, text)."""
    tolerance = sum(b[3] - b[1] for b in boxes) / len(boxes) / 2
    anchors, lines = [], {}
    for y in sorted({(b[1] + b[3]) / 2 for b in boxes}, reverse=True):
        if not anchors or anchors[-1] - y > tolerance:
            anchors.append(y)
    for b in sorted(boxes, key=lambda b: (b[0], b[2], b[4] is not None, b[4] or "")):
        lines.setdefault(sum(a >= (b[1] + b[3]) / 2 for a in anchors), []).append(b[4])
    return "\n".join(" ".join(x for x in lines[k] if x is not None).strip(" ") for k in sorted(lines))


def test_elements_of_whole_pages(spark):
    """A page's boxes are one row and are worked on where they lie; the same elements come of single boxes."""
    rng, pages, want = random.Random(8), [], {}
    for page in range(30):
        boxes = []
        for i in range(rng.randint(1, 60)):
            x, y = rng.randint(0, 12) * 20.0, rng.randint(0, 30) * 7.0
            boxes.append((x, y, x + rng.choice([10.0, 15.0]), y + rng.choice([5.0, 10.0]), rng.choice([None, "", "a b", f"t{i}", "ä", "same", "same"])))
        pages.append(("d" if page < 29 else "e", page, boxes))
        want[page] = [said(part) for part in walked(boxes)]
    pages += [("e", 40, []), ("f", 41, None)]
    kind = "doc_id string, page int, boxes array<struct<left:double,bottom:double,right:double,top:double,text:string>>"
    rows = spark.createDataFrame(pages, kind).repartition(3)
    alone = layout.page_elements(rows)
    plan = alone._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange") == 1  # repartition's
    got = {}
    for r in alone.collect():
        got.setdefault(r["page"], {})[r["place"]] = r["text"]
    assert {p: [own[k] for k in range(len(own))] for p, own in got.items()} == want
    whole = layout.document_elements(rows).collect()
    single = layout.elements(rows.select("doc_id", "page", F.explode("boxes").alias("b")).select("doc_id", "page", "b.*")).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, single))
    assert [r["text"] for r in sorted(whole, key=lambda r: (r["doc_id"], r["seq"]))] == [t for p in sorted(want) for t in want[p]]
    heights = sorted(b[3] - b[1] for b in pages[29][2])
    usual = heights[(len(heights) - 1) // 2]
    for r, part in zip(sorted((r for r in whole if r["doc_id"] == "e"), key=lambda r: r["seq"]), walked(pages[29][2]), strict=True):
        assert r["type"] == ("title" if sum(b[3] - b[1] for b in part) / len(part) >= usual * 1.3 else "paragraph")


def test_boxes_without_some_sides(spark):
    rows = [("d", 0, 0.0, 10.0, 5.0, 20.0, "b"), ("d", 0, None, 10.0, 4.0, 20.0, "a"), ("d", 0, 6.0, None, 9.0, 20.0, "first"), ("d", 0, 25.0, 10.0, None, 20.0, "c"), ("d", 0, 40.0, 11.0, 41.0, 20.0, "d")]
    got = layout.elements(spark.createDataFrame(rows, BOX)).orderBy("seq").collect()
    assert [r["text"] for r in got] == ["first\na b", "c", "d"]


def test_set_pages_are_rows(spark):
    from corvane.plans.layouts import place_on_page, set_pages

    pages = set_pages(spark, "/root/testdata/sf0.001")
    assert pages.columns == ["doc_id", "page", "boxes"]
    assert "Exchange hashpartitioning" not in pages._jdf.queryExecution().executedPlan().toString()
    assert place_on_page(0) == {"left": 0.0, "bottom": 779.0, "right": 152.0, "top": 797.0}
    assert place_on_page(203) == {"left": 570.0, "bottom": 475.0, "right": 625.0, "top": 485.0}
