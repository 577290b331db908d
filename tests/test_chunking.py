import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.operators import chunking, elements
from corvane.sources import files

MARKDOWN = "# A\n\nintro text\n\n## B\n" + "word " * 80 + "\n\n### C\n- one\n- two\n\n| h1 | h2 |\n|---|---|\n| a | b |\n| c | d |\n\n# D\nend\n"
pieces = st.lists(st.sampled_from(["# H\n", "## K\n", "word ", "a long run of words. ", "\n\n", "```\ncode\n```\n", "| a | b |\n|---|---|\n| 1 | 2 |\n", "1. point\n", "[x](y) ", "。", "\f", "===\n", "x" * 70]), max_size=60).map("".join)


@settings(max_examples=150, deadline=None)
@given(pieces, st.integers(20, 200), st.integers(0, 60), st.sampled_from(["auto", "heading", "heuristic", "legacy"]))
def test_pieces_are_slices_that_cover_the_text(text, size, overlap, strategy):
    tier, found, chain, refused = chunking.Splitter(size, overlap, strategy).split(text)
    assert all(0 <= p.start < p.end <= len(text) for p in found)
    covered = set()
    for p in found:
        covered.update(range(p.start, p.end))
    assert all(i in covered for i, c in enumerate(text) if not c.isspace())
    assert tier in chain if text else not found
    assert len(refused) <= len(chain) if text else not refused


def test_heading_tier_keeps_breadcrumbs():
    text = "# A\n" + "x " * 40 + "\n# B\n" + "y " * 40 + "\n# C\n" + "z " * 40
    tier, found, chain, _ = chunking.Splitter(120, 10).split(text)
    assert tier == "heading" and chain == ["heading", "legacy"]
    assert [p.header for p in found] == ["# A", "# B", "# C"]


def test_large_table_repeats_its_head():
    table = "| h1 | h2 |\n|---|---|\n" + "".join(f"| row {i} | {'v' * 10} |\n" for i in range(30))
    found = chunking.Splitter(200, 0, "legacy").split(table)[1]
    assert len(found) > 1 and found[0].header == "" and all(p.header.startswith("| h1 | h2 |") for p in found[1:])


def test_protected_spans_merge():
    assert chunking.merged([(5, 9), (0, 6), (9, 12)]) == [(0, 9), (9, 12)]


def test_profile_and_strategies(spark):
    rows = spark.createDataFrame([(1, MARKDOWN), (2, ""), (3, "Kapitel 1\nder Text\n"), (4, "一" * 50)], "id long, text string")
    got = {r["id"]: r for r in rows.select("id", chunking.profile(F.col("text")).alias("p")).select("id", "p.*", chunking.strategies(F.col("p")).alias("chain")).collect()}
    assert got[1]["heading_total"] == 4 and got[1]["headings"][0] == 2 and got[1]["has_tables"]
    assert list(got[1]["chain"])[-1] == "legacy" and got[3]["chain"][0] == "heuristic"
    assert list(got[2]["languages"]) == [] and list(got[3]["languages"]) == ["de"] and list(got[4]["languages"]) == ["zh"]
    # the driver-side chain of the splitter agrees with the column expression
    for i, text in ((1, MARKDOWN), (3, "Kapitel 1\nder Text\n")):
        assert chunking.Splitter().chain(text) == list(got[i]["chain"])


def test_elements(spark):
    got = elements.elements(spark.createDataFrame([("d", MARKDOWN)], "id string, text string")).orderBy("seq").collect()
    assert [r["type"] for r in got] == ["title", "paragraph", "title", "paragraph", "title", "list", "list", "table", "title", "paragraph"]
    assert [r["title_path"] for r in got][4:9] == ["A/B/C"] * 4 + ["D"]
    assert got[7]["text"] == "h1 | h2\na | b\nc | d"


def test_titles_that_skip_levels(spark):
    rows = elements.elements(spark.createDataFrame([("d", "# A\n### B\n### C\n## D\n")], "id string, text string")).orderBy("seq").collect()
    assert [r["title_path"] for r in rows] == ["A", "A/B", "A/B/C", "A/D"]


def test_table_rows(spark):
    md = "| h1 | h2 |\n|---|---|\n| a | b |\n| c |"
    row = spark.createDataFrame([(md,)], "m string").select(elements.table_rows(F.col("m")).alias("r"), elements.table_fields(F.col("m")).alias("f")).first()
    assert list(row["f"]) == ["h1", "h2"] and row["r"] == [{"h1": "a", "h2": "b"}, {"h1": "c", "h2": ""}]


def test_parent_child(spark):
    text = "para one. " * 60 + "\n\n" + "para two. " * 60
    rows = chunking.parent_child(spark.createDataFrame([("d", text), ("e", ""), ("f", None)], "id string, text string"), 500, 120, 20).collect()
    assert {r["id"] for r in rows} == {"d"}
    assert all(text[r["start"] : r["end"]] == r["content"] for r in rows)
    parents = {r["chunk_id"] for r in rows if r["chunk_type"] == "parent"}
    assert all(r["parent_id"] in parents for r in rows if r["chunk_type"] == "child")


def test_rejections(spark):
    rows = spark.createDataFrame([([], 0), ([900], 900), ([10, 10, 10, 10, 300], 340), ([10, 20], 900), ([300, 900], 1200), ([300, 380], 680)], "lengths array<int>, total int")
    got = [r[0] for r in rows.select(chunking.rejection(F.col("lengths"), F.col("total"), 384)).collect()]
    assert got == [chunking.REASONS[0], chunking.REASONS[1], chunking.REASONS[2], chunking.REASONS[3], chunking.REASONS[4], ""]


def test_page_text():
    page = "<p title='x>y'>a<b>b</b> &amp; c<br/>d<script>if (a<b) </script>e<!-- f --><STYLE>g</STYLE></p>h<noscript>i</noscript> <div class=\"cut"
    assert files.page_text(page) == "ab& c\nde\nh"
    assert files.page_text("") == "" and files.page_text("<script>never closed") == ""
    began = time.time()
    files.page_text("<a " * 300_000)
    assert time.time() - began < 5


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=40), st.integers(1, 60))
def test_packing_takes_one_part_and_what_fits(sizes, size):
    marks = [0]
    for n in sizes:
        marks.append(marks[-1] + n)
    spans = chunking.packed(marks, size, lambda _, b: b)
    assert [x for a, b in spans for x in range(a, b)] == list(range(marks[-1]))
    for (a, b), (_, c) in zip(spans, spans[1:], strict=False):
        assert b - a <= size or marks.index(b) - marks.index(a) == 1
        assert marks[marks.index(b) + 1] - a > size and c > b
