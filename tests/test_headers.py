"""Header sections against a walk over random markdown."""

import random
import re

from corvane.operators import headers


def walk(text):
    sections, stack, code, before = [], {}, False, None
    for raw in text.split("\n"):
        line = raw.strip(" \t\r\f\x0b")
        if not line:
            continue
        fence = line.startswith(("```", "~~~"))
        if fence:
            code = not code
        m = None if code or fence else re.fullmatch(r"(#{1,4})(?: (.*))?", line)
        if m:
            level = len(m[1])
            if before is None or before >= level:
                sections.append([{}, []])
            stack = {k: v for k, v in stack.items() if k < level} | {level: (m[2] or "").strip(" ")}
        before = len(m[1]) if m else None
        if not sections:
            sections.append([{}, []])
        sections[-1][1].append(line)
        sections[-1][0] = dict(stack)
    return [(i, *[s.get(k) for k in (1, 2, 3, 4)], "  \n".join(c)) for i, (s, c) in enumerate(sections)]


def test_equals_a_walk(spark):
    rng = random.Random(3)
    parts = ["# A", "## B", "### C", "#### D", "##### five", "#nospace", "#", "##  two  ", "text", "  more text\t", "", "```", "~~~ x", "| a |"]
    texts = ["\n".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(60)] + ["", "# only", "\n\n"]
    rows = headers.header_sections(spark.createDataFrame(list(enumerate(texts)) + [(999, None)], "doc_id int, text string"))
    got = {}
    for r in rows.orderBy("doc_id", "seq").collect():
        got.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    assert got == {i: w for i, t in enumerate(texts) if (w := walk(t))}


def test_long_sections_are_cut(spark):
    docs = spark.createDataFrame([(1, "# H\n" + "word " * 300)], "doc_id int, text string")
    rows = headers.header_chunks(docs, 100, 20).orderBy("part").collect()
    assert {r["h1"] for r in rows} == {"H"} and all(len(r["content"]) <= 100 for r in rows) and len(rows) > 10
