"""Rows, words and text that were once lost."""

import resource
import time
from datetime import datetime

import pytest

from corvane.llm import mixing, substring_dedup
from corvane.llm.html_extract import Blocks, vectors


def test_short_comments_end():
    for comment in ("<!-->", "<!--->", "<!-- x --!>", "<!---->", "<!-- a -- > b -->", "<!--x-->"):
        assert Blocks(f"<article><h1>T</h1><p>Alpha</p>{comment}<p>Beta</p><p>Gamma</p></article>").texts == ["T", "Alpha", "Beta", "Gamma"], comment
    assert Blocks("<p>one</p><!-- never ended <p>two</p>").texts == ["one"]


def test_deep_pages_take_time_and_memory_in_proportion():
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.process_time()
    for page in ("<div>x" * 100_000, "<i>" * 50_000 + "</p>" * 50_000 + "x"):
        page = Blocks(page)
    assert time.process_time() - began < 4
    page = Blocks("<div>x" * 100_000)
    assert len(page.texts) == 100_000 and len(page.sets) == 2 and max(page.depths) == 100_000
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000
    assert vectors(Blocks("<div class='a b'><p>x<div><p>y"))[0].shape[0] == 1


def test_rows_that_differ_in_a_microsecond(spark):
    rows = [(1, "a b c", "s", datetime(2024, 1, 1, 0, 0, 0, k)) for k in (1, 2, 2)] + [(2, "d e", "t", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, at timestamp")
    out = mixing.mix(docs).collect()
    copies = lambda k: sum(r["at"] is not None and r["at"].microsecond == k for r in out)
    assert copies(1) and copies(2) and abs(2 * copies(1) - copies(2)) <= 2


def brute_kept(rows, window):
    owner = {}
    split = [(i, (t or "").split()) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            owner[key] = min(owner.get(key, i), i)
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if owner[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        out.append((i, len(gone)))
    return sorted(out)


@pytest.mark.parametrize("window", [1, 2, 10, 15, 16, 17])
def test_windows_of_any_length(spark, window):
    words = [f"w{k % 23 * k % 31}" for k in range(120)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[30:60], "new", *words[70:90]])), (3, " ".join(words[5:20])), (4, "w1 only"), (5, None), (6, " ".join(words[:9]))]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=window)
    assert sorted((r["doc_id"], r["n_removed"]) for r in got.collect()) == brute_kept(rows, window)
