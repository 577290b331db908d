"""Small tables of the near-copy stage come in few files, and components take no round too many."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corvane.llm import _common, components, simhash, similar

HELD = {"spark.sql.shuffle.partitions": "13", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


@pytest.fixture
def files(spark, monkeypatch):
    """(name, files, rows) of every stored table, while shuffles keep 13 partitions."""
    seen, stored, before = [], _common.stored, {k: spark.conf.get(k) for k in HELD}

    def noted(df, what, *a, **b):
        out = stored(df, what, *a, **b)
        seen.append((what, len(list(Path(out.corvane_path.removeprefix("file:")).glob("part-*"))), out.count()))
        return out

    for module in (components, simhash, similar):
        monkeypatch.setattr(module, "stored", noted)
    for k, v in HELD.items():
        spark.conf.set(k, v)
    yield seen
    for k, v in before.items():
        spark.conf.set(k, v)


def test_small_tables_take_few_files(spark, files):
    rows = [(k + 1, f"a text of its own words with the number {k // 3} and more words {k // 3} to follow it x{k // 3}", "en", "s", 1) for k in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in similar.drop_similar(docs).collect()) == list(range(1, 91, 3))
    assert {"simhash-points", "shingle-edges", "edges", "simhash-kept"} <= {what for what, _, _ in files}
    assert max(n for _, n, _ in files) <= spark.sparkContext.defaultParallelism


def test_large_tables_keep_their_parts(spark, files):
    out = components.stored(spark.range(0, 13_000, 1, 13), "wide", 13_000, 1000)
    assert (out.count(), files[-1][1]) == (13_000, 13)
    assert components.stored(spark.range(0, 13_000, 1, 13), "wide").count() == 13_000
    assert files[-1][1] == 13  # of unknown size


def test_stars_take_no_further_round(spark, files):
    stars = [(k, k % 7) for k in range(7, 200)]
    got = components.labels(spark.createDataFrame(stars, "a long, b long"), len(stars))
    assert {r["node"]: r["label"] for r in got.collect()} == {k: k % 7 for k in range(200)}
    assert [what for what, _, _ in files] == ["edges"]


@pytest.mark.parametrize("edges", [[], [(3, 3)], [(k, k + 1) for k in range(40)], [(5, 1), (5, 2)], [(9, 4), (4, 1)]])
def test_rounds_end_in_stars(spark, files, edges):
    got = components.labels(spark.createDataFrame(edges, "a long, b long"))
    least = {}
    for a, b in edges:
        if a != b:
            own = {x for x in least if least[x] in (least.get(a, a), least.get(b, b))} | {a, b}
            least |= dict.fromkeys(own, min(least.get(x, x) for x in own))
    assert {r["node"]: r["label"] for r in got.collect()} == least
    assert got.agg(F.count_distinct("node")).first()[0] == got.count()
