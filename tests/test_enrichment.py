"""Enrichment: the default provider against pairs, the bound on every batch, rounds, failures and retries."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corvane.operators import enrichment as E

PARENT = "doc_id string, seq int, chunk_id string, content string, token_count int"


def by_pairs(tokens):
    """Centrality as it is defined: a sum over pairs."""
    counts = [Counter(t) for t in tokens]
    norm = [math.sqrt(sum(n * n for n in c.values())) for c in counts]
    cos = lambda i, j: sum(n * counts[j][t] for t, n in counts[i].items()) / (norm[i] * norm[j]) if norm[i] and norm[j] else 0.0
    return [round(sum(cos(i, j) for j in range(len(counts)) if j != i), 9) if counts[i] else -1.0 for i in range(len(counts))]


def test_centrality_is_the_sum_over_pairs():
    rng = random.Random(4)
    for _ in range(30):
        tokens = [rng.choices([f"word{i}" for i in range(15)], k=rng.randint(0, 9)) for _ in range(rng.randint(1, 12))]
        said = [f"s{i}" for i in range(len(tokens))]
        want = by_pairs(tokens)
        best = sorted(sorted(range(len(said)), key=lambda i: (-want[i], i))[:3])
        assert E.central(said, tokens, "n")[0] == " ".join(said[i] for i in best)
    assert E.central([], [], "n") == ("", [], [])


def test_sentences(spark):
    rows = spark.createDataFrame([("One. Two!  Three?\nFour 3.5 five\n\n 六。 七",), ("",)], "t string")
    assert [r[0] for r in rows.select(E.sentences(F.col("t"))).collect()] == [["One.", "Two!", "Three?", "Four 3.5 five", "六。", "七"], []]


def parents(spark, sizes):
    """Documents of chunks that repeat a sentence of their own; sizes: doc -> characters of each chunk."""
    rows = [(d, s, f"{d}-{s}", (f"Sentence {s} of {d} speaks about topic{s % 3}. " * (1 + n // 40))[:n], None) for d, ns in sizes.items() for s, n in enumerate(ns)]
    return spark.createDataFrame(rows, PARENT)


def test_every_batch_keeps_the_bound_and_rounds_end(spark):
    sizes = {"short": [300], "long": [1000] * 60, "one-large": [9000, 50], "none": []}
    docs = spark.createDataFrame([(d, f"{d}.txt") for d in sizes], "doc_id string, name string")
    seen = []

    def watched(texts):
        seen.append([(r["doc_id"], len(r["text"]), r["partial"]) for r in texts.collect()])
        return E.centrality_provider()(texts)

    rows = {r["doc_id"]: r for r in E.enrich(docs, parents(spark, sizes), watched, most=10).collect()}  # 500 is the least
    assert len(seen) > 2
    # tokens are characters / 4 rounded down, and batches are joined by two more
    assert all(n <= 500 * 4 + 4 * 80 for r in seen for d, n, _ in r if d != "one-large")
    assert {d for d, _, partial in seen[0] if partial} == {"long", "one-large"}
    assert rows["none"]["status"] == "failed" and rows["none"]["error"] == E.NO_PARENTS
    for d in ("short", "long", "one-large"):
        r = rows[d]
        assert r["status"] == "completed" and r["summary"] and r["keywords"] and len(r["suggested_questions"]) == min(3, len(r["keywords"])) and r["version"] == 1
        assert r["source_chunk_ids"] == [f"{d}-{s}" for s in range(len(sizes[d]))]
    assert (rows["short"]["batches"], rows["long"]["batches"], rows["one-large"]["batches"]) == (1, 30, 2)


def test_a_single_batch_is_what_the_provider_said(spark):
    docs = spark.createDataFrame([("d", "d.txt"), ("e", None)], "doc_id string, name string")
    chunks = spark.createDataFrame([("d", 0, "a", "First line. Second line.", 5), ("d", 1, "b", None, None), ("e", 0, "c", "x", 0)], PARENT)
    texts = {}

    def generate(name, text, partial):
        assert not partial
        texts[name] = text
        return {"summary": f"{name}: {text}", "keywords": [" a ", "a", "", "b" * 90, *map(str, range(20))], "suggested_questions": ["q" * 300] * 3}

    rows = {r["doc_id"]: r for r in E.enrich(docs, chunks, E.row_provider(generate)).collect()}
    assert rows["d"]["summary"] == "d.txt: First line. Second line.\n\n" and rows["e"]["summary"] == "e: x"
    assert rows["d"]["keywords"] == ["a", "b" * 80, *map(str, range(10))] and rows["d"]["suggested_questions"] == ["q" * 200]


def test_partial_summaries_are_numbered_and_combined(spark):
    docs = spark.createDataFrame([("d", "n")], "doc_id string, name string")
    chunks = spark.createDataFrame([("d", s, str(s), f"part {s}", 400) for s in range(3)], PARENT)
    generate = lambda name, text, partial: {"summary": f"<{text}>" if partial else text, "keywords": [str(partial)]}
    row = E.enrich(docs, chunks, E.row_provider(generate), most=500).first()
    assert row["summary"] == "分段 1: <part 0>\n\n分段 2: <part 1>\n\n分段 3: <part 2>"
    assert row["keywords"] == ["False"] and row["batches"] == 3


def test_failures_are_told_without_secrets_and_retried_to_a_limit(spark):
    docs = spark.createDataFrame([("good", "g"), ("bad", "b")], "doc_id string, name string")
    chunks = spark.createDataFrame([(d, s, f"{d}{s}", f"{d} {s}", 400) for d in ("good", "bad") for s in range(2)], PARENT)

    def generate(name, text, partial):
        if text == "bad 1":
            raise RuntimeError("refused: Bearer abc.def api_key=xyz")
        return {"summary": text}

    rows = E.enrich(docs, chunks, E.row_provider(generate), most=500)
    for version in (1, 2, 3, 3):
        got = {r["doc_id"]: r for r in rows.collect()}
        assert got["good"]["status"] == "completed" and got["good"]["version"] == 1
        assert (got["bad"]["status"], got["bad"]["error"], got["bad"]["version"]) == ("failed", "refused: Bearer [redacted] api_key=[redacted]", version)
        rows = E.retry(rows, docs, chunks, E.row_provider(generate), most=500)
    mended = E.retry(rows, docs, chunks, E.row_provider(lambda n, t, p: {"summary": "ok"}), most=500, max_retries=5)
    assert {r["doc_id"]: r["status"] for r in mended.collect()} == {"good": "completed", "bad": "completed"}


def test_without_a_provider_nothing_is_done(spark):
    docs = spark.createDataFrame([("d", "n")], "doc_id string, name string")
    assert E.enrich(docs, spark.createDataFrame([], PARENT), None).first()["status"] == "none"


@pytest.mark.parametrize("empty", [True])
def test_no_documents(spark, empty):
    docs = spark.createDataFrame([], "doc_id string, name string")
    assert E.enrich(docs, spark.createDataFrame([], PARENT), E.centrality_provider()).count() == 0
