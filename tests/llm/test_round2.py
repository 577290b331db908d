"""Cases that once went wrong: lost rows and spans, cut tags, clashing names, whole keys."""

import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import html_extract, mixing, secrets, simhash, topk

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# ---- top-k ---------------------------------------------------------------------------------------------------------------
def test_topk_ranks_scores_beyond_a_long(spark):
    rows = [(50, [1e15, 1.0]), (1, [1e15, 0.0]), (2, [1e15, 5.0]), (3, [2e15, 0.0]), (4, [-1e15, 0.0]), (5, [1.0, 1.0]), (6, [0.0, 1.0]), (7, [1e15, 5.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = [r["vec_id"] for r in topk.search(frame, F.expr("vec_id = 50"), k=7).orderBy("rank").collect()]
    exact = {i: sum(int(np.floor(256 * a)) * int(np.floor(256 * b)) for a, b in zip(rows[0][1], v)) for i, v in rows[1:]}
    assert got == sorted(exact, key=lambda i: (-exact[i], i))


def test_topk_takes_a_usable_vector_of_a_repeated_id(spark):
    rows = [(50, [None, 1.0]), (50, [1.0, 2.0]), (50, []), (50, None), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [float("inf"), 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit(9), "q": F.lit("clash"), "score": F.lit(0)})
    assert [tuple(r) for r in topk.search(frame, F.expr("vec_id = 50")).orderBy("rank").collect()] == [(50, 1, 1, 256 * 256 * 3), (50, 2, 1, 256 * 256 * 3)]


# ---- mixing --------------------------------------------------------------------------------------------------------------
def test_mix_keeps_rows_that_differ_elsewhere(spark):
    rows = [(1, "a b c", "en", "s", 5), (1, "a b c", "de", "s", 5), (1, "a b c", None, "s", 5), (2, "d", "en", "s", 1), (2, "d", "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"mix_position": F.lit("clash"), "key": F.lit("k"), "whole": F.lit("w")})
    got = mixing.mix(docs, rate=2.0, placed=False)
    assert got.columns == docs.columns
    assert sorted(str(r["lang"]) for r in got.where("doc_id = 1").collect()) == ["None", "None", "de", "de", "en", "en"]
    assert got.where("doc_id = 2").count() == 4
    placed = mixing.mix(docs, rate=2.0)
    assert [x for x in placed.columns if x.startswith("mix_")] == ["mix_position", "mix_copy"] and placed.count() == 10
    spots = [r["mix_position"] for r in placed.collect()]
    assert spots == sorted(spots)


# ---- SimHash -------------------------------------------------------------------------------------------------------------
def test_names_that_the_operator_uses_itself(spark):
    docs = spark.createDataFrame([(1, "a b c d", "en", "s", 1), (None, "x y z", "en", "s", 1), (None, "x y z", "en", "s", 1), (2, "A b c d", "en", "s", 1)], DOCS)
    docs = docs.withColumns({c: F.lit("clash") for c in ("corvane_n", "corvane_fp", "corvane_label", "fp", "label", "id", "times", "component_id")})
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "None"]


def test_classes_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 16)
    rng = np.random.default_rng(4)
    points = np.unique(np.concatenate([rng.integers(-(2**62), 2**62, 600), 5 ^ (1 << rng.integers(0, 60, 40))]))
    fps = spark.createDataFrame([(i, int(p)) for i, p in enumerate(points)], "id long, fp long")
    got = {r["fp"]: r["component_id"] for r in simhash.classes(fps).collect()}
    label = list(range(len(points)))
    for i in range(len(points)):
        for j in range(i):
            if ((int(points[i]) ^ int(points[j])) & (2**64 - 1)).bit_count() <= 2:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    assert got == {int(p): label[i] for i, p in enumerate(points)}


# ---- secrets -------------------------------------------------------------------------------------------------------------
def scanned(text):
    """The base spans by hand: character by character, without regular expressions of the operator."""
    out, low = [], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    run = lambda at, allowed: next((k for k in range(at, len(text)) if text[k] not in allowed), len(text))
    value = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
    at = 0
    while at < len(text):
        for name in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if low.startswith(name, at):
                p = at + len(name)
                p += text[p : p + 1] in ('"', "'") and p < len(text)
                p = run(p, " ")
                if text[p : p + 1] in (":", "=") and p < len(text):
                    p = run(p + 1, " ")
                    p += text[p : p + 1] in ('"', "'") and p < len(text)
                    end = run(p, value)
                    if end > p:
                        if end - p >= 6:
                            out.append((at, 0, end))
                        at = end - 1
                        break
        at += 1
    for kind, start, allowed, least in ((1, "AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 20), (2, "", "0123456789abcdef", 24)):
        at = 0
        while at < len(text):
            end = run(at + len(start), allowed) if text.startswith(start, at) else at
            if end > at + len(start):
                if end - at >= least:
                    out.append((at, kind, end))
                at = end
            else:
                at += 1
    return sorted(out)


def test_secret_columns_against_a_scanner_by_hand(spark):
    import hashlib

    rng = np.random.default_rng(8)
    bits = ["password", "PassWd", "secret", "token", "API_KEY", "apikey", '"', "'", " ", ":", "=", "abcdef", "x" * 7, "AKIA", "Q7" * 9, "0123456789abcdef", "deadbeef" * 3, "\n", "é", "ſecret", "+/=", "AKIAAKIA"]
    rows = [(i, "".join(rng.choice(bits, rng.integers(1, 25)))) for i in range(400)] + [(900, None), (901, ""), (901, "")]
    docs = spark.createDataFrame([(i, t, "en", None if i % 3 else "s", 1) for i, t in rows], DOCS).withColumns({c: F.lit("clash") for c in ("n_hex", "row", "places", "hash", "found", "owner")})
    docs.createOrReplaceTempView("secret_docs")
    got = sorted((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"], tuple((s["start"], s["kind"], s["end"]) for s in r["found"] if s["kind"] < 3)) for r in secrets.scan(docs).collect())
    want = []
    for i, t in rows:
        spans = scanned(t or "")
        told = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)
        want.append((i, *(sum(s[1] == k for s in spans) for k in range(3)), hashlib.sha256(told.encode()).hexdigest(), tuple(spans)))
    assert got == sorted(want) and sum(w[1] for w in want) > 50 and sum(w[2] for w in want) > 5 and sum(w[3] for w in want) > 50


def test_suspected_spans_in_many():
    text = " ".join(f"password=abcdefgh{k} ghp_{k:05d}{'Zx9y' * 9}" for k in range(4000))
    began = time.time()
    base = secrets.base_spans(text)
    more = secrets.suspected(text, base)
    assert len(base) == len(more) == 4000 and time.time() - began < 5
    assert all(text[a:b].startswith("ghp_") for a, _, b, _ in more)
    touching = "token=ghp_" + "a1B2" * 9
    assert secrets.suspected(touching, secrets.base_spans(touching)) == []


# ---- pages ---------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ('<article><p>Hello world.</p><div class="ab', ["Hello world."]),
        ("<p>one</p><p>two</p", ["one", "two"]),
        ("<p>1 < 2 and a <b", ["1 < 2 and a <b"]),
        ("İ" * 20 + "<script>var a = '<p>no</p>'</script><p>kept</p>", ["İ" * 20, "kept"]),
        ("<p>area <math><mi>x</mi><mo>=</mo><mn>2</mn></math> there</p>", ["area x=2 there"]),
        ("<p>a</p><select><option>b</option></select><p>c</p>", ["a", "b", "c"]),
        ('<a href="x>y</a> z <p title=\'it"s\'>w</p>', ["y z", "w"]),
        ('<p title="a > b">c</p><!-- <p>d</p> --><!doctype x><?php ?>e', ["c", "e"]),
    ],
)
def test_pages(page, texts):
    assert html_extract.Blocks(page).texts == texts


@pytest.mark.parametrize("piece", ["<a ", '<a "', "<a '>", "<!", "<a \">' ", "</", "<!--", "<script>", "<p>", "&amp;", "<a href='>"])
def test_long_broken_pages_take_linear_time(piece):
    took = []
    for size in (100_000, 400_000):
        began = time.process_time()
        for tail in ("", ">", "'>"):
            html_extract.Blocks(piece * (size // len(piece)) + tail)
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0] + 1.5


def test_pages_with_clashing_columns_and_very_long_text(spark):
    article = "<html><body><nav><ul><li><a href=a>Home</a></ul></nav><article>" + "".join(f"<p>{' '.join(['Plain', 'words', 'make', 'this', 'sentence', str(k)])}, and it goes on for a while. It ends here.</p>" for k in range(3000)) + "</article></body></html>"
    rows = [(1, "u", article), (1, "u", article), (2, None, None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("clash"), "n_chars": F.lit(1)})
    got = html_extract.extract(frame).collect()
    long = [r for r in got if r["page_id"] == 1]
    assert len(got) == 3 and len({r["text"] for r in long}) == 1 and len(re.findall("sentence", long[0]["text"])) > 2990
