"""Fitted operators: held-out quality, decoding, edge cases; and the pipeline's stages."""

import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import html_extract, quality, toxicity
from corvane.llm._common import table

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(3)
    names = [a + b for a in "bcdfglmnprst" for b in ("ane", "ore", "ith", "ula", "ent")]
    rows, marks = [], []
    for i in range(900):
        words = [str(rng.choice(names)) for _ in range(rng.integers(5, 60))]
        toxic, junk = i % 6 == 0, i % 7 == 0
        if toxic:
            words[:: max(1, len(words) // 3)] = ["grobian"] * len(words[:: max(1, len(words) // 3)])
        text = " ".join(words).upper() + "!!" if junk else " ".join(words) + "."
        rows.append((i, text, "en", f"s{i % 5}", len(text)))
        marks.append((i, int(not junk), int(toxic)))
    rows += [(9000 + k, t, None, None, None) for k, t in enumerate([None, "", "gr0bian", "g r o b i a n", "grooobian", "g.r.o.b.i.a.n", "friendly words only"])]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(marks + [(9999, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_toxicity(labelled, spark):
    docs, marks = labelled
    scorer = toxicity.train(docs, marks, toxicity.not_held_out(marks["doc_id"]))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, scorer).collect()}
    held = [r for r in marks.where(~toxicity.not_held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).collect()]
    assert len(held) > 150 and np.mean([(got[r["doc_id"]] >= 0.3) == (r["toxic"] == 1) for r in held if r["doc_id"] in got]) > 0.97
    assert got[9000] == got[9001] < 0.3 and all(got[9002 + k] >= 0.3 for k in range(4)) and got[9006] < 0.3
    kept = toxicity.reject(docs, scorer)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, s in got.items() if s < 0.3}


def test_toxicity_without_labels(labelled, spark):
    docs, marks = labelled
    for part in (marks.where("false"), marks.where("toxic = 1")):
        scorer = toxicity.train(docs, part, toxicity.not_held_out(part["doc_id"]))
        assert toxicity.score(docs, scorer).select("score").distinct().count() == 1
    none = docs.where("false")
    assert toxicity.score(none, toxicity.train(none, marks, toxicity.not_held_out(marks["doc_id"]))).count() == 0


def test_gram_counts_agree_with_cells():
    total = np.zeros(toxicity.GRAMS, np.int64)
    toxicity.count_grams("Ab c1ä", total)
    want = np.zeros(toxicity.GRAMS, np.int64)
    e = toxicity.EDGE
    for w in ("ab", "c", "ä"):
        s = e + e + w + e
        for i in range(2, len(s)):
            for g in (s[i], s[i - 1 : i + 1], s[i - 2 : i + 1]):
                want[toxicity.cell(g)] += 1
    assert (total == want).all()


def test_quality(labelled):
    docs, marks = labelled
    model = quality.train(docs, marks, toxicity.not_held_out(marks["doc_id"]))
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    held = marks.where(~toxicity.not_held_out(F.col("doc_id")) & F.col("quality").isNotNull()).collect()
    assert np.mean([(got[r["doc_id"]] >= 0.5) == (r["quality"] == 1) for r in held if r["doc_id"] in got]) > 0.97
    assert len(got) == docs.count() and quality.score(docs.where("false"), model).count() == 0
    flat = quality.train(docs, marks.where("quality = 1"), toxicity.not_held_out(F.col("doc_id")))
    assert quality.score(docs, flat).select("score").distinct().count() == 1


def test_views_teach_each_other():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 400).astype(float)
    a, b = (y[:, None] * 2 - 1) + rng.normal(0, 0.7, (400, 3)), (y[:, None] * 2 - 1) + rng.normal(0, 0.7, (400, 3))
    few = slice(0, 12)
    alone = quality.ridge(b[few], y[few])
    taught = quality.co_train((a[few], b[few]), y[few], (a[12:300], b[12:300]))[1]
    right = lambda w: ((quality.logit(w, b[300:]) > 0) == (y[300:] > 0)).mean()
    assert right(taught) >= right(alone) and right(taught) > 0.9


def test_blocks():
    page = "<html><head><title>T</title></head><body><p>One<br>two &amp; three<p>four <b>five</b></p><script>if (a<b) '</p>'</script><ul><li>x<li>y</ul>end"
    assert html_extract.Blocks(page).texts == ["One two & three", "four five", "x", "y", "end"]
    assert html_extract.Blocks("").texts == [] and html_extract.Blocks("a <b").texts == ["a <b"]


def test_gradients():
    model = html_extract.Labeller(1)
    xs = [(d, y) for d, y in html_extract.examples(4, 11)][:3]
    x, mask = html_extract.padded([html_extract.dense(d) for d, _ in xs])
    y = np.zeros(mask.shape)
    for k, (_, own) in enumerate(xs):
        y[: len(own), k] = own
    _, g = model.step(x, mask, y)
    for key, at in (("Uf", (2, 5)), ("Wb", (html_extract.PATHS + 3, 7)), ("cb", (1,)), ("V", (3,))):
        w = model.p[key]
        keep, e = w[at], 1e-5
        w[at] = keep + e
        up = model.step(x, mask, y)[0]
        w[at] = keep - e
        down = model.step(x, mask, y)[0]
        w[at] = keep
        assert g[key][at] == pytest.approx((up - down) / (2 * e), rel=1e-3, abs=1e-8)


def test_labeller_on_held_out_pages():
    model, wrong, total = html_extract.trained(), 0, 0
    for d, y in html_extract.examples(150, 321):
        wrong += int(((model.probabilities([d])[0] >= 0.5) != (y > 0)).sum())
        total += len(y)
    assert total > 2000 and wrong / total < 0.01


@needs_data
def test_article_text(spark):
    import html

    def truth(page):
        body = re.sub("<br>", " ", re.search("<article>(.*?)</article>", page, re.S)[1])
        parts = re.split("</?(?:h1|p)>", re.sub("</?b>", "", body))
        return "\n".join(t for p in parts if (t := " ".join(html.unescape(p).split())))

    pages = table(spark, DATA, "pages")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extract.extract(pages).collect()}
    for r in pages.collect():
        assert got[r["page_id"]] == (truth(r["html"]), len(truth(r["html"])))


def test_article_edge_cases(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "plain  text &amp; more"), (1, "u", None)]
    out = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")))
    assert sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in out.collect()) == [("1", "", 0), ("1", "", 0), ("2", "", 0), ("None", "plain text & more", 17)]
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@needs_data
def test_pipeline(spark):
    """Each stage on what its predecessor kept, against brute force."""
    from test_llm_exact import lower
    from test_similar import brute as brute_similar

    import corpus_pipeline
    from corvane.llm._common import stored

    docs = table(spark, "/root/testdata/sf0.001", "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stored(stage(spark, docs, "/root/testdata/sf0.001"), name)
        seen[name] = (before, docs.collect())
        if name != "bpe":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    before, after = seen["exact_dedup"]
    best = {}
    for r in before:
        best[lower(r["text"])] = max(best.get(lower(r["text"]), -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in after) == sorted(best.values())
    before, after = seen["simhash_near_dedup"]
    # five-word shingles with a similarity of 0.8 or more
    assert sorted(r["doc_id"] for r in after) == brute_similar(sorted((r["doc_id"], r["text"]) for r in before))
    before, after = seen["mixing"]
    assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before}
    assert len(seen["bpe"][1]) == len(seen["mixing"][1]) and corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() == len(seen["bpe"][1])
