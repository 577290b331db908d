"""Near copies of the pipeline's stage against brute force."""

import re

import numpy as np

from corvane.llm import similar

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = [x.lower() for x in WORDS(text or "")]
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """The smallest id of every component of pairs with a similarity of 0.8 or more."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both, one = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if 5 * both >= 4 * one:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return sorted({rows[k][0] for k in label})


def edited(rng, words, n):
    out = list(words)
    for k in range(n):
        out[int(rng.integers(len(out)))] = f"new{k}-{rng.integers(0, 999)}"
    return out


def test_near_copies_of_every_distance(spark):
    rng = np.random.default_rng(2)
    base = [[f"w{rng.integers(0, 4000)}" for _ in range(n)] for n in (7, 30, 80, 200, 400)]
    rows, line = [], "the licence line that very many of the texts hold word by word".split()
    for b in base:
        for n in (0, 0, 1, 2, 4, 7, 11, 16, 20):
            rows.append(edited(rng, b, n) if n else list(b))
    rows += [[*line, *[f"u{rng.integers(0, 9999)}" for _ in range(3 + k % 9)]] for k in range(60)]  # one shared line, some close to each other
    rows += [edited(rng, base[3], 3) for _ in range(25)]  # a large cluster
    rows += [None, [], ["A", "b"], ["a", "B"], ["b", "a"]]
    rows = [(i + 1, t if t is None else " ".join(t)) for i, t in enumerate(rows)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    kept = similar.drop_similar(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == brute(rows)
    assert similar.drop_similar(docs.where("false")).count() == 0


def test_stage_drops_near_copies_beyond_two_bits(spark):
    import corpus_pipeline

    words = [f"w{k}" for k in range(200)]
    rows = [(1, " ".join(words), "en", "s", 1), (2, " ".join([*words[:50], "x", *words[51:140], "y", *words[141:]]), "en", "s", 1), (3, " ".join(words[::-1]), "en", "s", 1)]
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    assert [r["doc_id"] for r in stage(spark, spark.createDataFrame(rows, DOCS), "").orderBy("doc_id").collect()] == [1, 3]


def test_rows_without_id(spark):
    rows = [(None, "a b c d e f", "en", "s", 1), (None, "A b c d e f", "en", "s", 1), (4, "g h", "en", "s", 1), (4, "g h", "en", "s", 1), (5, None, "en", "s", 1), (6, "", "en", "s", 1)]
    assert sorted(str(r["doc_id"]) for r in similar.drop_similar(spark.createDataFrame(rows, DOCS)).collect()) == ["4", "5", "None"]


def test_fingerprints_in_trees_link_without_shared_shingles(spark, monkeypatch):
    words = [f"w{k}" for k in range(300)]
    rows = [(k + 1, " ".join([*words, f"last{k}"]), "en", "s", 1) for k in range(40)] + [(90, "quite another text of some words", "en", "s", 1)]
    docs, met = spark.createDataFrame(rows, DOCS), []
    meeting = similar._meeting
    monkeypatch.setattr(similar, "_meeting", lambda *sides: met.append(meeting(*sides).count()) or meeting(*sides).limit(0))
    assert sorted(r["doc_id"] for r in similar.drop_similar(docs).collect()) == [1, 90]
    assert met == [0, 0]  # what fingerprints have joined up is not compared again


def test_texts_stay_where_they_lie(spark):
    rows = [(k, "a b c d e f g" if k % 2 else f"text number {k} of its own words", "en", "s", 1) for k in range(1, 9)]
    kept = similar.drop_similar(spark.createDataFrame(rows, DOCS))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 4, 6, 8]
    assert "Exchange hashpartitioning" not in kept._jdf.queryExecution().executedPlan().toString()


def test_whole_sets_move_for_likely_pairs_alone(spark, monkeypatch):
    """Long texts that share a passage that no sample showed are candidates of which the short sketches rule out none."""
    rng, asked = np.random.default_rng(5), []
    passage = [f"p{k}" for k in range(300)]
    texts = [[*passage, *[f"u{k}-{rng.integers(0, 99999)}" for _ in range(1500)]] for k in range(6)]
    texts.append(edited(rng, texts[2], 4))
    docs = spark.createDataFrame([(k + 1, " ".join(t), "en", "s", 1) for k, t in enumerate(texts)], DOCS)
    whole, met, meeting = similar.whole_sets, [], similar._meeting
    monkeypatch.setattr(similar, "common_grams", lambda *a: (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    monkeypatch.setattr(similar, "_meeting", lambda *sides: met.append(meeting(*sides).distinct().count()) or meeting(*sides))
    monkeypatch.setattr(similar, "whole_sets", lambda docs, need, *a: asked.append(need.count()) or whole(docs, need, *a))
    assert sorted(r["doc_id"] for r in similar.drop_similar(docs).collect()) == [1, 2, 3, 4, 5, 6]
    assert met[0] > 10
    assert sum(asked) == 2


def test_wide_sketches_never_rule_out_a_similar_pair():
    rng = np.random.default_rng(6)
    for n in (1, 2, 400, 513, 1030, 2047, 2050, 9000):
        own = np.unique(rng.integers(-(2**62), 2**62, n))
        other = np.concatenate([own[len(own) // 9 :], rng.integers(-(2**62), 2**62, n // 9 + 1)])
        x, y = similar.wide_sketch(own), similar.wide_sketch(other)
        assert similar.apart(x, y) == similar.apart(y, x) <= len(np.setxor1d(own, other))
        assert len(x) * 8 >= max(n, similar.BITS)
        far = rng.integers(-(2**62), 2**62, n)
        assert n < 400 or 9 * similar.apart(x, similar.wide_sketch(far)) > 2 * n
    assert similar.apart(similar.wide_sketch(np.zeros(0, np.int64)), similar.wide_sketch(np.array([3]))) == 1
