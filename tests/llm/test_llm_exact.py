"""Operators with one right answer, against brute force and edge cases."""

import hashlib
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.llm import bpe, components, exact_dedup, mixing, secrets, simhash, substring_dedup, topk

P = pytest.importorskip("public_tokenizers")
WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and long texts, ties, repeated rows, clashing names."""
    rows = [(1, "A b c", "en", "s1", 5), (2, "a B c", None, "s2", None), (2, "a B c", None, "s2", None), (3, None, "de", None, 0), (4, "", None, None, 0), (5, "x " * 30000, "en", "s1", 9), (None, "a b c", "fr", "s1", 1), (None, None, None, None, None), (7, "Ä ß", "de", "s0", 3), (8, "ä ß", "de", "s0", 3)]
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in ("digest", "kept", "size", "keep_id", "score", "positions", "label", "component_id", "key", "id")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# ---- exact dedup ---------------------------------------------------------------------------------------------------------
def brute_dedup(rows):
    best = {}
    for i, t in rows:
        own = best.setdefault(lower(t), [None, 0])
        own[1] += 1
        own[0] = i if own[0] is None or (i is not None and i > own[0]) else own[0]
    return sorted((str(i), str(best[lower(t)][0]), best[lower(t)][1], i == best[lower(t)][0], hashlib.sha256(lower(t).encode()).hexdigest()) for i, t in rows)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, F.length, lambda c: F.lit("one")])
def test_exact_dedup_with_weak_digests(odd, digest):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.verdicts(odd, digest=digest).collect())
    assert got == brute_dedup(rows)


def test_drop_copies(odd, none):
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns
    assert sorted((str(r["doc_id"]) for r in kept.collect())) == ["2", "4", "5", "7", "8"]
    assert exact_dedup.drop_copies(none).count() == 0 and exact_dedup.verdicts(none).count() == 0


def test_state_grows_with_new_arrivals(spark, tmp_path):
    path = str(tmp_path / "in")
    put = lambda rows: spark.createDataFrame(rows, "digest string, id long, locator string").write.mode("append").parquet(path)
    put([("a", 1, "f1"), ("b", 2, "f1")])
    stream = lambda: spark.readStream.schema("digest string, id long, locator string").parquet(path)
    at = str(tmp_path / "state")
    assert {r["digest"]: r["seen"] for r in exact_dedup.keyed_state(stream(), at).collect()} == {"a": 1, "b": 1}
    put([("a", 9, "f2"), ("c", 3, "f2")])
    got = {r["digest"]: (r["seen"], r["keep"], r["locator"]) for r in exact_dedup.keyed_state(stream(), at).collect()}
    assert got == {"a": (2, 9, "f2"), "b": (1, 2, "f1"), "c": (1, 3, "f2")}


# ---- top-k ---------------------------------------------------------------------------------------------------------------
def brute_topk(rows, k):
    good = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q in sorted(good):
        if q % 50 == 0:
            ranked = sorted((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
            out += [(q, n, i, -s) for n, (s, i) in enumerate(ranked[:k], 1)]
    return out


def test_topk(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.float32(rng.normal(0, 2, 6))]) for i in range(1, 400)]
    rows += [(i, [0.5] * 6) for i in range(400, 700)]  # one vector that many rows share
    rows += [(1000, None), (1001, []), (1002, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1003, [float("nan")] * 6), (1050, [1.0, 2.0]), (1051, [3.0, -2.0]), (1100, [1e15] * 6), (None, [1.0] * 6)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = [tuple(r) for r in topk.search(frame, F.expr("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()]
    want = [r for r in brute_topk(rows, 5)]
    assert [g for g in got if abs(g[3]) < 1 << 62] == [w for w in want if abs(w[3]) < 1 << 62] and len(got) == len(want)
    assert topk.search(frame.where("vec_id < 0"), F.expr("vec_id % 50 = 0")).count() == 0
    assert topk.search(frame.where("vec_id = 50"), F.expr("vec_id % 50 = 0")).count() == 0


def test_topk_counts_a_few_better_scores_once(spark):
    """A bin's part is finer than a score is wide, so its histogram goes beyond the bin, to scores that are counted already."""
    rows = [(50, [1 / 256]), *[(i, [900 / 256]) for i in (1, 2, 3)], *[(100 + i, [(889 + i % 3) / 256]) for i in range(1, 49)], (999, [1000 / 256])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.search(frame, F.expr("vec_id = 50")).orderBy("rank").collect()]
    assert got == [r for r in brute_topk(rows, 5) if r[0] == 50]
    rng = np.random.default_rng(3)
    copies = [(i, [0.5] * 3) for i in range(300, 400)] + [(i, [0.5 + float(x) for x in rng.uniform(-0.06, 0.06, 3)]) for i in range(1, 120)]
    got = [tuple(r) for r in topk.search(spark.createDataFrame(copies, "vec_id long, embedding array<double>"), F.expr("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()]
    assert got == brute_topk(copies, 5)


# ---- mixing --------------------------------------------------------------------------------------------------------------
def test_op4_stands_in_training_order(spark):
    rows = mixing.op4_mixing(spark, "/root/testdata/sf0.001").collect()
    places = [r["first_position"] for r in rows]
    met = [p for p in places if p is not None]
    assert met == sorted(met) and places == met + [None] * (len(places) - len(met)) and len({r["doc_id"] for r in rows}) == len(rows)


def test_mixing(spark, odd, none):
    rows = [(i, "w " * (i % 40), "en", f"s{i % 7}" if i % 11 else None, 1) for i in range(500)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.assign(docs).collect()
    sizes, taken, target = {}, {}, {}
    for r in got:
        source = rows[r["doc_id"]][3]
        sizes[source] = sizes.get(source, 0) + r["size"]
        taken[source] = taken.get(source, 0) + r["taken"]
        target[source] = r["target"]
        assert r["size"] == r["doc_id"] % 40 and r["taken"] <= 2 * r["size"]
        assert all(0 <= p <= 1 for p in r["positions"]) and sorted(r["positions"]) == list(r["positions"])
    order = sorted(s for s in sizes if s is not None) + [None]
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    # water filling, step by step
    left, open_, want = 1.5 * sum(sizes.values()), set(order), {}
    while True:
        level = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if level * weights[s] > 2 * sizes[s]}
        if not full:
            want |= {s: level * weights[s] for s in open_}
            break
        want |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    assert target == pytest.approx(want) and all(abs(taken[s] - want[s]) <= 1 for s in order)
    mixed = mixing.mix(docs)
    spots = [r["mix_position"] for r in mixed.collect()]
    assert spots == sorted(spots) and len(spots) == sum(len(r["positions"]) for r in got)
    assert sorted(map(tuple, mixing.assign(docs).select("doc_id", "taken").collect())) == sorted((r["doc_id"], r["taken"]) for r in got)
    assert mixing.assign(odd).count() == odd.count() and mixing.mix(odd, placed=False).columns == odd.columns
    assert mixing.assign(none).count() == 0 and mixing.mix(none).count() == 0


def test_inverse_demand(spark):
    knots = ((0.0, 0.0), (0.4, 2.0), (0.4, 0.0), (0.7, 0.0), (1.0, 1.0))
    area = 0.4 + 0.15
    share = [0.0, 0.2 / area, 0.39 / area, 0.45 / area, 1.0]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in share], "s double").select(mixing.inverse_demand(F.col("s"), knots)).collect()]
    assert got[0] == 0 and got[1] == pytest.approx(0.4 * 0.5**0.5) and got[2] < 0.4 and 0.7 < got[3] < 1 and got[4] == pytest.approx(1)


# ---- BPE -----------------------------------------------------------------------------------------------------------------
PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def coders():
    from tokenizers import Tokenizer

    return bpe.WordBpe(open(PATH, encoding="utf-8").read()), Tokenizer.from_file(PATH)


@settings(max_examples=250, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(["the", "don't", " ", "<|endoftext|>", "<|startoftext|>", "ΑΣ", "İ", "1234", "é", "é", "👍🏽", " ", "aaaaaa", "!?"]), max_size=20).map("".join)))
def test_bpe_as_the_library_does(coders, text):
    own, library = coders
    ids = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids
    assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_long_piece_and_table(spark, coders, odd, none):
    own, library = coders
    text = "abracadabra" * 3000
    assert own.encode(text) == library.encode(text, add_special_tokens=False).ids
    got = {(r["doc_id"], r["ids_sha256"]): r for r in bpe.encode_decode(odd, PATH, with_tokens=True).collect()}
    for r in odd.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        row = got[r["doc_id"], hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()]
        assert list(row["ids"]) == ids and row["n_tokens"] == len(ids)
        assert row["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_decode(none, PATH).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=40), st.data())
def test_pair_tree(ranks, data):
    if not ranks:
        return
    tree = bpe.PairTree(list(ranks))
    now = dict(enumerate(ranks))
    for _ in range(10):
        i = data.draw(st.integers(0, len(ranks) - 1))
        now[i] = data.draw(st.one_of(st.integers(0, 6), st.just(bpe.NONE)))
        tree.put(i, now[i])
        low = min(now.values())
        assert tree.root() == (bpe.NONE if low == bpe.NONE else low << 32 | min(k for k, v in now.items() if v == low))


# ---- SimHash -------------------------------------------------------------------------------------------------------------
def brute_fingerprint(text):
    w = WORDS(lower(text))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=80, deadline=None)
@given(st.one_of(st.none(), st.lists(st.sampled_from(["A", "b", "Ü", " ", "long-word", "\x1c"]), max_size=12).map(" ".join)))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def brute_components(points, radius):
    label = list(range(len(points)))
    for i in range(len(points)):
        for j in range(i):
            if (points[i] ^ points[j]).bit_count() <= radius:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 2**32), st.integers(2, 300), st.integers(1, 4))
def test_local_trees_lose_no_link(seed, n, radius):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**63, 8)
    points = np.unique(np.array([int(rng.choice(centres)) ^ sum(1 << b for b in {int(b) for b in rng.integers(0, 64, rng.integers(0, 5))}) for _ in range(n)], np.uint64))
    assert simhash.links(points, radius).tolist() == brute_components([int(p) for p in points], radius)
    # the routing tree brings every linked pair together in some leaf
    tree, _ = simhash.grow(points, 16, (radius + 1) // 2)
    leaf, at = simhash.route(points, tree, (radius + 1) // 2)
    seen = {}
    for l, i in zip(leaf.tolist(), at.tolist()):
        seen.setdefault(i, set()).add(l)
    for i in range(len(points)):
        for j in range(i):
            if (int(points[i]) ^ int(points[j])).bit_count() <= radius:
                assert seen[i] & seen[j]


def test_simhash_components(spark, odd, none):
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(base), " ".join([*base[:200], "changed", *base[201:]]), " ".join(base[::-1]), None, "", "A b", "a B", " ".join(base)]
    docs = spark.createDataFrame([(i + 1, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    fps = [brute_fingerprint(t) for t in texts]
    want = brute_components(fps, 2)
    got = {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_copies(docs).collect()}
    assert got == {i + 1: (fps[i], want[i] + 1) for i in range(len(texts))}
    assert sorted(r["doc_id"] for r in simhash.drop_near_copies(docs).collect()) == sorted({w + 1 for w in want})
    assert simhash.near_copies(odd).count() == odd.count()
    kept = simhash.drop_near_copies(odd)
    assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "5", "7", "8"]
    assert simhash.near_copies(none).count() == 0 and simhash.drop_near_copies(none).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r["node"]: r["label"] for r in components.labels(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 160))


# ---- secrets -------------------------------------------------------------------------------------------------------------
def test_secret_spans(spark, odd, none):
    text = "API_KEY = 'abcdefgh' token:xyz secret: token: abcdefg AKIA" + "Q" * 16 + " AKIA12 " + "0123456789abcdef" * 2 + " paſſword=abcdefgh ghp_" + "a1B2" * 9
    spans = [(a, secrets.KINDS[k], b) for a, k, b, _ in secrets.base_spans(text)]
    want = [(m.start(), "assign", m.end()) for m in secrets.ASSIGN.finditer(text) if len(m[2]) >= 6]
    want += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    want += [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    assert [(a, b) for a, _, b in spans] == [(a, b) for a, _, b in sorted(want, key=lambda x: (x[0], secrets.KINDS.index(x[1])))]
    assert [k for _, k, _ in spans] == ["assign", "access", "hex"]  # a failing match uses its text up; ſ is no s
    live = "ghp_" + "Zx9y" * 9
    rows = [(1, text, "en", "o1", 1), (2, f"mine {live}", "en", "o2", 1)] + [(10 + i, "shared ghp_" + "Ab1c" * 9, "en", f"o{i}", 1) for i in range(4)]
    got = {r["doc_id"]: r["found"] for r in secrets.scan(spark.createDataFrame(rows, DOCS)).collect()}
    assert [(s["start"], s["end"], s["looks"]) for s in got[2]] == [(5, 5 + len(live), "live")]
    assert got[10] == []  # copied by four owners: an example, and only suspected
    assert [s["kind"] for s in got[1]] == [0, 1, 2, 3]
    assert secrets.scan(odd).count() == odd.count() and secrets.scan(none).count() == 0


# ---- substring dedup -----------------------------------------------------------------------------------------------------
def brute_repeats(rows, window):
    seen, out = {}, {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = WORDS(t or "")
        gone, mine = [False] * len(w), []
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            mine.append(key)
            if seen.get(key, i) < i:
                gone[k : k + window] = [True] * window
        for key in mine:
            seen.setdefault(key, i)
        kept = [x for x, g in zip(w, gone) if not g]
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def test_substring_dedup(spark, odd, none, monkeypatch):
    monkeypatch.setattr(substring_dedup, "PIECE_WORDS", 120)  # passages cut into pieces, shards and salted spans
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 150)
    monkeypatch.setattr(substring_dedup, "TASK_WORDS", 300)
    rng = np.random.default_rng(5)
    word = lambda: f"w{rng.integers(0, 60)}"
    passage = [[word() for _ in range(n)] for n in (49, 50, 51, 90, 400)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.integers(1, 4)):
            p = passage[rng.integers(0, 5)]
            cut = rng.integers(0, 8)
            parts += [*[f"u{i}-{rng.integers(0, 99)}" for _ in range(rng.integers(0, 30))], *p[cut:]]
        rows.append((i + 1, " ".join(parts).replace(" ", "\n", 3)))
    rows += [(90, None), (91, ""), (92, " ".join(["same"] * 300)), (93, " ".join(["same"] * 55))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(docs).collect()}
    want = brute_repeats(rows, 50)
    assert got == want and sum(w[1] > 0 for w in want.values()) > 30
    assert substring_dedup.remove_repeats(odd).count() == odd.count() and substring_dedup.remove_repeats(none).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=14), min_size=1, max_size=5), st.lists(st.sampled_from("abcd"), max_size=30), st.integers(2, 5))
def test_automaton(passages, text, window):
    machine = substring_dedup.Automaton()
    first = {}
    for doc, p in enumerate(passages):
        machine.add(p, doc)
        for k in range(len(p) - window + 1):
            first.setdefault(tuple(p[k : k + window]), doc)
    for doc in range(len(passages) + 1):
        want = [k for k in range(len(text) - window + 1) if first.get(tuple(text[k : k + window]), doc) < doc]
        assert machine.repeats(text, window, doc) == want


def test_bpe_digests_are_those_of_its_ids_and_tokens():
    import hashlib
    import struct

    import public_tokenizers

    coder = bpe.WordBpe(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    for text in ("", " ", "a b  c\nd", "It's 2024, isn't it? \u00e9\u03a3 \u4e2d\u6587 \U0001f600 \x00", "x" * 300, *[f"{t} and{t}{t}" for t in coder.added]):
        ids = coder.encode(text)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        assert coder.digests(text) == (len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(coder.decode(ids).encode()))
        assert " ".join(said for own, said in coder.parts(text) if own) == coder.decode(ids)
