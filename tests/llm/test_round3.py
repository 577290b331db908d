"""Line dedup, vector codes and the filter audit against brute force, with the odd cases their docstrings define."""

import hashlib
import re
from itertools import permutations

import pytest

from corvane.llm import filter_audit, line_dedup, vector_codes

DOCS = "doc_id long, text string, source string"
LINE, OTHER = "A line that is shared", "Another line, shared too"


def fold(s):
    return s.translate({c: c + 32 for c in range(65, 91)})


def brute_lines(rows):
    """{(id, text): (kept text, n_lines, n_dropped)}; None as id sorts last."""
    order = lambda i: (i is None, i or 0)
    owner = {}
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            k = fold(line.strip(" \t\n\x0b\x0c\r"))
            if len(k) >= 10 and (k not in owner or order(i) < order(owner[k])):
                owner[k] = i
    out = {}
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if owner.get(fold(x.strip(" \t\n\x0b\x0c\r")), i) == i]
        out[i, text] = "\n".join(kept), len(lines), len(lines) - len(kept)
    return out


ODD = [
    (7, f"{LINE}\nown line of seven\n{LINE}", "a"),
    (3, f"  {LINE.upper()}\t\nx\n\nx", "a"),
    (3, f"{OTHER}\n{LINE}", "b"),  # the id again, with another text
    (9, f"{OTHER}\r\nshort\nshort\n{LINE}\n", None),
    (9, f"{OTHER}\r\nshort\nshort\n{LINE}\n", None),
    (None, f"{OTHER}\nonly without id, twice\nonly without id, twice", "a"),
    (None, "only without id, twice\n", ""),
    (1, None, "a"),
    (2, "", "b"),
    (11, "\n".join([LINE, "a long text's line"] * 20_000), "a"),
    (12, "éééééééééé\nééééééééé\n éééééééééé", "c"),
    (13, "ÉÉÉÉÉÉÉÉÉÉ\nééééééééé\néééééééééé \n éééééééééé", "c"),
]


@pytest.mark.parametrize("batches", [1, 5])
def test_lines_against_brute_force(spark, batches):
    docs = spark.createDataFrame(ODD, DOCS).withColumnRenamed("source", "n_lines")
    cut = line_dedup.drop_lines(docs, batches=batches)
    assert cut.columns == ["doc_id", "text", "n_lines", "n_lines_", "n_dropped"]
    want = brute_lines(ODD)
    key = lambda r: tuple(str(x) for x in r)
    expected = sorted(((i, want[i, t][0], s, want[i, t][1], want[i, t][2]) for i, t, s in ODD), key=key)
    assert sorted((tuple(r) for r in cut.collect()), key=key) == expected
    assert line_dedup.drop_lines(docs.limit(0), batches=batches).count() == 0


def test_runs_are_levelled_and_batches_commit_once(spark, tmp_path):
    rows = [[(b * 10 + i, f"line number {i % (b + 2)} here\nline of batch {b} here\nof all batches") for i in range(6)] for b in range(7)]
    docs = [spark.createDataFrame(r, "doc_id long, text string") for r in rows]
    thin = [line_dedup.thin_lines(d, "doc_id", "text") for d in docs]
    kind = docs[0].schema["doc_id"].dataType
    index = line_dedup.LineIndex(spark, f"file://{tmp_path}/x", kind, buckets=3, fanout=2)
    found = []
    for b in range(4):
        found += index.add(thin[b], f"b{b}").collect()
    index.close()
    # a driver that starts again goes on from the manifest, and a repeated batch changes nothing
    index = line_dedup.LineIndex(spark, f"file://{tmp_path}/x", kind, buckets=99, fanout=2)
    before = index.version
    again = index.add(thin[3], "b3").collect()
    assert index.version == before and sorted(again) == sorted(r for r in found if 30 <= r["id"] < 40)
    for b in range(4, 7):
        found += index.add(thin[b], f"b{b}").collect()
    levels = sorted(level for level, _ in index.state["runs"])
    assert levels == [0, 1, 2]
    hashes = [r["hash"] for _, name in index.state["runs"] for r in index._run(name).collect()]
    assert len(hashes) == len(set(hashes))
    index.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("corvane_run")]
    want = brute_lines([(i, t) for r in rows for i, t in r])
    assert len(found) == sum(n for _, _, n in want.values())


def brute_codes(rows):
    """(id -> (code, error)), digest; rows of one length with ids that may repeat."""
    rows = [(i, [(x * 4096).__floor__() for x in v], label) for i, v, label in rows if v is not None and all(x is not None and abs(x) < float("inf") for x in v)]
    width = len(rows[0][1]) // 8
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(8)]
    least = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:16]
    books = [[cut(v)[p] for _, v, _ in least] for p in range(8)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(6):
        new = []
        for p in range(8):
            of = {}
            for _, v, _ in rows:
                of.setdefault(near(p, cut(v)[p])[1], []).append(cut(v)[p])
            new.append([[sum(c) // len(c) for c in zip(*of[k])] if k in of else e for k, e in enumerate(books[p])])
        books = new
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out = []
    for i, v, label in rows:
        each = [near(p, x) for p, x in enumerate(cut(v))]
        out.append((i, "".join(f"{k:02x}" for _, k in each), sum(d for d, _ in each), label))
    total = {}
    for _, _, e, label in out:
        total[label] = total.get(label, 0) + e
    return sorted(((i, c, e, total[label], digest) for i, c, e, label in out), key=str)


def vectors(n, width, seed=1, scale=1.0):
    import numpy as np

    x = np.random.default_rng(seed).normal(size=(n, width)) * scale
    return [(i % 97 if i % 5 else None, [float(c) for c in v.astype("float32")], i % 3 if i % 7 else None) for i, v in enumerate(x)]


@pytest.mark.parametrize("scale", [1.0, 1e12])
def test_codes_against_brute_force(spark, scale):
    rows = vectors(150, 16, scale=scale)
    rows += [(500, None, 1), (501, [None] + [1.0] * 15, 1), (502, [float("nan")] * 16, 1), (503, [float("inf")] * 16, 1)]
    rows += rows[:20]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumnRenamed("vec_id", "id")
    frame = frame.selectExpr("id as vec_id", "embedding", "label", "1 as code", "2 as error").repartition(5)
    codes, _ = vector_codes.compress(frame)
    got = vector_codes.with_label_error(codes).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    fits = lambda x: x if x < 1 << 63 else None
    want = brute_codes(rows)
    assert sorted(((r[0], r[1], r[2], r[4]) for r in got), key=str) == sorted(((i, c, fits(e), d) for i, c, e, _, d in want), key=str)
    if scale == 1.0:
        assert sorted((tuple(r) for r in got), key=str) == want


def test_codes_of_odd_lengths(spark):
    rows = vectors(40, 8) + [(i, v + [0.5], 1) for i, v, _ in vectors(5, 8, 2)] + [(1, [], None)] + [(i, v, 2) for i, v, _ in vectors(9, 24, 3)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    codes, books = vector_codes.compress(frame)
    got = codes.collect()
    assert len(got) == len(rows) and sorted(books) == [0, 8, 24] and books[24].shape == (8, 9, 3)
    assert sum(r["code"] is None for r in got) == 5 and [(r["code"], r["error"]) for r in got if r["code"] == "00" * 8 and r["error"] == 0]
    one = [r for r in rows if len(r[1]) == 8]
    digest = brute_codes(one)[0][4]
    assert sorted((r["code"], r["error"]) for r in got if r["codebooks_sha256"] == digest) == sorted((c, e) for _, c, e, _, _ in brute_codes(one))
    empty, books = vector_codes.compress(frame.limit(0))
    assert empty.count() == 0 and not books


def brute_audit(docs, labels):
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    rows = []
    for i, t, part in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and first[t] < i}
        said = [x for x in labels if x[0] == i and i is not None]
        rows.append((part or "", {k for k, v in fails.items() if v}, any(x[1] == 1 for x in said), any(x[2] == 1 for x in said)))
    out, shares = {}, {}
    for part in {r[0] for r in rows}:
        for order in map("".join, permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                of = [r for r in rows if r[0] == part and f in r[1]]
                out[part, order, k + 1] = [len(left), len(gone), len(of) - len(gone), sum(len(r[1]) == 1 for r in of), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                shares[part, f] = shares.get((part, f), 0) + len(gone)
    return sorted((*k, *v, shares[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def test_audit_against_brute_force(spark):
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join(words[:20] * 5), "SHOUT & " * 40, "few words", "", None, " ".join(words) + " #", "\t \n", "LOUD", " ".join(f"x{i}  " for i in range(30_000))]
    docs = [(i, texts[i % len(texts)], ["a", "b", None, ""][i % 4]) for i in range(40)]
    docs += [docs[3], docs[3], (None, texts[0], "a"), (None, "no id", "a"), (None, "no id", "a"), (3, "another text of three", "b")]
    labels = [(i, i % 2, (i + 1) % 3 % 2) for i in range(0, 40, 3)] + [(3, None, None), (3, 0, 1), (None, 1, 1), (999, 1, 1)]
    frame = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 as id", "2 as part", "3 as mask", "4 as digest")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "1 as id", "2 as good")
    got = filter_audit.report(filter_audit.masks(frame, marks))
    assert sorted(tuple(r) for r in got.collect()) == brute_audit(docs, labels)
    assert filter_audit.report(filter_audit.masks(frame.limit(0), marks)).count() == 0


def test_transform_is_its_own_inverse(spark):
    rows = spark.range(1000).selectExpr("cast(id * id % 8 as int) as mask", "id % 2 as part")
    got = filter_audit.parity_sums(rows, ["part"], 3).select("part", filter_audit.cells(filter_audit.F.col("sums"), 3).alias("n")).collect()
    for r in got:
        assert r["n"] == [sum(i * i % 8 == m for i in range(1000) if i % 2 == r["part"]) for m in range(8)]
