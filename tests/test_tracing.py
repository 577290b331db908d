"""Own times, subtree sums and critical paths against a recursive walk over random trees."""

import random

from corvane.operators import tracing

SPAN = "trace_id string, span_id string, parent_id string, name string, started long, finished long"


def walk(spans):
    kids = {}
    for s in spans:
        kids.setdefault(s[2], []).append(s)
    out = {}

    def visit(s, depth, critical):
        own = set(range(s[4], s[5]))
        below = kids.get(s[1], [])
        for c in below:
            own -= set(range(c[4], c[5]))
        n, total = 1, len(own)
        last = min(below, key=lambda c: (-c[5], c[1]), default=None)
        for c in below:
            a, b = visit(c, depth + 1, critical and c is last)
            n, total = n + a, total + b
        out[s[1]] = (depth, critical, len(own), n, total)
        return n, total

    for root in kids[None]:
        visit(root, 0, True)
    return out


def test_trees_of_any_shape(spark):
    rng, rows, want = random.Random(8), [], {}
    for t in range(6):
        own = [(f"t{t}", "s0", None, "root", 0, 200)]
        for i in range(1, 40):
            parent = own[rng.choice([i - 1, rng.randrange(i)]) if t % 2 else i - 1] if t < 5 else own[0]  # chains, mixed trees, a star
            a = rng.randint(-5, 190)
            own.append((f"t{t}", f"s{i}", parent[1], f"n{i % 3}", a, a + rng.choice([0, 3, 30, 150])))
        rows += own
        want |= {(f"t{t}", k): v for k, v in walk(own).items()}
    got = tracing.trees(tracing.own_times(spark.createDataFrame(rows, SPAN).repartition(3)))
    assert {(r["trace_id"], r["span_id"]): (r["depth"], r["critical"], r["own_time"], r["spans"], r["total_own_time"]) for r in got.collect()} == want


def test_own_times_sum_to_the_length_of_a_trace_without_overlaps(spark):
    rows = [("t", "r", None, "root", 0, 100), ("t", "a", "r", "load", 0, 40), ("t", "b", "r", "index", 50, 100), ("t", "c", "a", "read", 10, 30), ("u", "x", "gone", "orphan", 5, 9)]
    got = tracing.trees(tracing.own_times(spark.createDataFrame(rows, SPAN)))
    report = {r["trace_id"]: r for r in tracing.report(got).collect()}
    assert {r["span_id"]: r["total_own_time"] for r in got.collect()}["r"] == report["t"]["length"] == 100
    assert report["t"]["critical_path"] == "root > index" and report["t"]["busiest"] == "index" and report["t"]["deepest"] == 2
    assert (report["u"]["critical_path"], report["u"]["length"]) == ("orphan", 4)


def test_current_stage(spark):
    rows = [("t", 1, "load", "done"), ("t", 2, "index", "failed"), ("t", 3, "post", "running"), ("u", 1, "load", "failed"), ("u", 2, "index", "pending"), ("v", 1, "load", "done")]
    got = tracing.current_stage(spark.createDataFrame(rows, "trace_id string, ord int, name string, status string"))
    assert {r["trace_id"]: r["stage"] for r in got.collect()} == {"t": "post", "u": "load", "v": None}


def test_spans_move_once(spark):
    rows = [("t", "r", None, "root", 0, 100), ("t", "a", "r", "load", 0, 40), ("t", "b", "a", "index", 5, 20)]
    moved = tracing.own_times(spark.createDataFrame(rows, SPAN))._jdf.queryExecution().executedPlan().toString()
    assert moved.count("Exchange hashpartitioning") == 1
