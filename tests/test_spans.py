"""Span rows of a stream against a plain fold, for any split into batches."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from corvane.streaming import spans

T0, SILENCE = datetime(2024, 1, 1), timedelta(minutes=10)
COLUMNS = [*(x.split(" ")[0] for x in spans.EVENT.split(", ")), "at"]
EPOCH, MICRO = datetime(1970, 1, 1), timedelta(microseconds=1)
micros = lambda t: (t - EPOCH) // MICRO


def events(seed, n=160):
    rng, at, out = random.Random(seed), T0, []
    for i in range(n):
        at += timedelta(seconds=rng.choice([0, 1, 5, 60, 200, 900]))
        action = rng.choice(["insert"] * 4 + ["update"] * 4 + ["cancel", "rename"])
        out.append((f"t{rng.randint(0, 3)}", at, i, action, rng.choice([None, "root"]), rng.choice("ab"), "stage", rng.choice([None, "running", "completed", "failed"]) if action != "insert" else rng.choice([None, "pending"]), rng.choice([None, "E1"]), rng.choice([None, "went wrong"]), f"k{i}"))
    return out


def plain(rows):
    """One pass over all events of a trace with a dict; then what has been silent at the last event is closed."""
    out, now = set(), max(r[1] for r in rows)
    for trace in {r[0] for r in rows}:
        held, last, knowledge = {}, None, None
        rule = spans.Trace(held, SILENCE // MICRO)
        for r in sorted((r for r in rows if r[0] == trace), key=lambda r: (r[1], r[2])):
            e = Row(*COLUMNS)(*r, micros(r[1]))
            knowledge = e.knowledge_id if knowledge is None or e.action == "rename" else knowledge
            rule.apply(e, last)
            last = e.at
        if last + SILENCE // MICRO < micros(now):
            rule.close(last + SILENCE // MICRO, spans.STALE_CODE, spans.SILENT)
        when = lambda t: None if t is None else EPOCH + t * MICRO
        out |= {(trace, knowledge, *key, *s[:4], *map(when, s[4:])) for key, s in held.items()}
    return out


@pytest.mark.parametrize("cuts", [1, 7])
def test_any_split_equals_a_fold(spark, tmp_path, cuts):
    rows = events(cuts)
    frame = spark.createDataFrame(rows, spans.EVENT)
    size = -(-len(rows) // cuts)
    for k in range(cuts):
        spark.createDataFrame(rows[k * size : (k + 1) * size], spans.EVENT).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    got = spans.fold(frame, f"file://{tmp_path}/out", f"file://{tmp_path}/check", SILENCE, f"file://{tmp_path}/in")
    if cuts > 1:
        assert len(list((tmp_path / "out").iterdir())) >= cuts
    now = F.lit(max(r[1] for r in rows))
    final = spans.current(got, SILENCE, now).select("trace_id", "knowledge_id", "parent", "name", "kind", *spans.FIELDS)
    assert {tuple(r) for r in final.collect()} == plain(rows)


def test_rules():
    held = {}
    rule = spans.Trace(held, SILENCE // MICRO)
    last = micros(T0)
    e = lambda i, action, **k: Row(*COLUMNS)("t", T0 + timedelta(minutes=i), i, action, None, k.get("name", "a"), "stage", k.get("status"), k.get("code"), k.get("message"), "k", micros(T0 + timedelta(minutes=i)))
    key = (None, "a", "stage")
    rule.apply(e(0, "update", status="failed"), None)
    assert not held  # nothing to update
    rule.apply(e(1, "insert"), last)
    rule.apply(e(2, "update", status="failed", code="E", message="m"), last)
    assert held[key][:4] == (1, "failed", "E", "m") and held[key][5] == micros(T0 + timedelta(minutes=2))
    rule.apply(e(3, "insert", status="pending"), last)
    assert held[key][:4] == (1, "pending", "", "") and held[key][5] is None  # refreshed, with its id
    rule.apply(e(4, "cancel", message="stop"), last)
    assert held[key][1:4] == ("cancelled", "CANCELLED", "stop")
    rule.apply(e(5, "cancel"), last)
    assert held[key][3] == "stop"  # closed already
