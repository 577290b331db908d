"""Runs, results and their JSON lines: once a run, whole or not at all, at any version."""

import json
import os

import pytest
from pyspark.sql import functions as F

from corvane.operators.evaluation_store import EvaluationStore
from corvane.sources.jsonlines import JsonLines


def results(spark, n, start=0):
    return spark.range(start, start + n, 1, 3).select(F.col("id").alias("case_id"), (F.col("id") / 10).alias("score"))


def test_runs_and_results(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    store = EvaluationStore.at(spark, root)
    assert store.runs().count() == 0 and store.results() is None
    store.create_run("a", "set", "1.0", {"k": 1}, ["kb"])
    assert store.summary(["score"]).first()["results"] == 0
    assert store.add_results("a", results(spark, 4)) and not store.add_results("a", results(spark, 9))
    early = store.store.version
    store.create_run("a", "other", "2.0")
    store.update_run("a", nothing="changes")
    assert store.store.version == early
    store.finish_run("a", "completed")
    store.create_run("b", "set", "1.0")
    with pytest.raises(KeyError):
        store.finish_run("absent", "failed")
    with pytest.raises(Exception):
        store.add_results("b", results(spark, 4).select("case_id", F.raise_error(F.lit("broken")).alias("score")))
    again = EvaluationStore.at(spark, root)
    assert [(r["run_id"], r["status"], r["dataset_id"]) for r in again.runs().orderBy("run_id").collect()] == [("a", "completed", "set"), ("b", "running", "set")]
    assert {r["run_id"]: (r["results"], r["score"]) for r in again.summary(["score"]).collect()} == {"a": (4, 0.15), "b": (0, None)}
    assert EvaluationStore.at(spark, root, early).runs().first()["status"] == "running"
    assert [r["case_id"] for r in again.worst("score", 2).orderBy("place").collect()] == [0, 1]


def test_json_lines_are_whole_and_written_once(spark, tmp_path):
    spark.dataSource.register(JsonLines)
    folder = f"{tmp_path}/lines"
    put = lambda df, run: df.write.format("corvane_jsonl").mode("append").option("path", f"file://{folder}").option("run", run).save()
    lines = lambda: sorted(json.loads(x)["case_id"] for f in os.listdir(folder) if f.endswith(".jsonl") for x in open(f"{folder}/{f}"))
    put(results(spark, 5), "one")
    put(results(spark, 7), "one")
    assert lines() == [0, 1, 2, 3, 4]
    broken = results(spark, 6, 100).withColumn("score", F.when(F.col("case_id") == 104, F.raise_error(F.lit("broken"))).otherwise(1.0))
    with pytest.raises(Exception):
        put(broken, "two")
    assert lines() == [0, 1, 2, 3, 4] and not [f for f in os.listdir(folder) if f.startswith(".two")]
    put(results(spark, 2, 100), "two")
    assert lines() == [0, 1, 2, 3, 4, 100, 101]
    odd = spark.createDataFrame([(1, {"k": [1, None]}, "é\n")], "case_id long, m map<string,array<int>>, t string").withColumn("s", F.struct("t", F.lit("2024-01-01").cast("date").alias("d")))
    put(odd, "three")
    assert '{"case_id": 1, "m": {"k": [1, null]}, "s": {"d": "2024-01-01", "t": "é\\n"}, "t": "é\\n"}\n' in [x for f in os.listdir(folder) if f.startswith("three") for x in open(f"{folder}/{f}")]
