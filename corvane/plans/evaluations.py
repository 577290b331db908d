"""Evaluation runs kept in a store."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.evaluation_store import EvaluationStore
from corvane.plans.adapters import once
from corvane.plans.knowledge import CASES, METRICS, scored_cases
from corvane.plans.registry import query
from corvane.storage import shared_path


def kept_runs(spark: SparkSession, sf_dir: str) -> EvaluationStore:
    """Two finished runs, each of half the cases; one that failed while its results were written; each asked for twice."""

    def build() -> EvaluationStore:
        store, cases = EvaluationStore.at(spark, shared_path(spark, "evaluations")), scored_cases(spark, sf_dir)
        for k in (0, 1, 2):
            run, own = f"run-{k}", cases.where(F.pmod("case_id", F.lit(2)) == k % 2)
            for _ in range(2):
                store.create_run(run, "cases", "1.0", {"k": k}, now=datetime(2024, 1, 1 + k))
                if k < 2:
                    store.add_results(run, own)
                    store.finish_run(run, "completed")
                else:
                    store.store.write(own, "results")  # and dies before it commits
                    store.finish_run(run, "failed", "stopped")
        return store

    return once(spark, sf_dir, ("documents", "labels"), "evaluations", build)


MEANS = ", ".join(f"round(avg({m}), 4) AS {m}" for m in METRICS)


@query("e8_run_listing", f"WITH {CASES} SELECT 'run-' || case_id % 2 AS run_id, 'completed' AS status, count(*) AS results, {MEANS} FROM scored GROUP BY 1 UNION ALL SELECT 'run-2', 'failed', 0, {', '.join('-1' for _ in METRICS)}")
def e8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kept_runs(spark, sf_dir).summary(list(METRICS))
    return rows.select("run_id", "status", "results", *[F.coalesce(m, F.lit(-1.0)).alias(m) for m in METRICS])


@query("sc21_result_lines", f"WITH {CASES} SELECT 'run-' || case_id % 2 AS run_id, case_id, " + ", ".join(f"CAST({m} AS DOUBLE) AS {m}" for m in METRICS) + " FROM scored")
def sc21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both finished runs' results written as JSON lines, each twice, and read back."""
    store, folder = kept_runs(spark, sf_dir), shared_path(spark, "result-lines")
    for run in ("run-0", "run-1", "run-0"):
        store.write_results(run, folder)
    kinds = "run_id string, case_id bigint, " + ", ".join(f"{m} double" for m in METRICS)
    return spark.read.schema(kinds).option("pathGlobFilter", "*.jsonl").json(folder)
