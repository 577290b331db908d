"""Evaluation runs and their results, kept as versions of append-only tables.

A run's changes are rows; its state is the last value of each field. Results of a run are committed once under its name. Any version can be read
again. Reports go out as JSON lines, whole or not at all, and as Markdown.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.sources.jsonlines import JsonLines
from corvane.storage import Versioned

RUN = "run_id string, dataset_id string, dataset_version string, status string, error_message string, config string, knowledge_base_ids array<string>, started_at timestamp, finished_at timestamp, changed bigint"
CHANGING = ("status", "error_message", "config", "finished_at")


class EvaluationStore:
    def __init__(self, store: Versioned) -> None:
        self.store, self.spark = store, store.spark

    @classmethod
    def at(cls, spark: SparkSession, root: str, version: int | None = None) -> EvaluationStore:
        return cls(Versioned(spark, root, version))

    def _append(self, name: str | None, **fields: object) -> None:
        names = [c.split(" ")[0] for c in RUN.split(", ")]
        row = tuple(self.store.version + 1 if c == "changed" else fields.get(c) for c in names)
        self.store.commit({"runs": self.store.write(self.spark.createDataFrame([row], RUN).coalesce(1), "runs")}, name)

    def create_run(self, run_id: str, dataset_id: str, dataset_version: str, config: Mapping | None = None, knowledge_base_ids: list[str] | None = None, now: datetime | None = None) -> None:
        """A running run; an id that is there changes nothing."""
        if self.store.done(f"run-{run_id}") is None:
            self._append(f"run-{run_id}", run_id=run_id, dataset_id=dataset_id, dataset_version=dataset_version, status="running", error_message="", config=json.dumps(dict(config or {}), ensure_ascii=False), knowledge_base_ids=list(knowledge_base_ids or []), started_at=now or datetime.now(timezone.utc))

    def update_run(self, run_id: str, **fields: object) -> None:
        """Other fields than CHANGING are left out; no field is no change."""
        fields = {k: v for k, v in fields.items() if k in CHANGING}
        if self.store.done(f"run-{run_id}") is None:
            raise KeyError(run_id)
        if fields:
            self._append(None, run_id=run_id, **fields)

    def finish_run(self, run_id: str, status: str, error_message: str = "", now: datetime | None = None) -> None:
        self.update_run(run_id, status=status, error_message=error_message, finished_at=now or datetime.now(timezone.utc))

    def add_results(self, run_id: str, results: DataFrame) -> bool:
        """Commits all results (case_id and any other columns) of a run at once; False if the run has results already."""
        if self.store.done(f"results-{run_id}") is not None:
            return False
        rows = results.select(F.lit(run_id).alias("run_id"), *results.columns)
        self.store.commit({"results": self.store.write(rows, "results")}, f"results-{run_id}")
        return True

    def runs(self) -> DataFrame:
        """Every run's state, the latest start first."""
        rows = self.store.table("runs")
        if rows is None:
            return self.spark.createDataFrame([], RUN)
        last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("changed"))).alias(c)
        return rows.groupBy("run_id").agg(*[last(c) for c in rows.columns if c not in ("run_id", "changed")]).orderBy(F.desc("started_at"), "run_id")

    def results(self, run_id: str | None = None) -> DataFrame | None:
        rows = self.store.table("results")
        return rows if rows is None or run_id is None else rows.where(F.col("run_id") == run_id)

    def summary(self, metrics: list[str]) -> DataFrame:
        """run_id, status, results and the average of each metric, to four places; null without results."""
        runs, rows = self.runs().select("run_id", "status"), self.results()
        if rows is None:
            return runs.select("*", F.lit(0).cast("bigint").alias("results"), *[F.lit(None).cast("double").alias(m) for m in metrics])
        means = rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("results"), *[F.round(F.avg(m), 4).alias(m) for m in metrics])
        return runs.join(means, "run_id", "left").select("run_id", "status", F.coalesce("results", F.lit(0)).alias("results"), *metrics)

    def worst(self, metric: str, n: int) -> DataFrame:
        """The n cases of each run with the lowest score, for its report."""
        w = Window.partitionBy("run_id").orderBy(metric, "case_id")
        return self.results().withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)

    def write_results(self, run_id: str, folder: str) -> None:
        """A run's results as JSON lines; written once."""
        self.spark.dataSource.register(JsonLines)
        self.results(run_id).write.format("corvane_jsonl").mode("append").option("path", folder).option("run", run_id).save()
