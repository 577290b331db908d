"""Scores of answers against expectations, their averages, and the comparison of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import INSUFFICIENT, any_contains

METRICS = ("citation_resolvable_rate", "required_source_hit_rate", "answer_contains_expected_terms", "graph_path_traceability_rate", "tool_plan_match_rate", "insufficient_evidence_correctness")


def rate(hits: Column, total: Column) -> Column:
    """hits / total, 1 where nothing was asked for."""
    return F.when(total == 0, 1.0).otherwise(hits / total)


def citation_rate(verified: Column, checked: Column) -> Column:
    return F.least(F.lit(1.0), rate(verified, checked))


def source_rate(expected: Column, used: Column) -> Column:
    return rate(F.size(F.array_intersect(expected, used)), F.size(F.array_distinct(expected)))


def term_rate(terms: Column, answer: Column) -> Column:
    return rate(F.size(F.filter(terms, lambda t: F.contains(F.lower(answer), F.lower(t)))), F.size(terms))


def tool_rate(expected: Column, forbidden: Column, used: Column) -> Column:
    """Half for all expected tools used, half for no forbidden one."""
    ok = (F.size(F.array_except(expected, used)) == 0).cast("int") + (~F.arrays_overlap(forbidden, used)).cast("int")
    return F.when(F.size(expected) + F.size(forbidden) == 0, 1.0).otherwise(ok / 2)


def insufficient_rate(expected: Column, answer: Column) -> Column:
    return F.when(~expected, 1.0).otherwise(any_contains(F.lower(answer), INSUFFICIENT).cast("double"))


def sufficient(question_type: Column, citations: Column, paths: Column) -> Column:
    """Dependency and impact questions need graph evidence; others a citation or a path."""
    return F.when(question_type.isin("dependency", "impact"), paths > 0).otherwise((citations > 0) | (paths > 0))


def long_form(results: DataFrame, key: str = "case_id", metrics: tuple[str, ...] = METRICS) -> DataFrame:
    return results.select(key, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("score")) for m in metrics])).alias("m")).select(key, "m.*")


def averages(scores: DataFrame) -> DataFrame:
    """metric, mean: unrounded."""
    return scores.groupBy("metric").agg(F.avg("score").alias("mean"))


def run_status(results: DataFrame) -> DataFrame:
    """failed if every case failed, partial_failed if some did, else completed."""
    bad = F.count_if(~F.col("passed"))
    return results.groupBy("run_id").agg(F.count(F.lit(1)).alias("cases"), bad.alias("failed"), F.when(bad == 0, "completed").when(bad == F.count(F.lit(1)), "failed").otherwise("partial_failed").alias("status"))


def compare(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """metric, current, baseline, delta; what one run lacks counts as 0."""
    c, b = current.select("metric", F.col("mean").alias("current")), baseline.select("metric", F.col("mean").alias("baseline"))
    rows = c.join(b, "metric", "full").na.fill(0.0, ["current", "baseline"])
    return rows.withColumn("delta", F.col("current") - F.col("baseline"))


def changed_cases(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """case_id, change: newly_failed or fixed. Both: case_id, passed."""
    rows = current.join(baseline.select("case_id", F.col("passed").alias("before")), "case_id")
    change = F.when(F.col("before") & ~F.col("passed"), "newly_failed").when(~F.col("before") & F.col("passed"), "fixed")
    return rows.withColumn("change", change).where("change IS NOT NULL").select("case_id", "change")


def report(means: DataFrame, title: str) -> DataFrame:
    """One row: a Markdown report of the averages, by metric."""
    line = F.concat(F.lit("- "), F.col("metric"), F.lit(": "), F.format_number("mean", 4))
    return means.groupBy().agg(F.concat(F.lit(f"# {title}\n"), F.array_join(F.array_sort(F.collect_list(line)), "\n")).alias("report"))
