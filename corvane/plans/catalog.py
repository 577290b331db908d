"""All queries by name, with the SQL that says the same."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from corvane.plans.registry import ORACLE_SQL, QUERIES, Query

PLANS = ("retrieval", "ingest", "library", "enriched", "layouts", "traces", "bookkeeping", "knowledge", "evaluations", "more", "lifecycle")
for _name in PLANS:
    import_module(f"corvane.plans.{_name}")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk, search by keyword and overlap, and fuse, for all questions."""
    return QUERIES["d1_weighted_rrf"](spark, sf_dir)
