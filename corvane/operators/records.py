"""Bookkeeping of a multi-tenant knowledge base: merges, scoped listings, counts, roll-ups, state changes.

Tables are DataFrames and every change is a function from tables to tables. Merges are one shuffle on the key; scopes are plain
comparisons that reach the scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(base: DataFrame, new: DataFrame, key: Sequence[str], keep: Sequence[str] = ("created_at",), partial: bool = False) -> DataFrame:
    """base with the rows of new in place of those with their key; `keep` columns stay as they were. With `partial`, nulls of new change nothing."""
    old = base.select(*key, *[F.col(c).alias(f"old_{c}") for c in base.columns if c not in key], F.lit(True).alias("was"))
    now = new.select(*base.columns, F.lit(True).alias("is"))
    rows = old.join(now, list(key), "full")

    def value(c: str) -> Column:
        if c in keep:
            return F.coalesce(F.col(f"old_{c}"), F.col(c))
        return F.coalesce(F.col(c), F.col(f"old_{c}")) if partial else F.when(F.col("is"), F.col(c)).otherwise(F.col(f"old_{c}"))

    return rows.select(*[F.col(c) if c in key else value(c).alias(c) for c in base.columns])


def replace_groups(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of base whose key occurs in new make way for those of new."""
    return base.join(new.select(key).distinct(), key, "left_anti").unionByName(new.select(*base.columns))


def insert_missing(base: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    return base.unionByName(new.join(base.select(*key), list(key), "left_anti").select(*base.columns))


def delete_documents(tables: dict[str, DataFrame], doomed: DataFrame, unlink: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Tables (by name, each with doc_id) without the doomed documents' rows; in those of `unlink` the named column becomes null instead."""
    ids, unlink = doomed.select("doc_id").distinct(), unlink or {}
    out = {}
    for name, df in tables.items():
        if name in unlink:
            col = unlink[name]
            gone = ids.select(F.col("doc_id").alias(col), F.lit(True).alias("gone"))
            out[name] = df.join(gone, col, "left").withColumn(col, F.when(F.col("gone").isNull(), F.col(col))).select(*df.columns)
        else:
            out[name] = df.join(ids, "doc_id", "left_anti")
    return out


def filter_documents(docs: DataFrame, text: str = "", file_type: str = "", parse_status: Sequence[str] = (), source: str = "", updated_from: str = "", updated_to: str = "") -> DataFrame:
    """Documents that hold the text (any case) in name, path or source, of a type and status, changed in a range of time."""
    rows = docs
    if text:
        rows = rows.where(F.lower(F.concat_ws(" ", "name", "storage_path", "knowledge_base_id")).contains(text.lower()))
    if file_type:
        rows = rows.where(F.col("file_type") == file_type)
    if parse_status:
        rows = rows.where(F.col("parse_status").isin(*parse_status))
    if source:
        rows = rows.where(F.lower("storage_path").contains(source.lower()))
    if updated_from:
        rows = rows.where(F.col("updated_at") >= updated_from)
    return rows.where(F.col("updated_at") <= updated_to) if updated_to else rows


def zero_filled(counts: DataFrame, asked: DataFrame, key: str, value: str = "n") -> DataFrame:
    """Counts of the asked keys, 0 where there is nothing."""
    return asked.select(key).distinct().join(counts, key, "left").select(key, F.coalesce(value, F.lit(0)).alias(value))


def base_rollup(bases: DataFrame, docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per knowledge base: documents, indexed chunks, documents processing and failed.

    Chunks are counted by document first and documents by base next, so no join multiplies rows.
    """
    per_doc = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"))
    per_base = docs.join(per_doc, "doc_id", "left").groupBy("base_id").agg(
        F.count(F.lit(1)).alias("documents"),
        F.coalesce(F.sum("chunks"), F.lit(0)).alias("indexed_chunks"),
        F.count_if(F.col("status") == "processing").alias("processing"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )
    return bases.select("base_id").join(per_base, "base_id", "left").na.fill(0, ["documents", "indexed_chunks", "processing", "failed"])


def status_counts(files: DataFrame, key: str, statuses: Sequence[str], status: str = "status") -> DataFrame:
    return files.groupBy(key).agg(*[F.count_if(F.col(status) == s).alias(s) for s in statuses], F.count(F.lit(1)).alias("total"))


def batch_status(files: DataFrame, key: str, status: str = "status") -> DataFrame:
    """A batch's end: failed and completed files make partial_failed; failed ones failed; only cancelled ones cancelled; else completed."""
    has = lambda s: F.bool_or(F.col(status) == s)
    end = F.when(has("failed") & has("completed"), "partial_failed").when(has("failed"), "failed").when(F.bool_and(F.col(status) == "canceled"), "canceled").otherwise("completed")
    return files.groupBy(key).agg(end.alias("batch_status"))


def latest(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row of each key."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def next_number(rows: DataFrame, key: str, value: str) -> DataFrame:
    return rows.groupBy(key).agg((F.coalesce(F.max(value), F.lit(0)) + 1).alias("next"))


def describe(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """field, n, least, most, mean of each numeric field, in one pass."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("x")) for f in fields])).alias("v")).select("v.*")
    return long.where("x IS NOT NULL").groupBy("field").agg(F.count("x").alias("n"), F.min("x").alias("least"), F.max("x").alias("most"), F.avg("x").alias("mean"))


def orphans(images: DataFrame, operations: DataFrame) -> DataFrame:
    """Images that no operation is processing or has completed."""
    busy = operations.where(F.col("status").isin("processing", "completed")).select("image_id")
    return images.join(busy, "image_id", "left_anti")


def claimable(tasks: DataFrame, now: Column, k: int = 1) -> DataFrame:
    """The k earliest tasks that are due, or whose lease has run out."""
    due = (F.col("status") == "pending") & (F.col("next_run_at") <= now) | (F.col("status") == "processing") & (F.col("lease_until") < now)
    return tasks.where(due).orderBy("next_run_at", "created_at", "id").limit(k)


def visible_audits(queries: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Audited queries all of whose knowledge bases are in the scope."""
    return queries.where(F.size(F.array_except("base_ids", F.array(*[F.lit(s) for s in scope]))) == 0)


def with_defaults(metadata: Column, defaults: dict[str, str]) -> Column:
    """A metadata map with the defaults where it has no value of its own."""
    pairs = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv])
    own = F.map_keys(metadata)
    return F.map_concat(F.map_filter(pairs, lambda k, _: ~F.array_contains(own, k)), metadata)


PHASES = ("upload", "parse", "chunk", "index", "enrich", "postprocess")  # fixed order


def phase_report(phases: Column) -> Column:
    """All phases in order from an array of (name, status, retryable): what is not there is pending. A failed, retryable one may be tried again."""
    one = lambda name: F.try_element_at(F.filter(phases, lambda p: p["name"] == name), F.lit(1))
    return F.array(*[F.struct(F.lit(n).alias("name"), F.coalesce(one(n)["status"], F.lit("pending")).alias("status"), (F.coalesce(one(n)["status"] == "failed", F.lit(False)) & F.coalesce(one(n)["retryable"], F.lit(False))).alias("can_retry")) for n in PHASES])


FORBIDDEN = ("insert", "update", "delete", "drop", "alter", "create", "attach", "detach", "pragma", "vacuum", "replace", "truncate")  # fixed words


def guarded_sql(spark, statement: str, limit: int = 100) -> DataFrame:
    """A single SELECT or WITH over registered views, limited; anything else raises."""
    import re

    text = statement.strip().rstrip(";").strip()
    if ";" in text or not re.match(r"(?is)^(select|with)\b", text) or re.search(rf"(?i)\b({'|'.join(FORBIDDEN)})\b", text):
        raise ValueError("only one SELECT or WITH statement is allowed")
    return spark.sql(f"SELECT * FROM ({text}) LIMIT {int(limit)}")


def safe_path(path: Column) -> Column:
    """A relative upload path with cleaned segments; null for absolute paths, drives and dot segments."""
    p = F.trim(path)
    parts = F.filter(F.split(p, r"[\\/]+"), lambda s: s != "")
    bad = (p == "") | p.rlike(r"^[\\/]") | p.rlike(r"^[A-Za-z]:[\\/]") | F.exists(parts, lambda s: s.isin(".", ".."))
    clean = F.transform(parts, lambda s: F.regexp_replace(s, r"[^\p{L}\p{N}._-]+", "_"))
    return F.when(~bad, F.array_join(clean, "/"))


def unique_names(rows: DataFrame, key: Sequence[str], name: str, order: str) -> DataFrame:
    """Repeated names of a key get -1, -2, ... by order."""
    w = Window.partitionBy(*key, name).orderBy(order)
    n = F.row_number().over(w) - 1
    return rows.withColumn("unique_name", F.when(n == 0, F.col(name)).otherwise(F.concat(name, F.lit("-"), n.cast("string"))))
