"""What is remembered of conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as X


def extract(messages: DataFrame, text_col: str = "text") -> DataFrame:
    """Messages that ask to be remembered or state a preference, unless they seem to hold a secret: kind, key, content, confidence."""
    t = messages[text_col]
    kind = X.memory_kind(t)
    rows = messages.withColumn("kind", kind).where(F.col("kind").isin("remember", "preference") & ~X.sensitive(t))
    content = F.when(F.col("kind") == "remember", X.memory_content(t)).otherwise(t)
    key = F.when((F.col("kind") == "preference") & X.any_contains(t, ("中文", "英文", "回答")), F.lit("language")).otherwise(X.memory_key(content))
    return rows.withColumn("content", content).withColumn("key", key).withColumn("confidence", F.when(F.col("kind") == "remember", 0.95).otherwise(0.9))


def upsert(base: DataFrame, new: DataFrame) -> DataFrame:
    """One active row per (scope, key): the newest content, the oldest created_at. Deleted rows stay as they are."""
    dead = base.where("status <> 'active'")
    rows = base.where("status = 'active'").unionByName(new.select(*base.columns))
    merged = rows.groupBy("scope", "key").agg(F.max_by(F.struct(*[c for c in base.columns if c not in ("scope", "key", "created_at")]), F.struct("updated_at", "id")).alias("m"), F.min("created_at").alias("created_at"))
    return merged.select("scope", "key", "created_at", "m.*").select(*base.columns).unionByName(dead)


def recall(memories: DataFrame, question: str, k: int = 8) -> DataFrame:
    """The k active memories that share most tokens with the question; then the surer, then the newer."""
    shared = F.size(F.array_intersect(X.overlap_tokens(F.col("content")), X.overlap_tokens(F.lit(question))))
    return memories.where("status = 'active'").withColumn("shared", shared).orderBy(F.desc("shared"), F.desc("confidence"), F.desc("updated_at"), "id").limit(k)


def forget(memories: DataFrame, target: Column) -> DataFrame:
    """Active memories that hold the target become deleted."""
    return memories.withColumn("status", F.when((F.col("status") == "active") & F.contains("content", target), "deleted").otherwise(F.col("status")))


def summaries(messages: DataFrame, keep: int = 10, least: int = 20, most_chars: int = 4000, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Per conversation of `least` messages or more: those before the last `keep`, joined, cut to the last characters."""
    w = Window.partitionBy(key)
    rows = messages.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("back", F.row_number().over(w.orderBy(F.desc(order)))).where((F.col("n") >= least) & (F.col("back") > keep))
    said = F.concat(F.col("role"), F.lit(": "), F.coalesce("text", F.lit("")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), said.alias("s")))), lambda x: x["s"]), "\n")
    return rows.groupBy(key).agg(F.right(joined, F.lit(most_chars)).alias("summary"), F.count(F.lit(1)).alias("messages"))
