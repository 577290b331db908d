"""Fusing ranked lists, removing duplicates, reranking gates and diversity.

Fusion is one aggregation by (query, chunk). Order-dependent selections (near-duplicates, diversity) work on a query's short hit
list, which an earlier top-k has bounded; they run as one grouped map a query.
"""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DENSE_WEIGHT, KEYWORD_WEIGHT, RANK_CONSTANT = 0.7, 0.3, 60
LAMBDA, NEAR = 0.75, 0.92


def weighted_rrf(lists: dict[str, tuple[DataFrame, float]], k: int = RANK_CONSTANT, key: tuple[str, ...] = ("query_id", "chunk_id")) -> DataFrame:
    """key columns, rrf = sum of weight / (k + rank), first_seen (the list and rank of the first occurrence) and the lists' scores."""
    parts = None
    for place, (name, (hits, weight)) in enumerate(lists.items()):
        part = hits.select(*key, "rank", F.lit(name).alias("list"), F.lit(place).alias("place"), F.lit(float(weight)).alias("weight"), F.col("score").cast("double").alias("score"))
        parts = part if parts is None else parts.unionByName(part)
    one = lambda name: F.max(F.when(F.col("list") == name, F.col("score"))).alias(f"{name}_score")
    return parts.groupBy(*key).agg(F.sum(F.col("weight") / (F.lit(k) + F.col("rank"))).alias("rrf"), F.min(F.struct("place", "rank")).alias("first_seen"), *[one(n) for n in lists])


def weighted_sum(lists: dict[str, tuple[DataFrame, float]], key: tuple[str, ...] = ("query_id", "chunk_id")) -> DataFrame:
    """key columns and score = sum of weight times raw score."""
    parts = None
    for _, (hits, weight) in lists.items():
        part = hits.select(*key, (F.lit(float(weight)) * F.col("score")).alias("s"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy(*key).agg(F.sum("s").alias("score"))


def concatenated_ranks(variants: DataFrame) -> DataFrame:
    """Ranks over a question's query variants laid end to end: (question, variant, rank) -> rank in the whole list."""
    w = Window.partitionBy("query_id").orderBy("variant", "variant_rank")
    return variants.withColumn("rank", F.row_number().over(w))


def merge_variants(hits: DataFrame) -> DataFrame:
    """One row per (query, chunk) over variants: best rank, best score and the variants that found it, in order."""
    return hits.groupBy("query_id", "chunk_id").agg(F.min("rank").alias("rank"), F.max("score").alias("score"), F.array_sort(F.collect_set("variant")).alias("matched_variants"))


def fused_cut(fused: DataFrame, score: str, n: int = 30) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round(score, 12)), "first_seen", "chunk_id")
    return fused.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


def drop_exact_duplicates(hits: DataFrame, score: Column, signature: Column, parent: str = "parent_id") -> DataFrame:
    """The best hit of every content signature, then of every parent, a query."""
    order = lambda key: Window.partitionBy("query_id", key).orderBy(F.desc("sort_score"), "chunk_id")
    rows = hits.withColumn("sort_score", score).withColumn("signature", signature)
    for key in ("chunk_id", "signature", parent):
        rows = rows.withColumn("rn", F.row_number().over(order(key))).where("rn = 1").drop("rn")
    return rows.drop("signature", "sort_score")


def flat(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip().lower()


def similarity(left: str, right: str) -> float:
    """Length ratio if one holds the other, else the matching-blocks ratio of their first 1000 characters."""
    a, b = flat(left), flat(right)
    if not a or not b:
        return 0.0
    short, long = sorted((a, b), key=len)
    return len(short) / len(long) if short in long else SequenceMatcher(None, a[:1000], b[:1000]).ratio()


def drop_near_duplicates(hits: DataFrame, score: str = "score", near: float = NEAR) -> DataFrame:
    """Greedy, best score first: a hit goes if a kept one has its id, its parent, its signature or nearly its content. Input: a short list a query."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([score, "chunk_id"], ascending=[False, True], kind="stable")
        seen: set[tuple] = set()
        kept, texts = [], []
        for i, r in enumerate(rows.itertuples(index=False)):
            marks = {("id", r.chunk_id), ("sign", flat(r.content)[:500]) if flat(r.content) else ("id", r.chunk_id), ("parent", r.parent_id or r.chunk_id)}
            if marks & seen or any(similarity(t, r.content) >= near for t in texts):
                continue
            seen |= marks
            kept.append(i)
            texts.append(r.content)
        return rows.iloc[kept]

    return hits.groupBy("query_id").applyInPandas(one, hits.schema)


def diverse(hits: DataFrame, k: int, score: str = "score", weight: float = LAMBDA) -> DataFrame:
    """Maximal marginal relevance: takes the hit with the best weight * score - (1 - weight) * similarity to those taken; the first
    of equals wins; lists of k or fewer stay as they are. Adds `position`."""
    schema = hits.withColumn("position", F.lit(0)).schema

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([score, "chunk_id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        left, taken = list(range(len(rows))), []
        if len(rows) <= k:
            taken = left
        else:
            texts, worth = rows["content"].tolist(), rows[score].tolist()
            close = [0.0] * len(rows)
            while left and len(taken) < k:
                best = max(left, key=lambda i: (weight * worth[i] - (1 - weight) * close[i], -i))
                taken.append(best)
                left.remove(best)
                for i in left:
                    close[i] = max(close[i], similarity(texts[i], texts[best]))
        out = rows.iloc[taken].copy()
        out["position"] = range(1, len(out) + 1)
        return out[[f.name for f in schema]].astype({"position": "int32"})

    return hits.groupBy("query_id").applyInPandas(one, schema)


def gate(reranked: DataFrame, threshold: float = 0.3, fallback: float = 0.15, least: int = 1, score: str = "reranker_score") -> DataFrame:
    """Hits at the threshold; if a query has none, those at the fallback; if none either, its first `least` hits. Adds `gate`."""
    w = Window.partitionBy("query_id")
    best = F.max(score).over(w)
    rows = reranked.withColumn("best", best).withColumn("place", F.row_number().over(w.orderBy(F.desc(score), "chunk_id")))
    rows = rows.withColumn("gate", F.when(F.col("best") >= threshold, "threshold").when(F.col("best") >= fallback, "fallback").otherwise("least"))
    keep = F.when(F.col("gate") == "threshold", F.col(score) >= threshold).when(F.col("gate") == "fallback", F.col(score) >= fallback).otherwise(F.col("place") <= least)
    return rows.where(keep).drop("best", "place")


def low_recall(hits: DataFrame, queries: DataFrame, least: int = 3, least_score: float = 0.2) -> DataFrame:
    """query_id of the queries with too few hits, or too weak ones."""
    found = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best"))
    return queries.select("query_id").join(found, "query_id", "left").where(F.coalesce("n", F.lit(0)).__lt__(least) | (F.coalesce("best", F.lit(0.0)) < least_score)).select("query_id")


# What is appended to a question that recalls too little.
SUFFIXES = ("specification", "configuration", "manual")


def expanded_queries(queries: DataFrame, normalized: Column, terms: Column, most: int = 3) -> DataFrame:
    """query_id, variants: the normalised question if it differs, the question with each term that it lacks, then with each suffix."""
    q = F.col("text")
    tries = F.concat(F.array(normalized), F.transform(F.filter(terms, lambda t: (t != "") & ~q.contains(t)), lambda t: F.concat(q, F.lit(" "), t)), F.array(*[F.concat(q, F.lit(f" {s}")) for s in SUFFIXES]))
    clean = F.array_distinct(F.filter(F.transform(tries, lambda t: F.trim(t)), lambda t: (t != "") & (t != F.trim(q))))
    return queries.select("query_id", F.slice(clean, 1, most).alias("variants"))


def confidence(scores: Column) -> Column:
    """The best of an array of scores, held between 0 and 1; 0 of none."""
    return F.coalesce(F.array_max(F.transform(scores, lambda s: F.least(F.lit(1.0), F.greatest(F.lit(0.0), s)))), F.lit(0.0))


def best_of(rows: DataFrame, key: list[str], score: str, tie: str) -> DataFrame:
    """The row with the best score of each key; the first by `tie` among equals."""
    w = Window.partitionBy(*key).orderBy(F.desc(score), tie)
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def first_seen(rows: DataFrame, key: str, order: str, value: str, most: int | None = None) -> DataFrame:
    """key, values: distinct values in the order in which they first come."""
    firsts = rows.groupBy(key, value).agg(F.min(order).alias("at"))
    values = F.transform(F.array_sort(F.collect_list(F.struct("at", value))), lambda x: x[value])
    return firsts.groupBy(key).agg((F.slice(values, 1, most) if most else values).alias("values"))
