"""Exact top-k search by distributed histogram selection.

Queries go in blocks of a fixed size; a block (at most `BLOCK` vectors) is broadcast, all candidates are scored where they lie.
Each round counts scores in a histogram per query over that query's current score range, adds the histograms up, finds the bin
that holds the k-th best score and makes that bin the next range. Rounds end when a range is one score wide or when few
candidates are left at or above it. A last pass keeps scores at or above the bound; each task passes on its own best k a query,
ties to smaller ids, so a vector that a third of all rows share costs k rows a task, not a third of all rows. No score list
leaves a task, no round sends more than a histogram a query.

Components are scaled to integers, floor(scale * x), and scores are exact integers: float64 products of rows whose products stay
under 2^53, Python integers for the few others. Histograms span 2^62 scores; a query whose k-th best lies outside is settled by each
task's best k alone. Ranks compare up to 38 digits; a score beyond a long is shown as the long's limit.

Defined results: vectors that are null, empty or hold a null or non-finite component take no part, nor do rows without an id;
vectors are compared with those of their own length only; a repeated query id is asked once, with the least of its usable vectors;
a repeated candidate row is
listed as often as it occurs; ties go to the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm._common import scratch_path, table

BLOCK, BINS, ROWS = 2048, 256, 4096
#: Vectors whose components stay under this, divided by the root of their length, have exact products in float64.
PLAIN = float(1 << 26)
LIMIT, SPAN, DIGITS = (1 << 63) - 1, 1 << 61, 10**38 - 1


def scaled(vectors: pa.Array, scale: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """(places of the usable vectors, their integer components)."""
    places, rows = [], []
    ends = vectors.offsets.to_numpy() if len(vectors) else np.zeros(1, int)
    flat = vectors.values
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    if flat.null_count:
        values[flat.is_null().to_numpy(zero_copy_only=False)] = np.nan
    present = vectors.is_valid().to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore"):
        values = np.floor(values * scale)
    for i in range(len(vectors)):
        row = values[ends[i] : ends[i + 1]]
        if present[i] and len(row) and np.isfinite(row).all():
            places.append(i)
            rows.append(row)
    return np.array(places, int), rows


def plain(rows: np.ndarray) -> np.ndarray:
    return np.abs(rows).max(axis=1, initial=0) <= PLAIN / np.sqrt(rows.shape[1])


def scores(queries: np.ndarray, candidates: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places of queries, places of candidates, their exact inner products): as longs, or as Python integers where rows are large."""
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    q, c = plain(queries), plain(candidates)
    for a in (True, False):
        for b in (True, False):
            i, j = np.flatnonzero(q == a), np.flatnonzero(c == b)
            if len(i) and len(j):
                yield i, j, (queries[i] @ candidates[j].T).astype(np.int64) if a and b else whole(queries[i]).dot(whole(candidates[j]).T)


def by_length(ids: list, rows: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    groups: dict[int, list[int]] = {}
    for i, row in enumerate(rows):
        groups.setdefault(len(row), []).append(i)
    return {n: (np.array([ids[i] for i in at], np.int64), np.stack([rows[i] for i in at])) for n, at in groups.items()}


class Block:
    """A block of queries with the score range in which each one's k-th best lies."""

    def __init__(self, ids: list[int], rows: list[np.ndarray], k: int) -> None:
        self.k = k
        self.of = by_length(ids, rows)
        place = {q: i for i, q in enumerate(ids)}
        self.at = {n: np.array([place[q] for q in own]) for n, (own, _) in self.of.items()}
        self.ids = np.array(ids, np.int64)
        size = np.array([float(np.sqrt((r * r).sum())) for r in rows])
        self.norm = size
        self.low = np.zeros(len(ids), np.int64)
        self.width = np.ones(len(ids), np.int64)  # of a bin
        self.reach = np.zeros(len(ids), np.int64)  # scores from low on that belong to the range; its last bins may go beyond
        self.open = np.ones(len(ids), bool)
        self.above = np.zeros(len(ids), np.int64)
        self.free = np.zeros(len(ids), bool)  # no lower bound holds

    def scored(self, batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(places of queries, candidate ids, scores; a query's own row has the least score) of each run of candidates."""
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                at, rows = scaled(pa.concat_arrays([part.column(1)]), scale)
                ids = part.column(0).take(pa.array(at)).to_pylist()
                for n, (own, matrix) in by_length(ids, rows).items():
                    if n in self.of:
                        for i, j, score in scores(self.of[n][1], matrix):
                            yield self.at[n][i], own[j], score

    def counts(self, batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(self.ids), BINS), np.int64)
        for at, own, score in self.scored(batches, scale):
            live = self.open[at]
            at, score = at[live], score[live]
            if not len(at):
                continue
            past = score - self.low[at][:, None]
            bin_ = past // self.width[at][:, None]
            if bin_.dtype == object:  # what is beyond the span counts with its highest scores
                bin_ = np.where(score > SPAN, np.where(self.top[at][:, None], BINS - 1, BINS), np.clip(bin_, -1, BINS)).astype(np.int64)
            # scores beyond the range are in `above` already, but where it reaches the highest ones
            within = (self.top[at][:, None] | (past < self.reach[at][:, None])).astype(bool)
            inside = (bin_ >= 0) & (bin_ < BINS) & within & (self.ids[at][:, None] != own[None, :])
            flat = (np.arange(len(at))[:, None] * BINS + np.clip(bin_, 0, BINS - 1))[inside]
            total[at] += np.bincount(flat, minlength=len(at) * BINS).reshape(len(at), BINS)
        q, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(b, pa.int32()), pa.array(total[q, b], pa.int64())], ["q", "bin", "n"])

    def best(self, batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for at, own, score in self.scored(batches, scale):
            good = ((score >= self.low[at][:, None]) | self.free[at][:, None]).astype(bool) & (self.ids[at][:, None] != own[None, :])
            for i in np.nonzero(good.any(axis=1))[0]:
                ids, got = own[good[i]], score[i][good[i]]
                if (q := int(at[i])) in held:
                    ids, got = np.concatenate([held[q][0], ids]), np.concatenate([held[q][1], got])
                first = np.lexsort((ids, -got))[: self.k] if got.dtype != object else np.array(sorted(range(len(got)), key=lambda x: (-got[x], ids[x]))[: self.k])
                held[q] = ids[first], got[first]
        q = np.repeat(self.ids[list(held)] if held else np.zeros(0, np.int64), [len(x[0]) for x in held.values()])
        ids, got = (np.concatenate([x[i] for x in held.values()]) if held else np.zeros(0, np.int64) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(ids, pa.int64()), pa.array([decimal.Decimal(max(-DIGITS, min(DIGITS, int(x)))) for x in got], pa.decimal128(38, 0))], ["query_id", "vec_id", "score"])


def longest(pairs: DataFrame, scale: float) -> float:
    """The greatest length of a usable vector."""

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = 0.0
        for batch in batches:
            _, rows = scaled(pa.concat_arrays([batch.column(1)]), scale)
            most = max([most, *(float(np.linalg.norm(r)) for r in rows)])
        yield pa.RecordBatch.from_arrays([pa.array([most])], ["most"])

    return pairs.mapInArrow(norms, "most double").agg(F.max("most")).first()[0] or 0.0


def _refine(block: Block, pairs: DataFrame, scale: float, most: float) -> None:
    """Narrows the range of each query to the bin that holds its k-th best score until few candidates are left."""
    spark, k = pairs.sparkSession, block.k
    with np.errstate(over="ignore", invalid="ignore"):
        reach = block.norm * most * (1 + 1e-9) + 1  # |score| is at most the product of the lengths
    reach = np.where(reach < SPAN, reach, SPAN).astype(np.int64)
    block.low, block.width, block.reach = -reach, (2 * reach + BINS) // BINS, 2 * reach + 1
    block.top = np.ones(len(block.ids), bool)  # the range reaches the highest scores
    while block.open.any():
        sent = spark.sparkContext.broadcast(block)
        counted = pairs.mapInArrow(lambda batches, sent=sent: sent.value.counts(batches, scale), "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("q").orderBy(F.desc("bin"))
        reached = counted.select("q", "bin", "n", (F.sum("n").over(down) - F.col("n")).alias("over"))
        need = spark.createDataFrame([(i, int(k - block.above[i])) for i in np.nonzero(block.open)[0].tolist()], "q int, need long")
        found = reached.join(need, "q").where("over < need").groupBy("q").agg(F.min(F.struct("bin", "n", "over")).alias("x")).select("q", "x.*").collect()
        seen = set()
        for q, bin_, n, over in found:
            seen.add(q)
            if block.above[q] + over + n < k:  # fewer than k candidates in the range
                block.open[q], block.free[q] = False, True
                continue
            block.top[q] &= bin_ == BINS - 1
            block.low[q] += bin_ * block.width[q]
            block.above[q] += over
            if block.width[q] == 1 or block.above[q] + n <= 4 * k:
                block.open[q] = False
            else:
                block.reach[q] = block.width[q]
                block.width[q] = -(-block.width[q] // BINS)
        for q in np.nonzero(block.open)[0]:
            if int(q) not in seen:
                block.open[q], block.free[q] = False, True  # none at all
        sent.unpersist()


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best candidates of every row for which `is_query` holds; candidates are all other rows."""
    spark = vectors.sparkSession
    pairs = vectors.where(vectors[id_col].isNotNull() & vectors[vector_col].isNotNull()).select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("v"))
    asked = vectors.where(is_query & vectors[id_col].isNotNull() & vectors[vector_col].isNotNull()).select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("v"))
    fine = F.size("v") > 0, ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x * F.lit(float(scale))) == F.lit(float("inf"))))
    pairs, asked = (x.where(fine[0] & fine[1]) for x in (pairs, asked))
    most = longest(pairs, scale)
    path, last, blocks = scratch_path(spark, "topk"), None, 0
    while True:
        rows = (asked if last is None else asked.where(F.col("id") > last)).orderBy("id", "v").limit(BLOCK).collect()
        if not rows:
            break
        last = rows[-1]["id"]
        once = {r["id"]: r["v"] for r in reversed(rows)}
        ids = sorted(once)
        at, usable = scaled(pa.array([once[i] for i in ids], pa.list_(pa.float64())), scale)
        if not len(at):
            continue
        block = Block([ids[i] for i in at], usable, k)
        _refine(block, pairs, scale, most)
        sent = spark.sparkContext.broadcast(block)
        found = pairs.mapInArrow(lambda batches, sent=sent: sent.value.best(batches, scale), "query_id long, vec_id long, score decimal(38,0)")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.greatest(F.least("score", F.lit(LIMIT)), F.lit(-LIMIT)).cast("long").alias("score")).write.mode("append").parquet(path)
        blocks += 1
    schema = "query_id long, rank int, vec_id long, score long"
    return spark.read.schema(schema).parquet(path) if blocks else spark.createDataFrame([], schema)


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.expr("vec_id % 50 = 0"))


OP2_SQL = """
WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum([z[1] * z[2] FOR z IN list_zip(a.q, b.q)]) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
