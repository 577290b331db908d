"""Mixing sources to target weights as a time-varying curriculum.

1. Each document's size is its number of words; each source's size the sum.
2. Targets: sources share `rate` times all words by weight; a source stops at `cap` times its own size and the excess is
   shared again by weight (water filling, solved in closed form over the sources sorted by how early they reach their cap).
3. Demand: a source's share over training time t in [0, 1] is a piecewise linear schedule; its integral, scaled to the target,
   is the source's cumulative token demand. A source's documents stand in the order of their hashed ids, pass after pass.
   The words before a document are looked up in the inverse of that integral, which gives the document's training position.
4. All copies are sorted by position (range partitioning): `mix` gives their texts, `op4_mixing` each document where its first copy stands.

The running sum is taken in two levels, hashed-id buckets and then documents of a bucket, so a source with a third of all rows
is spread over thousands of groups. Only thin rows (key, size) are shuffled for it; the table of distinct sources is the one
thing that meets in a single task, as its rank and water level are global.

The last document that a source's budget reaches is counted up to the budget: `taken` then adds up to the whole-word target.

Defined results: null text has size 0; a null source is a source of its own, ranked last; documents of size 0 are taken 0
times; ties of the hashed id go by id, then size; repeated rows are separate entries of the order; an empty table gives an
empty result; other columns are not read by `assign` and are carried by `mix`, whose added columns start with `mix_`.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import pairwise

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm._common import WORD, stored, table, whole

WEIGHTS = (3, 1, 2)
#: Knots (t, weight) of the schedules that sources take in turn: fading out, fading in, constant.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.0), (1.0, 1.0)))
Knots = Sequence[tuple[float, float]]


def inverse_demand(share: Column, knots: Knots) -> Column:
    """The t at which a schedule's integral, scaled to 1, reaches `share`."""
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in pairwise(knots))
    pieces, reached = [], 0.0
    for (t0, w0), (t1, w1) in pairwise(knots):
        mass = (t1 - t0) * (w0 + w1) / 2 / area
        if mass > 0:
            pieces.append((reached, t0, w0 / area, (w1 - w0) / (t1 - t0) / area))
            reached += mass
    at = None
    for u0, t0, w, slope in reversed(pieces):
        rest = F.greatest(share - F.lit(u0), F.lit(0.0))
        root = F.lit(w) + F.sqrt(F.greatest(F.lit(w * w) + F.lit(2 * slope) * rest, F.lit(0.0)))
        here = F.lit(t0) + F.when(root > 0, F.lit(2.0) * rest / root).otherwise(0.0)
        at = here if at is None else F.when(share < F.lit(nxt), here).otherwise(at)
        nxt = u0
    return at


def targets(totals: DataFrame, weights: Sequence[float], rate: float, cap: float) -> DataFrame:
    """(skey, source_size) -> rank, weight and target of each source."""
    everyone = Window.orderBy("skey")
    ranked = totals.withColumn("rank", F.row_number().over(everyone) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    full = F.col("source_size") * F.lit(float(cap))
    order = Window.orderBy(full / F.col("weight"), "rank")
    before = F.coalesce(F.sum(full).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(Window.partitionBy()) * F.lit(float(rate)) - before) / after
    leveled = ranked.withColumn("level", level).withColumn("place", F.row_number().over(order))
    open_place = F.min(F.when(F.col("level") * F.col("weight") <= full, F.struct("place", "level"))).over(Window.partitionBy())
    return leveled.select("skey", "source_size", "rank", "weight", F.least(full, F.col("weight") * open_place["level"]).alias("target"))


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, rate: float = 1.5, cap: float = 2.0, schedules: Sequence[Knots] = SCHEDULES, key: Column | None = None) -> DataFrame:
    """One row per document: id, size, source_size, target, taken, positions (of its first, second, ... copy)."""
    source = docs[source_col].cast("string")
    thin = docs.select(
        docs[id_col].alias("id"),
        F.regexp_count(whole(docs, text_col), F.lit(WORD)).cast("long").alias("size"),
        F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source)).alias("skey"),  # null stands last
        F.md5(F.coalesce(docs[id_col].cast("string"), F.lit("")).cast("binary")).alias("turn"),
        *([key.alias("key")] if key is not None else []),
    )
    thin = stored(thin.withColumn("bucket", F.substring("turn", 1, 3)), "mix-sizes")
    buckets = thin.groupBy("skey", "bucket").agg(F.sum("size").alias("words"))
    running = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select("skey", "bucket", F.coalesce(F.sum("words").over(running), F.lit(0)).alias("offset"))
    sources = targets(thin.groupBy("skey").agg(F.sum("size").alias("source_size")), weights, rate, cap)
    within = Window.partitionBy("skey", "bucket").orderBy("turn", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = thin.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0))).join(offsets, ["skey", "bucket"]).join(sources, "skey")
    before = F.col("inner") + F.col("offset")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.floor(F.col("target") - F.col("passes") * F.col("source_size"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    placed = placed.withColumn("before", before).withColumn("passes", passes).withColumn("part", part)

    def position(k: Column, words: Column) -> Column:
        share = (k * F.col("source_size") + F.col("before") + words / F.lit(2.0)) / F.col("target")
        at = None
        for i, knots in enumerate(schedules):
            own = inverse_demand(share, knots)
            at = own if at is None else F.when(F.col("rank") % len(schedules) == i, own).otherwise(at)
        return at

    whole_passes = F.when((F.col("passes") > 0) & (F.col("size") > 0), F.transform(F.sequence(F.lit(0), F.col("passes") - 1), lambda k: position(k, F.col("size")))).otherwise(F.array().cast("array<double>"))
    last = F.when(F.col("part") > 0, F.array(position(F.col("passes"), F.col("part")))).otherwise(F.array().cast("array<double>"))
    return placed.select(
        F.col("id").alias(id_col),
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("passes") + F.col("part")).cast("long").alias("taken"),
        F.concat(whole_passes, last).alias("positions"),
        *(["key"] if key is not None else []),
    )


#: JSON that tells apart times that differ in a microsecond.
WHOLE_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def in_order(copies: DataFrame, tie: str) -> DataFrame:
    """Copies (corvane_copy, corvane_position) in training order, range-partitioned; what is not taken stands last."""
    return copies.orderBy(F.asc_nulls_last("corvane_position"), tie, "corvane_copy")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", placed: bool = True, **how) -> DataFrame:
    """The mixed corpus: all columns of docs (plus mix_position and mix_copy, which replace columns of those names, if `placed`), a row for
    each copy, sorted by position. A row's key is a digest of all its columns, so rows that differ anywhere are different rows.

    A document that the budget cuts keeps its whole text.
    """
    key = F.sha2(F.to_json(F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)]), WHOLE_TIMES), 256)
    plan = assign(docs, id_col, text_col, source_col, key=key, **how).where(F.size("positions") > 0)
    plan = plan.select("key", F.posexplode("positions").alias("corvane_copy", "corvane_position"))
    rows = docs.select(key.alias("key"), F.struct(*[docs[c] for c in docs.columns]).alias("whole")).dropDuplicates(["key"])  # rows of one key are equal
    copies = in_order(rows.join(plan, "key"), "key")
    if not placed:
        return copies.select("whole.*")
    own = [F.col(f"whole.`{c}`") for c in docs.columns if c.lower() not in ("mix_position", "mix_copy")]
    return copies.select(*own, F.col("corvane_position").alias("mix_position"), F.col("corvane_copy").alias("mix_copy"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document, in the order in which training first meets them."""
    rows = assign(table(spark, sf_dir, "documents"))
    copies = rows.select("doc_id", "size", "source_size", "target", "taken", F.posexplode_outer("positions").alias("corvane_copy", "corvane_position"))
    first = in_order(copies, "doc_id").where("coalesce(corvane_copy, 0) = 0")
    return first.select("doc_id", "size", "source_size", "target", "taken", F.col("corvane_position").alias("first_position"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS turn FROM documents),
s AS (SELECT skey, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY skey),
r AS (SELECT *, row_number() OVER (ORDER BY skey) - 1 AS rank FROM s),
w AS (SELECT *, CAST([3, 1, 2][rank % 3 + 1] AS DOUBLE) AS weight, 2.0::DOUBLE * source_size AS room FROM r),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
         - coalesce(sum(room) OVER (ORDER BY room / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY room / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         row_number() OVER (ORDER BY room / weight, rank) AS place FROM w),
o AS (SELECT arg_min(level, place) AS level FROM l WHERE level * weight <= room),
t AS (SELECT skey, source_size, rank, least(room, weight * o.level) AS target FROM l, o),
c AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY skey ORDER BY turn, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d),
p AS (SELECT c.*, t.source_size, t.rank, t.target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes FROM c JOIN t USING (skey)),
q AS (SELECT *, greatest(0, least(size, floor(target - passes * source_size) - before)) AS part FROM p),
f AS (SELECT *, (before + (CASE WHEN passes > 0 THEN size ELSE part END) / 2.0::DOUBLE) / target AS share FROM q),
z AS (SELECT *, greatest(share, 0) AS u FROM f)
SELECT doc_id, size, source_size, target, CAST(size * passes + part AS BIGINT) AS taken,
  CASE WHEN size > 0 AND (passes > 0 OR part > 0) THEN
    CASE rank % 3 WHEN 1 THEN 2.0::DOUBLE * u / (0.5::DOUBLE + sqrt(greatest(0.25::DOUBLE + 2.0::DOUBLE * u, 0)))
                  WHEN 2 THEN 2.0::DOUBLE * u / (1.0::DOUBLE + sqrt(greatest(1.0::DOUBLE + 0.0::DOUBLE * u, 0)))
                  ELSE 2.0::DOUBLE * u / (1.5::DOUBLE + sqrt(greatest(2.25::DOUBLE + -2.0::DOUBLE * u, 0))) END END AS first_position
FROM z
"""
