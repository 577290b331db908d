"""Reports of traces from their spans: own times, subtree sums, depths and critical paths.

A span's own time is its duration less the union of its children's intervals, by a running maximum over siblings. What goes up or down the tree is
found by pointer jumping: each round replaces a span's pointer by its pointer's pointer, adds what it points over, and hands its sum to the span it pointed at. So a
tree of any shape takes as many rounds as the logarithm of its depth, and a span with very many children is an aggregate like any other.

Spans move once, to their trace's partition. There every span stands in its own family and in its parent's, and windows over families say what a join would.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from corvane.storage import stored

ID = ["trace_id", "span_id"]
#: What a view shows as current: the first running stage, else the first that waits or failed.
CURRENT = (("running",), ("pending", "failed"))


def _families(rows: DataFrame, up: str, carried: list[str], own: list[str]) -> DataFrame:
    """trace_id, family, child, `carried` and own: every span as the head of its family (child is null, own holds its columns), and as a child in that of `up`, if it has one."""
    kept, fields = F.struct(*own), [F.col(c).alias(c) for c in carried]
    head = F.struct(F.col("span_id").alias("family"), F.lit(None).cast("string").alias("child"), *fields, kept.alias("own"))
    child = F.struct(F.col(up).alias("family"), F.col("span_id").cast("string").alias("child"), *fields, F.when(F.lit(False), kept).alias("own"))
    return rows.select("trace_id", F.explode(F.array(head, child)).alias("r")).select("trace_id", "r.*").where("family IS NOT NULL")


def _roles() -> tuple[WindowSpec, Column, Column]:
    """A family, whether a row is its head, and the span that a row speaks of."""
    return Window.partitionBy("trace_id", "family"), F.col("child").isNull(), F.coalesce("child", "family").alias("span_id")


def _pointed(spans: DataFrame) -> DataFrame:
    """trace_id, span_id, own (all columns of spans), covered, up (a parent that is there), depth (1 below a parent, else 0) and critical (last among its siblings)."""
    family, is_head, span = _roles()
    rows = _families(spans.repartition("trace_id"), "parent_id", ["started", "finished"], spans.columns)
    head = lambda c: F.max(F.when(is_head, F.col(c))).over(family)
    last = F.min(F.when(~is_head, F.struct(-F.col("finished"), F.col("child").alias("child")))).over(family)
    rows = rows.withColumns({"low": head("started"), "high": head("finished"), "there": F.max(is_head).over(family), "last": last["child"] == F.col("child")})
    a, b = F.greatest("started", "low"), F.least("finished", "high")
    inside = ~is_head & F.col("there") & (b > a)
    rows = rows.withColumns({"a": F.when(inside, a), "b": F.when(inside, b)})
    before = family.orderBy("a", "b", "child").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("b") - F.greatest(F.col("a"), F.coalesce(F.max("b").over(before), F.col("a"))))
    rows = rows.withColumn("new", F.when(F.col("a").isNotNull(), new)).withColumn("covered", F.sum("new").over(family))
    below = ~is_head & F.col("there")
    return rows.groupBy("trace_id", span).agg(
        F.first("own", True).alias("own"),
        F.max(F.when(is_head, F.col("covered"))).alias("covered"),
        F.max(F.when(below, F.col("family"))).alias("up"),
        F.max(F.when(below, 1).otherwise(0)).alias("depth"),
        F.bool_and(~below | F.col("last")).alias("critical"),
    )


def _timed(rows: DataFrame, columns: list[str], *more: str) -> DataFrame:
    duration = F.col("own.finished") - F.col("own.started")
    return rows.select(*[F.col("own")[c].alias(c) for c in columns], duration.alias("duration"), (duration - F.coalesce("covered", F.lit(0))).alias("own_time"), *more)


def own_times(spans: DataFrame) -> DataFrame:
    """Adds duration and own_time. spans: trace_id, span_id, parent_id, started, finished (numbers). A child counts as far as it lies within its parent."""
    return _timed(_pointed(spans), spans.columns)


def _jumped(rows: DataFrame) -> DataFrame:
    """One round of pointer jumping over what `trees` keeps of each span."""
    family, is_head, span = _roles()
    rows = _families(rows, "up", ["up", "depth", "critical", "spans", "total_own_time"], ["own", "covered"])
    head = lambda c: F.max(F.when(is_head, F.col(c))).over(family).alias(c)
    handed = lambda c: F.when(is_head, F.col(c) + F.coalesce(F.sum(F.when(~is_head, F.col(c))).over(family), F.lit(0))).alias(c)
    rows = rows.select("trace_id", "family", "child", "own", head("up"), head("depth"), head("critical"), handed("spans"), handed("total_own_time"))
    sums = [F.sum("depth").cast("int").alias("depth"), F.bool_and("critical").alias("critical"), F.sum("spans").alias("spans"), F.sum("total_own_time").alias("total_own_time")]
    rows = rows.groupBy("trace_id", span).agg(F.first("own", True)["own"].alias("own"), F.first(F.when(is_head, F.col("own.covered")), True).alias("covered"), F.max(F.when(~is_head, F.col("up"))).alias("up"), *sums)
    return rows.select(*ID, "own", "covered", "up", "depth", "critical", "spans", "total_own_time")


def trees(spans: DataFrame) -> DataFrame:
    """Adds duration, own_time, depth, spans and total_own_time (of the span and all below it), and critical: whether the span ends last among its siblings, as do all above it.

    spans: what own_times takes or gives. A span whose parent is not there is a root.
    """
    spans = spans.drop("duration", "own_time")
    first = _pointed(spans)
    own_time = F.col("own.finished") - F.col("own.started") - F.coalesce("covered", F.lit(0))
    rows = first.select(*ID, "own", "covered", "up", "depth", "critical", F.lit(1).cast("bigint").alias("spans"), own_time.alias("total_own_time"))
    rows = stored(_jumped(_jumped(rows)), "trace-pointers")
    while not rows.where("up IS NOT NULL").isEmpty():  # deeper than four levels
        rows = stored(_jumped(rows.repartition("trace_id")), "trace-pointers")
    return _timed(rows, spans.columns, "depth", "critical", "spans", "total_own_time")


def report(rows: DataFrame) -> DataFrame:
    """A row a trace: started, finished, length, spans, deepest, critical_path (names from the root down) and busiest (the name with the most own time).

    rows: what trees gives, with name. The critical path is as long as the tree is deep.
    """
    path = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("critical"), F.struct("depth", "name")))), lambda x: x["name"]), " > ")
    whole = rows.groupBy("trace_id").agg(F.min("started").alias("started"), F.max("finished").alias("finished"), F.sum(F.when(F.col("depth") == 0, F.col("duration"))).alias("length"), F.count(F.lit(1)).alias("spans"), F.max("depth").alias("deepest"), path.alias("critical_path"))
    by_name = rows.groupBy("trace_id", "name").agg(F.sum("own_time").alias("own"))
    busiest = by_name.groupBy("trace_id").agg(F.min(F.struct(-F.col("own"), F.col("name")))["name"].alias("busiest"))
    return whole.join(busiest, "trace_id")


def current_stage(stages: DataFrame, order: str = "ord") -> DataFrame:
    """trace_id, stage: the first running stage of each trace, else its first that waits or failed. stages: trace_id, name, status and an order."""
    first = [F.min(F.when(F.col("status").isin(*kinds), F.struct(order, "name")))["name"] for kinds in CURRENT]
    return stages.groupBy("trace_id").agg(F.coalesce(*first).alias("stage"))
