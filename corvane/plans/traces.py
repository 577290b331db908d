"""Span rows of user sessions, kept by a stream over the events."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import tracing
from corvane.plans.adapters import once, table
from corvane.plans.registry import query
from corvane.storage import shared_path, stored
from corvane.streaming import spans

SILENCE = timedelta(hours=8)
BATCHES = 3


def span_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view or signup opens one of three stages of its user's trace, a click completes one, an error fails one, a purchase of some value cancels what is open."""
    kind = F.col("event_type")
    action = F.when(kind.isin("view", "signup"), "insert").when((kind == "purchase") & (F.col("value") > 40), "cancel").otherwise("update")
    status = F.when(kind == "click", "completed").when(kind == "error", "failed").when(kind == "purchase", "running")
    stage = F.concat(F.lit("stage-"), (F.col("event_id") % 3).cast("string"))
    code = F.when(kind == "error", F.concat(F.lit("E"), (F.col("event_id") % 5).cast("string")))
    rows = table(spark, sf_dir, "events").where("ts IS NOT NULL AND user_id IS NOT NULL")
    return rows.select(F.col("user_id").cast("string").alias("trace_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", action.alias("action"), F.lit(None).cast("string").alias("parent"), stage.alias("name"), F.lit("stage").alias("kind"), status.alias("status"), code.alias("error_code"), F.when(action == "cancel", F.lit("bought")).alias("error_message"), F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("knowledge_id"))


def kept_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed rows of a stream that takes the events in three batches, in the order of time."""

    def build() -> DataFrame:
        rows = stored(span_events(spark, sf_dir), "span-events")
        cuts = rows.select(F.percentile_approx(F.unix_micros("ts"), [i / BATCHES for i in range(1, BATCHES)], 10_000)).first()[0] or []
        source, at = shared_path(spark, "span-drops"), F.unix_micros("ts")
        bounds = [None, *cuts, None]
        for low, high in zip(bounds, bounds[1:]):
            part = rows.where((at > low) if low is not None else F.lit(True)).where((at <= high) if high is not None else F.lit(True))
            part.write.mode("append").parquet(source)
            out = spans.fold(rows, build.out, build.checkpoint, SILENCE, source, files_a_batch=1 << 20)
        return out

    build.out, build.checkpoint = shared_path(spark, "span-rows"), shared_path(spark, "span-state")
    return once(spark, sf_dir, ("events",), "spans", build)


@query("m14_span_rows", """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS trace_id, ts, event_id, 'stage-' || event_id % 3 AS name, event_type, CASE WHEN event_type IN ('view', 'signup') THEN 'insert' WHEN event_type = 'purchase' AND value > 40 THEN 'cancel' ELSE 'update' END AS action FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL),
g AS (SELECT *, lead(ts) OVER (PARTITION BY trace_id ORDER BY ts, event_id) AS next_ts FROM e),
c AS (SELECT trace_id, ts AS at, event_id + 0.5 AS ord, 'CANCELLED' AS code, 'bought' AS message FROM e WHERE action = 'cancel'
  UNION ALL SELECT trace_id, ts + INTERVAL 8 HOUR, -1, 'STALE', 'no event for too long' FROM g WHERE coalesce(next_ts, (SELECT max(ts) FROM e)) > ts + INTERVAL 8 HOUR),
f AS (SELECT trace_id, name, arg_min(event_id, (ts, event_id)) AS span_id, min((ts, event_id)) AS first FROM e WHERE action = 'insert' GROUP BY ALL),
u AS (SELECT e.*, span_id FROM e JOIN f USING (trace_id, name) WHERE action = 'insert' OR action = 'update' AND (ts, event_id) > first),
-- an opening stands until the next event of its span; a closing between them, the first, ends it
s AS (SELECT *, CASE WHEN action = 'insert' OR event_type = 'purchase' THEN 'open' ELSE 'done' END AS state, row_number() OVER (PARTITION BY trace_id, name ORDER BY ts DESC, event_id DESC) AS back FROM u),
l AS (SELECT * FROM s WHERE back = 1),
k AS (SELECT l.trace_id, l.name, min(struct_pack(at := c.at, ord := c.ord, code := c.code, message := c.message)) AS closing FROM l JOIN c ON c.trace_id = l.trace_id AND (c.at, c.ord) > (l.ts, l.event_id) GROUP BY ALL)
SELECT l.trace_id, 'k' || l.trace_id AS knowledge_id, l.span_id, l.name, CASE WHEN state = 'done' THEN CASE event_type WHEN 'click' THEN 'completed' ELSE 'failed' END WHEN closing IS NOT NULL THEN 'cancelled' ELSE 'running' END AS status,
  coalesce(strftime(CASE WHEN state = 'open' AND closing IS NOT NULL THEN closing.at ELSE l.ts END, '%Y-%m-%d %H:%M:%S'), '') AS updated_at FROM l LEFT JOIN k USING (trace_id, name)""")
def m14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage's last state. An update that says running reopens a stage."""
    now = F.lit(table(spark, sf_dir, "events").where("user_id IS NOT NULL").agg(F.max(F.col("ts").cast("timestamp"))).first()[0])
    rows = spans.current(kept_spans(spark, sf_dir), SILENCE, now)
    return rows.select("trace_id", "knowledge_id", "span_id", "name", "status", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))


def order_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer is a trace, its orders are spans below it, their lines below them; times are days."""
    day = lambda c: F.unix_date(F.col(c).cast("date")).cast("bigint")
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), day("l_shipdate").alias("started"), (day("l_shipdate") + F.col("l_linenumber") % 4 * 9).alias("finished"), F.col("l_linenumber").alias("n"))
    items = items.repartition("o").groupBy("o", "n").agg(F.min("started").alias("started"), F.max("finished").alias("finished"))
    lines = items.groupBy("o").agg(F.max("finished").alias("ends"), F.collect_list(F.struct("n", "started", "finished")).alias("lines"))  # an order has a handful of them
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("o"), F.col("o_custkey").cast("string").alias("trace_id"), day("o_orderdate").alias("started"), F.col("o_orderstatus").alias("name"))
    orders = orders.join(lines.hint("merge"), "o", "left").select(F.col("o").cast("string").alias("o"), "trace_id", "name", "started", F.greatest(F.coalesce("ends", F.col("started")), F.col("started") + 1).alias("finished"), "lines")
    span = lambda *c: F.struct(*[x.alias(y) for x, y in zip(c, ("span_id", "parent_id", "name", "started", "finished"), strict=True)])
    own = span(F.col("o"), F.lit("root"), F.col("name"), F.col("started"), F.col("finished"))
    line = lambda x: span(F.concat_ws("-", F.col("o"), x["n"].cast("string")), F.col("o"), F.concat(F.lit("line-"), x["n"].cast("string")), x["started"], x["finished"])
    below = F.when(F.col("lines").isNull(), F.array(own)).otherwise(F.concat(F.array(own), F.transform("lines", line)))
    roots = orders.groupBy("trace_id").agg(F.min("started").alias("started"), F.max("finished").alias("finished"))
    roots = roots.select("trace_id", F.lit("root").alias("span_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("customer").alias("name"), "started", "finished")
    return roots.unionByName(orders.select("trace_id", F.explode(below).alias("r")).select("trace_id", "r.*"))


SPANS = """i AS (SELECT l_orderkey AS o, l_linenumber AS n, min(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))) AS started, max(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) + l_linenumber % 4 * 9) AS finished FROM lineitem GROUP BY l_orderkey, l_linenumber),
o AS (SELECT o_orderkey AS o, CAST(o_custkey AS VARCHAR) AS trace_id, o_orderstatus AS name, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS started, greatest(coalesce(ends, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE))), date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 1) AS finished FROM orders LEFT JOIN (SELECT o, max(finished) AS ends FROM i GROUP BY o) x ON x.o = o_orderkey),
s AS (SELECT trace_id, 'root' AS span_id, NULL AS parent_id, 'customer' AS name, min(started) AS started, max(finished) AS finished FROM o GROUP BY trace_id
  UNION ALL SELECT trace_id, CAST(o AS VARCHAR), 'root', name, started, finished FROM o UNION ALL SELECT trace_id, i.o || '-' || n, CAST(i.o AS VARCHAR), 'line-' || n, i.started, i.finished FROM i JOIN o USING (o)),
c AS (SELECT c.trace_id, c.parent_id, c.span_id, greatest(c.started, p.started) AS a, least(c.finished, p.finished) AS b FROM s c JOIN s p ON p.trace_id = c.trace_id AND p.span_id = c.parent_id),
u AS (SELECT trace_id, parent_id AS span_id, sum(greatest(0, b - greatest(a, coalesce(reached, a)))) AS covered FROM (SELECT *, max(b) OVER (PARTITION BY trace_id, parent_id ORDER BY a, b, span_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM c WHERE b > a) GROUP BY ALL),
w AS (SELECT s.*, finished - started AS duration, finished - started - coalesce(covered, 0) AS own_time, row_number() OVER (PARTITION BY s.trace_id, parent_id ORDER BY finished DESC, s.span_id) AS late FROM s LEFT JOIN u ON u.trace_id = s.trace_id AND u.span_id = s.span_id),
t AS (SELECT trace_id, span_id, name, 0 AS depth, true AS critical, [span_id] AS above FROM w WHERE parent_id IS NULL UNION ALL SELECT w.trace_id, w.span_id, w.name, depth + 1, critical AND late = 1, list_append(above, w.span_id) FROM t JOIN w ON w.trace_id = t.trace_id AND w.parent_id = t.span_id)"""


@query("m25_span_times", f"WITH RECURSIVE {SPANS}, z AS (SELECT trace_id, unnest(above) AS span_id, span_id AS below FROM t), g AS (SELECT z.trace_id, z.span_id, count(*) AS spans, CAST(sum(own_time) AS BIGINT) AS total_own_time FROM z JOIN w ON w.trace_id = z.trace_id AND w.span_id = z.below GROUP BY ALL) SELECT trace_id, span_id, depth, critical, CAST(own_time AS BIGINT) AS own_time, spans, total_own_time FROM t JOIN w USING (trace_id, span_id) JOIN g USING (trace_id, span_id)")
def m25_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_trees(spark, sf_dir).select("trace_id", "span_id", "depth", "critical", "own_time", "spans", "total_own_time")


@query("m25_trace_report", f"WITH RECURSIVE {SPANS}, n AS (SELECT trace_id, arg_min(name, (-own, name)) AS busiest FROM (SELECT trace_id, name, sum(own_time) AS own FROM w GROUP BY ALL) GROUP BY trace_id) SELECT trace_id, min(started) AS started, max(finished) AS finished, CAST(sum(duration) FILTER (parent_id IS NULL) AS BIGINT) AS length, count(*) AS spans, max(depth) AS deepest, string_agg(w.name, ' > ' ORDER BY depth) FILTER (critical) AS critical_path, any_value(busiest) AS busiest FROM w JOIN t USING (trace_id, span_id) JOIN n USING (trace_id) GROUP BY trace_id")
def m25_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report goes out as JSON lines and is read back."""
    rows, path = tracing.report(kept_trees(spark, sf_dir)), shared_path(spark, "trace-report")
    rows.write.json(path)
    return spark.read.schema(rows.schema).json(path)


def kept_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every span of the orders, in its tree."""
    return once(spark, sf_dir, ("orders", "lineitem"), "trees", lambda: tracing.trees(order_spans(spark, sf_dir)))
