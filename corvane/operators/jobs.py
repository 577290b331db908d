"""Durable tasks, spans and runs: their states follow from ordered events.

A task's few events are folded in order by one aggregate expression; nothing is looped over on the driver. The streaming face of
the same rules is in corvane.streaming.tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TERMINAL = ("completed", "dead")
MAX_ATTEMPTS = 3
BACKOFF = (10, 30, 120)  # seconds before the 2nd, 3rd and 4th attempt


def transition(state: Column, action: Column, at: Column, max_attempts: int = MAX_ATTEMPTS) -> Column:
    """The state (status, attempts, changed_at) after an action. Completed and dead are final.

    create: none -> pending; claim: pending -> processing; heartbeat: keeps a processing task alive; error: processing -> pending,
    or dead once max_attempts are used; complete: anything but a final state -> completed.
    """
    s, n = state["status"], state["attempts"]
    status = (
        F.when(s.isin(*TERMINAL), s)
        .when(action == "complete", "completed")
        .when((action == "create") & (s == "none"), "pending")
        .when((action == "claim") & (s == "pending"), "processing")
        .when((action == "error") & (s == "processing") & (n >= max_attempts), "dead")
        .when((action == "error") & (s == "processing"), "pending")
        .otherwise(s)
    )
    attempts = n + ((action == "claim") & (s == "pending")).cast("int")
    alive = (status != s) | (action == "heartbeat") & (s == "processing")
    return F.struct(status.alias("status"), attempts.alias("attempts"), F.when(alive, at).otherwise(state["changed_at"]).alias("changed_at"))


def fold_tasks(events: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """task_id, status, attempts, changed_at from events (task_id, ts, event_id, action)."""
    rows = events.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "action"))).alias("log"))
    start = F.struct(F.lit("none").alias("status"), F.lit(0).alias("attempts"), F.lit(None).cast("timestamp").alias("changed_at"))
    end = F.aggregate("log", start, lambda s, e: transition(s, e["action"], e["ts"], max_attempts))
    return rows.select("task_id", end.alias("s")).select("task_id", "s.*")


def retry_delay(attempts: Column) -> Column:
    """Seconds to wait after so many attempts."""
    return F.element_at(F.array(*[F.lit(b) for b in BACKOFF]), F.least(F.greatest(attempts, F.lit(1)), F.lit(len(BACKOFF))).cast("int"))


def repeated_batches(events: DataFrame, key: str = "run_id", order: str = "sequence", signature: str = "signature") -> DataFrame:
    """key, longest: the longest run of equal neighbouring signatures, which guards against loops."""
    w = Window.partitionBy(key).orderBy(order)
    rows = events.withColumn("new", F.when(F.col(signature).eqNullSafe(F.lag(signature).over(w)), 0).otherwise(1))
    rows = rows.withColumn("island", F.sum("new").over(w))
    return rows.groupBy(key, "island").agg(F.count(F.lit(1)).alias("n")).groupBy(key).agg(F.max("n").alias("longest"))


def action_groups(actions: DataFrame, key: str = "run_id", order: str = "ord", parallel: str = "parallel") -> DataFrame:
    """Adds batch: neighbouring actions that may run in parallel share one, any other has its own."""
    w = Window.partitionBy(key).orderBy(order)
    joins = F.col(parallel) & F.coalesce(F.lag(parallel).over(w), F.lit(False))
    return actions.withColumn("joins", joins).withColumn("batch", F.sum(F.when(F.col("joins"), 0).otherwise(1)).over(w)).drop("joins")


def paired_calls(events: DataFrame) -> DataFrame:
    """run_id, call_key, nth, started, ended: the n-th call and the n-th result of a key belong together; a call without a result stays open."""
    w = Window.partitionBy("run_id", "call_key", "kind").orderBy("ts", "event_id")
    rows = events.withColumn("nth", F.row_number().over(w))
    calls = rows.where("kind = 'call'").select("run_id", "call_key", "nth", F.col("ts").alias("started"))
    results = rows.where("kind = 'result'").select("run_id", "call_key", "nth", F.col("ts").alias("ended"))
    return calls.join(results, ["run_id", "call_key", "nth"], "left")


def dependents(stage: str) -> list[str]:
    """Stages that cannot run once a stage has failed, in order (a fixed graph of five)."""
    graph = {"load": ["chunk"], "chunk": ["index", "multimodal"], "index": ["postprocess"], "multimodal": ["postprocess"], "postprocess": []}
    out: list[str] = []
    todo = list(graph.get(stage, []))
    while todo:
        s = todo.pop(0)
        if s not in out:
            out.append(s)
            todo += graph[s]
    return out


def current_stage(spans: DataFrame, key: str = "run_id") -> DataFrame:
    """key, stage: the first running span, else the first that is pending or failed."""
    rank = F.when(F.col("status") == "running", 0).when(F.col("status").isin("pending", "failed"), 1)
    return spans.withColumn("r", rank).where("r IS NOT NULL").groupBy(key).agg(F.min_by("stage", F.struct("r", "ord")).alias("stage"))


def offsets(spans: DataFrame, key: str = "batch_id") -> DataFrame:
    """Adds finish_rank and the seconds since the batch's first start."""
    w = Window.partitionBy(key)
    return spans.withColumn("finish_rank", F.rank().over(w.orderBy("finished_at"))).withColumn("offset_s", F.unix_micros("started_at") / 1e6 - F.min(F.unix_micros("started_at")).over(w) / 1e6)


def merged_runs(states: DataFrame) -> DataFrame:
    """run_id with counters added, flags or-ed and ids united in the order in which they came."""
    parts = states.groupBy("run_id").agg(F.sum("calls").alias("calls"), F.bool_or("blocked").alias("blocked"), F.transform(F.array_sort(F.collect_list(F.struct("sequence", "ids"))), lambda x: x["ids"]).alias("ids"))
    return parts.withColumn("ids", F.array_distinct(F.flatten("ids")))


def closed_spans(spans: DataFrame, links: DataFrame, failed: DataFrame) -> DataFrame:
    """Spans after failures: a failed span stays failed, open spans below it are cancelled. spans: id, status; links: id, parent_id; failed: id."""
    from corvane.operators.graph import descendants

    below = descendants(links, failed).where("depth > 0").select("id").distinct().withColumn("below", F.lit(True))
    rows = spans.join(failed.select("id", F.lit(True).alias("bad")), "id", "left").join(below, "id", "left")
    status = F.when(F.col("bad"), "failed").when(F.col("below") & F.col("status").isin("pending", "running"), "cancelled").otherwise(F.col("status"))
    return rows.select("id", status.alias("status"))


def event_stream(events: DataFrame, key: str = "run_id") -> DataFrame:
    """Events of each run with their sequence from 1: references before tokens, the end last, else by time."""
    stage = F.when(F.col("kind") == "references", 0).when(F.col("kind") == "done", 2).otherwise(1)
    return events.withColumn("sequence", F.row_number().over(Window.partitionBy(key).orderBy(stage, "ts", "event_id")))


def retried(operations: DataFrame) -> DataFrame:
    """Operations with may_retry: not while processing, not after completion."""
    return operations.withColumn("may_retry", ~F.col("status").isin("processing", "completed"))
