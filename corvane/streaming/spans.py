"""Span rows kept by a stream: one keyed state a trace, which never gathers the trace.

A trace's spans live in map state under (parent, name, kind). Inserting a span that is there refreshes it and keeps its id; updates change
spans that are there; a cancel closes all that are open; a rename gives the trace's rows another knowledge id. A timer closes what a trace leaves open
when it falls silent for a while. As the same rule is applied between two events that lie further apart, the rows are the same however the events are
split into batches, as long as batches come in the order of time.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Statuses and codes.
OPEN, CANCELLED, CANCELLED_CODE, STALE_CODE, SILENT = ("pending", "running"), "cancelled", "CANCELLED", "STALE", "no event for too long"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: action is insert, update, cancel or rename; null fields of an update leave what is there.
EVENT = "trace_id string, ts timestamp, event_id bigint, action string, parent string, name string, kind string, status string, error_code string, error_message string, knowledge_id string"
SPAN = "trace_id string, knowledge_id string, span_id bigint, parent string, name string, kind string, status string, error_code string, error_message string, started_at timestamp, finished_at timestamp, updated_at timestamp, last_seen timestamp, change bigint"
_KEY = "parent string, name string, kind string"
#: Times are microseconds in state.
_VALUE = "span_id bigint, status string, error_code string, error_message string, started_at bigint, finished_at bigint, updated_at bigint"
_TIMES = ("started_at", "finished_at", "updated_at", "last_seen")
_OUT = SPAN.replace("timestamp", "bigint")
FIELDS = tuple(x.split(" ")[0] for x in _VALUE.split(", "))


class Trace:
    """The rules, over any mapping of (parent, name, kind) to the fields of a span. Events tell their time as `at`."""

    def __init__(self, spans, silence: int) -> None:
        self.spans, self.silence = spans, silence

    def close(self, at: int, code: str, message: str | None) -> list[tuple]:
        """Closes what is open; returns the keys of what changed."""
        changed = []
        for key, s in list(self.spans.items()):
            if s[1] in OPEN:
                self.spans[key] = (s[0], CANCELLED, code, message or "", s[4], s[5] or at, at)
                changed.append(key)
        return changed

    def apply(self, e: Row, last: int | None) -> list[tuple]:
        """Keys that an event changes, after what a silence before it changes."""
        changed = self.close(last + self.silence, STALE_CODE, SILENT) if last is not None and e.at > last + self.silence else []
        key = (e.parent, e.name, e.kind)
        if e.action == "insert":
            there = self.spans.get(key)
            self.spans[key] = (there[0] if there else e.event_id, e.status or "running", "", "", e.at, None, e.at)
            return [*changed, key]
        if e.action == "update" and (s := self.spans.get(key)):
            done = e.status is not None and e.status not in OPEN
            self.spans[key] = (s[0], e.status or s[1], e.error_code or s[2], e.error_message or s[3], s[4] or e.at, e.at if done else s[5], e.at)
            return [*changed, key]
        if e.action == "cancel":
            changed += self.close(e.at, CANCELLED_CODE, e.error_message)
        return changed + (list(self.spans) if e.action == "rename" else [])


class _Held(dict):
    """Map state as a mapping; spans read once are kept for the batch, changes go through."""

    def __init__(self, state) -> None:
        super().__init__({tuple(k): tuple(v) for k, v in state.iterator()})
        self.state = state

    def __setitem__(self, key: tuple, value: tuple) -> None:
        super().__setitem__(key, value)
        self.state.updateValue(key, value)


class Spans(StatefulProcessor):
    """A trace's map of spans, and its knowledge id, last event, number of changes and timer."""

    def __init__(self, silence: timedelta) -> None:
        self.silence = silence // timedelta(microseconds=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spans = handle.getMapState("spans", _KEY, _VALUE)
        self.about = handle.getValueState("about", "knowledge_id string, last bigint, changes bigint, timer bigint")

    def _rows(self, trace: str, held: dict, keys: list[tuple], knowledge: str | None, last: int, changes: int) -> Iterator[Row]:
        for key in dict.fromkeys(keys):
            s = dict(zip(FIELDS, held[key]))
            yield Row(trace_id=trace, knowledge_id=knowledge, span_id=s["span_id"], parent=key[0], name=key[1], kind=key[2], status=s["status"], error_code=s["error_code"], error_message=s["error_message"], started_at=s["started_at"], finished_at=s["finished_at"], updated_at=s["updated_at"], last_seen=last, change=changes)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        knowledge, last, changes, timer = self.about.get() if self.about.exists() else (None, None, 0, 0)
        held = _Held(self.spans)
        trace, changed = Trace(held, self.silence), []
        for e in sorted(rows, key=lambda r: (r.at, r.event_id)):
            knowledge = (e.knowledge_id or knowledge) if knowledge is None or e.action == "rename" else knowledge
            changed += trace.apply(e, last)
            last = e.at
        if timer:
            self.handle.deleteTimer(timer)
        timer = 0
        if any(s[1] in OPEN for s in held.values()):
            timer = (last + self.silence) // 1000 + 1
            self.handle.registerTimer(timer)
        self.about.update((knowledge, last, changes + 1, timer))
        # every span tells when the trace was last seen, so that a reader knows what has fallen silent since
        yield from self._rows(key[0], held, list(held), knowledge, last, changes + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        knowledge, last, changes, _ = self.about.get()
        held = _Held(self.spans)
        changed = Trace(held, self.silence).close(last + self.silence, STALE_CODE, SILENT)
        self.about.update((knowledge, last, changes + 1, 0))
        yield from self._rows(key[0], held, changed, knowledge, last, changes + 1)

    def close(self) -> None:
        pass


def changes(events: DataFrame, silence: timedelta, lateness: str = "0 seconds") -> DataFrame:
    """A stream of changed span rows (SPAN) of a stream of events (EVENT)."""
    rows = events.withWatermark("ts", lateness).withColumn("at", F.unix_micros("ts")).groupBy("trace_id")
    rows = rows.transformWithState(statefulProcessor=Spans(silence), outputStructType=_OUT, outputMode="Update", timeMode="EventTime")
    return rows.withColumns({c: F.timestamp_micros(c) for c in _TIMES})


def current(rows: DataFrame, silence: timedelta, now: Column) -> DataFrame:
    """The latest row of every span; what is open in a trace that has been silent at `now` is closed, as its timer will."""
    w = Window.partitionBy("trace_id", "span_id").orderBy(F.desc("change"))
    last = rows.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place", "change")
    ends = F.col("last_seen") + F.make_dt_interval(secs=F.lit(silence.total_seconds()))
    stale = F.col("status").isin(*OPEN) & (ends < now)
    new = {"status": F.lit(CANCELLED), "error_code": F.lit(STALE_CODE), "error_message": F.lit(SILENT), "finished_at": F.coalesce("finished_at", ends), "updated_at": ends}
    return last.withColumns({c: F.when(stale, v).otherwise(F.col(c)) for c, v in new.items()})


def fold(events: DataFrame, out: str, checkpoint: str, silence: timedelta, source: str, files_a_batch: int = 1) -> DataFrame:
    """Runs the stream over files of events in `source`, appends changed rows to `out`, and returns them. events gives the schema."""
    spark = events.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    held = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files_a_batch).parquet(source)
        changes(stream, silence).writeStream.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}")).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, held) if held is not None else spark.conf.unset(name)
    return spark.read.schema(SPAN).option("recursiveFileLookup", "true").parquet(out)
