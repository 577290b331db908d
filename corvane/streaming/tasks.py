"""Task states kept by a stream: the rules of corvane.operators.jobs, one state row a task."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corvane.operators.jobs import MAX_ATTEMPTS, TERMINAL

OUT = "task_id bigint, status string, attempts int, changed_at timestamp"
STATE = "status string, attempts int, changed_at timestamp"


def step(status: str, attempts: int, action: str, most: int = MAX_ATTEMPTS) -> tuple[str, int, bool]:
    """(status, attempts, whether the task showed life) after an action."""
    if status in TERMINAL:
        return status, attempts, False
    if action == "complete":
        return "completed", attempts, True
    if action == "create" and status == "none":
        return "pending", attempts, True
    if action == "claim" and status == "pending":
        return "processing", attempts + 1, True
    if action == "error" and status == "processing":
        return ("dead" if attempts >= most else "pending"), attempts, True
    return status, attempts, action == "heartbeat" and status == "processing"


def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    status, attempts, changed = state.get if state.exists else ("none", 0, None)
    for r in pd.concat(list(frames)).sort_values(["ts", "event_id"]).itertuples(index=False):
        status, attempts, alive = step(status, attempts, r.action)
        changed = r.ts.to_pydatetime() if alive else changed
    state.update((status, attempts, changed))
    yield pd.DataFrame({"task_id": [key[0]], "status": [status], "attempts": [attempts], "changed_at": [changed]}).astype({"attempts": "int32"})


def states(events: DataFrame) -> DataFrame:
    """A stream of the states of the tasks that changed. events: task_id, ts, event_id, action."""
    return events.groupBy("task_id").applyInPandasWithState(fold, OUT, STATE, "update", GroupStateTimeout.NoTimeout)
