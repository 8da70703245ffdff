"""The life of upload jobs as a stateful stream: queued, running, then done or error, in the order of event time.

Events may come late and in any order. Each waits in the job's state until the watermark has passed it, so transitions are applied
in the order of their times and the result doesn't depend on how events were cut into batches. Timers do the rest: a job that
runs too long fails, and a finished one is forgotten after a while, so state doesn't grow with all jobs there ever were.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The states a job may go to from each, "" being a job that isn't known.
NEXT = {"": ("queued",), "queued": ("running",), "running": ("done", "error"), "done": (), "error": ()}
OUTPUT = "job_id string, status string, at timestamp, created_at timestamp, started_at timestamp, finished_at timestamp, error string, rejected string"
_STATE = "status string, created long, started long, finished long, error string"


def _moment(ms: int | None) -> pd.Timestamp | None:
    return None if ms is None else pd.Timestamp(ms, unit="ms")


def _milliseconds(ts: pd.Timestamp) -> int:
    return int(ts.value // 1_000_000)


class Jobs(StatefulProcessor):
    """One job's events: (job_id, ts, status, error)."""

    def __init__(self, stuck_ms: int, keep_ms: int):
        self.stuck_ms, self.keep_ms = stuck_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", _STATE)
        self.waiting = handle.getListState("waiting", "at long, status string, error string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for pdf in rows:
            for ts, status, error in zip(pdf["ts"], pdf["status"], pdf["error"], strict=True):
                at = _milliseconds(ts)
                self.waiting.appendValue((at, status, error if isinstance(error, str) else None))
                self.handle.registerTimer(at)
        yield pd.DataFrame(columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, out = expiredTimerInfo.getExpiryTimeInMs(), []
        events = [tuple(x) for x in self.waiting.get()]
        due, later = sorted(((a, s or "", e) for a, s, e in events if a <= now), key=lambda x: (x[0], _rank(x[1]), x[2] or "")), [x for x in events if x[0] > now]
        if due:
            self.waiting.put(later) if later else self.waiting.clear()
        state = self.job.get() if self.job.exists() else ("", None, None, None, None)
        status, created, started, finished, why = state
        for at, wanted, error in due:
            if status == "running" and at > started + self.stuck_ms:  # it had failed before this event
                status, finished, why = "error", started + self.stuck_ms, "timed out"
                out.append((status, finished, created, started, finished, why, None))
            if wanted not in NEXT[status]:
                out.append((status or None, at, created, started, finished, why, f"{status or 'unknown'} to {wanted or 'nothing'}"))
                continue
            status = wanted
            created, started = (at, None) if wanted == "queued" else (created, at if wanted == "running" else started)
            finished, why = (at, error) if wanted in ("done", "error") else (None, None)
            out.append((status, at, created, started, finished, why, None))
        if status == "running" and now >= started + self.stuck_ms:
            status, finished, why = "error", started + self.stuck_ms, "timed out"
            out.append((status, finished, created, started, finished, why, None))
        if finished is not None and now >= finished + self.keep_ms and not later:
            self.job.clear()
        elif status:
            self.job.update((status, created, started, finished, why))
            if status == "running":
                self.handle.registerTimer(started + self.stuck_ms)
            elif finished is not None and now < finished + self.keep_ms:
                self.handle.registerTimer(finished + self.keep_ms)
        rows = [(key[0], s, _moment(a), _moment(c), _moment(b), _moment(f), w, r) for s, a, c, b, f, w, r in out]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def _rank(status: str) -> int:
    """Events of one time are taken in the order of a job's life."""
    return {"queued": 0, "running": 1, "done": 2, "error": 3}.get(status, 4)


def job_changes(events: DataFrame, *, late: str = "10 seconds", stuck_seconds: float = 3600.0, keep_seconds: float = 86_400.0) -> DataFrame:
    """Streamed events (job_id, ts, status, error) as changes of jobs, with ``rejected`` for events that no transition allows.

    A change is told once the watermark, ``late`` behind the latest event, has passed it; events still later are dropped. A job
    running longer than ``stuck_seconds`` becomes an error, "timed out", at that time. A job that ended is forgotten after
    ``keep_seconds``; one that comes again is a new job. An event without job or time is left out. The session needs the RocksDB state store.
    """
    told = events.filter("job_id is not null and ts is not null").select(F.col("job_id").cast("string").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), "status", F.col("error").cast("string").alias("error"))
    jobs = told.withWatermark("ts", late).groupBy("job_id")
    return jobs.transformWithStateInPandas(Jobs(int(stuck_seconds * 1000), int(keep_seconds * 1000)), OUTPUT, "append", "eventTime")


def accepted(changes: DataFrame) -> DataFrame:
    return changes.filter("rejected is null").drop("rejected")


def refused(changes: DataFrame) -> DataFrame:
    """The side output: events that were no legal transition, with the state they met."""
    return changes.filter("rejected is not null").select("job_id", "at", "status", "rejected")
