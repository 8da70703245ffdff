"""Streaming forms, beyond what the batch pipeline has; each also works on a batch table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _marked(events: DataFrame, late: str) -> DataFrame:
    return events.withWatermark("ts", late) if events.isStreaming else events


def live_grid(events: DataFrame, every: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """(video_id, start, n, last_value) for each window of events (video_id, ts, value)."""
    windowed = _marked(events, late).groupBy("video_id", F.window("ts", every))
    return windowed.agg(F.count("*").alias("n"), F.max("value").alias("top")).select("video_id", F.col("window.start").alias("start"), "n", "top")


def quiet_sessions(quiet: DataFrame, gap: str = "4 seconds", late: str = "10 seconds") -> DataFrame:
    """(video_id, start, end, n): quiet events (video_id, ts) less than ``gap`` apart are one session."""
    sessions = _marked(quiet, late).groupBy("video_id", F.session_window("ts", gap))
    return sessions.agg(F.count("*").alias("n")).select("video_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def unique_events(events: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Events without repeated (video_id, event_id)."""
    key = ["video_id", "event_id"]
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key) if events.isStreaming else events.dropDuplicates(key)


def thinned(candidates: DataFrame, min_gap: int = 3, idle: str | None = None) -> DataFrame:
    """Streamed candidates (video_id, t), thinned as they come: kept if far enough from the last kept one of the recording.

    State is one number for each recording; candidates of a batch are taken in order, earlier ones that come late are dropped.
    With ``idle`` ("1 day") a recording without candidates for so long is forgotten, and one that comes again begins anew, so state
    doesn't grow for ever. That is by the clock, for streams that run on: one that ends with its input would wait for it.
    """
    idle_ms = None if idle is None else int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"video_id": [], "t": []})
            return
        last = state.get[0] if state.exists else None
        kept = []
        for t in sorted({int(t) for pdf in batches for t in pdf["t"]}):
            if last is None or t - last >= min_gap:
                kept.append(t)
                last = t
        if last is not None:
            state.update((last,))
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"video_id": [key[0]] * len(kept), "t": kept})

    return candidates.groupBy("video_id").applyInPandasWithState(step, "video_id string, t int", "last int", "append", GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout)
