"""Sessions of a stream, by keyed event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from darkslide.operators.sessions import KeyedTimers

OUTPUT = "key string, start bigint, end bigint, n bigint"
STATE = "start array<bigint>, end array<bigint>, n array<bigint>"


def stream_sessions(events: DataFrame, key: str, ts: str, gap_us: int, lateness: str = "10 minutes") -> DataFrame:
    """Sessions of a streaming table, each emitted when its timer fires: the watermark has passed its end by more than the gap.

    Until then it stays open, so that an event that is late by no more than the
    watermark allows goes on with it, comes before it, or joins two of them; a key may
    have several open sessions. Later events are dropped, as streams must; the batch
    operator ``sessionize`` takes them all. Null keys and times are ignored.
    """
    e = events.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts")).dropna()
    e = e.withWatermark("ts", lateness).withColumn("at", F.unix_micros("ts"))

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        lo, hi, n = (np.array(x, dtype=np.int64) for x in state.get) if state.exists else (np.zeros(0, dtype=np.int64),) * 3
        if not state.hasTimedOut:
            at = np.concatenate([b["at"].to_numpy() for b in batches])
            lo, hi, n = np.r_[lo, at], np.r_[hi, at], np.r_[n, np.ones(len(at), dtype=np.int64)]
        # Open sessions and new events in order; what a timer does not part becomes one.
        order = np.argsort(lo, kind="stable")
        timers = KeyedTimers(gap_us)
        parts = [timers.update(np.full(len(lo), k[0], dtype=object), lo[order], np.maximum.accumulate(hi[order]), n[order]), timers.close()]
        sessions = _sessions(pd.concat([p for p in parts if len(p)] or parts[:1]))
        over = sessions["end"] + gap_us < state.getCurrentWatermarkMs() * 1000
        still = sessions[~over]
        if len(still):
            state.update((still["start"].tolist(), still["end"].tolist(), still["n"].tolist()))
            # Spark's timers are in milliseconds; one more so that a gap of exactly gap_us still joins.
            state.setTimeoutTimestamp(max(int((still["end"].min() + gap_us) // 1000) + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if over.any():
            yield sessions[over]

    return e.groupBy("key").applyInPandasWithState(update, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def _sessions(done: pd.DataFrame) -> pd.DataFrame:
    return done.astype({"key": object, "lo": "int64", "hi": "int64", "n": "int64"}).rename(columns={"lo": "start", "hi": "end"})


def window_sessions(events: DataFrame, key: str, ts: str, gap: str = "10 minutes", lateness: str = "10 minutes") -> DataFrame:
    """The same by the built-in session window, where no other behaviour at expiry is wanted."""
    e = events.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts")).dropna().withWatermark("ts", lateness)
    return e.groupBy("key", F.session_window("ts", gap)).agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n")).drop("session_window")
