"""Sessions: runs of events of one key without a long gap.

The operator is a machine of keyed timers. The events of a key arrive in time
order; the first opens a session and sets its inactivity timer, each further
one that arrives before the timer fires moves the timer on, and a timer that
fires emits the session's start, end and count. ``KeyedTimers`` is that machine;
``sessionize`` runs it over a table and ``darkslide.streaming.sessions`` over a
stream.

A key may hold any share of the rows. Before the machine runs, events of one
key that fall into one slot as long as the gap are added up (they always belong
to one session); slots are at most the calendar's length over the gap, however
many events there are. The machine then works on chunks of a key's time line,
and a second run of it joins what chunk borders have cut. No task ever gets a
whole key's events.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Slots per chunk: with a gap of ten minutes, a day.
SLOTS_PER_CHUNK = 144


class KeyedTimers:
    """Inactivity timers of keys whose events come grouped by key and in order.

    At any time one session is open. ``update`` takes ordered arrays of events
    (key, first and last instant, count) and returns the sessions whose timer
    fired; ``close`` fires the last timer.
    """

    def __init__(self, gap: int):
        self.gap = gap
        self.open: tuple | None = None  # key, start, end, count

    def update(self, key: np.ndarray, lo: np.ndarray, hi: np.ndarray, n: np.ndarray) -> pd.DataFrame:
        if self.open is not None:
            k, s, e, c = self.open
            head = np.empty(1, dtype=object)
            head[0] = k
            key, lo, hi, n = np.concatenate([head, key]), np.r_[s, lo], np.r_[e, hi], np.r_[c, n]
        if not len(key):
            return pd.DataFrame({"key": key, "lo": lo, "hi": hi, "n": n})
        timer = hi + self.gap
        fired = np.r_[True, (key[1:] != key[:-1]) | (lo[1:] > timer[:-1])]
        at = np.flatnonzero(fired)
        last = np.r_[at[1:], len(key)] - 1
        counts = np.add.reduceat(n, at)
        self.open = (key[at[-1]], lo[at[-1]], hi[last[-1]], counts[-1])
        return pd.DataFrame({"key": key[at[:-1]], "lo": lo[at[:-1]], "hi": hi[last[:-1]], "n": counts[:-1]})

    def close(self) -> pd.DataFrame:
        rows = [self.open] if self.open is not None else []
        self.open = None
        return pd.DataFrame(rows, columns=["key", "lo", "hi", "n"])


def _machine(gap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        timers = KeyedTimers(gap)
        for b in batches:
            # A chunk is part of the key, so that its end fires the timer as the key's end does.
            keys = np.empty(len(b), dtype=object)
            keys[:] = list(zip(b["key"], b["chunk"]))
            yield _split(timers.update(keys, b["lo"].to_numpy(), b["hi"].to_numpy(), b["n"].to_numpy()))
        yield _split(timers.close())

    return run


def _split(done: pd.DataFrame) -> pd.DataFrame:
    keys = done.pop("key")
    done.insert(0, "key", pd.Series([k for k, _ in keys], dtype=object))
    done.insert(1, "chunk", pd.Series([c for _, c in keys], dtype="int64"))
    return done.astype({"lo": "int64", "hi": "int64", "n": "int64"})


def sessionize(events: DataFrame, key: str, at: str, gap: int, slots_per_chunk: int = SLOTS_PER_CHUNK) -> DataFrame:
    """Sessions (key, start, end, n) of ``events``; a gap of exactly ``gap`` does not end one.

    ``key`` is a string, ``at`` a bigint in the unit of ``gap``. Rows with a null
    key or instant are ignored. Equal instants count each. An empty table gives
    no sessions. Other columns are ignored.
    """
    if gap <= 0:
        raise ValueError("gap must be positive")
    e = events.select(F.col(key).alias("key"), F.col(at).alias("at")).dropna()
    slot = F.expr(f"(at - pmod(at, {gap}L)) div {gap}L")
    slots = e.groupBy("key", slot.alias("slot")).agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.count("*").alias("n"))
    chunk = F.expr(f"(slot - pmod(slot, {slots_per_chunk}L)) div {slots_per_chunk}L")
    schema = "key string, chunk bigint, lo bigint, hi bigint, n bigint"
    parts = (
        slots.select("key", chunk.alias("chunk"), "lo", "hi", "n")
        .repartition("key", "chunk").sortWithinPartitions("key", "chunk", "lo")
        .mapInPandas(_machine(gap), schema)
    )
    # Only the first and the last session of a chunk can go on beyond it. They meet under
    # chunk -1 of their key, at most two for each chunk; all others are final as they are.
    width = gap * slots_per_chunk
    near = (F.col("lo") - F.col("chunk") * width <= gap) | ((F.col("chunk") + 1) * width - F.col("hi") <= gap)
    inner = F.when(F.col("chunk") >= 0, F.col("chunk")).otherwise(F.col("chunk") - 1)  # never -1 itself
    return (
        parts.withColumn("chunk", F.when(near, F.lit(-1)).otherwise(inner))
        .repartition("key", "chunk").sortWithinPartitions("key", "chunk", "lo")
        .mapInPandas(_machine(gap), schema)
        .select("key", F.col("lo").alias("start"), F.col("hi").alias("end"), "n")
    )
