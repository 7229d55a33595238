"""Label changes and predictions as streams."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_label_states(log: DataFrame) -> DataFrame:
    """(path, state, source) whenever it changes, of a stream (path, seq, state, source).

    Keeps of each path the last manual and the last automatic change, so that
    changes may come in any order; the rule is that of ``labels.label_states``.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        m_seq, m, a_seq, a = state.get if state.exists else (-1, "", -1, "")
        before = _outcome(m_seq, m, a_seq, a) if state.exists else None
        for b in batches:
            for seq, value, source in b[["seq", "state", "source"]].itertuples(index=False):
                if value not in ("keep", "trash", ""):
                    continue
                if source == "auto":
                    a_seq, a = max((a_seq, a), (int(seq), value))
                else:
                    m_seq, m = max((m_seq, m), (int(seq), value))
        state.update((m_seq, m, a_seq, a))
        after = _outcome(m_seq, m, a_seq, a)
        if after != before:
            yield pd.DataFrame([(key[0], *after)], columns=["path", "state", "source"])

    kind = "m_seq bigint, m string, a_seq bigint, a string"
    return log.groupBy("path").applyInPandasWithState(update, f"path {log.schema['path'].dataType.simpleString()}, state string, source string", kind, "update", GroupStateTimeout.NoTimeout)


def _outcome(m_seq: int, m: str, a_seq: int, a: str) -> tuple[str, str]:
    if m:
        return m, "manual"
    return (a, "auto") if a_seq > m_seq else ("", "manual")


def debounced(changes: DataFrame, key: str, ts: str, value: str, quiet: str = "1 second", lateness: str = "10 seconds") -> DataFrame:
    """Of each burst of changes of a key, once it has been quiet for so long, the last value."""
    c = changes.withWatermark(ts, lateness)
    return c.groupBy(key, F.session_window(ts, quiet)).agg(F.max_by(value, ts).alias(value), F.count("*").alias("n"), F.max(ts).alias("last")).drop("session_window")


def coalesced(requests: DataFrame, key: str, ts: str, lateness: str = "10 minutes") -> DataFrame:
    """Each key's first request only, while repetitions can arrive."""
    return requests.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])


class SingleFlight:
    """At most one run of a task at a time, with a pause between the beginnings of two; requests made meanwhile become one further run.

    ``run`` gets what the last run left, and what it returns is kept; a run that fails keeps
    the last result, counts as failed and does not stop later ones.
    """

    def __init__(self, run: Callable, pause: float = 1.5, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.run, self.pause, self.clock, self.sleep = run, pause, clock, sleep
        self.lock, self.pending, self.running, self.began = threading.Lock(), False, False, None
        self.result, self.runs, self.failed = None, 0, 0

    def request(self) -> bool:
        """Ask for a run; whether this call did the running. It returns when nothing is pending."""
        with self.lock:
            self.pending = True
            if self.running:
                return False
            self.running = True
        while True:
            with self.lock:
                if not self.pending:
                    self.running = False
                    return True
                self.pending = False
            if self.began is not None and (left := self.began + self.pause - self.clock()) > 0:
                self.sleep(left)
            self.began = self.clock()
            try:
                self.result, self.runs = self.run(self.result), self.runs + 1
            except Exception:  # the next run may do better
                self.failed += 1


def picture_stream(spark: SparkSession, folder: str, at_once: int = 20) -> DataFrame:
    """Pictures of a folder as they come, so many in a batch; a stream goes on where it was."""
    kind = "path string, modificationTime timestamp, length bigint, content binary"
    return spark.readStream.format("binaryFile").schema(kind).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", at_once).load(folder)


def scored_so_far(spark: SparkSession, sink: str, key: str) -> DataFrame:
    """Of what ``score_stream`` has written the last score of each key; usable while the stream still runs, and to start from after a stop."""
    rows = spark.read.parquet(sink)
    others = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), "batch").alias("__r")).select(key, "__r.*")


def score_stream(rows: DataFrame, score: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str):
    """Score each micro-batch and append it to a parquet table, once for each batch even if it is retried."""

    def write(batch: DataFrame, number: int) -> None:
        score(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
