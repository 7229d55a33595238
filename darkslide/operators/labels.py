"""Labels that change over time: precedence of manual over automatic ones, undo, review."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def label_states(log: DataFrame) -> DataFrame:
    """(path, state, source) after all changes of ``log`` (path, seq, state, source).

    A manual change always holds; an automatic one only while there is no manual
    state; the empty state clears. So the state is that of the last manual change,
    unless it cleared or there is none: then of the last automatic change after it.
    Two aggregates that combine before the shuffle, whatever one path's share of
    the log. Unknown states are ignored; cleared and never labelled paths have the
    empty state.
    """
    known = log.filter(F.col("path").isNotNull() & F.col("state").isin("keep", "trash", ""))
    manual = F.coalesce("source", F.lit("manual")) == "manual"
    change = F.struct("seq", "state")
    last = known.groupBy("path").agg(F.max(F.when(manual, change)).alias("m"), F.max(F.when(~manual, change)).alias("a"))
    by_hand = F.coalesce(F.col("m.state") != "", F.lit(False))
    later = F.col("a").isNotNull() & (F.col("m").isNull() | (F.col("a.seq") > F.col("m.seq")))
    state = F.when(by_hand, F.col("m.state")).when(later, F.col("a.state")).otherwise("")
    return last.select("path", state.alias("state"), F.when(by_hand | ~later, "manual").otherwise("auto").alias("source"))


def replay(log: DataFrame, limit: int = 200) -> DataFrame:
    """(path, value, undoable, redoable) after a log (path, seq, action, value) of set, undo and redo.

    A set remembers the value it replaces and empties the list of what can be
    redone; more than ``limit`` sets cannot be undone. The history of one path is
    inherently sequential; it is kept short by ``limit`` while it is replayed.
    """

    def run(f: pd.DataFrame) -> pd.DataFrame:
        now, done, undone = None, [], []
        for action, value in f.sort_values("seq")[["action", "value"]].itertuples(index=False):
            if action == "set":
                done.append((now, value))
                del done[:-limit]
                undone.clear()
                now = value
            elif action == "undo" and done:
                undone.append(done.pop())
                now = undone[-1][0]
            elif action == "redo" and undone:
                done.append(undone.pop())
                now = done[-1][1]
        return pd.DataFrame({"path": [f["path"].iloc[0]], "value": [now], "undoable": [len(done)], "redoable": [len(undone)]})

    rows = log.select("path", "seq", "action", "value").filter("path is not null")
    return rows.groupBy("path").applyInPandas(run, "path bigint, value string, undoable int, redoable int")


def review_stats(queue: DataFrame) -> DataFrame:
    """Counts of a review queue (reviewed, user_label)."""
    reviewed, confirmed = F.coalesce("reviewed", F.lit(False)), F.coalesce(F.col("user_label") != "", F.lit(False))
    s = queue.agg(F.count("*").alias("total"), F.count_if(reviewed).alias("reviewed"), F.count_if(confirmed).alias("confirmed"))
    return s.select("total", "reviewed", (F.col("total") - F.col("reviewed")).alias("pending"), "confirmed", (F.col("reviewed") - F.col("confirmed")).alias("rejected"))


def refreshed(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """Automatic labels brought in line with new predictions: (path, old, new, change).

    ``labels`` (path, state, source), ``predictions`` (path, predicted). Manual labels
    stay; an automatic one changes with its prediction and goes if that is empty.
    """
    auto = labels.filter("source = 'auto' and state <> ''")
    j = auto.join(predictions, "path", "left")
    new = F.coalesce("predicted", F.col("state"))
    change = F.when(new == F.col("state"), "same").when(new == "", "removed").otherwise("changed")
    return j.select("path", F.col("state").alias("old"), new.alias("new"), change.alias("change"))


def applied(labels: DataFrame, predictions: DataFrame, keep_auto: float = 0.8, trash_auto: float = 0.2) -> DataFrame:
    """Labels that predictions (path, p, predicted) give to so far unlabelled paths, if they are very sure."""
    free = labels.filter("state = ''").select("path")
    sure = ((F.col("predicted") == "keep") & (F.col("p") >= keep_auto)) | ((F.col("predicted") == "trash") & (F.col("p") <= trash_auto))
    return free.join(predictions.filter(sure), "path").select("path", F.col("predicted").alias("state"), F.lit("auto").alias("source"))


def dirty(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """(path, old, new, changed) of the paths that a new prediction may change: those without a state or with an automatic one.

    ``labels`` (path, state, source), ``predictions`` (path, p, predicted). A path without
    a score keeps its state.
    """
    open_ = labels.filter("state = '' or source = 'auto'")
    j = open_.join(predictions, "path", "left")
    new = F.when(F.col("p").isNull(), F.col("state")).otherwise(F.col("predicted"))
    return j.select("path", F.col("state").alias("old"), new.alias("new"), (new != F.col("state")).alias("changed"))


def flagged(predictions: DataFrame, least: float = 0.9) -> DataFrame:
    """Review queue (path, predicted, p): predictions that are sure enough to be shown."""
    return predictions.filter(F.col("p") >= least).select("path", "predicted", "p")


def review(queue: DataFrame, answers: DataFrame) -> DataFrame:
    """The queue with the last answer of each entry: reviewed, user_label, the label it gives, and whether clearing takes it out.

    ``answers`` (path, user_label, seq); an empty label rejects. Answers to what is not in
    the queue count for nothing. Only keep and trash are applied.
    """
    last = answers.groupBy("path").agg(F.max_by("user_label", "seq").alias("user_label"))
    j = queue.join(last.withColumn("reviewed", F.lit(True)), "path", "left")
    done = F.coalesce("reviewed", F.lit(False))
    return j.select("path", "predicted", "p", done.alias("reviewed"), "user_label", F.when(F.col("user_label").isin("keep", "trash"), F.col("user_label")).alias("applied"), done.alias("cleared"))
