"""Quality of scores: confusion, asymmetric metrics, areas, calibration, thresholds.

All take rows (y int, 1 keep and 0 trash; p double) and aggregate in the JVM.
Equal scores are first added up, so a window over scores sees each once.
Rows with a null or NaN score or a null class do not count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from darkslide.operators.sequence import running_sums


def scored(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("y").cast("int").alias("y"), F.col("p").cast("double").alias("p")).dropna().filter(~F.isnan("p"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b != 0, a / b).otherwise(0.0)


def confusion(rows: DataFrame, threshold: float) -> DataFrame:
    keep = F.col("p") >= threshold
    y = F.col("y") == 1
    return scored(rows).agg(
        F.count_if(~y & ~keep).alias("tn"), F.count_if(~y & keep).alias("fp"), F.count_if(y & ~keep).alias("fn"), F.count_if(y & keep).alias("tp")
    )


def asymmetric(counts: DataFrame) -> DataFrame:
    """Rates of a confusion: what is lost of the keepers, and how much trash leaks."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return counts.select(
        "tn", "fp", "fn", "tp", ratio(fn, tp + fn).alias("keep_loss"), ratio(fp, fp + tn).alias("junk_leak"), ratio(tp + fp, tn + fp + fn + tp).alias("keep_rate"),
        precision.alias("precision"), recall.alias("recall"), ratio(2 * precision * recall, precision + recall).alias("f1"), ratio(tp + tn, tn + fp + fn + tp).alias("accuracy"),
    )


def _steps(rows: DataFrame) -> DataFrame:
    """Per distinct score: keepers and others at it, and at it or above."""
    at = scored(rows).groupBy("p").agg(F.sum("y").alias("k"), F.sum(1 - F.col("y")).alias("t"))
    return running_sums(at, [F.desc("p")], ["k", "t"]).withColumnsRenamed({"run_k": "tp", "run_t": "fp"})


def roc_auc(rows: DataFrame) -> DataFrame:
    """Share of (keep, trash) pairs in the right order, ties half; null without both classes."""
    s = _steps(rows)
    n = s.agg(F.sum("k").alias("nk"), F.sum("t").alias("nt"), F.sum(F.col("t") * (F.col("tp") - F.col("k") / 2)).alias("won"))
    return n.select(F.when((F.col("nk") > 0) & (F.col("nt") > 0), F.col("won") / (F.col("nk") * F.col("nt"))).alias("roc_auc"))


def roc_auc_by(rows: DataFrame, key: str) -> DataFrame:
    """(key, roc_auc) of rows (key, y, p) as ``roc_auc`` has it, for all keys in one pass."""
    good = rows.select(key, F.col("y").cast("int").alias("y"), F.col("p").cast("double").alias("p")).dropna().filter(~F.isnan("p"))
    at = good.groupBy(key, "p").agg(F.sum("y").alias("k"), F.sum(1 - F.col("y")).alias("t"))
    s = running_sums(at, [F.asc(key), F.desc("p")], ["k"])
    earlier = F.min(F.col("run_k") - F.col("k"))  # keepers of the keys before
    n = s.groupBy(key).agg(F.sum("k").alias("nk"), F.sum("t").alias("nt"), (F.sum(F.col("t") * (F.col("run_k") - F.col("k") / 2)) - earlier * F.sum("t")).alias("won"))
    return n.select(key, F.when((F.col("nk") > 0) & (F.col("nt") > 0), F.col("won") / (F.col("nk") * F.col("nt"))).alias("roc_auc"))


def pr_auc(rows: DataFrame) -> DataFrame:
    """Area under the straight lines between points (recall, precision), beginning at (0, 1)."""
    s = _steps(rows).crossJoin(F.broadcast(scored(rows).agg(F.sum("y").alias("nk"))))
    tp0, fp0 = F.col("tp") - F.col("k"), F.col("fp") - F.col("t")
    q0 = F.when(tp0 + fp0 > 0, tp0 / (tp0 + fp0)).otherwise(1.0)
    s = s.select((F.col("tp") / F.col("nk")).alias("r"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("q"), (tp0 / F.col("nk")).alias("r0"), q0.alias("q0"))
    return s.agg(F.sum((F.col("r") - F.col("r0")) * (F.col("q") + F.col("q0")) / 2).alias("pr_auc"))


def brier_and_log_loss(rows: DataFrame) -> DataFrame:
    p = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col("p")))
    return scored(rows).agg(
        F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"), F.avg(-(F.col("y") * F.ln(p) + (1 - F.col("y")) * F.ln(1 - p))).alias("log_loss")
    )


def calibration(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Per bin (lo, hi] of the score: count, mean score, share of keepers; empty bins too, with their middle and 0. A score of 0 is in no bin."""
    all_bins = rows.sparkSession.range(bins).select((F.col("id") + 1).cast("int").alias("bin"))
    b = scored(rows).filter("p > 0").groupBy(F.ceil(F.col("p") * bins).cast("int").alias("bin"))
    got = b.agg(F.count("*").alias("n"), F.avg("p").alias("mean"), F.avg("y").alias("share"))
    return all_bins.join(got, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mean", (F.col("bin") - 0.5) / bins).alias("mean"), F.coalesce("share", F.lit(0.0)).alias("share"))


def expected_calibration_error(rows: DataFrame, bins: int = 10) -> DataFrame:
    total = scored(rows).agg(F.count("*").alias("total"))
    gaps = calibration(rows, bins).crossJoin(F.broadcast(total))
    return gaps.agg(F.sum(ratio(F.col("n").cast("double"), F.col("total")) * F.abs(F.col("mean") - F.col("share"))).alias("ece"))


def threshold_for_loss(rows: DataFrame, max_loss: float) -> DataFrame:
    """The highest threshold at which no more than ``max_loss`` of the keepers fall below: one row.

    Without keepers 0.5; with no loss allowed just below the least keeper's score,
    but not below 0; with all allowed 1.
    """
    s = _steps(rows).filter("k > 0")
    n = s.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("nk"), F.min("p").alias("least"))
    s = s.crossJoin(F.broadcast(n)).select("p", "nk", "least", (F.col("nk") - F.col("tp")).alias("below"), F.floor(F.lit(max_loss) * F.col("nk")).alias("allowed"))
    found = s.agg(F.max("nk").alias("nk"), F.max("allowed").alias("allowed"), F.min("least").alias("least"), F.max(F.when(F.col("below") <= F.col("allowed"), F.col("p"))).alias("at"))
    t = F.when(F.col("nk").isNull(), 0.5).when(F.col("allowed") <= 0, F.greatest(F.lit(0.0), F.col("least") - 1e-10)).when(F.col("allowed") >= F.col("nk"), 1.0).otherwise(F.col("at"))
    return found.select(F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)).alias("threshold"))


def balance(rows: DataFrame) -> DataFrame:
    """Counts of both classes, their ratio (0 if one is missing) and how bad it is."""
    c = rows.agg(F.count_if(F.col("y") == 1).alias("keep"), F.count_if(F.col("y") == 0).alias("trash"))
    lo, hi = F.least("keep", "trash"), F.greatest("keep", "trash")
    r = ratio(hi.cast("double"), lo)
    kind = F.when(lo == 0, "insufficient").when(r < 1.5, "balanced").when(r < 3.0, "moderate").otherwise("severe")
    return c.select("keep", "trash", r.alias("ratio"), ratio(F.col("keep") * 100.0, F.col("keep") + F.col("trash")).alias("keep_pct"), kind.alias("severity"), (r >= 3.0).alias("severe"), ratio(F.col("trash").cast("double"), F.col("keep")).alias("pos_weight"))


def dynamic_thresholds(counts: DataFrame, keep: float = 0.7, trash: float = 0.3) -> DataFrame:
    """Thresholds moved towards the rarer class where one outnumbers the other by more than a fifth.

    Takes keep and trash counts. The majority's threshold gets stricter, by 0.04 of
    the excess ratio up to 0.08 for keep and 0.03 up to 0.05 for trash; if they meet
    they are set 0.05 either side of their middle.
    """
    k, t = F.col("keep").cast("double"), F.col("trash").cast("double")
    more_keep, more_trash = ratio(k, t), ratio(t, k)
    up = F.when(more_keep > 1.2, F.least(F.lit(0.08), (more_keep - 1) * 0.04)).otherwise(0.0)
    down = F.when(more_trash > 1.2, F.least(F.lit(0.05), (more_trash - 1) * 0.03)).otherwise(0.0)
    a, b = F.lit(keep) + up, F.lit(trash) - down
    middle = (a + b) / 2
    return counts.select("keep", "trash", F.when(a <= b, middle + 0.05).otherwise(a).alias("keep_at"), F.when(a <= b, middle - 0.05).otherwise(b).alias("trash_at"))


def classify(p: Column, keep: float = 0.7, trash: float = 0.3) -> Column:
    """keep, trash or, between the thresholds and without a score, the empty string."""
    return F.when(p.isNull() | F.isnan(p), "").when(p >= keep, "keep").when(p <= trash, "trash").otherwise("")


def improvement(old: Column, new: Column, smaller_is_better: bool = False) -> Column:
    """Percent of improvement over ``old``; 0 if that is not positive."""
    d = old - new if smaller_is_better else new - old
    return F.when(old > 0, d / old * 100).otherwise(0.0)


def nan_mean(columns: list[Column]) -> Column:
    """The mean of those that are numbers; null if none is."""
    ok = [F.when(~F.isnan(c), c) for c in columns]
    n = sum((c.isNotNull().cast("int") for c in ok), F.lit(0))
    return F.when(n > 0, sum((F.coalesce(c, F.lit(0.0)) for c in ok), F.lit(0.0)) / n)


def gain_summary(gains: DataFrame, key: str, gain: str) -> DataFrame:
    """Per key: numbers of positive, negative and zero gains, and the means of the positive and of the negative ones."""
    g = F.col(gain)
    return gains.groupBy(key).agg(
        F.count("*").alias("n"), F.count_if(g > 0).alias("gains"), F.count_if(g < 0).alias("losses"), F.count_if(g == 0).alias("same"),
        F.avg(F.when(g > 0, g)).alias("mean_gain"), F.avg(F.when(g < 0, g)).alias("mean_loss"),
    )


def suggestions(fp: Column, fn: Column, accuracy: Column, training_accuracy: Column | None = None) -> Column:
    """Codes of what mistakes suggest: a threshold when one kind is more than twice the other, overfitting, and what to do at low or high accuracy."""
    over = F.lit(None).cast("string") if training_accuracy is None else F.when((training_accuracy > 0) & (accuracy < training_accuracy - 0.1), "overfitting")
    lean = F.when(fp > 2 * fn, "raise_threshold").when(fn > 2 * fp, "lower_threshold")
    low = accuracy < 0.85
    return F.array_compact(F.array(lean, over, F.when(low, "more_data").otherwise("edge_cases"), F.when(low, "augment").otherwise("generalise")))


def valid_thresholds(keep: float, trash: float) -> tuple[float, float]:
    """Both rounded to four digits; ValueError unless 0 <= trash < keep <= 1, with keep above 0 and trash below 1."""
    if not (0 < keep <= 1 and 0 <= trash < 1 and keep > trash):
        raise ValueError(f"thresholds need 0 <= trash < keep <= 1: keep {keep}, trash {trash}")
    return round(keep, 4), round(trash, 4)


def thresholds_hold(keep: Column, trash: Column) -> Column:
    """The same rule on columns; null thresholds do not hold."""
    return F.coalesce((keep > 0) & (keep <= 1) & (trash >= 0) & (trash < 1) & (keep > trash), F.lit(False))
