"""Queries on the quality of scores: pick_score of labelled items against their label."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from darkslide.operators import evaluation as e
from darkslide.operators.sequence import dense_index, running_sums
from darkslide.plans.grouping import items
from darkslide.sources.tables import table


def _rows(spark, data):
    y = F.when(F.lower(F.trim("label")) == "keep", 1).when(F.lower(F.trim("label")) == "trash", 0)
    return items(spark, data).select("item_id", y.alias("y"), F.col("pick_score").alias("p"), "album", "filename").filter("y is not null")


def _rounded(df, n=6):
    return df.select(*[F.round(c, n).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def a5_class_balance(spark, data):
    return _rounded(e.balance(_rows(spark, data)))


def a7_confusion(spark, data):
    return e.confusion(_rows(spark, data), 0.5)


def a8_asymmetric(spark, data):
    return _rounded(e.asymmetric(e.confusion(_rows(spark, data), 0.5)))


def a9_pr_auc(spark, data):
    return _rounded(e.pr_auc(_rows(spark, data)))


def a10_roc_auc(spark, data):
    return _rounded(e.roc_auc(_rows(spark, data)))


def a11_a16_losses(spark, data):
    return _rounded(e.brier_and_log_loss(_rows(spark, data)))


def a12_ece(spark, data):
    return _rounded(e.expected_calibration_error(_rows(spark, data)))


def a13_calibration(spark, data):
    return _rounded(e.calibration(_rows(spark, data)))


def a14_by_class(spark, data):
    c = e.confusion(_rows(spark, data), 0.5)
    stats = lambda name, tp, fp, fn: F.struct(F.lit(name).alias("class"), e.ratio(tp, tp + fp).alias("precision"), e.ratio(tp, tp + fn).alias("recall"), e.ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), (tp + fn).alias("support"))
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    return _rounded(c.select(F.explode(F.array(stats("keep", tp, fp, fn), stats("trash", tn, fn, fp))).alias("r")).select("r.*"))


def a15_folds(spark, data):
    """Mean and population deviation of accuracy over five folds made from the id's hash, equal in number per class."""
    w = Window.partitionBy("y").orderBy(F.md5(F.col("item_id").cast("string")), "item_id")
    r = _rows(spark, data).filter("p is not null and not isnan(p)").withColumn("fold", F.pmod(F.row_number().over(w), F.lit(5)))
    folds = r.groupBy("fold").agg(F.avg(((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("double")).alias("accuracy"))
    return folds.agg(F.round(F.avg("accuracy"), 6).alias("mean"), F.round(F.stddev_pop("accuracy"), 6).alias("deviation"))


def a29_ensemble_mean(spark, data):
    return items(spark, data).select("item_id", F.round(e.nan_mean([F.col("pick_score"), F.col("rating") / 5]), 6).alias("p"))


def a36_correlations(spark, data):
    """Pearson, Spearman and slope of file size against score."""
    size = table(spark, data, "photo_metadata").filter("file_size is not null").groupBy("filename").agg(F.max("file_size").alias("size"))
    r = items(spark, data).filter("pick_score is not null and not isnan(pick_score)").select("filename", F.col("pick_score").alias("p")).join(size, "filename")
    ranked = [(c, r.groupBy(c).agg(F.count("*").alias("n"))) for c in ("p", "size")]
    out = r
    for c, counts in ranked:  # average ranks of distinct values
        ranks = running_sums(counts, [F.asc(c)], ["n"])
        out = out.join(ranks.select(c, (F.col("run_n") - (F.col("n") - 1) / 2).alias(f"r_{c}")), c)
    return out.agg(F.round(F.corr("size", "p"), 6).alias("pearson"), F.round(F.corr("r_size", "r_p"), 6).alias("spearman"), F.round(F.regr_slope("p", "size") * 1e6, 6).alias("slope"))


def w6_threshold(spark, data):
    return e.threshold_for_loss(_rows(spark, data), 0.02)


def x10_classify(spark, data):
    return items(spark, data).select("item_id", e.classify(F.col("pick_score")).alias("predicted"))


def x11_dynamic_thresholds(spark, data):
    return _rounded(e.dynamic_thresholds(e.balance(_rows(spark, data))))


def o9_errors(spark, data):
    """All mistakes: trash with high scores, highest first, and keepers with low ones, lowest first, with their place."""
    r = _rows(spark, data).filter("p is not null and not isnan(p)")
    kind = F.when((F.col("y") == 0) & (F.col("p") >= 0.5), "fp").when((F.col("y") == 1) & (F.col("p") < 0.5), "fn")
    wrong = r.select("item_id", "p", kind.alias("kind")).filter("kind is not null")
    worst = F.when(F.col("kind") == "fp", -F.col("p")).otherwise(F.col("p"))
    return dense_index(wrong, [F.asc("kind"), worst.asc(), F.asc("item_id")], "at")


def _improvements(spark, data):
    m = table(spark, data, "benchmark_results").select("run_id", F.explode("metrics").alias("metric", "value"))
    base = m.groupBy("metric").agg(F.min_by("value", "run_id").alias("baseline"), F.min("run_id").alias("first"))
    j = m.join(base, "metric")
    worse = F.col("metric").isin("brier", "keep_loss")
    better = F.when(worse, e.improvement(F.col("baseline"), F.col("value"), True)).otherwise(e.improvement(F.col("baseline"), F.col("value")))
    return j.select("run_id", "metric", "value", "baseline", better.alias("better"), "first")


def j12_x29_compare(spark, data):
    """Metrics of each run against the first run that has them: value, baseline and percent of improvement."""
    return _improvements(spark, data).select("run_id", "metric", F.round("value", 6).alias("value"), F.round("baseline", 6).alias("baseline"), F.round("better", 4).alias("improvement_pct"))


def a30_gains(spark, data):
    """By metric: how many later runs gain, lose or stay as the first is, and by how much on average."""
    later = _improvements(spark, data).filter("run_id > first").select("metric", F.round("better", 4).alias("gain"))
    return _rounded(e.gain_summary(later, "metric", "gain"))


def a18_runs_by_kind(spark, data):
    r = table(spark, data, "benchmark_results")
    size = F.col("train_size")
    return r.groupBy("model_name", "feature_mode").agg(F.count("*").alias("n"), F.round(F.avg(size), 6).alias("mean"), F.percentile(size, F.lit(0.5)).alias("median"))


def a37_best_runs(spark, data):
    """Runs within a percentage point of the best accuracy, with mean and deviation of all."""
    r = table(spark, data, "benchmark_results").select("run_id", F.try_element_at("metrics", F.lit("accuracy")).alias("accuracy")).filter("accuracy is not null")
    s = r.agg(F.max("accuracy").alias("best"), F.avg("accuracy").alias("mean"), F.stddev_pop("accuracy").alias("deviation"))
    return _rounded(r.crossJoin(F.broadcast(s)).filter("accuracy >= best - 0.01"))


def w10_best_so_far(spark, data):
    r = table(spark, data, "benchmark_results").select("run_id", F.try_element_at("metrics", F.lit("accuracy")).alias("accuracy"))
    return r.select("run_id", F.round(F.max("accuracy").over(Window.orderBy("run_id").rowsBetween(Window.unboundedPreceding, 0)), 6).alias("best"))


def w9_share_of_total(spark, data):
    n = items(spark, data).groupBy("album").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.crossJoin(F.broadcast(total)).select("album", F.round(F.col("n") * 100 / F.col("total"), 6).alias("pct"))


def a17_timings(spark, data):
    ev = table(spark, data, "events")
    return ev.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("greatest"))


def a33_bytes(spark, data):
    return table(spark, data, "photo_metadata").filter("file_size is not null").groupBy(F.regexp_extract("file_path", r"^(.*)[/\\]", 1).alias("folder")).agg(F.sum("file_size").alias("bytes"))


def x30_suggestions(spark, data):
    """What the mistakes of the scores suggest, as codes."""
    c = e.asymmetric(e.confusion(_rows(spark, data), 0.5))
    return c.select("fp", "fn", F.round("accuracy", 6).alias("accuracy"), F.concat_ws(",", e.suggestions(F.col("fp"), F.col("fn"), F.col("accuracy"))).alias("suggestions"))


QUERIES = {f.__name__: f for f in (
    a5_class_balance, a7_confusion, a8_asymmetric, a9_pr_auc, a10_roc_auc, a11_a16_losses, a12_ece, a13_calibration, a14_by_class, a15_folds, a29_ensemble_mean,
    a36_correlations, w6_threshold, x10_classify, x11_dynamic_thresholds, o9_errors, j12_x29_compare, a18_runs_by_kind, a37_best_runs, w10_best_so_far,
    a30_gains, w9_share_of_total, a17_timings, a33_bytes, x30_suggestions,
)}

I = "with i as (select distinct on (item_id) * from image_items), "  # noqa: E741
R = I + """l as (select item_id, album, filename, case lower(trim(label)) when 'keep' then 1 when 'trash' then 0 end as y, pick_score as p from i),
r as (select * from l where y is not null and p is not null and not isnan(p)),
c as (select count_if(y = 0 and p < .5)::bigint as tn, count_if(y = 0 and p >= .5)::bigint as fp, count_if(y = 1 and p < .5)::bigint as fn, count_if(y = 1 and p >= .5)::bigint as tp from r)"""
_BINS = """, b as (select range::int as bin from range(1, 11)), g as (select ceil(p * 10)::int as bin, count(*) as n, avg(p) as mean, avg(y) as share from r where p > 0 group by 1),
t as (select bin, coalesce(n, 0) as n, coalesce(mean, (bin - 0.5) / 10) as mean, coalesce(share, 0.0) as share from b left join g using (bin))"""
_BAL = ", n as (select count_if(y = 1)::bigint as keep, count_if(y = 0)::bigint as trash from l where y is not null)"

_GAIN = """with m as (select run_id, unnest(map_keys(metrics)) as metric, unnest(map_values(metrics)) as value from benchmark_results),
b as (select metric, arg_min(value, run_id) as baseline, min(run_id) as first from m group by 1),
z as (select m.*, baseline, first, case when baseline > 0 then (case when metric in ('brier', 'keep_loss') then baseline - value else value - baseline end) / baseline * 100 else 0 end as better from m join b using (metric))"""

ORACLE = {
    "a5_class_balance": R + _BAL + """ select keep, trash, round(greatest(keep, trash) / least(keep, trash), 6) as ratio, round(keep * 100.0 / (keep + trash), 6) as keep_pct,
case when least(keep, trash) = 0 then 'insufficient' when greatest(keep, trash) / least(keep, trash) < 1.5 then 'balanced' when greatest(keep, trash) / least(keep, trash) < 3 then 'moderate' else 'severe' end as severity,
greatest(keep, trash) / least(keep, trash) >= 3 as severe, round(trash / keep, 6) as pos_weight from n""",
    "a7_confusion": R + " select * from c",
    "a8_asymmetric": R + """ select tn, fp, fn, tp, round(fn / (tp + fn), 6) as keep_loss, round(fp / (fp + tn), 6) as junk_leak, round((tp + fp) / (tn + fp + fn + tp), 6) as keep_rate,
round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall, round(2 * tp / (2 * tp + fp + fn), 6) as f1, round((tp + tn) / (tn + fp + fn + tp), 6) as accuracy from c""",
    "a9_pr_auc": R + """, s as (select p, sum(sum(y)) over (order by p desc) as tp, sum(count(*)) over (order by p desc) as n from r group by p),
q as (select p, tp / (select sum(y) from r) as rc, tp / n as pc from s), z as (select rc, pc, lag(rc, 1, 0.0) over (order by p desc) as r0, lag(pc, 1, 1.0) over (order by p desc) as p0 from q)
select round(sum((rc - r0) * (pc + p0) / 2), 6) as pr_auc from z""",
    "a10_roc_auc": R + """, k as (select y, rank() over (order by p) + (count(*) over (partition by p) - 1) / 2 as rk from r)
select round((sum(case when y = 1 then rk end) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)), 6) as roc_auc from k""",
    "a11_a16_losses": R + " select round(avg((p - y) * (p - y)), 6) as brier, round(avg(-(y * ln(greatest(1e-15, least(1 - 1e-15, p))) + (1 - y) * ln(1 - greatest(1e-15, least(1 - 1e-15, p))))), 6) as log_loss from r",
    "a12_ece": R + _BINS + " select round(sum(n / (select count(*) from r) * abs(mean - share)), 6) as ece from t",
    "a13_calibration": R + _BINS + " select bin, n, round(mean, 6) as mean, round(share, 6) as share from t",
    "a14_by_class": R + """ select 'keep' as class, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall, round(2 * tp / (2 * tp + fp + fn), 6) as f1, tp + fn as support from c
union all select 'trash', round(tn / (tn + fn), 6), round(tn / (tn + fp), 6), round(2 * tn / (2 * tn + fp + fn), 6), tn + fp from c""",
    "a15_folds": R + """, k as (select y, p, (row_number() over (partition by y order by md5(item_id::varchar), item_id)) % 5 as f from r),
g as (select f, avg(case when (p >= .5)::int = y then 1.0 else 0.0 end) as a from k group by f) select round(avg(a), 6) as mean, round(stddev_pop(a), 6) as deviation from g""",
    "a29_ensemble_mean": I + """z as (select item_id, case when isnan(pick_score) then null else pick_score end as a, rating / 5 as b from i)
select item_id, round(case when a is null then b when b is null then a else (a + b) / 2 end, 6) as p from z""",
    "a36_correlations": I + """s as (select filename, max(file_size) as size from photo_metadata where file_size is not null group by 1),
j as (select pick_score as p, size from i join s using (filename) where not isnan(pick_score)),
k as (select p, size, rank() over (order by p) + (count(*) over (partition by p) - 1) / 2 as rp, rank() over (order by size) + (count(*) over (partition by size) - 1) / 2 as rs from j)
select round(corr(size, p), 6) as pearson, round(corr(rs, rp), 6) as spearman, round(regr_slope(p, size) * 1e6, 6) as slope from k""",
    "w6_threshold": R + """, k as (select p, row_number() over (order by p) - 1 as rk, count(*) over () as n from r where y = 1)
select p as threshold from k where rk = floor(0.02 * n)""",
    "x10_classify": I + "z as (select item_id, case when isnan(pick_score) then null else pick_score end as p from i) select item_id, case when p is null then '' when p >= 0.7 then 'keep' when p <= 0.3 then 'trash' else '' end as predicted from z",
    "x11_dynamic_thresholds": R + _BAL + """ select keep, trash, round(0.7 + case when keep / trash > 1.2 then least(0.08, (keep / trash - 1) * 0.04) else 0 end, 6)::double as keep_at,
round(0.3 - case when trash / keep > 1.2 then least(0.05, (trash / keep - 1) * 0.03) else 0 end, 6)::double as trash_at from n""",
    "o9_errors": R + """ select *, row_number() over (order by kind, case kind when 'fp' then -p else p end, item_id) - 1 as "at"
from (select item_id, p, case when y = 0 and p >= .5 then 'fp' when y = 1 and p < .5 then 'fn' end as kind from r) where kind is not null""",
    "j12_x29_compare": _GAIN + " select run_id, metric, round(value, 6) as value, round(baseline, 6) as baseline, round(better, 4) as improvement_pct from z",
    "a30_gains": _GAIN + """, g as (select metric, round(better, 4) as gain from z where run_id > first)
select metric, count(*) as n, count_if(gain > 0)::bigint as gains, count_if(gain < 0)::bigint as losses, count_if(gain = 0)::bigint as same,
round(avg(case when gain > 0 then gain end), 6) as mean_gain, round(avg(case when gain < 0 then gain end), 6) as mean_loss from g group by metric""",
    "a18_runs_by_kind": "select model_name, feature_mode, count(*) as n, round(avg(train_size), 6) as mean, quantile_cont(train_size, 0.5)::double as median from benchmark_results group by 1, 2",
    "a37_best_runs": """with r as (select run_id, metrics['accuracy'] as accuracy from benchmark_results where metrics['accuracy'] is not null), s as (select max(accuracy) as best, avg(accuracy) as mean, stddev_pop(accuracy) as deviation from r)
select run_id, round(accuracy, 6) as accuracy, round(best, 6) as best, round(mean, 6) as mean, round(deviation, 6) as deviation from r, s where accuracy >= best - 0.01""",
    "w10_best_so_far": "select run_id, round(max(metrics['accuracy']) over (order by run_id rows unbounded preceding), 6) as best from benchmark_results",
    "w9_share_of_total": I + "n as (select album, count(*) as n from i group by 1) select album, round(n * 100 / sum(n) over (), 6) as pct from n",
    "a17_timings": "select event_type, count(*) as n, round(sum(value), 4) as total, round(avg(value), 6) as mean, min(value) as least, max(value) as greatest from events group by 1",
    "a33_bytes": "select regexp_extract(file_path, '^(.*)[/\\\\]', 1) as folder, sum(file_size)::bigint as bytes from photo_metadata where file_size is not null group by 1",
    "x30_suggestions": R + """ select fp, fn, round(a, 6) as accuracy, concat_ws(',', case when fp > 2 * fn then 'raise_threshold' when fn > 2 * fp then 'lower_threshold' end,
 case when a < 0.85 then 'more_data,augment' else 'edge_cases,generalise' end) as suggestions from (select *, (tp + tn) / (tn + fp + fn + tp) as a from c)""",
}
