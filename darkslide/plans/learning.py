"""Queries that learn keep and trash from the statistics and histograms of labelled items."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.feature import PolynomialExpansion, StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darkslide.operators import evaluation as ev
from darkslide.operators import learning as L
from darkslide.operators.shared import Written, shared_folder
from darkslide.plans.grouping import items
from darkslide.plans.studies import _ALL, BINS, STATS, _features, bins
from darkslide.sources.tables import table

NAMES = [*STATS, *BINS, "rating"]


def _labelled(spark, data) -> DataFrame:
    y = F.when(F.lower(F.trim("label")) == "keep", 1).when(F.lower(F.trim("label")) == "trash", 0)
    return items(spark, data).select(F.col("item_id").alias("id"), y.alias("y"), "album").filter("y is not null")


def _vectors(spark, data) -> DataFrame:
    """(id, raw): the features of every item; values that are no numbers, and those of items without a vector, are 0."""
    number = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c)
    v = table(spark, data, "preprocess_results").dropDuplicates(["item_id"]).filter("size(hist_feat) in (24, 48)").select(F.col("item_id").alias("id"), *STATS, *bins(), F.lit(True).alias("known"))
    i = items(spark, data).select(F.col("item_id").alias("id"), "rating").filter("id is not null")
    rows = i.join(v, "id", "left").select("id", F.coalesce("known", F.lit(False)).alias("known"), *[number(c) for c in NAMES])
    return VectorAssembler(inputCols=NAMES, outputCol="raw").transform(rows).select("id", "known", "raw")


def _scaled(spark, data) -> tuple[DataFrame, DataFrame]:
    """The labelled rows with a vector (id, y, features), and all items (id, features), scaled alike."""
    everything = Written(_vectors(spark, data), "vectors").df
    x = everything.filter("known").join(_labelled(spark, data), "id")
    x = Written(x.select("id", "y", "raw"), "dataset").df
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(x)
    return scaler.transform(x).select("id", "y", "features"), scaler.transform(everything).select("id", "known", "features")


def dataset(spark, data) -> DataFrame:
    """(id, y, features): labelled items with a vector of either length, scaled; values that are no numbers are 0."""
    return _scaled(spark, data)[0]


def _split(spark, data):
    r = Written(L.stratified_split(dataset(spark, data), "id", "y", {"train": 0.8, "test": 0.2}), "split").df
    return r.filter("split = 'train'").drop("split"), r.filter("split = 'test'").drop("split")


def _table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def m3_split(spark, data):
    return L.stratified_split(_labelled(spark, data), "id", "y", {"train": 0.7, "val": 0.1, "test": 0.2}).select("id", "split")


def m4_folds(spark, data):
    return L.stratified_folds(_labelled(spark, data), "id", "y", 3).select("id", "fold")


def m4_grouped_folds(spark, data):
    return L.grouped_folds(_labelled(spark, data).filter("album is not null"), "album", 5).select("id", "fold")


def m22_undersampled(spark, data):
    return L.undersampled(_labelled(spark, data), "id", "y").select("id", "y")


def m22_weights(spark, data):
    return L.class_weights(_labelled(spark, data), "y").select("id", F.round("weight", 6).alias("weight"))


def m22_oversampled(spark, data):
    made = L.oversampled(dataset(spark, data), "id", "y", 0)
    return made.select("y", F.round(F.aggregate("features", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.size("features").alias("width"))


def m2_gate(spark, data):
    n = _labelled(spark, data).agg(F.count("*").alias("n"), F.countDistinct("y").alias("classes"))
    return n.select("n", "classes", ((F.col("n") >= 20) & (F.col("classes") == 2)).alias("trains"))


def m6_m9_fit(spark, data):
    """Metrics of boosted trees on the test part, at the threshold found on the training part."""
    train, test = _split(spark, data)
    model = L.MODELS["gbt"]().fit(train)
    t = L.one(ev.threshold_for_loss(L.scores(model, train), 0.02))["threshold"]
    m = L.measured(L.scores(model, test), threshold=t)
    return _table(spark, [(k, float(v) if v is not None else None) for k, v in m.items()], "metric string, value double")


def m5_cross_validation(spark, data):
    runs = L.cross_validated(dataset(spark, data), "logistic", 3)
    return _table(spark, L.mean_and_deviation(runs), "metric string, mean double, deviation double")


def m7_early_stopping(spark, data):
    """Trees of a boosted model that stops when its validation part no longer gains."""
    train, test = _split(spark, data)
    marked = train.withColumn("held_out", F.pmod(F.xxhash64("id"), F.lit(8)) == 0)
    model = L.MODELS["gbt"](maxIter=30, validationIndicatorCol="held_out", validationTol=0.01).fit(marked)
    return _table(spark, [(model.getNumTrees, float(L.one(ev.roc_auc(L.scores(model, test)))["roc_auc"]))], "trees int, roc_auc double")


def m10_importances(spark, data):
    train, _ = _split(spark, data)
    model = L.MODELS["forest"]().fit(train)
    return _table(spark, L.importances(model, NAMES)[:10], "feature string, importance double")


def m11_m30_calibrated(spark, data):
    """Brier score and log-loss on the test part (20 %) of raw, logistic, isotonic and tempered scores, fitted on 70 % and calibrated on 10 %."""
    r = Written(L.stratified_split(dataset(spark, data), "id", "y", {"train": 0.7, "val": 0.1, "test": 0.2}), "split").df
    part = lambda name: r.filter(F.col("split") == name).drop("split")
    model = L.MODELS["forest"]().fit(part("train"))
    base, s = Written(L.scores(model, part("val")), "scored").df, Written(L.scores(model, part("test")), "scored").df
    slope, offset = L.platt(base)
    kinds = {"raw": s, "platt": s.withColumn("p", L.with_platt(F.col("p"), slope, offset)), "isotonic": L.with_isotonic(base, s),
             "temperature": s.withColumn("p", L.with_temperature(F.col("p"), L.best_temperature(base)))}
    out = []
    for k, df in kinds.items():
        m = {**L.one(ev.brier_and_log_loss(df)), **L.one(ev.expected_calibration_error(df))}
        out.append((k, float(m["brier"]), float(m["log_loss"]), float(m["ece"])))
    return _table(spark, out, "kind string, brier double, log_loss double, ece double")


def m12_predictions(spark, data):
    """Every item, labelled or not, with its probability by a model of the labelled ones; NaN where there is no vector to go by."""
    known, everything = _scaled(spark, data)
    model = L.MODELS["logistic"]().fit(known)
    p = L.scores(model, everything.filter("known").withColumn("y", F.lit(None).cast("int"))).select("id", F.round("p", 6).alias("p"))
    return p.unionByName(everything.filter("not known").select("id", F.lit(float("nan")).alias("p")))


def m16_random_search(spark, data):
    points = L.random_choices({"regParam": [0.001, 0.01, 0.1], "elasticNetParam": [0.0, 0.5]}, 3)
    found = L.search(dataset(spark, data), "logistic", points, k=2)
    return _table(spark, [(p["regParam"], p["elasticNetParam"], s) for p, s in found], "reg double, elastic double, roc_auc double")


def m18_sweep(spark, data):
    found = L.search(dataset(spark, data), "logistic", L.grid({"regParam": [0.001, 0.05]}), k=2)
    return _table(spark, [(p["regParam"], s) for p, s in found], "reg double, roc_auc double")


def m19_coordinate_search(spark, data):
    best, score = L.coordinate_search(dataset(spark, data), "logistic", {"regParam": [0.01, 0.1], "maxIter": [10, 40]}, {"regParam": 0.01, "maxIter": 40})
    return _table(spark, [(best["regParam"], best["maxIter"], score)], "reg double, max_iter int, roc_auc double")


def _two_scorings(spark, data):
    train, test = _split(spark, data)
    models = [L.MODELS["logistic"]().fit(train), L.MODELS["forest"]().fit(train)]
    return [Written(L.scores(m, train), "scored").df for m in models], [Written(L.scores(m, test), "scored").df for m in models]


def m20_ensembles(spark, data):
    """Area under the curve of two models, their blend and their stack on the test part."""
    train, test = _two_scorings(spark, data)
    weights, _ = L.blended(train)
    mixed = test[0].select("id", "y", F.col("p").alias("a")).join(test[1].select("id", F.col("p").alias("b")), "id").select("y", (F.col("a") * weights[0] + F.col("b") * weights[1]).alias("p"))
    kinds = {"logistic": test[0], "forest": test[1], "blend": mixed, "stack": L.stacked(train, test)}
    return _table(spark, [(k, float(L.one(ev.roc_auc(df))["roc_auc"])) for k, df in kinds.items()], "kind string, roc_auc double")


def m21_algorithms(spark, data):
    train, test = _split(spark, data)
    params = {"network": {"layers": [len(NAMES), 8, 2]}, "gbt": {"maxIter": 8}}
    out = []
    for kind in L.MODELS:
        m = L.measured(Written(L.scores(L.MODELS[kind](**params.get(kind, {})).fit(train), test), "scored").df, threshold=0.5)
        out.append((kind, float(m["accuracy"]), float(m["roc_auc"])))
    return _table(spark, out, "kind string, accuracy double, roc_auc double")


def m23_permuted_importance(spark, data):
    """What the area under the curve loses for each feature that is shuffled."""
    train, test = _split(spark, data)
    model = L.MODELS["logistic"]().fit(train)
    return _table(spark, [(n, float(v)) for n, v in L.permuted_importance(model, test, NAMES)], "feature string, loss double")


def m25_ablation(spark, data):
    """What leaving out a group of features does to the area under the curve."""
    train, test = _split(spark, data)
    groups = {"none": set(), "colour": set(range(0, 6)), "brightness": {6, 7}, "histogram": set(range(9, 33)), "rating": {33}}
    out = []
    for name, drop in groups.items():
        model = L.MODELS["logistic"]().fit(L.without(train, drop, len(NAMES)))
        out.append((name, float(L.one(ev.roc_auc(L.scores(model, L.without(test, drop, len(NAMES)))))["roc_auc"])))
    return _table(spark, out, "left_out string, roc_auc double")


def m17_parzen_search(spark, data):
    """Points suggested by Parzen estimators, with their areas under the curve, best first."""
    d = Written(dataset(spark, data), "dataset").df
    space = {"regParam": (1e-4, 1.0, "log"), "elasticNetParam": (0.0, 1.0), "maxIter": (10, 50)}
    score = lambda p: np.mean([r["roc_auc"] for r in L.cross_validated(d, "logistic", 2, **p)])
    found = L.tpe_search(space, score, trials=8)
    return _table(spark, [(p["regParam"], p["elasticNetParam"], p["maxIter"], s) for p, s in found], "reg double, elastic double, max_iter int, roc_auc double")


def m22_adasyn(spark, data):
    made = L.adasyn(dataset(spark, data), "id", "y", 0)
    return made.select("y", F.round(F.aggregate("features", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.size("features").alias("width"))


def m23_mutual_information(spark, data):
    """Bits that each feature, in ten parts, tells of the label."""
    rows = _labelled(spark, data).select("id", "y").join(_features(spark, data).withColumnRenamed("item_id", "id"), "id")
    return L.mutual_information(Written(rows, "features").df, [*STATS, *BINS], "y").select("feature", F.round("bits", 6).alias("bits"))


def m23_recursive_elimination(spark, data):
    """Rank of each feature when the least important goes one at a time until 30 are left."""
    return _table(spark, L.eliminated_ranks(dataset(spark, data), NAMES, 30), "feature string, rank int")


def m36_improvements(spark, data):
    """Metrics of a plain model, a regularised one, and one with products of features, on the same test part."""
    train, test = _split(spark, data)
    more = lambda d: PolynomialExpansion(degree=2, inputCol="f", outputCol="features").transform(d.withColumnRenamed("features", "f")).drop("f")
    few = lambda d: L.without(d, set(range(9, len(NAMES))), len(NAMES))
    kinds = (("plain", {"regParam": 0.0}, train, test), ("regularised", {"regParam": 0.1}, train, test), ("few", {"regParam": 0.1}, few(train), few(test)), ("few with products", {"regParam": 0.1}, more(few(train)), more(few(test))))
    out = []
    for name, params, a, b in kinds:
        m = L.measured(Written(L.scores(L.MODELS["logistic"](**params).fit(a), b), "scored").df, threshold=0.5)
        out.append((name, float(m["accuracy"]), float(m["roc_auc"])))
    return _table(spark, out, "kind string, accuracy double, roc_auc double")


def m37_one_dimension(spark, data):
    """Each parameter of boosted trees by itself, the others at their defaults: score of each value on the test part."""
    train, test = _split(spark, data)
    out = []
    for name, values in (("stepSize", [0.05, 0.1, 0.2]), ("maxIter", [5, 10, 20]), ("maxDepth", [2, 4])):
        for v in values:
            m = L.measured(Written(L.scores(L.MODELS["gbt"](**{"maxIter": 8, name: v}).fit(train), test), "scored").df, threshold=0.5)
            out.append((name, float(v), float(m["accuracy"]), float(m["roc_auc"])))
    return _table(spark, out, "parameter string, value double, accuracy double, roc_auc double")


def m38_tuned(spark, data):
    """The best point of a sweep, the model of all rows made with it, stored and read again: its metadata."""
    path = f"{shared_folder(spark)}/model-{uuid.uuid4().hex[:12]}"
    best, score = L.tuned_and_retrained(dataset(spark, data), "logistic", L.grid({"regParam": [0.001, 0.05]}), NAMES, path)
    _, meta = L.load_model(LogisticRegressionModel, path, spark)
    return _table(spark, [(best["regParam"], score, meta["feature_count"], meta["n_samples"], meta["mode"])], "reg double, roc_auc double, features int, rows bigint, kind string")


def m25_leave_one_out(spark, data):
    """What each feature adds to the area under the curve: the model of all less that without it, on the test part."""
    train, test = _split(spark, data)

    def area(drop: set) -> float:
        model = L.MODELS["logistic"](maxIter=20).fit(L.without(train, drop, len(NAMES)))
        return float(L.one(ev.roc_auc(L.scores(model, L.without(test, drop, len(NAMES)))))["roc_auc"])

    whole = area(set())
    return _table(spark, [(n, whole - area({i})) for i, n in enumerate(NAMES)], "feature string, gain double")


def m29_benchmark(spark, data):
    """All metrics of a model and of another on the same test part, and by how much the second is better."""
    train, test = _split(spark, data)
    base, new = (L.measured(Written(L.scores(L.MODELS[k]().fit(train), test), "scored").df, threshold=0.5) for k in ("logistic", "forest"))
    worse = {"brier", "log_loss", "keep_loss", "junk_leak"}
    out = []
    for k in ("accuracy", "precision", "recall", "f1", "keep_loss", "junk_leak", "roc_auc", "pr_auc", "brier", "log_loss"):
        a, b = float(base[k]), float(new[k])
        out.append((k, a, b, ((a - b) if k in worse else (b - a)) / a * 100 if a > 0 else 0.0))
    return _table(spark, out, "metric string, baseline double, value double, improvement_pct double")


def m27_elimination(spark, data):
    found = L.eliminated(dataset(spark, data), NAMES)
    return _table(spark, found, "round int, features int, accuracy double")


def m26_m35_with_and_without(spark, data):
    """Per class of the dataset: metrics without and with its flag, and the differences.

    A class of less than one item in a hundred is not fitted: one row, insufficient_data.
    All classes share the split and the model without.
    """
    d = dataset(spark, data)
    seen = items(spark, data).select(F.col("item_id").alias("id"), F.coalesce(F.array_distinct(F.transform(F.filter("objects", lambda c: c.isNotNull()), F.lower)), F.array()).alias("classes"))
    both = Written(L.stratified_split(d.join(seen, "id"), "id", "y", {"train": 0.8, "test": 0.2}), "split").df
    total = both.agg(F.count("*").alias("total"))
    counts = both.select(F.explode("classes").alias("class")).groupBy("class").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total))
    counts = Written(counts.select("class", (F.col("n") / F.col("total") < 0.01).alias("rare")), "classes").df

    def fitted(rows: DataFrame) -> list[float]:
        model = L.MODELS["logistic"]().fit(rows.filter("split = 'train'"))
        m = L.measured(Written(L.scores(model, rows.filter("split = 'test'")), "scored").df, threshold=0.5)
        return [float(m[k]) for k in ("accuracy", "keep_loss", "roc_auc")]

    out, base = [], None
    for r in counts.filter("not rare").orderBy("class").collect():
        base = base or fitted(both)
        flagged = both.withColumn("flag", F.array_contains("classes", r["class"]).cast("double"))
        x = VectorAssembler(inputCols=["features", "flag"], outputCol="more").transform(flagged)
        more = fitted(x.select("id", "y", "split", F.col("more").alias("features")))
        out += [(r["class"], kind, *values) for kind, values in (("without", base), ("with", more), ("difference", [w - v for v, w in zip(base, more)]))]
    kind = "class string, kind string, accuracy double, keep_loss double, roc_auc double"
    none = F.lit(None).cast("double")
    rare = counts.filter("rare").select("class", F.lit("insufficient_data").alias("kind"), none.alias("accuracy"), none.alias("keep_loss"), none.alias("roc_auc"))
    return _table(spark, out, kind).unionByName(rare)


QUERIES = {f.__name__: f for f in (
    m2_gate, m3_split, m4_folds, m4_grouped_folds, m5_cross_validation, m6_m9_fit, m7_early_stopping, m10_importances, m11_m30_calibrated, m12_predictions,
    m16_random_search, m18_sweep, m19_coordinate_search, m20_ensembles, m21_algorithms, m22_undersampled, m22_weights, m22_oversampled,
    m25_leave_one_out, m29_benchmark, m17_parzen_search, m22_adasyn, m23_mutual_information, m23_recursive_elimination, m36_improvements, m37_one_dimension, m38_tuned, m23_permuted_importance, m25_ablation, m26_m35_with_and_without, m27_elimination,
)}

R = """with i as (select distinct on (item_id) * from image_items), l as (select item_id as id, album, case lower(trim(label)) when 'keep' then 1 when 'trash' then 0 end as y from i),
r as (select *, row_number() over (partition by y order by md5(id::varchar), id) - 1 as place, count(*) over (partition by y) as n from l where y is not null)"""
ORACLE = {
    "m2_gate": R + " select count(*) as n, count(distinct y) as classes, count(*) >= 20 and count(distinct y) = 2 as trains from r",
    "m3_split": R + " select id, case when place < round(0.7::double * n) then 'train' when place < round((0.7::double + 0.1::double) * n) then 'val' else 'test' end as split from r",
    "m4_folds": R + " select id, (place % 3)::int as fold from r",
    "m4_grouped_folds": R + """, g as (select album, count(*) as c from r where album is not null group by 1), d as (select album, row_number() over (order by c desc, album) - 1 as k from g)
select id, (case when (k // 5) % 2 = 1 then 4 - k % 5 else k % 5 end)::int as fold from r join d using (album)""",
    "m23_mutual_information": _ALL + ", w as materialized (select y, " + ", ".join([*STATS, *BINS]) + " from f join (select item_id, case lower(trim(label)) when 'keep' then 1 when 'trash' then 0 end as y from i) using (item_id) where y is not null), l as (" + " union all ".join(
        f"select '{c}' as feature, y, case when x is null then -1 when hi > lo then least(9, floor((x - lo) / (hi - lo) * 10)) else 0 end as part from (select y, x, min(x) over () as lo, max(x) over () as hi from (select y, case when isnan({c}) then null else {c}::double end as x from w))" for c in (*STATS, *BINS)
    ) + """), g as (select feature, part, y, count(*) as n from l group by all), t as (select feature, n, sum(n) over (partition by feature, part) as nx, sum(n) over (partition by feature, y) as ny, sum(n) over (partition by feature) as t from g)
select feature, round(sum(n / t * log2(n * t / (nx * ny))), 6) as bits from t group by feature""",
    "m22_undersampled": R + " select id, y from r where place < (select min(n) from r)",
    "m22_weights": R + " select id, round((select count(*) from r) / ((select count(distinct y) from r) * n), 6) as weight from r",
}
