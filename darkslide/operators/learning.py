"""Learning on labelled rows: splits, folds, models, thresholds, calibration, search.

Rows are (id, y, features vector). Splits and folds are taken by the order of the
id's hash within each class, so they are the same on every run and engine.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

import numpy as np
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from darkslide.operators import evaluation as ev
from darkslide.operators.sequence import dense_index
from darkslide.operators.shared import Written


def place_in_class(rows: DataFrame, item: str, y: str, seed: str = "") -> DataFrame:
    """``rows`` with place (from 0, by the id's hash) and n of their class; classes are few, rows many, so places come from sorted ranges."""
    key = F.md5(F.concat(F.lit(seed), F.col(item).cast("string")))
    counts = rows.groupBy(y).agg(F.count("*").alias("n"))
    before = counts.select(y, "n", F.coalesce(F.sum("n").over(Window.orderBy(y).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    ranked = dense_index(rows, [F.asc(y), key.asc(), F.asc(item)], "__at")
    return ranked.join(F.broadcast(before), y).withColumn("place", F.col("__at") - F.col("__b")).drop("__at", "__b")


def stratified_split(rows: DataFrame, item: str, y: str, shares: dict[str, float], seed: str = "") -> DataFrame:
    """``rows`` with split: of each class the given shares, to within one row."""
    r, at, upto = place_in_class(rows, item, y, seed), None, 0.0
    names = list(shares)
    for name in names[:-1]:
        upto += shares[name]
        hit = F.col("place") < F.round(F.lit(upto) * F.col("n"))
        at = F.when(hit, name) if at is None else at.when(hit, name)
    return r.withColumn("split", at.otherwise(names[-1]) if at is not None else F.lit(names[-1])).drop("place", "n")


def stratified_folds(rows: DataFrame, item: str, y: str, k: int, seed: str = "") -> DataFrame:
    return place_in_class(rows, item, y, seed).withColumn("fold", F.pmod("place", F.lit(k)).cast("int")).drop("place", "n")


def grouped_folds(rows: DataFrame, group: str, k: int) -> DataFrame:
    """``rows`` with fold, whole groups together: the groups in order of size are dealt out back and forth."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("n"))
    dealt = dense_index(sizes, [F.desc("n"), F.asc(group)], "at")
    turn, back = F.pmod("at", F.lit(k)), F.pmod(F.floor(F.col("at") / k), F.lit(2)) == 1
    return rows.join(dealt.select(group, F.when(back, k - 1 - turn).otherwise(turn).cast("int").alias("fold")), group)


def undersampled(rows: DataFrame, item: str, y: str) -> DataFrame:
    """As many rows of each class as of the rarest."""
    r = place_in_class(rows, item, y)
    least = rows.groupBy(y).agg(F.count("*").alias("c")).agg(F.min("c").alias("least"))
    return r.crossJoin(F.broadcast(least)).filter("place < least").drop("place", "n", "least")


def class_weights(rows: DataFrame, y: str) -> DataFrame:
    """``rows`` with weight: each class as a whole weighs the same."""
    n = rows.groupBy(y).agg(F.count("*").alias("c"))
    total = n.agg(F.sum("c").alias("t"), F.count("*").alias("k"))
    w = n.crossJoin(F.broadcast(total)).select(y, (F.col("t") / (F.col("k") * F.col("c"))).alias("weight"))
    return rows.join(F.broadcast(w), y)


def oversampled(rows: DataFrame, item: str, y: str, rare: int, k: int = 5, factor: float = 1.0, neighbours: Callable | None = None) -> DataFrame:
    """Made-up rows (features array) between a rare row and one of its near rows, ``factor`` times the rare ones.

    ``neighbours`` gives (item, neighbours) of (item, features array); the default
    compares blocks of the rare class.
    """
    few = rows.filter(F.col(y) == rare).select(F.col(item).alias("a"), vector_to_array("features").alias("x"))
    near = (neighbours or _near_in_blocks)(few, k)
    pairs = near.select("a", F.explode("near").alias("b")).withColumn("u", F.pmod(F.xxhash64("a", "b"), F.lit(1000)) / 1000)
    pairs = pairs.filter(F.pmod(F.xxhash64("b", "a"), F.lit(1000)) < factor * 1000 / k)
    j = pairs.join(few, "a").join(few.select(F.col("a").alias("b"), F.col("x").alias("z")), "b")
    return j.select(F.zip_with("x", "z", lambda p, q: p + F.col("u") * (q - p)).alias("features"), F.lit(rare).alias(y))


def adasyn(rows: DataFrame, item: str, y: str, rare: int, k: int = 5, factor: float = 1.0) -> DataFrame:
    """As ``oversampled``, but more rows are made from rare rows with many others among their ``k`` nearest.

    A rare row gets its share of ``factor`` times the rare rows, by the share of other
    classes around it, rounded; where no rare row has others around it none is made.
    """
    everything = rows.select(F.col(item).alias("a"), vector_to_array("features").alias("x"), F.col(y).alias("c"))
    few = everything.filter(F.col("c") == rare).select("a", "x")
    around = _near_in_blocks(few, k, everything.select("a", "x")).select("a", F.explode("near").alias("b"))
    hard = around.join(everything.select(F.col("a").alias("b"), "c"), "b").groupBy("a").agg(F.avg((F.col("c") != rare).cast("double")).alias("r"))
    total = hard.agg(F.sum("r").alias("total"), F.count("*").alias("n"))
    wanted = hard.crossJoin(F.broadcast(total)).select("a", F.when(F.col("total") > 0, F.round(F.col("r") / F.col("total") * F.col("n") * factor)).otherwise(0).cast("int").alias("m"))
    near = _near_in_blocks(few, k).join(wanted.filter("m > 0"), "a").select("a", "near", F.explode(F.sequence(F.lit(1), F.col("m"))).alias("i"))
    pick = F.pmod(F.xxhash64("a", "i"), F.size("near")).cast("int")
    pairs = near.filter(F.size("near") > 0).select("a", "i", F.col("near")[pick].alias("b"), (F.pmod(F.xxhash64("i", "a"), F.lit(1000)) / 1000).alias("u"))
    j = pairs.join(few, "a").join(few.select(F.col("a").alias("b"), F.col("x").alias("z")), "b")
    return j.select(F.zip_with("x", "z", lambda p, q: p + F.col("u") * (q - p)).alias("features"), F.lit(rare).alias(y))


def _near_in_blocks(few: DataFrame, k: int, among: DataFrame | None = None, block: int = 5000) -> DataFrame:
    """(a, near): of each row (a, x) of ``few`` the ids of the ``k`` nearest others, among ``few`` or ``among``."""
    other = few if among is None else among
    n, m = (max(1, -(-d.count() // block)) for d in (few, other))
    part = lambda c, parts: F.pmod(F.xxhash64(c), F.lit(parts))
    left = few.withColumn("p", part("a", n)).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    right = other.select(F.col("a").alias("a2"), F.col("x").alias("x2")).withColumn("q", part("a2", m)).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    def run(a, b):
        import pandas as pd

        if not len(a) or not len(b):
            return pd.DataFrame({"a": [], "b": [], "d": []}).astype({"a": "int64", "b": "int64", "d": "float64"})
        x, z = np.stack(a["x"].to_list()), np.stack(b["x2"].to_list())
        ids, others = a["a"].to_numpy(), b["a2"].to_numpy()
        d = (x**2).sum(1)[:, None] + (z**2).sum(1)[None, :] - 2 * x @ z.T
        d[ids[:, None] == others[None, :]] = np.inf
        top = np.argsort(d, axis=1, kind="stable")[:, :k]
        got = np.take_along_axis(d, top, 1).ravel()
        out = pd.DataFrame({"a": np.repeat(ids, top.shape[1]), "b": others[top].ravel(), "d": got})
        return out[np.isfinite(got)]

    met = left.groupBy("p", "q").cogroup(right.groupBy("p", "q")).applyInPandas(run, "a bigint, b bigint, d double")
    best = met.groupBy("a").agg(F.slice(F.sort_array(F.collect_list(F.struct("d", "b"))), 1, k).alias("l"))
    return best.select("a", F.col("l.b").alias("near"))


#: Kinds of models by name; each takes its parameters by keyword.
MODELS = {
    "gbt": lambda **p: GBTClassifier(labelCol="y", seed=42, **{"maxIter": 20, "maxDepth": 4, "stepSize": 0.1, **p}),
    "forest": lambda **p: RandomForestClassifier(labelCol="y", seed=42, **{"numTrees": 30, "maxDepth": 6, **p}),
    "logistic": lambda **p: LogisticRegression(labelCol="y", **{"maxIter": 50, "regParam": 0.01, **p}),
    "network": lambda **p: MultilayerPerceptronClassifier(labelCol="y", seed=42, **{"maxIter": 50, **p}),
}


def scores(model: Model, rows: DataFrame) -> DataFrame:
    """(id, y, p): p is the probability of class 1."""
    return model.transform(rows).select("id", "y", vector_to_array("probability")[1].alias("p"))


def one(df: DataFrame) -> dict:
    return df.first().asDict()


def measured(scored: DataFrame, max_loss: float = 0.02, threshold: float | None = None) -> dict:
    """Metrics of (y, p), at the threshold given or found for ``max_loss``."""
    t = one(ev.threshold_for_loss(scored, max_loss))["threshold"] if threshold is None else threshold
    m = one(ev.asymmetric(ev.confusion(scored, t)))
    return {**m, **one(ev.roc_auc(scored)), **one(ev.pr_auc(scored)), **one(ev.brier_and_log_loss(scored)), "threshold": t}


def cross_validated(rows: DataFrame, kind: str, k: int = 3, max_loss: float = 0.02, **params) -> list[dict]:
    """Metrics of each fold; the threshold is found on the training part of the fold."""
    r = Written(stratified_folds(rows, "id", "y", k), "folds").df
    out = []
    for fold in range(k):
        train, test = r.filter(F.col("fold") != fold), r.filter(F.col("fold") == fold)
        model = MODELS[kind](**params).fit(train)
        t = one(ev.threshold_for_loss(scores(model, train), max_loss))["threshold"]
        out.append({"fold": fold, **measured(Written(scores(model, test), "scored").df, threshold=t)})
    return out


def mean_and_deviation(runs: list[dict], names: tuple[str, ...] = ("accuracy", "keep_loss", "junk_leak", "roc_auc", "pr_auc", "f1")) -> list[tuple[str, float, float]]:
    values = {n: np.array([r[n] for r in runs if r[n] is not None], dtype=float) for n in names}
    return [(n, float(v.mean()) if len(v) else float("nan"), float(v.std()) if len(v) else float("nan")) for n, v in values.items()]


def grid(values: dict[str, list]) -> list[dict]:
    return [dict(zip(values, v)) for v in product(*values.values())]


def random_choices(values: dict[str, list], n: int, seed: int = 42) -> list[dict]:
    """``n`` different points of the grid, or all if it has fewer."""
    all_points = grid(values)
    order = np.random.default_rng(seed).permutation(len(all_points))[:n]
    return [all_points[i] for i in order]


def search(rows: DataFrame, kind: str, points: list[dict], k: int = 3, by: str = "roc_auc") -> list[tuple[dict, float]]:
    """Points with their mean score over the folds, best first."""
    done = [(p, float(np.mean([r[by] for r in cross_validated(rows, kind, k, **p)]))) for p in points]
    return sorted(done, key=lambda x: -x[1])


def coordinate_search(rows: DataFrame, kind: str, values: dict[str, list], start: dict, k: int = 2, by: str = "roc_auc") -> tuple[dict, float]:
    """Each parameter in turn set to its best value while the others stay."""
    best = dict(start)
    score = float("-inf")
    for name, options in values.items():
        ranked = search(rows, kind, [{**best, name: o} for o in options], k, by)
        if ranked[0][1] > score:
            best, score = ranked[0]
    return best, score


def adjusted_trees(rows: int, trees: int) -> int:
    """At most 60 trees for ten rows or fewer."""
    return min(trees, 60) if rows <= 10 else trees


def adjusted_leaf(rare: int, least: int) -> int:
    """Rows that a leaf needs, less for fewer than 30 rows of the rare class, so that trees can be cut at all."""
    return min(least, max(1, min(2, rare // 5))) if least > 1 and rare < 30 else least


def suggest(space: dict[str, tuple | list], done: list[tuple[dict, float]], rng: np.random.Generator, startup: int = 5, good: float = 0.25, tries: int = 24) -> dict:
    """The next point to try, by tree-structured Parzen estimators.

    ``space``: a list of options, or (low, high) or (low, high, "log"), of whole numbers if
    both are. ``done``: points with their scores, the higher the better. After ``startup``
    random points each parameter is drawn from the density of the best share of the points
    where that is highest against the density of the others.
    """
    ranked = sorted(done, key=lambda d: -d[1])
    n = max(1, int(np.ceil(good * len(ranked))))
    best, rest = [p for p, _ in ranked[:n]], [p for p, _ in ranked[n:]]
    point = {}
    for name, s in space.items():
        if isinstance(s, list):
            share = lambda some, o: (sum(p[name] == o for p in some) + 1) / (len(some) + len(s))
            weights = np.array([share(best, o) / share(rest, o) if len(done) >= startup else 1.0 for o in s])
            point[name] = s[int(rng.choice(len(s), p=weights / weights.sum()))]
            continue
        log, whole = len(s) > 2, isinstance(s[0], int) and isinstance(s[1], int)
        to, back = (np.log, np.exp) if log else (np.asarray, np.asarray)
        lo, hi = float(to(s[0])), float(to(s[1]))
        if len(done) < startup:
            x = rng.uniform(lo, hi)
        else:
            width = lambda some: max((hi - lo) / (1 + len(some)), (hi - lo) / 25)
            a, b = (np.array([float(to(p[name])) for p in some]) for some in (best, rest))

            def density(x: np.ndarray, at: np.ndarray, w: float) -> np.ndarray:
                kernels = np.exp(-(((x[:, None] - at[None, :]) / w) ** 2) / 2) / w if len(at) else np.zeros((len(x), 0))
                return (kernels.sum(axis=1) + 1 / (hi - lo)) / (len(at) + 1)

            options = np.clip(np.r_[rng.choice(a, tries) + rng.normal(0, width(a), tries), rng.uniform(lo, hi, 1)], lo, hi)
            x = options[np.argmax(density(options, a, width(a)) / density(options, b, width(b)))]
        point[name] = int(round(float(back(x)))) if whole else float(back(x))
    return point


def tpe_search(space: dict, score: Callable[[dict], float], trials: int, seed: int = 42) -> list[tuple[dict, float]]:
    """Points with their scores, best first, each suggested by those before it."""
    rng, done = np.random.default_rng(seed), []
    for _ in range(trials):
        point = suggest(space, done, rng)
        done.append((point, float(score(point))))
    return sorted(done, key=lambda d: -d[1])


def mutual_information(rows: DataFrame, columns: list[str], y: str, parts: int = 10) -> DataFrame:
    """(feature, bits): what each column, cut into ``parts`` of equal width, tells of ``y``; null and NaN are a part of their own."""
    clean = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns}
    span = rows.agg(*[f(clean[c]).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    wide = rows.crossJoin(F.broadcast(span))

    def part(c: str) -> Column:
        lo, hi = F.col(f"lo_{c}"), F.col(f"hi_{c}")
        at = F.when(hi > lo, F.least(F.lit(parts - 1), F.floor((clean[c] - lo) / (hi - lo) * parts))).otherwise(0)
        return F.when(clean[c].isNull(), -1).otherwise(at).cast("int")

    long = wide.select(F.col(y).alias("y"), F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), part(c).alias("part")) for c in columns])).alias("f")).select("y", "f.*")
    joint = long.groupBy("feature", "part", "y").agg(F.count("*").alias("n"))
    x, k, f = Window.partitionBy("feature", "part"), Window.partitionBy("feature", "y"), Window.partitionBy("feature")
    told = joint.select("feature", "n", F.sum("n").over(x).alias("nx"), F.sum("n").over(k).alias("ny"), F.sum("n").over(f).alias("t"))  # at most parts x classes rows a feature
    return told.groupBy("feature").agg(F.sum(F.col("n") / F.col("t") * F.log2(F.col("n") * F.col("t") / (F.col("nx") * F.col("ny")))).alias("bits"))


def eliminated_ranks(rows: DataFrame, names: list[str], keep: int, kind: str = "forest") -> list[tuple[str, int]]:
    """Recursive elimination of one feature at a time: rank 1 for the ``keep`` that stay, higher the earlier a feature went."""
    left, ranks = list(range(len(names))), {}
    held = Written(rows, "rows").df
    while len(left) > keep:
        weight = MODELS[kind]().fit(without(held, set(range(len(names))) - set(left), len(names))).featureImportances.toArray()
        out = left.pop(int(np.argmin(weight)))
        ranks[out] = len(left) - keep + 2
    return [(n, ranks.get(i, 1)) for i, n in enumerate(names)]


def tuned_and_retrained(rows: DataFrame, kind: str, points: list[dict], names: list[str], path: str, k: int = 2) -> tuple[dict, float]:
    """The best point by cross-validation, and a model of all rows made with it, stored with its metadata.

    ValueError if the model has learnt nothing; what is stored then stays as it was.
    """
    best, score = search(rows, kind, points, k)[0]
    model = MODELS[kind](**best).fit(rows)
    if hasattr(model, "featureImportances") and not healthy(model):
        raise ValueError("the model has learnt nothing")
    save_model(model, path, {**metadata(best, names, rows.count(), kind), "score": score})
    return best, score


def platt(scored: DataFrame) -> tuple[float, float]:
    """Slope and offset of the logistic curve that turns scores into probabilities."""
    from pyspark.ml.feature import VectorAssembler

    x = VectorAssembler(inputCols=["p"], outputCol="features").transform(scored.select("y", "p"))
    m = LogisticRegression(labelCol="y", maxIter=50).fit(x)
    return float(m.coefficients[0]), float(m.intercept)


def with_platt(p: Column, slope: float, offset: float) -> Column:
    return 1 / (1 + F.exp(-(p * slope + offset)))


def with_isotonic(scored: DataFrame, target: DataFrame) -> DataFrame:
    """``target`` with p replaced by the best rising step curve of ``scored``."""
    model = IsotonicRegression(labelCol="y", featuresCol="p", predictionCol="q").fit(scored.select(F.col("y").cast("double"), "p"))
    return model.transform(target).drop("p").withColumnRenamed("q", "p")


def with_temperature(p: Column, t: float) -> Column:
    return F.pow(p, 1 / t)


def best_temperature(scored: DataFrame, options: tuple[float, ...] = (0.1, 0.2, 0.35, 0.5, 0.7, 0.85, 1.0, 1.25, 1.5, 2.0, 3.0, 5.0, 10.0)) -> float:
    """The power of the scores with the least log-loss, of options from 0.1 to 10, in one pass."""
    def loss(t: float) -> Column:
        q = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), with_temperature(F.col("p"), t)))
        return F.avg(-(F.col("y") * F.ln(q) + (1 - F.col("y")) * F.ln(1 - q)))

    found = scored.agg(*[loss(t).alias(f"t{i}") for i, t in enumerate(options)]).first()
    return options[int(np.argmin([v if v is not None else np.inf for v in found]))]


def blended(parts: list[DataFrame], steps: int = 12, rate: float = 2.0) -> tuple[list[float], DataFrame]:
    """Weights, none negative and of sum one, of the mixture of scorings (id, y, p) with the least log-loss, and the mixture.

    Exponentiated gradient steps on the driver, each with one pass that adds up loss and
    gradient; the best weights of all steps count.
    """
    j = parts[0].select("id", "y", F.col("p").alias("p0"))
    for i, part in enumerate(parts[1:], 1):
        j = j.join(part.select("id", F.col("p").alias(f"p{i}")), "id")
    j = Written(j, "blended").df
    mix = lambda w: sum((F.col(f"p{i}") * float(x) for i, x in enumerate(w)), F.lit(0.0))
    w, best = np.full(len(parts), 1 / len(parts)), (np.inf, None)
    for _ in range(steps):
        q = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), mix(w)))
        slope = (1 - F.col("y")) / (1 - q) - F.col("y") / q
        found = j.agg(F.avg(-(F.col("y") * F.ln(q) + (1 - F.col("y")) * F.ln(1 - q))).alias("loss"), *[F.avg(slope * F.col(f"p{i}")).alias(f"g{i}") for i in range(len(parts))]).first()
        if found["loss"] is None:  # no rows
            best = (0.0, w)
            break
        if found["loss"] < best[0]:
            best = (found["loss"], w)
        g = np.array([found[f"g{i}"] for i in range(len(parts))])
        w = w * np.exp(-rate * (g - g.min()))
        w = w / w.sum()
    return list(map(float, best[1])), j.select("id", "y", mix(best[1]).alias("p"))


def stacked(train: list[DataFrame], test: list[DataFrame]) -> DataFrame:
    """A logistic regression over the scores of several models."""
    from pyspark.ml.feature import VectorAssembler

    def wide(parts: list[DataFrame]) -> DataFrame:
        j = parts[0].select("id", "y", F.col("p").alias("p0"))
        for i, part in enumerate(parts[1:], 1):
            j = j.join(part.select("id", F.col("p").alias(f"p{i}")), "id")
        return VectorAssembler(inputCols=[f"p{i}" for i in range(len(parts))], outputCol="features").transform(j)

    return scores(MODELS["logistic"](regParam=0.0).fit(wide(train)), wide(test))


def without(rows: DataFrame, left_out: set[int], width: int) -> DataFrame:
    keep = [i for i in range(width) if i not in left_out]
    sliced = VectorSlicer(inputCol="features", outputCol="__f", indices=keep).transform(rows)
    return sliced.drop("features").withColumnRenamed("__f", "features")


def importances(model: Model, names: list[str]) -> list[tuple[str, float]]:
    found = model.featureImportances.toArray()
    return sorted(zip(names, map(float, found)), key=lambda x: (-x[1], x[0]))


def healthy(model: Model) -> bool:
    """A model whose importances are all zero has learnt nothing."""
    return float(np.sum(model.featureImportances.toArray())) > 0


def permuted_importance(model: Model, rows: DataFrame, names: list[str]) -> list[tuple[str, float]]:
    """What the area under the curve loses when a feature's values change places, by the rows' hash order.

    ``names`` are those of the features from the first on. The rows with each feature
    moved in turn are scored in one pass.
    """
    base = one(ev.roc_auc(scores(model, rows)))["roc_auc"]
    wide = rows.select("id", "y", vector_to_array("features").alias("a"))
    from pyspark.ml.functions import array_to_vector

    order = dense_index(wide, [F.md5(F.col("id").cast("string")).asc(), F.asc("id")], "at")
    n = order.count()
    order = Written(order, "order").df
    moved = order.select(F.pmod(F.col("at") + n // 2, F.lit(n)).alias("at"), F.col("a").alias("m"))
    new = order.join(moved, "at").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))))
    new = new.withColumn("b", F.transform("a", lambda x, k: F.when(k == F.col("i"), F.col("m")[k]).otherwise(x)))
    p = model.transform(new.select("i", "y", array_to_vector("b").alias("features"))).select("i", "y", vector_to_array("probability")[1].alias("p"))
    out = [(names[r["i"]], base - r["roc_auc"]) for r in ev.roc_auc_by(p, "i").collect()]
    return sorted(out, key=lambda x: (-x[1], x[0]))


def eliminated(rows: DataFrame, names: list[str], floor: int = 5, share: float = 0.05, tolerate: float = 0.01, kind: str = "forest", rounds: int = 50) -> list[tuple[int, int, float]]:
    """Backward elimination: (round, features left, accuracy), dropping the least important while accuracy falls by no more than ``tolerate``."""
    parts = Written(stratified_split(rows, "id", "y", {"train": 0.8, "test": 0.2}), "split").df
    train, test = parts.filter("split = 'train'"), parts.filter("split = 'test'")
    left, out, best = list(range(len(names))), [], None
    for r in range(rounds):
        use = lambda df: without(df, set(range(len(names))) - set(left), len(names))
        model = MODELS[kind]().fit(use(train))
        accuracy = one(ev.asymmetric(ev.confusion(scores(model, use(test)), 0.5)))["accuracy"]
        if best is not None and accuracy < best - tolerate:
            break
        best = max(best or 0.0, accuracy)
        out.append((r, len(left), float(accuracy)))
        if len(left) <= floor:
            break
        weight = model.featureImportances.toArray()
        drop = max(1, min(int(len(left) * share), len(left) - floor))
        left = sorted(left[i] for i in np.argsort(-weight, kind="stable")[: len(left) - drop])
    return out


def metadata(params: dict, names: list[str], rows: int, mode: str) -> dict:
    """What a model was made from, with a short hash of its parameters by which another is told apart."""
    import hashlib
    import json

    kept = {k: v for k, v in params.items() if k not in ("random_state", "n_jobs", "verbose")}
    digest = lambda x: hashlib.sha256(json.dumps(x, sort_keys=True).encode()).hexdigest()[:16]
    return {"feature_count": len(names), "mode": mode, "params": digest(kept), "features": digest(names), "n_samples": rows}


def mismatches(a: dict, b: dict) -> list[str]:
    """Entries in which two models' metadata differ, but for the number of rows."""
    return sorted(k for k in a.keys() | b.keys() if k != "n_samples" and a.get(k) != b.get(k))


def save_model(model: Model, path: str, meta: dict) -> None:
    import json

    from pyspark.sql import SparkSession

    model.write().overwrite().save(f"{path}/model")
    session = SparkSession.getActiveSession()
    session.createDataFrame([(json.dumps(meta, sort_keys=True),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_model(kind, path: str, spark) -> tuple[Model, dict]:
    """``kind``: the model's class, such as GBTClassificationModel."""
    import json

    return kind.load(f"{path}/model"), json.loads(spark.read.text(f"{path}/meta").first()[0])
