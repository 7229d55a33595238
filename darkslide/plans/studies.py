"""Queries of the studies, and of pictures made from vectors."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from darkslide.functions import pixels
from darkslide.operators import study as s
from darkslide.operators.shared import Written, spread
from darkslide.plans.grouping import items
from darkslide.sources.stores import votes
from darkslide.sources.tables import table

STATS = ["mean_r", "mean_g", "mean_b", "std_r", "std_g", "std_b", "mean_brightness", "std_brightness", "aspect"]


def _stats(spark, data):
    return table(spark, data, "preprocess_results").dropDuplicates(["item_id"]).select("item_id", *STATS)


#: Bins of all vectors together: a vector of 48 values has two for each of the 24.
BINS = [f"h{i}" for i in range(24)]


def bins(vector="hist_feat"):
    """24 columns of a vector of 24 or 48 values, nulls and NaN as 0; null for other lengths."""
    v = F.col(vector)
    at = lambda i: F.coalesce(F.nanvl(F.try_element_at(v, F.lit(i + 1)).cast("double"), F.lit(0.0)), F.lit(0.0))
    return [F.when(F.size(v) == 48, at(2 * i) + at(2 * i + 1)).when(F.size(v) == 24, at(i)).alias(n) for i, n in enumerate(BINS)]


def _features(spark, data):
    v = table(spark, data, "preprocess_results").dropDuplicates(["item_id"]).filter("size(hist_feat) in (24, 48)")
    return v.select("item_id", *STATS, *bins())


def m24_correlations(spark, data):
    return s.correlations(_stats(spark, data), STATS).select("a", "b", F.round("r", 6).alias("r"))


def m24_redundant(spark, data):
    """Pairs of all features, and whether the two tell nearly the same."""
    v = Written(_features(spark, data), "features").df
    return s.correlation_matrix(v, [*STATS, *BINS]).select("a", "b", F.round("r", 6).alias("r"), (F.abs("r") > 0.95).alias("redundant"))


def m24_target(spark, data):
    y = F.when(F.lower(F.trim("label")) == "keep", 1.0).when(F.lower(F.trim("label")) == "trash", 0.0)
    lab = items(spark, data).select("item_id", y.alias("y")).filter("y is not null")
    return s.target_correlations(_stats(spark, data).join(lab, "item_id"), STATS, "y").select("feature", F.round("r", 6).alias("r")).orderBy(F.desc(F.abs("r")), "feature").limit(30)


def a28_variances(spark, data):
    """The fifteen features that vary most, with their rank."""
    v = s.variances(_features(spark, data), [*STATS, *BINS])
    top = F.row_number().over(Window.orderBy(F.desc("variance"), "feature"))  # one row a feature
    return v.withColumn("rank", top).filter("rank <= 15").select("feature", F.round("variance", 4).alias("variance"), "rank")


def x22_pairs(spark, data):
    """Which products and quotients of features are made: of the fifteen that vary most, at most 100 and 20."""
    ranked = [r.feature for r in a28_variances(spark, data).orderBy("rank").collect()]
    products, quotients = s.interaction_pairs(ranked)
    return spark.createDataFrame([(k, a, b) for k, pairs in (("product", products), ("quotient", quotients)) for a, b in pairs], "kind string, a string, b string")


def x23_names(spark, data):
    """Names of the features by index, those of products, quotients and embedding components after the plain ones."""
    products, quotients = s.interaction_pairs(STATS)
    names = s.feature_names([*STATS, *BINS], products, quotients, embedding=64)
    return spark.createDataFrame(list(enumerate(names)), "at int, name string")


def x24_stats_text(spark, data):
    """A line of text for each feature: its mean, deviation and range."""
    v = _stats(spark, data)
    one = v.agg(*[f(c).alias(f"{c}_{n}") for c in STATS for n, f in (("m", F.avg), ("d", F.stddev_pop), ("lo", F.min), ("hi", F.max))])
    line = lambda c: F.struct(F.lit(c).alias("feature"), F.format_string(f"{c}: mean %.3f, deviation %.3f, from %.3f to %.3f", *[F.col(f"{c}_{n}") for n in ("m", "d", "lo", "hi")]).alias("line"))
    return one.select(F.explode(F.array(*[line(c) for c in STATS])).alias("r")).select("r.*")


def x21_x22_interactions(spark, data):
    made = s.interactions(["mean_r", "std_r", "aspect"])
    return _stats(spark, data).select("item_id", *made).select("item_id", *[F.round(c, 6).alias(c) for c in ("mean_r_x_std_r", "mean_r_x_aspect", "std_r_over_aspect")])


def o6_cosine_top(spark, data):
    e = table(spark, data, "embeddings")
    return s.cosine_top(e, "vec_id", "embedding", 7, 10).select("vec_id", F.round("similarity", 5).alias("similarity"))


def j13_cosine_matrix(spark, data):
    """Cosines of a bounded set of query vectors (ids divisible by 100) with all vectors."""
    e = table(spark, data, "embeddings").select("vec_id", "embedding")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return e.crossJoin(F.broadcast(q)).select("query_id", "vec_id", F.round(s.cosine(F.col("embedding"), F.col("q")), 5).alias("similarity"))


def o7_extremes(spark, data):
    """The items with the five highest and lowest values of a component."""
    v = _stats(spark, data).filter("mean_r is not null").select("item_id", F.col("mean_r").alias("value"))
    top = v.orderBy(F.desc("value"), "item_id").limit(5).withColumn("end", F.lit("high"))
    return top.unionByName(v.orderBy("value", "item_id").limit(5).withColumn("end", F.lit("low")))


def a32_beyond_a_deviation(spark, data):
    """Items further than a deviation from the mean of a component, either way."""
    v = _stats(spark, data).filter("mean_g is not null").select("item_id", F.col("mean_g").alias("value"))
    m = v.agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("d"))
    side = F.when(F.col("value") > F.col("m") + F.col("d"), "high").when(F.col("value") < F.col("m") - F.col("d"), "low")
    return v.crossJoin(F.broadcast(m)).select("item_id", side.alias("side")).filter("side is not null")


def a32_beyond_a_median(spark, data):
    """Items further than a deviation from the median of a component, either way."""
    v = _stats(spark, data).filter("mean_g is not null").select("item_id", F.col("mean_g").alias("value"))
    m = v.agg(F.median("value").alias("m"), F.stddev_pop("value").alias("d"))
    side = F.when(F.col("value") > F.col("m") + F.col("d"), "high").when(F.col("value") < F.col("m") - F.col("d"), "low")
    return v.crossJoin(F.broadcast(m)).select("item_id", side.alias("side")).filter("side is not null")


def _votes(spark, data):
    """Vote lines as text, made of lineitem: a part's votes by tenth of the quantity; parsed again."""
    line = table(spark, data, "lineitem").select(F.col("l_partkey").alias("part"), F.least(F.lit(10), F.greatest(F.lit(1), F.ceil(F.col("l_quantity") / 5))).cast("int").alias("score"))
    counts = line.groupBy("part").agg(*[F.count_if(F.col("score") == i).alias(f"v{i}") for i in range(1, 11)])
    text = counts.select(F.concat_ws(" ", F.lit("0"), F.col("part").cast("string"), *[F.col(f"v{i}").cast("string") for i in range(1, 11)]).alias("value"))
    return votes(text)


def s17_a19_votes(spark, data):
    n, mean = s.vote_stats(F.col("votes"))
    v = _votes(spark, data).select("image_id", n.alias("n"), mean.alias("mean"))
    return v.select("image_id", "n", F.round("mean", 6).alias("mean"), (F.col("mean") >= 6).cast("int").alias("good"), F.greatest(F.lit(1), F.least(F.lit(10), F.bround("mean", 0).cast("int"))).alias("class"))


def j4_features_with_embeddings(spark, data):
    """Each item's features with its embedding behind them, zeros where it has none: width and total."""
    e = table(spark, data, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("e"))
    plain = _features(spark, data).select("item_id", F.array(*[F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0)) for c in (*STATS, *BINS)]).alias("f"))
    both = plain.join(e, "item_id", "left").select("item_id", F.concat("f", F.coalesce("e", F.array_repeat(F.lit(0.0), 64))).alias("x"))
    return both.select("item_id", F.size("x").alias("width"), F.round(F.aggregate("x", F.lit(0.0), lambda a, b: a + b), 3).alias("total"))


def j5_features_with_votes(spark, data):
    """Features of the items that have votes, whose ids may be written with an ending: id, mean vote, a feature."""
    n, mean = s.vote_stats(F.col("votes"))
    key = lambda c: F.regexp_replace(c, r"(?i)\.jpg$", "")
    v = _votes(spark, data).select(key(F.when(n % 2 == 0, F.concat("image_id", F.lit(".jpg"))).otherwise(F.col("image_id"))).alias("key"), mean.alias("mean"))
    f = _stats(spark, data).select(F.col("item_id").cast("string").alias("key"), "mean_r")
    return f.join(v, "key").select("key", F.round("mean", 6).alias("mean"), F.round("mean_r", 6).alias("mean_r"))


def a34_class_counts(spark, data):
    """How many images have each class from 0 to 10, absent classes included."""
    c = s17_a19_votes(spark, data).groupBy("class").agg(F.count("*").alias("n"))
    return spark.range(11).select(F.col("id").cast("int").alias("class")).join(c, "class", "left").select("class", F.coalesce("n", F.lit(0)).alias("n"))


_BASICS = ["mean", "std", "highlights", "shadows", "histogram_balance", "dynamic_range", "symmetry", "edge_strength"]


def _square(vector) -> np.ndarray:
    v = np.asarray(vector, dtype=np.float64)
    span = v.max() - v.min()
    g = np.floor(255 * (v - v.min()) / span) if span else np.zeros_like(v)
    return np.repeat(g.reshape(8, 8, 1), 3, axis=2).astype(np.uint8)


@F.pandas_udf(StructType([StructField(n, DoubleType()) for n in _BASICS]))
def _basics(vectors: pd.Series) -> pd.DataFrame:
    rows = [pixels.features(_square(v)) for v in vectors]
    return pd.DataFrame([[r[n] for n in _BASICS] for r in rows], columns=_BASICS)


def x_pixel_basics(spark, data):
    """Features of pictures of 8 x 8 pixels made from the embeddings."""
    e = spread(table(spark, data, "embeddings").select("vec_id", "embedding")).select("vec_id", _basics("embedding").alias("f"))
    return e.select("vec_id", *[F.round(F.col(f"f.{n}"), 5).alias(n) for n in _BASICS])


def x_pixel_vectors(spark, data):
    """The whole vector of 157 features of such pictures."""
    names = [f"class{i}" for i in range(80)]

    def run(batches):
        for b in batches:
            out = [pixels.feature_vector(_square(v), [12, 0, 1, 0, *[0.0] * 10], set(), names) for v in b["embedding"]]
            yield pd.DataFrame({"vec_id": b["vec_id"], "features": out})

    return spread(table(spark, data, "embeddings").select("vec_id", "embedding")).mapInPandas(run, "vec_id bigint, features array<double>")


def m28_components(spark, data):
    """Principal components of the embeddings: explained and cumulative variance of the first ten."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    e = table(spark, data, "embeddings").select(array_to_vector(F.col("embedding").cast("array<double>")).alias("x"))
    share = PCA(k=10, inputCol="x", outputCol="y").fit(e).explainedVariance.toArray()
    rows = [(i + 1, round(float(v), 9), round(float(c), 9)) for i, (v, c) in enumerate(zip(share, np.cumsum(share)))]
    return spark.createDataFrame(rows, "component int, explained double, cumulative double")


QUERIES = {f.__name__: f for f in (
    m24_correlations, m24_redundant, m24_target, a28_variances, x22_pairs, x23_names, x24_stats_text, a32_beyond_a_median, j4_features_with_embeddings, j5_features_with_votes, x21_x22_interactions, o6_cosine_top, j13_cosine_matrix, o7_extremes, a32_beyond_a_deviation,
    s17_a19_votes, a34_class_counts, x_pixel_basics, x_pixel_vectors, m28_components,
)}

V = "with i as (select distinct on (item_id) * from image_items), v as (select distinct on (item_id) * from preprocess_results)"
_PAIRS = " union all ".join(f"select '{a}' as a, '{b}' as b, corr({a}, {b}) as r from v" for k, a in enumerate(STATS) for b in STATS[k + 1 :])
_VOTES = """with l as (select l_partkey as part, least(10, greatest(1, ceil(l_quantity / 5)))::int as score from lineitem),
g as (select part::varchar as image_id, count(*) as n, avg(score) as mean from l group by part),
s17 as (select image_id, n, round(mean, 6) as mean, (mean >= 6)::int as good, greatest(1, least(10, round_even(mean, 0)::int)) as class from g)"""
_H = [f"case when len(hist_feat) = 48 then coalesce(nanless(hist_feat[{2 * i + 1}]), 0) + coalesce(nanless(hist_feat[{2 * i + 2}]), 0) else coalesce(nanless(hist_feat[{i + 1}]), 0) end" for i in range(24)]
BIN_SQL = [re.sub(r"nanless\((hist_feat\[\d+\])\)", r"(case when isnan(\1) then 0 else \1::double end)", h) for h in _H]
_ALL = V + ", f as (select item_id, " + ", ".join(STATS) + ", " + ", ".join(f"{h} as h{i}" for i, h in enumerate(BIN_SQL)) + " from v where len(hist_feat) in (24, 48))"
_RANKED = _ALL + ", rk as (select feature, x, row_number() over (order by x desc, feature) as rank from (" + " union all ".join(f"select '{c}' as feature, var_pop({c}) as x from f" for c in (*STATS, *BINS)) + "))"
_SOUND = " and ".join(f"{c} is not null and not isnan({c})" for c in STATS)
_ALL_PAIRS = " union all ".join(f"select '{a}' as a, '{b}' as b, corr({a}, {b}) as r from w" for k, a in enumerate([*STATS, *BINS]) for b in [*STATS, *BINS][k + 1 :])
ORACLE = {
    "m24_correlations": f"{V} select a, b, round(r, 6) as r from ({_PAIRS})",
    "m24_redundant": f"{_ALL}, w as materialized (select * from f where {_SOUND}) select a, b, round(r, 6) as r, abs(r) > 0.95 as redundant from ({_ALL_PAIRS})",
    "m24_target": V + ", j as (select v.*, case lower(trim(label)) when 'keep' then 1.0 when 'trash' then 0.0 end as y from v join i using (item_id)) select feature, round(r, 6) as r from ("
    + " union all ".join(f"select '{c}' as feature, corr({c}, y) as r from j where y is not null" for c in STATS) + ") order by abs(r) desc, feature limit 30",
    "a28_variances": _RANKED + " select feature, round(x, 4) as variance, rank::int as rank from rk where rank <= 15",
    "x22_pairs": _RANKED + """, t as (select feature, rank from rk where rank <= 15),
p as (select a.feature as a, b.feature as b, row_number() over (order by a.rank, b.rank) as k from t a join t b on a.rank < b.rank),
q as (select a.feature as a, b.feature as b, row_number() over (order by a.rank, b.rank) as k from t a join t b on a.rank < b.rank and b.rank <= 10)
select 'product' as kind, a, b from p where k <= 100 union all select 'quotient', a, b from q where k <= 20""",
    "a32_beyond_a_median": V + ", m as (select median(mean_g) as m, stddev_pop(mean_g) as d from v where mean_g is not null) select item_id, case when mean_g > m + d then 'high' else 'low' end as side from v, m where mean_g > m + d or mean_g < m - d",
    "j4_features_with_embeddings": _ALL + ", e as (select vec_id as item_id, list_sum(embedding::double[]) as t from embeddings) select item_id, " + str(len(STATS) + 24 + 64) + "::int as width, round(" + " + ".join(f"coalesce(case when isnan({c}) then 0 else {c} end, 0)" for c in (*STATS, *BINS)) + " + coalesce(t, 0), 3) as total from f left join e using (item_id)",
    "j5_features_with_votes": _VOTES.replace("with l as", V + ", l as") + " select s17.image_id as key, s17.mean, round(v.mean_r, 6) as mean_r from s17 join v on v.item_id::varchar = s17.image_id",
    "x24_stats_text": V + " " + " union all ".join(f"select '{c}' as feature, format('{c}: mean {{:.3f}}, deviation {{:.3f}}, from {{:.3f}} to {{:.3f}}', avg({c}), stddev_pop({c}), min({c}), max({c})) as line from v" for c in STATS),
    "x21_x22_interactions": V + " select item_id, round(mean_r * std_r, 6) as mean_r_x_std_r, round(mean_r * aspect, 6) as mean_r_x_aspect, round(case when aspect <> 0 then std_r / aspect else 0 end, 6) as std_r_over_aspect from v",
    "o6_cosine_top": "select a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 5) as similarity from embeddings a join embeddings b on b.vec_id = 7 and a.vec_id <> 7 order by list_cosine_similarity(a.embedding::double[], b.embedding::double[]) desc, a.vec_id limit 10",
    "j13_cosine_matrix": "select b.vec_id as query_id, a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 5) as similarity from embeddings a, embeddings b where b.vec_id % 100 = 0",
    "o7_extremes": V + """ (select item_id, mean_r as value, 'high' as "end" from v where mean_r is not null order by mean_r desc, item_id limit 5) union all (select item_id, mean_r, 'low' from v where mean_r is not null order by mean_r, item_id limit 5)""",
    "a32_beyond_a_deviation": V + ", m as (select avg(mean_g) as m, stddev_pop(mean_g) as d from v) select item_id, case when mean_g > m + d then 'high' else 'low' end as side from v, m where mean_g > m + d or mean_g < m - d",
    "s17_a19_votes": _VOTES + " select * from s17",
    "a34_class_counts": _VOTES + " select range::int as class, (select count(*) from s17 where s17.class = range) as n from range(11)",
    "x_pixel_basics": """with p as (select vec_id, list_transform(embedding, lambda x: floor(255 * (x::double - list_min(embedding)::double) / (list_max(embedding)::double - list_min(embedding)::double))) as g from embeddings),
h as (select vec_id, b, n / 64 as q from (select vec_id, floor(x / 4)::int as b, count(*) as n from (select vec_id, unnest(g) as x from p) group by 1, 2)),
e as (select vec_id, -sum(q::float * log2(q + 1e-12)) as bal, count(case when q > 0.01 then 1 end) / 64 as used from h group by 1)
select vec_id, round(list_avg(g), 5) as mean, round(sqrt(list_avg(list_transform(g, lambda x: (x - list_avg(g)) ** 2))), 5) as std,
 round(len(list_filter(g, lambda x: x >= 250)) / 64 * 100, 5) as highlights, round(len(list_filter(g, lambda x: x <= 5)) / 64 * 100, 5) as shadows,
 round(bal, 5) as histogram_balance, round(((list_max(g) - list_min(g)) / 255 + used) / 2, 5) as dynamic_range,
 round(1 - (list_avg(list_transform(range(32), lambda k: abs(g[(k // 4) * 8 + k % 4 + 1] - g[(k // 4) * 8 + 7 - k % 4 + 1])))
          + list_avg(list_transform(range(32), lambda k: abs(g[(k // 8) * 8 + k % 8 + 1] - g[(7 - k // 8) * 8 + k % 8 + 1])))) / 510, 5) as symmetry,
 round(list_avg(list_transform(range(49), lambda k: sqrt((g[(k // 7) * 8 + k % 7 + 2] - g[(k // 7) * 8 + k % 7 + 1]) ** 2 + (g[(k // 7 + 1) * 8 + k % 7 + 1] - g[(k // 7) * 8 + k % 7 + 1]) ** 2))), 5) as edge_strength
from p join e using (vec_id)""",
}
