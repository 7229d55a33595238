"""Study analytics: correlations, redundancy, similarity, principal components, votes."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def correlations(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) of every pair of columns, in one pass over the rows."""
    pairs = list(combinations(columns, 2))
    one = rows.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    out = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("r")) for i, (a, b) in enumerate(pairs)]
    return one.select(F.explode(F.array(*out)).alias("p")).select("p.*")


def correlation_matrix(rows: DataFrame, columns: list[str]) -> DataFrame:
    """As ``correlations``, for many columns: one pass that adds up a matrix. Rows in which a column is null or NaN are left out."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation

    whole = rows.dropna(subset=columns)
    for c in columns:
        whole = whole.filter(~F.isnan(c))
    r = Correlation.corr(VectorAssembler(inputCols=columns, outputCol="x").transform(whole).select("x"), "x").first()[0].toArray()
    out = [(columns[i], columns[j], float(r[i, j])) for i, j in combinations(range(len(columns)), 2)]
    return rows.sparkSession.createDataFrame(out, "a string, b string, r double")


def target_correlations(rows: DataFrame, columns: list[str], target: str) -> DataFrame:
    one = rows.agg(*[F.corr(c, target).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("r")) for c in columns])).alias("p")).select("p.*")


def variances(rows: DataFrame, columns: list[str]) -> DataFrame:
    one = rows.agg(*[F.var_pop(c).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("variance")) for c in columns])).alias("p")).select("p.*")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def cosine_top(rows: DataFrame, item: str, vector: str, query: int, k: int) -> DataFrame:
    """The ``k`` rows most like one given row, itself excluded."""
    q = rows.filter(F.col(item) == query).limit(1).select(F.col(vector).alias("__q"))
    near = rows.filter(F.col(item) != query).crossJoin(F.broadcast(q)).select(item, cosine(F.col(vector), F.col("__q")).alias("similarity"))
    return near.orderBy(F.desc("similarity"), item).limit(k)


def interactions(columns: list[str], ratios: int = 10, products: int = 100) -> list[Column]:
    """Products of all pairs and, among the first ``ratios``, quotients (0 over 0), up to a number of each."""
    made = [(F.col(a) * F.col(b)).alias(f"{a}_x_{b}") for a, b in list(combinations(columns, 2))[:products]]
    made += [F.when(F.col(b) != 0, F.col(a) / F.col(b)).otherwise(0.0).alias(f"{a}_over_{b}") for a, b in list(combinations(columns[:ratios], 2))[:20]]
    return made


def interaction_pairs(ranked: list[str], products: int = 100, ratios: int = 10, quotients: int = 20) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """Pairs of ``ranked`` features to multiply, and of the first ``ratios`` of them to divide, up to a number of each."""
    return list(combinations(ranked, 2))[:products], list(combinations(ranked[:ratios], 2))[:quotients]


def feature_names(plain: list[str], products: list[tuple[str, str]] = (), quotients: list[tuple[str, str]] = (), embedding: int = 0) -> list[str]:
    """Names by index: plain features, products, quotients, components of an embedding."""
    return [*plain, *[f"{a}_x_{b}" for a, b in products], *[f"{a}_over_{b}" for a, b in quotients], *[f"embedding_{i}" for i in range(embedding)]]


def vote_stats(votes: Column) -> tuple[Column, Column]:
    """Number of votes for 1, 2, ... and their mean."""
    n = F.aggregate(votes, F.lit(0).cast("bigint"), lambda a, x: a + x)
    weighted = F.aggregate(F.zip_with(votes, F.sequence(F.lit(1), F.size(votes)), lambda v, s: v.cast("bigint") * s), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return n, F.when(n > 0, weighted / n)
