"""Comparison of the rows of a key with each other, however many a key has.

Keys with few rows are compared by a join. The rows of others are cut into blocks of
bounded size, and each pair of blocks is a task; what a task gives back is made of its
pairs at once (a count, an extreme, a spanning forest), never the pairs themselves.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darkslide.operators.skew import skew_safe_lookup

#: Rows of a key that a join may compare, and rows of a block.
FEW, BLOCK = 256, 4096


def by_size(rows: DataFrame, key: str, few: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``rows`` of keys with few rows, and of those with many, these with ``__blocks``. Null keys are in neither."""
    few = FEW if few is None else few
    sizes = rows.groupBy(key).agg(F.count("*").alias("__n"))
    known = skew_safe_lookup(rows, key, sizes.withColumn("__blocks", F.ceil(F.col("__n") / BLOCK)), ["__n", "__blocks"], "__n")
    return known.filter(F.col("__n") <= few).select(*rows.columns), known.filter(F.col("__n") > few).select(*rows.columns, "__blocks")


def in_blocks(many: DataFrame, key: str, run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Rows of ``schema`` that ``run`` makes of each pair of blocks (left, right) of the rows of a key, a block with itself included.

    ``many`` as ``by_size`` gives it. Each unordered pair of blocks comes once; rows keep
    their order by none.
    """
    columns = [c for c in many.columns if c != "__blocks"]
    b = many.withColumn("__b", F.pmod(F.xxhash64(*columns), F.col("__blocks")))
    others = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__blocks") - 1))
    left = b.withColumn("__i", F.col("__b")).withColumn("__j", others).filter("__i <= __j").select(*columns, "__i", "__j")
    right = b.withColumn("__j", F.col("__b")).withColumn("__i", others).filter("__i <= __j")
    right = right.select(*[F.col(c).alias(c) for c in columns], "__i", "__j")
    keys = [key, "__i", "__j"]

    def pair(a: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        return run(a, c)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(pair, schema)


def bit_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of each of ``a`` and each of ``b`` (int64)."""
    return np.bitwise_count(a.view(np.uint64)[:, None] ^ b.view(np.uint64)[None, :])


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (vertex, least vertex) that tie together what the links (u, v) tie."""
    names, ends = np.unique(np.r_[u, v], return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    least = np.arange(len(names))
    while True:
        to = least.copy()
        low = np.minimum(least[a], least[b])
        np.minimum.at(to, a, low)
        np.minimum.at(to, b, low)
        np.minimum.at(to, least[a], low)
        np.minimum.at(to, least[b], low)
        to = to[to]
        if (to == least).all():
            break
        least = to
    moved = least != np.arange(len(names))
    return names[moved], names[least[moved]]
