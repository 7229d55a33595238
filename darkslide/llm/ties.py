"""Edges of a graph out of shared keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from darkslide.operators.skew import skew_safe_lookup


def assigned(key: str) -> Column:
    """The key if it ties records together: null and -1 do not."""
    return F.when(F.col(key) != -1, F.col(key))


def key_edges(rows: DataFrame, item: str, key: str) -> DataFrame:
    """Edges (u, v) that tie all items of equal ``key``, each to the smallest one.

    A star for each key, so edges are fewer than rows whatever the sizes of the
    groups. Null keys and items tie nothing.
    """
    m = rows.select(F.col(item).alias("u"), F.col(key).alias("k")).dropna().distinct()
    centre = m.groupBy("k").agg(F.min("u").alias("v"), F.count("*").alias("n")).filter("n > 1")
    return skew_safe_lookup(m, "k", centre, ["v"], "n").filter("v is not null and u <> v").select("u", "v")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
