"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darkslide.operators.blocks import forest
from darkslide.operators.shared import Written
from darkslide.operators.skew import skew_safe_lookup


def _both(edges: DataFrame) -> DataFrame:
    ends = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    return edges.select(F.explode(ends).alias("e")).select("e.u", "e.v")


def _star(adjacent: DataFrame, large: bool) -> DataFrame:
    """Hook neighbours to the least vertex around: the greater ones (large) or the smaller ones (small)."""
    side = adjacent if large else adjacent.filter("v < u")
    least = side.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    told = skew_safe_lookup(side, "u", least, ["m"], "n")
    if large:
        return told.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    here = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
    return told.select(F.explode(here).alias("e")).select("e.u", "e.v")


#: Edges, at most, that one task ties together.
FEW_EDGES = 1 << 20


def _in_one_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    e = pd.concat([*batches, pd.DataFrame({"u": [], "v": []}, dtype="int64")])
    item, root = forest(e["u"].to_numpy(np.int64), e["v"].to_numpy(np.int64))
    roots = np.unique(root)
    yield pd.DataFrame({"item": np.r_[item, roots], "root": np.r_[root, roots]})


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(item, root) of every vertex of ``edges`` (u, v): root is the smallest vertex of the component.

    Null ends, self loops, repeated and reversed edges do no harm; vertices
    without an edge to another are not returned. Up to FEW_EDGES edges are tied in one
    task, as their rounds would cost more than their work.
    """
    def marks() -> dict:
        h = F.xxhash64("u", "v")
        return {"rows": F.count("*"), "mix": F.bit_xor(h), "sum": F.sum(F.shiftrightunsigned(h, 40))}

    e = edges.select(F.col("u").cast("bigint"), F.col("v").cast("bigint")).dropna().filter("u <> v")
    now = Written(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", **marks())
    if now.stats["rows"] <= FEW_EDGES:
        return now.df.repartition(1).mapInPandas(_in_one_task, "item bigint, root bigint")
    for _ in range(max_rounds):
        large = _star(_both(now.df), True).filter("u <> v").distinct()
        then = Written(_star(_both(large), False).filter("u <> v").distinct(), "edges", **marks())
        now.drop()
        now, before = then, now.stats
        if now.stats == before:
            roots = now.df.select(F.col("v").alias("item")).distinct().withColumn("root", F.col("item"))
            return now.df.select(F.col("u").alias("item"), F.col("v").alias("root")).unionByName(roots)
    raise RuntimeError(f"not stable after {max_rounds} rounds")
