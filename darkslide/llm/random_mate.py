"""Connected components by random-mate contraction, and splits that keep them whole.

In a round every vertex tosses a coin, a hash of its id and the round. A tail
next to a head collapses into the smallest such head; the edges are relabelled,
loops and repetitions vanish, and the next round works on a smaller graph. After
about log(n) rounds no edge is left. The last rounds, on what is left of at most
REMAINDER edges, are the same but run in one task, as jobs would cost more than
their work. The collapses form a forest of pointers that is unwound by doubling.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from darkslide.operators.shared import Written
from darkslide.operators.skew import skew_safe_lookup


#: Edges, at most, whose rounds one task goes through.
REMAINDER = 20_000


def contract(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(item, root) of every vertex of ``edges`` (u, v); root is some vertex of its component.

    Null ends and self loops link nothing; repeated and reversed edges count once.
    """
    rows = F.count("*")
    left = Written(_distinct(edges.select(F.col("u").cast("bigint"), F.col("v").cast("bigint")).dropna()), "edges", rows=rows)
    collapsed: list[Written] = []
    spark = edges.sparkSession
    for r in range(max_rounds):
        if not left.stats["rows"]:
            break
        if left.stats["rows"] <= REMAINDER:
            collapsed.append(Written(left.df.repartition(1).mapInPandas(_finish, "k bigint, to bigint"), "hooks"))
            break
        both = F.explode(F.array(F.struct(F.col("u").alias("k"), F.col("v").alias("to")), F.struct(F.col("v").alias("k"), F.col("u").alias("to"))))
        hooks = (
            left.df.filter(_head("u", r) != _head("v", r)).select(both.alias("p")).select("p.k", "p.to").filter(~_head("k", r))
            .groupBy("k").agg(F.min("to").alias("to"), F.count("*").alias("n"))
        )
        collapsed.append(Written(hooks, "hooks"))
        to, most = collapsed[-1].df, left.stats["rows"]
        a = skew_safe_lookup(left.df.withColumnRenamed("u", "k"), "k", to, ["to"], "n", largest=most).select(F.coalesce("to", "k").alias("u"), F.col("v").alias("k"))
        b = skew_safe_lookup(a, "k", to, ["to"], "n", largest=most).select("u", F.coalesce("to", "k").alias("v"))
        then = Written(_distinct(b), "edges", rows=rows)
        left.drop()
        left = then
    else:
        raise RuntimeError(f"edges are left after {max_rounds} rounds")
    left.drop()
    if not collapsed:
        return spark.createDataFrame([], "item bigint, root bigint")
    return _unwind(collapsed)


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pointers (k, to) of the vertices of all the edges that collapse, to where they end."""
    edges = pd.concat([*batches, pd.DataFrame({"u": [], "v": []}, dtype="int64")])
    names, ends = np.unique(edges[["u", "v"]].to_numpy(np.int64).ravel(), return_inverse=True)
    u, v = ends.reshape(-1, 2).T
    to, r = np.arange(len(names)), 0
    while len(u):
        r += 1
        mixed = (names.astype(np.uint64) ^ np.uint64(r * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
        head = ((mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) >> np.uint64(63)).astype(bool)
        k, h = np.r_[u, v], np.r_[v, u]
        hooks = ~head[k] & head[h]
        least = np.full(len(names), len(names))
        np.minimum.at(least, k[hooks], h[hooks])
        step = np.where(least < len(names), least, np.arange(len(names)))
        to, u, v = step[to], step[u], step[v]
        pair = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)])[:, u != v], axis=1)
        u, v = pair
    moved = to != np.arange(len(names))
    yield pd.DataFrame({"k": names[moved], "to": names[to[moved]]})


def _head(c: str, r: int) -> Column:
    return F.xxhash64(F.col(c), F.lit(r)).bitwiseAND(F.lit(1)) == 1


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _unwind(collapsed: list[Written]) -> DataFrame:
    """Pointers (item, to) doubled until each points to a vertex that never collapsed."""
    from darkslide.llm.ties import union_all

    now = Written(union_all([h.df.select(F.col("k").alias("item"), "to") for h in collapsed]), "pointers", rows=F.count("*"))
    most = now.stats["rows"]
    for h in collapsed:
        h.drop()
    while True:
        hop = now.df.select(F.col("item").alias("to"), F.col("to").alias("next"))
        hopped = skew_safe_lookup(now.df.select("item", "to"), "to", hop, ["next"], largest=most).select("item", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved"))
        then = Written(hopped, "pointers", moved=F.count_if("moved"))
        now.drop()
        now = then
        if not then.stats["moved"]:
            break
    ends = now.df.select("to").distinct()
    return now.df.select("item", F.col("to").alias("root")).unionByName(ends.select(F.col("to").alias("item"), F.col("to").alias("root")))


def units(edges: DataFrame) -> DataFrame:
    """(item, unit, n): the component of each vertex named by its smallest vertex, and its size."""
    labels = contract(edges)
    least = labels.groupBy("root").agg(F.min("item").alias("unit"), F.count("*").alias("n"))
    return skew_safe_lookup(labels, "root", least, ["unit", "n"], "n").select("item", "unit", "n")


#: Parts of each stratum over which weights are added up, and of each size class of units that are large for the smallest share.
BUCKETS = 1024
#: A unit is large if it holds more than this part of the smallest share of its stratum.
LARGE = 0.02


def split_units(weights: DataFrame, shares: list[tuple[str, float]], seed: int = 0) -> DataFrame:
    """``weights`` (unit, stratum, n) with ``split``: whole units, by cumulative weight within their stratum.

    In each stratum units are put in order: those that are large for the smallest share
    first, heaviest size class first, then all others by a hash, so that every split gets
    units of all those sizes. A unit goes to the split in whose share of the stratum's
    weight its middle falls. The running weight is a sum over the at most 65 * BUCKETS
    parts of a stratum plus one within the part, so no task sees a whole stratum.
    """
    at = F.pmod(F.xxhash64("unit", F.lit(seed)), F.lit(BUCKETS)).cast("int")
    totals = weights.groupBy("stratum").agg(F.sum("n").alias("total"))
    w = weights.join(totals, "stratum")
    large = F.col("n") > F.col("total") * (LARGE * min(s for _, s in shares))
    w = w.withColumn("part", F.when(large, 64 - F.floor(F.log2(F.col("n").cast("double"))).cast("int")).otherwise(65) * BUCKETS + at)
    parts = w.groupBy("stratum", "part").agg(F.sum("n").alias("weight"))
    earlier = Window.partitionBy("stratum").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("stratum", "part", F.coalesce(F.sum("weight").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("stratum", "part").orderBy(F.xxhash64("unit", F.lit(seed)), "unit").rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(parts, ["stratum", "part"])
    middle = (F.col("before") + F.col("inside") + F.col("n") / 2) / F.col("total")
    split, upto = None, 0.0
    for name, share in shares[:-1]:
        upto += share
        split = F.when(middle <= upto, name) if split is None else split.when(middle <= upto, name)
    return w.select("unit", "stratum", "n", (split.otherwise(shares[-1][0]) if split is not None else F.lit(shares[-1][0])).alias("split"))
