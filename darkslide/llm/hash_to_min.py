"""Connected components by hash-to-min.

Each vertex has a cluster, at first itself and its neighbours. In a round every
vertex sends its whole cluster to the smallest member and that smallest member
to all the others; what a vertex receives is its next cluster. When nothing
changes, the smallest vertex of a component holds all of it and every other
vertex holds just that smallest one. Rounds grow with the logarithm of the
longest path.

Clusters are rows (v, u), never arrays, so that the component that holds a third
of all records is spread over all tasks like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darkslide.operators.shared import Written
from darkslide.operators.skew import skew_safe_lookup


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(item, root) of every vertex of ``edges`` (u, v); root is the smallest vertex of its component.

    Null ends and self loops link nothing; repeated and reversed edges count
    once. Vertices without an edge to another are not returned. The result reads
    a table in the shared folder.
    """
    e = edges.select(F.col("u").cast("bigint"), F.col("v").cast("bigint")).dropna().filter("u <> v")
    pairs = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")), F.struct("u", F.col("u").alias("v")), F.struct(F.col("v").alias("u"), "v")))
    now = Written(e.select(pairs.alias("p")).select(F.col("p.u").alias("v"), F.col("p.v").alias("u")).distinct(), "clusters", rows=F.count("*"))
    for _ in range(max_rounds):
        least = now.df.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n"))
        told = skew_safe_lookup(now.df, "v", least, ["m"], "n", largest=now.stats["rows"])
        sent = F.explode(F.array(F.struct(F.col("m").alias("v"), F.col("u").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u"))))
        then = Written(told.select(sent.alias("p")).select("p.v", "p.u").distinct(), "clusters", rows=F.count("*"))
        # Tables of different lengths differ; only those of equal length are read for comparison.
        stable = then.stats == now.stats and _marks(then.df) == _marks(now.df)
        now.drop()
        now = then
        if stable:
            return now.df.filter("v <= u").select(F.col("u").alias("item"), F.col("v").alias("root"))
    raise RuntimeError(f"no stable clusters after {max_rounds} rounds")


def _marks(clusters: DataFrame) -> tuple:
    """Order-free checksums of the clusters, by which two rounds of equal length are compared."""
    h = F.xxhash64("v", "u")
    return tuple(clusters.agg(F.bit_xor(h), F.sum(F.shiftrightunsigned(h, 40))).first())
