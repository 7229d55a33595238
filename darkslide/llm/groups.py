"""Queries on groups of linked items: splits (p2) and consolidated groups (p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from darkslide.llm.hash_to_min import components
from darkslide.llm.random_mate import split_units, units
from darkslide.llm.ties import assigned, key_edges
from darkslide.operators.skew import skew_safe_lookup
from darkslide.sources.tables import table

SHARES = [("train", 0.8), ("val", 0.1), ("test", 0.1)]


def _tie_edges(items: DataFrame) -> DataFrame:
    i = items.select("item_id", assigned("group_id").alias("group_id"), assigned("burst_id").alias("burst_id"))
    return key_edges(i, "item_id", "group_id").unionByName(key_edges(i, "item_id", "burst_id"))


def p2_found(spark: SparkSession, data: str) -> DataFrame:
    """Items that stay together: item_id, unit_id."""
    tied = units(_tie_edges(table(spark, data, "image_items")))
    return tied.select(F.col("item").alias("item_id"), F.col("unit").alias("unit_id"))


def p2_splits(spark: SparkSession, data: str) -> DataFrame:
    """Every item with its unit and split: 80/10/10 of the items of each label, units whole.

    An item's label is its non-blank label in lower case, else ``none``; a unit
    belongs to the stratum of its most frequent label (the first by name if
    several are).
    """
    items = table(spark, data, "image_items").filter("item_id is not null")
    label = F.coalesce(F.nullif(F.lower(F.trim("label")), F.lit("")), F.lit("none"))
    own = items.groupBy("item_id").agg(F.max(label).alias("label"))
    tied = units(_tie_edges(items)).select(F.col("item").alias("item_id"), "unit", F.col("n").alias("size"))
    mine = own.join(tied, "item_id", "left").select("item_id", "label", F.coalesce("unit", "item_id").alias("unit"))
    shares = mine.groupBy("unit", "label").agg(F.count("*").alias("k"))
    strata = shares.groupBy("unit").agg(F.min(F.struct(-F.col("k"), "label")).alias("top"), F.sum("k").alias("n"))
    placed = split_units(strata.select("unit", F.col("top.label").alias("stratum"), "n"), SHARES)
    return skew_safe_lookup(mine, "unit", placed, ["split"], "n").select("item_id", F.col("unit").alias("unit_id"), "label", "split")


def p5_found(spark: SparkSession, data: str) -> DataFrame:
    """Items linked by matches, groups or bursts: item_id, root_id."""
    matches = table(spark, data, "match_pairs").filter("is_match").select(F.col("item_a").alias("u"), F.col("item_b").alias("v"))
    edges = matches.unionByName(_tie_edges(table(spark, data, "image_items")))
    return components(edges).select(F.col("item").alias("item_id"), F.col("root").alias("root_id"))


QUERIES = {"p2_found": p2_found, "p2_splits": p2_splits, "p5_found": p5_found}

_TIES = """
  select i.item_id as u, g.lo as v from image_items i join (select group_id, min(item_id) as lo from image_items
    where group_id <> -1 group by 1) g using (group_id)
  union select i.item_id, g.lo from image_items i join (select burst_id, min(item_id) as lo from image_items
    where burst_id <> -1 group by 1) g using (burst_id)"""

_REACH = """
both_ways as (select u, v from e where u <> v union select v, u from e where u <> v),
reach as (select u as x, u as root from both_ways union select b.v, r.root from reach r join both_ways b on b.u = r.x)"""

ORACLE = {
    "p2_found": f"""with recursive e as ({_TIES}),{_REACH}
select x as item_id, min(root) as unit_id from reach group by x""",
    "p5_found": f"""with recursive e as ({_TIES} union select item_a, item_b from match_pairs where is_match),{_REACH}
select x as item_id, min(root) as root_id from reach group by x""",
}
