"""Dense numbers of runs in an ordered sequence, without putting it in one task.

The sequence is cut by key and day. Within a part, the previous row is at hand;
the first row of a part takes it from a table of the parts (as many rows as keys
times days), which also adds up how many runs began in earlier parts. That table is
sorted in ranges, so that no task sees all of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def gap_ids(rows: DataFrame, key: str, at: str, tie: str, gap: int, name: str, split_keys: bool = True) -> DataFrame:
    """``rows`` with ``name``: the number, from 0, of the run that a row belongs to in the order (key, at, tie).

    A new run begins where ``at`` is more than ``gap`` after the previous row,
    and with ``split_keys`` also where the key changes. Without, the previous row
    may be another key's, and going back in time begins no run. Rows with a null
    key or instant are left out.
    """
    r = rows.filter(F.col(key).isNotNull() & F.col(at).isNotNull()).withColumn("__day", F.expr(f"({at} - pmod({at}, {DAY_US}L)) div {DAY_US}L"))
    parts = r.groupBy(key, "__day").agg(F.max(at).alias("__last"), F.min(at).alias("__start"))
    if split_keys:
        parts = parts.select(key, "__day", F.lag("__last").over(Window.partitionBy(key).orderBy("__day")).alias("__before"))
    else:
        ranked = dense_index(parts, [F.asc(key), F.asc("__day")], "__at")
        before = ranked.select((F.col("__at") + 1).alias("__at"), F.col("__last").alias("__before"))
        parts = ranked.join(before, "__at", "left").select(key, "__day", "__before")
    inside = Window.partitionBy(key, "__day").orderBy(at, tie)
    prev = F.coalesce(F.lag(at).over(inside), F.col("__before"))
    r = r.join(parts, [key, "__day"]).withColumn("__prev", prev)
    opens = (F.col("__prev").isNull() | (F.col(at) - F.col("__prev") > gap)).cast("bigint")
    r = r.withColumn("__opens", opens)
    r = r.withColumn("__runs", F.sum("__opens").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    counts = r.groupBy(key, "__day").agg(F.sum("__opens").alias("__n"))
    counts = running_sums(counts, [F.asc(key), F.asc("__day")], ["__n"]).select(key, "__day", (F.col("run___n") - F.col("__n")).alias("__earlier"))
    out = r.join(counts, [key, "__day"]).withColumn(name, F.col("__earlier") + F.col("__runs") - 1)
    return out.select(*rows.columns, name)


def dense_index(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with ``name``: their rank from 0 in a total ``order``, by sorted ranges and their sizes."""
    from darkslide.operators.shared import Written

    place = F.monotonically_increasing_id()
    w = Written(rows.orderBy(*order).withColumn("__m", place), "ranked").df
    part, at = F.shiftrightunsigned("__m", 33), F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    w = w.withColumn("__part", part).withColumn("__at", at)
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = w.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__earlier"))
    return w.join(F.broadcast(sizes), "__part").select(*rows.columns, (F.col("__earlier") + F.col("__at")).alias(name))


def running_sums(rows: DataFrame, order: list[Column], columns: list[str]) -> DataFrame:
    """``rows`` with each of ``columns`` also summed up to and with the row, as run_<column>, in a total ``order``.

    Sorted ranges are summed one by one and started from the sums of those before,
    so that no task sees all rows.
    """
    from darkslide.operators.shared import Written

    w = Written(rows.orderBy(*order).withColumn("__m", F.monotonically_increasing_id()), "sorted").df
    w = w.withColumn("__part", F.shiftrightunsigned("__m", 33))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = w.groupBy("__part").agg(*[F.sum(c).alias(f"__t_{c}") for c in columns])
    totals = totals.select("__part", *[F.coalesce(F.sum(f"__t_{c}").over(earlier), F.lit(0)).alias(f"__e_{c}") for c in columns])
    inside = Window.partitionBy("__part").orderBy("__m").rowsBetween(Window.unboundedPreceding, 0)
    out = w.join(F.broadcast(totals), "__part")
    return out.select(*rows.columns, *[(F.col(f"__e_{c}") + F.sum(c).over(inside)).alias(f"run_{c}") for c in columns])
