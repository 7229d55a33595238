"""Lookups and ranked selections that survive hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A key with more rows than this is hot. At most rows / HOT_ROWS keys are, which
#: bounds what is broadcast: 100,000 keys for ten billion rows.
HOT_ROWS = 100_000


def skew_safe_lookup(
    rows: DataFrame, key: str, values: DataFrame, payload: list[str], count: str | None = None, hot_rows: int = HOT_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """``rows`` left-joined with ``values`` on ``key``, adding ``payload``.

    ``values`` has one row per key, and in ``count``, if that is given, about the
    number of ``rows`` of that key; else the rows are counted here. Hot keys
    travel as a broadcast, whose size ``hot_rows`` bounds; their rows are not
    shuffled by key but spread by a hash of the row that meets no value. Null
    keys are spread likewise and get nulls. ``largest``: no key has more rows, nor is
    null in more; if that is no more than ``hot_rows``, a plain join does.
    """
    if largest is not None and largest <= hot_rows:
        return rows.join(values.select(key, *payload), key, "left").select(*rows.columns, *payload)
    names = [f"__{i}" for i in range(len(payload))]
    pack = F.struct(*[F.col(p).alias(n) for p, n in zip(payload, names)])
    if count is None:
        many = rows.groupBy(key).agg(F.count("*").alias("__n")).filter((F.col("__n") > hot_rows) & F.col(key).isNotNull())
        hot = values.join(F.broadcast(many.select(key)), key, "left_semi")  # at most rows / hot_rows keys
        cold = values
    else:
        hot, cold = values.filter(F.col(count) > hot_rows), values.filter(F.col(count) <= hot_rows)
    hot = hot.select(F.col(key).alias("__hot"), pack.alias("__hv"))
    cold = cold.filter(F.col(key).isNotNull()).select(F.col(key).alias("__cold"), F.lit(0).alias("__zero"), pack.alias("__cv"))
    joined = rows.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left")
    plain = [c for c, t in rows.dtypes if "map<" not in t]
    spread = F.pmod(F.xxhash64(*plain), F.lit(1_000_000)).cast("int") + 1
    away = F.col("__hv").isNotNull() | F.col(key).isNull()
    joined = joined.withColumn("__spread", F.when(away, spread).otherwise(0))
    joined = joined.join(cold, (F.col(key) == F.col("__cold")) & (F.col("__spread") == F.col("__zero")), "left")
    found = F.coalesce("__hv", "__cv")
    return joined.select(*rows.columns, found.alias("__v")).select(*rows.columns, *[F.col(f"__v.{n}").alias(p) for p, n in zip(payload, names)])


def first_rows(df: DataFrame, keys: list[str], order: list[Column], k: int, salts: int = 64) -> DataFrame:
    """The first ``k`` rows of each key by ``order``, without one task per key.

    Ranks within salted parts of a key, then among the at most ``k * salts``
    survivors. ``order`` has to be total, or the choice among ties is open.
    """
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    part = Window.partitionBy(*keys, "__salt").orderBy(*order)
    few = salted.withColumn("__rank", F.row_number().over(part)).filter(F.col("__rank") <= k)
    whole = Window.partitionBy(*keys).orderBy(*order)
    few = few.withColumn("__rank", F.row_number().over(whole)).filter(F.col("__rank") <= k)
    return few.drop("__salt", "__rank")
