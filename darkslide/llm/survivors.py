"""One surviving record of each group, put together from consistent bundles.

Fields that depend on each other form a bundle and are taken from one member
together, never mixed. Each bundle puts a number on its trust in a member. A bundle
claims values of attributes, such as the label it gives or the album that a file path
implies; bundles that claim the same attribute have to agree on it, which is the
functional dependency between them. Which member each bundle is taken from is decided
by branch and bound: the choice of most trust in total, in which no two claims
contradict each other. A branch is cut as soon as its trust, with the best that the
bundles still open could add, is less than the best found.

Before the search a combinable aggregation keeps per bundle and claim only the most
trusted member: a less trusted one with the same claim is never part of a better
choice. Bundles without a common attribute are searched apart. If the bundles of a
search all claim the same one attribute, different values of it never go together, so
the values of a group are searched in parts of bounded size and the best part wins;
a group that holds a third of all records is no task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from darkslide.llm.ties import union_all
from darkslide.operators.photos import epoch_us

#: Values of an attribute, about, that one search sees.
VALUES_AT_ONCE = 1000


@dataclass(frozen=True)
class Bundle:
    """``present``: which members can give the bundle.

    With ``claims``, attribute name to a string column, ``trust`` is a bigint of at
    least 1; of equally trusted members the smaller id counts. Without, ``order`` are
    columns by which members are ranked, ascending, before the id.
    """

    name: str
    present: Column
    order: list[Column] = field(default_factory=list)
    claims: dict[str, Column] = field(default_factory=dict)
    trust: Column | None = None


def descending(c: Column) -> list[Column]:
    """Order keys for a number or timestamp: highest first, null and NaN last."""
    return [c.isNull().cast("int"), -c]


def latest(ts: str) -> Column:
    """Trust by a timestamp: the later the more, null least."""
    return F.greatest(F.lit(1), F.coalesce(epoch_us(ts), F.lit(0)) + 2)


def choose(candidates: list[list[tuple]]) -> tuple[int, list]:
    """Branch and bound: (trust in total, ids) of one of ``candidates[b]`` = [(id, claims, trust)] for each bundle b, or None.

    No two chosen claims contradict each other. Of choices with equal trust the one
    with the smaller ids, bundle by bundle and None last.
    """
    order = [sorted(c, key=lambda x: (-x[2], x[0])) for c in candidates]
    hope = [0] * (len(order) + 1)
    for b in range(len(order) - 1, -1, -1):
        hope[b] = hope[b + 1] + (order[b][0][2] if order[b] else 0)
    best: list = [-1, None]

    def rank(ids: tuple) -> tuple:
        return tuple((i is None, i or 0) for i in ids)

    def grow(b: int, total: int, ids: tuple, held: dict) -> None:
        if total + hope[b] < best[0]:
            return
        if b == len(order):
            if total > best[0] or rank(ids) < rank(best[1]):
                best[:] = [total, ids]
            return
        for item, claims, trust in order[b]:
            if total + trust + hope[b + 1] < best[0]:
                break
            if all(held.get(k, v) == v for k, v in claims.items()):
                grow(b + 1, total + trust, (*ids, item), {**held, **claims})
        grow(b + 1, total, (*ids, None), held)

    grow(0, 0, (), {})
    return best[0], list(best[1])


def _searches(bundles: list[Bundle]) -> list[list[Bundle]]:
    """Bundles with claims, those that are linked by common attributes together."""
    parts: list[list[Bundle]] = []
    for b in bundles:
        linked = [p for p in parts if any(b.claims.keys() & o.claims.keys() for o in p)]
        parts = [p for p in parts if p not in linked] + [[o for p in linked for o in p] + [b]]
    return parts


def survivors(rows: DataFrame, group: str, item: str, bundles: list[Bundle]) -> DataFrame:
    """One row per ``group`` of at least two different items: for each bundle the item it is taken from, or null.

    Rows with a null group or item belong to no group; repeated rows count once. A claim
    that is null is a value like any other.
    """
    r = rows.filter(F.col(group).isNotNull() & F.col(item).isNotNull())
    free, claiming = [b for b in bundles if not b.claims], [b for b in bundles if b.claims]
    key = lambda b: F.struct(*[c.alias(f"o{i}") for i, c in enumerate(b.order)], F.col(item).alias("id"))
    firsts = r.groupBy(F.col(group).alias("g")).agg(F.min(item).alias("lo"), F.max(item).alias("hi"), *[F.min(F.when(b.present, key(b))).alias(b.name) for b in free])
    firsts = firsts.filter("lo <> hi").select("g", *[F.col(f"{b.name}.id").alias(b.name) for b in free])
    if not claiming:
        return firsts.withColumnRenamed("g", group)

    # All searches in one table: (g, search, bundle, claims, trust, id).
    searches, given = _searches(claiming), []
    for s, part in enumerate(searches):
        for b, bundle in enumerate(part):
            what = F.struct(F.lit(s).alias("search"), F.lit(b).alias("bundle"), F.array(*[c.cast("string") for c in bundle.claims.values()]).alias("claims"), bundle.trust.cast("bigint").alias("trust"))
            given.append(F.when(bundle.present, what))
    long = r.select(F.col(group).alias("g"), F.col(item).alias("id"), F.explode(F.array_compact(F.array(*given))).alias("w"))
    few = long.groupBy("g", "w.search", "w.bundle", "w.claims").agg(F.min(F.struct((-F.col("w.trust")).alias("less"), "id")).alias("k"))
    few = few.select("g", "search", F.struct("bundle", "claims", (-F.col("k.less")).alias("trust"), F.col("k.id").alias("id")).alias("c"))
    one = [len({a for b in part for a in b.claims}) == 1 for part in searches]
    values = few.groupBy("g", "search").agg(F.count("*").alias("n"))
    parts = F.when(F.array(*[F.lit(x) for x in one])[F.col("search")], F.ceil(F.col("n") / VALUES_AT_ONCE)).otherwise(1)
    cut = few.join(values.select("g", "search", parts.alias("parts")), ["g", "search"]).withColumn("part", F.pmod(F.xxhash64("c.claims"), F.col("parts")))
    lists = cut.groupBy("g", "search", "part").agg(F.collect_list("c").alias("c"))
    attributes = [[list(b.claims) for b in part] for part in searches]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for g, s, cell in zip(batch["g"], batch["search"], batch["c"]):
                candidates: list[list] = [[] for _ in attributes[s]]
                for c in cell:
                    candidates[c["bundle"]].append((c["id"], dict(zip(attributes[s][c["bundle"]], c["claims"])), c["trust"]))
                total, ids = choose(candidates)
                out.append((g, s, total, [{"none": i is None, "id": 0 if i is None else i} for i in ids]))
            yield pd.DataFrame(out, columns=["g", "search", "total", "ids"])

    found = lists.select("g", "search", "c").mapInPandas(run, "g bigint, search int, total bigint, ids array<struct<none: boolean, id: bigint>>")
    order = F.struct((-F.col("total")).alias("less"), "ids")
    best = found.groupBy("g").agg(*[F.min(F.when(F.col("search") == s, order)).alias(f"s{s}") for s in range(len(searches))])
    pick = {bundle.name: F.col(f"s{s}.ids")[b] for s, part in enumerate(searches) for b, bundle in enumerate(part)}
    best = best.select("g", *[F.when(~c["none"], c["id"]).alias(n) for n, c in pick.items()])
    return firsts.join(best, "g", "left").select(F.col("g").alias(group), *[b.name for b in bundles])
