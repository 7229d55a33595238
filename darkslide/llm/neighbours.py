"""The most similar vectors of every vector (p7).

Equal vectors become one, with the smallest ids that have it. A tree over a bounded
sample routes each vector to a shard of about SHARD vectors. Each shard gets a
vantage-point tree, made once and written to the shared folder; in it the shard's
vectors find their nearest at home, and with the distance reached there they visit
the other shards that the triangle inequality, relaxed by FACTOR, does not rule out.
Only visits are shuffled; a shard is copied only where its visits fill several
blocks. Every vector is indexed and every vector is a query.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from darkslide.llm.ties import union_all
from darkslide.llm.vp_tree import Router, VPTree, unit
from darkslide.operators.shared import Written
from darkslide.operators.skew import skew_safe_lookup
from darkslide.sources.tables import table

#: Vectors of a shard, and queries that search it in one task.
SHARD, QUERIES_AT_ONCE = 16_384, 65_536
#: Vectors of each length from which the routing tree is made, and of each of its leaves that is split further.
SAMPLE = 20_000
#: Relaxation of the triangle inequality; 1 is exact. At 2.5 about 99 % of the true neighbours are found (README).
FACTOR = 2.5
LEAF = 1024
#: Vectors that are searched for, or told where to go, at a time; each takes some bytes for each vector of a leaf, or for each shard.
AT_ONCE = 4096


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Usable vectors as bytes whose order is that of the values."""
    for b in batches:
        ids, lists = b.column(0), b.column(1)
        at = lists.offsets.to_numpy().astype(np.int64)
        v = lists.values.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(np.float32) + np.float32(0)
        bad, some = np.r_[0, np.cumsum(~np.isfinite(v))], np.r_[0, np.cumsum(v != 0)]
        usable = (bad[at[1:]] == bad[at[:-1]]) & (some[at[1:]] > some[at[:-1]])
        usable &= lists.is_valid().to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False)
        u = v.view(np.uint32)
        data = (u ^ np.where(u >> np.uint32(31), np.uint32(0xFFFFFFFF), np.uint32(0x80000000))).astype(">u4").tobytes()
        rows = np.flatnonzero(usable)
        vec = pa.array([data[4 * at[i] : 4 * at[i + 1]] for i in rows], pa.binary())
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), vec], names=["item_id", "vec"])


def _decode(vectors, dim: int) -> np.ndarray:
    u = np.frombuffer(b"".join(vectors), dtype=">u4").astype(np.uint32)
    return (u ^ np.where(u >> np.uint32(31), np.uint32(0x80000000), np.uint32(0xFFFFFFFF))).view(np.float32).reshape(-1, dim)


class Shard:
    """Vectors with their ids and their tree; ``own``, which does not travel with it, is what they found at home."""

    def __init__(self, raw: np.ndarray, ids: list[list[int]], k: int, factor: float):
        self.ids = [list(map(int, i)) for i in ids]
        self.tree = VPTree(raw, np.array([i[0] for i in self.ids], dtype=np.int64), LEAF)
        x, near, reach = unit(raw), [], []
        for at in range(0, len(x), AT_ONCE):
            own = np.arange(at, min(at + AT_ONCE, len(x)))
            places, sims = self.tree.search(x[own], k, factor, own=own)
            near += self.items(places, sims, k)
            reach.append(np.sqrt(np.maximum(2 - 2 * np.where(places[:, -1] >= 0, sims[:, -1], -1.0), 0)))
        self.own = raw, self.ids, np.concatenate(reach), near

    def __getstate__(self) -> dict:
        return {"ids": self.ids, "tree": self.tree}

    def items(self, places: np.ndarray, sims: np.ndarray, k: int) -> list[list[tuple[float, int]]]:
        """Per query (-similarity, item) of the k nearest items among the nearest vectors."""
        out = []
        for row, sim in zip(places.tolist(), sims.tolist()):
            got = [(-s, i) for p, s in zip(row, sim) if p >= 0 for i in self.ids[p][:k]]
            out.append(sorted(got)[:k])
        return out


def _sub_routers(some: DataFrame, inner: dict[int, int]) -> dict[int, Router]:
    """Routers of leaves, each made in a task from that leaf's rows of ``some`` (leaf, vec)."""

    def build(f: pd.DataFrame) -> pd.DataFrame:
        leaf = int(f["leaf"].iloc[0])
        dim = len(f["vec"].iloc[0]) // 4
        return pd.DataFrame({"leaf": [leaf], "router": [pickle.dumps(Router(unit(_decode(f["vec"], dim)), inner[leaf]))]})

    return {r.leaf: pickle.loads(r.router) for r in some.groupBy("leaf").applyInPandas(build, "leaf int, router binary").toLocalIterator()}


def _routers(v: DataFrame, shard: int, sample: int) -> dict[int, Router]:
    """The router of each length of the vectors of ``v`` (item_id, vec), from samples of its different vectors.

    A sample holds about ``sample`` vectors, and gives at most sample / 8 leaves. Where
    these would hold more than a shard, each is split by a router of its own from a
    sample of its own. What comes to the driver is one node for each shard.
    """
    share = lambda part: F.pmod(F.xxhash64("vec"), F.lit(1 << 30)) < math.ceil(min(1.0, part) * (1 << 30))
    out = {}
    for dim, n in sorted((r.dim, r["count"]) for r in v.groupBy((F.length("vec") / 4).cast("int").alias("dim")).count().toLocalIterator()):
        mine = v.filter(F.length("vec") == 4 * dim)
        some = mine.filter(share(sample / n)).select("vec").distinct().toArrow().column("vec").to_pylist()
        distinct = min(n, len(some) / min(1.0, sample / n))
        router = out[dim] = Router(unit(_decode(sorted(some), dim)) if some else np.zeros((0, dim)), math.ceil(distinct / shard))
        inner = {i: math.ceil(distinct * s / shard) for i, s in enumerate(router.shares) if distinct * s > 4 * shard}
        if inner and distinct > sample:
            most = max(router.shares[i] for i in inner) * distinct

            def leaves(batches: Iterator[pd.DataFrame], router=router, dim=dim, inner=inner) -> Iterator[pd.DataFrame]:
                for b in batches:
                    leaf = router.leaf(unit(_decode(b["vec"], dim))) if len(b) else np.zeros(0)
                    yield b.assign(leaf=leaf.astype(np.int32))[np.isin(leaf, list(inner))][["leaf", "vec"]]

            # Another part of the hash, as all leaves together need a larger sample than one.
            wide = mine.filter(share(sample / most)).select("vec").distinct().mapInPandas(leaves, "leaf int, vec binary")
            router.refine(_sub_routers(wide, inner))
        router.cut(distinct, 2 * shard)
    return out


def nearest(vectors: DataFrame, k: int = 5, factor: float = FACTOR, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """(item_id, neighbours) of ``vectors`` (item_id, hist_feat): ids of the k most similar other items, nearest first.

    Usable are vectors without null, NaN or infinite values that are not all zero;
    others are left out. Vectors are compared with those of their own length only.
    Of equally similar items the smaller id comes first. An item with several
    vectors counts with the greatest. Fewer than k others give a shorter list. The
    result reads a table in the shared folder.
    """
    raw = vectors.select("item_id", F.col("hist_feat").cast("array<float>").alias("hist_feat")).mapInArrow(_encode, "item_id bigint, vec binary")
    v = raw.groupBy("item_id").agg(F.max("vec").alias("vec"))
    routers = _routers(raw, shard, sample)
    # Up to k + 1 ids tell what an item of the class needs; one more tells that there are others still.
    first = Window.partitionBy("vec").orderBy("item_id")
    classes = v.withColumn("at", F.row_number().over(first)).filter(F.col("at") <= k + 2).groupBy("vec").agg(F.sort_array(F.collect_list("item_id")).alias("ids"))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for size, g in b.groupby(b["vec"].map(len)):
                x = unit(_decode(g["vec"], size // 4))
                to = routers[size // 4].home(x, g["ids"].map(lambda i: i[0]).to_numpy(np.int64))
                yield g.assign(dim=np.int32(size // 4), shard=to)[["dim", "shard", "vec", "ids"]]

    def away(own: tuple, dim: int, here: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, shard) of all visits to other shards. They are many times the vectors, so they are found where they are needed, and never kept."""
        raw, _, reach, _ = own
        for at in range(0, len(raw), AT_ONCE // 4):
            part = slice(at, at + AT_ONCE // 4)
            row, to = routers[dim].visits(unit(raw[part]), reach[part], factor)
            yield at + row[to != here], to[to != here]

    def settle(f: pd.DataFrame) -> pd.DataFrame:
        dim, here = int(f["dim"].iloc[0]), int(f["shard"].iloc[0])
        f = f.assign(cid=f["ids"].map(lambda i: i[0])).sort_values("cid")
        s = Shard(_decode(f["vec"], dim), [list(i[: k + 1]) for i in f["ids"]], k, factor)
        counts = np.zeros(int(routers[dim].base[-1]), np.int64)
        for _, to in away(s.own, dim, here):
            counts += np.bincount(to, minlength=len(counts))
        full = int((f["ids"].map(len) > k + 1).sum())
        told = [{"shard": int(a), "n": int(counts[a])} for a in np.flatnonzero(counts)]
        return pd.DataFrame({"dim": [dim], "shard": [here], "full": [full], "visits": [told], "data": [pickle.dumps(s, protocol=5)], "own": [pickle.dumps(s.own, protocol=5)]})

    placed = classes.mapInPandas(assign, "dim int, shard bigint, vec binary, ids array<bigint>").groupBy("dim", "shard")
    held = Written(placed.applyInPandas(settle, "dim int, shard bigint, full bigint, visits array<struct<shard: bigint, n: bigint>>, data binary, own binary"), "shards").df

    def leave(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, here, data in zip(b["dim"], b["shard"], b["own"]):
                raw, ids, reach, _ = own = pickle.loads(data)
                for rows, to in away(own, dim, here):
                    for at in range(0, len(rows), 10_000):
                        row = rows[at : at + 10_000]
                        yield pd.DataFrame({"dim": np.int32(dim), "shard": to[at : at + 10_000], "cid": [ids[r][0] for r in row], "vec": [raw[r].tobytes() for r in row], "reach": reach[row]})

    def search(shard: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(queries) and len(shard):
            s = pickle.loads(shard["data"].iloc[0])
            for at in range(0, len(queries), AT_ONCE):
                part = queries.iloc[at : at + AT_ONCE]
                x = unit(np.frombuffer(b"".join(part["vec"]), dtype=np.float32).reshape(len(part), -1))
                places, sims = s.tree.search(x, k, factor, within=part["reach"].to_numpy())
                for cid, near in zip(part["cid"], s.items(places, sims, k)):
                    rows += [(cid, far, i) for far, i in near]
        return pd.DataFrame(rows, columns=["cid", "far", "id"]).astype({"cid": "int64", "far": "float64", "id": "int64"})

    def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data in b["own"]:
                _, ids, _, found = pickle.loads(data)
                for at in range(0, len(ids), 10_000):
                    near = [[{"far": d, "id": i} for d, i in n] for n in found[at : at + 10_000]]
                    yield pd.DataFrame({"cid": [i[0] for i in ids[at : at + 10_000]], "ids": ids[at : at + 10_000], "near": near})

    # One row a shard; a shard with more visits than a block holds is copied to several.
    blocks = held.select("dim", F.explode("visits").alias("v")).groupBy("dim", "v.shard").agg(F.ceil(F.sum("v.n") / QUERIES_AT_ONCE).alias("blocks"))
    visits = held.select("dim", "shard", "own").mapInPandas(leave, "dim int, shard bigint, cid bigint, vec binary, reach double")
    visits = visits.join(F.broadcast(blocks), ["dim", "shard"]).select("dim", "shard", F.pmod(F.xxhash64("cid"), F.col("blocks")).alias("block"), "cid", "vec", "reach")
    index = held.join(blocks, ["dim", "shard"]).select("dim", "shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"), "data")
    index = index.select(*[F.col(c).alias(c) for c in index.columns])  # columns of their own
    keys = ["dim", "shard", "block"]
    crossed = index.groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInPandas(search, "cid bigint, far double, id bigint")
    crossed = crossed.groupBy("cid").agg(F.collect_list(F.struct("far", "id")).alias("more"))
    home = held.select("own").mapInPandas(tell, "cid bigint, ids array<bigint>, near array<struct<far: double, id: bigint>>")
    others = F.transform(F.slice(F.sort_array(F.concat("near", F.coalesce("more", F.array().cast("array<struct<far: double, id: bigint>>")))), 1, k), lambda x: x["id"])
    told = home.join(crossed, "cid", "left").select("ids", others.alias("others")).select(F.explode("ids").alias("item_id"), "ids", "others")
    # Items of one vector come first to each other.
    found = [told.select("item_id", F.slice(F.concat(F.filter("ids", lambda i: i != F.col("item_id")), F.col("others")), 1, k).alias("neighbours"))]
    if held.agg(F.coalesce(F.sum("full"), F.lit(0))).first()[0]:
        full = classes.filter(F.size("ids") > k + 1).select("vec", F.slice("ids", 1, k + 1).alias("ids"))
        rest = skew_safe_lookup(v, "vec", full, ["ids"]).filter(F.col("ids").isNotNull() & ~F.array_contains("ids", F.col("item_id")))
        found.append(rest.select("item_id", F.slice("ids", 1, k).alias("neighbours")))
    return union_all(found)


def _usable(spark: SparkSession, data: str) -> DataFrame:
    return table(spark, data, "preprocess_results").select("item_id", "hist_feat").filter(F.size("hist_feat").isin(24, 48))


def p7_found(spark: SparkSession, data: str) -> DataFrame:
    """Pairs of items of which one is among the other's five most similar."""
    near = nearest(_usable(spark, data)).select("item_id", F.explode("neighbours").alias("other"))
    return near.select(F.least("item_id", "other").alias("item_lo"), F.greatest("item_id", "other").alias("item_hi")).distinct()


def p7_neighbours(spark: SparkSession, data: str) -> DataFrame:
    """The five most similar items of each item, by rank."""
    return nearest(_usable(spark, data)).select("item_id", F.posexplode("neighbours").alias("rank", "other_id"))


QUERIES = {"p7_found": p7_found, "p7_neighbours": p7_neighbours}

_RANKED = """
with v as (select item_id, max(hist_feat)::double[] as h from preprocess_results where len(hist_feat) in (24, 48) and item_id is not null
    and len(list_filter(hist_feat, lambda x: x is null or isnan(x))) = 0 and len(list_filter(hist_feat, lambda x: x <> 0)) > 0 group by item_id),
p as (select a.item_id as a, b.item_id as b, row_number() over (partition by a.item_id
    order by case when a.h = b.h then 1 else list_cosine_similarity(a.h, b.h) end desc, b.item_id) as k
  from v a join v b on a.item_id <> b.item_id and len(a.h) = len(b.h))"""

ORACLE = {
    "p7_found": _RANKED + " select distinct least(a, b) as item_lo, greatest(a, b) as item_hi from p where k <= 5",
    "p7_neighbours": _RANKED + " select a as item_id, (k - 1)::int as rank, b as other_id from p where k <= 5",
}
