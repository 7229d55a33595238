"""Near-duplicate joins of 64-bit perceptual hashes.

Two hashes that differ in at most T bits differ, in at least one of m pieces, by no
more than that piece's share of T. Hashes are cut into blocks, and each pair of blocks
is a task: it sorts one block by each piece and looks up the other's pieces with every
pattern of so few bits (``near_plan`` takes the m that costs least for the size of a
block). A task holds two blocks, whatever the number of hashes, and the plan has no
expression for each pattern. The lossy mode, an equality join on four 16-bit pieces,
finds all pairs up to three bits, and others by luck.

Equal hashes are one vertex, so copies never meet each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from darkslide.operators.blocks import bit_distances
from darkslide.operators.graph import connected_components
from darkslide.operators.shared import Written
from darkslide.operators.skew import skew_safe_lookup

VALID = "^[0-9A-Fa-f]{16}$"


def hash_bits(hex_digits: str | Column) -> Column:
    """The 64 bits of 16 hex digits as a bigint; null for anything else."""
    c = F.col(hex_digits) if isinstance(hex_digits, str) else hex_digits
    high, low = F.conv(F.substring(c, 1, 8), 16, 10).cast("bigint"), F.conv(F.substring(c, 9, 8), 16, 10).cast("bigint")
    return F.when(c.rlike(VALID), F.shiftleft(high, 32).bitwiseOR(low))


def distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


#: Hashes of a block at most, and those below which a block is not cut further.
BLOCK, LEAST = 1 << 20, 1 << 14
#: Nanoseconds of a lookup and of a comparison, and comparisons at a time.
LOOKUP, COMPARE, AT_ONCE = 15, 7, 1 << 17


def _pieces(m: int) -> list[tuple[int, int]]:
    """First bit and width of m pieces of 64 bits, as even as can be."""
    edges = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def near_plan(n: int, threshold: int) -> list[tuple[int, int, int]]:
    """(first bit, width, bits that may differ) of the pieces by which two blocks of n hashes are compared.

    The allowances and one for each piece add up to threshold + 1, so a pair that
    exceeds all of them exceeds the threshold. A piece of -1 bits is not looked up.
    """
    def plan(m: int) -> list[tuple[int, int, int]]:
        share, more = divmod(threshold + 1, m)
        return [(a, w, min(w, share - 1 + (i < more))) for i, (a, w) in enumerate(_pieces(m))]

    def cost(m: int) -> float:
        return sum(sum(comb(w, k) for k in range(r + 1)) * (n * LOOKUP + n * n / 2**w * COMPARE) for _, w, r in plan(m))

    return plan(min(range(3, max(3, min(threshold + 1, 16)) + 1), key=cost))


def _near_in_blocks(left: np.ndarray, right: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of the two blocks (uint64, distinct in each) within ``threshold`` bits, each once, in bounded portions."""
    if threshold >= 32 or len(left) * len(right) <= 1 << 20:
        step = max(1, AT_ONCE // max(1, len(right)))
        for at in range(0, len(left), step):
            i, j = np.nonzero(bit_distances(left[at : at + step], right) <= threshold)
            yield left[at + i], right[j]
        return
    plan = near_plan(max(len(left), len(right)), threshold)
    piece = lambda h, a, w: ((h >> np.uint64(a)) & np.uint64((1 << w) - 1)).astype(np.int64)
    for p, (a, w, r) in enumerate(plan):
        q, x = (h[np.argsort(piece(h, a, w))] for h in (left, right))
        mine, start = piece(q, a, w).astype(np.int32), np.searchsorted(piece(x, a, w), np.arange((1 << w) + 1)).astype(np.int32)
        for pattern in (sum(1 << k for k in bits) for n in range(r + 1) for bits in combinations(range(w), n)):
            for begin in range(0, len(q), AT_ONCE):
                to = mine[begin : begin + AT_ONCE] ^ pattern
                first = start[to]
                count = start[to + 1] - first
                some = np.flatnonzero(count)
                first, count = first[some], count[some]
                total = np.cumsum(count)
                # Portions of about AT_ONCE comparisons; a row of the block is never cut.
                cuts = [0, *np.searchsorted(total, np.arange(AT_ONCE, total[-1], AT_ONCE)), len(some)] if len(some) else []
                for lo, hi in zip(cuts, cuts[1:]):
                    if lo == hi:
                        continue
                    c, t = count[lo:hi], total[lo:hi]
                    b = x[np.arange(t[-1] - t[0] + c[0]) + np.repeat(first[lo:hi] - (t - c - (t[0] - c[0])), c)]
                    u = np.repeat(q[begin + some[lo:hi]], c)
                    hit = np.flatnonzero(np.bitwise_count(u ^ b) <= threshold)
                    u, b = u[hit], b[hit]
                    # Pairs that an earlier piece has found are not told again.
                    new = np.ones(len(u), dtype=bool)
                    for a2, w2, r2 in plan[:p]:
                        new &= np.bitwise_count(piece(u ^ b, a2, w2)) > r2
                    yield u[new], b[new]


def _by_blocks(h: DataFrame, n: int, threshold: int) -> DataFrame:
    """Pairs of the ``n`` distinct hashes ``h``; a task for each pair of blocks."""
    few = math.ceil(2 * math.sqrt(h.sparkSession.sparkContext.defaultParallelism))  # blocks that keep all cores busy
    blocks = max(1, -(-n // BLOCK), min(few, -(-n // LEAST)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: dict[int, list[np.ndarray]] = {0: [], 1: []}
        same = True
        for batch in batches:
            hashes, side = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            for k in sides:
                sides[k].append(hashes[side == k])
            same &= not (side == 1).any()
        left = np.concatenate([np.zeros(0, np.uint64), *sides[0]])
        right = left if same else np.concatenate(sides[1])
        for u, v in _near_in_blocks(left, right, threshold):
            u, v = u.view(np.int64), v.view(np.int64)
            if same:
                u, v = u[u < v], v[u < v]
            if len(u):
                d = np.bitwise_count(u.view(np.uint64) ^ v.view(np.uint64)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v)), pa.array(d)], names=["a", "b", "distance"])

    # Block y meets itself, as side 0, and each block before it, which is side 0 then; pairs have numbers y (y + 1) / 2 + x.
    own = F.pmod(F.xxhash64("h"), F.lit(blocks)).cast("int")
    meets = h.select("h", own.alias("x"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("y"))
    high, low = F.greatest("x", "y"), F.least("x", "y")
    number = (F.shiftright(high * (high + 1), 1) + low).cast("int")
    tasks = meets.select("h", (F.col("x") > F.col("y")).cast("int").alias("side"), number.alias("task"))
    return tasks.repartitionById(blocks * (blocks + 1) // 2, "task").select("h", "side").mapInArrow(run, "a bigint, b bigint, distance int")


def hamming_pairs(hashes: DataFrame, threshold: int, exact: bool = True) -> DataFrame:
    """(a, b, distance) of different ``hashes`` (h bigint) within ``threshold`` bits, a < b.

    Nulls match nothing. Not exact: pairs that share one of four 16-bit pieces only. The
    exact result reads a table in the shared folder.
    """
    h = hashes.select("h").dropna().distinct()
    if exact:
        w = Written(h, "hashes", rows=F.count("*"))
        return _by_blocks(w.df, w.stats["rows"], threshold)
    piece = [F.shiftrightunsigned("h", a).bitwiseAND(F.lit((1 << w) - 1)) for a, w in _pieces(4)]
    keyed = h.select("h", F.posexplode(F.array(*piece)).alias("i", "k"))
    left, right = keyed.select(F.col("h").alias("a"), "i", "k"), keyed.select(F.col("h").alias("b"), "i", "k")
    met = left.join(right, ["i", "k"]).filter((F.col("a") < F.col("b")) & (distance("a", "b") <= threshold))
    return met.select("a", "b", distance("a", "b").alias("distance")).distinct()


#: Query hashes, at most, that are sent to all tasks at a time.
QUERIES_AT_ONCE = 50_000


def distance_counts(queries: DataFrame, hashes: DataFrame) -> DataFrame:
    """(query, counts): of each row (query, h) how many rows of ``hashes`` (h) lie at each distance from 0 to 64.

    Queries are a stated set and go through all hashes in blocks of bounded size; every
    task adds up its own counts. Null hashes are at no distance.
    """
    q = queries.filter("query is not null and h is not null").select("query", "h").distinct()
    blocks = max(1, -(-q.count() // QUERIES_AT_ONCE))
    found = []
    for b in range(blocks):
        rows = q.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).toPandas().sort_values(["query", "h"])
        ids, bits = rows["query"].to_numpy(np.int64), rows["h"].to_numpy(np.int64)

        def run(batches: Iterator[pd.DataFrame], ids=ids, bits=bits) -> Iterator[pd.DataFrame]:
            counts = np.zeros((len(bits), 65), dtype=np.int64)
            for batch in batches:
                h = batch["h"].to_numpy(np.int64)
                for at in range(0, len(bits), 1024):
                    d = bit_distances(bits[at : at + 1024], h) + np.arange(len(bits[at : at + 1024]))[:, None] * 65
                    counts[at : at + 1024] += np.bincount(d.ravel(), minlength=65 * len(bits[at : at + 1024])).reshape(-1, 65)
            yield pd.DataFrame({"query": ids, "counts": list(counts)})

        found.append(hashes.select("h").dropna().mapInPandas(run, "query bigint, counts array<bigint>"))
    parts = reduce(DataFrame.unionByName, found).groupBy("query").agg(*[F.sum(F.col("counts")[d]).alias(f"d{d}") for d in range(65)])
    return parts.select("query", F.array(*[f"d{d}" for d in range(65)]).alias("counts"))


def counted_statistics(counts: Column) -> dict[str, Column]:
    """Number, least, greatest, mean, median and deviation of the distances that ``counts`` counts."""
    d = F.sequence(F.lit(0), F.lit(64))
    add = lambda x: F.aggregate(x, F.lit(0).cast("bigint"), lambda a, v: a + v)
    n, total = add(counts), add(F.zip_with(counts, d, lambda c, k: c * k))
    squares = add(F.zip_with(counts, d, lambda c, k: c * k * k))
    mean = total / n
    # The least distance at or below which there are more than so many.
    below = lambda rank: F.array_position(F.transform(d, lambda k: add(F.slice(counts, 1, k + 1)) > rank), True) - 1
    median = (below(F.floor((n - 1) / 2)) + below(F.floor(n / 2))) / 2
    seen = F.filter(d, lambda k: F.get(counts, k) > 0)
    return {"n": n, "least": F.array_min(seen), "greatest": F.array_max(seen), "mean": mean, "median": median, "deviation": F.sqrt(F.greatest(F.lit(0.0), squares / n - mean * mean))}


def near_duplicate_groups(items: DataFrame, threshold: int = 8, exact: bool = True, keep: Sequence[str] = ()) -> DataFrame:
    """(item_id, ``keep``, group_root) of ``items`` (item_id, h): root is the smallest item linked by chains of near hashes.

    Items without a hash are groups of their own, as are items near no other. The result
    reads tables in the shared folder.
    """
    i = items.select(*dict.fromkeys(["item_id", "h", *keep])).filter("item_id is not null").distinct()
    named = Written(i.filter("h is not null").groupBy("h").agg(F.min("item_id").alias("first"), F.count("*").alias("n")), "hashes").df
    pairs = hamming_pairs(named.select("h"), threshold, exact)
    a, b = named.select(F.col("h").alias("a"), F.col("first").alias("u")), named.select(F.col("h").alias("b"), F.col("first").alias("v"))
    roots = connected_components(pairs.join(a, "a").join(b, "b").select("u", "v")).select(F.col("item").alias("first"), "root")
    rooted = named.join(roots, "first", "left").select("h", "n", F.coalesce("root", "first").alias("root"))
    # Items without a hash, and those of a common one, are spread.
    return skew_safe_lookup(i, "h", rooted, ["root"], "n").select("item_id", *keep, F.coalesce("root", "item_id").alias("group_root"))
