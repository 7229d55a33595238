"""Queries of sessions, bursts, near-duplicate groups and best picks over the catalogue."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from darkslide.operators.blocks import bit_distances, by_size, forest, in_blocks
from darkslide.operators.graph import connected_components
from darkslide.operators.hamming import counted_statistics, distance, distance_counts, hamming_pairs, hash_bits, near_duplicate_groups
from darkslide.operators.photos import clean_camera, current_photos, epoch_us
from darkslide.operators.sequence import dense_index, gap_ids
from darkslide.operators.shared import Written
from darkslide.operators.skew import first_rows, skew_safe_lookup
from darkslide.sources.tables import table

SESSION_US, BURST_US, NEAR_BITS, MERGE_BITS = 600_000_000, 15_000_000, 8, 30


def items(spark: SparkSession, data: str) -> DataFrame:
    """Items, each once."""
    return table(spark, data, "image_items").dropDuplicates(["item_id"])


def photos(spark: SparkSession, data: str) -> DataFrame:
    p = current_photos(table(spark, data, "photo_metadata").select("filename", "row_id", "photo_ts", "camera_id", "ingested_at"))
    return p.select("filename", clean_camera("camera_id").alias("camera_id"), epoch_us("photo_ts").alias("us")).filter("us is not null")


def shots(spark: SparkSession, data: str) -> DataFrame:
    """Items with camera, instant, hash and score; those without an instant are left out."""
    i = items(spark, data).select("item_id", "filename", hash_bits("phash").alias("h"), _score().alias("score"), "group_id", "burst_id")
    return i.join(photos(spark, data), "filename")


def _score():
    return F.coalesce(F.when(~F.isnan("pick_score"), F.col("pick_score")), F.lit(0.5))


def w1_session_ids(spark, data):
    return gap_ids(photos(spark, data), "camera_id", "us", "filename", SESSION_US, "session_id").select("filename", "session_id")


def w2_burst_ids(spark, data):
    return gap_ids(photos(spark, data), "camera_id", "us", "filename", BURST_US, "burst_id").select("filename", "burst_id")


def w3_burst_ids_as_coded(spark, data):
    return gap_ids(photos(spark, data), "camera_id", "us", "filename", BURST_US, "burst_id", split_keys=False).select("filename", "burst_id")


def w4_best_pick(spark, data):
    s = shots(spark, data).filter("group_id is not null and group_id <> -1")
    return first_rows(s, ["group_id"], [F.desc("score"), F.asc("us"), F.asc("item_id")], 1).select("group_id", "item_id")


def a1_group_size(spark, data):
    i = items(spark, data).filter("group_id is not null and group_id <> -1").select("item_id", "group_id")
    sizes = i.groupBy("group_id").agg(F.count("*").alias("group_size"))
    return i.join(sizes, "group_id").select("item_id", "group_size")


def a2_counts(spark, data):
    i = items(spark, data)
    return i.agg(
        F.countDistinct("session_id").alias("sessions"), F.countDistinct("burst_id").alias("bursts"), F.countDistinct("group_id").alias("groups"),
        F.count_if("is_group_best").alias("best"), F.count("*").alias("items"),
    )


def a3_group_start(spark, data):
    return shots(spark, data).filter("group_id is not null and group_id <> -1").groupBy("group_id").agg(F.min("us").alias("first_us"))


def _query_distances(spark, data):
    """Distances of the items whose id is divisible by 100 to all items, themselves included."""
    i = items(spark, data).select("item_id", hash_bits("phash").alias("h"))
    return distance_counts(i.filter("item_id % 100 = 0").select(F.col("item_id").alias("query"), "h"), i)


def j8_distances(spark, data):
    """Of each item whose id is divisible by 100: number, least, greatest, mean, median and deviation of its distances to all items."""
    s = counted_statistics(F.col("counts"))
    return _query_distances(spark, data).select(
        F.col("query").alias("item_id"), s["n"].alias("n"), s["least"].alias("least"), s["greatest"].alias("greatest"), *[F.round(s[k], 6).alias(k) for k in ("mean", "median", "deviation")])


def a20_distance_histogram(spark, data):
    """How many of these distances there are of each size."""
    c = _query_distances(spark, data).select(F.posexplode("counts").alias("distance", "n"))
    return c.groupBy("distance").agg(F.sum("n").alias("pairs")).filter("pairs > 0")


def a21_degrees(spark, data):
    """The twenty hashes with most others within 12 bits."""
    h = items(spark, data).select(hash_bits("phash").alias("h")).dropna().distinct()
    p = hamming_pairs(h, 12)
    ends = p.select(F.explode(F.array("a", "b")).alias("h"))
    return ends.groupBy("h").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "h").limit(20)


def a26_days(spark, data):
    day = F.expr("cast(us div 86400000000 as int)")
    return photos(spark, data).groupBy(day.alias("day")).agg(F.count("*").alias("n"), F.countDistinct("camera_id").alias("cameras")).orderBy(F.desc("n"), "day").limit(10)


def a26_sessions_nested(spark, data):
    """Each session with its first day, photos, bursts and photos of its largest burst."""
    p = Written(gap_ids(photos(spark, data), "camera_id", "us", "filename", SESSION_US, "session_id"), "sessions").df
    p = gap_ids(p, "camera_id", "us", "filename", BURST_US, "burst_id")
    bursts = p.groupBy("session_id", "burst_id").agg(F.count("*").alias("n"), F.min("us").alias("us"))
    return bursts.groupBy("session_id").agg(F.expr("cast(min(us) div 86400000000 as int)").alias("day"), F.sum("n").alias("photos"), F.count("*").alias("bursts"), F.max("n").alias("largest"))


def g8_network_degrees(spark, data):
    """Of each item whose id is divisible by 100: how many other items lie within 30 bits."""
    near = F.aggregate(F.slice("counts", 1, MERGE_BITS + 1), F.lit(0).cast("bigint"), lambda a, n: a + n) - 1
    return _query_distances(spark, data).select(F.col("query").alias("item_id"), near.alias("degree"))


def g2_near_duplicates(spark, data):
    return near_duplicate_groups(items(spark, data).select("item_id", hash_bits("phash").alias("h")), NEAR_BITS)


def g2_near_duplicates_lossy(spark, data):
    return near_duplicate_groups(items(spark, data).select("item_id", hash_bits("phash").alias("h")), NEAR_BITS, exact=False)


def g3_equal_hash_groups(spark, data):
    i = items(spark, data).select("item_id", hash_bits("phash").alias("h"))
    first = i.filter("h is not null").groupBy("h").agg(F.min("item_id").alias("first"), F.count("*").alias("n"))
    return skew_safe_lookup(i, "h", first, ["first"], "n").select("item_id", F.coalesce("first", "item_id").alias("group_root"))


#: Rows of a burst, at most, that are compared by shifting them against each other, and those that one task compares.
SHIFTED, TOGETHER = 16, 1 << 15


def _burst_merge(groups: DataFrame) -> DataFrame:
    """Groups that share a burst and come within MERGE_BITS of each other become one: (item_id, group_root).

    ``groups`` (item_id, group_root, h, burst) is a written table.
    """
    g = groups.filter("h is not null and burst is not null").select(F.col("burst").cast("bigint").alias("burst"), "group_root", "h").distinct()
    large = Written(g.groupBy("burst").agg(F.count("*").alias("n")).filter(F.col("n") > TOGETHER), "bursts", rows=F.count("*"))
    few = g.join(F.broadcast(large.df), "burst", "left_anti") if large.stats["rows"] else g
    links = few.repartition("burst").sortWithinPartitions("burst").mapInArrow(_tie_bursts, "u bigint, v bigint")
    if large.stats["rows"]:
        many = g.join(F.broadcast(large.df.select("burst", F.ceil(F.col("n") / TOGETHER).alias("__blocks"))), "burst")
        links = links.unionByName(in_blocks(many, "burst", _close_groups, "u bigint, v bigint"))
    roots = connected_components(links).select(F.col("item").alias("group_root"), "root")
    return groups.join(roots, "group_root", "left").select("item_id", F.coalesce("root", "group_root").alias("group_root"))


def _chained(h: np.ndarray) -> np.ndarray:
    """For each hash the place of one that chains of hashes within MERGE_BITS tie it to, the same one for all of a chain.

    Hashes found are not compared again with each other, so work seldom grows with the square:
    no more than a few hundred hashes can be further apart than MERGE_BITS, each from each.
    """
    to, rest = np.arange(len(h)), np.arange(len(h))
    while len(rest):
        first, rest = rest[0], rest[1:]
        found = [np.array([first])]
        while found and len(rest):
            now = found.pop()
            step = max(1, (1 << 19) // len(rest))
            if len(now) > step:
                found.append(now[step:])
            near = (bit_distances(h[now[:step]], h[rest]) <= MERGE_BITS).any(axis=0)
            if near.any():
                found.append(rest[near])
                to[rest[near]] = first
                rest = rest[~near]
    return to


def _tied(burst: np.ndarray, group: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links to the least group of what the bursts of these rows, which are sorted by burst, tie together."""
    start = np.flatnonzero(np.r_[True, burst[1:] != burst[:-1]])
    n = np.diff(np.r_[start, len(burst)])
    us, vs = [], []
    k = np.flatnonzero(np.repeat(n <= SHIFTED, n))
    for d in range(1, min(SHIFTED, len(burst))):
        k = k[k + d < len(burst)]
        k = k[burst[k] == burst[k + d]]
        near = k[np.bitwise_count((h[k] ^ h[k + d]).view(np.uint64)) <= MERGE_BITS]
        us, vs = [*us, group[near]], [*vs, group[near + d]]
    for at, size in zip(start[n > SHIFTED], n[n > SHIFTED]):
        own = group[at : at + size]
        us, vs = [*us, own], [*vs, own[_chained(h[at : at + size])]]
    return forest(np.concatenate(us), np.concatenate(vs)) if us else (group[:0], group[:0])


def _tie_bursts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of the bursts of a partition sorted by burst; a burst that goes on in the next batch waits for it."""
    held: list[tuple[np.ndarray, ...]] = []

    def links() -> Iterator[pa.RecordBatch]:
        u, v = _tied(*map(np.concatenate, zip(*held)))
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    for batch in batches:
        rows = tuple(c.to_numpy() for c in batch.columns)
        if not len(rows[0]):
            continue
        last = np.searchsorted(rows[0], rows[0][-1])
        if last or held and held[-1][0][-1] != rows[0][0]:
            held.append(tuple(c[:last] for c in rows))
            yield from links()
            held = []
        held.append(tuple(c[last:] for c in rows))
    if held:
        yield from links()


def _close_groups(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """What ties the groups of two blocks of a burst together, as links to the least group."""
    both = pd.concat([left, right]).drop_duplicates(["group_root", "h"])
    g, h = both["group_root"].to_numpy(np.int64), both["h"].to_numpy(np.int64)
    u, v = forest(g, g[_chained(h)])
    return pd.DataFrame({"u": u, "v": v})


def g4_burst_merge(spark, data):
    s = items(spark, data).select("item_id", hash_bits("phash").alias("h"), F.when(F.col("burst_id") != -1, F.col("burst_id")).alias("burst"))
    return _burst_merge(Written(near_duplicate_groups(Written(s, "items").df, NEAR_BITS, keep=["h", "burst"]), "groups").df)


def g6_prefix_groups(spark, data):
    i = items(spark, data).filter("filename is not null")
    stem = F.regexp_replace("filename", r"\.[^.]*$", "")
    prefix = F.regexp_replace(stem, r"[_-]?\d+$", "")
    first = i.groupBy(prefix.alias("prefix")).agg(F.min("item_id").alias("group_root"), F.count("*").alias("n"))
    return i.select("item_id", prefix.alias("prefix")).join(first, "prefix").select("item_id", "prefix", "group_root", "n")


def g7_grouping(spark, data):
    """The whole pipeline: session, burst, group after burst merge, size, best and score of every shot."""
    s = Written(shots(spark, data).select("item_id", "camera_id", "us", "h", "score"), "shots").df
    s = gap_ids(s, "camera_id", "us", "item_id", SESSION_US, "session_id")
    s = Written(gap_ids(s, "camera_id", "us", "item_id", BURST_US, "burst_id", split_keys=False), "shots").df
    merged = _burst_merge(Written(near_duplicate_groups(s.withColumnRenamed("burst_id", "burst"), NEAR_BITS, keep=["h", "burst"]), "groups").df)
    g = Written(s.join(merged, "item_id"), "grouped").df
    best = first_rows(g.select("group_root", "item_id", "score", "us"), ["group_root"], [F.desc("score"), F.asc("us"), F.asc("item_id")], 1)
    sizes = g.groupBy("group_root").agg(F.count("*").alias("group_size"))
    top = best.select("group_root", F.col("item_id").alias("best_id"))
    return g.join(sizes, "group_root").join(top, "group_root").select(
        "item_id", "session_id", "burst_id", F.col("group_root").alias("group_id"), "group_size", (F.col("item_id") == F.col("best_id")).alias("is_group_best"), F.col("score").alias("pick_score"))


def _spread_of(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Per pair of kinds of two blocks: least, greatest and sum of the distances of their hashes, and their number."""
    left, right = left.sort_values("kind"), right.sort_values("kind")
    (x, i), (y, j) = (np.unique(f["kind"].to_numpy(np.int64), return_index=True) for f in (left, right))
    d = bit_distances(left["h"].to_numpy(np.int64), right["h"].to_numpy(np.int64))
    least, greatest, total = (f.reduceat(f.reduceat(m, i, axis=0), j, axis=1).ravel() for f, m in ((np.minimum, d), (np.maximum, d), (np.add, d.astype(np.int32))))
    n = np.outer(np.diff(np.r_[i, len(left)]), np.diff(np.r_[j, len(right)])).ravel()
    a, b = np.repeat(x, len(y)), np.tile(y, len(x))
    out = {"key": left["key"].iloc[0], "g1": np.minimum(a, b), "g2": np.maximum(a, b), "least": least, "greatest": greatest, "total": total, "pairs": n}
    return pd.DataFrame(out).astype("int64")


_SPREAD = "key bigint, g1 bigint, g2 bigint, least bigint, greatest bigint, total bigint, pairs bigint"


def _wide(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Of one kind: pairs of different hashes, each once, although a block meets itself both ways."""
    h, k = np.sort(left["h"].to_numpy(np.int64)), right["h"].to_numpy(np.int64)
    same = len(h) == len(k) and (h == np.sort(k)).all()
    least, greatest, total = 64, 0, 0
    for at in range(0, len(h), 512):
        d = bit_distances(h[at : at + 512], k)
        total += int(d.sum())
        greatest = max(greatest, int(d.max()))
        least = min(least, int(d[d > 0].min()) if (d > 0).any() else 64)
    pairs = len(h) * (len(h) - 1) // 2 if same else len(h) * len(k)
    if not pairs:
        return pd.DataFrame([], columns=["key", "g1", "g2", "least", "greatest", "total", "pairs"]).astype("int64")
    return pd.DataFrame([(int(left["key"].iloc[0]), 0, 0, least, greatest, total // (2 if same else 1), pairs)], columns=["key", "g1", "g2", "least", "greatest", "total", "pairs"])


def g9_wide_groups(spark, data):
    """Stored groups whose hashes lie further apart than they should, with least and greatest distance."""
    g = items(spark, data).filter("group_id is not null and group_id <> -1").select(F.col("group_id").alias("key"), hash_bits("phash").alias("h")).dropna().distinct()
    few, many = by_size(g, "key")
    pairs = few.select("key", F.col("h").alias("a")).join(few.select("key", F.col("h").alias("b")), "key").filter("a < b")
    d = distance("a", "b").cast("bigint")
    found = pairs.groupBy("key").agg(F.min(d).alias("least"), F.max(d).alias("greatest"), F.count("*").alias("pairs"))
    found = found.unionByName(in_blocks(many, "key", _wide, _SPREAD).select("key", "least", "greatest", "pairs"))
    found = found.groupBy(F.col("key").alias("group_id")).agg(F.min("least").cast("int").alias("least"), F.max("greatest").cast("int").alias("greatest"), F.sum("pairs").alias("pairs"))
    return found.filter(f"greatest > {NEAR_BITS}")


def j9_group_distances(spark, data):
    """Within a stored burst, distances between its stored groups."""
    g = items(spark, data).filter("group_id <> -1 and burst_id <> -1").select(F.col("burst_id").alias("key"), F.col("group_id").alias("kind"), hash_bits("phash").alias("h")).dropna().distinct()
    few, many = by_size(g, "key")
    a = few.select("key", F.col("kind").alias("g1"), F.col("h").alias("a"))
    b = few.select("key", F.col("kind").alias("g2"), F.col("h").alias("b"))
    d = distance("a", "b").cast("bigint")
    found = a.join(b, "key").filter("g1 < g2").groupBy("key", "g1", "g2").agg(F.min(d).alias("least"), F.sum(d).alias("total"), F.count("*").alias("pairs"))
    # A block with itself has each pair of kinds both ways.
    blocks = in_blocks(many, "key", _kinds_apart, _SPREAD).select("key", "g1", "g2", "least", "total", "pairs")
    found = found.unionByName(blocks).groupBy(F.col("key").alias("burst_id"), "g1", "g2").agg(F.min("least").cast("int").alias("least"), F.sum("total").alias("total"), F.sum("pairs").alias("pairs"))
    return found.select("burst_id", "g1", "g2", "least", F.round(F.col("total") / F.col("pairs"), 6).alias("mean"), "pairs")


def _kinds_apart(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    found = _spread_of(left, right)
    found = found[found["g1"] != found["g2"]]
    rows = lambda f: sorted(zip(f["kind"], f["h"]))
    if len(left) == len(right) and rows(left) == rows(right):  # each pair of kinds came both ways
        found = found.drop_duplicates(["g1", "g2"])
    return found


def g10_why_separate(spark, data):
    """Neighbouring shots of one stored burst in different groups: time gap, camera and distance between them."""
    s = shots(spark, data).filter("group_id <> -1 and burst_id <> -1")
    w = Window.partitionBy("burst_id").orderBy("us", "item_id")
    cols = [F.lag(c).over(w).alias(f"prev_{c}") for c in ("item_id", "group_id", "us", "camera_id", "h")]
    s = s.select("burst_id", "item_id", "group_id", "us", "camera_id", "h", *cols).filter("group_id <> prev_group_id")
    return s.select("burst_id", F.col("prev_item_id").alias("item_a"), F.col("item_id").alias("item_b"), (F.col("us") - F.col("prev_us")).alias("gap_us"),
                    (F.col("camera_id") == F.col("prev_camera_id")).alias("same_camera"), distance("h", "prev_h").alias("distance"))


def j15_shared_bursts(spark, data):
    """Pairs of stored groups that have a burst in common, and how many."""
    g = items(spark, data).filter("group_id <> -1 and burst_id <> -1").select("burst_id", "group_id").distinct()
    a, b = g.select("burst_id", F.col("group_id").alias("g1")), g.select("burst_id", F.col("group_id").alias("g2"))
    return a.join(b, "burst_id").filter("g1 < g2").groupBy("g1", "g2").agg(F.count("*").alias("bursts"))


def o1_by_uncertainty(spark, data):
    """All items by uncertainty, with their place."""
    p = F.when(F.col("pick_score").isNotNull() & ~F.isnan("pick_score"), F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), F.col("pick_score"))))
    u = F.round(F.coalesce(-(p * F.log2(p) + (1 - p) * F.log2(1 - p)), F.lit(1.0)), 6)
    return dense_index(items(spark, data).select("item_id", "filename", u.alias("uncertainty")), [F.desc("uncertainty"), F.desc_nulls_last("filename"), F.asc("item_id")], "at")


def o2_by_group(spark, data):
    """All shots in the order of their groups' first instants, then by score, with their place."""
    s = shots(spark, data).withColumn("g", F.when(F.col("group_id") != -1, F.col("group_id")))
    first = s.filter("g is not null").groupBy("g").agg(F.min("us").alias("group_us"), F.count("*").alias("n"))
    s = skew_safe_lookup(s, "g", first, ["group_us"], "n").withColumn("group_us", F.coalesce("group_us", "us"))
    return dense_index(s.select("item_id", "filename", "group_us", "score"), [F.asc("group_us"), F.desc("score"), F.asc("filename"), F.asc("item_id")], "at")


def o5_top_groups(spark, data):
    i = items(spark, data).filter("group_id is not null and group_id <> -1")
    return i.groupBy("group_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "group_id").limit(15)


def o11_sample(spark, data):
    """Every k-th item by id, k such that about 200 are taken."""
    i = items(spark, data).select("item_id")
    k = max(1, i.count() // 200)
    return dense_index(i, [F.asc("item_id")], "at").filter(F.col("at") % k == 0).select("item_id")


def o13_range(spark, data):
    """Items between two places of the display order, both included."""
    i = items(spark, data).filter("filename is not null").select("filename", "item_id")
    return dense_index(i, [F.asc("filename"), F.asc("item_id")], "at").filter("at between 40 and 90").select("item_id", "at")


def u4_sets(spark, data):
    """Bursts and groups that are stored, computed only for one kind of item, or for both."""
    i = items(spark, data)
    keep = i.filter("lower(trim(label)) = 'keep' and burst_id <> -1").select("burst_id").distinct()
    trash = i.filter("lower(trim(label)) = 'trash' and burst_id <> -1").select("burst_id").distinct()
    both = keep.intersect(trash).withColumn("found", F.lit("both"))
    return both.unionByName(keep.subtract(trash).withColumn("found", F.lit("keep"))).unionByName(trash.subtract(keep).withColumn("found", F.lit("trash")))


QUERIES = {f.__name__: f for f in (
    w1_session_ids, w2_burst_ids, w3_burst_ids_as_coded, w4_best_pick, a1_group_size, a2_counts, a3_group_start, j8_distances, a20_distance_histogram, a21_degrees,
    a26_days, a26_sessions_nested, g8_network_degrees, g2_near_duplicates, g2_near_duplicates_lossy, g3_equal_hash_groups, g4_burst_merge, g6_prefix_groups, g7_grouping, g9_wide_groups,
    j9_group_distances, g10_why_separate, j15_shared_bursts, o1_by_uncertainty, o2_by_group, o5_top_groups, o11_sample, o13_range, u4_sets,
)}

BASE = """
with recursive i as (select distinct on (item_id) * from image_items where item_id is not null),
ph as (select filename, coalesce(nullif(trim(regexp_replace(lower(camera_id), '\\s+', ' ', 'g')), ''), 'unknown') as camera_id, epoch_us(photo_ts) as us
  from (select *, row_number() over (partition by filename order by ingested_at desc nulls last, row_id desc) as k
        from photo_metadata where filename is not null) where k = 1 and photo_ts is not null),
hx as (select item_id, case when regexp_full_match(phash, '[0-9A-Fa-f]{16}') then ('0x' || phash)::ubigint end as h,
  coalesce(case when isnan(pick_score) then null else pick_score end, 0.5) as score from i),
sh as (select i.item_id, i.filename, h, score, group_id, burst_id, camera_id, us from i join hx using (item_id) join ph using (filename))"""

_RUNS = """
select filename, (sum(o) over (order by camera_id, us, filename rows unbounded preceding) - 1)::bigint as {name} from (
  select *, case when {first} or us - lag(us) over (order by camera_id, us, filename) > {gap} then 1 else 0 end as o from ph)"""
_CHANGED = "lag(camera_id) over (order by camera_id, us, filename) is distinct from camera_id"
_START = "row_number() over (order by camera_id, us, filename) = 1"

_PAIRS = """,
dh as (select distinct h from hx where h is not null),
pr as (select a.h as a, b.h as b, bit_count(xor(a.h, b.h)) as d from dh a join dh b on a.h < b.h and bit_count(xor(a.h, b.h)) <= {bits} {also})"""
_LOSSY = "and ((a.h & 65535) = (b.h & 65535) or ((a.h >> 16) & 65535) = ((b.h >> 16) & 65535) or ((a.h >> 32) & 65535) = ((b.h >> 32) & 65535) or (a.h >> 48) = (b.h >> 48))"
_NEAR = _PAIRS + """,
fs as (select h, min(item_id) as first from hx where h is not null group by h),
ed as (select x.first as u, y.first as v from pr join fs x on x.h = a join fs y on y.h = b union all select y.first, x.first from pr join fs x on x.h = a join fs y on y.h = b),
rc as (select u as x, u as r from ed union select ed.v, rc.r from rc join ed on ed.u = rc.x),
rt as (select x, min(r) as r from rc group by x),
gr as (select item_id, coalesce(rt.r, fs.first, item_id) as group_root from hx left join fs using (h) left join rt on rt.x = fs.first)"""
_MERGE = """,
gb as (select distinct burst_id as b, group_root, h from {shots} join gr using (item_id) where burst_id <> -1 and h is not null),
ce as (select distinct x.group_root as u, y.group_root as v from gb x join gb y using (b) where x.group_root <> y.group_root and bit_count(xor(x.h, y.h)) <= 30),
cr as (select u as x, u as r from ce union select ce.v, cr.r from cr join ce on ce.u = cr.x),
ct as (select x, min(r) as r from cr group by x)"""

ORACLE = {
    "w1_session_ids": BASE + _RUNS.format(name="session_id", first=_CHANGED, gap=SESSION_US),
    "w2_burst_ids": BASE + _RUNS.format(name="burst_id", first=_CHANGED, gap=BURST_US),
    "w3_burst_ids_as_coded": BASE + _RUNS.format(name="burst_id", first=_START, gap=BURST_US),
    "w4_best_pick": BASE + " select group_id, item_id from (select *, row_number() over (partition by group_id order by score desc, us, item_id) as k from sh where group_id <> -1) where k = 1",
    "a1_group_size": BASE + " select item_id, count(*) over (partition by group_id) as group_size from i where group_id <> -1",
    "a2_counts": BASE + " select count(distinct session_id) as sessions, count(distinct burst_id) as bursts, count(distinct group_id) as groups, count_if(is_group_best)::bigint as best, count(*) as items from i",
    "a3_group_start": BASE + " select group_id, min(us) as first_us from sh where group_id <> -1 group by group_id",
    "j8_distances": BASE + """ select a.item_id, count(*) as n, min(bit_count(xor(a.h, b.h)))::int as least, max(bit_count(xor(a.h, b.h)))::int as greatest, round(avg(bit_count(xor(a.h, b.h))), 6) as mean,
 round(median(bit_count(xor(a.h, b.h))::int), 6) as median, round(stddev_pop(bit_count(xor(a.h, b.h))), 6) as deviation from hx a join hx b on a.item_id % 100 = 0 and a.h is not null and b.h is not null group by 1""",
    "a20_distance_histogram": BASE + " select bit_count(xor(a.h, b.h))::int as distance, count(*) as pairs from hx a join hx b on a.item_id % 100 = 0 and a.h is not null and b.h is not null group by 1",
    "a21_degrees": BASE + _PAIRS.format(bits=12, also="") + """ select case when h >= 9223372036854775808 then (h::hugeint - 18446744073709551616)::bigint else h::bigint end as h, count(*) as degree
from (select a as h from pr union all select b from pr) group by h order by degree desc, 1 limit 20""",
    "a26_days": BASE + " select (us // 86400000000)::int as day, count(*) as n, count(distinct camera_id) as cameras from ph group by 1 order by n desc, day limit 10",
    "a26_sessions_nested": BASE + """, r as (select us, filename, camera_id, case when lag(camera_id) over w is distinct from camera_id or us - lag(us) over w > 600000000 then 1 else 0 end as so,
  case when lag(camera_id) over w is distinct from camera_id or us - lag(us) over w > 15000000 then 1 else 0 end as bo, row_number() over w as pos from ph window w as (order by camera_id, us, filename)),
n as (select us, (sum(so) over (order by pos) - 1)::bigint as session_id, sum(bo) over (order by pos) as b from r),
g as (select session_id, b, count(*) as n, min(us) as us from n group by 1, 2)
select session_id, (min(us) // 86400000000)::int as day, sum(n)::bigint as photos, count(*) as bursts, max(n) as largest from g group by 1""",
    "g8_network_degrees": BASE + " select a.item_id, count_if(bit_count(xor(a.h, b.h)) <= 30)::bigint - 1 as degree from hx a join hx b on a.item_id % 100 = 0 and a.h is not null and b.h is not null group by 1",
    "g2_near_duplicates": BASE + _NEAR.format(bits=8, also="") + " select item_id, group_root from gr",
    "g2_near_duplicates_lossy": BASE + _NEAR.format(bits=8, also=_LOSSY) + " select item_id, group_root from gr",
    "g3_equal_hash_groups": BASE + " select item_id, coalesce(min(case when h is not null then item_id end) over (partition by h), item_id) as group_root from hx",
    "g4_burst_merge": BASE + _NEAR.format(bits=8, also="") + _MERGE.format(shots="i join hx using (item_id)") + " select item_id, coalesce(ct.r, group_root) as group_root from gr left join ct on ct.x = gr.group_root",
    "g7_grouping": BASE + _NEAR.replace("hx", "sh").format(bits=8, also="") + """,
s1 as (select item_id, score, us, h, case when lag(camera_id) over w is distinct from camera_id or us - lag(us) over w > 600000000 then 1 else 0 end as so,
  case when row_number() over w = 1 or us - lag(us) over w > 15000000 then 1 else 0 end as bo, row_number() over w as pos from sh window w as (order by camera_id, us, item_id)),
s2 as (select item_id, score, us, h, (sum(so) over (order by pos) - 1)::bigint as session_id, (sum(bo) over (order by pos) - 1)::bigint as burst_id from s1)""" + _MERGE.format(shots="s2") + """,
z as (select item_id, session_id, burst_id, score, us, coalesce(ct.r, group_root) as g from gr join s2 using (item_id) left join ct on ct.x = gr.group_root)
select item_id, session_id, burst_id, g as group_id, count(*) over (partition by g) as group_size,
  row_number() over (partition by g order by score desc, us, item_id) = 1 as is_group_best, score as pick_score from z""",
    "g6_prefix_groups": BASE + """ select item_id, prefix, min(item_id) over (partition by prefix) as group_root, count(*) over (partition by prefix) as n
from (select item_id, regexp_replace(regexp_replace(filename, '\\.[^.]*$', ''), '[_-]?\\d+$', '') as prefix from i where filename is not null)""",
    "g9_wide_groups": BASE + """, d as (select distinct group_id, h from i join hx using (item_id) where group_id <> -1 and h is not null)
select a.group_id, min(bit_count(xor(a.h, b.h)))::int as least, max(bit_count(xor(a.h, b.h)))::int as greatest, count(*) as pairs
from d a join d b on a.group_id = b.group_id and a.h < b.h group by 1 having max(bit_count(xor(a.h, b.h))) > 8""",
    "j9_group_distances": BASE + """, d as (select distinct burst_id, group_id, h from i join hx using (item_id) where group_id <> -1 and burst_id <> -1 and h is not null)
select a.burst_id, a.group_id as g1, b.group_id as g2, min(bit_count(xor(a.h, b.h)))::int as least, round(avg(bit_count(xor(a.h, b.h))), 6) as mean, count(*) as pairs
from d a join d b on a.burst_id = b.burst_id and a.group_id < b.group_id group by 1, 2, 3""",
    "g10_why_separate": BASE + """ select burst_id, pi as item_a, item_id as item_b, us - pu as gap_us, camera_id = pc as same_camera, bit_count(xor(h, pp))::int as distance
from (select *, lag(item_id) over w as pi, lag(group_id) over w as pg, lag(us) over w as pu, lag(camera_id) over w as pc, lag(h) over w as pp
  from sh where group_id <> -1 and burst_id <> -1 window w as (partition by burst_id order by us, item_id)) where group_id <> pg""",
    "j15_shared_bursts": BASE + """, d as (select distinct burst_id, group_id from i where group_id <> -1 and burst_id <> -1)
select a.group_id as g1, b.group_id as g2, count(*) as bursts from d a join d b on a.burst_id = b.burst_id and a.group_id < b.group_id group by 1, 2""",
    "o1_by_uncertainty": BASE + """ select *, row_number() over (order by uncertainty desc, filename desc nulls last, item_id) - 1 as "at" from (
select item_id, filename, round(coalesce(-(p * log2(p) + (1 - p) * log2(1 - p)), 1.0), 6) as uncertainty
from (select item_id, filename, case when not isnan(pick_score) then greatest(1e-4, least(1 - 1e-4, pick_score)) end as p from i))""",
    "o2_by_group": BASE + """ select *, row_number() over (order by group_us, score desc, filename, item_id) - 1 as "at" from (
select item_id, filename, coalesce(min(us) over (partition by case when group_id <> -1 then group_id else -1000000000 - item_id end), us) as group_us, score from sh)""",
    "o5_top_groups": BASE + " select group_id, count(*) as n from i where group_id <> -1 group by 1 order by n desc, group_id limit 15",
    "o11_sample": BASE + " select item_id from (select item_id, row_number() over (order by item_id) - 1 as k, count(*) over () as n from i) where k % greatest(1, n // 200) = 0",
    "o13_range": BASE + """ select item_id, k::bigint as "at" from (select item_id, row_number() over (order by filename, item_id) - 1 as k from i where filename is not null) where k between 40 and 90""",
    "u4_sets": BASE + """, k as (select distinct burst_id from i where lower(trim(label)) = 'keep' and burst_id <> -1), t as (select distinct burst_id from i where lower(trim(label)) = 'trash' and burst_id <> -1)
select burst_id, 'both' as found from k semi join t using (burst_id) union all select burst_id, 'keep' from k anti join t using (burst_id) union all select burst_id, 'trash' from t anti join k using (burst_id)""",
}
