"""Near hashes at sizes at which a plan of all combinations of pieces is too large."""

import random

import numpy as np
import pytest

from darkslide.operators import hamming


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute(hashes, threshold):
    return {(min(a, b), max(a, b)) for i, a in enumerate(hashes) for b in hashes[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= threshold}


@pytest.mark.parametrize("threshold", [0, 1, 2, 5, 8, 12, 40])
def test_blocks_find_each_near_pair_once(spark, monkeypatch, threshold):
    r = random.Random(threshold)
    base = [r.getrandbits(64) for _ in range(60)]
    made = sorted({signed(b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, threshold + 2)))) for b in base for _ in range(5)})
    df = spark.createDataFrame([(h,) for h in [*made, *made[:9], None]], "h bigint")
    want = brute(made, threshold)
    for block in (1 << 20, 70):
        monkeypatch.setattr(hamming, "BLOCK", block)
        got = [tuple(x) for x in hamming.hamming_pairs(df, threshold).collect()]
        assert {x[:2] for x in got} == want and len(got) == len(want)
        assert all(d == ((a ^ b) & (2**64 - 1)).bit_count() for a, b, d in got)


@pytest.mark.parametrize("threshold", [1, 5, 8, 12, 20])
def test_lookups_find_what_comparing_finds(monkeypatch, threshold):
    monkeypatch.setattr(hamming, "AT_ONCE", 1000)
    r = random.Random(threshold)
    made = [r.getrandbits(64) for _ in range(1500)]
    left = np.unique(np.array(made, dtype=np.uint64))
    right = np.unique(np.array([b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, threshold + 3))) for b in made], dtype=np.uint64))
    i, j = np.nonzero(np.bitwise_count(left[:, None] ^ right[None, :]) <= threshold)
    got = [p for u, v in hamming._near_in_blocks(left, right, threshold) for p in zip(u.tolist(), v.tolist())]
    assert sorted(got) == sorted(zip(left[i].tolist(), right[j].tolist()))


def test_plan_of_wide_distances_stays_small(spark):
    """Twelve bits over 40,000 hashes took a plan with hundreds of keys a hash, and thousands over more."""
    r = random.Random(1)
    made = sorted({signed(r.getrandbits(64)) for _ in range(40_000)})
    near = [signed((h ^ 0b1010_1010_1010_1010_1010_1010) & (2**64 - 1)) for h in made[:50]]
    pairs = hamming.hamming_pairs(spark.createDataFrame([(h,) for h in made + near], "h bigint"), 12)
    assert len(pairs._jdf.queryExecution().toString()) < 20_000
    got = {(x.a, x.b) for x in pairs.collect()}
    assert {(min(p), max(p)) for p in zip(made, near)} <= got


def test_merged_bursts_take_no_join_of_keys(spark, monkeypatch):
    """Near hashes of many items were met by a join on hundreds of keys a hash; now a hash comes once for each block."""
    from pyspark.sql import functions as F

    from darkslide.plans import grouping

    r = random.Random(2)
    seeds = [r.getrandbits(64) for _ in range(20_000)]
    hashes = seeds + [h ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for h in seeds[:2_000]] + [h ^ (2**28 - 1) for h in seeds[2_000:2_500]]
    made = [(i, f"{h:016x}", i % 20_000 if i >= 22_000 or 2_000 <= i < 2_500 else -1) for i, h in enumerate(hashes)]
    made = [(i, h, i - 20_000 if i >= 22_000 else b) for i, h, b in made]
    df = spark.createDataFrame(made, "item_id bigint, phash string, burst_id bigint")
    monkeypatch.setattr(grouping, "items", lambda *_: df)
    plan = hamming.hamming_pairs(df.select(hamming.hash_bits("phash").alias("h")), 8)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    got = {x.item_id: x.group_root for x in grouping.g4_burst_merge(spark, "").select("item_id", F.col("group_root")).collect()}
    # Copies within two bits follow their first; those within 28 bits do so by their burst.
    assert got == {i: i - 20_000 if i >= 20_000 else i for i in range(len(made))}


def test_first_match_groups_take_no_join_of_keys(spark, monkeypatch):
    from darkslide.plans import objects

    r = random.Random(3)
    made = [(i, r.getrandbits(64)) for i in range(300)]
    made += [(300 + i, r.choice(made[: 300 + i])[1] ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 6)))) for i in range(300)]
    ids = r.sample(range(600), 600)
    made = sorted((i, h) for i, (_, h) in zip(ids, made))
    df = spark.createDataFrame([(i, f"{h:016x}") for i, h in made] + [(900, None), (901, "no hash")], "item_id bigint, phash string")
    monkeypatch.setattr(objects, "items", lambda *_: df)
    plans, pairs = [], objects.hamming_pairs
    monkeypatch.setattr(objects, "hamming_pairs", lambda *a: plans.append(pairs(*a)) or plans[-1])
    root = {}
    for i, h in made:
        first = next((j for j, k in made if j < i and (h ^ k).bit_count() <= 5), None)
        same = next((j for j, k in made if j < i and h == k), None)
        root[i] = root[same if same is not None else first] if first is not None else i
    assert {x.item_id: x.group_root for x in objects.g5_first_match_groups(spark, "").collect()} == root
    assert "Join" not in plans[0]._jdf.queryExecution().executedPlan().toString()


def apart(r, n):
    """Hashes around codes 32 bits apart, of which two to four bits decide whether they come within 30 of another's."""
    codes = [sum(1 << k for k in range(64) if (k & c).bit_count() % 2) for c in r.sample(range(64), min(n, 5))]
    return sorted({r.choice(codes) ^ sum(1 << k for k in r.sample(range(64), r.choice([0, 0, 0, 1, 1, 2]))) for _ in range(n)})


def linked(links):
    root = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for pair in links for x in pair}


def close_in_bursts(rows):
    """What links (burst, group, hash) by comparing each with each."""
    return linked([(x[1], y[1]) for i, x in enumerate(rows) for y in rows[:i] if x[0] == y[0] and x[1] != y[1] and (x[2] ^ y[2]).bit_count() <= 30])


def test_hashes_of_a_burst_are_not_all_compared_with_each_other(monkeypatch):
    """Each with each, and a third of the pairs listed, was the square of a burst's hashes: 36 million for 6,000."""
    import pandas as pd

    from darkslide.plans import grouping

    made, compared = grouping.bit_distances, []
    monkeypatch.setattr(grouping, "bit_distances", lambda a, b: compared.append(len(a) * len(b)) or made(a, b))
    r = random.Random(4)
    rows = pd.DataFrame({"burst": 1, "group_root": range(6_000), "h": [signed(r.getrandbits(64)) for _ in range(6_000)]})
    got = grouping._close_groups(rows, rows)
    assert sorted(got["u"]) == list(range(1, 6_000)) and set(got["v"]) == {0}
    assert sum(compared) < 1_000_000


@pytest.mark.parametrize("seed", range(4))
def test_bursts_of_any_size_are_tied_as_by_comparing_all(seed):
    import pyarrow as pa

    from darkslide.plans import grouping

    r = random.Random(seed)
    rows = [(b, 1000 * b + i if r.random() < .9 else r.randrange(50), h) for b in range(60) for i, h in enumerate(apart(r, r.choice([1, 2, 3, 15, 16, 17, 60])))]
    cuts = [0, *sorted(r.sample(range(len(rows)), 12)), len(rows)]  # batches that end within bursts, or hold a part of one
    batches = [pa.RecordBatch.from_pylist([{"burst": b, "group_root": g, "h": signed(h)} for b, g, h in rows[i:j]], pa.schema([(n, pa.int64()) for n in ("burst", "group_root", "h")])) for i, j in zip(cuts, cuts[1:])]
    got = [(x["u"], x["v"]) for out in grouping._tie_bursts(iter(batches)) for x in out.to_pylist()]
    assert linked(got) == close_in_bursts(rows)


def test_large_bursts_in_blocks_merge_as_small_ones(spark, monkeypatch):
    from darkslide.plans import grouping

    r = random.Random(6)
    made = [(h, b) for b, n in ((None, 9), (-1, 40), (1, 90), (2, 50), (3, 5), (4, 2)) for h in apart(r, n)]
    df = spark.createDataFrame([(i, f"{h:016x}", b) for i, (h, b) in enumerate(made)], "item_id bigint, phash string, burst_id bigint")
    monkeypatch.setattr(grouping, "items", lambda *_: df)
    near = linked([(i, j) for i, x in enumerate(made) for j, y in enumerate(made[:i]) if (x[0] ^ y[0]).bit_count() <= 8])
    merged = close_in_bursts([(b, near.get(i, i), h) for i, (h, b) in enumerate(made) if b not in (None, -1)])
    want = {i: merged.get(near.get(i, i), near.get(i, i)) for i in range(len(made))}
    for together in (1 << 15, 20):
        monkeypatch.setattr(grouping, "TOGETHER", together)
        assert {x.item_id: x.group_root for x in grouping.g4_burst_merge(spark, "").collect()} == want
