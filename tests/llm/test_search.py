import pickle
import random

import numpy as np
import pandas as pd
import pytest

from darkslide.llm.fm_index import FMIndex, paths
from darkslide.llm.neighbours import nearest
from darkslide.llm.overlaps import PIECES, Shard, cross_split_overlaps, name_key, name_keys
from darkslide.llm.vp_tree import Router, VPTree, unit


def brute_matches(queries, rows, least):
    out = set()
    for q, a in enumerate(queries):
        for r, b in enumerate(rows):
            at = 0
            while at < len(a):
                end = at
                while end < len(a) and a[end] == b[end]:
                    end += 1
                if end - at >= least:
                    out.add((q, r, at, end - 1))
                at = end + 1
    return out


@pytest.mark.parametrize("least", [1, 2, 3])
def test_maximal_matches_are_those_of_comparing(least):
    r = np.random.default_rng(least)
    for n in (1, 40):
        rows, queries = r.integers(0, 3, (n, 10)), r.integers(-1, 4, (30, 10))
        queries[queries == 3] = -1
        found = FMIndex(rows, [3] * 10, np.arange(n)).maximal_matches(queries, least)
        got = list(zip(*(x.tolist() for x in found)))
        assert len(got) == len(set(got)) and set(got) == brute_matches(queries.tolist(), rows.tolist(), least)


def test_any_two_pieces_stand_together_once():
    sides = [frozenset(p) for o in paths(10) for p in zip(o, o[1:])]
    assert len(sides) == len(set(sides)) == 45 and all(sorted(o) == list(range(10)) for o in paths(10))


def test_single_symbols_do_not_decide():
    """Hashes with one piece in common are no pair, however many records share it; two pieces and eight bits are one."""
    base = 0
    one = sum(1 << at for at, _ in PIECES[1:])  # differs in nine pieces by a bit each
    two = sum(1 << at for at, _ in PIECES[2:])
    make = lambda ids, bits: pd.DataFrame({"run_id": 1, "split_name": "test", "item_id": ids, "group_id": -1, "grouped": False, "bits": np.array(bits, dtype=np.uint64).view(np.int64), "hashed": True})
    shard = Shard(make([10, 11, 12], [one, two, base]))
    got = shard.overlaps(make([1], [base]))
    assert sorted(got["item_hi"]) == [11, 12]
    found = [index.maximal_matches(np.zeros((0, 10), dtype=np.int64), 2)[0] for index in shard.hashes]
    assert not any(len(x) for x in found)


def brute_overlaps(rows):
    out = set()
    for run, split, a, g, h in rows:
        for run2, split2, b, g2, h2 in rows:
            if run == run2 and split != "train" and split2 == "train":
                near = h and h2 and (int(h, 16) ^ int(h2, 16)).bit_count() <= 8
                if a == b or near or (g is not None and g == g2):
                    out.add((run, split, min(a, b), max(a, b)))
    return out


def test_overlaps_like_brute_force(spark, monkeypatch):
    r, rows = random.Random(7), set()
    base = [r.getrandbits(64) for _ in range(12)]
    for i in range(300):
        h = r.choice(base) ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 6)))
        rows.add((r.randint(1, 3), r.choice(["train", "train", "test", "val"]), i % 120, r.choice([None, 1, 2, 3, 4, 5, 6, 7]), r.choice([None, f"{h:016x}"])))
    rows |= {(8, "test", 1, None, None), (9, "train", 1, None, None)}
    df = spark.createDataFrame(list(rows), "run_id bigint, split_name string, item_id bigint, group_id bigint, phash string")
    monkeypatch.setattr("darkslide.llm.overlaps.SHARD", 7)
    monkeypatch.setattr("darkslide.llm.overlaps.BLOCK", 11)
    assert {tuple(x) for x in cross_split_overlaps(df).collect()} == brute_overlaps(rows)
    assert cross_split_overlaps(df.filter("run_id > 9")).count() == 0


@pytest.mark.parametrize("a, b", [(" D:\\x\\ É.JPG ", "é.jpg"), (" D:\\x\\ B c.JPG\t", "b c.jpg"), ("A.b", "a.b"), ("x/ y /Z z ", "z z"), ("/lib/e\u0301.jpg", "é.jpg"), ("", None), ("a/", None), (None, None), ("  ", None)])
def test_name_keys(spark, a, b):
    assert name_key(a) == b
    assert spark.createDataFrame([(a,)], "n string").select(name_keys("n").alias("k")).first().k == b


def test_tree_and_router_are_exact_at_factor_one():
    r = np.random.default_rng(2)
    raw = r.random((3000, 12)).astype(np.float32)
    x = unit(raw)
    tree = pickle.loads(pickle.dumps(VPTree(raw, np.arange(len(raw)), leaf=50)))
    s = x @ x.T
    np.fill_diagonal(s, -2)
    want = np.sort(-s, axis=1)[:, :5] * -1
    _, got = tree.search(x, 5, 1.0, own=np.arange(len(x)))
    assert np.allclose(got, want)
    router = Router(x[:800], 16)
    router.refine({3: Router(x[:300], 4)})
    router.cut(3000, 100)
    key = np.arange(len(x))
    home, reach = router.home(x, key), np.sqrt(2 - 2 * want[:, 4])
    row, shard = router.visits(x, reach, 1.0)
    seen = set(zip(row.tolist(), shard.tolist()))
    assert len(set(home)) > 19 and len(seen) == len(row)
    assert all((i, home[j]) in seen for i in range(0, 3000, 50) for j in np.argsort(-s[i])[:5])


def test_near_copies_are_ranked_in_double_precision():
    r = np.random.default_rng(3)
    base = r.random(16)
    raw = np.concatenate([base * r.uniform(0.5, 2, (60, 1)), base + 1e-5 * r.standard_normal((60, 16)), r.random((200, 16))]).astype(np.float32)
    rank = r.permutation(len(raw))
    x = unit(raw)
    s = np.einsum("ij,kj->ik", x, x)
    places, sims = VPTree(raw, rank, leaf=20).search(x, 5, 1.0, own=np.arange(len(x)))
    np.fill_diagonal(s, -2)
    assert np.allclose(sims, -np.sort(-s, axis=1)[:, :5], atol=1e-14, rtol=0)
    assert all(len(set(p)) == 5 and i not in p for i, p in enumerate(places.tolist()))


def brute_nearest(rows, k):
    out = {}
    for i, v in rows.items():
        near = []
        for j, w in rows.items():
            if i != j and len(v) == len(w):
                a, b = np.array(v), np.array(w)
                near.append((-1.0 if v == w else -float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), j))
        out[i] = [j for _, j in sorted(near)[:k]]
    return out


def test_nearest_with_equal_and_unusable_vectors(spark):
    r = np.random.default_rng(5)
    rows = {i: [float(np.float32(x)) for x in r.random(6)] for i in range(150)}
    rows |= {i: rows[3] for i in range(200, 230)} | {i: [float(np.float32(x)) for x in r.random(4)] for i in range(300, 303)} | {400: [1.0]}
    bad = [(500, None), (501, [0.0] * 6), (502, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (503, [float("nan")] * 6), (504, [float("inf")] * 6), (None, [1.0] * 6), (3, rows[3])]
    df = spark.createDataFrame([*rows.items(), *bad], "item_id bigint, hist_feat array<float>")
    for sample in (20_000, 100):  # the second splits the leaves of the first router
        got = {x.item_id: list(x.neighbours) for x in nearest(df, 5, factor=1.0, shard=4 if sample == 100 else 16, sample=sample).collect()}
        assert got == brute_nearest(rows, 5)
    assert nearest(df.filter("item_id > 999"), 5).count() == 0


def test_recall_at_the_factor_in_use(spark):
    r = np.random.default_rng(6)
    rows = {i: [float(np.float32(x)) for x in r.dirichlet(np.ones(24))] for i in range(2500)}
    got = {x.item_id: set(x.neighbours) for x in nearest(spark.createDataFrame(list(rows.items()), "item_id bigint, hist_feat array<float>"), 5, shard=128).collect()}
    x = unit(np.array(list(rows.values())))
    s = x @ x.T
    np.fill_diagonal(s, -2)
    assert np.mean([len(got[i] & set(np.argsort(-s[i])[:5].tolist())) / 5 for i in rows]) >= 0.9


def test_visits_take_memory_by_their_number_only():
    """All pairs of a vector and a node, each with a vector of its own, were held at once; now one node's vectors are."""
    import tracemalloc

    r = np.random.default_rng(5)
    x = unit(r.random((4096, 48)))
    router = Router(unit(r.random((5000, 48))), 256)
    tracemalloc.start()
    row, to = router.visits(x, np.full(len(x), 2.0), 1.0)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(row) == len(to) == 4096 * 256 and most < 100e6


def test_shards_travel_without_what_their_own_vectors_found():
    from darkslide.llm import neighbours

    r = np.random.default_rng(6)
    raw = r.random((3000, 24)).astype(np.float32)
    s = neighbours.Shard(raw, [[i] for i in range(3000)], 5, 1.0)
    assert not hasattr(pickle.loads(pickle.dumps(s)), "own") and len(pickle.dumps(s, protocol=5)) < 1.5 * raw.nbytes
