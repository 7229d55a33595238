import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from darkslide.llm.hash_to_min import components
from darkslide.llm.random_mate import contract, split_units, units
from darkslide.llm.survivors import Bundle, choose, descending, survivors
from darkslide.llm.ties import assigned, key_edges


def union_find(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


R = random.Random(1)
GRAPHS = {
    "empty": [], "loops": [(1, 1), (None, 2), (3, None)], "repeated": [(1, 2), (2, 1), (1, 2)], "chain": [(i, i + 1) for i in range(60)],
    "star": [(500, i) for i in range(60)], "random": [(R.randint(1, 150), R.randint(1, 150)) for _ in range(110)],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_hash_to_min(spark, name):
    got = components(spark.createDataFrame(GRAPHS[name], "u bigint, v bigint"))
    assert {r.item: r.root for r in got.collect()} == union_find(GRAPHS[name]) and got.count() == len(union_find(GRAPHS[name]))


@pytest.mark.parametrize("remainder", [0, 40, 20_000])
@pytest.mark.parametrize("name", ["empty", "loops", "repeated", "star", "random"])
def test_random_mate(spark, monkeypatch, name, remainder):
    monkeypatch.setattr("darkslide.llm.random_mate.REMAINDER", remainder)
    df = spark.createDataFrame(GRAPHS[name], "u bigint, v bigint")
    want = union_find(GRAPHS[name])
    assert sorted((r.item, r.unit) for r in units(df).collect()) == sorted(want.items())
    labels = {r.item: r.root for r in contract(df).collect()}
    assert labels.keys() == want.keys()


def test_keys_tie_items(spark):
    rows = [(1, 7), (2, 7), (2, 7), (3, -1), (4, None), (None, 7), (5, 8), (6, -1)]
    df = spark.createDataFrame(rows, "item bigint, g bigint").withColumn("k", F.lit(3)).withColumn("u", F.lit(9))
    assert [tuple(r) for r in key_edges(df.withColumn("g", assigned("g")), "item", "g").collect()] == [(2, 1)]


def test_splits_keep_units_and_shares(spark):
    r = random.Random(4)
    rows = [(i, r.choice("ab"), r.choice([1, 1, 1, 2, 5])) for i in range(3000)] + [(9999, "a", 1500)]
    df = spark.createDataFrame(rows, "unit bigint, stratum string, n bigint")
    got = split_units(df, [("train", .8), ("val", .1), ("test", .1)]).collect()
    assert len(got) == len(rows) == len({g.unit for g in got})
    for s in "ab":
        total = sum(g.n for g in got if g.stratum == s)
        for name, share in (("train", .8), ("val", .1), ("test", .1)):
            assert abs(sum(g.n for g in got if g.stratum == s and g.split == name) / total - share) < 0.01


def test_evaluation_splits_get_units_of_all_sizes(spark):
    df = spark.createDataFrame([(i, "a", 1 + i % 4) for i in range(4000)], "unit bigint, stratum string, n int")
    sizes = {(r.split, r.n) for r in split_units(df, [("train", .8), ("val", .1), ("test", .1)]).collect()}
    assert len(sizes) == 12


def brute(candidates):
    best = None
    for picks in product(*[[*c, None] for c in candidates]):
        held, ok = {}, True
        for p in picks:
            for k, v in (p[1] if p else {}).items():
                ok &= held.setdefault(k, v) == v
        rank = (-sum(p[2] for p in picks if p), tuple((p is None, p[0] if p else 0) for p in picks))
        if ok and (best is None or rank < best[0]):
            best = (rank, [p and p[0] for p in picks])
    return -best[0][0], best[1]


def test_branch_and_bound_is_the_best_of_all():
    r = random.Random(3)
    for _ in range(400):
        candidates = [[(r.randint(1, 99), {k: r.choice("xy") for k in r.sample("pq", r.randint(0, 2))}, r.randint(1, 5)) for _ in range(r.randint(0, 4))] for _ in range(3)]
        assert choose(candidates) == brute(candidates)


def test_survivors(spark):
    rows = [(1, 10, .5, "a", "a", 3), (1, 10, .5, "a", "a", 3), (1, 11, None, "b", "a", 2), (1, 12, float("nan"), None, "b", 9), (2, 20, 1., "a", "a", 1), (None, 1, 1., "a", "a", 1), (3, 30, None, None, None, 1), (3, 31, None, None, None, 1)]
    df = spark.createDataFrame(rows, "g bigint, item bigint, score double, p string, q string, t bigint").withColumn("lo", F.lit(0)).withColumn("id", F.lit(0))
    score = F.when(~F.isnan("score"), F.col("score"))
    bundles = [
        Bundle("pick", F.lit(True), descending(score)),
        Bundle("first", F.col("p").isNotNull(), claims={"letter": F.col("p")}, trust=F.col("t")),
        Bundle("second", F.col("q").isNotNull(), claims={"letter": F.col("q")}, trust=F.col("t")),
    ]
    got = {r.g: (r.pick, r["first"], r.second) for r in survivors(df, "g", "item", bundles).collect()}
    # The first bundle gives up its favourite a, since b lets the second have its own: 2 + 9 is more than 3 + 3.
    assert got == {1: (10, 11, 12), 3: (30, None, None)}
    assert survivors(df.filter("g > 99"), "g", "item", bundles).count() == 0
    assert {r.g: r.pick for r in survivors(df, "g", "item", bundles[:1]).collect()} == {1: 10, 3: 30}


@pytest.mark.parametrize("at_once", [1, 7, 1000])
def test_values_are_searched_in_parts(spark, monkeypatch, at_once):
    r = random.Random(5)
    rows = [(r.choice([1, 1, 1, 2, 3]), i, str(r.randint(0, 30)), str(r.randint(20, 50)), r.randint(1, 9)) for i in range(300)]
    monkeypatch.setattr("darkslide.llm.survivors.VALUES_AT_ONCE", at_once)
    bundles = [Bundle("a", F.lit(True), claims={"v": F.col("p")}, trust=F.col("t")), Bundle("b", F.lit(True), claims={"v": F.col("q")}, trust=F.col("t"))]
    got = {x.g: [x.a, x.b] for x in survivors(spark.createDataFrame(rows, "g bigint, item bigint, p string, q string, t bigint"), "g", "item", bundles).collect()}
    for g in (1, 2, 3):
        mine = [x for x in rows if x[0] == g]
        options = [(-a[4] - b[4], a[1], b[1]) for a in mine for b in mine if a[2] == b[3]] + [(-a[4], a[1], 1 << 60) for a in mine]
        assert got[g] == [i if i < 1 << 60 else None for i in min(options)[1:]]
