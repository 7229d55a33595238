"""Queries of the core that do more than one operator, on small tables."""

import random

import numpy as np
from conftest import rows
from pyspark.ml.linalg import Vectors

from darkslide.operators import evaluation as ev
from darkslide.operators import blocks
from darkslide.plans import catalogue, grouping, learning


def test_with_and_without_tries_every_frequent_class(spark, monkeypatch):
    r = random.Random(5)
    objects = [["dog", "Cat"] if i % 2 else ["kite", None] if i % 3 else None for i in range(120)]
    objects[7] = ["rare", "dog"]
    made = [(i, int(r.random() < 0.5), Vectors.dense(r.random(), r.random())) for i in range(120)]
    monkeypatch.setattr(learning, "dataset", lambda *_: spark.createDataFrame(made, ["id", "y", "features"]))
    monkeypatch.setattr(learning, "items", lambda *_: spark.createDataFrame(list(enumerate(objects)), "item_id bigint, objects array<string>"))
    got = rows(learning.m26_m35_with_and_without(spark, "").drop("keep_loss", "roc_auc"))
    assert {x[:2] for x in got} == {(c, k) for c in ("dog", "cat", "kite") for k in ("without", "with", "difference")} | {("rare", "insufficient_data")}
    by = {x[:2]: x[2] for x in got}
    assert all(abs(by[c, "with"] - by[c, "without"] - by[c, "difference"]) < 1e-12 for c in ("dog", "cat", "kite")) and by["rare", "insufficient_data"] is None


def test_permuted_importance_of_every_feature(spark, monkeypatch):
    r = random.Random(6)
    names = [f"n{i}" for i in range(8)]
    made = [(i, i % 2, Vectors.dense(*[r.random() for _ in range(7)], i % 2 + r.random())) for i in range(200)]
    monkeypatch.setattr(learning, "dataset", lambda *_: spark.createDataFrame(made, ["id", "y", "features"]))
    monkeypatch.setattr(learning, "NAMES", names)
    got = [tuple(x) for x in learning.m23_permuted_importance(spark, "").collect()]
    assert sorted(n for n, _ in got) == names and got[0][0] == "n7" and got[0][1] > 0.2


def test_areas_by_key_are_those_of_each(spark):
    r = random.Random(7)
    made = [(k, int(r.random() < 0.4), r.choice([None, float("nan"), *[i / 9 for i in range(9)]])) for k in range(4) for _ in range(50)] + [(9, 1, 0.5)]
    df = spark.createDataFrame(made, "g int, y int, p double")
    got = {x.g: x.roc_auc for x in ev.roc_auc_by(df, "g").collect()}
    assert got.pop(9) is None and len(got) == 4
    assert all(abs(v - ev.roc_auc(df.filter(df.g == k)).first()[0]) < 1e-12 for k, v in got.items())


def test_flags_of_all_classes(spark, monkeypatch):
    made = [(1, ["cup", "Kite", "dog"]), (2, ["traffic light", None, "sled", "Sled"]), (3, []), (4, None)]
    monkeypatch.setattr(catalogue, "items", lambda *_: spark.createDataFrame(made, "item_id bigint, objects array<string>"))
    got = {r.item_id: r.asDict() for r in catalogue.j11_all_class_flags(spark, "").collect()}
    assert all(len(r) == 82 for r in got.values())
    on = {i: sorted(c for c, v in r.items() if v == 1 and c != "item_id") for i, r in got.items()}
    assert on == {1: ["cup", "dog", "kite"], 2: ["traffic_light"], 3: [], 4: []}
    assert {i: r["others"] for i, r in got.items()} == {1: [], 2: ["sled"], 3: [], 4: []}


def test_elimination_goes_down_to_five(spark, monkeypatch):
    r = random.Random(8)
    made = [(i, i % 2, Vectors.dense(*[r.random() for _ in range(7)], i % 2)) for i in range(100)]
    monkeypatch.setattr(learning, "dataset", lambda *_: spark.createDataFrame(made, ["id", "y", "features"]))
    monkeypatch.setattr(learning, "NAMES", [f"n{i}" for i in range(8)])
    assert [x.features for x in learning.m27_elimination(spark, "").collect()] == [8, 7, 6, 5]


def test_blocks_compare_as_joins_do(spark, monkeypatch):
    """Bursts and groups cut into blocks of a few rows give what the join of each with itself gives."""
    r = random.Random(8)
    base = [r.getrandbits(64) for _ in range(6)]
    made = [(i, f"{r.choice(base) ^ (1 << r.randrange(64)):016x}" if r.random() < .9 else None, r.choice([None, -1, 1, 1, 2, 3]), r.choice([None, -1, 1, 2, 2])) for i in range(200)]
    df = spark.createDataFrame(made, "item_id bigint, phash string, group_id bigint, burst_id bigint")
    monkeypatch.setattr(grouping, "items", lambda *_: df)
    names = (grouping.g4_burst_merge, grouping.g9_wide_groups, grouping.j9_group_distances)
    want = [rows(f(spark, "")) for f in names]
    assert all(want)
    monkeypatch.setattr(blocks, "FEW", 1)
    monkeypatch.setattr(blocks, "BLOCK", 7)
    for f, w in zip(names, want):
        assert rows(f(spark, "")) == w, f.__name__


def test_parzen_search_beats_chance():
    space = {"a": (1e-4, 1.0, "log"), "b": (0, 30), "c": ["x", "y", "z"]}
    score = lambda p: -(np.log10(p["a"]) + 2) ** 2 - ((p["b"] - 20) / 10) ** 2 - (p["c"] != "y")
    found = learning.L.tpe_search(space, score, 60)
    assert len(found) == 60 and all(1e-4 <= p["a"] <= 1 and isinstance(p["b"], int) and 0 <= p["b"] <= 30 for p, _ in found)
    draws = [learning.L.tpe_search(space, score, 5, seed)[0][1] for seed in range(3)]
    assert found[0][1] > -0.3 and found[0][1] >= max(draws)


def test_adjustments_of_tiny_sets():
    L = learning.L
    assert [L.adjusted_trees(n, 200) for n in (5, 10, 11)] == [60, 60, 200] and L.adjusted_trees(5, 40) == 40
    assert [L.adjusted_leaf(n, 5) for n in (3, 9, 10, 29, 30)] == [1, 1, 2, 2, 5] and L.adjusted_leaf(3, 1) == 1


def test_more_rows_are_made_where_others_are_near(spark):
    r = random.Random(9)
    easy = [(i, 0, Vectors.dense(r.random(), r.random())) for i in range(20)]
    mixed = [(100 + i, i % 2, Vectors.dense(50 + r.random(), r.random())) for i in range(20)]
    df = spark.createDataFrame(easy + mixed, ["id", "y", "features"])
    made = [x.features for x in learning.L.adasyn(df, "id", "y", 0).collect()]
    assert 20 <= len(made) <= 40 and all(len(f) == 2 for f in made) and sum(f[0] > 20 for f in made) == len(made)
    assert learning.L.adasyn(df.filter("id < 100"), "id", "y", 0).count() == 0


def test_recursive_elimination_keeps_what_tells(spark):
    r = random.Random(10)
    df = spark.createDataFrame([(i, i % 2, Vectors.dense(r.random(), i % 2 + r.random() / 9, r.random())) for i in range(120)], ["id", "y", "features"])
    ranks = dict(learning.L.eliminated_ranks(df, ["a", "b", "c"], 1))
    assert ranks["b"] == 1 and sorted(ranks.values()) == [1, 2, 3]


def test_tuned_model_is_stored_with_its_metadata(spark, tmp_path):
    from pyspark.ml.classification import LogisticRegressionModel

    L, r = learning.L, random.Random(11)
    df = spark.createDataFrame([(i, i % 2, Vectors.dense(i % 2 + r.random(), r.random())) for i in range(80)], ["id", "y", "features"])
    best, score = L.tuned_and_retrained(df, "logistic", L.grid({"regParam": [0.01, 0.1]}), ["a", "b"], str(tmp_path / "m"))
    model, meta = L.load_model(LogisticRegressionModel, str(tmp_path / "m"), spark)
    assert model.numFeatures == 2 and meta["n_samples"] == 80 and score > 0.9
    assert L.mismatches(meta, {**meta, "n_samples": 1}) == [] and L.mismatches(meta, {**meta, "mode": "x"}) == ["mode"]


def test_blend_has_the_least_loss(spark):
    r, L = random.Random(12), learning.L
    y = [int(r.random() < 0.5) for _ in range(400)]
    clip = lambda v: min(0.99, max(0.01, v))
    ps = [[clip(t * 0.6 + r.random() * 0.4) for t in y], [clip(r.random()) for _ in y], [clip(0.5 + (t - 0.5) * r.random()) for t in y]]
    parts = [spark.createDataFrame(list(zip(range(400), y, p)), "id bigint, y int, p double") for p in ps]
    weights, mixed = L.blended(parts, steps=25)
    loss = lambda w: float(np.mean([-np.log(q if t else 1 - q) for t, *p in zip(y, *ps) for q in [sum(a * b for a, b in zip(w, p))]]))
    grid = min(loss((a / 10, b / 10, (10 - a - b) / 10)) for a in range(11) for b in range(11 - a))
    assert abs(sum(weights) - 1) < 1e-9 and min(weights) >= 0 and loss(weights) <= grid + 5e-3
    assert mixed.count() == 400
