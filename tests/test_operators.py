import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from darkslide.functions import pixels
from darkslide.operators import detections, evaluation, filters, labels
from darkslide.operators.graph import connected_components
from darkslide.operators.hamming import hamming_pairs, hash_bits, near_duplicate_groups
from darkslide.operators.photos import clean_camera, current_photos
from darkslide.operators.skew import first_rows, skew_safe_lookup
from darkslide.sources import pictures, stores


def union_find(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is None or b is None or a == b:
            continue
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return sorted((x, find(x)) for x in up)


def test_hot_keys_are_looked_up_like_others(spark):
    left = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 50 + [2, 3, None])], "k bigint, i bigint")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (None, "z")], "k bigint, v string")
    counted = right.withColumn("n", F.when(F.col("k") == 1, 50).otherwise(1))
    want = sorted(["a"] * 50 + ["b", "None", "None"])
    for r, n in ((right, None), (counted, "n")):
        assert sorted(str(x.v) for x in skew_safe_lookup(left, "k", r, ["v"], n, hot_rows=10).collect()) == want


def test_first_rows_with_ties(spark):
    df = spark.createDataFrame([(1, 5, i) for i in range(100)] + [(2, 1, 1)], "g int, s int, id int")
    assert rows(first_rows(df, ["g"], [F.desc("s"), F.asc("id")], 2, salts=3)) == [(1, 5, 0), (1, 5, 1), (2, 1, 1)]


@pytest.mark.parametrize("edges", [
    [], [(1, 1)], [(1, 2), (2, 1), (1, 2), (None, 3)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)],
])
@pytest.mark.parametrize("few", [0, 100_000])
def test_components(spark, monkeypatch, edges, few):
    monkeypatch.setattr("darkslide.operators.graph.FEW_EDGES", few)
    assert sorted(map(tuple, connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect())) == union_find(edges)


def test_hamming_join_is_exact_and_the_lossy_one_a_part_of_it(spark):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(30)]
    near = [b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 10))) for b in base for _ in range(3)]
    signed = sorted({x - (1 << 64) if x >> 63 else x for x in base + near})
    df = spark.createDataFrame([(x,) for x in signed] + [(None,)], "h bigint")
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 8}
    assert {(x.a, x.b) for x in hamming_pairs(df, 8).collect()} == want
    assert {(x.a, x.b) for x in hamming_pairs(df, 8, exact=False).collect()} <= want


def test_groups_of_hashes(spark):
    hexes = [("f" * 16, 1), ("f" * 15 + "e", 2), ("0" * 16, 3), ("error_x", 4), (None, 5), ("F" * 16, 6)]
    df = spark.createDataFrame(hexes, "p string, item_id bigint").select("item_id", hash_bits("p").alias("h"))
    assert rows(near_duplicate_groups(df)) == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 1)]


def test_photos(spark):
    df = spark.createDataFrame([("a", 1, None, " X  Y ", 5), ("a", 2, None, " ", 9), (None, 3, None, "q", 9)], "filename string, row_id bigint, photo_ts timestamp_ntz, camera_id string, s int")
    df = df.withColumn("ingested_at", F.timestamp_seconds("s").cast("timestamp_ntz"))
    assert rows(current_photos(df)) == [("a", None, " ")]
    assert rows(df.select(clean_camera("camera_id"))) == [("q",), ("unknown",), ("x y",)]


KEEP = [.1, .2, .3, .4, .5, .6, .7, .8, .9, 1.0]


@pytest.mark.parametrize("loss, want", [(0.2, 0.3), (0.0, 0.1 - 1e-10), (1.0, 1.0)])
def test_thresholds(spark, loss, want):
    df = spark.createDataFrame([(1, p) for p in KEEP] + [(0, .5)] * 10, "y int, p double")
    assert evaluation.threshold_for_loss(df, loss).first()[0] == pytest.approx(want, abs=1e-12)


def test_threshold_without_keepers_and_metrics_without_rows(spark):
    df = spark.createDataFrame([(0, .5)], "y int, p double")
    assert evaluation.threshold_for_loss(df, 0.1).first()[0] == 0.5
    none = df.filter("p > 1")
    assert evaluation.confusion(none, .5).first() == (0, 0, 0, 0)
    assert evaluation.asymmetric(evaluation.confusion(none, .5)).first()["keep_loss"] == 0.0
    assert evaluation.roc_auc(df).first()[0] is None


@pytest.mark.parametrize("k, t, ratio, kind", [(50, 50, 1.0, "balanced"), (80, 20, 4.0, "severe"), (60, 30, 2.0, "moderate"), (0, 0, 0.0, "insufficient")])
def test_balance(spark, k, t, ratio, kind):
    r = evaluation.balance(spark.createDataFrame([(1,)] * k + [(0,)] * t, "y int")).first()
    assert (r.ratio, r.severity) == (ratio, kind)


def test_detections(spark):
    texts = ['{"class": "car", "score": 0.5}', '{"label": "dog", "scores": [0.7, 0.1]}', '["cat", 0.9]', '"bird"', '{"name": "x", "prob": "?"}', None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(detections.normalised(F.col("t")).alias("d")).select("d.*")
    assert [tuple(r) for r in df.collect()] == [("car", .5), ("dog", .7), ("cat", .9), ("bird", 0.0), ("x", 0.0), (None, None)]
    d = spark.createDataFrame([(1, i, "c", .81 + i / 100, .5) for i in range(6)] + [(2, i, "c", .9, .5) for i in range(2)] + [(2, 9, "c", .1, .5)], "image int, det int, class string, conf double, area double")
    assert sorted((r.image, r.det) for r in detections.overlay(d).collect()) == [(1, 1), (1, 2), (1, 3), (1, 4), (1, 5), (2, 0), (2, 1), (2, 9)]


def test_label_states_like_a_fold(spark):
    r = random.Random(2)
    log = [(r.randint(1, 30), i, r.choice(["keep", "trash", "", "bad"]), r.choice(["manual", "auto", None])) for i in range(400)] + [(None, 1, "keep", "auto")]
    state = {}
    for path, _, new, source in sorted(log[:-1], key=lambda x: x[1]):
        if new == "bad":
            continue
        old, by = state.setdefault(path, ("", "manual"))
        if source == "auto" and old and by == "manual":
            continue
        state[path] = (new, source or "manual") if new else ("", by)
    got = labels.label_states(spark.createDataFrame(log, "path bigint, seq bigint, state string, source string"))
    assert {x.path: x.state for x in got.collect()} == {k: v[0] for k, v in state.items()}


def test_replay(spark):
    log = [(1, 1, "set", "a"), (1, 2, "set", "b"), (1, 3, "undo", None), (1, 4, "redo", None), (1, 5, "undo", None), (1, 6, "undo", None), (1, 7, "undo", None), (2, 1, "undo", None)]
    assert rows(labels.replay(spark.createDataFrame(log, "path bigint, seq bigint, action string, value string"))) == [(1, None, 0, 2), (2, None, 0, 0)]


def test_filters_of_missing_values(spark):
    df = spark.createDataFrame([(1, None, None, None, None), (2, [" Web ", None], "keep", "manual", 4)], "id int, tags array<string>, label string, label_source string, rating int")
    assert rows(df.filter(filters.has_tag("web")).select("id")) == [(2,)]
    assert rows(df.filter(filters.not_manual(True)).select("id")) == [(1,)]
    assert rows(df.filter(filters.rating_at_least(0) & filters.has_tag(" ")).select("id")) == [(1,), (2,)]


def test_pictures(spark, tmp_path):
    rng = np.random.default_rng(3)
    picture = rng.integers(0, 255, (24, 32, 3)).astype(np.uint8)
    assert (pixels.decode_png(pixels.encode_png(picture)) == picture).all()
    assert pixels.decode_png(b"") is None and pixels.decode_png(pixels.PNG_MAGIC + b"junk") is None
    assert len(pixels.feature_vector(picture, [12, 0, 1, 0, *[0.0] * 10], {"car"}, [f"c{i}" for i in range(79)] + ["car"])) == 157
    assert len(pixels.feature_vector(picture, [12, 0, 1, 0, *[0.0] * 10], set(), ["c"] * 80, bins=16)) == 181
    flat = pixels.features(np.full((5, 5, 3), 9, np.uint8))
    assert all(np.isfinite(v) for v in flat.values()) and flat["width"] == 5
    assert (int(pixels.perceptual_hash(picture), 16) ^ int(pixels.perceptual_hash((picture // 2 + 60).astype(np.uint8)), 16)).bit_count() <= 8
    (tmp_path / "B.PNG").write_bytes(pixels.encode_png(picture))
    (tmp_path / "a.png").write_bytes(b"no picture")
    (tmp_path / "notes.txt").write_text("x")
    files = pictures.scan(spark, str(tmp_path))
    assert sorted(r.filename for r in files.collect()) == ["B.PNG", "a.png"]
    got = {r.path[-5:]: r.phash for r in pictures.hashes(files).collect()}
    assert got["B.PNG"] == pixels.perceptual_hash(picture) and got["a.png"] is None


def test_filtered_png_lines():
    line = lambda kind, data: bytes([kind]) + bytes(data)
    raw = line(1, [10, 20, 30, 1, 1, 1]) + line(2, [1, 1, 1, 1, 1, 1]) + line(3, [0] * 6) + line(4, [2] * 6)
    body = pixels.encode_png(np.zeros((4, 2, 3), np.uint8))
    at = body.index(b"IDAT")
    packed = zlib.compress(raw)
    png = body[: at - 4] + len(packed).to_bytes(4, "big") + b"IDAT" + packed + b"\0" * 4 + body[body.index(b"IEND") - 4 :]
    out = pixels.decode_png(png)
    assert out[0].tolist() == [[10, 20, 30], [11, 21, 31]] and out[1].tolist() == [[11, 21, 31], [12, 22, 32]]
    assert out[2].tolist() == [[5, 10, 15], [8, 16, 23]] and out[3, 0].tolist() == [7, 12, 17]


def test_stores(spark, tmp_path):
    f = tmp_path / "ratings.json"
    f.write_text('{"a/x.jpg": {"rating": 3, "tags": ["t"]}, "x.jpg": {"rating": 4, "state": "keep"}, "y.jpg": {}}')
    got = {r.filename: r for r in stores.load_ratings(spark, str(f)).collect()}
    assert (got["x.jpg"].rating, got["x.jpg"].tags, got["x.jpg"].state, got["y.jpg"].rating) == (4, ["t"], "keep", None)
    assert stores.parameter_values("1,2, 3") == [1, 2, 3] and stores.parameter_values("0.1:0.3:0.1") == pytest.approx([0.1, 0.2, 0.3]) and stores.parameter_values("a,b") == ["a", "b"]
    stores.save_parameters({"depth": 6}, str(tmp_path / "p.json"))
    assert stores.load_parameters(str(tmp_path / "p.json")) == {"depth": 6} and stores.load_parameters(str(tmp_path / "none")) == {}
    lines = spark.createDataFrame([("1 img " + " ".join(["1"] * 10),), ("2 short 1",), ("3 zero " + " ".join(["0"] * 10),), (None,)], "value string")
    assert [r.image_id for r in stores.votes(lines).collect()] == ["img"]
