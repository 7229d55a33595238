"""Stores, settings, tags out of bytes, review and strict shapes."""

import json
import struct

import pytest
from conftest import rows
from pyspark.sql import functions as F

from darkslide.functions.exif_bytes import exif_tags, tags
from darkslide.operators import detections, evaluation, labels
from darkslide.sources import stores
from darkslide.sources.settings import Criteria, Settings


def tiff(order, fields, camera=()):
    """A TIFF structure with text, number and fraction values, and a directory of its own for ``camera``."""
    mark = b"II*\0" if order == "<" else b"MM\0*"

    def directory(at, fields, pointer=None):
        n = len(fields) + (pointer is not None)
        end, body, more = at + 2 + 12 * n + 4, struct.pack(order + "H", n), b""
        for tag, value in fields:
            if isinstance(value, str):
                raw, kind, count = value.encode() + b"\0", 2, len(value) + 1
            elif isinstance(value, tuple):
                raw, kind, count = struct.pack(order + "II", *value), 5, 1
            else:
                raw, kind, count = struct.pack(order + "H", value), 3, 1
            if len(raw) > 4:
                body += struct.pack(order + "HHII", tag, kind, count, end + len(more))
                more += raw
            else:
                body += struct.pack(order + "HHI", tag, kind, count) + raw.ljust(4, b"\0")
        if pointer is not None:
            body += struct.pack(order + "HHII", 34665, 4, 1, end + len(more))
        return body + b"\0\0\0\0" + more

    first = directory(8, fields, 0 if camera else None)
    return mark + struct.pack(order + "I", 8) + first + (directory(8 + len(first), camera) if camera else b"")


FIELDS, CAMERA = [(271, "Norvik"), (272, "DX-3"), (274, 6), (65000, 7)], [(36867, "2009:02:16 06:10:00"), (33434, (1, 250)), (34855, 400), (37385, 1)]
WANT = {"Make": "Norvik", "Model": "DX-3", "Orientation": "6", "65000": "7", "DateTimeOriginal": "2009:02:16 06:10:00", "ExposureTime": "1/250", "ISOSpeedRatings": "400", "Flash": "1"}


def wrapped(kind, block):
    if kind == "jpeg":
        other = b"\xff\xe0" + struct.pack(">H", 4) + b"JF"
        return b"\xff\xd8" + other + b"\xff\xe1" + struct.pack(">H", len(block) + 8) + b"Exif\0\0" + block + b"\xff\xda\0\4picture"
    if kind == "png":
        chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + b"crc!"
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"x" * 13) + chunk(b"eXIf", block)
    return block


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("kind", ["jpeg", "png", "tiff"])
def test_tags_out_of_bytes(order, kind):
    whole = wrapped(kind, tiff(order, FIELDS, CAMERA))
    assert tags(whole) == WANT
    for n in range(len(whole)):  # a file cut anywhere gives what it still has
        assert tags(whole[:n]).keys() <= WANT.keys()
    assert tags(None) == tags(b"") == tags(b"\xff\xd8\xff\xda") == tags(b"GIF89a") == {}


def test_a_directory_that_points_to_itself_ends():
    block = bytearray(tiff("<", [(271, "Norvik")], [(34855, 1)]))
    at = block.index(struct.pack("<H", 34665))
    block[at + 8 : at + 12] = struct.pack("<I", 8)
    assert tags(bytes(block)) == {"Make": "Norvik"}


def test_tags_of_files(spark):
    df = spark.createDataFrame([(1, bytearray(wrapped("jpeg", tiff("<", FIELDS)))), (2, None), (3, bytearray(b"text"))], "id int, content binary")
    got = {r.id: r.t for r in df.select("id", exif_tags(F.col("content")).alias("t")).collect()}
    assert got == {1: {k: WANT[k] for k in ("Make", "Model", "Orientation", "65000")}, 2: {}, 3: {}}


def test_settings(tmp_path):
    path = str(tmp_path / "s.json")
    s = Settings(path)
    assert s.set("a", 1) and not s.set("a", 1) and Settings(path).get("a") == 1 and s.get("b", 5) == 5
    assert s.set_thresholds(0.81234567, 0.2) and Settings(path).get("keep_threshold") == 0.8123
    for keep, trash in ((0.2, 0.8), (0.5, 0.5), (1.1, 0.2), (0.5, -0.1), (0, 0)):
        with pytest.raises(ValueError):
            s.set_thresholds(keep, trash)
    assert s.get("trash_threshold") == 0.2
    assert s.folder("/a", lambda f: True) == "/a" and s.folder(None, lambda f: True) == "/a" and s.folder("/gone", lambda f: f != "/gone") == "/a"
    (tmp_path / "s.json").write_text("{broken")
    assert Settings(path).values == {}
    assert Criteria().changed(rating=3, tag="web")[1] and Criteria(rating=3).changed(rating=3) == (Criteria(rating=3), False)


def test_review_round_trip_and_actions(spark, tmp_path):
    p = spark.createDataFrame([("a", .95, "keep"), ("b", .92, "trash"), ("c", .5, "keep"), ("d", .99, "keep"), ("e", None, "keep")], "path string, p double, predicted string")
    q = labels.flagged(p)
    assert sorted(r.path for r in q.collect()) == ["a", "b", "d"]
    answers = spark.createDataFrame([("a", "keep", 1), ("b", "trash", 1), ("b", "", 2), ("x", "keep", 1)], "path string, user_label string, seq bigint")
    got = {r.path: (r.reviewed, r.user_label, r.applied, r.cleared) for r in labels.review(q, answers).collect()}
    assert got == {"a": (True, "keep", "keep", True), "b": (True, "", None, True), "d": (False, None, None, False)}
    stored = q.select(F.col("path").alias("filename"), F.col("predicted").alias("predicted_label"), F.col("p").alias("confidence"), F.lit(False).alias("reviewed"), F.lit("").alias("user_label"))
    stores.save_reviews(stored, str(tmp_path / "r"))
    assert rows(stores.load_review_rows(spark, str(tmp_path / "r"))) == rows(stored)


def test_caches(spark, tmp_path):
    path = str(tmp_path / "f")
    stores.save_features(spark.createDataFrame([("a", [1., 2.]), ("b", [1.])], "path string, features array<double>"), path, "1")
    stores.save_features(spark.createDataFrame([("a", [1., 2.])], "path string, features array<double>"), path, "2")
    assert stores.purge_features(spark, path, "2", 2) == 0 and stores.load_features(spark, path, "2", 2).count() == 1
    assert stores.purge_features(spark, path, "1", 2) == 2 and stores.load_features(spark, path, "1", 2).count() == 0
    files = spark.sql("select 'a' as path, timestamp_micros(5) as modificationTime union all select 'b', timestamp_micros(6)")
    cached = spark.createDataFrame([("a", 5, 1), ("b", 7, 2), ("c", 1, 3)], "path string, modified bigint, x int")
    assert rows(stores.fresh(cached, files)) == [("a", 5, 1)]
    assert not stores.group_cache_valid(cached, files)
    assert stores.group_cache_valid(spark.createDataFrame([("b", 6), ("a", 5)], "path string, modified bigint"), files)


def test_baseline(spark, tmp_path):
    path = str(tmp_path / "b.json")
    runs = spark.createDataFrame([(1, {"accuracy": .9, "other": 1.})], "run_id bigint, metrics map<string, double>")
    assert stores.against_baseline(runs, path).count() == 0
    stores.save_baseline({"accuracy": .8}, path)
    assert rows(stores.against_baseline(runs, path)) == [(1, "accuracy", .9, .8)] and json.loads((tmp_path / "b.json").read_text()) == {"accuracy": .8}


def test_strict_shapes(spark):
    good = ['["cat", 0.5]', '{"class": "cat", "confidence": 0.5}', '{"name": "cat", "score": 0.5}']
    df = spark.createDataFrame([(g,) for g in good], "j string")
    assert {tuple(r.d) for r in df.select(detections.sanitised(F.col("j")).alias("d")).collect()} == {("cat", 0.5)}
    for bad in ('"cat"', '["cat"]', '["cat", 1, 2]', '{"label": "cat"}', '{"class": "cat", "confidence": "x"}', "", None):
        with pytest.raises(Exception, match="unexpected shape"):
            spark.createDataFrame([(bad,)], "j string").select(detections.sanitised(F.col("j")).alias("d")).collect()


def test_suggestions_and_gains(spark):
    df = spark.createDataFrame([(5, 1, .9), (1, 5, .8), (1, 1, .85)], "fp int, fn int, a double")
    got = [list(r[0]) for r in df.select(evaluation.suggestions(F.col("fp"), F.col("fn"), F.col("a"), F.lit(.95))).collect()]
    assert got == [["raise_threshold", "edge_cases", "generalise"], ["lower_threshold", "overfitting", "more_data", "augment"], ["edge_cases", "generalise"]]
    g = spark.createDataFrame([("m", 1.), ("m", -2.), ("m", 0.), ("m", 3.), ("m", None)], "k string, g double")
    assert rows(evaluation.gain_summary(g, "k", "g")) == [("m", 5, 2, 1, 1, 2.0, -2.0)]
