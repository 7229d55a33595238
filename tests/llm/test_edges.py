"""Empty tables, nulls in any column, repeated rows, very long texts, and extra columns with clashing names."""

import pytest
from pyspark.sql import functions as F

from darkslide.llm.damage import damaged
from darkslide.llm.groups import p2_splits
from darkslide.llm.hash_to_min import components
from darkslide.llm.leaks import FOUND, near_windows
from darkslide.llm.neighbours import nearest
from darkslide.llm.overlaps import cross_split_overlaps
from darkslide.llm.random_mate import units

NAMES = ("pack", "sub", "block", "blocks", "bits", "n", "k", "v", "u", "item", "root", "text_of", "vec", "ids", "index", "edits", "__n", "g", "part")


def dressed(df):
    """With columns of the names that operators use inside."""
    for n in NAMES:
        if n not in df.columns:
            df = df.withColumn(n, F.lit(n))
    return df


def test_overlaps(spark):
    kind = "run_id bigint, split_name string, item_id bigint, group_id bigint, phash string"
    made = [(1, "train", 1, 5, "0" * 16), (1, "train", 1, 5, "0" * 16), (1, "test", 2, 5, None), (1, "val", 3, None, "0" * 15 + "f"), (1, "val", 4, None, "nothing"), (2, "test", 1, 5, "0" * 16), (3, "train", 1, 5, "0" * 16)]
    got = {tuple(r) for r in cross_split_overlaps(dressed(spark.createDataFrame(made, kind))).collect()}
    assert got == {(1, "test", 1, 2), (1, "val", 1, 3)}
    assert cross_split_overlaps(spark.createDataFrame([], kind)).count() == 0


def test_neighbours(spark):
    kind = "item_id bigint, hist_feat array<float>"
    made = [(1, [1., 0.]), (1, [1., 0.]), (2, [1., 0.]), (3, [0., 1.]), (4, None), (None, [1., 1.]), (5, []), (6, [1., None])]
    got = {r.item_id: list(r.neighbours) for r in nearest(dressed(spark.createDataFrame(made, kind)), 2).collect()}
    assert got == {1: [2, 3], 2: [1, 3], 3: [1, 2]}
    assert nearest(spark.createDataFrame([], kind), 2).count() == 0


@pytest.mark.parametrize("tie", [components, units])
def test_links(spark, tie):
    df = spark.createDataFrame([(1, 2), (1, 2), (2, None), (None, None), (3, 3), (-5, 2)], "u bigint, v bigint").withColumn("k", F.lit(7)).withColumn("to", F.lit(7)).withColumn("m", F.lit(7))
    assert sorted(tuple(r)[:2] for r in tie(df).collect()) == [(-5, -5), (1, -5), (2, -5)]
    assert tie(df.filter("u > 9")).count() == 0


def test_splits_of_a_catalogue(spark, tmp_path):
    kind = "item_id bigint, group_id bigint, burst_id bigint, label string"
    made = [(i, i // 2 if i < 40 else None, -1, [None, "Keep ", "trash", ""][i % 4]) for i in range(60)] + [(None, 1, 1, "keep"), (1, 0, -1, "Keep ")]
    dressed(spark.createDataFrame(made, kind)).write.parquet(str(tmp_path / "image_items.parquet"))
    got = p2_splits(spark, str(tmp_path)).collect()
    assert sorted(r.item_id for r in got) == list(range(60)) and {r.split for r in got} <= {"train", "val", "test"}
    split = {r.item_id: r.split for r in got}
    assert all(split[2 * i] == split[2 * i + 1] for i in range(20))


def test_texts(spark):
    passage = " ".join(f"w{i}" for i in range(12))
    docs = [(1, passage), (1, passage), (2, "x " * 300_000 + passage), (3, None), (None, passage), (4, ""), (5, " \n ")]
    df = dressed(spark.createDataFrame(docs, "doc_id bigint, text string"))
    items = dressed(spark.createDataFrame([(7, passage), (8, None), (None, passage)], "eval_id bigint, passage string").dropna(subset=["eval_id"]))
    assert sorted((r.doc_id, r.eval_id, r.edits) for r in near_windows(df, items, **FOUND).collect()) == [(1, 7, 0), (2, 7, 0)]
    odd = dressed(spark.createDataFrame([(1, "cafÃ© " * 50_000), (2, None), (None, "cafÃ©"), (3, "é"), (4, "")], "doc_id bigint, text string"))
    assert [(r.doc_id, r.n_stretches, r.restored) for r in damaged(odd).collect()] == [(1, 50_000, True)]
    assert damaged(odd.filter("doc_id > 9")).count() == 0 and near_windows(df.filter("doc_id > 9"), items, **FOUND).count() == 0
