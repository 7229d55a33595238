"""Detections in photos: normal form, filters, selections and summaries.

Rows are (image, det, class, conf, area): det numbers the detections of an image.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Keys under which detectors put names and scores, first match counts.
NAME_KEYS = ("name", "class", "label", "class_name", "label_name")
SCORE_KEYS = ("confidence", "score", "prob", "scores")


def normalised(json: Column) -> Column:
    """(class, conf) of a JSON detection: an object, a [name, score] list or a bare name.

    Unreadable scores are 0, a missing name is empty; null for null.
    """
    j = F.trim(json)
    name = F.coalesce(*[F.get_json_object(j, f"$.{k}") for k in NAME_KEYS], F.lit(""))
    given = F.coalesce(*[F.get_json_object(j, f"$.{k}") for k in SCORE_KEYS])
    score = F.when(given.startswith("["), F.get_json_object(given, "$[0]")).otherwise(given)
    bare = F.regexp_replace(j, r'^"|"$', "")
    cls = F.when(j.startswith("{"), name).when(j.startswith("["), F.coalesce(F.get_json_object(j, "$[0]"), F.lit(""))).otherwise(bare)
    conf = F.when(j.startswith("{"), score).when(j.startswith("["), F.get_json_object(j, "$[1]"))
    return F.when(j.isNotNull(), F.struct(cls.alias("class"), F.coalesce(conf.try_cast("double"), F.lit(0.0)).alias("conf")))


def sanitised(json: Column) -> Column:
    """(class, conf) of a JSON detection in one of the strict shapes, else an error: [name, score], or an object with class and confidence or name and score."""
    j = F.trim(json)
    get = lambda k: F.get_json_object(j, f"$.{k}")
    two = j.startswith("[") & (F.json_array_length(j) == 2)
    old = get("class").isNull() | get("confidence").isNull()
    name = F.when(two, F.get_json_object(j, "$[0]")).when(~old, get("class")).otherwise(get("name"))
    score = F.when(two, F.get_json_object(j, "$[1]")).when(~old, get("confidence")).otherwise(get("score")).try_cast("double")
    bad = F.raise_error(F.concat(F.lit("unexpected shape of a detection: "), F.coalesce(json, F.lit("null"))))
    return F.when((two | j.startswith("{")) & name.isNotNull() & score.isNotNull(), F.struct(name.alias("class"), score.alias("conf"))).otherwise(bad)


def shown_area(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Share of the picture for display: of a box (x1, y1, x2, y2) in pixels if the picture's size is known, else of a box (x, y, w, h) in shares of it."""
    known = width.isNotNull() & height.isNotNull() & (width != 0) & (height != 0)
    return F.when(known & (width * height > 0), (w - x) * (h - y) / (width * height)).when(known, 0.0).otherwise(F.coalesce(w * h, F.lit(0.0)))


def area_ratio(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """Share of the picture that a box covers, after it is cut to the picture; 0 for an empty picture."""
    inside = lambda v, top: F.greatest(F.lit(0.0), F.least(v, top))
    w, h = inside(x2, width) - inside(x1, width), inside(y2, height) - inside(y1, height)
    return F.when((width > 0) & (height > 0), F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h) / (width * height)).otherwise(0.0)


def to_thumbnail(v: Column, source: Column, target: Column, offset: int) -> Column:
    """A coordinate of the source scaled to the thumbnail, cut towards zero, moved by the offset."""
    return (v * target / source).cast("int") + offset


def confident(d: DataFrame, least: float, floor: float, classes: list[str], least_area: float) -> DataFrame:
    return d.filter((F.col("conf") >= max(least, floor)) & F.col("class").isin(classes) & (F.col("area") >= least_area))


def top_of_image(d: DataFrame, k: int = 3, least: float = 0.6, least_area: float = 0.01) -> DataFrame:
    w = Window.partitionBy("image").orderBy(F.desc("conf"), F.desc("area"), "det")
    return d.filter((F.col("conf") >= least) & (F.col("area") >= least_area)).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def overlay(d: DataFrame, least: float = 0.8, cap: int = 5) -> DataFrame:
    """The most confident ``cap`` of an image with more than ``cap`` above ``least``; else all of it."""
    high = F.col("conf") > least
    w = Window.partitionBy("image")
    order = w.orderBy(F.desc(high), F.desc("conf"), "det")
    r = d.withColumn("__high", F.count_if(high).over(w)).withColumn("__at", F.row_number().over(order))
    return r.filter((F.col("__high") <= cap) | (F.col("__at") <= cap)).drop("__high", "__at")


def best_of_class(d: DataFrame) -> DataFrame:
    return d.groupBy("image", "class").agg(F.max("conf").alias("conf"))


def summary(d: DataFrame, categories: dict[str, list[str]]) -> DataFrame:
    flags = [F.max(F.col("class").isin(c)).alias(f"has_{n}") for n, c in categories.items()]
    return d.groupBy("image").agg(F.count("*").alias("n"), F.max("conf").alias("best"), F.countDistinct("class").alias("classes"), *flags)
