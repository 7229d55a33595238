"""Stores beside the photos: ratings, caches, review queues, benchmark records, parameters."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RATING = "struct<rating: int, tags: array<string>, state: string, label_source: string, objects: array<string>>"
REVIEW = "struct<predicted_label: string, confidence: double, reviewed: boolean, user_label: string>"


def base_name(path: str) -> F.Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def load_ratings(spark: SparkSession, path: str) -> DataFrame:
    """Rows (filename, rating, tags, state, label_source, objects) of a JSON object keyed by file.

    Keys that end in the same file name are one photo: of each field the last entry that has it.
    """
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string, {RATING}>").alias("m"))
    rows = raw.select(F.posexplode(F.map_entries("m")).alias("at", "e")).select("at", base_name("e.key").alias("filename"), "e.value.*")
    fields = ["rating", "tags", "state", "label_source", "objects"]
    return rows.groupBy("filename").agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col("at"))).alias(f) for f in fields])


def save_ratings(ratings: DataFrame, path: str) -> None:
    """The whole store anew, one JSON row a photo; ``load_rating_rows`` reads it."""
    ratings.write.mode("overwrite").json(path)


def load_rating_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("filename string, rating int, tags array<string>, state string, label_source string, objects array<string>").json(path)


def load_reviews(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string, {REVIEW}>").alias("m"))
    return raw.select(F.explode(F.map_entries("m")).alias("e")).select(F.col("e.key").alias("filename"), "e.value.*")


def save_reviews(reviews: DataFrame, path: str) -> None:
    """The whole queue anew, one JSON row an entry; ``load_review_rows`` reads it."""
    reviews.write.mode("overwrite").json(path)


def load_review_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("filename string, predicted_label string, confidence double, reviewed boolean, user_label string").json(path)


def purge_features(spark: SparkSession, path: str, version: str, width: int) -> int:
    """Empty the cache of a version if any of its features has another width than expected; how many rows went."""
    where = f"{path}/feature_version={version}"
    stored = spark.read.parquet(where)
    n, wrong = stored.agg(F.count("*"), F.count_if(F.coalesce(F.size("features"), F.lit(-1)) != width)).first()
    if wrong:
        spark.createDataFrame([], stored.schema).write.mode("overwrite").parquet(where)
    return n if wrong else 0


def fresh(cached: DataFrame, files: DataFrame) -> DataFrame:
    """Cached rows (path, modified, ...) of files (path, modificationTime) that have not changed since."""
    now = files.select("path", F.unix_micros("modificationTime").alias("__now"))
    return cached.join(now, "path").filter(F.col("modified") == F.col("__now")).drop("__now")


def group_cache_valid(stored: DataFrame, files: DataFrame) -> bool:
    """Whether a stored grouping (path, modified) has just the files there are, each with its time."""
    now = files.select("path", F.unix_micros("modificationTime").alias("modified"))
    return stored.select("path", "modified").exceptAll(now).isEmpty() and now.exceptAll(stored.select("path", "modified")).isEmpty()


def save_baseline(metrics: dict[str, float], path: str) -> None:
    """The metrics that later runs are compared with."""
    save_parameters(metrics, path)


def against_baseline(runs: DataFrame, path: str) -> DataFrame:
    """(run_id, metric, value, baseline) of runs (run_id, metrics) for the metrics of a stored baseline; none without one."""
    spark, base = runs.sparkSession, load_parameters(path)
    known = spark.createDataFrame([(k, float(v)) for k, v in base.items()], "metric string, baseline double")
    return runs.select("run_id", F.explode("metrics").alias("metric", "value")).join(F.broadcast(known), "metric").select("run_id", "metric", "value", "baseline")


def save_features(features: DataFrame, path: str, version: str) -> None:
    """Features of one version replace those of that version only."""
    features.write.mode("overwrite").parquet(f"{path}/feature_version={version}")


def load_features(spark: SparkSession, path: str, version: str, width: int) -> DataFrame:
    """Features of a version that have the right width; others are as if not there."""
    return spark.read.parquet(f"{path}/feature_version={version}").filter(F.size("features") == width)


def split_by_cache(keyed: DataFrame, cached: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """What is cached, and what is still needed."""
    return keyed.join(cached.select(key), key, "left_semi"), keyed.join(cached.select(key), key, "left_anti")


def save_detections(detections: DataFrame, path: str) -> None:
    detections.write.mode("overwrite").partitionBy("backend").parquet(path)


def load_detections(spark: SparkSession, path: str, backend: str) -> DataFrame:
    """Cached detections of one backend; the partition of another is not read."""
    return spark.read.parquet(path).filter(F.col("backend") == backend)


def append_benchmark(record: DataFrame, path: str) -> None:
    record.write.mode("append").json(path)


def load_benchmarks(spark: SparkSession, pattern: str) -> DataFrame:
    """Benchmark records of all files of a pattern, each an object or a list of them, with the file they come from."""
    return spark.read.option("multiLine", "true").json(pattern).withColumn("source_file", F.input_file_name())


def load_parameters(path: str) -> dict:
    """Best parameters of a model; none if there is no readable file."""
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except (OSError, ValueError):
        return {}


def save_parameters(values: dict, path: str) -> None:
    part = f"{path}.part"
    with open(part, "w", encoding="utf-8") as f:
        json.dump(values, f, indent=2, sort_keys=True)
    os.replace(part, path)


def parameter_values(text: str) -> list:
    """``a,b,c`` or ``start:end:step`` (end included) as ints where all are, else floats, else strings."""
    def value(x: str):
        for kind in (int, float):
            try:
                return kind(x)
            except ValueError:
                pass
        return x.strip()

    if text.count(":") == 2:
        start, end, step = (value(x) for x in text.split(":"))
        if any(isinstance(x, str) for x in (start, end, step)) or step == 0:
            raise ValueError(f"not a range: {text}")
        n = int((end - start) / step + 1e-9) + 1
        return [start + i * step for i in range(max(0, n))]
    out = [value(x) for x in text.split(",") if x.strip()]
    return [float(x) for x in out] if any(isinstance(x, float) for x in out) and not any(isinstance(x, str) for x in out) else out


def votes(lines: DataFrame, column: str = "value") -> DataFrame:
    """(image_id, votes array<int>) of lines ``index image_id v1 ... v10 ...``; shorter lines and those without a vote are left out."""
    f = F.split(F.trim(column), r"\s+")
    rows = lines.select(f.alias("f")).filter(F.size("f") >= 12)
    v = rows.select(F.col("f")[1].alias("image_id"), F.transform(F.slice("f", 3, 10), lambda x: x.try_cast("int")).alias("votes"))
    return v.filter(F.forall("votes", lambda x: x.isNotNull()) & (F.aggregate("votes", F.lit(0), lambda a, x: a + x) > 0))


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)
