"""Queries of the general problems: sessions (p1) and capture times (p4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from darkslide.functions.instants import utc_us
from darkslide.operators.photos import clean_camera, current_photos, epoch_us
from darkslide.operators.sessions import sessionize
from darkslide.sources.tables import table

TEN_MINUTES_US = 600_000_000


def p1_found(spark: SparkSession, data: str) -> DataFrame:
    """Sessions of each camera: camera_id, start_us, end_us, n_photos."""
    photos = current_photos(table(spark, data, "photo_metadata").select("filename", "row_id", "photo_ts", "camera_id", "ingested_at"))
    events = photos.select(clean_camera("camera_id").alias("camera_id"), epoch_us("photo_ts").alias("at"))
    return sessionize(events, "camera_id", "at", TEN_MINUTES_US).toDF("camera_id", "start_us", "end_us", "n_photos")


def p1_item_sessions(spark: SparkSession, data: str) -> DataFrame:
    """Items with the start of the session that their photo lies in, as a new session key."""
    photos = current_photos(table(spark, data, "photo_metadata").select("filename", "row_id", "photo_ts", "camera_id", "ingested_at"))
    at = photos.select("filename", clean_camera("camera_id").alias("camera_id"), epoch_us("photo_ts").alias("at")).filter("at is not null")
    found = sessionize(at, "camera_id", "at", TEN_MINUTES_US)
    # A session and its photos meet by camera and day; a session of several days has a row for each.
    day = 86_400_000_000
    days = found.withColumn("day", F.explode(F.sequence(F.expr(f"start div {day}L"), F.expr(f"end div {day}L"))))
    photo = at.withColumn("day", F.expr(f"at div {day}L")).alias("p")
    items = table(spark, data, "image_items").filter("filename is not null").select("item_id", "filename").distinct()
    s = days.alias("s")
    same = (F.col("p.camera_id") == F.col("s.key")) & (F.col("p.day") == F.col("s.day")) & F.col("p.at").between(F.col("s.start"), F.col("s.end"))
    return (
        items.join(photo, "filename").join(s, same)
        .select("item_id", F.col("p.camera_id").alias("camera_id"), F.col("s.start").alias("session_start_us"), F.col("s.n").alias("n_photos"))
    )


def _tag(name: str) -> F.Column:
    return F.try_element_at("exif", F.lit(name))


def p4_found(spark: SparkSession, data: str) -> DataFrame:
    """One UTC instant per readable record: src, rec_id, utc_us."""
    none = F.lit(None).cast("string")
    stamps = (
        table(spark, data, "photo_stamps").filter("stamp_id is not null").groupBy("stamp_id")
        .agg(F.max(F.struct("stamp_text", "home_zone")).alias("r"))
        .select(F.lit("stamp").alias("src"), F.col("stamp_id").alias("rec_id"), utc_us([(F.col("r.stamp_text"), none, none)], F.col("r.home_zone")).alias("utc_us"))
    )
    tags = ["DateTimeOriginal", "36867", "DateTime", "306", "SubSecTimeOriginal", "OffsetTimeOriginal", "SubSecTime", "OffsetTime"]
    items = (
        table(spark, data, "image_items").filter("item_id is not null and exif is not null")
        .select("item_id", F.struct(*[_tag(t).alias(t) for t in tags], F.col("home_zone").alias("home")).alias("r"))
        .groupBy("item_id").agg(F.max("r").alias("r"))
    )
    original, changed = (F.col("r.SubSecTimeOriginal"), F.col("r.OffsetTimeOriginal")), (F.col("r.SubSecTime"), F.col("r.OffsetTime"))
    readings = [(F.col("r.DateTimeOriginal"), *original), (F.col("r.`36867`"), *original), (F.col("r.DateTime"), *changed), (F.col("r.`306`"), *changed)]
    exif = items.select(F.lit("exif").alias("src"), F.col("item_id").alias("rec_id"), utc_us(readings, F.col("r.home")).alias("utc_us"))
    return stamps.unionByName(exif).filter("utc_us is not null")


QUERIES = {"p1_found": p1_found, "p1_item_sessions": p1_item_sessions, "p4_found": p4_found}

_PHOTOS = """
  select filename, photo_ts, coalesce(nullif(trim(regexp_replace(lower(camera_id), '\\s+', ' ', 'g')), ''), 'unknown') as camera_id
  from (select *, row_number() over (partition by filename order by ingested_at desc nulls last, row_id desc) as k
        from photo_metadata where filename is not null) where k = 1 and photo_ts is not null"""

_SESSIONS = f"""
with p as ({_PHOTOS}),
g as (select *, epoch_us(photo_ts) as us, lag(epoch_us(photo_ts)) over (partition by camera_id order by photo_ts, filename) as prev from p),
s as (select *, sum(case when prev is null or us - prev > 600000000 then 1 else 0 end)
      over (partition by camera_id order by photo_ts, filename rows unbounded preceding) as s from g)"""

ORACLE = {
    "p1_found": _SESSIONS + """
select camera_id, min(us)::bigint as start_us, max(us)::bigint as end_us, count(*)::bigint as n_photos from s group by camera_id, s""",
    "p1_item_sessions": _SESSIONS + """,
t as (select *, min(us) over (partition by camera_id, s) as start, count(*) over (partition by camera_id, s) as n from s)
select i.item_id, t.camera_id, t.start::bigint as session_start_us, t.n::bigint as n_photos
from (select distinct item_id, filename from image_items) i join t using (filename)""",
}
