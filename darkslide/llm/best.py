"""Queries on duplicate groups of items: the best photo and what the survivor takes over (p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from darkslide.llm.survivors import Bundle, descending, latest, survivors
from darkslide.llm.ties import assigned
from darkslide.operators.photos import current_photos, epoch_us
from darkslide.sources.tables import table

_BLANK = r"(?U)^\s*$"


def _members(spark: SparkSession, data: str) -> DataFrame:
    """Items in a group, with their photo's time; items without a filename do not meet in one task."""
    items = table(spark, data, "image_items").withColumn("group_id", assigned("group_id")).filter("group_id is not null and item_id is not null")
    items = items.withColumn("photo", F.coalesce("filename", F.concat(F.lit("\0"), F.col("item_id").cast("string"))))
    metadata = table(spark, data, "photo_metadata").select("filename", "row_id", "photo_ts", "camera_id", "ingested_at")
    photos = current_photos(metadata).select(F.col("filename").alias("photo"), "photo_ts")
    return items.join(photos, "photo", "left")


#: What a label given by hand adds to the trust in it: more than any time does.
_MANUAL = 1 << 60


def _bundles() -> list[Bundle]:
    """The photo itself; a label with its source and time; a rating with its time."""
    score = F.when(~F.isnan("pick_score"), F.col("pick_score"))
    at = epoch_us("photo_ts")
    manual = F.when(F.lower(F.trim("label_source")) == "manual", F.lit(_MANUAL)).otherwise(F.lit(0))
    return [
        Bundle("pick", F.lit(True), [*descending(score), at.isNull().cast("int"), at]),
        Bundle("label", F.col("label").isNotNull() & ~F.col("label").rlike(_BLANK), claims={"label": F.lower(F.trim("label"))}, trust=manual + latest("updated_at")),
        Bundle("rated", F.col("rating") > 0, claims={"rating": F.col("rating")}, trust=latest("updated_at")),
    ]


def p6_found(spark: SparkSession, data: str) -> DataFrame:
    """Of each group the best item and the members that give label and rating; -1 where none can."""
    best = survivors(_members(spark, data), "group_id", "item_id", _bundles())
    giver = lambda c: F.coalesce(c, F.lit(-1))
    return best.select("group_id", F.col("pick").alias("item_id"), giver("label").alias("label_item_id"), giver("rated").alias("rating_item_id"))


def p6_survivors(spark: SparkSession, data: str) -> DataFrame:
    """As p6_found, and the members whose album and file path it takes: most trust in total, where the path's folder has to be the album."""
    folder = F.regexp_extract("file_path", r"([^/\\]+)[/\\][^/\\]+$", 1)
    album = Bundle("album_from", ~F.coalesce("album", F.lit("")).rlike(_BLANK), claims={"album": F.col("album")}, trust=latest("updated_at"))
    path = Bundle("path_from", F.coalesce(folder, F.lit("")) != "", claims={"album": folder}, trust=latest("updated_at"))
    return survivors(_members(spark, data), "group_id", "item_id", [*_bundles(), album, path])


QUERIES = {"p6_found": p6_found, "p6_survivors": p6_survivors}

_BEST = """
with p as (select filename, photo_ts from (select *, row_number() over (partition by filename order by ingested_at desc nulls last, row_id desc) as k
    from photo_metadata where filename is not null) where k = 1),
m as (select distinct i.group_id, i.item_id, case when isnan(pick_score) then null else pick_score end as score, p.photo_ts, label,
    lower(trim(label_source)) as src, rating, updated_at, album, file_path
  from image_items i left join p using (filename) where group_id <> -1 and group_id is not null),
g as (select group_id from m group by 1 having count(distinct item_id) > 1),
a as (select group_id, item_id, row_number() over (partition by group_id order by score desc nulls last, photo_ts nulls last, item_id) as k from m),
b as (select group_id, item_id, row_number() over (partition by group_id order by coalesce(src, '') <> 'manual', updated_at desc nulls last, item_id) as k
  from m where trim(label) <> ''),
c as (select group_id, item_id, row_number() over (partition by group_id order by updated_at desc nulls last, item_id) as k from m where rating > 0)"""

ORACLE = {
    "p6_found": _BEST + """
select g.group_id, a.item_id, coalesce(b.item_id, -1) as label_item_id, coalesce(c.item_id, -1) as rating_item_id
from g join a on a.group_id = g.group_id and a.k = 1 left join b on b.group_id = g.group_id and b.k = 1
left join c on c.group_id = g.group_id and c.k = 1""",
    "p6_survivors": _BEST + """,
t as (select *, regexp_extract(file_path, '([^/\\\\]+)[/\\\\][^/\\\\]+$', 1) as folder, greatest(1, coalesce(epoch_us(updated_at), 0) + 2) as trust from m),
al as (select group_id, album as v, max(trust) as trust, arg_min(item_id, struct_pack(x := -trust, y := item_id)) as id from t where trim(album) <> '' group by 1, 2),
pa as (select group_id, folder as v, max(trust) as trust, arg_min(item_id, struct_pack(x := -trust, y := item_id)) as id from t where folder <> '' group by 1, 2),
o as (select group_id, al.id as album_from, pa.id as path_from, row_number() over (partition by group_id order by coalesce(al.trust, 0) + coalesce(pa.trust, 0) desc, al.id nulls last, pa.id nulls last) as k
  from al full join pa using (group_id, v))
select g.group_id, a.item_id as pick, b.item_id as label, c.item_id as rated, album_from, path_from
from g join a on a.group_id = g.group_id and a.k = 1 left join b on b.group_id = g.group_id and b.k = 1
left join c on c.group_id = g.group_id and c.k = 1 left join o on o.group_id = g.group_id and o.k = 1""",
}
