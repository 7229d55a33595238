"""Queries of the catalogue: filters, EXIF values, lookups and status counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from darkslide.functions import exif
from darkslide.operators import filters as p
from darkslide.operators.evaluation import thresholds_hold
from darkslide.plans.grouping import BASE, items, photos
from darkslide.plans.studies import BIN_SQL, bins
from darkslide.sources.tables import table


def _ids(spark, data, condition):
    return items(spark, data).filter(condition).select("item_id")


def f1_rating(spark, data):
    return _ids(spark, data, p.rating_at_least(4))


def f2_tag(spark, data):
    return _ids(spark, data, p.has_tag(" Print "))


def f3_date(spark, data):
    return _ids(spark, data, p.date_prefix("2009:03"))


def f4_hide_manual(spark, data):
    return _ids(spark, data, p.not_manual(True))


def f5_all_criteria(spark, data):
    return _ids(spark, data, p.matches(rating=2, tag="web", date="2009", hide_manual=True))


def f7_filename(spark, data):
    return _ids(spark, data, p.filename_contains("DSC"))


def f8_exif_field(spark, data):
    return _ids(spark, data, p.exif_field_contains("model", "dx-"))


def f9_unlabelled(spark, data):
    return _ids(spark, data, p.unlabelled())


def f10_manual(spark, data):
    return items(spark, data).select("item_id", p.is_manual().alias("manual"), p.is_manual(strict_source=True).alias("manual_source"))


def f11_training_rows(spark, data):
    return items(spark, data).filter(p.trains()).select("item_id", F.when(F.lower(F.trim("label")) == "keep", 1).otherwise(0).alias("y"))


def f14_scored(spark, data):
    return _ids(spark, data, F.col("pick_score").isNotNull() & ~F.isnan("pick_score"))


def f15_feature_subset(spark, data):
    """Some bins of every vector, of either length."""
    v = table(spark, data, "preprocess_results").dropDuplicates(["item_id"]).filter("size(hist_feat) in (24, 48)").select("item_id", *bins())
    return v.select("item_id", *[F.round(f"h{i}", 6).alias(f"h{i}") for i in (0, 5, 11, 17, 23)])


def f16_class_presence(spark, data):
    i = items(spark, data)
    total = i.select(F.count("*").alias("total"))
    seen = i.select("item_id", F.explode(F.array_distinct("objects")).alias("class")).filter("class is not null").groupBy("class").agg(F.count("*").alias("n"))
    return seen.crossJoin(F.broadcast(total)).select("class", "n", F.when(F.col("n") / F.col("total") < 0.01, "insufficient_data").otherwise("ok").alias("status"))


def f17_exif_dates(spark, data):
    raw = F.coalesce(*[F.nullif(F.trim(exif.value(t)), F.lit("")) for t in ("DateTimeOriginal", "36867", "DateTime", "306")])
    kind = F.when(raw.isNull(), "missing").when(exif.capture_time().isNull(), "other").otherwise("standard")
    return items(spark, data).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def f18_problems(spark, data):
    return items(spark, data).select("item_id", F.concat_ws(",", p.problems()).alias("problems")).filter("problems <> ''")


def s5_capture_time(spark, data):
    i = items(spark, data).select("item_id", exif.capture_time().alias("t"), F.col("updated_at").alias("fallback"))
    return i.select("item_id", F.coalesce("t", "fallback").alias("taken_at"))


def s10_cache_key(spark, data):
    m = table(spark, data, "photo_metadata")
    key = F.sha2(F.concat_ws(":", "file_path", F.unix_timestamp(F.col("ingested_at").cast("timestamp")).cast("string"), F.col("file_size").cast("string")), 256)
    return m.filter("file_path is not null and ingested_at is not null and file_size is not null").select("row_id", key.alias("cache_key"))


def s8_cache_split(spark, data):
    """Items whose features are at hand, and those still to be computed."""
    i = items(spark, data).select("item_id")
    cache = table(spark, data, "preprocess_results").filter("size(hist_feat) in (24, 48)").select("item_id")
    hits = i.join(cache, "item_id", "left_semi").withColumn("state", F.lit("hit"))
    return hits.unionByName(i.join(cache, "item_id", "left_anti").withColumn("state", F.lit("needed")))


def s7_valid_cache(spark, data):
    """Cached vectors of the width of their mode, of files that are still there."""
    v = table(spark, data, "preprocess_results").dropDuplicates(["item_id"])
    width = F.when(F.col("feature_mode") == "FULL", 48).when(F.col("feature_mode") == "FAST", 24)
    return v.filter(F.size("hist_feat") == width).join(items(spark, data).select("filename"), "filename", "left_semi").select("item_id", "feature_mode")


def s12_group_cache(spark, data):
    """Whether a stored grouping still covers exactly the items there are: one row."""
    i = items(spark, data)
    stored = i.filter("group_id is not null").select("filename")
    now = i.select("filename")
    gone, new = stored.join(now, "filename", "left_anti"), now.join(stored, "filename", "left_anti")
    return gone.agg(F.count("*").alias("gone")).crossJoin(new.agg(F.count("*").alias("new"))).select("gone", "new", ((F.col("gone") == 0) & (F.col("new") == 0)).alias("valid"))


def s21_aligned_vectors(spark, data):
    """Every item with its vector of 24 bins, zeros where it has none."""
    v = table(spark, data, "preprocess_results").dropDuplicates(["item_id"]).filter("size(hist_feat) in (24, 48)").select("item_id", F.array(*bins()).alias("h"))
    j = items(spark, data).select("item_id").join(v, "item_id", "left").select("item_id", F.coalesce("h", F.array_repeat(F.lit(0.0), 24)).alias("h"))
    return j.select("item_id", F.round(F.aggregate("h", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.size("h").alias("width"))


def j1_photo_rows(spark, data):
    """Each item with its photo's time and camera, its tags out of the file, its stored rating and labels, its objects and its probability."""
    p = F.coalesce(F.when(~F.isnan("pick_score"), F.col("pick_score")), F.lit(0.5))
    known = F.coalesce(F.array_sort(F.array_distinct(F.filter("objects", lambda o: o.isNotNull()))), F.array().cast("array<string>"))
    state = F.lower(F.trim(F.coalesce("label", F.lit(""))))
    i = items(spark, data).select("item_id", "filename", exif.value("Model").alias("model"), exif.number("ISOSpeedRatings").alias("iso"), F.coalesce("rating", F.lit(0)).alias("rating"),
                                  F.size(F.coalesce("tags", F.array())).alias("n_tags"), state.alias("state"), known.alias("objects"), p.alias("p"))
    return i.join(photos(spark, data), "filename", "left")


def j3_probabilities(spark, data):
    """Every photo with its item's probability, 0.5 where there is none."""
    p = items(spark, data).filter("filename is not null").select("filename", "item_id", F.when(~F.isnan("pick_score"), F.col("pick_score")).alias("p"))
    names = table(spark, data, "photo_metadata").filter("filename is not null").select("filename").distinct()
    return names.join(p, "filename", "left").select("filename", "item_id", F.coalesce("p", F.lit(0.5)).alias("p"))


def j11_class_flags(spark, data):
    classes = ["person", "car", "bird", "bench", "dog", "cat", "bicycle", "boat"]
    return items(spark, data).select("item_id", *[F.coalesce(F.array_contains("objects", c), F.lit(False)).cast("int").alias(c) for c in classes])


# The classes of the reference's detector.
CLASSES = (
    "person", "bicycle", "car", "motorcycle", "airplane", "bus", "train", "truck", "boat", "traffic light", "fire hydrant", "stop sign", "parking meter",
    "bench", "bird", "cat", "dog", "horse", "sheep", "cow", "elephant", "bear", "zebra", "giraffe", "backpack", "umbrella", "handbag", "tie", "suitcase",
    "frisbee", "skis", "snowboard", "sports ball", "kite", "baseball bat", "baseball glove", "skateboard", "surfboard", "tennis racket", "bottle",
    "wine glass", "cup", "fork", "knife", "spoon", "bowl", "banana", "apple", "sandwich", "orange", "broccoli", "carrot", "hot dog", "pizza", "donut",
    "cake", "chair", "couch", "potted plant", "bed", "dining table", "toilet", "tv", "laptop", "mouse", "remote", "keyboard", "cell phone", "microwave",
    "oven", "toaster", "sink", "refrigerator", "book", "clock", "vase", "scissors", "teddy bear", "hair drier", "toothbrush",
)


def j11_all_class_flags(spark, data):
    """Flags of all classes of the detector, in lower case and _ for a space; others: classes that it doesn't know."""
    low = F.transform("objects", F.lower)
    others = F.array_sort(F.array_distinct(F.filter(low, lambda c: c.isNotNull() & ~c.isin(*CLASSES))))
    flags = [F.coalesce(F.array_contains("low", c), F.lit(False)).cast("int").alias(c.replace(" ", "_")) for c in CLASSES]
    return items(spark, data).select("item_id", low.alias("low"), F.coalesce(others, F.array().cast("array<string>")).alias("others")).select("item_id", *flags, "others")


def a4_status(spark, data):
    labelled = F.trim(p.text("label")) != ""
    auto = F.col("label_source") == "auto"
    return items(spark, data).agg(
        F.count("*").alias("total"), F.count_if(labelled).alias("labelled"), F.count_if(~labelled).alias("unlabelled"),
        F.count_if(labelled & ~F.coalesce(auto, F.lit(False))).alias("manual"), F.count_if(labelled & auto).alias("auto"),
    )


def x1_camera(spark, data):
    return items(spark, data).select("item_id", F.when(F.col("exif").isNull(), "unknown").otherwise(exif.camera_id()).alias("camera_id"))


def x2_exif_numbers(spark, data):
    """The ten numbers out of the tags, each with its default: as they are, bit 0 of the flash, and logarithms of speed, time and size."""
    size = table(spark, data, "photo_metadata").groupBy("filename").agg(F.max("file_size").alias("file_size"))
    i = items(spark, data).join(size, "filename", "left")
    names = [(t, n) for t, n in exif.NUMBERS.items() if t != "Flash"]
    logs = [("log_iso", exif.number("ISOSpeedRatings")), ("log_shutter", exif.number("ExposureTime")), ("log_size", F.coalesce("file_size", F.lit(0)))]
    return i.select("item_id", *[F.round(exif.number(t), 6).alias(n) for t, n in names], exif.flash_fired().alias("flash_fired"), *[F.round(F.log1p(c), 6).alias(n) for n, c in logs])


def x12_thresholds(spark, data):
    """Pairs of thresholds, as runs might propose them, and whether they hold."""
    m = table(spark, data, "benchmark_results").select("run_id", F.round(F.try_element_at("metrics", F.lit("accuracy")), 4).alias("keep"), F.round(F.try_element_at("metrics", F.lit("brier")) * 3, 4).alias("trash"))
    return m.withColumn("holds", thresholds_hold(F.col("keep"), F.col("trash")))


def x5_time_parts(spark, data):
    t = items(spark, data).select("item_id", exif.capture_time().alias("t")).filter("t is not null")
    return t.select("item_id", F.hour("t").alias("hour"), F.weekday("t").alias("weekday"), F.month("t").alias("month"), (F.weekday("t") >= 5).alias("weekend"))


def x8_light(spark, data):
    v = table(spark, data, "preprocess_results").dropDuplicates(["item_id"])
    warmth = exif.colour_temperature(F.col("mean_r"), F.col("mean_g"), F.col("mean_b"))
    return v.select("item_id", F.round(warmth, 6).alias("warmth"), F.round(exif.golden_hour(F.pmod("item_id", F.lit(24)), warmth), 6).alias("golden_hour"))


def x25_class_names(spark, data):
    o = items(spark, data).select(F.explode("objects").alias("o")).filter("o is not null").distinct()
    return o.select("o", F.lower("o").alias("low"), F.initcap(F.replace("o", F.lit("_"), F.lit(" "))).alias("title"))


QUERIES = {f.__name__: f for f in (
    f1_rating, f2_tag, f3_date, f4_hide_manual, f5_all_criteria, f7_filename, f8_exif_field, f9_unlabelled, f10_manual, f11_training_rows, f14_scored,
    f15_feature_subset, f16_class_presence, f17_exif_dates, f18_problems, s5_capture_time, s7_valid_cache, s8_cache_split, s10_cache_key, s12_group_cache,
    s21_aligned_vectors, j1_photo_rows, j3_probabilities, j11_class_flags, j11_all_class_flags, a4_status, x1_camera, x2_exif_numbers, x12_thresholds, x5_time_parts, x8_light, x25_class_names,
)}

I = "with i as (select distinct on (item_id) * from image_items), v as (select distinct on (item_id) * from preprocess_results)"  # noqa: E741
_ID = I + " select item_id from i where "
_MANUAL = "(coalesce(label_source, 'manual') = 'manual' and trim(coalesce(label, '')) <> '')"
_DATE = "coalesce(nullif(exif['DateTimeOriginal'], ''), nullif(exif['DateTime'], ''), '')"
_RAW = "coalesce(nullif(trim(exif['DateTimeOriginal']), ''), nullif(trim(exif['36867']), ''), nullif(trim(exif['DateTime']), ''), nullif(trim(exif['306']), ''))"
_TIME = f"case when regexp_full_match({_RAW}, '\\d{{4}}:\\d{{2}}:\\d{{2}} \\d{{2}}:\\d{{2}}:\\d{{2}}') then try_strptime({_RAW}, '%Y:%m:%d %H:%M:%S') end"


def _number(tag: str) -> str:
    v = f"trim(exif['{tag}'])"
    fraction = f"case when len(string_split({v}, '/')) = 2 and try_cast(string_split({v}, '/')[2] as double) <> 0 then try_cast(string_split({v}, '/')[1] as double) / try_cast(string_split({v}, '/')[2] as double) end"
    return f"coalesce({fraction}, try_cast({v} as double), {exif.DEFAULTS[tag]}::double)"


ORACLE = {
    "f1_rating": _ID + "rating >= 4",
    "f2_tag": _ID + "len(list_filter(tags, lambda t: lower(trim(t)) = 'print')) > 0",
    "f3_date": _ID + f"starts_with({_DATE}, '2009:03')",
    "f4_hide_manual": _ID + f"not {_MANUAL}",
    "f5_all_criteria": _ID + f"rating >= 2 and len(list_filter(tags, lambda t: lower(trim(t)) = 'web')) > 0 and starts_with({_DATE}, '2009') and not {_MANUAL}",
    "f7_filename": _ID + "contains(lower(filename), 'dsc')",
    "f8_exif_field": _ID + "len(list_filter(map_entries(exif), lambda e: lower(e.key) = 'model' and contains(lower(e.value), 'dx-'))) > 0",
    "f9_unlabelled": _ID + "trim(coalesce(label, '')) = ''",
    "f10_manual": I + f" select item_id, {_MANUAL} as manual, coalesce(label_source, 'manual') = 'manual' as manual_source from i",
    "f11_training_rows": I + " select item_id, case when lower(trim(label)) = 'keep' then 1 else 0 end as y from i where lower(trim(label)) in ('keep', 'trash') and coalesce(label_source, 'manual') = 'manual'",
    "f14_scored": _ID + "pick_score is not null and not isnan(pick_score)",
    "f15_feature_subset": I + " select item_id, " + ", ".join(f"round({BIN_SQL[i]}, 6) as h{i}" for i in (0, 5, 11, 17, 23)) + " from v where len(hist_feat) in (24, 48)",
    "f16_class_presence": I + """ select c as class, count(*) as n, case when count(*) / (select count(*) from i) < 0.01 then 'insufficient_data' else 'ok' end as status
from (select item_id, unnest(list_distinct(objects)) as c from i) group by c""",
    "f17_exif_dates": I + f" select case when {_RAW} is null then 'missing' when {_TIME} is null then 'other' else 'standard' end as kind, count(*) as n from i group by 1",
    "f18_problems": I + """ select * from (select item_id, concat_ws(',', case when rating is null or rating < 0 or rating > 5 then 'rating' end,
 case when tags is null or len(list_filter(tags, lambda t: t is null or trim(t) = '')) > 0 then 'tags' end,
 case when lower(trim(coalesce(label, ''))) not in ('', 'keep', 'trash') then 'label' end,
 case when coalesce(label_source, 'manual') not in ('manual', 'auto') then 'label_source' end) as problems from i) where problems <> ''""",
    "s5_capture_time": I + f" select item_id, coalesce({_TIME}, updated_at) as taken_at from i",
    "s7_valid_cache": I + " select item_id, feature_mode from v where len(hist_feat) = case feature_mode when 'FULL' then 48 when 'FAST' then 24 end and filename in (select filename from i)",
    "s8_cache_split": I + " select item_id, case when item_id in (select item_id from preprocess_results where len(hist_feat) in (24, 48)) then 'hit' else 'needed' end as state from i",
    "s10_cache_key": "select row_id, sha256(file_path || ':' || epoch(date_trunc('second', ingested_at))::bigint || ':' || file_size) as cache_key from photo_metadata where file_path is not null and ingested_at is not null and file_size is not null",
    "s12_group_cache": I + " select 0::bigint as gone, count(*) as new, count(*) = 0 as valid from i where group_id is null",
    "s21_aligned_vectors": I + ", b as (select item_id, " + " + ".join(BIN_SQL) + " as t from v where len(hist_feat) in (24, 48)) select i.item_id, round(coalesce(t, 0), 4) as total, 24::int as width from i left join b using (item_id)",
    "j1_photo_rows": BASE + f""" select item_id, i.filename, exif['Model'] as model, {_number('ISOSpeedRatings')} as iso, coalesce(rating, 0) as rating, coalesce(len(tags), 0)::int as n_tags,
 lower(trim(coalesce(label, ''))) as state, coalesce(list_sort(list_distinct(list_filter(objects, lambda o: o is not null))), []) as objects,
 coalesce(case when isnan(pick_score) then null else pick_score end, 0.5) as p, camera_id, us from i left join ph using (filename)""",
    "j3_probabilities": I + """ select n.filename, item_id, coalesce(case when isnan(pick_score) then null else pick_score end, 0.5) as p
from (select distinct filename from photo_metadata where filename is not null) n left join i using (filename)""",
    "j11_class_flags": I + " select item_id, " + ", ".join(f"coalesce(list_contains(objects, '{c}'), false)::int as {c}" for c in ("person", "car", "bird", "bench", "dog", "cat", "bicycle", "boat")) + " from i",
    "j11_all_class_flags": I + " select item_id, " + ", ".join(f"coalesce(list_contains(list_transform(objects, lambda c: lower(c)), '{c}'), false)::int as \"{c.replace(' ', '_')}\"" for c in CLASSES)
    + f", coalesce(list_sort(list_distinct(list_filter(list_transform(objects, lambda c: lower(c)), lambda c: c is not null and c not in {CLASSES}))), []) as others from i",
    "a4_status": I + """ select count(*) as total, count_if(trim(coalesce(label, '')) <> '')::bigint as labelled, count_if(trim(coalesce(label, '')) = '')::bigint as unlabelled,
 count_if(trim(coalesce(label, '')) <> '' and label_source is distinct from 'auto')::bigint as manual, count_if(trim(coalesce(label, '')) <> '' and label_source = 'auto')::bigint as auto from i""",
    "x1_camera": I + """ select item_id, case when nullif(trim(exif['Make']), '') is not null and nullif(trim(exif['Model']), '') is not null
 then concat_ws(' ', trim(exif['Make']), trim(exif['Model']), nullif(trim(exif['BodySerialNumber']), '')) else 'unknown' end as camera_id from i""",
    "x2_exif_numbers": I + ", z as (select filename, max(file_size) as file_size from photo_metadata group by 1) select item_id, " + ", ".join(f"round({_number(t)}, 6) as {n}" for t, n in exif.NUMBERS.items() if t != "Flash")
    + f", ({_number('Flash')}::bigint & 1)::int as flash_fired, round(ln(1 + {_number('ISOSpeedRatings')}), 6) as log_iso, round(ln(1 + {_number('ExposureTime')}), 6) as log_shutter, round(ln(1 + coalesce(file_size, 0)), 6) as log_size from i left join z using (filename)",
    "x12_thresholds": """select run_id, round(metrics['accuracy'], 4) as keep, round(metrics['brier'] * 3, 4) as trash,
 coalesce(round(metrics['accuracy'], 4) > 0 and round(metrics['accuracy'], 4) <= 1 and round(metrics['brier'] * 3, 4) >= 0 and round(metrics['brier'] * 3, 4) < 1
  and round(metrics['accuracy'], 4) > round(metrics['brier'] * 3, 4), false) as holds from benchmark_results""",
    "x5_time_parts": I + f" select item_id, hour(t)::int as hour, (isodow(t) - 1)::int as weekday, month(t)::int as month, isodow(t) >= 6 as weekend from (select item_id, {_TIME} as t from i) where t is not null",
    "x8_light": I + """ select item_id, round(w, 6) as warmth, round(least(1.0, case when h between 6 and 8 or h between 18 and 20 then 0.5 + 0.5 * greatest(0, w / 50) else 0.2 * greatest(0, w / 50) end), 6) as golden_hour
from (select item_id, item_id % 24 as h, case when mean_r + mean_g + mean_b > 0 then (mean_r - mean_b) / (mean_r + mean_g + mean_b) * 100 else 0 end as w from v)""",
    "x25_class_names": I + " select distinct o, lower(o) as low, array_to_string(list_transform(string_split(replace(o, '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') as title from (select unnest(objects) as o from i) where o is not null",
}
