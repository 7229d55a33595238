"""Queries on detections and labels.

Detections are the rows of lineitem: an order is an image, its flags the class,
its discount the confidence, its quantity the area. The log of label changes is
events: a user is a path.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from darkslide.operators import detections as d
from darkslide.operators import labels as lab
from darkslide.operators.evaluation import classify
from darkslide.operators.graph import connected_components
from darkslide.operators.hamming import hamming_pairs, hash_bits
from darkslide.operators.shared import Written
from darkslide.operators.skew import skew_safe_lookup
from darkslide.plans.grouping import items
from darkslide.sources.tables import table


def _detections(spark, data):
    t = table(spark, data, "lineitem")
    return t.select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("det"), F.concat("l_returnflag", "l_linestatus").alias("class"),
                    (F.col("l_discount") * 10).alias("conf"), (F.col("l_quantity") / 50).alias("area"), F.col("l_partkey").alias("part"))


def f12_confident(spark, data):
    return d.confident(_detections(spark, data), 0.3, 0.6, ["AF", "NO"], 0.2).select("image", "det", "part", "class")


def f13_top_of_image(spark, data):
    t = _detections(spark, data).withColumn("det", F.struct("det", "part"))
    return d.top_of_image(t).select("image", F.col("det.det").alias("det"), F.col("det.part").alias("part"), "rank")


def o8_overlay(spark, data):
    t = _detections(spark, data).withColumn("det", F.struct("det", "part"))
    return d.overlay(t, 0.4, 2).select("image", F.col("det.det").alias("det"), F.col("det.part").alias("part"))


def a22_classes_of_extremes(spark, data):
    """The commonest classes among wide and among narrow detections, with their share."""
    t = _detections(spark, data).select("class", F.when(F.col("area") >= 0.8, "high").when(F.col("area") <= 0.2, "low").alias("set")).filter("set is not null")
    n = t.groupBy("set", "class").agg(F.count("*").alias("n"))
    total = n.groupBy("set").agg(F.sum("n").alias("total"))
    return n.join(F.broadcast(total), "set").select("set", "class", "n", F.round(F.col("n") * 100 / F.col("total"), 6).alias("pct"))


def a23_summary(spark, data):
    return d.summary(_detections(spark, data), {"returned": ["AF", "RF"], "open": ["NO"]}).withColumn("best", F.round("best", 6))


def a24_best_of_class(spark, data):
    return d.best_of_class(_detections(spark, data)).withColumn("conf", F.round("conf", 6))


def a25_fullest_image(spark, data):
    return _detections(spark, data).groupBy("image").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "image").limit(1)


def a35_class_counts(spark, data):
    return _detections(spark, data).groupBy("class").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "class").limit(10)


def j2_undetected(spark, data):
    """Orders without a detection, to be processed."""
    o = table(spark, data, "orders").select(F.col("o_orderkey").alias("image"))
    return o.join(_detections(spark, data), "image", "left_anti")


def j2_with_detections(spark, data):
    """Every order with the classes of its detections, an empty list and a flag where there are none."""
    o = table(spark, data, "orders").select(F.col("o_orderkey").alias("image"))
    found = _detections(spark, data).groupBy("image").agg(F.sort_array(F.collect_set("class")).alias("classes"), F.count("*").alias("n"))
    j = o.join(found, "image", "left")
    return j.select("image", F.coalesce("classes", F.array().cast("array<string>")).alias("classes"), F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("to_process"))


def o4_by_confidence(spark, data):
    """All detections of an image by confidence, with their place."""
    w = Window.partitionBy("image").orderBy(F.desc("conf"), "det", "part")
    return _detections(spark, data).select("image", "det", "part", (F.row_number().over(w) - 1).alias("at"))


def x17_to_thumbnail(spark, data):
    t = _detections(spark, data)
    return t.select("image", "det", "part", d.to_thumbnail(F.col("area") * 400, F.lit(400.0), F.lit(130.0), 3).alias("x"), d.to_thumbnail(F.col("conf") * 300, F.lit(300.0), F.lit(97.0), 5).alias("y"))


def x18_area(spark, data):
    t = _detections(spark, data)
    a = F.col("area") * 100
    return t.select("image", "det", "part", F.round(d.area_ratio(a - 20, a / 2, a + 30, a * 2, F.lit(100.0), F.lit(80.0)), 6).alias("ratio"))


def x18_shown_area(spark, data):
    """The share for display, of boxes in pixels and, where the size is not known, in shares."""
    t, a = _detections(spark, data), F.col("area")
    known = F.col("det") % 2 == 0
    size = lambda v: F.when(known, F.lit(v))
    pixels = lambda p, s: F.when(known, p).otherwise(s)
    return t.select("image", "det", "part", F.round(d.shown_area(pixels(a * 10, a / 2), pixels(a * 5, a / 3), pixels(a * 90, a / 4), pixels(a * 60, a / 5), size(100.0), size(80.0)), 6).alias("ratio"))


def x20_sanitised(spark, data):
    """Detections written in the strict shapes, and read back."""
    t = _detections(spark, data).select("image", "det", "part", "class", F.round("conf", 2).alias("conf"))
    c = F.col("conf").cast("string")
    text = (
        F.when(F.col("det") % 3 == 0, F.concat(F.lit('{"class": "'), "class", F.lit('", "confidence": '), c, F.lit("}")))
        .when(F.col("det") % 3 == 1, F.concat(F.lit('{"name": "'), "class", F.lit('", "score": '), c, F.lit("}"))).otherwise(F.concat(F.lit('["'), "class", F.lit('", '), c, F.lit("]")))
    )
    return t.select("image", "det", "part", d.sanitised(text).alias("d")).select("image", "det", "part", "d.class", "d.conf")


def x19_normalised(spark, data):
    """Detections written in five different ways, and read back."""
    t = _detections(spark, data).select("image", "det", "part", "class", F.round("conf", 2).alias("conf"))
    c, q = F.col("conf").cast("string"), F.lit('"')
    text = (
        F.when(F.col("det") % 5 == 0, F.concat(F.lit('{"class": "'), "class", F.lit('", "score": '), c, F.lit("}")))
        .when(F.col("det") % 5 == 1, F.concat(F.lit('{"label": "'), "class", F.lit('", "scores": ['), c, F.lit(", 0.1]}")))
        .when(F.col("det") % 5 == 2, F.concat(F.lit('["'), "class", F.lit('", '), c, F.lit("]")))
        .when(F.col("det") % 5 == 3, F.concat(q, "class", q)).otherwise(F.concat(F.lit('{"name": "'), "class", F.lit('", "prob": "x"}')))
    )
    return t.select("image", "det", "part", d.normalised(text).alias("d")).select("image", "det", "part", "d.class", "d.conf")


def _log(spark, data):
    t = table(spark, data, "events")
    state = F.when(F.col("event_type") == "view", "keep").when(F.col("event_type") == "click", "trash").when(F.col("event_type") == "error", "")
    return t.select(F.col("user_id").alias("path"), F.col("event_id").alias("seq"), state.alias("state"), F.when(F.col("event_id") % 4 == 0, "manual").otherwise("auto").alias("source"), "value")


def r1_label_states(spark, data):
    return lab.label_states(_log(spark, data))


def r8_last_pending(spark, data):
    """Of changes held back, the last of each path counts."""
    return _log(spark, data).filter("state is not null").groupBy("path").agg(F.max_by("state", "seq").alias("state"), F.count("*").alias("n"))


def r10_replay(spark, data):
    t = table(spark, data, "events")
    action = F.when(F.col("event_type") == "error", "undo").when(F.col("event_type") == "click", "redo").otherwise("set")
    return lab.replay(t.select(F.col("user_id").alias("path"), F.col("event_id").alias("seq"), action.alias("action"), F.col("value").cast("string").alias("value")))


def _predictions(spark, data):
    i = items(spark, data)
    score = F.when(~F.isnan("pick_score"), F.col("pick_score"))
    return i.filter("filename is not null").select(F.col("filename").alias("path"), score.alias("p"), classify(F.col("pick_score")).alias("predicted"))


def _labels(spark, data):
    return items(spark, data).filter("filename is not null").select(F.col("filename").alias("path"), F.lower(F.trim(F.coalesce("label", F.lit("")))).alias("state"), F.coalesce("label_source", F.lit("manual")).alias("source"))


def r2_r3_applied(spark, data):
    return lab.applied(_labels(spark, data), _predictions(spark, data))


def r4_refreshed(spark, data):
    return lab.refreshed(_labels(spark, data), _predictions(spark, data))


def r9_review(spark, data):
    """Confident predictions flagged for review, of which the labelled by hand count as reviewed."""
    flagged = _predictions(spark, data).filter("p >= 0.9").join(_labels(spark, data), "path")
    return lab.review_stats(flagged.select((F.col("source") == "manual").alias("reviewed"), F.when((F.col("source") == "manual") & (F.col("state") != ""), F.col("state")).alias("user_label")))


def r9_actions(spark, data):
    """The queue after the last answer to each entry, and what it does to the labels: confirmed ones are applied, answered ones cleared."""
    flagged = lab.flagged(_predictions(spark, data).filter("predicted <> ''"), 0.9)
    answers = _labels(spark, data).filter("source = 'manual'").select("path", F.col("state").alias("user_label"), F.lit(1).cast("bigint").alias("seq"))
    return lab.review(flagged, answers)


def r5_dirty(spark, data):
    """After a new prediction: all unlabelled and automatically labelled paths with the label they get, and whether it is another."""
    return lab.dirty(_labels(spark, data), _predictions(spark, data))


def u5_labels_with_pending(spark, data):
    """Stored labels, overlaid by pending changes in order."""
    stored = _labels(spark, data).select("path", "state", F.lit(0).cast("bigint").alias("seq"))
    pending = _predictions(spark, data).filter("predicted <> ''").select("path", F.col("predicted").alias("state"), F.lit(1).cast("bigint").alias("seq"))
    return stored.unionByName(pending).groupBy("path").agg(F.max_by("state", "seq").alias("state"))


def g5_first_match_groups(spark, data):
    """Items in id order join the group of the first earlier hash within five bits: pointers to earlier hashes, then their roots."""
    i = items(spark, data).select("item_id", hash_bits("phash").alias("h")).filter("h is not null")
    first = Written(i.groupBy("h").agg(F.min("item_id").alias("at"), F.count("*").alias("n")), "hashes").df
    p = hamming_pairs(first.select("h"), 5)
    both = p.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
    near = both.join(first.select(F.col("h").alias("a"), F.col("at").alias("u")), "a").join(first.select(F.col("h").alias("b"), F.col("at").alias("v")), "b")
    parent = near.filter("v < u").groupBy("u").agg(F.min("v").alias("v"))
    roots = connected_components(parent).select(F.col("item").alias("at"), "root")
    rooted = first.join(roots, "at", "left").select("h", "n", F.coalesce("root", "at").alias("group_root"))
    return skew_safe_lookup(i, "h", rooted, ["group_root"], "n").select("item_id", "group_root")


QUERIES = {f.__name__: f for f in (
    f12_confident, f13_top_of_image, o8_overlay, a22_classes_of_extremes, a23_summary, a24_best_of_class, a25_fullest_image, a35_class_counts, j2_undetected, j2_with_detections, o4_by_confidence, x18_shown_area, x20_sanitised, r5_dirty, r9_actions,
    x17_to_thumbnail, x18_area, x19_normalised, r1_label_states, r8_last_pending, r10_replay, r2_r3_applied, r4_refreshed, r9_review, u5_labels_with_pending,
    g5_first_match_groups,
)}

D = "with d as (select l_orderkey as image, l_linenumber as det, l_returnflag || l_linestatus as class, l_discount * 10 as conf, l_quantity / 50 as area, l_partkey as part from lineitem)"
L = """with log as (select user_id as path, event_id as seq, case event_type when 'view' then 'keep' when 'click' then 'trash' when 'error' then '' end as state,
  case when event_id % 4 = 0 then 'manual' else 'auto' end as source from events)"""
P = """with i as (select distinct on (item_id) * from image_items where filename is not null),
s as (select *, case when isnan(pick_score) then null else pick_score end as sc from i),
pr as (select filename as path, sc as p, case when sc >= 0.7 then 'keep' when sc <= 0.3 then 'trash' else '' end as predicted from s),
lb as (select filename as path, lower(trim(coalesce(label, ''))) as state, coalesce(label_source, 'manual') as source from i)"""

_H = """with recursive i as (select distinct on (item_id) * from image_items where item_id is not null),
hx as (select item_id, case when regexp_full_match(phash, '[0-9A-Fa-f]{16}') then ('0x' || phash)::ubigint end as h from i)"""
ORACLE = {
    "g5_first_match_groups": _H + """, fs as (select h, min(item_id) as first from hx where h is not null group by h),
pa as (select a.first as u, min(b.first) as v from fs a join fs b on b.first < a.first and bit_count(xor(a.h, b.h)) <= 5 group by 1),
rt as (select first as x, first as r from fs where first not in (select u from pa) union all select pa.u, rt.r from rt join pa on pa.v = rt.x)
select item_id, rt.r as group_root from hx join fs using (h) join rt on rt.x = fs.first""",
    "r10_replay": """with recursive l as (select user_id as path, row_number() over (partition by user_id order by event_id) as k,
  case event_type when 'error' then 'undo' when 'click' then 'redo' else 'set' end as act, value::varchar as value from events where user_id is not null),
st as (select path, 0::bigint as k, null::varchar as now, []::struct(a varchar, b varchar)[] as done, []::struct(a varchar, b varchar)[] as undone from l where k = 1
  union all select st.path, l.k,
    case act when 'set' then value when 'undo' then case when len(done) > 0 then done[-1].a else now end else case when len(undone) > 0 then undone[-1].b else now end end,
    case act when 'set' then list_append(done, struct_pack(a := now, b := value))[-200:] when 'undo' then done[:-2] else case when len(undone) > 0 then list_append(done, undone[-1]) else done end end,
    case act when 'set' then [] when 'undo' then case when len(done) > 0 then list_append(undone, done[-1]) else undone end else undone[:-2] end
  from st join l on l.path = st.path and l.k = st.k + 1)
select path, now as value, len(done)::int as undoable, len(undone)::int as redoable from (select *, max(k) over (partition by path) as last from st) where k = last""",
    "f12_confident": D + " select image, det, part, class from d where conf >= 0.6 and class in ('AF', 'NO') and area >= 0.2",
    "f13_top_of_image": D + " select image, det, part, rank::int as rank from (select *, row_number() over (partition by image order by conf desc, area desc, det, part) as rank from d where conf >= 0.6 and area >= 0.01) where rank <= 3",
    "o8_overlay": D + """ select image, det, part from (select *, count_if(conf > 0.4) over (partition by image) as n, row_number() over (partition by image order by conf > 0.4 desc, conf desc, det, part) as k from d)
where n <= 2 or k <= 2""",
    "a22_classes_of_extremes": D + """ select "set", class, n, round(n * 100 / sum(n) over (partition by "set"), 6) as pct
from (select case when area >= 0.8 then 'high' when area <= 0.2 then 'low' end as "set", class, count(*) as n from d group by 1, 2) where "set" is not null""",
    "a23_summary": D + " select image, count(*) as n, round(max(conf), 6) as best, count(distinct class) as classes, bool_or(class in ('AF', 'RF')) as has_returned, bool_or(class = 'NO') as has_open from d group by image",
    "a24_best_of_class": D + " select image, class, round(max(conf), 6) as conf from d group by all",
    "a25_fullest_image": D + " select image, count(*) as n from d group by image order by n desc, image limit 1",
    "a35_class_counts": D + " select class, count(*) as n from d group by class order by n desc, class limit 10",
    "j2_undetected": "select o_orderkey as image from orders where o_orderkey not in (select l_orderkey from lineitem)",
    "j2_with_detections": D + " select o_orderkey as image, coalesce(list_sort(list_distinct(list(class) filter (class is not null))), []) as classes, count(class) as n, count(class) = 0 as to_process from orders left join d on image = o_orderkey group by 1",
    "o4_by_confidence": D + """ select image, det, part, (row_number() over (partition by image order by conf desc, det, part) - 1)::int as "at" from d""",
    "x18_shown_area": D + " select image, det, part, round(case when det % 2 = 0 then (area * 90 - area * 10) * (area * 60 - area * 5) / 8000.0 else area / 4 * (area / 5) end, 6) as ratio from d",
    "x20_sanitised": D + " select image, det, part, class, round(conf, 2) as conf from d",
    "r5_dirty": P + """ select path, state as old, case when p is null then state else predicted end as new, case when p is null then false else predicted <> state end as changed
from lb left join pr using (path) where state = '' or source = 'auto'""",
    "r9_actions": P + """, f as (select path, predicted, p from pr where predicted <> '' and p >= 0.9)
select path, predicted, p, source = 'manual' as reviewed, case when source = 'manual' then state end as user_label,
 case when source = 'manual' and state in ('keep', 'trash') then state end as applied, source = 'manual' as cleared from f left join lb using (path)""",
    "x17_to_thumbnail": D + " select image, det, part, trunc(area * 400 * 130.0 / 400.0)::int + 3 as x, trunc(conf * 300 * 97.0 / 300.0)::int + 5 as y from d",
    "x18_area": D + """, b as (select image, det, part, area * 100 as a from d), c as (select *, greatest(0, least(a - 20, 100)) as x1, greatest(0, least(a + 30, 100)) as x2, greatest(0, least(a / 2, 80)) as y1, greatest(0, least(a * 2, 80)) as y2 from b)
select image, det, part, round(greatest(0, x2 - x1) * greatest(0, y2 - y1) / 8000, 6) as ratio from c""",
    "x19_normalised": D + " select image, det, part, class, case when det % 5 in (0, 1, 2) then round(conf, 2) else 0.0 end as conf from d",
    "r1_label_states": L + """, m as (select path, max(seq) as ms, arg_max(state, seq) as m from log where state is not null and source = 'manual' group by 1), a as (select path, max(seq) as sq, arg_max(state, seq) as a from log where state is not null and source = 'auto' group by 1)
select path, case when m <> '' then m when sq > coalesce(ms, -1) then a else '' end as state, case when m <> '' or not coalesce(sq > coalesce(ms, -1), false) then 'manual' else 'auto' end as source from m full join a using (path)""",
    "r8_last_pending": L + " select path, arg_max(state, seq) as state, count(*) as n from log where state is not null group by path",
    "r2_r3_applied": P + " select path, predicted as state, 'auto' as source from lb join pr using (path) where state = '' and (predicted = 'keep' and p >= 0.8 or predicted = 'trash' and p <= 0.2)",
    "r4_refreshed": P + """ select path, state as old, coalesce(predicted, state) as new, case when coalesce(predicted, state) = state then 'same' when predicted = '' then 'removed' else 'changed' end as change
from lb left join pr using (path) where source = 'auto' and state <> ''""",
    "r9_review": P + """, f as (select source = 'manual' as r, case when source = 'manual' then nullif(state, '') end as u from lb join pr using (path) where p >= 0.9)
select count(*) as total, count_if(r)::bigint as reviewed, count_if(not r)::bigint as pending, count(u) as confirmed, (count_if(r) - count(u))::bigint as rejected from f""",
    "u5_labels_with_pending": P + " select path, case when coalesce(predicted, '') <> '' then predicted else state end as state from lb left join pr using (path)",
}
