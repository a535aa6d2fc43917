"""Mask algebra over run tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from splatlake import fixtures as fx
from splatlake.operators import masks as ma
from splatlake.queries import query

W, H = fx.IMAGE_W, fx.IMAGE_H
MASK = ["scan_id", "frame_index", "mask_id"]
FRAME = ["scan_id", "frame_index"]
PX = """
px AS (SELECT scan_id, frame_index, mask_id, label, y, unnest(range(x0, x1)) AS x FROM fx_runs)"""
SUMS = "count(*) AS pixels, CAST(sum(x) AS BIGINT) AS sum_x, CAST(sum(y) AS BIGINT) AS sum_y"


def _runs(spark, sf):
    return fx.view(spark, sf, "fx_runs")


def _sums(runs, keys):
    """Pixel count and coordinate sums: equal only when the pixel sets are equal in practice."""
    w = F.col("x1") - F.col("x0")
    return runs.groupBy(*keys).agg(F.sum(w).alias("pixels"), F.sum(F.expr("(x0 + x1 - 1) * (x1 - x0) div 2")).alias("sum_x"),
                                   F.sum(F.col("y") * w).alias("sum_y"))


@query("u3_union_runs", fx.with_views("fx_runs", sql=PX + f"SELECT scan_id, frame_index, {SUMS} FROM (SELECT DISTINCT scan_id, frame_index, y, x FROM px) q GROUP BY ALL"))
def u3(spark, sf):
    return _sums(ma.union_runs(_runs(spark, sf), FRAME), FRAME)


@query("m1_dilate", fx.with_views("fx_runs", sql=PX + f""",
d AS (SELECT DISTINCT scan_id, frame_index, mask_id, y + dy AS y, x + dx AS x FROM px, (SELECT unnest(range(-2, 3)) AS dy) a, (SELECT unnest(range(-2, 3)) AS dx) b)
SELECT scan_id, frame_index, mask_id, {SUMS} FROM d WHERE y >= 0 AND y < 120 AND x >= 0 AND x < 160 GROUP BY ALL"""))
def m1(spark, sf):
    return _sums(ma.dilate(_runs(spark, sf), MASK, 2, W, H), MASK)


@query("m1_erode", fx.with_views("fx_runs", sql=PX + f""",
e AS (SELECT p.scan_id, p.frame_index, p.mask_id, p.y, p.x FROM px p JOIN px q ON q.scan_id = p.scan_id AND q.mask_id = p.mask_id AND abs(q.y - p.y) <= 1 AND abs(q.x - p.x) <= 1
  GROUP BY ALL HAVING count(*) = (least(p.y + 1, 119) - greatest(p.y - 1, 0) + 1) * (least(p.x + 1, 159) - greatest(p.x - 1, 0) + 1))
SELECT scan_id, frame_index, mask_id, {SUMS} FROM e GROUP BY ALL"""))
def m1_erode(spark, sf):
    r = _runs(spark, sf)
    return _sums(ma.erode(ma.union_runs(r, MASK), r, MASK, 1, W, H), MASK)


@query("m2_close_open")
def m2(spark, sf):
    r = _runs(spark, sf)
    return _sums(ma.close_open(ma.union_runs(r, MASK), r, MASK, W, H), MASK)


@query("u4_subtract_runs", fx.with_views("fx_runs", sql=PX + f"""
SELECT scan_id, frame_index, mask_id, {SUMS} FROM (SELECT DISTINCT p.scan_id, p.frame_index, p.mask_id, p.y, p.x FROM px p
 ANTI JOIN (SELECT * FROM px WHERE label = 'bed') b USING (scan_id, frame_index, y, x) WHERE p.label = 'wall') q GROUP BY ALL"""))
def u4(spark, sf):
    r = _runs(spark, sf)
    return _sums(ma.subtract_runs(r.where("label = 'wall'"), r.where("label = 'bed'"), FRAME, MASK), MASK)


@query("f14_mask_box", fx.with_views("fx_runs", sql="""
SELECT scan_id, frame_index, mask_id, CAST(min(x0) AS DOUBLE) AS x1_min, CAST(min(y) AS DOUBLE) AS y1_min, CAST(max(x1) AS DOUBLE) AS x2_max, CAST(max(y) + 1 AS DOUBLE) AS y2_max FROM fx_runs GROUP BY ALL"""))
def f14(spark, sf):
    return ma.mask_box(_runs(spark, sf), MASK)


@query("a9_mask_iou", fx.with_views("fx_runs", sql=PX + """,
n AS (SELECT scan_id, frame_index, mask_id, count(*) AS n FROM px GROUP BY ALL),
i AS (SELECT a.scan_id, a.frame_index, a.mask_id AS ma, b.mask_id AS mb, count(*) AS inter FROM px a JOIN px b ON a.scan_id = b.scan_id AND a.frame_index = b.frame_index AND a.y = b.y AND a.x = b.x AND a.label = 'wall' AND b.label = 'bed' GROUP BY ALL)
SELECT i.scan_id, i.frame_index, ma AS mask_a, mb AS mask_b, inter AS intersection, na.n + nb.n - inter AS union_pixels, round(inter / (na.n + nb.n - inter), 6) AS iou
FROM i JOIN n na ON na.scan_id = i.scan_id AND na.mask_id = ma JOIN n nb ON nb.scan_id = i.scan_id AND nb.mask_id = mb"""))
def a9(spark, sf):
    r = _runs(spark, sf)
    out = ma.mask_iou(r.where("label = 'wall'").withColumnRenamed("mask_id", "mask_a"), r.where("label = 'bed'").withColumnRenamed("mask_id", "mask_b"),
                      FRAME, "mask_a", "mask_b")
    return out.withColumn("iou", F.round("iou", 6))


@query("j18_second_model_agreement", fx.with_views("fx_masks", "fx_runs", sql=PX + """,
n AS (SELECT scan_id, mask_id, count(*) AS n FROM px GROUP BY ALL),
i AS (SELECT a.scan_id, a.mask_id AS ma, b.mask_id AS mb, count(*) AS inter FROM px a JOIN px b ON a.scan_id = b.scan_id AND a.frame_index = b.frame_index AND a.label = b.label AND a.y = b.y AND a.x = b.x
  AND a.mask_id % 2 = 0 AND b.mask_id % 2 = 1 GROUP BY ALL),
v AS (SELECT i.scan_id, ma, max(inter / (na.n + nb.n - inter)) AS iou FROM i JOIN n na ON na.scan_id = i.scan_id AND na.mask_id = ma JOIN n nb ON nb.scan_id = i.scan_id AND nb.mask_id = mb GROUP BY ALL)
SELECT m.scan_id, m.mask_id, round(CASE WHEN o.scan_id IS NOT NULL THEN coalesce(v.iou, 0) END, 6) AS agreement FROM fx_masks m
LEFT JOIN (SELECT DISTINCT scan_id, frame_index, label FROM px WHERE mask_id % 2 = 1) o USING (scan_id, frame_index, label)
LEFT JOIN v ON v.scan_id = m.scan_id AND v.ma = m.mask_id WHERE m.mask_id % 2 = 0 AND m.score >= 0.5e0"""))
def j18(spark, sf):
    m, r = fx.view(spark, sf, "fx_masks"), _runs(spark, sf)
    pilot = m.where("mask_id % 2 = 0").select("scan_id", "frame_index", "label", "mask_id", "score")
    return ma.agreement(pilot, r.where("mask_id % 2 = 0"), r.where("mask_id % 2 = 1")).select("scan_id", "mask_id", F.round("agreement", 6).alias("agreement"))


@query("s16_resize_runs", fx.with_views("fx_runs", sql=PX + f""",
d AS (SELECT scan_id, frame_index, mask_id, ty AS y, tx AS x FROM px JOIN (SELECT unnest(range(0, 45)) AS ty) a ON CAST(floor(ty * 120 / 45.0e0) AS INT) = y
  JOIN (SELECT unnest(range(0, 100)) AS tx) b ON CAST(floor(tx * 160 / 100.0e0) AS INT) = x)
SELECT scan_id, frame_index, mask_id, {SUMS} FROM d GROUP BY ALL"""))
def s16(spark, sf):
    return _sums(ma.resize_runs(_runs(spark, sf), MASK, (W, H), (100, 45)), MASK)


@query("m7_pyramid", fx.with_views("fx_runs", sql=PX + """
SELECT scan_id, frame_index, mask_id, f AS factor, count(*) AS pixels, sum(CAST(x / f AS INT)) AS sum_x, sum(CAST(y / f AS INT)) AS sum_y
FROM px, (VALUES (2), (4)) v(f) WHERE x % f = 0 AND y % f = 0 GROUP BY ALL"""))
def m7(spark, sf):
    return _sums(ma.pyramid(_runs(spark, sf), MASK, (W, H), (2, 4)), [*MASK, "factor"])


@query("m3_m4_clean_components")
def m3(spark, sf):
    out = ma.clean_components(_runs(spark, sf), MASK, W, H)
    info = [F.first(c).alias(c) for c in ("component_count", "kept_component_count", "filled_hole_count", "filled_hole_pixels")]
    return out.groupBy(*MASK).agg(F.sum(F.col("x1") - F.col("x0")).alias("pixels"), F.round(F.first("largest_component_ratio"), 6).alias("largest_component_ratio"), *info)


# 8-connected components without gaps filled: closure over touching runs of adjacent rows
@query("m3_component_count", fx.with_views("fx_runs", recursive=True, sql="""
r AS (SELECT *, row_number() OVER (PARTITION BY scan_id, mask_id ORDER BY y, x0) AS rn FROM fx_runs),
e AS (SELECT a.scan_id, a.mask_id, a.rn AS s, b.rn AS t FROM r a JOIN r b ON a.scan_id = b.scan_id AND a.mask_id = b.mask_id AND abs(a.y - b.y) = 1 AND a.x0 <= b.x1 AND b.x0 <= a.x1),
c AS (SELECT scan_id, mask_id, rn AS s, rn AS t FROM r UNION SELECT c.scan_id, c.mask_id, c.s, e.t FROM c JOIN e ON e.scan_id = c.scan_id AND e.mask_id = c.mask_id AND e.s = c.t)
SELECT scan_id, mask_id, CAST(count(DISTINCT root) AS INT) AS component_count FROM (SELECT scan_id, mask_id, s, min(t) AS root FROM c GROUP BY ALL) q GROUP BY ALL"""))
def m3_count(spark, sf):
    out = ma.clean_components(_runs(spark, sf), MASK, W, H, keep=10**6, ratio=0.0, max_hole=0)
    return out.select("scan_id", "mask_id", "component_count").distinct()


def _owned(spark, sf):
    m = fx.view(spark, sf, "fx_masks")
    c = m.select(*MASK, (F.col("score") * (1 + F.col("mask_id") % 3)).alias("rank_score"), F.col("mask_id").alias("ordinal"))
    return ma.own_pixels(c, _runs(spark, sf), W, H)


@query("m5_own_pixels")
def m5(spark, sf):
    out = _owned(spark, sf)
    return out.groupBy(*MASK).agg(
        F.coalesce(F.sum(F.col("x1") - F.col("x0")), F.lit(0)).alias("pixels"), F.max("rejection_reason").alias("rejection_reason"),
        F.round(F.max("remaining_after_overlap"), 6).alias("remaining_after_overlap"))


@query("a39_overlap_stats", fx.with_views("fx_runs", sql=PX + """,
b AS (SELECT scan_id, frame_index, mask_id, count(*) AS n FROM px WHERE label = 'wall' GROUP BY ALL),
a AS (SELECT scan_id, frame_index, mask_id, count(*) AS n FROM (SELECT p.* FROM px p ANTI JOIN (SELECT * FROM px WHERE label = 'bed') q USING (scan_id, frame_index, y, x) WHERE p.label = 'wall') z GROUP BY ALL)
SELECT b.scan_id, b.frame_index, b.mask_id, b.n AS before_pixels, b.n - coalesce(a.n, 0) AS suppressed_pixels, round(coalesce(a.n, 0) / b.n, 6) AS remaining_ratio FROM b LEFT JOIN a USING (scan_id, frame_index, mask_id)"""))
def a39(spark, sf):
    r = _runs(spark, sf)
    wall = r.where("label = 'wall'")
    out = ma.overlap_stats(wall, ma.subtract_runs(wall, r.where("label = 'bed'"), FRAME, MASK), MASK)
    return out.withColumn("remaining_ratio", F.round("remaining_ratio", 6))


@query("a39_suppressed_by_label", fx.with_views("fx_runs", sql=PX + """,
b AS (SELECT scan_id, label, count(*) AS n, count(DISTINCT mask_id) AS m FROM px WHERE label <> 'bed' GROUP BY ALL),
k AS (SELECT scan_id, label, count(*) AS n FROM (SELECT p.* FROM px p ANTI JOIN (SELECT * FROM px WHERE label = 'bed') q USING (scan_id, frame_index, y, x) WHERE p.label <> 'bed') z GROUP BY ALL)
SELECT b.scan_id, b.label, b.m AS masks, b.n - coalesce(k.n, 0) AS suppressed_pixels, round(1 - (b.n - coalesce(k.n, 0)) / b.n, 6) AS remaining_ratio FROM b LEFT JOIN k USING (scan_id, label)"""))
def a39_labels(spark, sf):
    r = _runs(spark, sf)
    rest = r.where("label <> 'bed'")
    stats = ma.overlap_stats(rest, ma.subtract_runs(rest, r.where("label = 'bed'"), FRAME, MASK), MASK)
    return ma.suppressed_by_label(stats, rest, MASK).withColumn("remaining_ratio", F.round("remaining_ratio", 6))


def _scores(spark, sf):
    """Class probabilities on a 40 x 30 image, one per order row and label."""
    o = fx.table(spark, sf, "orders").selectExpr(
        "concat('scan_', string(int(o_orderkey div 6000))) AS scan_id", "int(o_orderkey div 1200 % 5) AS frame_index",
        "int(o_orderkey % 40) AS x", "int(o_orderkey div 40 % 30) AS y",
        "explode(array(named_struct('label', 'wall', 'score', 0.3D + (o_orderkey * 13 % 60) / 100D), "
        "named_struct('label', 'floor', 'score', 0.3D + (o_orderkey * 29 % 60) / 100D))) AS s")
    top = F.max("s.score").over(Window.partitionBy("scan_id", "frame_index", "x", "y"))
    return o.select("scan_id", "frame_index", "x", "y", "s.label", "s.score", (F.col("s.score") == top).alias("predicted"))


@query("m6_arbitrate_structure")
def m6(spark, sf):
    cut = spark.createDataFrame([], "scan_id string, frame_index int, y int, x0 int, x1 int")
    out = ma.arbitrate_structure(_scores(spark, sf), cut, 40, 30)
    return out.groupBy("scan_id", "frame_index", "label").agg(F.sum(F.col("x1") - F.col("x0")).alias("pixels"), F.first("accepted").alias("accepted"))


@query("a8_mask_metrics", """
WITH s AS (SELECT CAST(floor(o_orderkey / 300.0e0) AS INT) AS mask_id, (o_orderkey * 37 % 101) / 10.0e0 - 5.0e0 AS l FROM orders)
SELECT mask_id, round(count(*) FILTER (WHERE l > 1) / count(*) FILTER (WHERE l > -1), 6) AS stability, count(*) FILTER (WHERE l > 0) AS pixel_count,
 round(avg(1/(1+exp(-l))) FILTER (WHERE l > 0), 6) AS positive_conf, round(count(*) FILTER (WHERE l > 0) / 300, 6) AS area_fraction FROM s GROUP BY mask_id""")
def a8(spark, sf):
    s = fx.table(spark, sf, "orders").selectExpr("int(o_orderkey div 300) AS mask_id", "int(o_orderkey % 20) AS x", "int(o_orderkey % 300 div 20) AS y",
                                                 "(o_orderkey * 37 % 101) / 10D - 5D AS logit")
    kept = s.where("logit > 0").selectExpr("mask_id", "y", "x AS x0", "x + 1 AS x1")
    out = ma.mask_metrics(s, kept, ["mask_id"], 20 * 15)
    return out.select("mask_id", F.round("stability", 6).alias("stability"), "pixel_count", F.round("positive_conf", 6).alias("positive_conf"), F.round("area_fraction", 6).alias("area_fraction"))
