"""Scalar functions over whole tables (text keys, boxes, cameras, colours, thumbnails)."""

from __future__ import annotations

from pyspark.sql import functions as F

from splatlake import fixtures as fx
from splatlake.functions import boxes, camera, images, text, weights
from splatlake.queries import query

MESSY = "concat(' The ', {t}.p_type, ' / ', {t}.p_brand, '--')"


@query("f1_normalize_label", """
SELECT p_partkey, trim(regexp_replace(lower(concat(' The ', p_type, ' / ', p_brand, '--')), '[^a-z0-9]+', '_', 'g'), '_') AS label
FROM part""")
def f1(spark, sf):
    part = fx.table(spark, sf, "part")
    raw = F.concat(F.lit(" The "), F.col("p_type"), F.lit(" / "), F.col("p_brand"), F.lit("--"))
    return part.select("p_partkey", text.normalize_label(raw).alias("label"))


@query("f2_detection_label", """
SELECT event_id, CASE WHEN event_type = 'error' THEN CASE WHEN user_id % 2 = 0 THEN 'unknown' ELSE 'user_x' END
                      ELSE concat(event_type, '_item') END AS label FROM events""")
def f2(spark, sf):
    ev = fx.table(spark, sf, "events")
    a = F.when(F.col("event_type") != "error", F.concat(F.lit(" "), F.initcap("event_type"), F.lit(" Item ")))
    b = F.when(F.col("user_id") % 2 == 0, F.lit("")).otherwise(F.lit("User X"))
    return ev.select("event_id", text.detection_label(a, b).alias("label"))


@query("f3_detection_score", """
SELECT event_id, greatest(0.05e0, CASE event_id % 4 WHEN 0 THEN value WHEN 1 THEN 1.0e0
       ELSE CAST(json_extract(props, '$.k') AS DOUBLE) END) AS score FROM events""")
def f3(spark, sf):
    ev = fx.table(spark, sf, "events")
    m = F.col("event_id") % 4
    score = F.when(m == 0, F.col("value").cast("string")).when(m == 1, F.lit("n/a"))
    confidence = F.when(m >= 2, F.get_json_object("props", "$.k"))
    return ev.select(
        "event_id", F.greatest(F.lit(0.05), text.detection_score(score, confidence)).alias("score")
    )


@query("f4_normalize_key", """
SELECT o_orderkey, CASE o_orderkey % 5
   WHEN 4 THEN concat('scan_', CAST(o_orderkey AS STRING), '_left')
   ELSE concat('frame_', CASE WHEN length(CAST(o_orderkey AS STRING)) < 6
               THEN lpad(CAST(o_orderkey AS STRING), 6, '0') ELSE CAST(o_orderkey AS STRING) END) END AS key
FROM orders""")
def f4(spark, sf):
    o = fx.table(spark, sf, "orders")
    n, k = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 5
    name = (
        F.when(k == 0, F.concat(F.lit("images/Frame_"), F.lpad(n, 8, "0"), F.lit(".PNG")))
        .when(k == 1, F.concat(F.lit("a/b/IMG-"), n, F.lit(".jpg")))
        .when(k == 2, n)
        .when(k == 3, F.concat(F.lit("x/my image "), n, F.lit(".jpeg")))
        .otherwise(F.concat(F.lit("Scan_"), n, F.lit("_LEFT.png")))
    )
    return o.select("o_orderkey", text.normalize_key(name).alias("key"))


@query("f5_frame_key", """
SELECT page_id, concat('frame_', CAST(page_id AS STRING)) AS rgb_key,
       concat('frame_', CAST(page_id AS STRING)) AS depth_key FROM pages""")
def f5(spark, sf):
    p = fx.table(spark, sf, "pages")
    base = F.concat(F.lit("d/frame_"), F.col("page_id").cast("string"))
    kinds = ["_rgb", "_image", "_mask", "_overlay"]
    suffix = F.element_at(F.array(*map(F.lit, kinds)), (F.col("page_id") % 4 + 1).cast("int"))
    depth = F.when(F.col("page_id") % 2 == 0, F.lit("_median_depth.npy")).otherwise(F.lit("_depth.npz"))
    return p.select(
        "page_id",
        text.frame_key(F.concat(base, suffix, F.lit(".png"))).alias("rgb_key"),
        text.frame_key(F.concat(base, F.lit("_rgb"), depth), depth=True).alias("depth_key"),
    )


@query("f8_object_key", """
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN lower(p_type)
  WHEN 1 THEN concat(lower(p_type), '_', CAST(p_size AS STRING))
  ELSE concat(lower(p_type), '__', 'item_', CAST(p_size AS STRING)) END AS object_key FROM part""")
def f8(spark, sf):
    part = fx.table(spark, sf, "part")
    m = F.col("p_partkey") % 3
    inst = F.when(m == 0, F.col("p_type")).when(
        m == 1, F.concat(F.col("p_type"), F.lit(" "), F.col("p_size").cast("string"))
    ).otherwise(F.concat(F.lit("Item #"), F.col("p_size").cast("string")))
    return part.select("p_partkey", text.object_key(F.col("p_type"), inst).alias("object_key"))


def _pairs(spark, sf):
    d = fx.view(spark, sf, "fx_detections")
    a = boxes.box("x1", "y1", "x2", "y2")
    other = boxes.box(F.col("y1"), F.col("x1") * 0.5, F.col("y1") + 90.0, F.col("x1") * 0.5 + 120.0)
    return d.select("detection_id", "width", "height", a.alias("a"), other.alias("b"))


_PAIR_SQL = fx.with_views("fx_detections", sql="""
p AS (SELECT detection_id, width, height, x1 AS ax1, y1 AS ay1, x2 AS ax2, y2 AS ay2,
             y1 AS bx1, x1 * 0.5e0 AS by1, y1 + 90.0e0 AS bx2, x1 * 0.5e0 + 120.0e0 AS by2 FROM fx_detections),
m AS (SELECT *, (ax2-ax1)*(ay2-ay1) AS aa, (bx2-bx1)*(by2-by1) AS ab,
        greatest(0.0e0, least(ax2,bx2)-greatest(ax1,bx1)) * greatest(0.0e0, least(ay2,by2)-greatest(ay1,by1)) AS inter FROM p)
""")


@query("f9_clip_box", _PAIR_SQL + """
SELECT detection_id, round(greatest(0.0e0, c2-c1) * greatest(0.0e0, d2-d1) / 200000.0e0, 6) AS area_fraction, c1 AS x1, d1 AS y1, c2 AS x2, d2 AS y2
FROM (SELECT detection_id, greatest(0.0e0, least(499.0e0, ax1)) c1, greatest(0.0e0, least(399.0e0, ay1)) d1,
      greatest(0.0e0, least(499.0e0, ax2)) c2, greatest(0.0e0, least(399.0e0, ay2)) d2 FROM m) q""")
def f9(spark, sf):
    p = _pairs(spark, sf).withColumn("c", boxes.clip(F.col("a"), F.lit(500), F.lit(400)))
    frac = boxes.area_fraction(F.col("c"), F.lit(500), F.lit(400))
    return p.select("detection_id", F.round(frac, 6).alias("area_fraction"), "c.*")


@query("f10_box_iou", _PAIR_SQL + """
SELECT detection_id, round(inter / (aa + ab - inter), 6) AS iou FROM m""")
def f10(spark, sf):
    return _pairs(spark, sf).select("detection_id", F.round(boxes.iou(F.col("a"), F.col("b")), 6).alias("iou"))


@query("f11_box_ios", _PAIR_SQL + """
SELECT detection_id, round(inter / least(aa, ab), 6) AS ios FROM m""")
def f11(spark, sf):
    ios = boxes.intersection_over_smaller(F.col("a"), F.col("b"))
    return _pairs(spark, sf).select("detection_id", F.round(ios, 6).alias("ios"))


@query("f12_center_distance", _PAIR_SQL + """
SELECT detection_id, round(sqrt(pow((ax1+ax2)/2-(bx1+bx2)/2, 2) + pow((ay1+ay2)/2-(by1+by2)/2, 2)) / 800.0e0, 6) AS distance FROM m""")
def f12(spark, sf):
    d = boxes.center_distance(F.col("a"), F.col("b"), F.col("width"), F.col("height"))
    return _pairs(spark, sf).select("detection_id", F.round(d, 6).alias("distance"))


@query("f13_area_ratio", _PAIR_SQL + """
SELECT detection_id, round(least(aa, ab) / greatest(aa, ab), 6) AS ratio FROM m""")
def f13(spark, sf):
    r = boxes.area_ratio(F.col("a"), F.col("b"))
    return _pairs(spark, sf).select("detection_id", F.round(r, 6).alias("ratio"))


@query("f15_intrinsics", """
SELECT c_custkey, round(fx_l, 5) AS fx_labelling, round(CASE WHEN k = 0 OR k = 1 THEN fl ELSE ang END, 5) AS fx_batch,
       round(CASE WHEN k = 0 THEN fl * 1.1e0 WHEN k = 1 THEN fl ELSE CASE WHEN k = 2 THEN fl * 1.1e0 ELSE ang END END, 5) AS fy_batch,
       320.0e0 AS cx, CASE WHEN k = 3 THEN 240.0e0 ELSE 236.5e0 END AS cy
FROM (SELECT *, CASE WHEN k = 0 OR k = 1 THEN fl ELSE ang END AS fx_l FROM (
  SELECT c_custkey, c_custkey % 4 AS k, 500.0e0 + c_nationkey AS fl,
         640 * 0.5e0 / tan((0.9e0 + c_nationkey / 100.0e0) * 0.5e0) AS ang FROM customer) a) b""")
def f15(spark, sf):
    c = fx.table(spark, sf, "customer")
    k = F.col("c_custkey") % 4
    fl = F.col("c_nationkey") + 500.0
    frame = {
        "fl_x": F.when(k <= 1, fl), "fl_y": F.when((k == 0) | (k == 2), fl * 1.1),
        "camera_angle_x": F.lit(None).cast("double"), "cx": F.lit(None).cast("double"),
        "cy": F.lit(None).cast("double"),
    }
    scene = {
        "fl_x": F.lit(None).cast("double"), "fl_y": F.lit(None).cast("double"),
        "camera_angle_x": F.col("c_nationkey") / 100.0 + 0.9, "cx": F.lit(None).cast("double"),
        "cy": F.when(k != 3, F.lit(236.5)),
    }
    lab = camera.intrinsics(frame, scene, F.lit(640), F.lit(480), "labelling")
    bat = camera.intrinsics(frame, scene, F.lit(640), F.lit(480), "batch")
    lab_fx = F.when(k == 2, lab[0]).otherwise(lab[0])
    return c.select(
        "c_custkey", F.round(lab_fx, 5).alias("fx_labelling"), F.round(bat[0], 5).alias("fx_batch"),
        F.round(bat[1], 5).alias("fy_batch"), bat[2].alias("cx"), F.coalesce(bat[3]).alias("cy"),
    )


def _gaussians(spark, sf):
    p = fx.view(spark, sf, "fx_points")
    k = F.col("point_id")
    bad = F.when(k % 50 == 0, F.lit(float("nan"))).otherwise(-4.0 + (k % 7) / 10.0)
    return p.select(
        "scan_id", "point_id", "x", "y", "z", "opacity",
        F.array(bad, -4.2 + (k % 11) / 10.0, -4.1 + (k % 13) / 20.0).alias("scale"),
    )


_SCALES = """
g AS (SELECT scan_id, point_id, opacity, CASE WHEN point_id % 50 = 0 THEN NULL ELSE
  greatest(exp(-4.0e0 + (point_id % 7) / 10.0e0), exp(-4.2e0 + (point_id % 11) / 10.0e0), exp(-4.1e0 + (point_id % 13) / 20.0e0)) END AS r
  FROM fx_points)
"""


@query("f17_world_radius", fx.with_views("fx_points", sql=_SCALES) + """
SELECT g.scan_id, point_id, round(coalesce(r, med), 6) AS radius
FROM g JOIN (SELECT scan_id, median(r) AS med FROM g GROUP BY scan_id) m ON g.scan_id = m.scan_id""")
def f17(spark, sf):
    return camera.world_radius(_gaussians(spark, sf)).select("scan_id", "point_id", F.round("radius", 6).alias("radius"))


@query("f18_sigma_alpha", fx.with_views("fx_points", sql=_SCALES) + """
SELECT scan_id, point_id, round(r, 6) AS sigma, round(1.0e0 / (1.0e0 + exp(-opacity)), 6) AS alpha FROM g WHERE point_id % 50 <> 0""")
def f18(spark, sf):
    out = camera.sigma_alpha(_gaussians(spark, sf)).where(~F.isnan("sigma"))
    return out.select("scan_id", "point_id", F.round("sigma", 6).alias("sigma"), F.round("alpha", 6).alias("alpha"))


@query("f19_footprint_radius", fx.with_views("fx_points", sql="""
SELECT scan_id, point_id, round(greatest(1.0e0, least(18.0e0, 125.0e0 * 2.0e0 * radius / greatest(abs(z), 1e-6))), 6) AS radius_px,
       round(greatest(1.0e0, least(64.0e0, 125.0e0 * 3.0e0 * radius / greatest(abs(z), 1e-5))), 6) AS cleanup_px FROM fx_points"""))
def f19(spark, sf):
    p = fx.view(spark, sf, "fx_points")
    f = F.lit(125.0)
    args = (F.col("radius"), F.abs("z"), f, F.lit(100.0))
    return p.select(
        "scan_id", "point_id", F.round(camera.footprint_radius(*args), 6).alias("radius_px"),
        F.round(camera.footprint_radius(*args, k=3.0, lo=1.0, hi=64.0, floor=1e-5), 6).alias("cleanup_px"),
    )


@query("f20_label_frequency_weight", fx.with_views("fx_masks", sql="""
n AS (SELECT scan_id, label, count(*) AS label_mask_count FROM fx_masks GROUP BY scan_id, label)
SELECT scan_id, label, label_mask_count,
  round(greatest(0.2e0, least(3.0e0, sqrt(median(label_mask_count) OVER (PARTITION BY scan_id) / label_mask_count))), 6) AS label_frequency_weight
FROM n"""))
def f20(spark, sf):
    out = weights.label_frequency_weight(fx.view(spark, sf, "fx_masks"))
    return out.withColumn("label_frequency_weight", F.round("label_frequency_weight", 6))


@query("f21_mask_area_weight", fx.with_views("fx_masks", sql="""
SELECT scan_id, mask_id, round(greatest(0.2e0, least(3.0e0, sqrt(0.04e0 / greatest(w * h / 19200.0e0, 1e-6)))), 6) AS weight FROM fx_masks"""))
def f21(spark, sf):
    m = fx.view(spark, sf, "fx_masks")
    frac = F.col("w") * F.col("h") / F.lit(19200.0)
    return m.select("scan_id", "mask_id", F.round(weights.mask_area_weight(frac), 6).alias("weight"))


@query("f22_role_weight", fx.with_views("fx_masks", sql="""
SELECT scan_id, mask_id, CASE label WHEN 'wall' THEN 0.05e0 WHEN 'floor' THEN 0.85e0 WHEN 'ceiling' THEN 0.85e0 ELSE 1.5e0 END AS role_weight,
       CASE WHEN label IN ('wall', 'floor', 'ceiling') THEN 0 ELSE 2 END AS dilation FROM fx_masks"""))
def f22(spark, sf):
    m = fx.view(spark, sf, "fx_masks")
    return m.select(
        "scan_id", "mask_id", weights.role_weight(F.col("label")).alias("role_weight"),
        weights.mask_dilation(F.col("label")).alias("dilation"),
    )


@query("f23_colors", """
SELECT p_partkey, greatest(55, CAST(concat('0x', substr(sha1(p_name), 1, 2)) AS INT)) AS label_r,
  greatest(55, CAST(concat('0x', substr(sha1(p_name), 3, 2)) AS INT)) AS label_g,
  70 + CAST(concat('0x', substr(sha256(p_name), 5, 2)) AS INT) % 170 AS track_b FROM part""")
def f23(spark, sf):
    part = fx.table(spark, sf, "part")
    lab, trk = text.label_color(F.col("p_name")), text.track_color(F.col("p_name"))
    return part.select("p_partkey", lab[0].alias("label_r"), lab[1].alias("label_g"), trk[2].alias("track_b"))


@query("f26_thumb_diff", """
SELECT a.vec_id AS vec_a, b.vec_id AS vec_b, round(list_sum(list_transform(range(1, 65), lambda i: abs(CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE)))) / 64, 6) AS diff
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def f26(spark, sf):
    e = fx.table(spark, sf, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_a"), F.col("vec_id").alias("vec_b"), F.col("embedding").alias("eb"))
    return e.select(F.col("vec_id").alias("vec_a"), "embedding").join(nxt, "vec_a").select(
        "vec_a", "vec_b", F.round(images.thumb_diff(F.col("embedding"), F.col("eb")), 6).alias("diff")
    )


def _pixels(spark, sf):
    """A 20 x 15 gray image per camera, with values from the order rows."""
    o = fx.table(spark, sf, "orders")
    return o.select(
        F.lit("s").alias("scan_id"), F.floor(F.col("o_orderkey") / 300).cast("int").alias("frame_index"),
        (F.col("o_orderkey") % 20).cast("int").alias("x"),
        F.floor((F.col("o_orderkey") % 300) / 20).cast("int").alias("y"),
        (F.col("o_custkey") % 256).cast("double").alias("value"),
    )


@query("f27_sharpness", """
WITH px AS (SELECT CAST(floor(o_orderkey / 300.0e0) AS INT) AS frame_index, CAST(o_orderkey % 20 AS INT) AS x,
  CAST(floor((o_orderkey % 300) / 20.0e0) AS INT) AS y, CAST(o_custkey % 256 AS DOUBLE) AS value FROM orders),
lap AS (SELECT a.frame_index, l.value + r.value + u.value + d.value - 4 * a.value AS lap FROM px a
  JOIN px l ON l.frame_index = a.frame_index AND l.y = a.y AND l.x = CASE WHEN a.x = 0 THEN 1 ELSE a.x - 1 END
  JOIN px r ON r.frame_index = a.frame_index AND r.y = a.y AND r.x = CASE WHEN a.x = 19 THEN 18 ELSE a.x + 1 END
  JOIN px u ON u.frame_index = a.frame_index AND u.x = a.x AND u.y = CASE WHEN a.y = 0 THEN 1 ELSE a.y - 1 END
  JOIN px d ON d.frame_index = a.frame_index AND d.x = a.x AND d.y = CASE WHEN a.y = 14 THEN 13 ELSE a.y + 1 END)
SELECT 's' AS scan_id, frame_index, round(var_pop(lap), 4) AS sharpness FROM lap GROUP BY frame_index""")
def f27(spark, sf):
    return images.sharpness(_pixels(spark, sf)).withColumn("sharpness", F.round("sharpness", 4))


@query("f28_hamming", """
SELECT o_orderkey, CAST(bit_count(xor(o_orderkey, o_custkey)) + bit_count(xor(o_orderkey * 31, o_custkey * 17))
  + bit_count(xor(o_custkey, 255)) + bit_count(xor(o_orderkey * 7919, o_custkey)) AS INT) AS distance FROM orders""")
def f28(spark, sf):
    o = fx.table(spark, sf, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        "o_orderkey",
        images.hamming(F.array(k, k * 31, c, k * 7919), F.array(c, c * 17, F.lit(255).cast("bigint"), c)).alias("distance"),
    )


@query("f29_color_to_sh", fx.with_views("fx_points", sql="""
SELECT scan_id, point_id, round((r / 255.0e0 - 0.5e0) / 0.28209479177387814e0, 6) AS sh_r, g AS back_g FROM fx_points"""))
def f29(spark, sf):
    p = fx.view(spark, sf, "fx_points")
    return p.select(
        "scan_id", "point_id", F.round(camera.color_to_sh(F.col("r")), 6).alias("sh_r"),
        camera.sh_to_color(camera.color_to_sh(F.col("g"))).alias("back_g"),
    )


@query("f30_quaternion_rotation", fx.with_views("fx_points", sql="""
q AS (SELECT scan_id, point_id, a / n AS w, b / n AS i, c / n AS j, d / n AS k FROM (
  SELECT *, sqrt(a*a + b*b + c*c + d*d) AS n FROM (
    SELECT scan_id, point_id, 1.0e0 + point_id % 3 AS a, x AS b, y AS c, z AS d FROM fx_points) s) t)
SELECT scan_id, point_id, round(1 - 2*(j*j + k*k), 6) AS m00, round(2*(i*j - w*k), 6) AS m01, round(2*(j*k + w*i), 6) AS m21 FROM q"""))
def f30(spark, sf):
    p = fx.view(spark, sf, "fx_points")
    q = F.array(1.0 + F.col("point_id") % 3, F.col("x"), F.col("y"), F.col("z"))
    r = p.select("scan_id", "point_id", camera.quat_to_rotation(q).alias("m"))
    return r.select(
        "scan_id", "point_id", F.round(F.col("m")[0], 6).alias("m00"), F.round(F.col("m")[1], 6).alias("m01"),
        F.round(F.col("m")[7], 6).alias("m21"),
    )


@query("f32_in_grid", fx.with_views("fx_points", sql="""
SELECT scan_id, point_id, round_even((x + 3.1e0) / 0.25e0, 0) BETWEEN 0 AND 19 AND round_even((y - 0.1e0) / 0.25e0, 0) BETWEEN 0 AND 7 AND round_even((z + 2.1e0) / 0.25e0, 0) BETWEEN 0 AND 11 AS inside FROM fx_points"""))
def f32_in_grid(spark, sf):
    origin = F.array(F.lit(-3.1), F.lit(0.1), F.lit(-2.1))
    axes = F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)])
    cell = camera.to_grid(F.col("x"), F.col("y"), F.col("z"), origin, axes, F.lit(0.25))
    return fx.view(spark, sf, "fx_points").select("scan_id", "point_id", camera.in_grid(cell, F.array(F.lit(20), F.lit(8), F.lit(12))).alias("inside"))


@query("f32_to_grid", fx.with_views("fx_points", sql="""
SELECT scan_id, point_id, CAST(round_even(((x + 3.1e0) * 0.8e0 + (z + 2.1e0) * 0.6e0) / 0.25e0, 0) AS INT) AS i,
  CAST(round_even((y - 0.1e0) / 0.25e0, 0) AS INT) AS j,
  CAST(round_even(((x + 3.1e0) * -0.6e0 + (z + 2.1e0) * 0.8e0) / 0.25e0, 0) AS INT) AS k FROM fx_points"""))
def f32(spark, sf):
    p = fx.view(spark, sf, "fx_points")
    origin = F.array(F.lit(-3.1), F.lit(0.1), F.lit(-2.1))
    axes = F.array(*[F.lit(v) for v in (0.8, 0.0, -0.6, 0.0, 1.0, 0.0, 0.6, 0.0, 0.8)])
    i, j, k = camera.to_grid(F.col("x"), F.col("y"), F.col("z"), origin, axes, F.lit(0.25))
    return p.select("scan_id", "point_id", i.alias("i"), j.alias("j"), k.alias("k"))


@query("f33_containment_log", """
SELECT user_id, CAST(max(event_id) AS BIGINT) AS step, CAST(max_by(event_id * 3, event_id) AS BIGINT) AS total_center_projected,
       round(max_by(value, event_id) / 1000, 6) AS boundary_inside_fraction FROM events GROUP BY user_id""")
def f33(spark, sf):
    ev = fx.table(spark, sf, "events")
    lines = ev.select(
        "user_id",
        F.concat(
            F.lit("[object-hull] step="), F.col("event_id").cast("string"), F.lit(" total_center_projected="),
            (F.col("event_id") * 3).cast("string"), F.lit(" boundary_inside_fraction="),
            (F.col("value") / 1000).cast("string"),
        ).alias("line"),
    )
    step = F.regexp_extract("line", r"^\[object-hull\] step=(\d+)", 1)
    last = lines.where(step != "").groupBy("user_id").agg(F.max_by("line", step.cast("bigint")).alias("line"))
    v = last.select("user_id", text.containment_values(F.col("line")).alias("v"))
    return v.select(
        "user_id", F.col("v")["step"].cast("bigint").alias("step"),
        F.col("v")["total_center_projected"].cast("double").cast("bigint").alias("total_center_projected"),
        F.round(F.col("v")["boundary_inside_fraction"].cast("double"), 6).alias("boundary_inside_fraction"),
    )
