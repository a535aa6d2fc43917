"""Projection, visibility, voting and point labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from splatlake import fixtures as fx
from splatlake.functions import camera
from splatlake.operators import projection as pj, ranking as rk, votes as vt
from splatlake.plans import labelling as plan
from splatlake.queries import query

W, H = fx.IMAGE_W, fx.IMAGE_H
MASK = plan.MASK

# --- oracle building blocks: brute force over the same views ------------------------------
PROJ = """
cam AS (SELECT *, yaw_c / (yaw_c*yaw_c + yaw_s*yaw_s) AS ca, yaw_s / (yaw_c*yaw_c + yaw_s*yaw_s) AS sa FROM fx_frames),
pc AS (SELECT p.scan_id, f.frame_index, p.point_id, p.radius,
   ca*p.x + (-sa)*p.z + -(ca*cam_x + (-sa)*cam_z) AS xc, p.y - cam_y AS yc,
   -(sa*p.x + ca*p.z + -(sa*cam_x + ca*cam_z)) AS z FROM fx_points p JOIN cam f ON f.scan_id = p.scan_id),
pf AS (SELECT *, 125.0e0 * (xc / z) + 80.0e0 AS fu, 125.0e0 * (-yc / z) + 60.0e0 AS fv FROM pc WHERE z > 0.05e0 AND z < 20.0e0),
proj AS (SELECT scan_id, frame_index, point_id, radius, z, CAST(floor(fu) AS INT) AS u, CAST(floor(fv) AS INT) AS v, fu, fv
   FROM pf WHERE fu >= 0 AND fu < 160 AND fv >= 0 AND fv < 120)"""
ZB = """,
zb AS (SELECT scan_id, frame_index, v, u, min(z) AS z_ref FROM proj GROUP BY ALL),
zb5 AS (SELECT scan_id, frame_index, v + dv AS v, u + du AS u, min(z_ref) AS z_ref FROM zb,
   (SELECT unnest(range(-2, 3)) AS dv) a, (SELECT unnest(range(-2, 3)) AS du) b
   WHERE v + dv >= 0 AND v + dv < 120 AND u + du >= 0 AND u + du < 160 GROUP BY ALL)"""
VIS = """,
vis AS (SELECT p.*, r.z_ref, greatest(1.0e0, least(18.0e0, 250.0e0 * radius / greatest(z, 1e-6))) AS rad FROM proj p
   JOIN zb5 r USING (scan_id, frame_index, v, u) WHERE abs(z - z_ref) <= greatest(0.25e0, 0.1e0 * z_ref))"""
MPX = """,
rr AS (SELECT *, CASE WHEN label IN ('wall', 'floor', 'ceiling') THEN 0 ELSE 2 END AS rad FROM fx_runs),
mrow AS (SELECT scan_id, frame_index, mask_id, label, y + unnest(range(-rad, rad + 1)) AS y, greatest(0, x0 - rad) AS x0, least(160, x1 + rad) AS x1 FROM rr),
mpx AS (SELECT DISTINCT scan_id, frame_index, mask_id, label, y, unnest(range(x0, x1)) AS x FROM mrow WHERE y >= 0 AND y < 120)"""
STATIC = """,
freq AS (SELECT scan_id, label, n, greatest(0.2e0, least(3.0e0, sqrt(median(n) OVER (PARTITION BY scan_id) / n))) AS fw
   FROM (SELECT scan_id, label, count(*) AS n FROM fx_masks GROUP BY ALL) q),
prep AS (SELECT m.scan_id, m.frame_index, m.mask_id, m.label, greatest(m.score, 0.05e0) AS score, f.n, f.fw, a.px / 19200.0e0 AS frac,
   greatest(0.2e0, least(3.0e0, sqrt(0.04e0 / greatest(a.px / 19200.0e0, 1e-6)))) AS aw,
   CASE m.label WHEN 'wall' THEN 0.05e0 WHEN 'floor' THEN 0.85e0 WHEN 'ceiling' THEN 0.85e0 ELSE 1.5e0 END AS rw
   FROM fx_masks m JOIN freq f USING (scan_id, label)
   JOIN (SELECT scan_id, frame_index, mask_id, count(*) AS px FROM mpx GROUP BY ALL) a USING (scan_id, frame_index, mask_id))"""
FG = """,
obj AS (SELECT * FROM mpx WHERE label NOT IN ('wall', 'floor', 'ceiling')),
big AS (SELECT DISTINCT scan_id, frame_index, mask_id, y, unnest(range(x0, x1)) AS x FROM (
   SELECT scan_id, frame_index, mask_id, y + unnest(range(-10, 11)) AS y, greatest(0, x0 - 10) AS x0, least(160, x1 + 10) AS x1 FROM (
     SELECT scan_id, frame_index, mask_id, y, min(x) AS x0, max(x) + 1 AS x1 FROM (
       SELECT *, x - row_number() OVER (PARTITION BY scan_id, frame_index, mask_id, y ORDER BY x) AS g FROM obj) q
     GROUP BY scan_id, frame_index, mask_id, y, g) q2) q3 WHERE y >= 0 AND y < 120),
zone AS (SELECT b.*, o.mask_id IS NOT NULL AS inner_px FROM big b LEFT JOIN obj o USING (scan_id, frame_index, mask_id, y, x)),
fgs AS (SELECT z.scan_id, z.frame_index, z.mask_id, count(*) FILTER (WHERE inner_px) AS n_in, count(*) FILTER (WHERE NOT inner_px) AS n_ring,
   quantile_cont(z_ref, 0.35) FILTER (WHERE inner_px) AS d_in, median(z_ref) FILTER (WHERE NOT inner_px) AS d_ring
   FROM zone z JOIN zb5 r ON r.scan_id = z.scan_id AND r.frame_index = z.frame_index AND r.v = z.y AND r.u = z.x GROUP BY ALL),
fg AS (SELECT m.scan_id, m.frame_index, m.mask_id, m.label, coalesce(n_in, 0) AS n_in, coalesce(n_ring, 0) AS n_ring,
   CASE WHEN n_in >= 80 AND n_ring >= 80 THEN d_ring - d_in END AS delta FROM (SELECT * FROM fx_masks WHERE label NOT IN ('wall', 'floor', 'ceiling')) m
   LEFT JOIN fgs USING (scan_id, frame_index, mask_id))"""
USABLE = """,
objok AS (SELECT o.* FROM obj o JOIN fg USING (scan_id, frame_index, mask_id) WHERE delta IS NULL OR delta >= 0.15e0),
block AS (SELECT DISTINCT scan_id, frame_index, y + dy AS y, x + dx AS x FROM (SELECT DISTINCT scan_id, frame_index, y, x FROM objok) q,
   (SELECT unnest(range(-4, 5)) AS dy) a, (SELECT unnest(range(-4, 5)) AS dx) b),
usable AS (SELECT scan_id, frame_index, mask_id, y, x FROM objok UNION ALL
   SELECT m.scan_id, m.frame_index, m.mask_id, m.y, m.x FROM mpx m ANTI JOIN block b USING (scan_id, frame_index, y, x) WHERE label IN ('wall', 'floor', 'ceiling'))"""
OFFS = """,
offs(dx, dy, w) AS (VALUES (0.0e0, 0.0e0, 1.0e0), (0.5e0, 0.0e0, 0.7e0), (-0.5e0, 0.0e0, 0.7e0), (0.0e0, 0.5e0, 0.7e0), (0.0e0, -0.5e0, 0.7e0),
  (0.45e0, 0.45e0, 0.5e0), (-0.45e0, 0.45e0, 0.5e0), (0.45e0, -0.45e0, 0.5e0), (-0.45e0, -0.45e0, 0.5e0)),
smp AS (SELECT scan_id, frame_index, point_id, CAST(round_even(u + dx * rad, 0) AS INT) AS x, CAST(round_even(v + dy * rad, 0) AS INT) AS y, w / 5.8e0 AS w FROM vis, offs)"""
COVER = OFFS + """,
cover AS (SELECT s.scan_id, s.frame_index, s.point_id, m.mask_id, sum(w) AS coverage FROM smp s JOIN usable m USING (scan_id, frame_index, y, x) GROUP BY ALL)"""
LIMITS = """,
limits AS (SELECT scan_id, CASE WHEN lo >= hi THEN a ELSE lo END AS flo, CASE WHEN lo >= hi THEN b ELSE hi END AS ceil_ FROM (
  SELECT scan_id, quantile_cont(y, 0.12) + 0.35e0 AS lo, quantile_cont(y, 0.88) - 0.35e0 AS hi, quantile_cont(y, 0.15) AS a, quantile_cont(y, 0.85) AS b
  FROM fx_points GROUP BY scan_id) q)"""
VOTES = """,
cand AS (SELECT c.*, p.label, p.score * (p.fw * p.aw * p.rw) * c.coverage * 0.65e0 AS weight, p.label IN ('wall', 'floor', 'ceiling') AS surf,
   p.fw * p.aw * p.rw AS sw, p.score FROM cover c JOIN prep p USING (scan_id, frame_index, mask_id) JOIN fx_points pt USING (scan_id, point_id) JOIN limits l USING (scan_id)
   WHERE coverage >= 0.2e0 AND CASE p.label WHEN 'floor' THEN pt.y <= flo WHEN 'ceiling' THEN pt.y >= ceil_ WHEN 'wall' THEN pt.y > flo AND pt.y < ceil_ ELSE TRUE END),
votes AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY scan_id, frame_index, point_id
   ORDER BY surf, CASE WHEN surf THEN -sw ELSE -(score * sw) END, CASE WHEN surf THEN -score ELSE 0 END, mask_id) = 1),
totals AS (SELECT scan_id, point_id, label, sum(weight) AS score, count(*) AS views FROM votes GROUP BY ALL)"""
WIN = """,
rk AS (SELECT *, row_number() OVER (PARTITION BY scan_id, point_id ORDER BY score DESC, label) AS rn,
   sum(score) OVER (PARTITION BY scan_id, point_id) AS total FROM totals),
win AS (SELECT a.scan_id, a.point_id, a.label, a.score AS best, coalesce(b.score, 0) AS second, a.views, a.total
   FROM rk a LEFT JOIN rk b ON b.scan_id = a.scan_id AND b.point_id = a.point_id AND b.rn = 2 WHERE a.rn = 1)"""
CLEAN = """,
clean AS (SELECT w.*, CASE w.label WHEN 'floor' THEN pt.y <= flo WHEN 'ceiling' THEN pt.y >= ceil_ WHEN 'wall' THEN pt.y > flo AND pt.y < ceil_ ELSE TRUE END AS ok
   FROM win w JOIN fx_points pt USING (scan_id, point_id) JOIN limits USING (scan_id))"""
V_PF = ("fx_frames", "fx_points")
V_ALL = ("fx_frames", "fx_points", "fx_masks", "fx_runs")


def _points(spark, sf):
    """Points, spread over all tasks because the source table is one small file."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return fx.view(spark, sf, "fx_points").select("scan_id", "point_id", "x", "y", "z", "radius").repartition(tasks)


def _projected(spark, sf):
    return pj.project_points(_points(spark, sf), fx.frames(spark, sf))


def _plan(spark, sf):
    masks = fx.view(spark, sf, "fx_masks").select(*MASK, "label", "score")
    return plan.label_points(_points(spark, sf), fx.frames(spark, sf), masks, fx.view(spark, sf, "fx_runs"), W, H)


@query("j1_project_points", fx.with_views(*V_PF, sql=PROJ + """
SELECT scan_id, frame_index, point_id, u, v, round(z, 5) AS depth FROM proj"""))
def j1(spark, sf):
    return _projected(spark, sf).select("scan_id", "frame_index", "point_id", "u", "v", F.round("depth", 5).alias("depth"))


@query("f16_project_ranges", fx.with_views(*V_PF, sql=PROJ.replace("z < 20.0e0", "z < 3.0e0") + """
SELECT scan_id, frame_index, count(*) AS n, CAST(sum(u) AS BIGINT) AS sum_u, CAST(sum(v) AS BIGINT) AS sum_v, round(sum(fu), 3) AS sum_fu FROM proj GROUP BY ALL"""))
def f16(spark, sf):
    p = pj.project_points(_points(spark, sf), fx.frames(spark, sf), near=0.05, far=3.0, cell=0.75, whole_pixels=False)
    return p.groupBy("scan_id", "frame_index").agg(
        F.count("*").alias("n"), F.sum("u").alias("sum_u"), F.sum("v").alias("sum_v"), F.round(F.sum("float_u"), 3).alias("sum_fu")
    )


@query("a1_zbuffer", fx.with_views(*V_PF, sql=PROJ + ZB + """
SELECT scan_id, frame_index, v, u, round(z_ref, 5) AS z_ref FROM zb5"""))
def a1(spark, sf):
    return pj.zbuffer(_projected(spark, sf), 2).withColumn("z_ref", F.round("z_ref", 5))


@query("a1_zbuffer_raw", fx.with_views(*V_PF, sql=PROJ + ZB + """
SELECT scan_id, frame_index, v, u, round(z_ref, 5) AS z_ref FROM zb"""))
def a1_raw(spark, sf):
    return pj.zbuffer(_projected(spark, sf)).withColumn("z_ref", F.round("z_ref", 5))


@query("j4_zbuffer_visible", fx.with_views(*V_PF, sql=PROJ + ZB + VIS + """
SELECT scan_id, frame_index, point_id, u, v, round(z_ref, 5) AS z_ref FROM vis"""))
def j4(spark, sf):
    p = _projected(spark, sf)
    out = pj.zbuffer_visible(p, pj.zbuffer(p, 2, occupied=True)).where("self_visible")
    return out.select("scan_id", "frame_index", "point_id", "u", "v", F.round("z_ref", 5).alias("z_ref"))


@query("j4_cleanup_visible", fx.with_views(*V_PF, sql=PROJ + ZB + """
SELECT scan_id, frame_index, point_id, u, v FROM proj p JOIN zb5 r USING (scan_id, frame_index, v, u) WHERE z <= z_ref + 0.08e0 + 2.0e0 * radius"""))
def j4_cleanup(spark, sf):
    p = _projected(spark, sf)
    out = pj.cleanup_visible(p, pj.zbuffer(p, 2, occupied=True), "radius").where("cleanup_visible")
    return out.select("scan_id", "frame_index", "point_id", "u", "v")


# depth rasters at half size, made from the z-buffer with a deterministic error and holes
DEPTH = """,
dep AS (SELECT scan_id, frame_index, v, u, m * (1 + (frame_index % 3) * 0.05e0) AS z FROM (
   SELECT scan_id, frame_index, CAST(floor(v / 2.0e0) AS INT) AS v, CAST(floor(u / 2.0e0) AS INT) AS u, min(z_ref) AS m FROM zb WHERE (u + v) % 7 <> 0 GROUP BY ALL) q),
probe AS (SELECT p.scan_id, p.frame_index, p.point_id, p.z AS pz, 3*(dv+1) + (du+1) AS i,
   greatest(0, least(59, CAST(floor(v * 60.0e0 / 120) AS INT) + dv)) AS v, greatest(0, least(79, CAST(floor(u * 80.0e0 / 160) AS INT) + du)) AS u
   FROM proj p, (SELECT unnest(range(-1, 2)) AS dv) a, (SELECT unnest(range(-1, 2)) AS du) b),
dm AS (SELECT scan_id, frame_index, point_id, min(abs(probe.pz - dep.z)) AS delta, arg_min(dep.z, (abs(probe.pz - dep.z), probe.i)) AS ref FROM probe JOIN dep USING (scan_id, frame_index, v, u)
   WHERE dep.z > 0.05e0 AND dep.z < 20.0e0 GROUP BY ALL)"""


def _depth(projected):
    z = pj.zbuffer(projected).where((F.col("u") + F.col("v")) % 7 != 0)
    half = [F.floor(F.col(c) / 2).cast("int").alias(c) for c in ("v", "u")]
    g = z.select("scan_id", "frame_index", *half, "z_ref").groupBy("scan_id", "frame_index", "v", "u").agg(F.min("z_ref").alias("m"))
    return g.select("scan_id", "frame_index", "v", "u", (F.col("m") * (F.lit(1.0) + (F.col("frame_index") % 3) * 0.05)).alias("z"))


@query("j5_depth_visible", fx.with_views(*V_PF, sql=PROJ + ZB + DEPTH + """
SELECT scan_id, frame_index, point_id, round(delta, 5) AS depth_delta, coalesce(delta <= greatest(0.18e0, 0.08e0 * ref), FALSE) AS rendered_visible
FROM proj LEFT JOIN dm USING (scan_id, frame_index, point_id)"""))
def j5(spark, sf):
    p = _projected(spark, sf)
    out = pj.depth_match(p, _depth(p), (80, 60))
    return out.select("scan_id", "frame_index", "point_id", F.round("depth_delta", 5).alias("depth_delta"), "rendered_visible")


@query("j6_hybrid_visibility", fx.with_views(*V_PF, sql=PROJ + ZB + DEPTH + """
SELECT scan_id, frame_index, point_id, CASE WHEN coalesce(delta <= greatest(0.18e0, 0.08e0 * ref), FALSE) THEN 1.0e0 ELSE 0.65e0 END AS visibility_weight
FROM proj p LEFT JOIN dm USING (scan_id, frame_index, point_id) LEFT JOIN zb5 r USING (scan_id, frame_index, v, u)
WHERE coalesce(delta <= greatest(0.18e0, 0.08e0 * ref), FALSE) OR abs(z - z_ref) <= greatest(0.25e0, 0.1e0 * z_ref)"""))
def j6(spark, sf):
    p = _projected(spark, sf)
    m = pj.depth_match(pj.zbuffer_visible(p, pj.zbuffer(p, 2, occupied=True)), _depth(p), (80, 60))
    return pj.visibility(m, "hybrid").select("scan_id", "frame_index", "point_id", "visibility_weight")


@query("j3_footprint_coverage", fx.with_views(*V_ALL, sql=PROJ + ZB + VIS + OFFS + """
SELECT s.scan_id, s.frame_index, s.point_id, m.mask_id, round(sum(w), 6) AS coverage FROM smp s
JOIN fx_runs m ON m.scan_id = s.scan_id AND m.frame_index = s.frame_index AND m.y = s.y AND s.x >= m.x0 AND s.x < m.x1 GROUP BY ALL"""))
def j3(spark, sf):
    p = _projected(spark, sf)
    vis = pj.zbuffer_visible(p, pj.zbuffer(p, 2, occupied=True)).where("self_visible")
    r = camera.footprint_radius(F.col("radius"), F.col("depth"), F.col("fx"), F.col("fy"))
    out = pj.footprint_coverage(vis.withColumn("radius_px", r), fx.view(spark, sf, "fx_runs"))
    return out.withColumn("coverage", F.round("coverage", 6))


@query("g11_center_in_mask", fx.with_views(*V_ALL, sql=PROJ + """
SELECT DISTINCT p.scan_id, p.frame_index, point_id, mask_id FROM proj p JOIN fx_runs r
ON r.scan_id = p.scan_id AND r.frame_index = p.frame_index AND r.y = p.v AND p.u >= r.x0 AND p.u < r.x1"""))
def g11(spark, sf):
    return pj.center_in_mask(_projected(spark, sf), fx.view(spark, sf, "fx_runs"))


@query("a14_world_up", fx.with_views("fx_frames", sql="""
SELECT DISTINCT scan_id, 0.0e0 AS up_x, 1.0e0 AS up_y, 0.0e0 AS up_z FROM fx_frames"""))
def a14(spark, sf):
    return vt.world_up(fx.frames(spark, sf))


@query("a15_height_limits", fx.with_views("fx_points", sql=LIMITS.lstrip(",\n") + """
SELECT scan_id, round(flo, 6) AS floor_limit, round(ceil_, 6) AS ceiling_limit FROM limits"""))
def a15(spark, sf):
    h = vt.point_heights(_points(spark, sf), vt.world_up(fx.frames(spark, sf)))
    out = vt.height_limits(h)
    return out.select("scan_id", F.round("floor_limit", 6).alias("floor_limit"), F.round("ceiling_limit", 6).alias("ceiling_limit"))


@query("p4_height_gate", fx.with_views("fx_points", sql=LIMITS.lstrip(",\n") + """
SELECT scan_id, l.label, count(*) AS passed FROM fx_points p JOIN limits USING (scan_id),
 (VALUES ('wall'), ('floor'), ('ceiling'), ('bed')) l(label)
WHERE CASE l.label WHEN 'floor' THEN y <= flo WHEN 'ceiling' THEN y >= ceil_ WHEN 'wall' THEN y > flo AND y < ceil_ ELSE TRUE END GROUP BY ALL"""))
def p4(spark, sf):
    h = vt.point_heights(_points(spark, sf), vt.world_up(fx.frames(spark, sf)))
    j = h.join(vt.height_limits(h), "scan_id").withColumn("label", F.explode(F.array(*map(F.lit, ["wall", "floor", "ceiling", "bed"]))))
    ok = vt.height_gate(F.col("label"), F.col("height"), F.col("floor_limit"), F.col("ceiling_limit"))
    return j.where(ok).groupBy("scan_id", "label").agg(F.count("*").alias("passed"))


@query("a16_cloud_bounds", fx.with_views("fx_points", sql="""
SELECT scan_id, count(*) AS point_count, """ + ", ".join(
    f"round(min({a}),6) AS min_{a}, round(max({a}),6) AS max_{a}, round(max({a})-min({a}),6) AS size_{a}" for a in "xyz") + """,
 round(min(radius),6) AS radius_min, round(median(radius),6) AS radius_median, round(max(radius),6) AS radius_max FROM fx_points GROUP BY scan_id"""))
def a16(spark, sf):
    out = vt.cloud_bounds(_points(spark, sf))
    return out.select(*[F.round(c, 6).alias(c) if c not in ("scan_id", "point_count") else c for c in out.columns])


@query("p5_finite_points", """
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_tax > 0 AND l_discount > 0""")
def p5(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    bad = F.lit(1.0) / F.when(F.col("l_discount") == 0, F.lit(1e-320)).otherwise(F.col("l_discount"))
    d = li.select("l_orderkey", "l_linenumber", "l_partkey",
                  F.when(F.col("l_tax") == 0, F.lit(float("nan"))).otherwise(F.col("l_tax")).alias("x"), bad.alias("y"))
    return vt.finite_points(d, ["x", "y"]).drop("x", "y")


@query("a17_foreground_support", fx.with_views(*V_ALL, sql=PROJ + ZB + MPX + FG + """
SELECT scan_id, frame_index, mask_id, n_in AS inside_valid_pixels, n_ring AS ring_valid_pixels, round(delta, 5) AS foreground_delta_m,
  coalesce(delta >= 0.15e0, TRUE) AS geometry_supported, CASE WHEN delta IS NULL THEN 'insufficient_valid_depth_for_check' ELSE 'foreground_depth_delta' END AS reason FROM fg"""))
def a17(spark, sf):
    out = _plan(spark, sf).foreground
    return out.withColumn("foreground_delta_m", F.round("foreground_delta_m", 5)).drop("label")


@query("u4_structure_suppression", fx.with_views(*V_ALL, sql=PROJ + ZB + MPX + FG + USABLE + """
SELECT scan_id, frame_index, mask_id, count(*) AS pixels, CAST(sum(x) AS BIGINT) AS sum_x, CAST(sum(y) AS BIGINT) AS sum_y FROM usable GROUP BY ALL"""))
def u4(spark, sf):
    r = _plan(spark, sf).runs
    w = F.col("x1") - F.col("x0")
    return r.groupBy(*MASK).agg(
        F.sum(w).alias("pixels"), F.sum((F.col("x0") + F.col("x1") - 1) * w / 2).cast("bigint").alias("sum_x"),
        F.sum(F.col("y") * w).alias("sum_y"),
    )


@query("a19_static_weights", fx.with_views(*V_ALL, sql=MPX.lstrip(",\n") + STATIC + """
SELECT scan_id, frame_index, mask_id, n AS label_mask_count, round(fw, 6) AS label_frequency_weight, round(frac, 6) AS mask_area_fraction,
  round(aw, 6) AS mask_area_weight, round(fw * aw * rw, 6) AS static_weight FROM prep"""))
def a19_static(spark, sf):
    p = _plan(spark, sf).prepared
    return p.select(*MASK, "label_mask_count", *[F.round(c, 6).alias(c) for c in (
        "label_frequency_weight", "mask_area_fraction", "mask_area_weight", "static_weight")])


CHAIN = PROJ + ZB + VIS + MPX + STATIC + FG + USABLE + COVER + LIMITS + VOTES


@query("w1_first_claim", fx.with_views(*V_ALL, sql=CHAIN + """
SELECT scan_id, frame_index, point_id, mask_id, label, round(weight, 6) AS weight FROM votes"""))
def w1(spark, sf):
    return _plan(spark, sf).votes.select("scan_id", "frame_index", "point_id", "mask_id", "label", F.round("weight", 6).alias("weight"))


@query("a10_vote_totals", fx.with_views(*V_ALL, sql=CHAIN + """
SELECT scan_id, point_id, label, round(score, 6) AS score, views FROM totals"""))
def a10(spark, sf):
    return _plan(spark, sf).totals.withColumn("score", F.round("score", 6))


@query("a11_winner", fx.with_views(*V_ALL, sql=CHAIN + WIN + """
SELECT scan_id, point_id, label, round(best, 6) AS best_score, round(second, 6) AS second_score, views AS support_views,
  round((best - second) / greatest(best, 1e-6), 6) AS margin, round(best / greatest(total, best), 6) AS confidence FROM win"""))
def a11(spark, sf):
    out = vt.winner(_plan(spark, sf).totals)
    return out.select("scan_id", "point_id", "label", "support_views", *[F.round(c, 6).alias(c) for c in (
        "best_score", "second_score", "margin", "confidence")])


@query("w2_top2_labels", fx.with_views(*V_ALL, sql=CHAIN + WIN + """
SELECT scan_id, point_id, label, rn AS label_rank, round(score, 6) AS score FROM rk WHERE rn <= 2"""))
def w2(spark, sf):
    return rk.top_labels(_plan(spark, sf).totals, 2).withColumn("score", F.round("score", 6))


@query("a12_structural_cleanup", fx.with_views(*V_ALL, sql=CHAIN + WIN + CLEAN + """
SELECT scan_id, label AS rejected_label, count(*) AS rejections FROM clean WHERE NOT ok GROUP BY ALL
UNION ALL SELECT scan_id, 'kept', count(*) FROM clean WHERE ok GROUP BY ALL"""))
def a12(spark, sf):
    p = _plan(spark, sf)
    out = vt.structural_cleanup(vt.winner(p.totals), p.heights, p.limits)
    return out.groupBy("scan_id", F.coalesce("rejected_label", F.lit("kept")).alias("rejected_label")).agg(F.count("*").alias("rejections"))


FINAL = """,
fin AS (SELECT scan_id, point_id, CASE WHEN ok AND best >= 1 AND views >= 1 AND (best - second) / greatest(best, 1e-6) >= 0.1e0 THEN label END AS final_label,
  CASE WHEN ok THEN best ELSE 0 END AS best, CASE WHEN ok THEN views ELSE 0 END AS views, CASE WHEN ok THEN best / greatest(total, best) ELSE 0 END AS conf FROM clean)"""


@query("flagship_point_labels", fx.with_views(*V_ALL, sql=CHAIN + WIN + CLEAN + FINAL + """
SELECT scan_id, point_id, final_label, round(best, 5) AS best_score, views AS support_views, round(conf, 5) AS confidence FROM fin"""))
def flagship(spark, sf):
    out = _plan(spark, sf).labels
    return out.select("scan_id", "point_id", "final_label", F.round("best_score", 5).alias("best_score"), "support_views",
                      F.round("confidence", 5).alias("confidence"))


@query("a13_label_summary", fx.with_views(*V_ALL, sql=CHAIN + WIN + CLEAN + FINAL + """
SELECT l.scan_id, l.label, count(f.point_id) AS point_count, round(coalesce(avg(conf), 0), 5) AS mean_confidence,
 round(coalesce(avg(best), 0), 5) AS mean_score, round(coalesce(avg(views), 0), 5) AS mean_support_views
FROM (SELECT DISTINCT scan_id, label FROM fx_masks) l LEFT JOIN fin f ON f.scan_id = l.scan_id AND f.final_label = l.label GROUP BY ALL"""))
def a13(spark, sf):
    out = vt.label_summary(_plan(spark, sf).labels, fx.view(spark, sf, "fx_masks"))
    return out.select("scan_id", "label", "point_count", *[F.round(c, 5).alias(c) for c in ("mean_confidence", "mean_score", "mean_support_views")])


@query("a18_frame_report", fx.with_views(*V_ALL, sql=CHAIN + """
SELECT m.scan_id, m.frame_index, m.masks, coalesce(p.n, 0) AS projected_points, coalesce(s.n, 0) AS visible_points,
  coalesce(v.o, 0) AS object_votes, coalesce(v.s, 0) AS structural_votes, coalesce(v.o + v.s, 0) AS votes, CASE WHEN p.n IS NULL THEN 'nothing_projected' ELSE 'processed' END AS status
FROM (SELECT scan_id, frame_index, count(*) AS masks FROM fx_masks GROUP BY ALL) m
LEFT JOIN (SELECT scan_id, frame_index, count(*) AS n FROM proj GROUP BY ALL) p USING (scan_id, frame_index)
LEFT JOIN (SELECT scan_id, frame_index, count(*) AS n FROM vis GROUP BY ALL) s USING (scan_id, frame_index)
LEFT JOIN (SELECT scan_id, frame_index, count(*) FILTER (WHERE NOT surf) AS o, count(*) FILTER (WHERE surf) AS s FROM votes GROUP BY ALL) v USING (scan_id, frame_index)"""))
def a18(spark, sf):
    p = _plan(spark, sf)
    keys = ["scan_id", "frame_index"]
    n_proj = p.projected.groupBy(*keys).agg(F.count("*").alias("projected_points"))
    n_vis = p.visible.groupBy(*keys).agg(F.count("*").alias("visible_points"))
    return vt.frame_report(n_proj, n_vis, p.votes, fx.view(spark, sf, "fx_masks"))


@query("a18_coverage_totals", fx.with_views(*V_ALL, sql=CHAIN + """
SELECT m.scan_id, m.frames, m.processed_frames, m.pp AS projected_points_total, m.vp AS visible_points_total,
 coalesce(o, 0) AS object_votes_total, coalesce(s, 0) AS structural_votes_total, coalesce(o + s, 0) AS votes_total
FROM (SELECT f.scan_id, count(*) AS frames, count(p.n) AS processed_frames, coalesce(sum(p.n), 0) AS pp, coalesce(sum(s.n), 0) AS vp
  FROM (SELECT DISTINCT scan_id, frame_index FROM fx_masks) f
  LEFT JOIN (SELECT scan_id, frame_index, count(*) AS n FROM proj GROUP BY ALL) p USING (scan_id, frame_index)
  LEFT JOIN (SELECT scan_id, frame_index, count(*) AS n FROM vis GROUP BY ALL) s USING (scan_id, frame_index) GROUP BY f.scan_id) m
LEFT JOIN (SELECT scan_id, count(*) FILTER (WHERE NOT surf) AS o, count(*) FILTER (WHERE surf) AS s FROM votes GROUP BY ALL) v USING (scan_id)"""))
def a18_totals(spark, sf):
    return vt.coverage_totals(a18(spark, sf))


@query("a19_vote_report", fx.with_views(*V_ALL, sql=CHAIN + """
SELECT scan_id, frame_index, mask_id, label, count(*) AS accepted_points, round(avg(coverage), 5) AS mean_coverage, round(avg(weight), 5) AS mean_weight FROM votes GROUP BY ALL"""))
def a19(spark, sf):
    out = vt.vote_report(_plan(spark, sf).votes)
    return out.withColumn("mean_coverage", F.round("mean_coverage", 5)).withColumn("mean_weight", F.round("mean_weight", 5))


@query("center_vote_labels")
def center_votes(spark, sf):
    masks = fx.view(spark, sf, "fx_masks").select(*MASK, "label", "score")
    runs = fx.view(spark, sf, "fx_runs")
    return plan.center_vote_labels(_points(spark, sf), fx.frames(spark, sf), masks, runs, W, H).select(
        "scan_id", "point_id", "final_label", F.round("best_score", 5).alias("best_score"), "support_views")
