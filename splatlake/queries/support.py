"""Spatial support, calibration, seeds, grids and containment."""

from __future__ import annotations

from pyspark.sql import functions as F

from splatlake import fixtures as fx
from splatlake.operators import cleanup as cu, components as co, containment as ct, projection as pj, support as su
from splatlake.queries import labelling as lab, query

KEY = ["scan_id", "point_id"]


def _pts(spark, sf):
    return fx.view(spark, sf, "fx_object_points")


def _split(spark, sf):
    p = _pts(spark, sf)
    return p.where("point_id % 4 = 0").select("scan_id", "point_id", "x", "y", "z"), p.where("point_id % 4 <> 0")


VOX = """
q AS (SELECT * FROM fx_object_points WHERE point_id % 4 = 0), rf AS (SELECT * FROM fx_object_points WHERE point_id % 4 <> 0),
om AS (SELECT scan_id, min(x) - {s}e0 AS ox, min(y) - {s}e0 AS oy, min(z) - {s}e0 AS oz FROM fx_object_points GROUP BY scan_id),
qc AS (SELECT q.scan_id, q.point_id, floor((x-ox)/{s}e0) AS i, floor((y-oy)/{s}e0) AS j, floor((z-oz)/{s}e0) AS k FROM q JOIN om USING (scan_id)),
rc AS (SELECT rf.*, floor((x-ox)/{s}e0) AS i, floor((y-oy)/{s}e0) AS j, floor((z-oz)/{s}e0) AS k FROM rf JOIN om USING (scan_id)),
nn AS (SELECT qc.scan_id, qc.point_id, rc.label, rc.confidence, rc.support_views FROM qc JOIN rc ON qc.scan_id = rc.scan_id AND abs(qc.i - rc.i) <= 1 AND abs(qc.j - rc.j) <= 1 AND abs(qc.k - rc.k) <= 1)"""


@query("j14_voxel_member", fx.with_views("fx_object_points", sql=VOX.format(s=0.08) + """
SELECT qc.scan_id, qc.point_id, count(nn.point_id) > 0 AS supported FROM qc LEFT JOIN nn ON nn.scan_id = qc.scan_id AND nn.point_id = qc.point_id GROUP BY ALL"""))
def j14(spark, sf):
    return su.voxel_member(*_split(spark, sf), 0.08).select(*KEY, "supported")


# three roles over the same points: sigma of the queries, spacing of a scan from its reference count
@query("j14_voxel_levels", fx.with_views("fx_object_points", sql="""
q AS (SELECT scan_id, point_id, x, y, z, (point_id % 50) / 500e0 AS sigma FROM fx_object_points WHERE point_id % 4 = 0), rf AS (SELECT scan_id, x, y, z FROM fx_object_points WHERE point_id % 4 <> 0),
om AS (SELECT scan_id, min(x) AS ox, min(y) AS oy, min(z) AS oz FROM fx_object_points GROUP BY scan_id),
sp AS (SELECT scan_id, 0.01e0 + count(*) % 7 / 400e0 AS sp FROM rf GROUP BY scan_id HAVING count(*) >= 8),
qs AS (SELECT scan_id, quantile_cont(sigma, 0.5) FILTER (WHERE sigma > 0) AS med, quantile_cont(sigma, 0.99) AS p99 FROM q GROUP BY scan_id),
gp AS (SELECT scan_id, greatest(sp, coalesce(med, 1e-3) * 0.5e0, 1e-5) AS gap, p99 FROM sp JOIN qs USING (scan_id)),
lv AS (SELECT scan_id, gap, greatest(gap * 0.5e0, 1e-5) AS s0, len(list_filter(range(0, 11), lambda k: greatest(gap * 0.5e0, 1e-5) * pow(2, k) < (3 * gap + 3 * p99) * 0.5e0)) AS top FROM gp),
ql AS (SELECT q.*, s0, CASE WHEN s0 IS NOT NULL THEN least(top, len(list_filter(range(0, 12), lambda k: 2 * s0 * pow(2, k) < 3 * gap + 3 * sigma))) END AS level FROM q LEFT JOIN lv USING (scan_id)),
qc AS (SELECT ql.*, floor((x-ox)/(s0*pow(2,level))) AS i, floor((y-oy)/(s0*pow(2,level))) AS j, floor((z-oz)/(s0*pow(2,level))) AS k FROM ql JOIN om USING (scan_id)),
rl AS (SELECT rf.*, s0, unnest(range(0, top + 1)) AS level FROM rf JOIN lv USING (scan_id)),
rc AS (SELECT DISTINCT rl.scan_id, level, floor((x-ox)/(s0*pow(2,level))) AS i, floor((y-oy)/(s0*pow(2,level))) AS j, floor((z-oz)/(s0*pow(2,level))) AS k FROM rl JOIN om USING (scan_id))
SELECT qc.scan_id, qc.point_id, CAST(qc.level AS INT) AS level, count(rc.i) > 0 AS supported FROM qc LEFT JOIN rc ON qc.scan_id = rc.scan_id AND qc.level = rc.level AND abs(qc.i - rc.i) <= 1 AND abs(qc.j - rc.j) <= 1 AND abs(qc.k - rc.k) <= 1 GROUP BY ALL"""))
def j14_levels(spark, sf):
    q, r = _split(spark, sf)
    spacing = r.groupBy("scan_id").agg((F.lit(0.01) + F.count("*") % 7 / F.lit(400.0)).alias("spacing"))
    return su.voxel_member_levels(q.withColumn("sigma", F.expr("(point_id % 50) / 500D")), r, spacing).select(*KEY, "level", "supported")


@query("j15_voxel_count", fx.with_views("fx_object_points", sql=VOX.format(s=0.15) + """
SELECT qc.scan_id, qc.point_id, count(nn.point_id) AS neighbors FROM qc LEFT JOIN nn ON nn.scan_id = qc.scan_id AND nn.point_id = qc.point_id GROUP BY ALL"""))
def j15(spark, sf):
    return su.voxel_count(*_split(spark, sf), 0.15).select(*KEY, "neighbors")


@query("j16_room_conflict", fx.with_views("fx_object_points", sql=VOX.format(s=0.25) + """,
ag AS (SELECT scan_id, point_id, count(*) AS room, count(*) FILTER (WHERE label = 'bed' AND confidence >= 0.8e0 AND support_views >= 4) AS own FROM nn GROUP BY ALL),
rv AS (SELECT scan_id, point_id, max(n) AS rival FROM (SELECT scan_id, point_id, label, count(*) AS n FROM nn WHERE label <> 'bed' AND confidence >= 0.8e0 AND support_views >= 4 GROUP BY ALL) z GROUP BY ALL),
ok AS (SELECT scan_id FROM rf WHERE label = 'bed' AND confidence >= 0.8e0 AND support_views >= 4 GROUP BY scan_id HAVING count(*) >= 20)
SELECT qc.scan_id, qc.point_id, NOT (ok.scan_id IS NOT NULL AND coalesce(room, 0) >= 1 AND coalesce(rival, 0) >= 4 AND coalesce(own, 0) < 1) AS keep
FROM qc LEFT JOIN ag USING (scan_id, point_id) LEFT JOIN rv USING (scan_id, point_id) LEFT JOIN ok ON ok.scan_id = qc.scan_id"""))
def j16(spark, sf):
    q, r = _split(spark, sf)
    return su.room_conflict(q, r.select("scan_id", "x", "y", "z", "label", "confidence", "support_views"), "bed", 0.25).select(*KEY, "keep")


@query("a29_spacing", fx.with_views("fx_object_points", sql="""
d AS (SELECT a.scan_id, a.point_id, min((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS d2 FROM fx_object_points a JOIN fx_object_points b ON a.scan_id = b.scan_id AND a.point_id <> b.point_id GROUP BY ALL)
SELECT scan_id, round(median(sqrt(d2)), 6) AS spacing FROM d WHERE d2 > 0 GROUP BY scan_id"""))
def a29(spark, sf):
    return su.spacing(_pts(spark, sf)).select("scan_id", F.round("spacing", 6).alias("spacing"))


# rendered depth and sparse depth of the same pixel, from line items
PAIRS = """
pr AS (SELECT 's' AS scan_id, CAST(l_suppkey AS INT) AS frame_index, 1.0e0 + l_quantity / 10e0 AS depth,
 (1.0e0 + l_quantity / 10e0) * (1.2e0 + (l_suppkey % 5) / 10e0 + l_discount * CASE WHEN l_suppkey % 7 = 0 THEN 20 ELSE 1 END) AS z_ref FROM lineitem),
lg AS (SELECT *, ln(z_ref / depth) AS l FROM pr), md AS (SELECT scan_id, frame_index, count(*) AS n, median(l) AS m FROM lg GROUP BY ALL),
mm AS (SELECT lg.scan_id, lg.frame_index, median(abs(l - m)) AS mad FROM lg JOIN md USING (scan_id, frame_index) GROUP BY ALL),
sc AS (SELECT lg.scan_id, lg.frame_index, exp(CASE WHEN max(mad) > 1e-8 AND count(*) FILTER (WHERE abs(l - m) <= 5.1891e0 * mad) >= 24 THEN median(l) FILTER (WHERE abs(l - m) <= 5.1891e0 * mad) ELSE max(m) END) AS scale
  FROM lg JOIN md USING (scan_id, frame_index) JOIN mm USING (scan_id, frame_index) GROUP BY ALL),
er AS (SELECT pr.scan_id, pr.frame_index, median(abs(z_ref - depth * scale) / z_ref) AS err FROM pr JOIN sc USING (scan_id, frame_index) GROUP BY ALL)"""


def _pairs(spark, sf):
    return fx.table(spark, sf, "lineitem").selectExpr(
        "'s' AS scan_id", "int(l_suppkey) AS frame_index", "1D + l_quantity / 10D AS depth",
        "(1D + l_quantity / 10D) * (1.2D + (l_suppkey % 5) / 10D + l_discount * CASE WHEN l_suppkey % 7 = 0 THEN 20 ELSE 1 END) AS z_ref")


@query("a20_depth_scale", "WITH " + PAIRS + """
SELECT scan_id, frame_index, n AS overlap_pixels, round(CASE WHEN n >= 24 THEN scale END, 5) AS scale, round(CASE WHEN n >= 24 THEN err END, 5) AS median_relative_error,
 CASE WHEN n < 24 THEN 'insufficient_sparse_depth_overlap' WHEN err <= 0.25e0 THEN 'ok' ELSE 'depth_alignment_residual_too_large' END AS reason
FROM md JOIN sc USING (scan_id, frame_index) JOIN er USING (scan_id, frame_index)""")
def a20(spark, sf):
    out = su.depth_scale(_pairs(spark, sf), ["scan_id", "frame_index"])
    return out.withColumns({c: F.round(c, 5) for c in ("scale", "median_relative_error")})


# the second reading: every other frame holds distances along the ray
READ = """
WITH b AS (SELECT 's' AS scan_id, CAST(l_suppkey AS INT) AS frame_index, CAST(l_orderkey % 120 AS INT) AS v, CAST(l_partkey % 160 AS INT) AS u, 1.0e0 + l_quantity / 10e0 AS z,
  1.2e0 + (l_suppkey % 5) / 10e0 + l_discount * CASE WHEN l_suppkey % 7 = 0 THEN 20 ELSE 1 END AS k FROM lineitem),
c AS (SELECT *, 1 / sqrt(1 + ((v - 60e0) / 70e0) * ((v - 60e0) / 70e0) + ((u - 80e0) / 80e0) * ((u - 80e0) / 80e0)) AS cs FROM b),
p AS (SELECT scan_id, frame_index, z * k AS z_ref, CASE WHEN frame_index % 2 = 0 THEN z / cs ELSE z END AS depth, cs FROM c),
t AS (SELECT scan_id, frame_index, 0 AS trial, depth, z_ref FROM p UNION ALL SELECT scan_id, frame_index, 1, depth * cs, z_ref FROM p),
lg AS (SELECT *, ln(z_ref / depth) AS l FROM t), md AS (SELECT scan_id, frame_index, trial, count(*) AS n, median(l) AS m FROM lg GROUP BY ALL),
mm AS (SELECT scan_id, frame_index, trial, median(abs(l - m)) AS mad FROM lg JOIN md USING (scan_id, frame_index, trial) GROUP BY ALL),
sc AS (SELECT scan_id, frame_index, trial, exp(CASE WHEN max(mad) > 1e-8 AND count(*) FILTER (WHERE abs(l - m) <= 5.1891e0 * mad) >= 24 THEN median(l) FILTER (WHERE abs(l - m) <= 5.1891e0 * mad) ELSE max(m) END) AS scale
  FROM lg JOIN md USING (scan_id, frame_index, trial) JOIN mm USING (scan_id, frame_index, trial) GROUP BY ALL),
er AS (SELECT scan_id, frame_index, trial, median(abs(z_ref - depth * scale) / z_ref) AS err FROM t JOIN sc USING (scan_id, frame_index, trial) GROUP BY ALL),
rs AS (SELECT scan_id, frame_index, trial, n AS overlap_pixels, CASE WHEN n >= 24 THEN scale END AS scale, CASE WHEN n >= 24 THEN err END AS err,
  CASE WHEN n < 24 THEN 'insufficient_sparse_depth_overlap' WHEN err <= 0.25e0 THEN 'ok' ELSE 'depth_alignment_residual_too_large' END AS reason FROM md JOIN sc USING (scan_id, frame_index, trial) JOIN er USING (scan_id, frame_index, trial))"""


@query("a20_calibrate_depth", READ + """
SELECT scan_id, frame_index, CASE WHEN trial = 0 THEN 'native_camera_z' ELSE 'ray_distance_to_camera_z' END AS mode, round(scale, 5) AS scale, overlap_pixels, round(err, 5) AS median_relative_error, reason,
  round(max(CASE WHEN trial = 0 THEN err END) OVER (PARTITION BY scan_id, frame_index), 5) AS native_error, round(max(CASE WHEN trial = 1 THEN err END) OVER (PARTITION BY scan_id, frame_index), 5) AS ray_error
FROM rs QUALIFY row_number() OVER (PARTITION BY scan_id, frame_index ORDER BY reason <> 'ok', coalesce(err, 1e300), trial) = 1""")
def a20_calibrate(spark, sf):
    b = fx.table(spark, sf, "lineitem").selectExpr("'s' AS scan_id", "int(l_suppkey) AS frame_index", "int(l_orderkey % 120) AS v", "int(l_partkey % 160) AS u", "1D + l_quantity / 10D AS z",
                                                   "1.2D + (l_suppkey % 5) / 10D + l_discount * CASE WHEN l_suppkey % 7 = 0 THEN 20 ELSE 1 END AS k")
    ray = F.expr("sqrt(1 + ((v - 60D) / 70D) * ((v - 60D) / 70D) + ((u - 80D) / 80D) * ((u - 80D) / 80D))")
    pairs = b.withColumn("depth", F.when(F.col("frame_index") % 2 == 0, F.col("z") * ray).otherwise(F.col("z"))).withColumn("z_ref", F.col("z") * F.col("k"))
    cameras = b.select("scan_id", "frame_index").distinct().selectExpr("*", "80D AS fx", "70D AS fy", "80D AS cx", "60D AS cy")
    out = cu.calibrate_depth(pairs, cameras)
    return out.select("scan_id", "frame_index", "mode", "overlap_pixels", "reason", *[F.round(c, 5).alias(c) for c in ("scale", "median_relative_error")],
                      F.round("candidate_errors.native_camera_z", 5).alias("native_error"), F.round("candidate_errors.ray_distance_to_camera_z", 5).alias("ray_error"))


@query("a21_depth_gates", "WITH " + PAIRS + """
SELECT 's' AS scan_id, round(avg(CASE WHEN n IS NULL THEN 0e0 ELSE 1e0 END), 6) AS depth_coverage, round(avg(CASE WHEN n >= 24 AND err <= 0.25e0 THEN 1e0 ELSE 0e0 END), 6) AS reliable_ratio,
 avg(CASE WHEN n IS NULL THEN 0e0 ELSE 1e0 END) >= 0.75e0 AND avg(CASE WHEN n >= 24 AND err <= 0.25e0 THEN 1e0 ELSE 0e0 END) >= 0.6e0 AS passed
FROM (SELECT CAST(s_suppkey AS INT) AS frame_index FROM supplier UNION ALL SELECT CAST(-1 - s_suppkey AS INT) FROM supplier WHERE s_suppkey % 10 = 0) f LEFT JOIN md USING (frame_index) LEFT JOIN er USING (frame_index)""")
def a21(spark, sf):
    s = fx.table(spark, sf, "supplier")
    frames = s.selectExpr("'s' AS scan_id", "int(s_suppkey) AS frame_index").union(s.where("s_suppkey % 10 = 0").selectExpr("'s'", "int(-1 - s_suppkey)"))
    out = su.depth_gates(frames, su.depth_scale(_pairs(spark, sf), ["scan_id", "frame_index"]))
    return out.withColumns({c: F.round(c, 6) for c in ("depth_coverage", "reliable_ratio")})


CLS = lab.PROJ + lab.ZB + lab.DEPTH + """,
cls AS (SELECT p.*, CASE WHEN d.ref IS NOT NULL THEN CASE WHEN d.delta <= greatest(0.1e0 * d.ref, 0.125e0) THEN 'near' WHEN p.z - d.ref < 0 THEN 'free' ELSE 'behind' END
  WHEN abs(p.z - r.z_ref) <= greatest(0.1e0 * r.z_ref, 0.1e0) THEN 'near' WHEN p.z - r.z_ref < 0 THEN 'free' ELSE 'behind' END AS geometry
  FROM proj p LEFT JOIN dm d USING (scan_id, frame_index, point_id) LEFT JOIN zb5 r USING (scan_id, frame_index, v, u))"""


def _classified(spark, sf):
    p = lab._projected(spark, sf)
    m = pj.depth_match(pj.zbuffer_visible(p, pj.zbuffer(p, 2, occupied=True)), lab._depth(p), (80, 60))
    return su.classify_geometry(m, 0.05)


@query("j23_classify_geometry", fx.with_views(*lab.V_PF, sql=CLS + "SELECT scan_id, frame_index, geometry, count(*) AS n FROM cls GROUP BY ALL"))
def j23(spark, sf):
    return _classified(spark, sf).groupBy("scan_id", "frame_index", "geometry").agg(F.count("*").alias("n"))


HITS = """,
hit AS (SELECT DISTINCT p.scan_id, p.frame_index, p.point_id FROM proj p JOIN fx_runs r ON r.scan_id = p.scan_id AND r.frame_index = p.frame_index AND r.y = p.v AND p.u >= r.x0 AND p.u < r.x1 AND r.label = 'bed')"""


def _hits(spark, sf, projected=None):
    runs = fx.view(spark, sf, "fx_runs").where("label = 'bed'")
    return pj.center_in_mask(projected if projected is not None else lab._projected(spark, sf), runs).drop("mask_id").distinct()


@query("a22_seed_hits", fx.with_views(*lab.V_ALL, sql=lab.PROJ + HITS + "SELECT scan_id, point_id, count(*) AS hits FROM hit GROUP BY ALL HAVING count(*) >= 2"))
def a22(spark, sf):
    return su.seed_hits(_hits(spark, sf))


@query("a23_visible_seeds", fx.with_views(*lab.V_ALL, sql=CLS + HITS + """
SELECT scan_id, point_id, count(*) AS mask_hits, count(*) FILTER (WHERE geometry = 'near') AS visible_hits, count(*) FILTER (WHERE geometry = 'behind') AS occluded_hits,
 count(*) FILTER (WHERE geometry = 'near') >= 2 AND count(*) FILTER (WHERE geometry = 'near') / count(*) >= 0.5e0 AS is_seed FROM cls JOIN hit USING (scan_id, frame_index, point_id) GROUP BY ALL"""))
def a23(spark, sf):
    c = _classified(spark, sf)
    return su.visible_seeds(c.join(_hits(spark, sf), ["scan_id", "frame_index", "point_id"], "left_semi"))


@query("a24_multiview_support", """
WITH e AS (SELECT 's' AS scan_id, l_partkey AS point_id, l_linenumber % 5 = 0 AS neg, CASE WHEN l_quantity < 10 THEN 0e0 ELSE l_discount * 8 END AS cov FROM lineitem),
g AS (SELECT scan_id, point_id, count(*) FILTER (WHERE NOT neg AND cov >= 0.2e0) AS sv, count(*) FILTER (WHERE NOT neg) AS pv, sum(CASE WHEN neg THEN 0.35e0 WHEN cov <= 0.02e0 THEN 1e0 ELSE 0e0 END) / greatest(sum(CASE WHEN neg THEN 0.35e0 ELSE 1e0 END), 1e-6) AS cr,
 coalesce(sum(cov) FILTER (WHERE NOT neg), 0) AS c FROM e GROUP BY ALL)
SELECT scan_id, point_id, sv AS support_views, pv AS positive_visible, round(cr, 6) AS contradiction_ratio, round(c / greatest(pv, 1), 6) AS mean_coverage,
 sv >= 3 AND sv / greatest(pv, 1) >= 0.5e0 AND cr <= 0.55e0 AS strong, sv >= 1 AND c / greatest(pv, 1) >= 0.1e0 AS weak, pv >= 4 AND sv <= 0 AND cr >= 0.8e0 AS strong_background FROM g""")
def a24(spark, sf):
    e = fx.table(spark, sf, "lineitem").selectExpr("'s' AS scan_id", "l_partkey AS point_id", "l_linenumber % 5 = 0 AS negative", "CASE WHEN l_quantity < 10 THEN 0D ELSE l_discount * 8 END AS coverage")
    out = su.multiview_support(e).drop("support_ratio")
    return out.withColumns({c: F.round(c, 6) for c in ("contradiction_ratio", "mean_coverage")})


@query("c4_a40_seed_components", fx.with_views("fx_object_points", recursive=True, sql="""
c AS (SELECT scan_id, label, point_id, support_views AS h, x, y, z, CAST(floor(x / 0.2e0) AS INT) AS i, CAST(floor(y / 0.2e0) AS INT) AS j, CAST(floor(z / 0.2e0) AS INT) AS k FROM fx_object_points),
v AS (SELECT *, row_number() OVER (ORDER BY scan_id, label, i, j, k) AS id FROM (SELECT DISTINCT scan_id, label, i, j, k FROM c) q),
e AS (SELECT a.id AS s, b.id AS t FROM v a JOIN v b ON a.scan_id = b.scan_id AND a.label = b.label AND b.i BETWEEN a.i - 1 AND a.i + 1 AND b.j BETWEEN a.j - 1 AND a.j + 1 AND b.k BETWEEN a.k - 1 AND a.k + 1 AND a.id <> b.id),
r AS (SELECT id, id AS c FROM v UNION SELECT e.t, r.c FROM r JOIN e ON e.s = r.id),
m AS (SELECT id, min(c) AS c FROM r GROUP BY id),
g AS (SELECT c.scan_id, c.label, m.c AS comp, count(*) AS n, count(DISTINCT c.point_id % 6) AS f, count(*) * greatest(avg(h), 1e-6) AS s, max(x) - min(x) AS sx FROM c JOIN v USING (scan_id, label, i, j, k) JOIN m ON m.id = v.id GROUP BY ALL),
t AS (SELECT *, sum(n) OVER (PARTITION BY scan_id, label) AS al, max(s) OVER (PARTITION BY scan_id, label) AS top, row_number() OVER (PARTITION BY scan_id, label ORDER BY s DESC, comp) AS rk FROM g)
SELECT t.scan_id, t.label, v.i AS ci, v.j AS cj, v.k AS ck, t.n AS point_count, t.f AS support_frames, round(t.s, 4) AS score, round(t.sx, 6) AS span_x, rk = 1 OR (n >= 24 AND n / al >= 0.01e0 AND f >= 2 AND s >= 0.08e0 * top) AS kept FROM t JOIN v ON v.id = t.comp"""))
def c4(spark, sf):
    p = _pts(spark, sf).select("scan_id", "label", "point_id", "x", "y", "z", F.col("support_views").alias("visible_hits"))
    hits = p.select("scan_id", "label", "point_id", (F.col("point_id") % 6).cast("int").alias("frame_index"))
    out = su.seed_components(p, hits, ["scan_id", "label"], 0.2)
    return out.select("scan_id", "label", "component.*", "point_count", "support_frames", F.round("score", 4).alias("score"), F.round("span_x", 6).alias("span_x"), "kept")


@query("g1_principal_axes")
def g1(spark, sf):
    out = su.principal_axes(_pts(spark, sf), ["scan_id", "label"])
    return out.select("scan_id", "label", F.round("mx", 5).alias("mx"), F.round(F.abs(F.col("axes")[0]), 4).alias("axis_x"))


@query("g2_grid_definition")
def g2(spark, sf):
    p = _pts(spark, sf)
    key = ["scan_id", "label"]
    sp = p.select(*key).distinct().withColumn("spacing", F.lit(0.04))
    out = su.grid_definition(p, su.principal_axes(p, key), sp, key)
    return out.select(*key, F.round("voxel_size", 5).alias("voxel_size"), "nx", "ny", "nz")


OCC = """
occ AS (SELECT DISTINCT scan_id, CAST(round_even(x / 0.2e0, 0) AS INT) AS ci, CAST(round_even(y / 0.2e0, 0) AS INT) AS cj, CAST(round_even(z / 0.2e0, 0) AS INT) AS ck FROM fx_object_points WHERE label <> 'wall')"""


def _occ(spark, sf):
    return _pts(spark, sf).where("label <> 'wall'").selectExpr("scan_id", "int(rint(x / 0.2D)) AS ci", "int(rint(y / 0.2D)) AS cj", "int(rint(z / 0.2D)) AS ck").distinct()


@query("g3_grid_occupancy", fx.with_views(*lab.V_ALL, sql=lab.PROJ + HITS + """
SELECT scan_id, point_id, coalesce(v, 0) AS projected, coalesce(h, 0) AS hits, coalesce(h, 0) >= 2 AND coalesce(h, 0) / greatest(coalesce(v, 0), 1) >= 0.35e0 AS occupied FROM fx_points
LEFT JOIN (SELECT scan_id, point_id, count(*) AS v FROM proj GROUP BY ALL) a USING (scan_id, point_id) LEFT JOIN (SELECT scan_id, point_id, count(*) AS h FROM hit GROUP BY ALL) b USING (scan_id, point_id)"""))
def g3(spark, sf):
    p = lab._projected(spark, sf)
    return su.grid_occupancy(lab._points(spark, sf).select(*KEY), p, _hits(spark, sf, p))


@query("g4_protect_seeds", fx.with_views("fx_object_points", sql=OCC + """,
sd AS (SELECT DISTINCT scan_id, CAST(round_even(x / 0.2e0, 0) AS INT) AS i, CAST(round_even(y / 0.2e0, 0) AS INT) AS j, CAST(round_even(z / 0.2e0, 0) AS INT) AS k FROM fx_object_points WHERE label = 'wall')
SELECT * FROM occ UNION SELECT scan_id, CAST(i + a AS INT), CAST(j + b AS INT), CAST(k + c AS INT) FROM sd, (SELECT unnest(range(-1, 2)) AS a) x, (SELECT unnest(range(-1, 2)) AS b) y, (SELECT unnest(range(-1, 2)) AS c) z"""))
def g4(spark, sf):
    s = _pts(spark, sf).where("label = 'wall'").selectExpr("scan_id", "int(rint(x / 0.2D)) AS ci", "int(rint(y / 0.2D)) AS cj", "int(rint(z / 0.2D)) AS ck")
    return su.protect_seeds(_occ(spark, sf), s, ["scan_id"])


@query("c5_nearest_occupied", fx.with_views("fx_object_points", sql=OCC + """,
bx AS (SELECT scan_id, min(ci) AS a, max(ci) AS b, min(cj) AS c, max(cj) AS d, min(ck) AS e, max(ck) AS f FROM occ GROUP BY scan_id),
gr AS (SELECT scan_id, i AS ci, j AS cj, unnest(range(e, f + 1)) AS ck FROM (SELECT *, unnest(range(c, d + 1)) AS j FROM (SELECT *, unnest(range(a, b + 1)) AS i FROM bx) q) q2)
SELECT g.scan_id, CAST(g.ci AS INT) AS ci, CAST(g.cj AS INT) AS cj, CAST(g.ck AS INT) AS ck, CAST(min(abs(g.ci - o.ci) + abs(g.cj - o.cj) + abs(g.ck - o.ck)) AS INT) AS dist FROM gr g JOIN occ o ON o.scan_id = g.scan_id GROUP BY ALL"""))
def c5(spark, sf):
    occ = _occ(spark, sf)
    b = occ.groupBy("scan_id").agg(*[fn(c).alias(f"{n}_{c}") for c in ("ci", "cj", "ck") for n, fn in (("lo", F.min), ("hi", F.max))])
    grid = b
    for c in ("ci", "cj", "ck"):
        grid = grid.withColumn(c, F.explode(F.sequence(F.col(f"lo_{c}"), F.col(f"hi_{c}"))))
    return co.nearest_occupied(grid.select("scan_id", "ci", "cj", "ck"), occ, ["scan_id"]).select("scan_id", "ci", "cj", "ck", "dist")


def _gaussians(spark, sf):
    from splatlake.functions.camera import quat_to_rotation

    p = _pts(spark, sf)
    q = F.expr("array(1D, 0D, (point_id % 5) / 5D, 0D)")
    return p.select(*KEY, "x", "y", "z", F.expr("array(0.02D + (point_id % 7) / 50D, 0.03D, 0.02D)").alias("sigma"), quat_to_rotation(q).alias("rot"))


# the SQL states the probes and the Gaussians by itself
PROBES = """,
un(a, b, c) AS (SELECT * FROM (VALUES (1e0, 0e0, 0e0), (-1e0, 0e0, 0e0), (0e0, 1e0, 0e0), (0e0, -1e0, 0e0), (0e0, 0e0, 1e0), (0e0, 0e0, -1e0)) v
  UNION ALL SELECT sqrt(1 - h * h) * cos(i * pi() * (3 - sqrt(5e0))), sqrt(1 - h * h) * sin(i * pi() * (3 - sqrt(5e0))), h FROM (SELECT i, 1 - 2 * (i + 0.5e0) / 42 AS h FROM range(42) r(i)) q),
pb AS (SELECT a * s / 2e0 AS a, b * s / 2e0 AS b, c * s / 2e0 AS c FROM un, (VALUES (1), (2)) sh(s)),
ga AS (SELECT scan_id, point_id, label, x, y, z, 0.02e0 + (point_id % 7) / 50e0 AS s0, 1 / sqrt(1 + q * q) AS w, q / sqrt(1 + q * q) AS t FROM (SELECT *, (point_id % 5) / 5e0 AS q FROM fx_object_points) z)"""


def _probe_cells(factor: str) -> str:
    """Cells of the probes scaled by ``factor``, in SQL."""
    return f"""CAST(round_even((x + ((1-2*t*t)*2*s0*a + 2*w*t*2*0.02e0*c) * {factor}) / 0.2e0, 0) AS INT) AS ci, CAST(round_even((y + 2*0.03e0*b * {factor}) / 0.2e0, 0) AS INT) AS cj,
  CAST(round_even((z + ((-2*w*t)*2*s0*a + (1-2*t*t)*2*0.02e0*c) * {factor}) / 0.2e0, 0) AS INT) AS ck"""


INSIDE = OCC + PROBES + f""",
pt AS (SELECT scan_id, point_id, {_probe_cells("1e0")} FROM ga, pb),
ins AS (SELECT pt.scan_id, pt.point_id, avg(CASE WHEN occ.ci IS NULL THEN 0e0 ELSE 1e0 END) AS f FROM pt LEFT JOIN occ USING (scan_id, ci, cj, ck) GROUP BY ALL),
res AS (SELECT ins.scan_id, ins.point_id, label, occ.ci IS NOT NULL AS center_inside, f = 1 AS all_inside, f AS inside_fraction FROM ins JOIN ga USING (scan_id, point_id)
LEFT JOIN occ ON occ.scan_id = ins.scan_id AND occ.ci = round_even(x / 0.2e0, 0) AND occ.cj = round_even(y / 0.2e0, 0) AND occ.ck = round_even(z / 0.2e0, 0))
"""


@query("j24_g6_ellipsoid_inside", fx.with_views("fx_object_points", sql=INSIDE + "SELECT scan_id, point_id, center_inside, all_inside, round(inside_fraction, 6) AS inside_fraction FROM res"))
def j24(spark, sf):
    return ct.ellipsoid_inside(_gaussians(spark, sf), _occ(spark, sf), 0.2).withColumn("inside_fraction", F.round("inside_fraction", 6))


@query("g6_containment_report", fx.with_views("fx_object_points", sql=INSIDE + """
SELECT scan_id, label, count(*) AS gaussians, round(avg(CAST(center_inside AS INT)), 6) AS center_inside_ratio, round(avg(CAST(all_inside AS INT)), 6) AS ellipsoid_inside_ratio,
  round(avg(inside_fraction), 6) AS probe_inside_ratio FROM res GROUP BY scan_id, label"""))
def g6(spark, sf):
    inside = ct.ellipsoid_inside(_gaussians(spark, sf), _occ(spark, sf), 0.2).join(_pts(spark, sf).select(*KEY, "label"), KEY)
    out = ct.containment_report(inside, ["scan_id", "label"])
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.endswith("ratio")})


@query("g7_max_inside_scale", fx.with_views("fx_object_points", recursive=True, sql=INSIDE.rstrip() + f""",
st AS (SELECT scan_id, point_id, 0e0 AS lo, 1e0 AS hi, 0 AS step FROM res WHERE NOT all_inside
  UNION ALL SELECT scan_id, point_id, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END, step + 1 FROM (
    SELECT q.scan_id, q.point_id, lo, hi, mid, step, bool_and(occ.ci IS NOT NULL) AS ok FROM (
      SELECT st.*, (lo + hi) / 2 AS mid, {_probe_cells("((lo + hi) / 2)")} FROM st JOIN ga USING (scan_id, point_id), pb WHERE step < 7) q
    LEFT JOIN occ USING (scan_id, ci, cj, ck) GROUP BY ALL) z)
SELECT scan_id, point_id, lo AS max_scale FROM st WHERE step = 7"""))
def g7(spark, sf):
    return ct.max_inside_scale(_gaussians(spark, sf), _occ(spark, sf), 0.2)


@query("g9_constrain_extents")
def g9(spark, sf):
    return ct.constrain_extents(_gaussians(spark, sf), _occ(spark, sf), 0.2)


@query("g10_affine_fit", fx.with_views("fx_object_points", sql="""
SELECT DISTINCT scan_id, 2.0e0 AS xx, -0.5e0 AS xy, 1.5e0 AS x0 FROM fx_object_points"""))
def g10(spark, sf):
    p = _pts(spark, sf).selectExpr("scan_id", "x", "y", "z", "2D * x - 0.5D * y + 1.5D AS tx", "y + z AS ty", "z - 3D AS tz")
    out = su.affine_fit(p, ["scan_id"])
    return out.select("scan_id", *[F.round(F.col("affine")[i], 5).alias(n) for i, n in ((0, "xx"), (1, "xy"), (3, "x0"))])


@query("g12_silhouette_scores", """
WITH a AS (SELECT o_custkey % 97 AS view, (o_orderkey % 100) / 100e0 AS alpha, o_orderkey % 3 <> 0 AS inside, o_orderkey % 3 <> 0 OR o_orderkey % 4 = 0 AS allowed FROM orders),
c AS (SELECT *, greatest(1e-6, least(1 - 1e-6, alpha)) AS p FROM a)
SELECT view, count(*) FILTER (WHERE inside) AS positive_pixels, round(avg(-ln(p)) FILTER (WHERE inside), 5) AS positive_loss, round(avg(-ln(1 - p)) FILTER (WHERE NOT allowed), 5) AS outside_loss,
  round(1 - (2 * sum(CASE WHEN inside THEN alpha ELSE 0e0 END) + 1e-6) / (sum(alpha) + count(*) FILTER (WHERE inside) + 1e-6), 5) AS dice_loss FROM c GROUP BY view HAVING count(*) FILTER (WHERE inside) >= 16""")
def g12(spark, sf):
    a = fx.table(spark, sf, "orders").selectExpr("o_custkey % 97 AS view", "(o_orderkey % 100) / 100D AS alpha", "o_orderkey % 3 <> 0 AS inside", "o_orderkey % 3 <> 0 OR o_orderkey % 4 = 0 AS allowed")
    out = su.silhouette_scores(a, ["view"])
    return out.select("view", "positive_pixels", *[F.round(c, 5).alias(c) for c in ("positive_loss", "outside_loss", "dice_loss")])


@query("j22_calibration_pairs", """
WITH r AS (SELECT l_suppkey % 5 AS s, l_suppkey % 20 AS f, l_orderkey % 120 AS v, l_partkey % 160 AS u, min(CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity / 2.0e0 END) AS depth FROM lineitem GROUP BY ALL),
z AS (SELECT o_custkey % 5 AS s, o_custkey % 20 AS f, o_orderkey % 120 AS v, o_orderkey % 160 AS u, min(o_totalprice / 20000.0e0) AS z_ref FROM orders GROUP BY ALL)
SELECT concat('s', CAST(r.s AS STRING)) AS scan_id, CAST(r.f AS INT) AS frame_index, CAST(r.v AS INT) AS v, CAST(r.u AS INT) AS u, depth, z_ref FROM r JOIN z ON r.s = z.s AND r.f = z.f AND r.v = z.v AND r.u = z.u
WHERE depth > 0.05e0 AND depth < 20e0""")
def j22(spark, sf):
    pixel = lambda scan, f, v, u: [f"concat('s', string({scan} % 5)) AS scan_id", f"int({f} % 20) AS frame_index", f"int({v} % 120) AS v", f"int({u} % 160) AS u"]
    key = ["scan_id", "frame_index", "v", "u"]
    r = fx.table(spark, sf, "lineitem").selectExpr(*pixel("l_suppkey", "l_suppkey", "l_orderkey", "l_partkey"), "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity / 2.0D END AS depth")
    z = fx.table(spark, sf, "orders").selectExpr(*pixel("o_custkey", "o_custkey", "o_orderkey", "o_orderkey"), "o_totalprice / 20000.0D AS z_ref")
    return cu.calibration_pairs(r.groupBy(*key).agg(F.min("depth").alias("depth")), z.groupBy(*key).agg(F.min("z_ref").alias("z_ref")))


@query("c3_supported_components", fx.with_views("fx_object_points", recursive=True, sql="""
c AS (SELECT scan_id, point_id, support_views >= 4 AS strong, CAST(floor(x / 0.1e0) AS INT) AS i, CAST(floor(y / 0.1e0) AS INT) AS j, CAST(floor(z / 0.1e0) AS INT) AS k FROM fx_object_points),
v AS (SELECT scan_id, i, j, k, count(*) AS n, count(*) FILTER (strong) AS s, row_number() OVER (ORDER BY scan_id, i, j, k) AS id FROM c GROUP BY scan_id, i, j, k),
e AS (SELECT a.id AS s, b.id AS t FROM v a JOIN v b ON a.scan_id = b.scan_id AND b.i BETWEEN a.i - 1 AND a.i + 1 AND b.j BETWEEN a.j - 1 AND a.j + 1 AND b.k BETWEEN a.k - 1 AND a.k + 1 AND a.id <> b.id),
r AS (SELECT id, id AS c FROM v UNION SELECT e.t, r.c FROM r JOIN e ON e.s = r.id),
m AS (SELECT id, min(c) AS c FROM r GROUP BY id),
w AS (SELECT scan_id, c, sum(n) >= 6 OR sum(s) >= 3 AS ok FROM v JOIN m USING (id) GROUP BY scan_id, c)
SELECT c.scan_id, c.point_id, w.ok AS keep FROM c JOIN v USING (scan_id, i, j, k) JOIN m ON m.id = v.id JOIN w ON w.scan_id = c.scan_id AND w.c = m.c"""))
def c3(spark, sf):
    p = _pts(spark, sf).select("scan_id", "point_id", "x", "y", "z", F.lit(0.01).alias("sigma"), (F.col("support_views") >= 4).alias("strong"))
    spacing = p.select("scan_id").distinct().withColumn("spacing", F.lit(0.05))
    return cu.supported_components(p, spacing, ["scan_id"], min_points=6, min_strong=3)[0]


@query("g8_project_to_support", fx.with_views("fx_object_points", sql=OCC + """,
bx AS (SELECT scan_id, min(ci) AS a, max(ci) AS b, min(cj) AS c, max(cj) AS d, min(ck) AS e, max(ck) AS f FROM occ GROUP BY scan_id),
p AS (SELECT scan_id, point_id, x / 0.2e0 + 1.5e0 AS gx, y / 0.2e0 AS gy, z / 0.2e0 - 0.7e0 AS gz FROM fx_object_points),
q AS (SELECT p.*, round_even(gx, 0) AS ri, round_even(gy, 0) AS rj, round_even(gz, 0) AS rk, least(greatest(round_even(gx, 0), a), b) AS i, least(greatest(round_even(gy, 0), c), d) AS j, least(greatest(round_even(gz, 0), e), f) AS k FROM p JOIN bx USING (scan_id)),
n AS (SELECT q.scan_id, q.point_id, arg_min([o.ci, o.cj, o.ck], (abs(o.ci - q.i) + abs(o.cj - q.j) + abs(o.ck - q.k)) * 1000000000 + (o.ci + 400) * 1000000 + (o.cj + 400) * 1000 + o.ck + 400) AS s FROM q JOIN occ o USING (scan_id) GROUP BY ALL)
SELECT q.scan_id, q.point_id, round(CASE WHEN h THEN gx ELSE s[1] + least(greatest(gx - ri, -0.4e0), 0.4e0) END, 6) AS gx, round(CASE WHEN h THEN gy ELSE s[2] + least(greatest(gy - rj, -0.4e0), 0.4e0) END, 6) AS gy,
  round(CASE WHEN h THEN gz ELSE s[3] + least(greatest(gz - rk, -0.4e0), 0.4e0) END, 6) AS gz, NOT h AS moved
FROM (SELECT q.*, s, s[1] = ri AND s[2] = rj AND s[3] = rk AS h FROM q JOIN n USING (scan_id, point_id)) q"""))
def g8(spark, sf):
    occ = _occ(spark, sf)
    b = occ.groupBy("scan_id").agg(*[fn(c).alias(f"{n}_{c}") for c in ("ci", "cj", "ck") for n, fn in (("lo", F.min), ("hi", F.max))])
    for c in ("ci", "cj", "ck"):
        b = b.withColumn(c, F.explode(F.sequence(F.col(f"lo_{c}"), F.col(f"hi_{c}"))))
    near = co.nearest_occupied(b.select("scan_id", "ci", "cj", "ck"), occ, ["scan_id"])
    p = _pts(spark, sf).selectExpr("scan_id", "point_id", "x / 0.2D + 1.5D AS gx", "y / 0.2D AS gy", "z / 0.2D - 0.7D AS gz")
    return cu.project_to_support(p, near, ["scan_id"]).withColumns({g: F.round(g, 6) for g in ("gx", "gy", "gz")})


@query("c6_robust_plane")
def c6(spark, sf):
    p = _pts(spark, sf).withColumn("sigma", F.lit(0.02))
    seeds = p.where("support_views >= 2").select("scan_id", "label", F.col("point_id").alias("seed_id"), "x", "y", "z")
    spacing = p.select("scan_id", "label").distinct().withColumn("spacing", F.lit(0.04))
    return cu.robust_plane(p, seeds, spacing, ["scan_id", "label"])[0]
