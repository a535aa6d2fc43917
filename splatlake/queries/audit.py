"""Audits, batch control and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from splatlake import fixtures as fx
from splatlake.operators import audit as au
from splatlake.queries import query

MASK = ["scan_id", "frame_index", "mask_id"]

REC = """
rec AS (SELECT scan_id, frame_index, mask_id, label, concat(label, '_', CAST(mask_id % 3 AS STRING)) AS track_id,
 CASE WHEN mask_id % 41 = 0 THEN NULL WHEN label IN ('wall', 'floor') THEN 'semantic_room_structure' ELSE 'tracked_object' END AS role,
 CASE WHEN mask_id % 37 = 0 THEN 'other' WHEN label IN ('wall', 'floor') THEN 'segformer_ade_structural' ELSE 'grounding_dino_sam2_video' END AS source,
 mask_id % 29 <> 0 AS accepted, CASE WHEN mask_id % 53 = 0 THEN 'old' ELSE 'new' END AS fingerprint, CASE WHEN mask_id % 31 = 0 THEN 'unknown' ELSE 'visible' END AS state FROM fx_masks)"""


def _rec(spark, sf):
    return fx.view(spark, sf, "fx_masks").selectExpr(
        *MASK, "label", "concat(label, '_', string(mask_id % 3)) AS track_id",
        "CASE WHEN mask_id % 41 = 0 THEN NULL WHEN label IN ('wall', 'floor') THEN 'semantic_room_structure' ELSE 'tracked_object' END AS role",
        "CASE WHEN mask_id % 37 = 0 THEN 'other' WHEN label IN ('wall', 'floor') THEN 'segformer_ade_structural' ELSE 'grounding_dino_sam2_video' END AS source",
        "mask_id % 29 <> 0 AS accepted", "CASE WHEN mask_id % 53 = 0 THEN 'old' ELSE 'new' END AS fingerprint", "CASE WHEN mask_id % 31 = 0 THEN 'unknown' ELSE 'visible' END AS state")


@query("p2_authoritative", fx.with_views("fx_masks", sql=REC + """
SELECT scan_id, mask_id, accepted AND state = 'visible' AND mask_id % 37 <> 0 AND mask_id % 41 <> 0 AS authoritative FROM rec"""))
def p2(spark, sf):
    c = [F.col(n) for n in ("label", "accepted", "state", "role", "source")]
    return _rec(spark, sf).select("scan_id", "mask_id", au.authoritative(*c).alias("authoritative"))


@query("p7_is_structural", fx.with_views("fx_masks", sql=REC + """
SELECT scan_id, mask_id, label IN ('wall', 'floor') AND (mask_id % 41 <> 0 OR mask_id % 37 <> 0) AS structural FROM rec"""))
def p7(spark, sf):
    return _rec(spark, sf).select("scan_id", "mask_id", au.is_structural(F.col("role"), F.col("source")).alias("structural"))


@query("p6_discover_targets", fx.with_views("fx_masks", sql="""
l AS (SELECT DISTINCT scan_id, label, TRUE AS a FROM fx_masks WHERE scan_id <> 'scan_1'), x AS (SELECT scan_id, label, bool_or(a) AS a FROM (SELECT * FROM l UNION ALL SELECT DISTINCT scan_id, v, FALSE FROM fx_masks, (VALUES ('bed'), ('sofa')) q(v)) z GROUP BY ALL)
SELECT scan_id, label, a AS accepted_label, CASE WHEN label IN ('wall', 'floor') THEN 'excluded_geometry_policy' WHEN label NOT IN ('bed', 'desk', 'sofa') THEN 'excluded_not_allowlisted'
 WHEN label NOT IN ('bed', 'sofa') THEN 'excluded_by_explicit_filter' WHEN NOT a THEN 'unavailable' ELSE 'selected_volumetric_class' END AS decision FROM x"""))
def p6(spark, sf):
    m = fx.view(spark, sf, "fx_masks")
    return au.discover_targets(m.where("scan_id <> 'scan_1'"), ["bed", "desk", "sofa"], {"wall": "surface", "floor": "surface"}, ["bed", "sofa"], m)


@query("a7_summaries", fx.with_views("fx_detections", sql="""
SELECT label, count(*) AS count, min(confidence) AS min, round(quantile_cont(confidence, 0.25), 6) AS p25, round(median(confidence), 6) AS median, round(quantile_cont(confidence, 0.75), 6) AS p75,
 max(confidence) AS max, round(avg(confidence), 6) AS mean, round(stddev_pop(confidence), 6) AS std FROM fx_detections GROUP BY label"""))
def a7(spark, sf):
    out = au.summarize(fx.view(spark, sf, "fx_detections"), "confidence", ["label"], with_std=True)
    return out.withColumns({c: F.round(c, 6) for c in ("p25", "median", "p75", "mean", "std")})


@query("a25_instance_audit", fx.with_views("fx_masks", sql=REC + """,
g AS (SELECT scan_id, label, track_id, count(DISTINCT frame_index) AS frames, count(*) AS records FROM rec GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY scan_id, label ORDER BY frames DESC, records DESC, track_id) = 1 AS best, CASE WHEN frames < 16 THEN 'too_few_frames' ELSE 'eligible' END AS status FROM g"""))
def a25(spark, sf):
    return au.instance_audit(_rec(spark, sf), 16)


@query("k4_eligible_objects", fx.with_views("fx_masks", sql=REC + """,
g AS (SELECT scan_id, label, track_id, count(DISTINCT frame_index) AS frames FROM rec GROUP BY ALL HAVING count(DISTINCT frame_index) >= 10)
SELECT scan_id, label, track_id, row_number() OVER (PARTITION BY scan_id ORDER BY label, frames DESC, track_id) AS position FROM g QUALIFY position <= 6"""))
def k4(spark, sf):
    return au.eligible_objects(au.instance_audit(_rec(spark, sf), 10), 6).select("scan_id", "label", "track_id", "position")


@query("a26_dataset_report", fx.with_views("fx_frames", "fx_masks", "fx_runs", sql="""
u AS (SELECT scan_id, frame_index, count(*) AS n FROM (SELECT DISTINCT scan_id, frame_index, y, unnest(range(x0, x1)) AS x FROM fx_runs WHERE label = 'bed') q GROUP BY ALL)
SELECT f.scan_id, f.frame_index, round(coalesce(n, 0) / 19200e0, 6) AS area_fraction, CASE WHEN n IS NULL THEN 'included_blank_shared_coordinate_frame' WHEN n / 19200e0 < 0.02e0 THEN 'mask_too_small' ELSE 'included_positive_target_mask' END AS status
FROM fx_frames f LEFT JOIN u USING (scan_id, frame_index)"""))
def a26(spark, sf):
    out = au.dataset_report(fx.view(spark, sf, "fx_frames"), fx.view(spark, sf, "fx_runs").where("label = 'bed'"), 19200, 0.02)
    return out.withColumn("area_fraction", F.round("area_fraction", 6))


AUDIT = REC + """,
fr AS (SELECT scan_id, frame_index, frame_index <> 7 AS has_json, CASE WHEN frame_index <> 11 THEN 160 END AS w, CASE WHEN frame_index % 9 = 4 THEN 'old' ELSE 'new' END AS f,
  CASE WHEN frame_index = 6 THEN NULL ELSE 'lay' END AS lf FROM fx_frames),
told AS (SELECT r.*, r.accepted AND r.state = 'visible' AS live FROM rec r JOIN fr ON r.scan_id = fr.scan_id AND r.frame_index = fr.frame_index AND has_json AND w IS NOT NULL),
lv AS (SELECT *, coalesce(role, 'unknown') AS ro FROM told WHERE live),
good AS (SELECT * FROM lv WHERE mask_id % 43 <> 0 AND mask_id % 47 <> 0),
px AS (SELECT scan_id, frame_index, y, x FROM (SELECT DISTINCT r.scan_id, r.frame_index, r.mask_id, r.y, unnest(range(r.x0, r.x1)) AS x FROM fx_runs r WHERE mask_id IN (SELECT mask_id FROM good)) q GROUP BY ALL HAVING count(*) > 1),
ov AS (SELECT scan_id, frame_index, count(*) / 19200e0 AS o FROM px GROUP BY ALL),
err AS (SELECT scan_id, frame_index, 'missing_detection_json' AS error, '' AS item FROM fr WHERE NOT has_json
 UNION ALL SELECT scan_id, frame_index, 'tracking_fingerprint_mismatch', '' FROM fr WHERE has_json AND f = 'old'
 UNION ALL SELECT scan_id, frame_index, 'layout_fingerprint_mismatch', '' FROM fr WHERE has_json AND lf IS NULL
 UNION ALL SELECT scan_id, frame_index, 'unreadable_source_image', '' FROM fr WHERE has_json AND w IS NULL
 UNION ALL SELECT scan_id, frame_index, 'nonaccepted_record_in_canonical_detections', CAST(mask_id AS STRING) FROM told WHERE NOT live
 UNION ALL SELECT scan_id, frame_index, CASE WHEN ro = 'tracked_object' THEN 'object_source_violation' ELSE 'structural_source_violation' END, CAST(mask_id AS STRING) FROM lv WHERE ro <> 'unknown' AND source = 'other'
 UNION ALL SELECT scan_id, frame_index, CASE WHEN label IN ('wall', 'floor') THEN 'structural_role_violation' ELSE 'object_role_violation' END, CAST(mask_id AS STRING) FROM lv WHERE ro = 'unknown'
 UNION ALL SELECT scan_id, frame_index, 'duplicate_track', track_id FROM lv QUALIFY row_number() OVER (PARTITION BY scan_id, frame_index, track_id ORDER BY mask_id) > 1
 UNION ALL SELECT scan_id, frame_index, 'missing_or_unreadable_mask', CAST(mask_id AS STRING) FROM lv WHERE mask_id % 43 = 0
 UNION ALL SELECT scan_id, frame_index, 'mask_shape_mismatch', CAST(mask_id AS STRING) FROM lv WHERE mask_id % 43 <> 0 AND mask_id % 47 = 0
 UNION ALL SELECT scan_id, frame_index, 'canonical_masks_overlap', '' FROM ov
 UNION ALL SELECT scan_id, -1, 'published_track_below_minimum_visible_frames', track_id FROM lv GROUP BY scan_id, track_id HAVING count(DISTINCT frame_index) < 10)"""
PROMPTS = ["wall", "floor", "bed", "desk", "pillow", "sofa"]


def _audit(spark, sf):
    frames = fx.view(spark, sf, "fx_frames").selectExpr(
        "scan_id", "frame_index", "frame_index <> 7 AS has_json", "CASE WHEN frame_index <> 11 THEN 160 END AS width", "CASE WHEN frame_index <> 11 THEN 120 END AS height",
        "CASE WHEN frame_index % 9 = 4 THEN 'old' ELSE 'new' END AS fingerprint", "CASE WHEN frame_index = 6 THEN NULL ELSE 'lay' END AS layout_fingerprint")
    masks = fx.view(spark, sf, "fx_masks").where("mask_id % 43 <> 0").selectExpr(*MASK, "CASE WHEN mask_id % 47 = 0 THEN 161 ELSE 160 END AS width", "120 AS height")
    manifests = frames.select("scan_id").distinct().selectExpr("scan_id", "'new' AS fingerprint", "'lay' AS layout_fingerprint")
    return frames, _rec(spark, sf), masks, fx.view(spark, sf, "fx_runs"), manifests


@query("a30_audit_errors", fx.with_views("fx_frames", "fx_masks", "fx_runs", sql=AUDIT + "SELECT * FROM err"))
def a30(spark, sf):
    return au.audit_errors(*_audit(spark, sf), 10)


@query("a31_audit_summary", fx.with_views("fx_frames", "fx_masks", "fx_runs", sql=AUDIT + """,
wn AS (SELECT scan_id, count(*) AS n FROM (SELECT DISTINCT scan_id FROM fr) s, (VALUES ('wall'), ('floor'), ('bed'), ('desk'), ('pillow'), ('sofa')) l(label)
  WHERE (scan_id, label) NOT IN (SELECT (scan_id, label) FROM good) GROUP BY scan_id)
SELECT f.scan_id, f.n AS frame_count, coalesce(g.n, 0) AS accepted_mask_count, coalesce(e.n, 0) AS error_count, coalesce(wn.n, 0) AS warning_count,
  round(coalesce(o.m, 0), 6) AS maximum_overlap_fraction, CASE WHEN e.n > 0 THEN 'failed' ELSE 'success' END AS status
FROM (SELECT scan_id, count(*) AS n FROM fr GROUP BY scan_id) f LEFT JOIN (SELECT scan_id, count(*) AS n FROM good GROUP BY scan_id) g USING (scan_id)
LEFT JOIN (SELECT scan_id, count(*) AS n FROM err GROUP BY scan_id) e USING (scan_id) LEFT JOIN wn USING (scan_id) LEFT JOIN (SELECT scan_id, max(o) AS m FROM ov GROUP BY scan_id) o USING (scan_id)"""))
def a31(spark, sf):
    frames, records, masks, runs, manifests = _audit(spark, sf)
    good = au.audit_parts(frames, records, masks)["good"]
    out = au.audit_summary(frames, good, au.overlaps(good, runs, frames), au.audit_errors(frames, records, masks, runs, manifests, 10), au.audit_warnings(frames, good, PROMPTS))
    return out.withColumn("maximum_overlap_fraction", F.round("maximum_overlap_fraction", 6))


@query("a31_audit_counts", fx.with_views("fx_frames", "fx_masks", "fx_runs", sql=AUDIT + """
SELECT scan_id, 'label' AS kind, label AS name, count(*) AS n FROM good GROUP BY ALL UNION ALL SELECT scan_id, 'source', source, count(*) FROM good GROUP BY ALL
UNION ALL SELECT scan_id, 'role', ro, count(*) FROM good GROUP BY ALL UNION ALL SELECT scan_id, 'state', state, count(*) FROM rec GROUP BY ALL"""))
def a31_counts(spark, sf):
    frames, records, masks, _, _ = _audit(spark, sf)
    return au.audit_counts(au.audit_parts(frames, records, masks)["good"], records)


@query("u5_stale_files", """
SELECT concat('s', CAST(p_partkey % 5 AS STRING)) AS scan_id, p_name AS path FROM part WHERE p_size <= 10 AND p_partkey % 5 <> 3 AND (p_partkey % 5, p_name) NOT IN (SELECT (p_partkey % 5, p_name) FROM part WHERE p_size > 10)""")
def u5(spark, sf):
    p = fx.table(spark, sf, "part").selectExpr("concat('s', string(p_partkey % 5)) AS scan_id", "p_name AS path", "p_size")
    bad = p.where("scan_id = 's3'").select("scan_id")
    return au.stale_files(p.where("p_size <= 10").select("scan_id", "path"), p.where("p_size > 10"), bad)


@query("s17_pending_stages", """
SELECT 's' AS scan_id, CAST(p_partkey AS STRING) AS stage, p_partkey % 4 = 0 AS fingerprint_changed, CAST(CASE WHEN p_size < 5 THEN 1 ELSE 0 END AS BIGINT) AS missing_outputs FROM part WHERE p_partkey % 4 = 0 OR p_size < 5""")
def s17(spark, sf):
    p = fx.table(spark, sf, "part")
    stages = p.selectExpr("'s' AS scan_id", "string(p_partkey) AS stage", "p_brand AS fingerprint", "array(concat('a', p_partkey), concat('b', p_partkey)) AS outputs")
    old = p.selectExpr("'s' AS scan_id", "string(p_partkey) AS stage", "IF(p_partkey % 4 = 0, 'x', p_brand) AS fingerprint")
    listing = p.selectExpr("'s' AS scan_id", "concat('a', p_partkey) AS path").union(p.where("p_size >= 5").selectExpr("'s'", "concat('b', p_partkey)"))
    return au.pending_stages(stages, old, listing)


def _targets(spark, sf):
    return fx.table(spark, sf, "part").selectExpr("'s' AS scan_id", "string(p_partkey) AS object_key", "p_type AS label", "p_brand AS instance_id", "concat('v', string(p_size % 3)) AS variant", "'r1' AS run_id")


def _done(spark, sf):
    s = _targets(spark, sf).selectExpr("*", "IF(int(object_key) % 3 = 0, 'failed', 'success') AS status", "concat('f', object_key) AS path")
    s = s.withColumn("run_id", F.expr("IF(int(object_key) % 7 = 0, 'r0', run_id)"))
    files = _targets(spark, sf).selectExpr("scan_id", "concat('f', object_key) AS path", "IF(int(object_key) % 5 = 0, 0, 9) AS size")
    return au.recoverable(s, _targets(spark, sf), files)


@query("j20_recoverable", """
SELECT 's' AS scan_id, CAST(p_partkey AS STRING) AS object_key, concat('v', CAST(p_size % 3 AS STRING)) AS variant, concat('f', CAST(p_partkey AS STRING)) AS path FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 5 <> 0""")
def j20(spark, sf):
    return _done(spark, sf)


@query("j21_pending", """
SELECT CAST(p_partkey AS STRING) AS object_key, concat('v', CAST(p_size % 3 AS STRING)) AS variant FROM part WHERE NOT (p_partkey % 3 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 5 <> 0)""")
def j21(spark, sf):
    return au.pending(_targets(spark, sf), _done(spark, sf)).select("object_key", "variant")


@query("a33_batch_status", """
SELECT concat('s', CAST(p_size AS STRING)) AS scan_id, count(*) AS planned, count(*) FILTER (WHERE p_partkey % 11 <> 0 AND p_size % 4 <> 0) AS success, count(*) FILTER (WHERE p_size % 4 = 0 AND p_partkey % 11 <> 0 AND p_size % 8 = 0) AS failed,
 CASE WHEN count(*) FILTER (WHERE p_partkey % 11 = 0) > 0 THEN 'in_progress_checkpoint' WHEN p_size % 8 = 0 THEN 'partial_failure' WHEN p_size % 4 = 0 THEN 'success_with_skips' ELSE 'success' END AS batch_status FROM part GROUP BY p_size""")
def a33(spark, sf):
    p = fx.table(spark, sf, "part")
    rows = p.selectExpr("concat('s', string(p_size)) AS scan_id", "p_partkey", "CASE WHEN p_size % 8 = 0 THEN 'failed' WHEN p_size % 4 = 0 THEN 'skipped' ELSE 'success' END AS status")
    return au.batch_status(rows.where("p_partkey % 11 <> 0"), rows).select("scan_id", "planned", "success", "failed", "batch_status")


@query("a34_inspect_exports", fx.with_views("fx_object_points", sql="""
SELECT scan_id, label, count(*) AS count, round(avg(x), 5) AS center_x, round(max(y) - min(y), 5) AS span_y, round(quantile_cont(confidence, 0.9), 5) AS alpha_p90 FROM fx_object_points GROUP BY ALL"""))
def a34(spark, sf):
    p = fx.view(spark, sf, "fx_object_points").withColumns({"sigma": F.col("z"), "alpha": F.col("confidence")})
    o = au.inspect_exports(p, ["scan_id", "label"])
    return o.select("scan_id", "label", "count", F.round("center_x", 5).alias("center_x"), F.round("span_y", 5).alias("span_y"), F.round("alpha_p90", 5).alias("alpha_p90"))


@query("a35_select_cleanup", """
WITH c AS (SELECT p_partkey AS k, r, 100 + (p_partkey * (r + 3) * 37) % 1500 AS n FROM part, (VALUES (0), (1), (2)) v(r))
SELECT 's' AS scan_id, CAST(k AS STRING) AS object_key, coalesce('candidate_' || CAST(min(r) FILTER (WHERE n >= 500 AND n / 1000e0 >= 0.7e0) AS STRING), 'raw') AS selected FROM c GROUP BY k""")
def a35(spark, sf):
    c = fx.table(spark, sf, "part").selectExpr("'s' AS scan_id", "string(p_partkey) AS object_key", "p_partkey", "explode(array(0, 1, 2)) AS rank")
    c = c.selectExpr("scan_id", "object_key", "rank", "concat('candidate_', rank) AS name", "100 + (p_partkey * (rank + 3) * 37) % 1500 AS count", "1000 AS alpha_count")
    return au.select_cleanup(c)


@query("a36_isolation", fx.with_views("fx_frames", "fx_masks", "fx_runs", sql="""
r AS (SELECT DISTINCT scan_id, frame_index, y, unnest(range(x0, x1)) AS x FROM fx_runs WHERE label = 'bed'), t AS (SELECT DISTINCT scan_id, frame_index, y, unnest(range(x0, x1)) AS x FROM fx_runs WHERE label = 'desk'),
a AS (SELECT coalesce(r.scan_id, t.scan_id) AS scan_id, coalesce(r.frame_index, t.frame_index) AS frame_index, count(r.x) AS nr, count(t.x) AS nt, count(*) FILTER (WHERE r.x IS NOT NULL AND t.x IS NOT NULL) AS i, count(*) AS un
  FROM r FULL JOIN t ON r.scan_id = t.scan_id AND r.frame_index = t.frame_index AND r.y = t.y AND r.x = t.x GROUP BY ALL)
SELECT f.scan_id, f.frame_index, round(i / nullif(un, 0), 6) AS iou, round(i / nullif(nr, 0), 6) AS precision, round(i / nullif(nt, 0), 6) AS recall, round((nr - i) / nullif(nr, 0), 6) AS leakage, coalesce(nt, 0) = 0 AND coalesce(nr, 0) > 0 AS empty_view_false_positive
FROM fx_frames f LEFT JOIN a USING (scan_id, frame_index)"""))
def a36(spark, sf):
    r = fx.view(spark, sf, "fx_runs")
    out = au.isolation(r.where("label = 'bed'"), r.where("label = 'desk'"), fx.view(spark, sf, "fx_frames"), ["scan_id", "frame_index"])
    return out.select("scan_id", "frame_index", *[F.round(c, 6).alias(c) for c in ("iou", "precision", "recall", "leakage")], "empty_view_false_positive")


@query("a36_isolation_delta", fx.with_views("fx_frames", "fx_masks", "fx_runs", sql="""
px AS (SELECT DISTINCT scan_id, frame_index, label, y, unnest(range(x0, x1)) AS x FROM fx_runs WHERE label IN ('bed', 'desk', 'pillow')),
r AS (SELECT DISTINCT scan_id, frame_index, y, x FROM px WHERE label <> 'desk'), c AS (SELECT scan_id, frame_index, y, x FROM px WHERE label = 'bed'), t AS (SELECT scan_id, frame_index, y, x FROM px WHERE label = 'desk'),
n AS (SELECT scan_id, frame_index, (SELECT count(*) FROM r WHERE r.scan_id = f.scan_id AND r.frame_index = f.frame_index) AS nr, (SELECT count(*) FROM c WHERE c.scan_id = f.scan_id AND c.frame_index = f.frame_index) AS nc,
  (SELECT count(*) FROM t WHERE t.scan_id = f.scan_id AND t.frame_index = f.frame_index) AS nt, (SELECT count(*) FROM r JOIN t USING (scan_id, frame_index, y, x) WHERE scan_id = f.scan_id AND frame_index = f.frame_index) AS ir,
  (SELECT count(*) FROM c JOIN t USING (scan_id, frame_index, y, x) WHERE scan_id = f.scan_id AND frame_index = f.frame_index) AS ic FROM fx_frames f)
SELECT scan_id, frame_index, round((nc - ic) / nullif(nc, 0) - (nr - ir) / nullif(nr, 0), 6) AS delta_leakage, round(ic / nullif(nt, 0) - ir / nullif(nt, 0), 6) AS delta_recall FROM n"""))
def a36_delta(spark, sf):
    r, keys = fx.view(spark, sf, "fx_runs"), ["scan_id", "frame_index"]
    frames, target = fx.view(spark, sf, "fx_frames"), r.where("label = 'desk'")
    raw, clean = (au.isolation(r.where(c), target, frames, keys) for c in ("label IN ('bed', 'pillow')", "label = 'bed'"))
    return au.isolation_delta(raw, clean, keys).select(*keys, *[F.round(c, 6).alias(c) for c in ("delta_leakage", "delta_recall")])


@query("a35_cap_sigma", fx.with_views("fx_object_points", sql="""
g AS (SELECT scan_id, label, point_id, support_views * 0.01e0 + point_id % 97 / 1000.0e0 AS s FROM fx_object_points), q AS (SELECT scan_id, label, quantile_cont(s, 0.97) AS q FROM g GROUP BY ALL)
SELECT scan_id, point_id, round(least(s, q), 8) AS sigma FROM g JOIN q USING (scan_id, label)"""))
def a35_cap(spark, sf):
    g = fx.view(spark, sf, "fx_object_points").selectExpr("scan_id", "label", "point_id", "support_views * 0.01D + point_id % 97 / 1000.0D AS sigma")
    return au.cap_sigma(g, ["scan_id", "label"]).select("scan_id", "point_id", F.round("sigma", 8).alias("sigma"))


@query("f8_key_collisions", """
WITH k AS (SELECT concat('s', CAST(p_size % 3 AS STRING)) AS scan_id, CASE WHEN p_partkey % 2 = 0 THEN 'bed' ELSE 'bed_lamp' END AS label, concat('bed_lamp_', CAST(p_size AS STRING)) AS instance_id FROM part)
SELECT scan_id, instance_id AS object_key, count(DISTINCT label) AS objects FROM k GROUP BY ALL HAVING count(DISTINCT label) > 1""")
def f8_collisions(spark, sf):
    from splatlake.functions import text

    k = fx.table(spark, sf, "part").selectExpr("concat('s', string(p_size % 3)) AS scan_id", "CASE WHEN p_partkey % 2 = 0 THEN 'bed' ELSE 'bed_lamp' END AS label", "concat('bed lamp ', p_size) AS instance_id")
    return au.key_collisions(k.withColumn("object_key", text.object_key(F.col("label"), F.col("instance_id"))))


@query("a37_macro_average", """
SELECT l_returnflag, round(avg(m), 5) AS macro_mean, count(*) AS items FROM (SELECT l_returnflag, l_suppkey, avg(l_discount) AS m FROM lineitem GROUP BY ALL) q GROUP BY l_returnflag""")
def a37(spark, sf):
    return au.macro_average(fx.table(spark, sf, "lineitem"), "l_suppkey", "l_returnflag", "l_discount").withColumn("macro_mean", F.round("macro_mean", 5))


@query("a37_bootstrap_ci")
def a37_ci(spark, sf):
    m = fx.table(spark, sf, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.avg("l_discount").alias("a"), F.avg("l_tax").alias("b"))
    return au.bootstrap_ci(m, ["l_returnflag"], "l_suppkey", "a", "b", 1000)


PRED = "WITH p AS (SELECT 's' AS scan_id, (l_orderkey % 100) / 100e0 AS confidence, l_quantity * 2 < l_orderkey % 100 AS correct FROM lineitem)"


def _preds(spark, sf):
    return fx.table(spark, sf, "lineitem").selectExpr("'s' AS scan_id", "(l_orderkey % 100) / 100D AS confidence", "l_quantity * 2 < l_orderkey % 100 AS correct")


@query("a38_calibration", PRED + """
SELECT scan_id, CAST(least(9, floor(confidence * 10)) AS INT) AS bin, count(*) AS n, round(avg(confidence), 6) AS mean_confidence, round(avg(CAST(correct AS INT)), 6) AS accuracy FROM p GROUP BY ALL""")
def a38(spark, sf):
    return au.calibration(_preds(spark, sf)).withColumns({c: F.round(c, 6) for c in ("mean_confidence", "accuracy")})


@query("a38_abstention", PRED + """
SELECT scan_id, t AS threshold, round(count(*) FILTER (WHERE confidence >= t) / count(*), 6) AS coverage, round(avg(CAST(correct AS INT)) FILTER (WHERE confidence >= t), 6) AS accuracy FROM p, (VALUES (0.25e0), (0.5e0), (0.75e0)) v(t) GROUP BY ALL""")
def a38_abstain(spark, sf):
    return au.abstention(_preds(spark, sf), [0.25, 0.5, 0.75]).withColumns({c: F.round(c, 6) for c in ("coverage", "accuracy")})
