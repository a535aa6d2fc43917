"""Detection gates, suppression, evidence and prompt plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from splatlake import config as cfg, fixtures as fx
from splatlake.operators import detections as de
from splatlake.queries import query


def _case(values, default):
    return "CASE label " + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in values.items()) + f" ELSE {default}e0 END"


GATE = f"""
cl AS (SELECT * EXCLUDE (x1, y1, x2, y2), least(639.0e0, x1) AS x1, least(479.0e0, y1) AS y1, least(639.0e0, x2) AS x2, least(479.0e0, y2) AS y2 FROM fx_detections),
gt AS (SELECT *, (x2-x1)*(y2-y1)/307200.0e0 AS frac,
  CASE WHEN label = 'miscellaneous' AND prompt_kind = 'generic_fallback' THEN 0.42e0 ELSE {_case(cfg.DETECTION_THRESHOLDS, 99)} END AS th,
  CASE WHEN label = 'miscellaneous' AND prompt_kind = 'generic_fallback' THEN 0.20e0 ELSE {_case(cfg.MAX_BOX_FRACTION, 0.7)} END AS mx FROM cl),
gated AS (SELECT *, CASE WHEN confidence < th THEN 'below_class_threshold' WHEN frac < 0.00015e0 THEN 'box_too_small'
  WHEN frac > mx THEN 'box_too_large' WHEN x2 <= x1 OR y2 <= y1 THEN 'invalid_box' END AS reason FROM gt)"""
IOU = """
pairs AS (SELECT a.scan_id, a.frame_index, a.detection_id AS ida, b.detection_id AS idb, a.label AS la, b.label AS lb, a.prompt_kind AS ka, a.confidence AS ca,
  greatest(0e0, least(a.x2,b.x2)-greatest(a.x1,b.x1)) * greatest(0e0, least(a.y2,b.y2)-greatest(a.y1,b.y1)) AS inter,
  (a.x2-a.x1)*(a.y2-a.y1) AS aa, (b.x2-b.x1)*(b.y2-b.y1) AS ab,
  sqrt(pow((a.x1+a.x2-b.x1-b.x2)/2,2)+pow((a.y1+a.y2-b.y1-b.y2)/2,2))/800.0e0 AS dist
  FROM fx_detections a JOIN fx_detections b ON a.scan_id = b.scan_id AND a.frame_index = b.frame_index AND a.detection_id <> b.detection_id)"""


def _d(spark, sf):
    return fx.view(spark, sf, "fx_detections")


@query("p1_detection_gates", fx.with_views("fx_detections", sql=GATE + """
SELECT detection_id, scan_id, label, round(frac, 9) AS box_area_fraction, reason AS rejection_reason, reason IS NULL AS accepted, x2, y2 FROM gated"""))
def p1(spark, sf):
    out = de.gate(_d(spark, sf))
    return out.select("detection_id", "scan_id", "label", F.round("box_area_fraction", 9).alias("box_area_fraction"),
                      "rejection_reason", "accepted", "x2", "y2")


NMS = """
o AS (SELECT *, row_number() OVER (PARTITION BY scan_id, frame_index, label ORDER BY CASE prompt_kind WHEN 'named_fallback' THEN 3
  WHEN 'canonical' THEN 2 WHEN 'alias' THEN 2 ELSE 1 END DESC, confidence DESC, detection_id) AS rn FROM fx_detections),
e AS (SELECT a.scan_id, a.frame_index, a.label, a.rn, list(b.rn ORDER BY b.rn) AS over, list(b.detection_id ORDER BY b.rn) AS ids FROM o a JOIN o b
  ON a.scan_id = b.scan_id AND a.frame_index = b.frame_index AND a.label = b.label AND b.rn < a.rn
  WHERE greatest(0e0, least(a.x2,b.x2)-greatest(a.x1,b.x1)) * greatest(0e0, least(a.y2,b.y2)-greatest(a.y1,b.y1)) /
   ((a.x2-a.x1)*(a.y2-a.y1) + (b.x2-b.x1)*(b.y2-b.y1) - greatest(0e0, least(a.x2,b.x2)-greatest(a.x1,b.x1)) * greatest(0e0, least(a.y2,b.y2)-greatest(a.y1,b.y1))) >= 0.5e0
  GROUP BY ALL),
r AS (SELECT scan_id, frame_index, label, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS kept FROM o GROUP BY ALL
  UNION ALL SELECT r.scan_id, r.frame_index, r.label, r.rn + 1,
    CASE WHEN e.over IS NOT NULL AND len(list_intersect(e.over, r.kept)) > 0 THEN r.kept ELSE list_append(r.kept, r.rn + 1) END
  FROM r JOIN o ON o.scan_id = r.scan_id AND o.frame_index = r.frame_index AND o.label = r.label AND o.rn = r.rn + 1
  LEFT JOIN e ON e.scan_id = r.scan_id AND e.frame_index = r.frame_index AND e.label = r.label AND e.rn = r.rn + 1),
f AS (SELECT scan_id, frame_index, label, arg_max(kept, rn) AS kept FROM r GROUP BY ALL)"""


@query("j7_nms", fx.with_views("fx_detections", recursive=True, sql=NMS + """
SELECT o.detection_id, CASE WHEN list_contains(f.kept, o.rn) THEN NULL ELSE
  e.ids[list_position(e.over, list_min(list_intersect(e.over, f.kept)))] END AS suppressed_by
FROM o JOIN f USING (scan_id, frame_index, label) LEFT JOIN e USING (scan_id, frame_index, label, rn)"""))
def j7(spark, sf):
    return de.nms(_d(spark, sf)).select("detection_id", "suppressed_by")


@query("j8_drop_generic", fx.with_views("fx_detections", sql=IOU + """
SELECT d.detection_id, s.by_id AS suppressed_by FROM fx_detections d LEFT JOIN (SELECT ida, min(idb) AS by_id FROM pairs
 WHERE la = 'miscellaneous' AND ka = 'generic_fallback' AND lb <> 'miscellaneous' AND (inter/(aa+ab-inter) >= 0.2e0 OR inter/least(aa,ab) >= 0.65e0) GROUP BY ida) s ON s.ida = d.detection_id"""))
def j8(spark, sf):
    return de.drop_generic(_d(spark, sf)).select("detection_id", "suppressed_by")


@query("j9_drop_conflicts", fx.with_views("fx_detections", sql=IOU + """
SELECT d.detection_id, CASE WHEN d.label = 'curtain' AND d.confidence < 0.86e0 AND c.ida IS NULL THEN 'curtain_without_window_context'
  WHEN b.ida IS NOT NULL THEN 'blanket_duplicates_bed_extent' END AS conflict_reason, b.bed AS conflict_with FROM fx_detections d
LEFT JOIN (SELECT DISTINCT ida FROM pairs WHERE la = 'curtain' AND lb = 'window' AND (inter/least(aa,ab) >= 0.08e0 OR dist <= 0.2e0)) c ON c.ida = d.detection_id
LEFT JOIN (SELECT ida, min(idb) AS bed FROM pairs WHERE la = 'blanket' AND lb = 'bed' AND inter/greatest(1,aa) >= 0.8e0 AND aa/greatest(1,ab) >= 0.55e0 GROUP BY ida) b ON b.ida = d.detection_id"""))
def j9(spark, sf):
    return de.drop_conflicts(_d(spark, sf)).select("detection_id", "conflict_reason", "conflict_with")


CORE = "(VALUES " + ", ".join(f"('{c}')" for c in cfg.CORE_LABELS) + ") c(label)"


@query("a2_label_evidence", fx.with_views("fx_detections", sql=f"""
SELECT s.scan_id, c.label, count(d.detection_id) AS detection_count, count(DISTINCT d.frame_index) AS anchor_frame_count,
  coalesce(max(confidence), 0e0) AS maximum_confidence FROM (SELECT DISTINCT scan_id FROM fx_detections) s CROSS JOIN {CORE}
LEFT JOIN fx_detections d ON d.scan_id = s.scan_id AND d.label = c.label GROUP BY ALL"""))
def a2(spark, sf):
    d = _d(spark, sf)
    return de.label_evidence(d, d)


STRONG = "fx_detections WHERE confidence > 0.97e0 AND label IN ('bed', 'window')"


@query("a3_active_profiles", fx.with_views("fx_detections", sql="""
SELECT scan_id, profile, profile = 'room_details' OR (profile = 'bedroom' AND bed) AS active, CASE WHEN profile = 'bedroom' AND bed THEN 'bed' ELSE '' END AS matched
FROM (SELECT scan_id, bool_or(label = 'bed' AND confidence > 0.98e0) AS bed FROM fx_detections GROUP BY scan_id) s,
 (VALUES ('room_details'), ('bedroom'), ('workspace'), ('living_room')) p(profile)"""))
def a3(spark, sf):
    d = _d(spark, sf)
    ev = de.label_evidence(d.where("confidence > 0.98D"), d)
    return de.active_profiles(ev).select("scan_id", "profile", "active", F.array_join("matched_triggers", ",").alias("matched"))


@query("a4_prompt_plan", fx.with_views("fx_detections", sql="""
SELECT scan_id, 15 AS core_prompts, CASE WHEN bed THEN 35 ELSE 23 END AS expanded_prompts
FROM (SELECT scan_id, bool_or(label = 'bed' AND confidence > 0.98e0) AS bed FROM fx_detections GROUP BY scan_id) s"""))
def a4(spark, sf):
    d = _d(spark, sf)
    plan = de.prompt_plan(de.active_profiles(de.label_evidence(d.where("confidence > 0.98D"), d)))
    return plan.groupBy("scan_id").agg(
        F.count(F.when(F.col("pass") == "core", 1)).cast("int").alias("core_prompts"),
        F.count(F.when(F.col("pass") == "expanded", 1)).cast("int").alias("expanded_prompts"),
    )


@query("a5_reason_counts", fx.with_views("fx_detections", sql=GATE + """
SELECT scan_id, r AS reason, count(*) AS n FROM (SELECT scan_id, unnest(string_split(concat(label, ';', coalesce(reason, 'accepted')), ';')) AS r FROM gated) q GROUP BY ALL"""))
def a5(spark, sf):
    g = de.gate(_d(spark, sf)).withColumn("r", F.concat_ws(";", "label", F.coalesce("rejection_reason", F.lit("accepted"))))
    return de.reason_counts(g, "r", ["scan_id"])


@query("f6_canonical_label", """
WITH p(ordinal, prompt, label) AS (VALUES (0, 'economy', 'bed'), (1, 'standard_brand', 'chair'), (2, 'promo', 'fan'), (3, 'type_small', 'rug')),
raw AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS STRING) WHEN 1 THEN concat('The ', p_type) WHEN 2 THEN concat('old ', p_type) ELSE p_type END AS raw FROM part),
n AS (SELECT p_partkey, raw, regexp_replace(replace(lower(raw), ' ', '_'), '^(a|an|the)_', '') AS n FROM raw)
SELECT p_partkey, raw AS raw_label, CASE WHEN p_partkey % 4 = 0 THEN (SELECT label FROM p WHERE ordinal = TRY_CAST(raw AS INT)) ELSE coalesce(
  (SELECT label FROM p WHERE prompt = n), (SELECT arg_min(label, ordinal) FROM p WHERE ends_with(n, concat('_', prompt)) OR ends_with(prompt, concat('_', n)))) END AS label FROM n""")
def f6(spark, sf):
    part = fx.table(spark, sf, "part")
    prompts = spark.createDataFrame([(0, "economy", "bed"), (1, "standard_brand", "chair"), (2, "promo", "fan"), (3, "type_small", "rug")],
                                    "ordinal int, prompt string, label string")
    raw = part.selectExpr("p_partkey", """CASE p_partkey % 4 WHEN 0 THEN string(p_size) WHEN 1 THEN concat('The ', p_type)
                          WHEN 2 THEN concat('old ', p_type) ELSE p_type END AS raw_label""")
    return de.canonical_label(raw, prompts).select("p_partkey", "raw_label", "label")


@query("f7_class_ids", """
WITH n AS (SELECT p_partkey AS id, lower(p_type) AS a, concat(lower(p_type), '_', CAST(p_size AS STRING)) AS b FROM part)
SELECT t AS label, count(*) AS n, CAST(sum(id) AS BIGINT) AS id_sum FROM (SELECT id, 'first' AS t FROM n WHERE a = 'economy' OR b LIKE 'promo\\_%' ESCAPE '\\'
 UNION ALL SELECT id, 'second' FROM n WHERE a = 'small') q GROUP BY t""")
def f7(spark, sf):
    part = fx.table(spark, sf, "part")
    named = part.select(F.col("p_partkey").alias("class_id"),
                        F.concat(F.col("p_type"), F.lit(" ; "), F.lower("p_type"), F.lit(" "), F.col("p_size").cast("string")).alias("name"))
    only = {"first": ["economy", "promo"], "second": ["small"]}
    out = de.class_ids(named, only)
    return out.select("label", F.size("class_ids").cast("bigint").alias("n"), F.aggregate("class_ids", F.lit(0).cast("bigint"), lambda s, v: s + v).alias("id_sum"))


@query("p9_taxonomy_errors", """
WITH pr AS (SELECT p_brand AS label, lower(p_type) AS prompt FROM part), core AS (SELECT DISTINCT p_brand AS label FROM part WHERE p_size > 25 UNION SELECT 'Nowhere'),
prof AS (SELECT DISTINCT p_brand AS label FROM part WHERE p_size < 3)
SELECT 'duplicate_normalized_prompt' AS error, prompt AS item FROM pr GROUP BY prompt HAVING count(DISTINCT label) > 1
UNION ALL SELECT 'unknown_label', label FROM (SELECT * FROM core UNION SELECT * FROM prof) q WHERE label NOT IN (SELECT label FROM pr)
UNION ALL SELECT 'unreachable_label', label FROM (SELECT DISTINCT label FROM pr) q WHERE label NOT IN (SELECT * FROM core UNION SELECT * FROM prof)""")
def p9(spark, sf):
    part = fx.table(spark, sf, "part")
    prompts = part.select(F.col("p_brand").alias("label"), F.col("p_type").alias("prompt"))
    core = part.where("p_size > 25").select(F.col("p_brand").alias("label")).union(spark.range(1).select(F.lit("Nowhere")))
    prof = part.where("p_size < 3").select(F.col("p_brand").alias("label"))
    return de.taxonomy_errors(prompts, prof, core)
