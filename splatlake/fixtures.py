"""Scene-shaped views over the driver's tables.

Each view is one SQL text that Spark and DuckDB both accept (all non-integer literals carry ``e0``
so that both engines compute in DOUBLE).  Row counts grow with the source tables: a scan holds 20
frames, 3,000 points and 300 masks, and the number of scans grows with the scale factor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from splatlake.functions.camera import invert_affine

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

IMAGE_W, IMAGE_H = 160, 120

VIEWS: dict[str, str] = {
    # cameras: yaw is a rational rotation, so both engines hold the same doubles
    "fx_frames": """
SELECT concat('scan_', CAST(CAST(floor(s_suppkey / 20.0e0) AS INT) AS STRING)) AS scan_id,
       CAST(s_suppkey % 20 AS INT) AS frame_index,
       concat('frame_', lpad(CAST(s_suppkey % 20 AS STRING), 6, '0')) AS frame_key,
       160 AS width, 120 AS height, 125.0e0 AS fx, 125.0e0 AS fy, 80.0e0 AS cx, 60.0e0 AS cy,
       1.0e0*(s_suppkey % 5) - 2.0e0 AS cam_x, 1.5e0 AS cam_y,
       2.0e0 + 0.25e0*(s_suppkey % 3) AS cam_z,
       CASE s_suppkey % 4 WHEN 0 THEN 1.0e0 WHEN 1 THEN 0.96e0 WHEN 2 THEN 0.8e0 ELSE 0.96e0 END AS yaw_c,
       CASE s_suppkey % 4 WHEN 0 THEN 0.0e0 WHEN 1 THEN 0.28e0 WHEN 2 THEN -0.6e0 ELSE -0.28e0 END AS yaw_s
FROM supplier""",
    "fx_points": """
SELECT concat('scan_', CAST(CAST(floor(o_custkey / 300.0e0) AS INT) AS STRING)) AS scan_id,
       o_orderkey AS point_id,
       (o_orderkey % 97) / 97.0e0 * 6.2e0 - 3.1e0 AS x,
       (o_orderkey % 61) / 61.0e0 * 3.0e0 AS y,
       (o_custkey % 83) / 83.0e0 * 4.2e0 - 2.1e0 AS z,
       0.025e0 + (o_orderkey % 20) / 1000.0e0 AS radius,
       (o_orderkey % 15) - 7.0e0 AS opacity,
       CAST(o_orderkey % 4 AS INT) * 60 AS r, CAST(o_orderkey % 3 AS INT) * 80 AS g,
       CAST(o_orderkey % 2 AS INT) * 90 AS b
FROM orders""",
    "fx_masks": """
SELECT concat('scan_', CAST(CAST(floor(c_custkey / 300.0e0) AS INT) AS STRING)) AS scan_id,
       c_custkey AS mask_id, CAST(c_custkey % 20 AS INT) AS frame_index,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'wall' WHEN 'AUTOMOBILE' THEN 'floor'
            WHEN 'MACHINERY' THEN 'bed' WHEN 'HOUSEHOLD' THEN 'desk' ELSE 'pillow' END AS label,
       0.5e0 + (c_custkey % 50) / 100.0e0 AS score,
       CAST(c_custkey * 31 % 150 AS INT) - 5 AS x0, CAST(c_custkey * 17 % 115 AS INT) - 4 AS y0,
       CAST(8 + c_custkey * 13 % 40 AS INT) AS w, CAST(6 + c_custkey * 7 % 30 AS INT) AS h
FROM customer""",
    # every third row of a mask has a gap, so masks are not plain rectangles
    "fx_runs": """
SELECT scan_id, frame_index, mask_id, label, y, x0, x1 FROM (
  SELECT scan_id, frame_index, mask_id, label, y,
         greatest(0, x0) AS x0,
         least(160, CASE WHEN (y - y0) % 3 = 1 THEN x0 + CAST(floor(w / 3.0e0) AS INT) ELSE x0 + w END) AS x1
  FROM fx_mask_rows
  UNION ALL
  SELECT scan_id, frame_index, mask_id, label, y,
         greatest(0, x0 + CAST(floor(w / 3.0e0) AS INT) + 2) AS x0, least(160, x0 + w) AS x1
  FROM fx_mask_rows WHERE (y - y0) % 3 = 1
) q WHERE x1 > x0 AND y >= 0 AND y < 120""",
    "fx_detections": """
SELECT concat('scan_', CAST(CAST(floor(user_id / 30.0e0) AS INT) AS STRING)) AS scan_id,
       event_id AS detection_id, CAST(8 * (event_id % 20) AS INT) AS frame_index,
       concat('frame_', lpad(CAST(8 * (event_id % 20) AS STRING), 6, '0')) AS frame_key,
       CASE event_type WHEN 'view' THEN 'bed' WHEN 'click' THEN 'blanket' WHEN 'purchase' THEN 'window'
                       WHEN 'signup' THEN 'curtain' ELSE 'miscellaneous' END AS label,
       CASE event_id % 4 WHEN 0 THEN 'canonical' WHEN 1 THEN 'alias'
                         WHEN 2 THEN 'named_fallback' ELSE 'generic_fallback' END AS prompt_kind,
       0.2e0 + (event_id * 37 % 80) / 100.0e0 AS confidence,
       1.0e0*(event_id * 53 % 400) AS x1, 1.0e0*(event_id * 29 % 300) AS y1,
       1.0e0*(event_id * 53 % 400) + 20 + (event_id * 7 % 200) AS x2,
       1.0e0*(event_id * 29 % 300) + 20 + (event_id * 11 % 150) AS y2,
       640 AS width, 480 AS height
FROM events""",
    # one candidate mask per (scan, object, frame); direction rows are drawn from it
    "fx_candidates": """
SELECT concat('scan_', CAST(CAST(floor(o_orderkey / 600.0e0) AS INT) AS STRING)) AS scan_id,
       CAST(floor(o_orderkey / 30.0e0) % 20 AS INT) + 1 AS sam_object_id,
       CAST(o_orderkey % 30 AS INT) AS frame_index,
       0.70e0 + (o_orderkey * 31 % 30) / 100.0e0 AS stability_f,
       0.40e0 + (o_orderkey * 17 % 60) / 100.0e0 AS conf_f,
       0.70e0 + (o_orderkey * 23 % 30) / 100.0e0 AS stability_r,
       0.40e0 + (o_orderkey * 11 % 60) / 100.0e0 AS conf_r,
       (o_orderkey * 13 % 100) / 100.0e0 AS pair_iou,
       0.00005e0 + (o_orderkey * 7 % 97) / 130.0e0 AS area_fraction,
       0.3e0 + (o_orderkey * 19 % 70) / 100.0e0 AS largest_component_ratio,
       o_orderkey % 7 <> 0 AS has_forward, o_orderkey % 5 <> 0 AS has_reverse,
       1.0e0*(o_orderkey * 53 % 400) AS x1, 1.0e0*(o_orderkey * 29 % 300) AS y1,
       1.0e0*(o_orderkey * 53 % 400) + 40 AS x2, 1.0e0*(o_orderkey * 29 % 300) + 50 AS y2
FROM orders""",
    "fx_tracks": """
SELECT DISTINCT scan_id, sam_object_id,
       concat(CASE sam_object_id % 5 WHEN 0 THEN 'bed' WHEN 1 THEN 'chair' WHEN 2 THEN 'pillow'
              WHEN 3 THEN 'book' ELSE 'door' END, '_', lpad(CAST(sam_object_id AS STRING), 3, '0')) AS track_id,
       CASE sam_object_id % 5 WHEN 0 THEN 'bed' WHEN 1 THEN 'chair' WHEN 2 THEN 'pillow'
              WHEN 3 THEN 'book' ELSE 'door' END AS label,
       0.4e0 + (sam_object_id * 7 % 50) / 100.0e0 AS mean_conf,
       8 * (sam_object_id % 2) AS first_anchor_frame, 8 * (sam_object_id % 2) + 8 AS last_anchor_frame,
       2 AS anchor_count
FROM fx_candidates WHERE sam_object_id <> 7""",
    "fx_anchors": """
SELECT scan_id, sam_object_id, first_anchor_frame AS frame_index, 0 AS ordinal,
       30.0e0 * sam_object_id AS x1, 20.0e0 AS y1, 30.0e0 * sam_object_id + 60 AS x2, 90.0e0 AS y2
FROM fx_tracks
UNION ALL
SELECT scan_id, sam_object_id, last_anchor_frame AS frame_index, 1 AS ordinal,
       30.0e0 * sam_object_id + 4 AS x1, 22.0e0 AS y1, 30.0e0 * sam_object_id + 62 AS x2, 95.0e0 AS y2
FROM fx_tracks""",
    # frames of a video: 100 per scan, thumbnail values derived from the embedding vector
    "fx_video": """
SELECT concat('scan_', CAST(CAST(floor(vec_id / 100.0e0) AS INT) AS STRING)) AS scan_id,
       CAST((vec_id % 100) * 3 AS INT) AS frame_id,
       CAST(50 + vec_id * 37 % 400 AS INT) AS features,
       20.0e0 + (vec_id * 91 % 1000) / 4.0e0 AS sharpness,
       20.0e0 * (1 + vec_id % 7) AS gain, embedding
FROM embeddings""",
    "fx_object_points": """
SELECT scan_id, point_id, label, x, y, z, confidence, support_views FROM (
  SELECT concat('scan_', CAST(CAST(floor(o_custkey / 300.0e0) AS INT) AS STRING)) AS scan_id,
       o_orderkey AS point_id,
       CASE o_orderkey % 5 WHEN 0 THEN 'wall' WHEN 1 THEN 'bed' WHEN 2 THEN 'bed' WHEN 3 THEN 'desk' ELSE 'pillow' END AS label,
       (o_orderkey * 7919 % 1009) / 1009.0e0 * 1.5e0 + 4.0e0 * (o_custkey % 2) AS x,
       (o_orderkey * 104729 % 997) / 997.0e0 * 1.2e0 AS y,
       (o_custkey * 15485863 % 991) / 991.0e0 * 1.5e0 AS z,
       (o_orderkey % 90) / 100.0e0 AS confidence, CAST(o_orderkey % 9 AS INT) AS support_views
  FROM orders) q""",
}

# views whose text differs because generating rows is spelled differently
SPARK_ONLY = {
    "fx_mask_rows": "SELECT *, explode(sequence(y0, y0 + h - 1)) AS y FROM fx_masks",
}
DUCK_ONLY = {
    "fx_mask_rows": "SELECT *, CAST(unnest(range(y0, y0 + h)) AS INT) AS y FROM fx_masks",
}
DEPENDS = {
    "fx_runs": ["fx_masks", "fx_mask_rows"],
    "fx_tracks": ["fx_candidates"],
    "fx_anchors": ["fx_candidates", "fx_tracks"],
}


def with_views(*names: str, sql: str = "", recursive: bool = False) -> str:
    """Oracle text: the named views as CTEs in front of ``sql`` (continue with ', name AS' or SELECT)."""
    ordered: list[str] = []
    for name in names:
        for item in [*DEPENDS.get(name, []), name]:
            if item not in ordered:
                ordered.append(item)
    ctes = ",\n".join(f"{n} AS ({(DUCK_ONLY.get(n) or VIEWS[n]).strip()})" for n in ordered)
    head = "WITH RECURSIVE " if recursive else "WITH "
    body = sql.strip()
    return head + ctes + ("\n" if body.upper().startswith("SELECT") else ",\n") + body


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One fixture view as a DataFrame over the parquet tables of ``sf_dir``."""
    for item in TABLES:
        table_ref = f"FROM {item}"
        if any(table_ref in VIEWS.get(n, "") for n in [name, *DEPENDS.get(name, [])]):
            table(spark, sf_dir, item).createOrReplaceTempView(item)
    for item in [*DEPENDS.get(name, []), name]:
        spark.sql(SPARK_ONLY.get(item) or VIEWS[item]).createOrReplaceTempView(item)
    return spark.table(name)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Camera registry with row-major ``c2w`` and ``w2c`` matrices."""
    c2w = F.expr(
        "array(yaw_c, 0D, yaw_s, cam_x, 0D, 1D, 0D, cam_y, -yaw_s, 0D, yaw_c, cam_z, 0D, 0D, 0D, 1D)"
    )
    base = view(spark, sf_dir, "fx_frames").withColumn("c2w", c2w)
    return base.withColumn("w2c", invert_affine("c2w")).drop("yaw_c", "yaw_s", "cam_x", "cam_y", "cam_z")
