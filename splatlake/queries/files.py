"""Scene files written from the fixture views and read back through the sources."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, functions as F

from splatlake import fixtures as fx
from splatlake.operators import objects as ob
from splatlake.queries import query
from splatlake.session import checkpoint_dir
from splatlake.sources import scene


def _folder(spark, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def _json(rows: DataFrame, by: list[str], name: str) -> str:
    """One JSON document per group as a partitioned folder of text files, written by all tasks."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    folder = _folder(rows.sparkSession, name)
    body = [c for c in rows.columns if c not in by]
    value = F.col("documents") if body == ["documents"] else F.struct(*body)
    rows.select(*by, F.to_json(value).alias("value")).repartition(tasks, *by).write.option("maxRecordsPerFile", 1).partitionBy(*by).text(folder)
    return folder


def _registry(spark, sf) -> str:
    m = "array(array(yaw_c, 0D, yaw_s, cam_x), array(0D, 1D, 0D, cam_y), array(-yaw_s, 0D, yaw_c, cam_z), array(0D, 0D, 0D, 1D))"
    f = fx.view(spark, sf, "fx_frames").withColumn("f", F.expr(f"named_struct('file_path', concat('images/', frame_key, '.png'), 'transform_matrix', CASE WHEN frame_index = 9 THEN slice({m}, 1, 3) ELSE {m} END)"))
    g = f.groupBy("scan_id").agg(F.sort_array(F.collect_list(F.struct("frame_index", "f"))).alias("s"), *[F.first(c).alias(c) for c in ("width", "height", "fx", "fy", "cx", "cy")])
    g = g.select("scan_id", F.col("width").alias("w"), F.col("height").alias("h"), F.col("fx").alias("fl_x"), F.col("fy").alias("fl_y"), "cx", "cy", F.col("s.f").alias("frames"))
    return _json(g, ["scan_id"], "registry")


@query("s1_read_frames", fx.with_views("fx_frames", sql="""
SELECT scan_id, CAST(row_number() OVER (PARTITION BY scan_id ORDER BY frame_index) - 1 AS INT) AS frame_index, frame_key, width, fx, cy,
  CASE WHEN frame_index <> 9 THEN -(yaw_c*cam_x - yaw_s*cam_z) END AS w2c_x, cam_z AS c2w_z FROM fx_frames QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY frame_index) <= 15"""))
def s1(spark, sf):
    f = scene.read_frames(spark, _registry(spark, sf), max_frames=15)
    inverse = F.when(F.size("c2w") == 16, F.get("w2c", F.lit(3)))
    return f.select("scan_id", "frame_index", "frame_key", "width", "fx", "cy", inverse.alias("w2c_x"), F.get("c2w", F.lit(11)).alias("c2w_z"))


@query("s2_read_frames_tolerant", fx.with_views("fx_frames", sql="""
SELECT scan_id, frame_key, 'kept' AS found FROM fx_frames WHERE (frame_index + ascii(right(scan_id, 1))) % 6 <> 5 AND frame_index <> 9 UNION ALL SELECT scan_id, frame_key, 'missing' FROM fx_frames WHERE (frame_index + ascii(right(scan_id, 1))) % 6 = 5"""))
def s2(spark, sf):
    files = fx.view(spark, sf, "fx_frames").where("(frame_index + ascii(right(scan_id, 1))) % 6 <> 5").select("scan_id", F.concat("frame_key", F.lit(".png")).alias("name"))
    kept, missing = scene.read_frames_tolerant(spark, _registry(spark, sf), files)
    return kept.select("scan_id", "frame_key", F.lit("kept").alias("found")).unionByName(missing.select("scan_id", "frame_key", F.lit("missing").alias("found")))


def _detections(spark, sf) -> tuple[str, DataFrame]:
    m = fx.view(spark, sf, "fx_masks").withColumns({
        "path": F.concat(F.lit("m/"), F.col("mask_id").cast("string"), F.lit(".png")), "frame_key": F.format_string("frame_%06d", "frame_index")})
    small = F.collect_list(F.when(~F.col("label").isin("wall", "floor"), F.struct("mask_id", F.col("label").alias("class_name"), F.col("score").cast("string").alias("confidence"), F.col("path").alias("mask_path"))))
    wide = F.collect_list(F.when(F.col("label").isin("wall", "floor"), F.struct("mask_id", "label", F.col("path").alias("mask_path"))))
    d = m.groupBy("scan_id", "frame_key").agg(F.sort_array(small).alias("objects"), F.sort_array(wide).alias("layout"))
    d = d.select("scan_id", F.concat(F.lit("x/"), "frame_key", F.lit(".jpg")).alias("image_path"), "objects", "layout",
                 F.lit("tracked_semantic_frame.v2").alias("schema"), F.lit("s").alias("segmentation_fingerprint"), F.lit("l").alias("layout_fingerprint"))
    aliases = scene.frame_aliases(fx.view(spark, sf, "fx_frames").withColumn("image_path", F.col("frame_key")))
    # a scan's frames are one file, an array of their documents: a file of its own costs a frame more than its masks
    body = F.struct(*[c for c in d.columns if c != "scan_id"])
    return _json(d.groupBy("scan_id").agg(F.sort_array(F.collect_list(body)).alias("documents")), ["scan_id"], "detections"), aliases


DETECTED = fx.with_views("fx_masks", "fx_frames", sql="""
SELECT m.scan_id, f.frame_key, m.label, CASE WHEN m.label IN ('wall', 'floor') THEN 1e0 ELSE round(m.score, 6) END AS score,
  CASE WHEN m.label IN ('wall', 'floor') THEN 'structural' ELSE 'small' END AS role, concat('m/', CAST(m.mask_id AS STRING), '.png') AS mask_path
FROM fx_masks m JOIN fx_frames f ON m.scan_id = f.scan_id AND m.frame_index = f.frame_index""")


@query("s4_read_detections", DETECTED)
def s4(spark, sf):
    path, aliases = _detections(spark, sf)
    return scene.read_detections(spark, path, None, aliases, packed=True).select("scan_id", "frame_key", "label", F.round("score", 6).alias("score"), "role", "mask_path")


@query("s5_read_detections_strict", DETECTED)
def s5(spark, sf):
    path, aliases = _detections(spark, sf)
    return scene.read_detections_strict(spark, path, aliases, packed=True).select("scan_id", "frame_key", "label", F.round("score", 6).alias("score"), "role", "mask_path")


@query("s6_masks_from_filenames", fx.with_views("fx_masks", sql="""
m AS (SELECT DISTINCT scan_id, frame_index, concat('frame_', lpad(CAST(frame_index AS STRING), 6, '0')) AS k, mask_id FROM fx_masks WHERE label = 'bed')
SELECT scan_id, CASE WHEN (frame_index + ascii(right(scan_id, 1))) % 2 = 0 THEN concat(k, '_x') ELSE k END AS frame_key, concat('/m/', k, '_x_bed_', CAST(mask_id AS STRING), '.png') AS path FROM m"""))
def s6(spark, sf):
    m = fx.view(spark, sf, "fx_masks")
    key = F.format_string("frame_%06d_x", "frame_index")
    frames = m.where("(frame_index + ascii(right(scan_id, 1))) % 2 = 0").select("scan_id", key.alias("frame_key"))  # each scan has other frames
    name = F.format_string("frame_%06d_x_%s_%d.png", "frame_index", "label", "mask_id")
    files = m.select("scan_id", F.concat(F.lit("/m/"), name).alias("path"), name.alias("name"))
    return scene.masks_from_filenames(files, frames, "bed")


@query("s14_manifest", """
SELECT o_orderkey AS id, o_orderpriority AS kind, o_totalprice AS price FROM orders""")
def s14(spark, sf):
    o = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("kind"), F.col("o_totalprice").alias("price"))
    path = _folder(spark, "manifest")
    scene.write_manifest(o, path)
    return spark.read.schema(o.schema).json(path)


@query("e2_run_summary", fx.with_views("fx_object_points", "fx_frames", sql="""
p AS (SELECT scan_id, count(*) FILTER (point_id % 4 <> 0) AS labeled_points, count(*) FILTER (point_id % 4 = 0) AS unlabeled_points,
  count(DISTINCT label) FILTER (point_id % 4 <> 0) AS labels FROM fx_object_points GROUP BY scan_id),
f AS (SELECT scan_id, count(*) FILTER (frame_index % 3 = 0) AS skipped, count(*) FILTER (frame_index % 3 <> 0) AS used FROM fx_frames GROUP BY scan_id)
SELECT p.*, f.skipped AS frames_skipped, f.used AS frames_used FROM p LEFT JOIN f USING (scan_id)"""))
def e2(spark, sf):
    labels = fx.view(spark, sf, "fx_object_points").select("scan_id", F.when(F.col("point_id") % 4 != 0, F.col("label")).alias("final_label"))
    frames = fx.view(spark, sf, "fx_frames").select("scan_id", F.when(F.col("frame_index") % 3 == 0, "skipped").otherwise("used").alias("status"))
    s = ob.run_summary(labels, frames)
    return s.select("scan_id", "labeled_points", "unlabeled_points", "labels", *[F.col("frames_by_status")[k].alias(f"frames_{k}") for k in ("skipped", "used")])
