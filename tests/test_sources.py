"""Files in, files out."""

import json

import pytest
from pyspark.sql import functions as F

from splatlake.sources import ply, scene


def test_ply_ascii_and_split(spark, tmp_path):
    ply.register(spark)
    p = tmp_path / "a.ply"
    p.write_text("ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nend_header\n1 2 3 255\n4 5 6 0\n")
    rows = spark.read.format("ply").load(str(p)).orderBy("point_id").collect()
    assert [(r.point_id, r.x, r.red) for r in rows] == [(0, 1.0, 255), (1, 4.0, 0)]


def test_camera_and_detection_scan(spark, tmp_path):
    eye = [[1, 0, 0, 1.0], [0, 1, 0, 2.0], [0, 0, 1, 3.0], [0, 0, 0, 1]]
    (tmp_path / "t.json").write_text(json.dumps({"w": 640, "h": 480, "camera_angle_x": 0.9, "frames": [
        {"file_path": f"images/frame_{i:05d}.png", "transform_matrix": eye} for i in range(3)]}))
    f = scene.read_frames(spark, str(tmp_path / "t.json"), "s")
    r = f.orderBy("frame_index").collect()
    assert [x.frame_key for x in r] == ["frame_00000", "frame_00001", "frame_00002"]
    assert r[0].w2c[3] == -1.0 and abs(r[0].fx - 320 / 0.4830550656) < 1e-3 and r[0].cx == 320.0
    d = tmp_path / "det"
    d.mkdir()
    (d / "frame_00001.json").write_text(json.dumps({"image_path": "x/frame_1.png", "detections": [{"class_name": "Picture Frame", "score": "0.7", "mask_path": "m.png"}],
                                                    "planes": [{"label": "wall", "mask_path": "w.png"}]}))
    (d / "broken.json").write_text("{")
    got = {x.label: (x.frame_key, x.score, x.role) for x in scene.read_detections(spark, str(d), "s", scene.frame_aliases(f)).collect()}
    assert got == {"picture_frame": ("frame_00001", 0.7, "small"), "wall": ("frame_00001", 1.0, "structural")}


def test_filename_masks(spark):
    names = [("a", "frame_01_bed.png"), ("a", "frame_01_embedded.png"), ("a", "view_bed_2.png"), ("b", "view_bed_2.png"), ("b", "frame_01_bed.png")]
    files = spark.createDataFrame([(s, f"/{s}/{n}", n) for s, n in names], "scan_id string, path string, name string")
    frames = spark.createDataFrame([("a", "frame_01"), ("a", "view"), ("b", "frame_02")], "scan_id string, frame_key string")
    got = {(r.scan_id, r.path): r.frame_key for r in scene.masks_from_filenames(files, frames, "bed").collect()}
    # scan b knows no frame of that name: only the numbered name can be told from the file
    assert got == {("a", "/a/frame_01_bed.png"): "frame_01", ("a", "/a/view_bed_2.png"): "view", ("b", "/b/frame_01_bed.png"): "frame_01"}


def test_missing_images_are_told_by_scan(spark, tmp_path):
    matrix = [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]]
    for scan in "ab":
        (tmp_path / scan).mkdir()
        frames = [{"file_path": f"images/f{k}.png", "transform_matrix": matrix} for k in range(2)]
        (tmp_path / scan / "transforms.json").write_text(json.dumps({"w": 640, "h": 480, "camera_angle_x": 0.9, "frames": frames}))
    files = spark.createDataFrame([("a", "f0.png"), ("b", "f1.png")], "scan_id string, name string")
    kept, missing = scene.read_frames_tolerant(spark, str(tmp_path / "*/transforms.json"), files)
    assert sorted((r.scan_id, r.frame_key) for r in kept.collect()) == [("a", "f0"), ("b", "f1")]
    assert sorted((r.scan_id, r.frame_key) for r in missing.collect()) == [("a", "f1"), ("b", "f0")]


def test_manifest_and_listing(spark, tmp_path):
    scene.write_manifest(spark.range(3).select("id", F.lit("a").alias("k")), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 3
    assert scene.listing(spark, str(tmp_path / "m"), "part-*").count() >= 1


def test_ply_is_written_per_scan_in_order(spark, tmp_path):
    rows = spark.createDataFrame([("b", i, float(i), 0.0, 1.0, 1, 2, 3) for i in range(50)] + [("a", 7, 5.0, 5.0, 5.0, 0, 0, 0)],
                                 "scan_id string, point_id bigint, x double, y double, z double, r int, g int, b int").orderBy(F.col("x").desc())
    ply.write_points(rows, f"file:{tmp_path}/out")
    names = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert [n[0] for n in names] == ["a", "b"] and not any(n.startswith(".") for n in names)
    back = spark.read.format("ply").load(f"file://{tmp_path}/out").where("file LIKE 'b%'").orderBy("point_id").collect()
    assert [r.x for r in back] == [float(i) for i in range(50)] and back[0].red == 1
    assert not ply.read_header(str(tmp_path / "out" / names[0])).is_gaussian


def test_labeled_skips_incomplete_scans(spark):
    g = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.5), ("b", 1, 0.5)], "scan_id string, point_id bigint, x double")
    n = spark.createDataFrame([("a", 1, 1, 0.5, 2), ("b", 1, 2, 0.5, 2)], "scan_id string, point_id bigint, semantic_label_id int, semantic_confidence double, semantic_support_views int")
    assert [(r.scan_id, r.semantic_label_id) for r in ply.labeled(g, n).collect()] == [("b", 2)]


def _packed(folder, **of_second):
    for scan in "ab":
        (folder / f"scan_id={scan}").mkdir(parents=True)
        docs = [{"image_path": f"x/frame_{i:05d}.png", "schema": "tracked_semantic_frame.v2", "segmentation_fingerprint": "s", "layout_fingerprint": "l",
                 "objects": [{"label": "bed", "score": "0.5", "mask_path": f"{scan}{i}.png"}]} for i in range(2)]
        docs[1] |= of_second
        (folder / f"scan_id={scan}" / "all.json").write_text(json.dumps(docs))


def test_frames_of_one_file(spark, tmp_path):
    _packed(tmp_path / "d")
    aliases = spark.createDataFrame([(s, f"frame_{i:05d}") for s in "ab" for i in range(2)], "scan_id string, frame_key string").withColumn("image_path", F.col("frame_key"))
    aliases = scene.frame_aliases(aliases)
    want = [(s, f"frame_{i:05d}", f"frame_{i:05d}_000_bed", f"{s}{i}.png") for s in "ab" for i in range(2)]
    for d in (scene.read_detections(spark, str(tmp_path / "d"), None, aliases, packed=True), scene.read_detections_strict(spark, str(tmp_path / "d"), aliases, packed=True)):
        assert sorted((r.scan_id, r.frame_key, r.mask_id, r.mask_path) for r in d.collect()) == want


def test_strict_reads_files_once(spark, tmp_path):
    aliases = spark.createDataFrame([("a", "frame_00000", "frame_00000")], "scan_id string, alias string, frame_key string")
    _packed(tmp_path / "d")
    plan = scene.read_detections_strict(spark, str(tmp_path / "d"), aliases, packed=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan json") == 1
    for i, second in enumerate(({"schema": "v1"}, {"segmentation_fingerprint": "t"}, {"layout_fingerprint": "t"}, {"schema": None})):
        _packed(tmp_path / f"bad{i}", **second)
        with pytest.raises(Exception, match="mixed or unsupported detection files"):
            scene.read_detections_strict(spark, str(tmp_path / f"bad{i}"), aliases, packed=True).collect()
