"""Behavioural cases with literal inputs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from splatlake.functions import boxes, camera, text
from splatlake.operators import detections as de, ranking as rk, tracks as tr

DET = "scan_id string, frame_index int, detection_id bigint, label string, prompt_kind string, confidence double, x1 double, y1 double, x2 double, y2 double, width int, height int"


def dets(spark, rows, w=200, h=200):
    return spark.createDataFrame([("s", 0, i, lab, kind, float(c), *map(float, b), w, h) for i, lab, kind, c, b in rows], DET)


def test_iou_literal(spark):
    a, b = (boxes.box(*[F.lit(float(v)) for v in t]) for t in ((0, 0, 10, 10), (5, 5, 15, 15)))
    got = spark.range(1).select(boxes.iou(a, b).alias("v")).first().v
    assert math.isclose(got, 25 / 175)


def test_canonical_label(spark):
    prompts = spark.createDataFrame([(0, "bed", "bed"), (1, "ceiling_fan", "fan")], "ordinal int, prompt string, label string")
    raw = spark.createDataFrame([("ceiling fan",), ("the bed",), ("1",), ("9",), ("fan",), ("unknown thing",)], "raw_label string")
    got = {r.raw_label: r.label for r in de.canonical_label(raw, prompts).collect()}
    assert got == {"ceiling fan": "fan", "the bed": "bed", "1": "fan", "9": None, "fan": "fan", "unknown thing": None}


def test_generic_duplicate(spark):
    d = dets(spark, [(1, "bed", "canonical", .8, (0, 0, 100, 100)), (2, "miscellaneous", "generic_fallback", .8, (20, 20, 40, 40)),
                     (3, "miscellaneous", "named_fallback", .8, (0, 0, 100, 30))])
    got = {r.detection_id: r.suppressed_by for r in de.drop_generic(d).collect()}
    assert got == {1: None, 2: 1, 3: None}


def test_nms_prefers_named(spark):
    d = dets(spark, [(1, "miscellaneous", "named_fallback", .45, (0, 0, 50, 50)), (2, "miscellaneous", "generic_fallback", .92, (0, 0, 50, 50))])
    assert {r.detection_id: r.suppressed_by for r in de.nms(d).collect()} == {1: None, 2: 1}


def test_conflicts(spark):
    rows = [(1, "bed", "canonical", .82, (0, 0, 100, 100)), (2, "blanket", "canonical", .83, (5, 5, 95, 95)),
            (3, "blanket", "canonical", .77, (10, 10, 45, 35)), (4, "curtain", "canonical", .75, (120, 0, 180, 180))]
    got = {r.detection_id: r.conflict_reason for r in de.drop_conflicts(dets(spark, rows)).collect()}
    assert got == {1: None, 2: "blanket_duplicates_bed_extent", 3: None, 4: "curtain_without_window_context"}
    rows.append((5, "window", "canonical", .80, (118, 0, 182, 180)))
    got = {r.detection_id: r.conflict_reason for r in de.drop_conflicts(dets(spark, rows)).collect()}
    assert got[4] is None


def test_uniform_sampling(spark):
    f = spark.range(263).select(F.lit("s").alias("scan_id"), F.col("id").alias("frame_index"))
    got = sorted(r.frame_index for r in rk.uniform_pick(f, ["scan_id"], [F.col("frame_index")], 180).collect())
    assert len(got) == 180 and got[0] == 0 and got[-1] == 262
    assert max(b - a for a, b in zip(got, got[1:])) <= 2


def test_association_names(spark):
    rows = [(0, 1, "bed", .61, (10, 10, 50, 40)), (8, 2, "bed", .61, (12, 10, 52, 40)), (16, 3, "bed", .61, (14, 11, 54, 41)), (8, 4, "chair", .40, (70, 20, 80, 40))]
    d = spark.createDataFrame([("s", f, i, lab, "canonical", c, *map(float, b), 100, 80) for f, i, lab, c, b in rows], DET)
    s = tr.track_summary(tr.associate(d))
    got = {r.label: (r.anchor_count, r.rejection_reason) for r in s.collect()}
    assert got == {"bed": (3, None), "chair": (1, "insufficient_anchor_persistence")}
    named = tr.number_tracks(tr.cap_instances(s).where("rejection_reason IS NULL")).collect()
    assert [(r.track_id, r.sam_object_id) for r in named] == [("bed_001", 1)]


def test_support_gate(spark):
    rows = [("s", f, "bed_001") for f in (0, 1, 2)] + [("s", f, "drawer_004") for f in (0, 1)]
    g = tr.support_gate(spark.createDataFrame(rows, "scan_id string, frame_index int, track_id string")).collect()
    assert sum(r.supported for r in g) == 3 and sum(not r.supported for r in g) == 2


def test_prompt_plan(spark):
    none = spark.createDataFrame([("s", 0, "x", 0.1)], "scan_id string, frame_index int, label string, confidence double")
    ev = de.label_evidence(none, none)
    assert [r.profile for r in de.active_profiles(ev).where("active").collect()] == ["room_details"]
    bed = spark.createDataFrame([("s", 10, "bed", 0.81)], none.schema)
    p = de.active_profiles(de.label_evidence(bed, bed))
    assert {r.profile for r in p.where("active").collect()} == {"room_details", "bedroom"}
    prompts = {r.prompt for r in de.prompt_plan(p).collect()}
    assert {"pillow", "backpack", "headboard"} <= prompts
    assert len(prompts) < de.prompt_records(spark).count()


def test_opencv_and_opengl_agree_on_axis():
    assert camera.affine_text("m", "x", "y", "z")[0].startswith("(m[0] * x")


def test_keys(spark):
    names = ["img_007.png", "a/Frame-12.JPG", "0042", "other.name.png", ".hidden"]
    d = spark.createDataFrame([(n,) for n in names], "n string").select(text.normalize_key(F.col("n")).alias("k"))
    assert [r.k for r in d.collect()] == ["frame_000007", "frame_000012", "frame_000042", "other.name", ".hidden"]


def test_equal_boxes_meet_once(spark):
    """Copies of a box are one row with their number, and sums over all pairs come out of the representatives."""
    boxes_ = [(0, (0, 0, 40, 40)), (8, (5, 5, 45, 45)), (16, (300, 300, 310, 310)), (40, (5, 5, 45, 45))]
    rows = [("s", f, 10 * i + k, "bed", "canonical", .9, *map(float, b), 640, 480) for i, (f, b) in enumerate(boxes_) for k in range(5)]
    d = spark.createDataFrame(rows, DET)
    every = tr.candidate_pairs(d).collect()
    met = tr.candidate_pairs(tr.equal_boxes(d), carry=("members", "id_sum")).collect()
    assert len(met) == len({(r[2] // 10, r[3] // 10) for r in every}) < len(every)
    n = [r.members * r.previous_members for r in met]
    assert sum(n) == len(every)
    assert sum(r.id_sum * r.previous_members for r in met) == sum(r.detection_id for r in every)
    assert sum(k * r.gap for k, r in zip(n, met)) == sum(r.gap for r in every)
    assert math.isclose(sum(k * r.score for k, r in zip(n, met)), sum(r.score for r in every))


@pytest.mark.parametrize("iou", [0.05, 0.3, 0.5, 0.9, 1.0])
def test_overlaps_match_all_pairs(spark, iou):
    """Boxes that reach the threshold share a bucket, whatever their sides, and a box goes into few buckets."""
    rng = random.Random(5)
    rows = []
    for i in range(300):
        x, y, w, h = rng.uniform(-50, 50), rng.uniform(-50, 50), 2 ** rng.uniform(-3, 6), 2 ** rng.uniform(-3, 6)
        for k in range(2):  # a box and one that has nearly its place
            rows.append(("s", i % 3, "bed", 2 * i + k, x + k * rng.uniform(-.3, .3) * w, y, x + w * (1 + k * rng.uniform(-.3, .3)), y + h))
    rows += [("s", 0, "bed", 1000 + k, 16.0, 0.0, 16.0 + 4 ** k, 4.0) for k in range(3)] + [("s", 0, "bed", 1010 + k, 16.0, 0.0, 16.0 + 2 * 4 ** k, 4.0) for k in range(3)]
    rows = [r for r in rows if r[6] > r[4]]
    keys = ["scan_id", "frame_index", "label"]
    d = spark.createDataFrame(rows, "scan_id string, frame_index int, label string, _o bigint, x1 double, y1 double, x2 double, y2 double")
    got = {(r.lo, r.hi) for r in de.overlaps(d, keys, iou).collect()}
    want = set()
    for a in rows:
        for b in rows:
            if a[1] == b[1] and a[3] < b[3]:
                inter = max(0.0, min(a[6], b[6]) - max(a[4], b[4])) * max(0.0, min(a[7], b[7]) - max(a[5], b[5]))
                if inter / ((a[6] - a[4]) * (a[7] - a[5]) + (b[6] - b[4]) * (b[7] - b[5]) - inter) >= iou:
                    want.add((a[3], b[3]))
    assert got == want and (want or iou == 1.0)
