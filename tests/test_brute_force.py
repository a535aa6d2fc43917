"""Operators against plain Python twins on small fixtures, including forced hot-key paths."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from splatlake import config as cfg, fixtures as fx, queries
from splatlake.operators import components as co, containment as ct, detections as de, masks as ma, projection as pj, skew, support as su, tracks as tr, video as vd


@pytest.fixture(scope="module")
def detections(spark, sf):
    return fx.view(spark, sf, "fx_detections")


def test_nms_rounds_follow_chains_not_boxes(spark, monkeypatch):
    """Disjoint boxes of one cell, a chain of three, copies of one box, and rows that take no part."""
    apart = [(k, 10.0 * k, 0.0, 10.0 * k + 8, 8.0) for k in range(40)]
    chain = [(100 + k, 2000.0 + 3 * k, 0.0, 2012.0 + 3 * k, 12.0) for k in range(3)]
    copies = [(200 + k, 3000.0, 0.0, 3010.0, 10.0) for k in range(50)]
    rows = [("s", 1, "chair", "named", 0.9 - i / 1e4, *b) for i, b in enumerate([(b[0], *map(float, b[1:])) for b in apart + chain + copies])]
    rows += [("s", 1, "chair", "named", 0.5, 900, 5.0, 5.0, 5.0, 9.0), ("s", 1, None, "named", 0.5, 901, 0.0, 0.0, 8.0, 8.0)]
    d = spark.createDataFrame(rows, "scan_id string, frame_index int, label string, prompt_kind string, confidence double, detection_id bigint, x1 double, y1 double, x2 double, y2 double")
    rounds = []
    real = de.cut
    monkeypatch.setattr(de, "cut", lambda df: rounds.append(1) or real(df))
    got = {r.detection_id: r.suppressed_by for r in de.nms(d, 0.5).collect()}
    want = {k: None for k in [*range(40), 100, 102, 200, 900, 901]} | {101: 100} | {k: 200 for k in range(201, 250)}
    assert got == want
    assert len(rounds) <= 2 + 2 * 2  # boxes, overlaps, and two rounds of two tables


@pytest.mark.parametrize("threshold", [0.3, cfg.NMS_IOU])
def test_nms_matches_loop(detections, threshold):
    few = detections.where("detection_id < 250")
    crowd = few.withColumns({"frame_index": F.lit(0), "label": F.lit("bed"), "scan_id": F.lit("s")})
    rank = cfg.PROMPT_KIND_RANK
    want, kept = {}, []
    for r in sorted(crowd.collect(), key=lambda r: (-rank.get(r.prompt_kind, 0), -r.confidence, r.detection_id)):
        by = next((k.detection_id for k in kept if iou(k, r) >= threshold), None)
        want[r.detection_id] = by
        if by is None:
            kept.append(r)
    got = {r.detection_id: r.suppressed_by for r in de.nms(crowd, threshold).collect()}
    assert got == want and any(v is not None for v in got.values())


def iou(a, b):
    inter = max(0.0, min(a.x2, b.x2) - max(a.x1, b.x1)) * max(0.0, min(a.y2, b.y2) - max(a.y1, b.y1))
    return inter / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - inter)


@pytest.mark.parametrize("order", ["descending", "shuffled"])
def test_components_of_long_chains(spark, order):
    names = list(range(2000))[::-1]
    if order == "shuffled":
        random.Random(5).shuffle(names)
    v = spark.createDataFrame([("s", n) for n in names], "scan_id string, id bigint")
    e = spark.createDataFrame([("s", a, b) for a, b in zip(names, names[1:]) if names.index(a) % 1000 != 999], "scan_id string, src bigint, dst bigint")
    got = {r.id: r.component for r in co.connected_components(v, e, ["scan_id"]).collect()}
    assert got == {n: min(part) for part in (names[:1000], names[1000:]) for n in part}


def test_voxel_spiral_far_from_the_origin(spark):
    far = 3_000_000
    spiral, x, y, step, left = [], 0, 0, 2, (1, 0)
    for side in range(24):
        for _ in range(step):
            spiral.append((x, y))
            x, y = x + left[0], y + left[1]
        left = (-left[1], left[0])
        step += 2 * (side % 2)
    cells = spark.createDataFrame([("s", far + a, -far + b, 0) for a, b in spiral] + [("s", far + 1_000, 0, 0), ("s", far + 1_001, 1, 1)],
                                  "scan_id string, ci int, cj int, ck int")
    rows = co.voxel_components(cells, ["scan_id"]).collect()
    assert len({r.component for r in rows}) == 2 and len(rows) == len(set(spiral)) + 2


def test_nearest_occupied_on_a_long_corridor(spark):
    cells = spark.createDataFrame([("s", i, 0, 0) for i in range(60)] + [("s", 0, 5, 5)], "scan_id string, ci int, cj int, ck int")
    src = cells.where("ci IN (0, 1, 40)")
    got = {(r.ci, r.cj): (r.dist, r.source.si) for r in co.nearest_occupied(cells, src, ["scan_id"]).collect()}
    want = {(i, 0): min((abs(i - s), s) for s in (0, 1, 40)) for i in range(60)}
    assert {k: v for k, v in got.items() if k[1] == 0} == want and got[(0, 5)] == (0, 0)


def test_pairs_of_the_last_anchor(spark):
    rows = [("s", "bed", f, f, 10.0, 10.0, 60.0, 60.0, 640, 480) for f in (0, 8, 11, 40)]
    d = spark.createDataFrame(rows, "scan_id string, label string, frame_index int, detection_id bigint, x1 double, y1 double, x2 double, y2 double, width int, height int")
    assert {(r.detection_id, r.previous_id) for r in tr.candidate_pairs(d).collect()} == {(8, 0), (11, 8), (11, 0)}


def test_counters_keep_scans_that_start_late(spark):
    from splatlake.streaming import jobs

    d = spark.createDataFrame([("a", f, "bed") for f in range(0, 9008, 8)] + [("b", f, "bed") for f in range(0, 80, 4)], "scan_id string, frame_index int, label string")
    folder = jobs.job_folder(d, "late")
    for scan in ("a", "b"):
        d.where(F.col("scan_id") == scan).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    out = jobs.run_available(jobs.counters(stream), folder, "scan_id string, first_frame int, label string, n bigint", mode="update")
    assert out.where("scan_id = 'b'").groupBy("first_frame").agg(F.max("n").alias("n")).where("n = 2").count() == 10


def test_associate_matches_loop(detections):
    rows = detections.collect()
    expected = {}
    for key in {(r.scan_id, r.label) for r in rows}:
        tracks = []
        mine = sorted((r for r in rows if (r.scan_id, r.label) == key), key=lambda r: (r.frame_index, -r.confidence, r.detection_id))
        for r in mine:
            box = (r.x1, r.y1, r.x2, r.y2)
            scored = [(s, i) for i, t in enumerate(tracks) if 0 < r.frame_index - t[1] <= cfg.MAX_ANCHOR_GAP
                      for s in [tr.pair_score(box, t[2], r.width, r.height)] if s is not None]
            if scored:
                t = tracks[max(scored)[1]]
                t[1], t[2] = r.frame_index, box
            else:
                t = [r.detection_id, r.frame_index, box]
                tracks.append(t)
            expected[r.detection_id] = t[0]
    got = {r.detection_id: r.temp_track for r in tr.associate(detections).collect()}
    assert got == expected


def test_ordered_rank_and_skew_join(spark):
    d = spark.range(5000).select((F.col("id") % 3 == 0).cast("int").alias("k"), F.xxhash64("id").alias("v"), "id")
    got = skew.ordered_rank(d, ["k"], [F.col("v")]).collect()
    for k in (0, 1):
        ordered = sorted((r.v, r.rank) for r in got if r.k == k)
        assert [x for _, x in ordered] == list(range(1, len(ordered) + 1))
    small = spark.createDataFrame([(0, "a"), (1, "b"), (1, "c")], "k int, t string")
    hot = skew.skew_join(d, small, ["k"], ["id"], hot_rows=100)
    assert hot.count() == d.join(small, "k").count() and hot.distinct().count() == hot.count()


def test_dbscan_matches_brute_force(spark):
    rng = random.Random(5)
    pts = [("s", i, rng.gauss(c, .15), rng.gauss(0, .15), rng.gauss(0, .15)) for i, c in enumerate([0] * 150 + [2] * 90 + [5] * 12)]
    pts += [("s", 1000 + i, rng.uniform(-1, 6), rng.uniform(-1, 1), rng.uniform(-1, 1)) for i in range(60)]
    d = spark.createDataFrame(pts, "scan_id string, point_id bigint, x double, y double, z double")
    xyz, ids = np.array([p[2:] for p in pts]), [p[1] for p in pts]
    near = ((xyz[:, None] - xyz[None]) ** 2).sum(2) <= 0.35 ** 2
    core = near.sum(1) >= 30
    label = {}
    for i in np.argsort(ids):
        if core[i] and i not in label:
            todo = [i]
            while todo:
                j = todo.pop()
                if j in label:
                    continue
                label[j] = ids[i]
                if core[j]:
                    todo += [k for k in np.flatnonzero(near[j]) if k not in label]
    got = {r.point_id: r.cluster for r in co.dbscan(d, ["scan_id"]).collect()}
    assert got == {p: label.get(i) for i, p in enumerate(ids)}


def _raster(runs, h, w):
    m = np.zeros((h, w), bool)
    for r in runs:
        m[r.y, r.x0:r.x1] = True
    return m


def _grow(m, r, op):
    pad = np.pad(m, r, constant_values=op is np.min)
    return op([pad[i:i + m.shape[0], j:j + m.shape[1]] for i in range(2 * r + 1) for j in range(2 * r + 1)], axis=0)


def test_close_open_and_components(spark):
    rng = np.random.default_rng(3)
    h, w = 30, 40
    m = rng.random((h, w)) < 0.45
    y, x0, x1 = ma._raster_runs(m)
    runs = spark.createDataFrame([("s", 0, 1, int(a), int(b), int(c)) for a, b, c in zip(y, x0, x1)], "scan_id string, frame_index int, mask_id int, y int, x0 int, x1 int")
    key = ["scan_id", "frame_index", "mask_id"]
    got = _raster(ma.close_open(runs, runs, key, w, h, 5, 3).collect(), h, w)
    want = _grow(_grow(_grow(_grow(m, 2, np.max), 2, np.min), 1, np.min), 1, np.max)
    assert (got == want).all()
    clean = ma.clean_components(runs, key, w, h).collect()
    seen, comps = np.zeros_like(m), []
    for a, b in zip(*np.nonzero(m)):
        if not seen[a, b]:
            todo, comp = [(a, b)], []
            seen[a, b] = True
            while todo:
                p = todo.pop()
                comp.append(p)
                for q in [(p[0] + i, p[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                    if 0 <= q[0] < h and 0 <= q[1] < w and m[q] and not seen[q]:
                        seen[q] = True
                        todo.append(q)
            comps.append(comp)
    assert clean[0].component_count == len(comps)
    out = _raster(clean, h, w)
    assert out.sum() == sum(r.x1 - r.x0 for r in clean)
    biggest = max(comps, key=len)
    assert all(out[p] for p in biggest)


def test_owned_pixels_are_disjoint(spark, sf):
    from splatlake.queries.masks import _owned

    rows = [r for r in _owned(spark, sf).collect() if r.y is not None]
    seen = set()
    for r in rows:
        for x in range(r.x0, r.x1):
            p = (r.scan_id, r.frame_index, r.y, x)
            assert p not in seen
            seen.add(p)
    assert rows


def test_projection_cells_lose_nothing(spark, sf):
    pts = fx.view(spark, sf, "fx_points").select("scan_id", "point_id", "x", "y", "z")
    f = fx.frames(spark, sf)
    wide = pj.project_points(pts, f, cell=50.0).select("frame_index", "point_id", "u", "v")
    narrow = pj.project_points(pts, f, cell=0.5).select("frame_index", "point_id", "u", "v")
    assert wide.count() == narrow.count() and wide.exceptAll(narrow).isEmpty()


def test_mutual_matches():
    import pandas as pd

    a = [[[0, 0, 0, 0], [2 ** 60, 0, 0, 1], [-1, -1, -1, -1]]]
    b = [[[0, 0, 0, 1], [-1, -1, -1, -2]]]
    assert vd.mutual_matches(pd.Series(a), pd.Series(b)).tolist() == [2]


def test_max_scale_is_inside(spark):
    g = spark.createDataFrame([("s", 1, 0.0, 0.0, 0.0, [0.2, 0.2, 0.2], [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0])],
                              "scan_id string, point_id bigint, x double, y double, z double, sigma array<double>, rot array<double>")
    occ = spark.createDataFrame([("s", i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)], "scan_id string, ci int, cj int, ck int")
    s = ct.max_inside_scale(g, occ, 0.1).first().max_scale
    assert 0.3 < s < 0.4  # 2 sigma * s must stay within 1.5 voxels


def test_streams_equal_batch(spark):
    queries.load()
    sf = "/root/testdata/sf0.001"
    for batch, stream in (("t1_continuity_frames", "t1_continuity_stream"), ("j10_associate", "t2_associate_stream")):
        a, b = queries.QUERIES[batch](spark, sf), queries.QUERIES[stream](spark, sf)
        cols = sorted(a.columns)
        assert sorted(map(tuple, a.select(cols).collect())) == sorted(map(tuple, b.select(cols).collect())), batch


def test_robust_plane(spark):
    from splatlake.operators import cleanup as cu

    rng = np.random.default_rng(8)
    flat = np.column_stack([rng.random((80, 2)) * 2, 0.3 + 0.002 * rng.standard_normal(80)])
    cloud = np.concatenate([flat, rng.random((25, 3)) * 2])
    seeds = spark.createDataFrame([("s", i, *map(float, r)) for i, r in enumerate(cloud)] + [("t", i, float(i), 0.0, 0.0) for i in range(5)], "scan_id string, seed_id bigint, x double, y double, z double")
    points = seeds.withColumnRenamed("seed_id", "point_id").withColumn("sigma", F.lit(0.001))
    spacing = spark.createDataFrame([("s", 0.01), ("t", 0.01)], "scan_id string, spacing double")
    keep, plane = cu.robust_plane(points, seeds, spacing, ["scan_id"])
    best, top = None, 0
    for t in cu.triples(len(cloud)):
        a, b, c = cloud[t]
        n = np.cross(b - a, c - a)
        n /= np.linalg.norm(n)
        hit = np.abs((cloud - a) @ n) <= 0.025
        if hit.sum() > top:
            best, top = hit, hit.sum()
    mine = cloud[best]
    n = np.linalg.svd(mine - mine.mean(axis=0))[2][-1]
    want = np.abs((cloud - mine.mean(axis=0)) @ n) <= 0.025 + 0.003
    got = {r.point_id: r.keep for r in keep.where("scan_id = 's'").collect()}
    assert [got[i] for i in range(len(cloud))] == want.tolist()
    assert plane.collect()[0].sparse_inliers == top and keep.where("scan_id = 't' AND keep").count() == 5


def test_pick_calibration(spark):
    from splatlake.operators import cleanup as cu

    rows = [("s", 0, 0, 1.0, 30, 0.3, "depth_alignment_residual_too_large"), ("s", 0, 1, 1.1, 30, 0.2, "ok"), ("s", 1, 0, 1.0, 30, 0.1, "ok"), ("s", 1, 1, 1.0, 30, 0.1, "ok")]
    t = spark.createDataFrame(rows, "scan_id string, frame_index int, trial int, scale double, overlap_pixels bigint, median_relative_error double, reason string")
    assert {(r.frame_index, r.trial) for r in cu.pick_calibration(t, ["scan_id", "frame_index"]).collect()} == {(0, 1), (1, 0)}


def test_largest_inside_scale_takes_every_point(spark, sf):
    from splatlake import queries

    queries.load()
    got = queries.QUERIES["g7_max_inside_scale"](spark, sf)  # the points that stick out
    assert {r.third for r in got.selectExpr("point_id % 3 AS third").distinct().collect()} == {0, 1, 2}


def probe_twin(centre, sigma, rot, cells, voxel, factor):
    """Are all probes of one ellipsoid inside?  One probe after the other."""
    for d in ct.ellipsoid_probes():
        at = [centre[r] + sum(rot[3 * r + c] * sigma[c] * 2.0 * factor * d[c] for c in range(3)) for r in range(3)]
        if tuple(int(np.rint(v / voxel)) for v in at) not in cells:
            return False
    return True


def test_extents_are_capped_shrunk_and_snapped(spark):
    rng, voxel = np.random.default_rng(5), 0.1
    cells = {tuple(c) for c in rng.integers(-9, 10, (5000, 3)).tolist()} | {(i, j, k) for i in range(-4, 3) for j in range(-4, 3) for k in range(-4, 3)}
    rows = []
    for k in range(400):
        q = rng.normal(size=4)
        w, x, y, z = q / np.linalg.norm(q)
        rot = [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), 2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
               2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]
        rows.append(("s", k, *rng.uniform(-0.95, 0.95, 3).tolist(), rng.choice([0.002, 0.02, 0.1, 0.6], 3).tolist(), [float(v) for v in rot]))
    schema = "scan_id string, point_id bigint, x double, y double, z double, sigma array<double>, rot array<double>"
    g = spark.createDataFrame(rows + [("empty", 0, *rows[0][2:])], schema)
    occ = spark.createDataFrame([("s", *c) for c in cells] + [("s", 0, 0, 0)], "scan_id string, ci int, cj int, ck int")
    whole = {r.point_id: r for r in ct.ellipsoid_inside(g, occ, voxel).collect()}
    got = {r.point_id: r for r in ct.constrain_extents(g, occ, voxel).collect()}
    assert len(whole) == len(got) == len(rows)
    seen = set()
    for _, k, x, y, z, sigma, rot in rows:
        centre, r = (x, y, z), got[k]
        home = tuple(int(np.rint(v / voxel)) for v in centre) in cells
        assert whole[k].center_inside == r.center_inside == home
        assert whole[k].all_inside == probe_twin(centre, sigma, rot, cells, voxel, 1.0)
        capped = [min(s, 1.25 * voxel) for s in sigma]
        assert r.shrunk == (not probe_twin(centre, capped, rot, cells, voxel, 1.0))
        assert np.allclose(r.sigma, [s * r.factor for s in capped])
        assert np.allclose((r.x, r.y, r.z), [np.rint(v / voxel) * voxel for v in centre] if r.snapped else centre)
        if not r.shrunk:
            assert r.factor == 1.0 and not r.snapped
        elif r.factor > 1e-4:
            assert probe_twin((r.x, r.y, r.z), capped, rot, cells, voxel, r.factor)
        elif not home:
            assert not r.snapped and r.factor == 1e-4
        seen.add((r.shrunk, r.snapped, home))
    assert {(False, False, True), (True, False, True), (True, True, True), (True, False, False)} <= seen


def test_support_gate_after_overlap(spark):
    """Two published frames go, their label becomes unknown unless another instance of it is left in the frame."""
    def rec(scan, frame, track, label, role="tracked_object", accepted=True, state="visible"):
        return scan, frame, track, label, role, accepted, state

    rows = [rec("a", f, "bed_001", "bed") for f in range(3)] + [rec("a", f, "drawer_004", "Drawer") for f in range(2)]
    rows += [rec("a", 1, "drawer_005", "drawer"), rec("a", 2, "drawer_005", "drawer"), rec("a", 3, "drawer_005", "drawer")]
    rows += [rec("a", 0, "drawer_004", "drawer", accepted=False), rec("a", 5, "wall_001", "wall", role="structure"), rec("a", 5, None, "wall"), rec("a", 5, "", "wall")]
    rows += [rec("b", f, "bed_001", "bed") for f in range(2)]
    records = spark.createDataFrame(rows, "scan_id string, frame_index int, track_id string, label string, role string, accepted boolean, state string")
    states = spark.createDataFrame([("a", 0, "drawer", "visible", "x"), ("a", 1, "drawer", "visible", "x"), ("a", 0, "bed", "visible", "x"), ("b", 0, "bed", "visible", "x")],
                                   "scan_id string, frame_index int, label string, state string, reason string")
    marked, rewritten, suppressed = tr.suppress_after_overlap(records, states)
    assert marked.count() == len(rows)
    assert sorted((r.scan_id, r.frame_index, r.track_id) for r in marked.where("rejection_reasons IS NOT NULL").collect()) == [
        ("a", 0, "drawer_004"), ("a", 0, "drawer_004"), ("a", 1, "drawer_004"), ("b", 0, "bed_001"), ("b", 1, "bed_001")]
    assert {(r.scan_id, r.frame_index, r.label): r.state for r in rewritten.collect()} == {
        ("a", 0, "drawer"): "unknown", ("a", 1, "drawer"): "visible", ("a", 0, "bed"): "visible", ("b", 0, "bed"): "unknown", ("b", 1, "bed"): "unknown"}
    assert sorted((r.scan_id, r.track_id, r.published_visible_frames, r.removed_mask_count) for r in suppressed.collect()) == [("a", "drawer_004", 2, 3), ("b", "bed_001", 2, 2)]
    assert tr.suppress_after_overlap(records.limit(0), states)[1].count() == 4
