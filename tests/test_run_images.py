"""Run algebra over batches of images against rasters, and what its queries shuffle."""

import numpy as np
import pytest

from splatlake.operators import masks as ma, run_images as ri
from tests.test_brute_force import _grow, _raster

W, H, KEY = 40, 30, ["scan_id", "frame_index", "mask_id"]
SCHEMA = "scan_id string, frame_index int, mask_id bigint, y int, x0 int, x1 int"


@pytest.fixture(scope="module")
def drawn(spark):
    rng = np.random.default_rng(7)
    images = {(s, f, m): rng.random((H, W)) < rng.uniform(0.2, 0.8) for s in ("a", None) for f in (0, 1) for m in range(3)}
    rows = [(*k, int(a), int(b), int(c)) for k, m in images.items() for a, b, c in zip(*ma._raster_runs(m))]
    rows += [("a", 0, 0, 3, 9, 9)]  # a run without pixels
    return images, spark.createDataFrame(rows, SCHEMA).persist()


def _by_mask(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.scan_id, r.frame_index, r.mask_id), []).append(r)
    return out


@pytest.mark.parametrize("batch", [50, 100_000])
def test_shapes_of_many_images(drawn, monkeypatch, batch):
    monkeypatch.setattr(ri, "BATCH_RUNS", batch)  # an image is longer than a small batch
    images, runs = drawn
    grown, eroded = _by_mask(ma.dilate(runs, KEY, 2, W, H)), _by_mask(ma.erode(runs, runs, KEY, 1, W, H))
    both = _by_mask(ma.close_open(runs, runs, KEY, W, H, 5, 3))
    for k, m in images.items():
        assert (_raster(grown.get(k, []), H, W) == _grow(m, 2, np.max)).all()
        assert (_raster(eroded.get(k, []), H, W) == _grow(m, 1, np.min)).all()
        want = _grow(_grow(_grow(_grow(m, 2, np.max), 2, np.min), 1, np.min), 1, np.max)
        assert (_raster(both.get(k, []), H, W) == want).all()


def _one_shuffle(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1


def test_runs_are_shuffled_once(drawn):
    _, runs = drawn
    assert _one_shuffle(ma.close_open(runs, runs, KEY, W, H))
    assert _one_shuffle(ma.erode(runs, runs, KEY, 1, W, H))
    assert _one_shuffle(ma.clean_components(runs, KEY, W, H))


def test_masks_and_frames_come_in_batches(drawn):
    """Not one call per mask or frame, which costs milliseconds each."""
    _, runs = drawn
    places = runs.selectExpr(*KEY, "double(mask_id % 2) AS rank_score", "mask_id AS ordinal").distinct()
    for df in (ma.clean_components(runs, KEY, W, H), ma.own_pixels(places, runs, W, H)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroupsInPandas" not in plan and "MapInArrow" in plan


def test_owned_pixels_follow_the_rank(drawn):
    images, runs = drawn
    places = runs.selectExpr(*KEY, "double(mask_id % 2) AS rank_score", "mask_id AS ordinal").distinct()
    got = _by_mask(ma.own_pixels(places, runs, W, H))
    assert set(got) == set(images)
    for s in ("a", None):
        for f in (0, 1):
            taken = np.zeros((H, W), dtype=bool)
            for m in (1, 0, 2):
                rows, pixels = got[s, f, m], images[s, f, m]
                left = (pixels & ~taken).sum() / pixels.sum()
                assert abs(rows[0].remaining_after_overlap - left) < 1e-12
                if left < 0.35:
                    assert [r.rejection_reason for r in rows] == ["overlap_dominated"] and rows[0].y is None
                    continue
                mine = _raster(rows, H, W)
                assert not (mine & taken & pixels).any() and rows[0].rejection_reason is None
                taken |= mine


def test_depth_is_read_from_images(spark):
    """A row is not repeated for each pixel of its window; the first of equal differences wins."""
    from splatlake.operators import projection as pj

    points = spark.createDataFrame([("s", f, p, (p * 7) % 20, (p * 3) % 12, 1.0 + p % 5, 20, 12) for f in (0, 1, 2) for p in range(60)],
                                   "scan_id string, frame_index int, point_id long, u int, v int, depth double, width int, height int")
    pixels = {(f, v, u): 1.0 + (v * 3 + u) % 6 / 2 for f in (0, 1) for v in range(6) for u in range(10) if (v + u) % 4}
    depth = spark.createDataFrame([("s", f, v, u, z) for (f, v, u), z in pixels.items()], "scan_id string, frame_index int, v int, u int, z double")
    out = pj.depth_match(points, depth, (10, 6))
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    rows = out.collect()
    assert len(rows) == 180
    for r in rows:
        window = [(max(0, min(5, r.v // 2 + a)), max(0, min(9, r.u // 2 + b))) for a in (-1, 0, 1) for b in (-1, 0, 1)]
        found = [(abs(r.depth - pixels[r.frame_index, v, u]), i, pixels[r.frame_index, v, u]) for i, (v, u) in enumerate(window) if (r.frame_index, v, u) in pixels]
        assert (r.depth_delta, r.depth_ref) == ((min(found)[0], min(found)[2]) if found else (None, None))
