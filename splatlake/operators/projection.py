"""Points seen by cameras: frustum join, z-buffer, depth and visibility tests."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from splatlake import config as cfg
from splatlake.functions import camera
from splatlake.operators.run_images import by_image
from splatlake.operators.skew import skew_join, spread_join

CELL_M = 2.5  # edge of a world cell: a 20 m frustum covers a few hundred of them
TILE_PX = 64  # horizontal image tile that keeps run lookups short
IMAGE_CELLS = 4_000_000  # pixels of depth images that a task makes at once


def frustum_cells(frames: DataFrame, occupied: DataFrame, far: float, near: float, cell: float = CELL_M,
                  convention="opengl") -> DataFrame:
    """World cells that each camera's frustum may touch, inside the scan's occupied cell range.

    Cells come from the bounding box of the frustum corners, cut to ``occupied`` (one row of cell
    ranges per scan), and are then tested against the six planes with the cell's bounding sphere.
    """
    sign = -1.0 if convention == "opengl" else 1.0
    # few, small camera rows fan out to many cells: spread them over all tasks first
    tasks = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    frames = frames.join(occupied, "scan_id").repartition(tasks, "scan_id", "frame_index")
    corners = [("c2w[3]", "c2w[7]", "c2w[11]")] + [
        camera.affine_text("c2w", f"(({u} - cx) / fx * {far}D)", f"(({v} - cy) / fy * {far * sign}D)", f"({far * sign}D)")
        for u in ("0", "width") for v in ("0", "height")
    ]
    out = frames
    for axis, name in enumerate(("cell_x", "cell_y", "cell_z")):
        values = ", ".join(c[axis] for c in corners)
        lo = f"greatest(int(floor(least({values}) / {cell}D)), _lo_{name})"
        hi = f"least(int(floor(greatest({values}) / {cell}D)), _hi_{name})"
        cells = f"explode(CASE WHEN {lo} <= {hi} THEN sequence({lo}, {hi}) END)"
        out = out.withColumn(name, F.expr(cells)).drop(f"_lo_{name}", f"_hi_{name}")
    centre = [f"((cell_{a} + 0.5D) * {cell}D)" for a in "xyz"]
    x, y, z = camera.affine_text("w2c", *centre)
    d, py = f"({z} * {sign}D)", f"({y} * {sign}D)"
    radius = cell * (3.0 ** 0.5) / 2 * 1.001

    def plane(f, p, off):
        return f"(({f} * {p} + ({off}) * {d}) / sqrt({f} * {f} + ({off}) * ({off})))"

    return out.where(
        f"{d} > {near - radius}D AND {d} < {far + radius}D "
        f"AND {plane('fx', x, 'cx')} >= {-radius}D AND {plane('fx', x, 'cx - width')} <= {radius}D "
        f"AND {plane('fy', py, 'cy')} >= {-radius}D AND {plane('fy', py, 'cy - height')} <= {radius}D"
    )


def project_points(points: DataFrame, frames: DataFrame, near: float = cfg.NEAR_M, far: float = cfg.FAR_M,
                   convention: str = "opengl", cell: float = CELL_M, whole_pixels: bool = True) -> DataFrame:
    """Every point in every camera that sees it: adds frame_index, u, v, z (and float_u, float_v).

    Points meet cameras through shared world cells (an equi-join), never by a cross product.
    """
    frame_cols = ["scan_id", "frame_index", "width", "height", "fx", "fy", "cx", "cy", "c2w", "w2c"]
    located = points
    for axis in "xyz":
        located = located.withColumn(f"cell_{axis}", F.floor(F.col(axis) / cell).cast("int"))
    occupied = located.groupBy("scan_id").agg(
        *[fn(f"cell_{a}").alias(f"_{tag}_cell_{a}") for a in "xyz" for tag, fn in (("lo", F.min), ("hi", F.max))]
    )
    cells = frustum_cells(frames.select(*frame_cols), occupied, far, near, cell, convention).drop("c2w")
    keys = ["scan_id", "cell_x", "cell_y", "cell_z"]
    pairs = skew_join(located, cells, keys, ["point_id"], fan_out=True)
    xc, yc, zc = camera.affine_text("w2c", "x", "y", "z")
    sign = {"opengl": "-", "opencv": ""}[convention]
    kept = [c for c in points.columns]
    # the one-row generator keeps the range tests above the camera arithmetic: pushed into the join
    # they would repeat the matrix product once per test and pair
    camera_row = f"inline(array(named_struct('_x', {xc}, '_y', {sign}{yc}, 'depth', {sign}{zc})))"
    seen = pairs.selectExpr(*kept, "frame_index", "width", "height", "fx", "fy", "cx", "cy", camera_row)
    seen = seen.where(f"depth > {near}D AND depth < {far}D").selectExpr(
        *kept, "frame_index", "width", "height", "fx", "fy", "depth",
        "fx * (_x / depth) + cx AS float_u", "fy * (_y / depth) + cy AS float_v",
    ).where("float_u >= 0 AND float_u < width AND float_v >= 0 AND float_v < height")
    whole = ["int(floor(float_u)) AS u", "int(floor(float_v)) AS v"]
    floats = [] if whole_pixels else ["float_u", "float_v"]
    return seen.selectExpr(*kept, "frame_index", "width", "height", "fx", "fy", "depth", *floats, *whole)


def min_filter(v: np.ndarray, u: np.ndarray, z: np.ndarray, width: int, height: int, radius: int) -> np.ndarray:
    """Image of the smallest depth within ``radius`` of each pixel; infinite where there is none."""
    wide = np.full((height + 2 * radius, width + 2 * radius), np.inf)
    wide[v + radius, u + radius] = z
    rows = np.min([wide[i:i + height] for i in range(2 * radius + 1)], axis=0)
    return np.min([rows[:, j:j + width] for j in range(2 * radius + 1)], axis=0)


def zbuffer(projected: DataFrame, radius: int = 0, occupied: bool = False) -> DataFrame:
    """Nearest depth per (scan, frame, v, u); ``radius`` > 0 adds a square minimum filter.

    ``occupied`` gives the filtered depth only at pixels that hold a point, which is all that a test
    of the points themselves reads; the filter fills a dozen pixels around each of them.
    """
    keys = ["scan_id", "frame_index", "v", "u"]
    base = projected.groupBy(*keys).agg(F.min("depth").alias("z_ref"), F.first("width").alias("width"),
                                        F.first("height").alias("height"))
    if radius == 0:
        return base.drop("width", "height")
    # Only the per-pixel minima of whole frames reach a task, many frames at once, and a frame is bounded by its
    # image.  Spelling the filter as rows would multiply every pixel by the window area before a shuffle.
    def spread(image, c, images):
        wide, high = np.zeros(images, dtype="int64"), np.zeros(images, dtype="int64")
        wide[image], high[image] = c["width"], c["height"]
        width, height = int(wide.max()), int(high.max())
        step = max(1, IMAGE_CELLS // ((width + 2 * radius) * (height + 2 * radius)))
        made = []
        for first in range(0, images, step):
            n = min(step, images - first)
            part = slice(*np.searchsorted(image, [first, first + n]))
            at, v, u = image[part] - first, c["v"][part], c["u"][part]
            grid = np.full((n, height + 2 * radius, width + 2 * radius), np.inf)
            grid[at, v + radius, u + radius] = c["z_ref"][part]
            rows = grid[:, :height].copy()
            for i in range(1, 2 * radius + 1):
                np.minimum(rows, grid[:, i:i + height], out=rows)
            low = rows[:, :, :width].copy()
            for j in range(1, 2 * radius + 1):
                np.minimum(low, rows[:, :, j:j + width], out=low)
            if not occupied:
                own = (np.arange(height)[:, None] < high[first:first + n, None, None]) & (np.arange(width) < wide[first:first + n, None, None])
                at, v, u = np.nonzero(np.isfinite(low) & own)
            made.append((at + first, v.astype("int32"), u.astype("int32"), low[at, v, u]))
        image, v, u, z = (np.concatenate(x) for x in zip(*made))
        return image, {"v": v, "u": u, "z_ref": z}

    return by_image(base, ["scan_id", "frame_index"], [], spread, "v int, u int, z_ref double")


def pixel_surface(projected: DataFrame) -> DataFrame:
    """Adds ``z_ref``, the nearest depth of a point's own pixel: one shuffle, and the projection is not made twice for it."""
    return projected.withColumn("z_ref", F.min("depth").over(W.partitionBy("scan_id", "frame_index", "v", "u")))


def zbuffer_visible(projected: DataFrame, surface: DataFrame | None = None, abs_tol=cfg.ZBUFFER_ABS, rel_tol=cfg.ZBUFFER_REL) -> DataFrame:
    """Adds ``z_ref`` and ``self_visible``: depth within a two-sided tolerance of the surface, by default that of the pixel."""
    joined = pixel_surface(projected) if surface is None else projected.join(surface, ["scan_id", "frame_index", "v", "u"], "left")
    return self_visible(joined, abs_tol, rel_tol)


def self_visible(joined: DataFrame, abs_tol=cfg.ZBUFFER_ABS, rel_tol=cfg.ZBUFFER_REL) -> DataFrame:
    """Adds ``self_visible`` to rows that have ``z_ref``."""
    near = F.abs(F.col("depth") - F.col("z_ref")) <= F.greatest(F.lit(abs_tol), F.lit(rel_tol) * F.col("z_ref"))
    return joined.withColumn("self_visible", F.coalesce(near, F.lit(False)))


def by_frame(projected: DataFrame) -> DataFrame:
    """Rows of a frame in one partition: steps that are keyed by the frame and more need no further shuffle."""
    tasks = int(projected.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return projected.repartition(tasks, "scan_id", "frame_index")


def filtered_surface(projected: DataFrame, radius: int) -> DataFrame:
    """Adds ``z_ref``, the least depth within ``radius`` pixels of a point's own one; rows of :func:`by_frame` are not shuffled again.

    The points of a pixel are one row.  Such a row is repeated along its image row only, and without its
    points; a range of image rows then closes the square.
    """
    keys = ["scan_id", "frame_index"]
    held = F.struct(*[c for c in projected.columns if c not in (*keys, "u", "v")])
    pixels = projected.groupBy(*keys, "v", "u").agg(F.min("depth").alias("_z"), F.collect_list(held).alias("_points"))
    step = F.explode(F.array(*[F.lit(d) for d in range(-radius, radius + 1)]))
    wide = pixels.withColumn("_d", step).select(*keys, "v", (F.col("u") + F.col("_d")).alias("u"), "_z", F.when(F.col("_d") == 0, F.col("_points")).alias("_points"))
    low = F.min("_z").over(W.partitionBy(*keys, "u").orderBy("v").rangeBetween(-radius, radius))
    seen = wide.withColumn("z_ref", low).where("_points IS NOT NULL")
    return seen.select(*keys, "u", "v", "z_ref", F.inline("_points")).select(*projected.columns, "z_ref")


def cleanup_visible(projected: DataFrame, surface: DataFrame, sigma: str = "sigma", abs_tol: float = 0.08, sigmas: float = 2.0) -> DataFrame:
    """The one-sided form of clean-up: adds ``z_ref`` and ``cleanup_visible``, depth not behind the surface by more than the tolerance."""
    joined = projected.join(surface, ["scan_id", "frame_index", "v", "u"], "left")
    near = F.col("depth") <= F.col("z_ref") + abs_tol + sigmas * F.col(sigma)
    return joined.withColumn("cleanup_visible", F.coalesce(near, F.lit(False)))


def depth_match(projected: DataFrame, depth: DataFrame, size: tuple[int, int], patch: int = 1,
                near=cfg.NEAR_M, far=cfg.FAR_M, abs_tol=cfg.DEPTH_ABS, rel_tol=cfg.DEPTH_REL) -> DataFrame:
    """Adds ``depth_ref``, ``depth_delta`` and ``rendered_visible`` from depth rasters of ``size``.

    The best pixel of a (2*patch+1)^2 window wins.  Offsets are visited row by row and only a
    strictly smaller difference replaces, so equal differences keep the earlier offset.
    """
    dw, dh = size
    keys = ["scan_id", "frame_index"]
    usable = depth.where((F.col("z") > near) & (F.col("z") < far)).select(*keys, "v", "u", F.col("z").cast("double").alias("z"))
    out = spread_join(projected, depth_images(usable, keys, dw, dh), keys, "left")
    du0 = F.floor(F.col("u") * float(dw) / F.col("width"))
    dv0 = F.floor(F.col("v") * float(dh) / F.col("height"))

    def clamp(c, hi):
        return F.greatest(F.lit(0), F.least(F.lit(hi - 1), c.cast("int")))

    # places of the window in the image first: a row is widened by a few numbers, not repeated per pixel
    steps = [(a, b) for a in range(-patch, patch + 1) for b in range(-patch, patch + 1)]
    found = []
    for i, (a, b) in enumerate(steps):
        z = F.get("_image", clamp(dv0 + a, dh) * dw + clamp(du0 + b, dw))
        found.append(F.when(~F.isnan(z), F.struct(F.abs(F.col("depth") - z).alias("d"), F.lit(i).alias("i"), z.alias("ref"))))
    best = F.least(*found) if len(found) > 1 else found[0]
    out = out.select(*projected.columns, best.alias("_best"))
    ref, d = F.col("_best.ref"), F.col("_best.d")
    visible = F.coalesce(d <= F.greatest(F.lit(abs_tol), F.lit(rel_tol) * ref), F.lit(False))
    return out.select(*projected.columns, ref.alias("depth_ref"), d.alias("depth_delta"), visible.alias("rendered_visible"))


def depth_images(depth: DataFrame, keys: list[str], width: int, height: int) -> DataFrame:
    """One row per frame with its raster in ``_image``, row after row and NaN where there is no depth; a frame is bounded by its image.

    Of several depths at one pixel the nearest counts.
    """
    cells = width * height

    def work(image, c, images):
        raster = np.full(images * cells, np.inf)
        inside = (c["v"] >= 0) & (c["v"] < height) & (c["u"] >= 0) & (c["u"] < width)
        np.minimum.at(raster, (image * cells + c["v"].astype("int64") * width + c["u"])[inside], c["z"][inside])
        raster[np.isinf(raster)] = np.nan
        return np.arange(images), {"_image": pa.ListArray.from_arrays(pa.array(np.arange(images + 1, dtype="int32") * cells), pa.array(raster))}

    at = depth.where("v IS NOT NULL AND u IS NOT NULL")
    return by_image(at, keys, [], work, "_image array<double>", most=max(1, IMAGE_CELLS // cells))


def visibility(matched: DataFrame, mode: str = "hybrid") -> DataFrame:
    """Adds ``visibility_weight`` and keeps visible rows.

    Needs ``rendered_visible`` and ``self_visible`` (hybrid), or the one its mode names.
    """
    if mode == "none":
        return matched.withColumn("visibility_weight", F.lit(cfg.WEIGHT_NO_DEPTH))
    rendered = F.when(F.col("rendered_visible"), F.lit(cfg.WEIGHT_RENDERED)) if mode in ("hybrid", "rendered_depth") else None
    own = F.when(F.col("self_visible"), F.lit(cfg.WEIGHT_ZBUFFER)) if mode in ("hybrid", "self_zbuffer") else None
    if rendered is None and own is None:
        raise ValueError(f"unknown visibility mode {mode}")
    weight = F.coalesce(*[w for w in (rendered, own) if w is not None])
    return matched.withColumn("visibility_weight", weight).where(F.col("visibility_weight").isNotNull())


def footprint_coverage(points: DataFrame, runs: DataFrame, offsets=None, count_outside: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """Share of each point's screen footprint inside each mask.

    ``points``: scan_id, frame_index, point_id, u, v, radius_px, width, height; ``runs`` are disjoint
    per mask.  Samples outside the image miss (``count_outside``) or leave the denominator.
    Returns (scan_id, frame_index, point_id, mask_id, coverage) with coverage > 0, and the columns of
    a point that ``carry`` names.
    """
    offsets = offsets or cfg.FOOTPRINT_OFFSETS
    total = sum(o[2] for o in offsets)
    listed = ", ".join(f"named_struct('dx', {a}D, 'dy', {b}D, 'w', {w / total!r}D)" for a, b, w in offsets)
    samples = F.expr(f"array({listed})")
    keys = ["scan_id", "frame_index", "point_id", *carry]
    base = points.select(*keys, "u", "v", "radius_px", "width", "height")
    s = base.select("*", F.explode(samples).alias("s")).select(
        *keys, "width", "height", F.col("s.w").alias("w"),
        F.rint(F.col("u") + F.col("s.dx") * F.col("radius_px")).cast("int").alias("su"),
        F.rint(F.col("v") + F.col("s.dy") * F.col("radius_px")).cast("int").alias("y"),
    )
    inside = (F.col("su") >= 0) & (F.col("su") < F.col("width")) & (F.col("y") >= 0) & (F.col("y") < F.col("height"))
    s = s.where(inside)
    packed = s.select(*keys, "y", "su", "w").withColumn("tile", F.floor(F.col("su") / TILE_PX).cast("int"))
    # image rows are bounded by the frame; AQE splits a row that a large share of the samples hits
    hits = spread_join(packed, tiled_runs(runs), ["scan_id", "frame_index", "y", "tile"]).where(
        (F.col("su") >= F.col("x0")) & (F.col("su") < F.col("x1"))
    )
    cover = hits.groupBy(*keys, "mask_id").agg(F.sum("w").alias("coverage"))
    if count_outside:
        return cover
    seen = s.groupBy(*keys).agg(F.sum("w").alias("_seen"))
    return cover.join(seen, keys).withColumn("coverage", F.col("coverage") / F.col("_seen")).drop("_seen")


def frame_rows(runs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per frame: ``_rows`` lists for each image row its runs (mask_id, x0, x1 and what ``carry`` names); a frame is bounded by its masks."""
    held = F.collect_list(F.struct("mask_id", "x0", "x1", *carry)).alias("runs")
    rows = by_frame(runs.select("scan_id", "frame_index", "mask_id", "y", "x0", "x1", *carry).where("y >= 0")).groupBy("scan_id", "frame_index", "y").agg(held)
    listed = rows.groupBy("scan_id", "frame_index").agg(F.max("y").alias("_last"), F.map_from_entries(F.collect_list(F.struct("y", "runs"))).alias("_at"))
    return listed.select("scan_id", "frame_index", F.expr("transform(sequence(0, _last), y -> _at[y])").alias("_rows"))


def frame_coverage(points: DataFrame, rows: DataFrame, offsets=None, carry: tuple[str, ...] = (), mask: tuple[str, ...] = ()) -> DataFrame:
    """:func:`footprint_coverage` of points by frame against :func:`frame_rows`; samples never become rows of a shuffle.

    ``points``: scan_id, frame_index, point_id, u, v, radius_px, width, height; columns that ``carry`` (of the
    point) and ``mask`` (of the run) name come back.  Samples outside the image miss.
    """
    offsets = offsets or cfg.FOOTPRINT_OFFSETS
    total = sum(o[2] for o in offsets)
    keys = ["scan_id", "frame_index", "point_id", *carry]
    base = points.select(*keys, "u", "v", "radius_px", "width", "height")
    listed = ", ".join(f"named_struct('_x', int(rint(u + {a}D * radius_px)), '_y', int(rint(v + {b}D * radius_px)), '_w', {w / total!r}D)" for a, b, w in offsets)
    s = spread_join(base, rows, ["scan_id", "frame_index"]).selectExpr(*keys, "width", "height", "_rows", f"inline(array({listed}))")
    s = s.where("_x >= 0 AND _x < width AND _y >= 0 AND _y < height").selectExpr(*keys, "_x", "_w", "inline(get(_rows, _y))")
    return s.where("_x >= x0 AND _x < x1").groupBy(*keys, "mask_id", *mask).agg(F.sum("_w").alias("coverage"))


def tiled_runs(runs: DataFrame, tile: int = TILE_PX) -> DataFrame:
    """Each run once per image tile it touches."""
    tiles = F.sequence(F.floor(F.col("x0") / tile).cast("int"), F.floor((F.col("x1") - 1) / tile).cast("int"))
    return runs.select("scan_id", "frame_index", "mask_id", "y", "x0", "x1", F.explode(tiles).alias("tile"))


def center_in_mask(projected: DataFrame, runs: DataFrame) -> DataFrame:
    """(scan, frame, point) rows whose pixel lies in any mask of the frame."""
    p = projected.select("scan_id", "frame_index", "point_id", F.col("v").alias("y"), "u").withColumn(
        "tile", F.floor(F.col("u") / TILE_PX).cast("int")
    )
    hit = spread_join(p, tiled_runs(runs), ["scan_id", "frame_index", "y", "tile"]).where(
        (F.col("u") >= F.col("x0")) & (F.col("u") < F.col("x1"))
    )
    return hit.select("scan_id", "frame_index", "point_id", "mask_id").distinct()
