"""End to end: points, cameras and masks in; one label per point out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from splatlake import config as cfg
from splatlake.functions import camera, weights
from splatlake.operators import masks as ma, projection as pj, votes as vt

MASK = ["scan_id", "frame_index", "mask_id"]


@dataclass
class Labelling:
    """Lazily planned tables of one labelling run."""

    projected: DataFrame
    surface: DataFrame
    prepared: DataFrame
    foreground: DataFrame
    runs: DataFrame
    visible: DataFrame
    coverage: DataFrame
    votes: DataFrame
    limits: DataFrame
    heights: DataFrame
    totals: DataFrame
    labels: DataFrame


def label_points(points: DataFrame, frames: DataFrame, masks: DataFrame, runs: DataFrame, width: int, height: int,
                 depth: DataFrame | None = None, depth_size: tuple[int, int] | None = None) -> Labelling:
    """Plan the whole voting chain.  ``points`` carry ``radius``; ``masks`` carry label and score.

    Tables that several later steps read (projection, dilated masks, foreground) are persisted, so that they are
    computed once; lost blocks are rebuilt from lineage.  All steps from the depth surface to the votes find the rows
    of a frame in one partition.
    """
    def keep(df: DataFrame) -> DataFrame:
        return df.persist(StorageLevel.MEMORY_AND_DISK)

    heights = vt.point_heights(points, vt.world_up(frames))
    limits = vt.height_limits(heights)
    placed = vt.height_gates(heights.select("scan_id", "point_id", "radius", "x", "y", "z", "height"), limits).drop("height")
    framed = frames.join(masks.select("scan_id", "frame_index").distinct(), ["scan_id", "frame_index"], "left_semi")
    # a projected point is shuffled once, to its frame, with all that its vote needs
    seen = pj.project_points(placed, framed)
    radius = camera.footprint_radius(F.col("radius"), F.col("depth"), F.col("fx"), F.col("fy"))
    projected = keep(pj.by_frame(seen.withColumn("radius_px", radius).drop("x", "y", "z", "radius", "fx", "fy")))
    nearest = pj.zbuffer(projected)

    r = runs.join(masks.select(*MASK, "label"), MASK).select(*MASK, "label", "y", "x0", "x1") if "label" not in runs.columns else runs
    grown = keep(ma.dilate(r, [*MASK, "label"], weights.mask_dilation(F.col("label")), width, height))
    prepared = vt.static_weights(masks, ma.pixel_count(grown, MASK), width, height)
    foreground = keep(vt.foreground_support(masks, grown, nearest, width, height, cfg.ZBUFFER_RADIUS))  # one row per mask, read twice below

    surface_label = weights.is_surface(F.col("label"))
    objects = grown.where(~surface_label).join(
        foreground.where("geometry_supported").select(*MASK), MASK, "left_semi"
    )
    union = ma.union_runs(objects, ["scan_id", "frame_index"])
    blocked = ma.dilate(union, ["scan_id", "frame_index"], cfg.SUPPRESSION_DILATION, width, height)
    structure = ma.subtract_runs(grown.where(surface_label), blocked, ["scan_id", "frame_index"], MASK)
    usable = objects.select(*MASK, "y", "x0", "x1").unionByName(structure)

    seen = pj.self_visible(pj.filtered_surface(projected, cfg.ZBUFFER_RADIUS))
    if depth is not None:
        seen = pj.depth_match(seen, depth, depth_size)
        visible = pj.visibility(seen, "hybrid")
    else:
        visible = pj.visibility(seen, "self_zbuffer")
    named = ("label", "score", "static_weight")
    claimed = usable.join(prepared.select(*MASK, *named), MASK)
    cover = pj.frame_coverage(visible, pj.frame_rows(claimed, named), carry=("visibility_weight", "gates"), mask=named)
    votes = vt.best_claim(cover.where((F.col("coverage") >= cfg.FOOTPRINT_MIN_COVERAGE) & vt.passes_gates(F.col("label"), F.col("gates"))))
    totals = vt.vote_totals(votes)
    labels = vt.final_labels(vt.structural_cleanup(vt.winner(totals), heights, limits))
    return Labelling(projected, pj.zbuffer(projected, cfg.ZBUFFER_RADIUS), prepared, foreground, usable, visible, cover, votes, limits, heights, totals, labels)


def center_vote_labels(points: DataFrame, frames: DataFrame, masks: DataFrame, runs: DataFrame, width: int, height: int) -> DataFrame:
    """The short form: z-buffer visibility, centre pixel only, static weights, one vote per frame."""
    projected = pj.project_points(points.select("scan_id", "point_id", "x", "y", "z"), frames)
    visible = pj.zbuffer_visible(projected).where("self_visible")
    prepared = vt.static_weights(masks, ma.pixel_count(ma.union_runs(runs, MASK), MASK), width, height)
    hits = pj.center_in_mask(visible, runs).withColumn("coverage", F.lit(1.0)).withColumn(
        "visibility_weight", F.lit(cfg.WEIGHT_ZBUFFER)
    )
    heights = vt.point_heights(points, vt.world_up(frames))
    votes = vt.first_claim(hits, prepared, heights, vt.height_limits(heights))
    return vt.final_labels(vt.winner(vt.vote_totals(votes)))
