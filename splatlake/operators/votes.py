"""Label votes of masks on points: claims, totals, winners, gates and reports."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from splatlake.operators.quantiles import attach, exact_quantiles
from splatlake import config as cfg
from splatlake.functions import weights
from splatlake.operators import masks as ma
from splatlake.operators.projection import min_filter

POINT = ["scan_id", "point_id"]


def world_up(frames: DataFrame) -> DataFrame:
    """Mean camera up axis per scan: (scan_id, up_x, up_y, up_z); (0,1,0) when undefined."""
    m = F.col("c2w")
    raw = [m[1], m[5], m[9]]
    norm = F.sqrt(raw[0] * raw[0] + raw[1] * raw[1] + raw[2] * raw[2])
    ok = (norm > 1e-6) & (norm < float("inf"))
    means = frames.groupBy("scan_id").agg(
        *[F.avg(F.when(ok, r / norm)).alias(f"m{i}") for i, r in enumerate(raw)]
    )
    total = F.sqrt(F.col("m0") * F.col("m0") + F.col("m1") * F.col("m1") + F.col("m2") * F.col("m2"))
    good = total.isNotNull() & ~F.isnan(total) & (total >= 1e-6)
    return means.select(
        "scan_id", *[F.when(good, F.col(f"m{i}") / total).otherwise(F.lit(d)).alias(n)
                     for i, (n, d) in enumerate((("up_x", 0.0), ("up_y", 1.0), ("up_z", 0.0)))]
    )


def point_heights(points: DataFrame, up: DataFrame) -> DataFrame:
    """Adds ``height`` along the scan's up axis."""
    h = F.col("x") * F.col("up_x") + F.col("y") * F.col("up_y") + F.col("z") * F.col("up_z")
    return points.join(up, "scan_id").withColumn("height", h).drop("up_x", "up_y", "up_z")


def height_limits(points: DataFrame) -> DataFrame:
    """Floor and ceiling limits per scan from exact height percentiles."""
    p = exact_quantiles(points, ["scan_id"], {"height": [cfg.HEIGHT_LOW, 0.15, 0.85, cfg.HEIGHT_HIGH]}).withColumnRenamed("q_height", "p")
    lo, hi = F.col("p")[0] + cfg.HEIGHT_MARGIN, F.col("p")[3] - cfg.HEIGHT_MARGIN
    crossed = lo >= hi
    return p.select(
        "scan_id", F.when(crossed, F.col("p")[1]).otherwise(lo).alias("floor_limit"),
        F.when(crossed, F.col("p")[2]).otherwise(hi).alias("ceiling_limit"),
    )


def height_gate(label: Column, height: Column, floor: Column, ceiling: Column) -> Column:
    return (
        F.when(label == "floor", height <= floor).when(label == "ceiling", height >= ceiling)
        .when(label == "wall", (height > floor) & (height < ceiling)).otherwise(F.lit(True))
    )


def cloud_bounds(points: DataFrame) -> DataFrame:
    """Bounds, size and radius statistics per scan."""
    aggs = [F.count("*").alias("point_count")]
    for a in "xyz":
        aggs += [F.min(a).alias(f"min_{a}"), F.max(a).alias(f"max_{a}"), (F.max(a) - F.min(a)).alias(f"size_{a}")]
    aggs += [F.min("radius").alias("radius_min"), F.max("radius").alias("radius_max")]
    middle = exact_quantiles(points, ["scan_id"], {"radius": [0.5]})
    return attach(points.groupBy("scan_id").agg(*aggs), middle, ["scan_id"]).withColumn("radius_median", F.col("q_radius")[0]).drop("q_radius")


def finite_points(points: DataFrame, cols: list[str]) -> DataFrame:
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return points.where(cond)


def static_weights(masks: DataFrame, areas: DataFrame, width: int, height: int) -> DataFrame:
    """Adds the frequency, area, role and combined weights of each mask (area after dilation)."""
    freq = weights.label_frequency_weight(masks)
    frac = F.col("pixels") / F.lit(float(width * height))
    joined = masks.join(freq, ["scan_id", "label"]).join(areas, ["scan_id", "frame_index", "mask_id"])
    return joined.select(
        "scan_id", "frame_index", "mask_id", "label", F.greatest("score", F.lit(cfg.MIN_MASK_SCORE)).alias("score"),
        "label_mask_count", "label_frequency_weight", frac.alias("mask_area_fraction"),
        weights.mask_area_weight(frac).alias("mask_area_weight"), weights.role_weight(F.col("label")).alias("role_weight"),
    ).withColumn("static_weight", F.col("label_frequency_weight") * F.col("mask_area_weight") * F.col("role_weight"))


def foreground_support(masks: DataFrame, runs: DataFrame, surface: DataFrame, width: int, height: int, radius: int = 0) -> DataFrame:
    """Is an object mask nearer than the ring around it?  One row per object mask.

    ``surface`` is the nearest depth per pixel; ``radius`` adds its square minimum filter.  Exempt
    labels pass with reason ``not_required_for_label``; masks with too few depth pixels pass with
    ``insufficient_valid_depth_for_check``.  A frame's depth pixels meet its zones as one image, so
    neither the filtered surface nor the pixels of the zones become rows.
    """
    keys = ["scan_id", "frame_index", "mask_id"]
    objects = masks.where(~weights.is_surface(F.col("label")))
    checked = objects.where(~F.col("label").isin(cfg.FOREGROUND_EXEMPT)).select(*keys, "label")
    inside = runs.join(checked.select(*keys), keys, "left_semi")
    types = {f.name: f.dataType.simpleString() for f in masks.schema}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", inside_valid_pixels bigint, ring_valid_pixels bigint, inside_depth_m double, ring_depth_m double"

    def quantile(z: np.ndarray, q: float) -> float | None:
        if not len(z):
            return None
        place = q * (len(z) - 1)
        lo, hi = math.floor(place), math.ceil(place)
        z = np.partition(z, (lo, hi))
        return float(z[lo]) if lo == hi else float((hi - place) * z[lo] + (place - lo) * z[hi])

    def grow(shape: np.ndarray, r: int) -> np.ndarray:
        for axis in (0, 1):  # a window holds a pixel where the running count rises inside it
            n = np.cumsum(np.pad(shape, [(r + 1, r) if k == axis else (0, 0) for k in (0, 1)]), axis=axis, dtype=np.int32)
            size = shape.shape[axis]
            shape = n.take(range(2 * r + 1, 2 * r + 1 + size), axis) > n.take(range(size), axis)
        return shape

    def measure(key: tuple, zones: pd.DataFrame, depth: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(zones) and len(depth):
            v, u = depth["v"].to_numpy(), depth["u"].to_numpy()
            image = min_filter(v, u, depth["z_ref"].to_numpy(), max(width, int(u.max()) + 1), max(height, int(v.max()) + 1), radius)
            valid = (image > cfg.NEAR_M) & (image < cfg.FAR_M)
            ring_px = cfg.FOREGROUND_RING
            for mask, part in zones.groupby("mask_id", sort=False):
                # only the box of the mask and its ring is looked at; the runs may reach beyond the image that rings are cut to
                top, left = max(0, int(part["y"].min()) - ring_px), max(0, int(part["x0"].min()) - ring_px)
                bottom, right = int(part["y"].max()) + ring_px + 1, int(part["x1"].max()) + ring_px
                near, ok = image[top:bottom, left:right], valid[top:bottom, left:right]
                shape = np.zeros(near.shape, dtype=bool)
                for y, x0, x1 in zip(part["y"] - top, part["x0"] - left, part["x1"] - left):
                    shape[y, x0:x1] = True
                inner = shape[:max(0, height - top), :max(0, width - left)]
                ring = grow(inner, ring_px) & ~inner
                z_in, z_ring = near[shape & ok], near[:inner.shape[0], :inner.shape[1]][ring & ok[:inner.shape[0], :inner.shape[1]]]
                if len(z_in) or len(z_ring):
                    out.append((*key, mask, len(z_in), len(z_ring), quantile(z_in, cfg.FOREGROUND_PERCENTILE), quantile(z_ring, 0.5)))
        return pd.DataFrame(out, columns=[*keys, "inside_valid_pixels", "ring_valid_pixels", "inside_depth_m", "ring_depth_m"])

    frame = ["scan_id", "frame_index"]
    zone = inside.where((F.col("y") >= 0) & (F.col("y") < height)).select(*keys, "y", F.greatest("x0", F.lit(0)).alias("x0"), "x1")
    stats = zone.groupBy(*frame).cogroup(surface.select(*frame, "v", "u", "z_ref").groupBy(*frame)).applyInPandas(measure, schema)
    out = objects.select(*keys, "label").join(stats, keys, "left")
    zero = F.lit(0).cast("bigint")
    n_in, n_ring = F.coalesce("inside_valid_pixels", zero), F.coalesce("ring_valid_pixels", zero)
    exempt = F.col("label").isin(cfg.FOREGROUND_EXEMPT)
    enough = (n_in >= cfg.FOREGROUND_MIN_PIXELS) & (n_ring >= cfg.FOREGROUND_MIN_PIXELS) & ~exempt
    delta = F.when(enough, F.col("ring_depth_m") - F.col("inside_depth_m"))
    return out.select(
        *keys, "label", n_in.alias("inside_valid_pixels"), n_ring.alias("ring_valid_pixels"),
        delta.alias("foreground_delta_m"), F.coalesce(delta >= cfg.FOREGROUND_DELTA, F.lit(True)).alias("geometry_supported"),
        F.when(exempt, F.lit("not_required_for_label")).when(enough, F.lit("foreground_depth_delta"))
        .otherwise(F.lit("insufficient_valid_depth_for_check")).alias("reason"),
    )


def first_claim(coverage: DataFrame, masks: DataFrame, points: DataFrame, limits: DataFrame,
                min_coverage=cfg.FOOTPRINT_MIN_COVERAGE) -> DataFrame:
    """The one mask that each visible point votes for in each frame.

    ``coverage``: scan, frame, point, mask, coverage, visibility_weight.  Objects come first by
    score*static, then surfaces by (static, score) that pass the height gate; ties keep mask order.
    The claim is a minimum over an ordered struct, so map-side combining applies.
    """
    m = masks.select("scan_id", "frame_index", "mask_id", "label", "score", "static_weight")
    c = coverage.where(F.col("coverage") >= min_coverage).join(m, ["scan_id", "frame_index", "mask_id"])
    c = c.join(points.select(*POINT, "height"), POINT).join(limits, "scan_id")
    return best_claim(c.where(height_gate(F.col("label"), F.col("height"), F.col("floor_limit"), F.col("ceiling_limit"))))


def best_claim(c: DataFrame) -> DataFrame:
    """The first claim of rows that passed their gates; rows carry label, score and static_weight of their mask."""
    surface = weights.is_surface(F.col("label"))
    first = F.when(surface, -F.col("static_weight")).otherwise(-F.col("score") * F.col("static_weight"))
    second = F.when(surface, -F.col("score")).otherwise(F.lit(0.0))
    weight = F.col("score") * F.col("static_weight") * F.col("coverage") * F.col("visibility_weight")
    claim = F.struct(
        surface.alias("is_surface"), first.alias("k1"), second.alias("k2"), "mask_id", "label", weight.alias("weight"), "coverage"
    )
    best = c.groupBy("scan_id", "frame_index", "point_id").agg(F.min(claim).alias("c"))
    return best.select("scan_id", "frame_index", "point_id", "c.mask_id", "c.label", "c.is_surface", "c.weight", "c.coverage")


GATED = ("floor", "ceiling", "wall")


def height_gates(points: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds ``gates``, a bit per label of ``GATED`` whose height band holds the point; null in scans without limits."""
    passed = [F.coalesce(height_gate(F.lit(n), F.col("height"), F.col("floor_limit"), F.col("ceiling_limit")), F.lit(False)) for n in GATED]
    bits = sum((F.when(ok, 1 << i).otherwise(0) for i, ok in enumerate(passed)), F.lit(0))
    return points.join(limits.withColumn("_limits", F.lit(True)), "scan_id", "left").withColumn("gates", F.when(F.col("_limits"), bits)).drop("floor_limit", "ceiling_limit", "_limits")


def passes_gates(label: Column, gates: Column) -> Column:
    """:func:`height_gate` by the bits of :func:`height_gates`."""
    out = F.when(gates.isNull(), F.lit(False))
    for i, n in enumerate(GATED):
        out = out.when(label == n, gates.bitwiseAND(F.lit(1 << i)) != 0)
    return out.otherwise(F.lit(True))


def vote_totals(votes: DataFrame) -> DataFrame:
    """Summed weight and distinct frames per (point, label); one vote per frame makes count exact."""
    return votes.groupBy(*POINT, "label").agg(F.sum("weight").alias("score"), F.count("*").alias("views"))


def winner(totals: DataFrame) -> DataFrame:
    """Best and second score per point; equal scores go to the alphabetically first label."""
    w = totals.where(F.col("score") > 0).groupBy(*POINT).agg(
        F.min(F.struct((-F.col("score")).alias("n"), "label", "views")).alias("b"),
        F.sum("score").alias("total_score"),
        F.sort_array(F.collect_list("score"), asc=False).alias("_scores"),
    )
    best = -F.col("b.n")
    second = F.coalesce(F.try_element_at("_scores", F.lit(2)), F.lit(0.0))
    return w.select(
        *POINT, F.col("b.label").alias("label"), best.alias("best_score"), second.alias("second_score"),
        F.col("b.views").alias("support_views"), ((best - second) / F.greatest(best, F.lit(1e-6))).alias("margin"),
        (best / F.greatest("total_score", best)).alias("confidence"),
    )


def structural_cleanup(win: DataFrame, points: DataFrame, limits: DataFrame) -> DataFrame:
    """A surface winner outside its height band becomes unknown with zeroed scores."""
    j = win.join(points.select(*POINT, "height"), POINT).join(limits, "scan_id")
    ok = height_gate(F.col("label"), F.col("height"), F.col("floor_limit"), F.col("ceiling_limit"))

    def keep(name, zero):
        return F.when(ok, F.col(name)).otherwise(F.lit(zero)).alias(name)

    return j.select(
        *POINT, F.when(ok, F.col("label")).alias("label"), keep("best_score", 0.0), keep("second_score", 0.0),
        keep("support_views", 0), keep("margin", 0.0), keep("confidence", 0.0),
        F.when(~ok, F.col("label")).alias("rejected_label"),
    )


def final_labels(win: DataFrame) -> DataFrame:
    """Adds ``final_label`` (null = unknown); confidence and views stay published."""
    ok = (
        F.col("label").isNotNull() & (F.col("best_score") >= cfg.MIN_TOTAL_VOTE)
        & (F.col("support_views") >= cfg.MIN_SUPPORT_VIEWS) & (F.col("margin") >= cfg.MIN_MARGIN)
    )
    return win.withColumn("final_label", F.when(ok, F.col("label")))


def label_summary(final: DataFrame, labels: DataFrame) -> DataFrame:
    """Per (scan, label) counts and means over final points; listed labels without points get zeros."""
    agg = final.where(F.col("final_label").isNotNull()).groupBy("scan_id", F.col("final_label").alias("label")).agg(
        F.count("*").alias("point_count"), F.avg("confidence").alias("mean_confidence"),
        F.avg("best_score").alias("mean_score"), F.avg("support_views").alias("mean_support_views"),
    )
    return labels.select("scan_id", "label").distinct().join(agg, ["scan_id", "label"], "left").na.fill(
        0, ["point_count"]
    ).na.fill(0.0, ["mean_confidence", "mean_score", "mean_support_views"])


def frame_report(projected_counts: DataFrame, visible_counts: DataFrame, votes: DataFrame, masks: DataFrame) -> DataFrame:
    """One row per frame with masks: projection, visibility and vote counters."""
    keys = ["scan_id", "frame_index"]
    per_mask = masks.groupBy(*keys).agg(F.count("*").alias("masks"))
    v = votes.groupBy(*keys).agg(
        F.count(F.when(~F.col("is_surface"), 1)).alias("object_votes"),
        F.count(F.when(F.col("is_surface"), 1)).alias("structural_votes"), F.count("*").alias("votes"),
    )
    out = per_mask.join(projected_counts, keys, "left").join(visible_counts, keys, "left").join(v, keys, "left")
    counters = [c for c in out.columns if c not in keys]
    status = F.when(F.col("projected_points").isNull(), F.lit("nothing_projected")).otherwise(F.lit("processed"))
    return out.withColumn("status", status).na.fill(0, counters)


def coverage_totals(report: DataFrame) -> DataFrame:
    """Scan totals over the frame report."""
    counters = ["projected_points", "visible_points", "object_votes", "structural_votes", "votes"]
    return report.groupBy("scan_id").agg(
        F.count("*").alias("frames"), F.count(F.when(F.col("status") == "processed", 1)).alias("processed_frames"),
        *[F.sum(c).alias(f"{c}_total") for c in counters],
    )


def vote_report(votes: DataFrame) -> DataFrame:
    """Accepted points, mean coverage and mean weight per (frame, mask)."""
    return votes.groupBy("scan_id", "frame_index", "mask_id", "label").agg(
        F.count("*").alias("accepted_points"), F.avg("coverage").alias("mean_coverage"), F.avg("weight").alias("mean_weight")
    )
