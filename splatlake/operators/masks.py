"""Mask algebra on run tables ``(keys..., y, x0, x1)`` with half-open runs.

Work is keyed by (mask, image row) or (frame, image row), which the image size bounds.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from splatlake import config as cfg
from splatlake.operators import run_images as ri
from splatlake.operators.skew import spread_join


OPEN = 1_000_000  # beyond any image edge


def union_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Pixel union of all runs that share ``keys`` (drop the mask id to unite masks).

    Gaps and islands over the runs of one image row; touching runs merge.
    """
    row = W.partitionBy(*keys, "y").orderBy("x0", "x1")
    reach = F.max("x1").over(row.rowsBetween(W.unboundedPreceding, -1))
    marked = runs.select(*keys, "y", "x0", "x1", F.when(F.col("x0") <= reach, 0).otherwise(1).alias("_new"))
    island = marked.withColumn("_island", F.sum("_new").over(row.rowsBetween(W.unboundedPreceding, 0)))
    return island.groupBy(*keys, "y", "_island").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_island")


def _plain(runs: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    at = [F.col(c).cast("int").alias(c) for c in ("y", "x0", "x1")]
    return runs.select(*keys, *at, *more).where("y IS NOT NULL AND x0 < x1")


def _images(runs: DataFrame, keys: list[str], width: int, height: int, shape: Callable) -> DataFrame:
    """``shape(lines, p0, p1)`` of the united runs of every image that ``keys`` name."""
    lines = ri.Lines(width, height)

    def unite(image, c, images):
        return _rows(lines, *ri.union(*lines.place(image, c["y"], c["x0"], c["x1"])))

    def work(image, c, images):
        return _rows(lines, *shape(lines, *ri.union(*lines.place(image, c["y"], c["x0"], c["x1"]))))

    return ri.by_image(_plain(runs, keys), keys, [], work, "y int, x0 int, x1 int", unite)


def _rows(lines: ri.Lines, p0: np.ndarray, p1: np.ndarray) -> tuple:
    image, y, x0, x1 = lines.runs(p0, p1)
    return image, {"y": y.astype("int32"), "x0": x0.astype("int32"), "x1": x1.astype("int32")}


def dilate(runs: DataFrame, keys: list[str], radius: Column | int, width: int, height: int) -> DataFrame:
    """Square dilation; ``radius`` may be a column of the run table.

    Runs meet by image before they are grown: grown rows would multiply what is shuffled and sorted.
    """
    lines = ri.Lines(width, height)
    r = F.lit(radius) if isinstance(radius, int) else radius

    def work(image, c, images):
        return _rows(lines, *lines.dilate(image, c["y"].astype("int64"), c["x0"], c["x1"], c["_r"]))

    def fold(image, c, images):
        at, grown = work(image, c, images)
        return at, {**grown, "_r": np.zeros(len(at), dtype="int32")}

    return ri.by_image(_plain(runs, keys, r.cast("int").alias("_r")).where("_r IS NOT NULL"), keys, [], work, "y int, x0 int, x1 int", fold)


def _gaps(merged: DataFrame, keys: list[str], lo: int, hi: int) -> DataFrame:
    """Spaces between the disjoint runs of each row, as ``g0``/``g1`` inside ``[lo, hi)``."""
    row = W.partitionBy(*keys, "y").orderBy("x0")
    before = F.struct(F.lag("x1", 1, lo).over(row).alias("g0"), F.col("x0").alias("g1"))
    after = F.when(F.lead("x0").over(row).isNull(), F.struct(F.col("x1").alias("g0"), F.lit(hi).alias("g1")))
    out = merged.select(*keys, "y", before.alias("_b"), after.alias("_a"))
    return out.select(*keys, "y", F.explode(F.array_compact(F.array("_b", "_a"))).alias("_g")).select(
        *keys, "y", "_g.g0", "_g.g1"
    ).where("g0 < g1")


def complement(runs: DataFrame, masks: DataFrame, keys: list[str], width: int, height: int) -> DataFrame:
    """Pixels of the frame outside each mask; ``masks`` lists the keys (empty masks included).

    Every row also gets an empty run past the right edge, so rows without runs need no join.
    """
    rows = masks.select(*keys).distinct().select(
        *keys, F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y"), F.lit(width).alias("x0"), F.lit(width).alias("x1")
    )
    filled = union_runs(runs.select(*keys, "y", "x0", "x1").unionByName(rows), keys)
    return _gaps(filled, keys, 0, width).select(*keys, "y", F.col("g0").alias("x0"), F.col("g1").alias("x1"))


def erode(runs: DataFrame, masks: DataFrame, keys: list[str], radius: int, width: int, height: int) -> DataFrame:
    """Square erosion; the frame border does not erode.  Masks without runs stay empty, so ``masks`` is not read."""
    return _images(runs, keys, width, height, lambda lines, p0, p1: lines.erode(p0, p1, radius))


def close_open(runs, masks, keys, width, height, close=cfg.STRUCTURE_CLOSE, open_=cfg.STRUCTURE_OPEN) -> DataFrame:
    """Morphological close, then open, with odd square kernels; all four steps on an image at once."""
    c, o = close // 2, open_ // 2

    def grow(lines, p0, p1, radius):
        return lines.dilate(*lines.runs(p0, p1), radius)

    def shape(lines, p0, p1):
        closed = lines.erode(*grow(lines, p0, p1, c), c)
        return grow(lines, *lines.erode(*closed, o), o)

    return _images(runs, keys, width, height, shape)


def subtract_runs(a: DataFrame, b: DataFrame, on: list[str], keep: list[str]) -> DataFrame:
    """Runs of ``a`` without the pixels of ``b`` that share ``on``; ``keep`` are a's key columns.

    ``a`` meets the gaps of ``b`` row by row; a row that ``b`` does not touch stays whole.
    """
    gaps = _gaps(union_runs(b, on), on, -OPEN, OPEN)
    x0 = F.greatest("x0", F.coalesce("g0", F.col("x0")))
    x1 = F.least("x1", F.coalesce("g1", F.col("x1")))
    return spread_join(a, gaps, [*on, "y"], "left").select(*keep, "y", x0.alias("x0"), x1.alias("x1")).where("x0 < x1")


def pixel_count(runs: DataFrame, keys: list[str], name: str = "pixels") -> DataFrame:
    return runs.groupBy(*keys).agg(F.sum(F.col("x1") - F.col("x0")).cast("bigint").alias(name))


def mask_box(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Tight box of each mask, right and bottom exclusive."""
    return runs.groupBy(*keys).agg(
        F.min("x0").cast("double").alias("x1_min"), F.min("y").cast("double").alias("y1_min"),
        F.max("x1").cast("double").alias("x2_max"), (F.max("y") + 1).cast("double").alias("y2_max"),
    )


def mask_iou(a: DataFrame, b: DataFrame, on: list[str], a_id: str, b_id: str) -> DataFrame:
    """IoU of every mask pair of ``a`` and ``b`` that share ``on`` and at least one pixel.

    Inputs are disjoint runs per mask.  Pairs without a common pixel have IoU 0 and are left out.
    """
    x = a.select(*on, "y", F.col(a_id).alias("_a"), F.col("x0").alias("_a0"), F.col("x1").alias("_a1"))
    y = b.select(*on, "y", F.col(b_id).alias("_b"), F.col("x0").alias("_b0"), F.col("x1").alias("_b1"))
    met = x.join(y, [*on, "y"]).where((F.col("_a0") < F.col("_b1")) & (F.col("_b0") < F.col("_a1")))
    inter = met.groupBy(*on, "_a", "_b").agg(
        F.sum(F.least("_a1", "_b1") - F.greatest("_a0", "_b0")).cast("bigint").alias("intersection")
    )
    na = pixel_count(a, [*on, a_id], "_na").withColumnRenamed(a_id, "_a")
    nb = pixel_count(b, [*on, b_id], "_nb").withColumnRenamed(b_id, "_b")
    joined = inter.join(na, [*on, "_a"]).join(nb, [*on, "_b"])
    union = F.col("_na") + F.col("_nb") - F.col("intersection")
    return joined.select(
        *on, F.col("_a").alias(a_id), F.col("_b").alias(b_id), "intersection", union.alias("union_pixels"),
        (F.col("intersection") / union).alias("iou"),
    )


def resize_runs(runs: DataFrame, keys: list[str], src: tuple[int, int], dst: tuple[int, int]) -> DataFrame:
    """Nearest-neighbour resize: target pixel d reads source pixel floor(d * src / dst)."""
    (sw, sh), (dw, dh) = src, dst

    def first(c, s, d):
        # smallest target whose source index reaches c
        return F.ceil(c * d / F.lit(s)).cast("int")

    rows = runs.select(
        *keys, F.expr("x0"), F.expr("x1"), first(F.col("y"), sh, dh).alias("_lo"), first(F.col("y") + 1, sh, dh).alias("_hi")
    ).where(F.col("_lo") < F.col("_hi"))
    out = rows.select(
        *keys, F.explode(F.sequence(F.col("_lo"), F.col("_hi") - 1)).alias("y"),
        first(F.col("x0"), sw, dw).alias("x0"), first(F.col("x1"), sw, dw).alias("x1"),
    )
    return out.where(F.col("x0") < F.col("x1"))


def pyramid(runs: DataFrame, keys: list[str], size: tuple[int, int], factors: tuple[int, ...]) -> DataFrame:
    """The masks at several integer down-scaling factors."""
    levels = [
        resize_runs(runs, keys, size, (size[0] // f, size[1] // f)).withColumn("factor", F.lit(f)) for f in factors
    ]
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


# --- components of one mask: a mask is bounded by its image, so it is a safe unit of work ---

def _raster_runs(mask: np.ndarray):
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    y, x0 = np.nonzero(edge == 1)
    return y, x0, np.nonzero(edge == -1)[1]


_INFO = ("component_count int, largest_component_ratio double, kept_component_count int, "
         "filled_hole_count int, filled_hole_pixels int")


def clean_components(runs: DataFrame, keys: list[str], width: int, height: int, keep=cfg.MAX_COMPONENTS,
                     ratio=cfg.MIN_COMPONENT_RATIO, max_hole=cfg.MAX_HOLE_PIXELS) -> DataFrame:
    """Largest components of each mask with small enclosed holes filled, plus summary columns."""
    lines = ri.Lines(width, height)

    def unite(image, c, images):
        return _rows(lines, *ri.union(*lines.place(image, c["y"], c["x0"], c["x1"])))

    def work(image, c, images):
        united = ri.union(*lines.place(image, c["y"], c["x0"], c["x1"]))
        p0, p1, info = lines.clean(*united, images, keep, ratio, cfg.MIN_COMPONENT_PIXELS, max_hole)
        at, out = _rows(lines, p0, p1)
        return at, {**out, **{n: _typed(v[at]) for n, v in info.items()}}

    return ri.by_image(_plain(runs, keys), keys, [], work, f"y int, x0 int, x1 int, {_INFO}", unite)


def _typed(values: np.ndarray) -> np.ndarray:
    return values if values.dtype.kind == "f" else values.astype("int32")


def own_pixels(candidates: DataFrame, runs: DataFrame, width: int, height: int,
               min_remaining=cfg.MIN_REMAINING) -> DataFrame:
    """Greedy pixel ownership inside each frame, best quality*priority first.

    ``candidates``: scan_id, frame_index, mask_id, rank_score, ordinal.  One output row per owned
    run, or one row with null runs and a reason for a rejected candidate.  A frame is bounded by
    its image and its candidates, so frames are the parallel unit.
    """
    keys, frame = ["scan_id", "frame_index", "mask_id"], ["scan_id", "frame_index"]
    lines = ri.Lines(width, height)
    best = W.partitionBy(*frame).orderBy(F.col("rank_score").desc_nulls_last(), F.col("ordinal").asc_nulls_last(), "mask_id")
    places = candidates.select(*keys, F.nanvl("rank_score", F.lit(None).cast("double")).alias("rank_score"), "ordinal").dropDuplicates(keys).select(
        *keys, F.row_number().over(best).alias("place"))
    # places travel as rows without a run, so runs are shuffled once and met in their frame
    rows = _plain(runs, keys).withColumn("place", F.lit(None).cast("int")).unionByName(places, allowMissingColumns=True)
    rows = rows.select(*frame, "mask_id", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("y", "x0", "x1", "place")]).withColumn(
        "_mask", F.xxhash64("mask_id"))
    mask_type = runs.schema["mask_id"].dataType.simpleString()
    schema = f"mask_id {mask_type}, y int, x0 int, x1 int, remaining_after_overlap double, rejection_reason string, {_INFO}"
    info_names = [c.strip().split()[0] for c in _INFO.split(",")]

    def work(image, c, images):
        listed = c["place"] > 0
        # the rows of a mask follow each other, the one with its place first
        group = np.cumsum(np.r_[True, (image[1:] != image[:-1]) | (c["_mask"][1:] != c["_mask"][:-1])]) - 1
        place, at_row, of_frame = (np.zeros(group[-1] + 1, dtype="int64") for _ in range(3))
        place[group[listed]], at_row[group[listed]], of_frame[group] = c["place"][listed], np.flatnonzero(listed), image
        use = ~listed & (place[group] > 0)
        image, group, y, x0, x1 = image[use], group[use], c["y"][use], c["x0"][use], c["x1"][use]
        owned = place[group]
        order = np.argsort(owned, kind="stable")
        bounds = np.r_[np.flatnonzero(np.r_[True, np.diff(owned[order]) > 0]), len(order)] if len(order) else np.zeros(1, dtype="int64")
        taken = (np.zeros(0, dtype="int64"), np.zeros(0, dtype="int64"))
        parts = []
        # the n-th candidates of all frames at once: one mask of a frame at a time
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            pick = order[lo:hi]
            mine = np.zeros(images, dtype="int64")
            mine[image[pick]] = group[pick]
            full = ri.union(*lines.place(image[pick], y[pick], x0[pick], x1[pick]))
            here = np.unique(lines.image(full[0]))
            p0, p1 = ri.union(*ri.subtract(full, taken))
            original = np.bincount(lines.image(full[0]), full[1] - full[0], images)
            left = np.bincount(lines.image(p0), p1 - p0, images) / np.maximum(original, 1)
            passed = left >= min_remaining
            stay = passed[lines.image(p0)]
            p0, p1, info = lines.clean(p0[stay], p1[stay], images, cfg.MAX_COMPONENTS, cfg.MIN_COMPONENT_RATIO, cfg.MIN_COMPONENT_PIXELS, cfg.MAX_HOLE_PIXELS)
            taken = ri.union(np.concatenate([taken[0], p0]), np.concatenate([taken[1], p1]))
            at, runs_ = _rows(lines, p0, p1)
            parts.append({"mask": mine[at], **runs_, "remaining_after_overlap": left[at], "reason": np.zeros(len(at), dtype="int8"),
                          **{n: _typed(v[at]) for n, v in info.items()}})
            lost = here[~np.isin(here, at)]
            parts.append({"mask": mine[lost], **{n: np.zeros(len(lost), dtype="int32") for n in ("y", "x0", "x1")}, "remaining_after_overlap": left[lost],
                          "reason": np.where(passed[lost], 2, 1).astype("int8"), **{n: np.zeros(len(lost), dtype=v.dtype) for n, v in info.items()}})
        names = ["mask", "y", "x0", "x1", "remaining_after_overlap", "reason", *info_names]
        out = {n: np.concatenate([p[n] for p in parts]) if parts else np.zeros(0, dtype="int64") for n in names}
        rejected = out["reason"] > 0
        made = {"mask_id": at_row[out["mask"]]}
        for n in ("y", "x0", "x1", "remaining_after_overlap", *info_names):
            kind = pa.float64() if n.startswith(("remaining", "largest")) else pa.int32()
            made[n] = pa.array(out[n], kind, mask=None if n.startswith("remaining") else rejected)
            if n == "remaining_after_overlap":
                reasons = np.array([None, "overlap_dominated", "empty_after_overlap"], dtype=object)
                made["rejection_reason"] = pa.array(reasons[out["reason"]], pa.string())
        return of_frame[out["mask"]], made

    return ri.by_image(rows, frame, ["mask_id", F.col("place").desc()], work, schema, carry="mask_id")


def arbitrate_structure(scores: DataFrame, objects: DataFrame, width: int, height: int) -> DataFrame:
    """Structural masks from per-pixel class probabilities.

    ``scores``: scan_id, frame_index, label, y, x, score, predicted (label of the pixel's top class).
    ``objects``: confident object runs that cut the structure.  Returns runs of the accepted
    (scan, frame, label) masks with ``area_fraction`` and ``accepted``.
    """
    from splatlake.functions.weights import literal_map

    keys = ["scan_id", "frame_index", "label"]
    gate = literal_map(cfg.STRUCTURE_MIN_PROBABILITY, F.col("label"), 2.0)
    raw = scores.where(F.col("predicted") & (F.col("score") >= gate)).select(
        *keys, "y", F.col("x").alias("x0"), (F.col("x") + 1).alias("x1")
    )
    listed = scores.select(*keys).distinct()
    clean = close_open(raw, listed, keys, width, height)
    pixels = clean.select(*keys, "y", F.explode(F.sequence(F.col("x0"), F.col("x1") - 1)).alias("x"))
    rank = literal_map({label: -i for i, label in enumerate(cfg.STRUCTURE_LABELS)}, F.col("label"), -99)
    won = (
        pixels.join(scores.select(*keys, "y", "x", "score"), [*keys, "y", "x"], "left")
        .groupBy("scan_id", "frame_index", "y", "x")
        .agg(F.max_by("label", F.struct(F.coalesce("score", F.lit(0.0)), rank)).alias("label"))
    )
    single = won.select(*keys, "y", F.col("x").alias("x0"), (F.col("x") + 1).alias("x1"))
    free = subtract_runs(union_runs(single, keys), objects, ["scan_id", "frame_index"], keys)
    area = pixel_count(free, keys)
    minimum = literal_map(cfg.STRUCTURE_MIN_AREA, F.col("label"), 0.0)
    frac = F.col("pixels") / F.lit(float(width * height))
    judged = area.select(*keys, frac.alias("area_fraction"), (frac >= minimum).alias("accepted"))
    return free.join(judged, keys)


def overlap_stats(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels a mask lost and the share that remains."""
    b, a = pixel_count(before, keys, "before_pixels"), pixel_count(after, keys, "after_pixels")
    kept = F.coalesce("after_pixels", F.lit(0).cast("bigint"))
    return b.join(a, keys, "left").select(
        *keys, "before_pixels", (F.col("before_pixels") - kept).alias("suppressed_pixels"),
        (kept / F.greatest(F.col("before_pixels"), F.lit(1))).alias("remaining_ratio"),
    )


def suppressed_by_label(stats: DataFrame, masks: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels lost and share kept per scan and label, from :func:`overlap_stats`."""
    j = stats.join(masks.select(*keys, "label").distinct(), keys)
    g = j.groupBy("scan_id", "label").agg(F.count("*").alias("masks"), F.sum("suppressed_pixels").alias("suppressed_pixels"), F.sum("before_pixels").alias("_b"))
    return g.withColumn("remaining_ratio", 1 - F.col("suppressed_pixels") / F.greatest(F.col("_b"), F.lit(1))).drop("_b")


def agreement(pilot: DataFrame, pilot_runs: DataFrame, primary_runs: DataFrame, min_score: float = cfg.AGREEMENT_SCORE) -> DataFrame:
    """Best IoU of each pilot mask with primary masks of its label and frame; null when none exists."""
    on = ["scan_id", "frame_index", "label"]
    p = primary_runs.withColumnRenamed("mask_id", "primary_id")
    best = mask_iou(pilot_runs, p, on, "mask_id", "primary_id").groupBy(*on, "mask_id").agg(F.max("iou").alias("_iou"))
    listed = p.select(*on).distinct().withColumn("_some", F.lit(True))
    j = pilot.where(F.col("score") >= min_score).join(listed, on, "left").join(best, [*on, "mask_id"], "left")
    return j.withColumn("agreement", F.when(F.col("_some"), F.coalesce("_iou", F.lit(0.0)))).drop("_some", "_iou")


def mask_metrics(logits: DataFrame, kept: DataFrame, keys: list[str], image_pixels: int, threshold: float = 0.0,
                 offset: float = 1.0) -> DataFrame:
    """Stability over the raw logits; size and mean sigmoid over the cleaned mask ``kept``."""
    px = kept.select(*keys, "y", F.explode(F.sequence(F.col("x0"), F.col("x1") - 1)).alias("x"), F.lit(True).alias("_in"))
    j = logits.join(px, [*keys, "y", "x"], "left")
    sig = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-20.0), F.least(F.lit(20.0), F.col("logit")))))
    low = F.count(F.when(F.col("logit") > threshold - offset, 1))
    high = F.count(F.when(F.col("logit") > threshold + offset, 1))
    n = F.count(F.when(F.col("_in"), 1))
    return j.groupBy(*keys).agg(
        F.when(low > 0, high / low).otherwise(F.lit(0.0)).alias("stability"),
        F.coalesce(F.avg(F.when(F.col("_in"), sig)), F.lit(0.0)).alias("positive_conf"),
        n.alias("pixel_count"), (n / F.lit(float(image_pixels))).alias("area_fraction"),
    )
