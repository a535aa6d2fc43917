"""Instance tracks: association, limits, naming, mask candidates, states and support gates."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F, Window as W

from splatlake import config as cfg
from splatlake.functions import boxes
from splatlake.functions.text import normalize_label
from splatlake.functions.weights import literal_map
from splatlake.operators.ordered import stream_groups
from splatlake.operators.skew import ordered_rank, spread_join

KEY = ["scan_id", "label"]

# --- fixed values: reasons of the support gate after overlap
SUPPORT_REASON, STATE_REASON = "insufficient_visible_track_frames_after_overlap", "track_removed_below_minimum_visible_frames_after_overlap"


def pair_score(a, b, width: float, height: float):
    """Association score of two corner tuples, or None when the pair does not pass."""
    ix = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    sa, sb = (max(0.0, t[2] - t[0]) * max(0.0, t[3] - t[1]) for t in (a, b))
    union = sa + sb - ix
    iou = ix / union if union > 0 else 0.0
    gap = math.hypot((a[0] + a[2]) / 2 - (b[0] + b[2]) / 2, (a[1] + a[3]) / 2 - (b[1] + b[3]) / 2)
    dist = gap / max(1.0, math.hypot(width, height))
    ratio = min(sa, sb) / max(sa, sb) if sa > 0 and sb > 0 else 0.0
    if iou >= cfg.TRACK_IOU or (dist <= cfg.TRACK_DISTANCE and ratio >= cfg.TRACK_AREA_RATIO):
        return 0.60 * iou + 0.25 * max(0.0, 1.0 - dist) + 0.15 * ratio
    return None


class OpenTracks:
    """Open tracks of one label: the only state association needs."""

    def __init__(self):
        self.tracks: list[list] = []  # [track id, last frame, corners], oldest first

    def add(self, frame, box, detection_id, width, height, max_gap=cfg.MAX_ANCHOR_GAP):
        self.tracks = [t for t in self.tracks if frame - t[1] <= max_gap]
        best, best_score = None, None
        for t in self.tracks:
            if t[1] >= frame:
                continue  # a track takes one detection per frame
            score = pair_score(box, t[2], width, height)
            if score is not None and (best_score is None or score >= best_score):
                best, best_score = t, score  # equal scores: the newest track wins
        if best is None:
            best = [detection_id, frame, box]
            self.tracks.append(best)
        else:
            best[1], best[2] = frame, box
        return best[0]


def associate(detections: DataFrame, max_gap: int = cfg.MAX_ANCHOR_GAP) -> DataFrame:
    """Adds ``temp_track``: the detection id that opened the track.

    Tracks never bridge more than ``max_gap`` frames, so each (scan, label) is cut at longer
    silences, found on its distinct frames; the pieces advance in parallel.
    """
    seen = detections.select(*KEY, "frame_index").distinct()
    w = W.partitionBy(*KEY).orderBy("frame_index")
    new = (F.col("frame_index") - F.lag("frame_index").over(w) > max_gap).cast("int")
    pieces = seen.withColumn("_new", F.coalesce(new, F.lit(0))).withColumn("piece", F.sum("_new").over(w)).drop("_new")
    d = detections.join(pieces, [*KEY, "frame_index"])

    def step(state, r):
        return (state.add(r.frame_index, (r.x1, r.y1, r.x2, r.y2), r.detection_id, r.width, r.height, max_gap),)

    order = [F.col("frame_index"), F.col("confidence").desc(), F.col("detection_id")]
    return stream_groups(d, [*KEY, "piece"], order, OpenTracks, step, ["temp_track"], "temp_track bigint").drop("piece")


def equal_boxes(detections: DataFrame) -> DataFrame:
    """One row for all detections of a label with the same frame and box: its least ``detection_id``, ``members`` and the sum of their ids."""
    same = [*KEY, "width", "height", "frame_index", "x1", "y1", "x2", "y2"]
    return detections.groupBy(*same).agg(F.min("detection_id").alias("detection_id"), F.count("*").alias("members"), F.sum("detection_id").alias("id_sum"))


def candidate_pairs(detections: DataFrame, max_gap: int = cfg.MAX_ANCHOR_GAP, carry: tuple[str, ...] = ()) -> DataFrame:
    """Scored pairs of consecutive-anchor detections of one label that pass the association test.

    A pair is a gap of 1 to ``max_gap`` frames apart, whatever the anchor stride: pairs of frames are found
    first, on distinct frames cut into spans of ``max_gap``, so that only boxes of such frames meet.  Over
    :func:`equal_boxes` these are pairs of representatives; columns that ``carry`` names come back, those of
    the earlier box as ``previous_<name>``.
    """
    span = F.floor(F.col("frame_index") / max_gap)
    seen = detections.select(*KEY, "frame_index").distinct()
    later = seen.select(*KEY, "frame_index", F.explode(F.array(span, span - 1)).alias("_span"))
    gap = F.col("frame_index") - F.col("_prev")
    near = later.join(seen.select(*KEY, F.col("frame_index").alias("_prev"), span.alias("_span")), [*KEY, "_span"]).where((gap > 0) & (gap <= max_gap)).drop("_span")
    # what one box decides is taken before the join, and a pair costs a few operations
    b = boxes.box("x1", "y1", "x2", "y2")
    sides = {"x1": F.col("x1"), "y1": F.col("y1"), "x2": F.col("x2"), "y2": F.col("y2"), "area": boxes.area(b),
             "cx": (F.col("x1") + F.col("x2")) / 2, "cy": (F.col("y1") + F.col("y2")) / 2}
    diagonal = F.greatest(F.lit(1.0), F.sqrt(F.col("width") * F.col("width") + F.col("height") * F.col("height")))
    a = detections.select(*KEY, "frame_index", "detection_id", *carry, diagonal.alias("_diagonal"), *[c.alias(f"_a_{n}") for n, c in sides.items()])
    p = detections.select(*KEY, F.col("frame_index").alias("_prev"), F.col("detection_id").alias("previous_id"),
                          *[F.col(c).alias(f"previous_{c}") for c in carry], *[c.alias(f"_p_{n}") for n, c in sides.items()])
    # few boxes make many pairs: all tasks share them, whatever the size of the tables
    on, tasks = [*KEY, "_prev"], int(detections.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = spread_join(spread_join(a, near, [*KEY, "frame_index"]).repartition(tasks, *on), p.repartition(tasks, *on), on)
    wide = "greatest(0D, least(_a_x2, _p_x2) - greatest(_a_x1, _p_x1)) * greatest(0D, least(_a_y2, _p_y2) - greatest(_a_y1, _p_y1))"
    kept = [*KEY, "detection_id", "previous_id", *carry, *[f"previous_{c}" for c in carry]]
    # one-row generators keep each measure from being repeated wherever a later one reads it
    met = met.selectExpr(*kept, "frame_index - _prev AS gap", "_a_area", "_p_area",
                         f"inline(array(named_struct('_inter', {wide}, '_dx', _a_cx - _p_cx, '_dy', _a_cy - _p_cy, '_diagonal', _diagonal)))")
    met = met.selectExpr(*kept, "gap", "inline(array(named_struct('_iou', CASE WHEN _a_area + _p_area - _inter > 0 THEN _inter / (_a_area + _p_area - _inter) ELSE 0D END, "
                         "'_dist', sqrt(_dx * _dx + _dy * _dy) / _diagonal, "
                         "'_ratio', CASE WHEN _a_area > 0 AND _p_area > 0 THEN least(_a_area, _p_area) / greatest(_a_area, _p_area) ELSE 0D END)))")
    iou, dist, ratio = F.col("_iou"), F.col("_dist"), F.col("_ratio")
    passes = (iou >= cfg.TRACK_IOU) | ((dist <= cfg.TRACK_DISTANCE) & (ratio >= cfg.TRACK_AREA_RATIO))
    score = 0.60 * iou + 0.25 * F.greatest(F.lit(0.0), 1.0 - dist) + 0.15 * ratio
    return met.where(passes).withColumn("score", score).drop("_iou", "_dist", "_ratio")


def track_summary(associated: DataFrame, add_by: str | None = None) -> DataFrame:
    """Anchor count, span and confidences per track; ``accepted`` when persistent or strong.

    The mean is taken over decimals of 12 places, so it does not depend on the order of the rows and
    equal means tie; values that do not fit (not finite, 10^8 or more) leave the plain mean.  ``add_by``
    names a column in whose order the doubles are added instead, as a scan of a table in that order adds them.
    """
    first = F.min(F.struct("frame_index", "x1"))
    c = F.col("confidence")
    exact = c.try_cast("decimal(20,12)")
    mean = F.when(F.count(exact) == F.count(c), F.sum(exact).cast("double") / F.count(c)).otherwise(F.avg(c))
    if add_by is not None:
        listed = F.sort_array(F.collect_list(F.when(c.isNotNull(), F.struct(F.col(add_by).alias("at"), c.cast("double").alias("c")))))
        mean = F.try_divide(F.aggregate(listed, F.lit(0.0), lambda total, x: total + x["c"]), F.count(c))
    s = associated.groupBy(*KEY, "temp_track").agg(
        F.count("*").alias("anchor_count"), F.min("frame_index").alias("first_anchor_frame"),
        F.max("frame_index").alias("last_anchor_frame"), mean.alias("mean_conf"),
        F.max("confidence").alias("max_conf"), first["x1"].alias("first_x1"),
    )
    keep = (F.col("anchor_count") >= cfg.TRACK_MIN_ANCHORS) | (F.col("max_conf") >= cfg.TRACK_STRONG_SINGLE)
    return s.withColumn("rejection_reason", F.when(~keep, F.lit("insufficient_anchor_persistence")))


def cap_instances(tracks: DataFrame) -> DataFrame:
    """Adds a rejection reason to tracks beyond the label's instance limit (best first)."""
    good = tracks.where(F.col("rejection_reason").isNull()).drop("rejection_reason")
    order = [F.col("anchor_count").desc(), F.col("mean_conf").desc(),
             (F.col("last_anchor_frame") - F.col("first_anchor_frame")).desc(), F.col("temp_track")]
    ranked = ordered_rank(good, KEY, order, "_rank")
    limit = literal_map(cfg.MAX_INSTANCES, F.col("label"), cfg.DEFAULT_MAX_INSTANCES)
    over = F.when(F.col("_rank") > limit, F.lit("maximum_instances_for_label"))
    capped = ranked.withColumn("rejection_reason", over).drop("_rank", "_rank_total")
    return capped.unionByName(tracks.where(F.col("rejection_reason").isNotNull()))


def number_tracks(tracks: DataFrame) -> DataFrame:
    """Stable ids in order of first frame, label and left edge: global per scan and per label."""
    order = [F.col("first_anchor_frame"), F.col("label"), F.col("first_x1"), F.col("temp_track")]
    g = ordered_rank(tracks, ["scan_id"], order, "sam_object_id").drop("sam_object_id_total")
    n = ordered_rank(g, KEY, [F.col("sam_object_id")], "_n").drop("_n_total")
    return n.withColumn("track_id", F.format_string("%s_%03d", F.col("label"), F.col("_n"))).drop("_n")


def nearest_anchor(frames: DataFrame, anchors: DataFrame, on: list[str]) -> DataFrame:
    """Distance and frame of the anchor nearest to each row; the first anchor wins a tie.

    Rows and anchors are read in frame order once: the nearest anchor is the last one before or the
    first one after, so no row meets more than two anchors.
    """
    a = anchors.select(*on, F.col("frame_index").alias("anchor_frame"), "ordinal").groupBy(*on, "anchor_frame").agg(F.min("ordinal").alias("ordinal"))
    rows = frames.select(*on, "frame_index").distinct().withColumn("anchor", F.lit(None).cast("struct<f:int,o:int>"))
    marks = a.select(*on, F.col("anchor_frame").alias("frame_index"), F.struct(F.col("anchor_frame").alias("f"), F.col("ordinal").alias("o")).alias("anchor"))
    both = rows.unionByName(marks)
    w = W.partitionBy(*on).orderBy("frame_index")
    near = both.select(
        *on, "frame_index", "anchor",
        F.last("anchor", ignorenulls=True).over(w.rangeBetween(W.unboundedPreceding, 0)).alias("_b"),
        F.first("anchor", ignorenulls=True).over(w.rangeBetween(0, W.unboundedFollowing)).alias("_a"),
    ).where(F.col("anchor").isNull())

    def dist(c):
        return F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.f") - F.col("frame_index")).alias("d"), F.col(f"{c}.o").alias("o"), F.col(f"{c}.f").alias("f")))

    best = F.least(dist("_b"), dist("_a"))
    return near.select(*on, "frame_index", best["d"].alias("nearest_anchor_distance"), best["f"].alias("nearest_anchor_frame"))


def merge_directions(forward: DataFrame, reverse: DataFrame, tracks: DataFrame, ious: DataFrame) -> DataFrame:
    """One candidate per (scan, frame, object) from forward and reverse propagation.

    The better of .6 stability + .4 confidence wins (forward on a tie); quality mixes the track's
    confidence with stability, confidence and the two-way IoU (a default when only one exists).
    """
    keys = ["scan_id", "frame_index", "sam_object_id"]
    mix = 0.60 * F.col("stability") + 0.40 * F.col("positive_conf")
    both = forward.withColumn("_d", F.lit(1)).unionByName(reverse.withColumn("_d", F.lit(0)))
    data = F.struct(*[c for c in forward.columns if c not in keys])
    picked = both.groupBy(*keys).agg(F.max_by(data, F.struct(mix, F.col("_d"))).alias("c"), F.max("_d").alias("f"), F.min("_d").alias("r"))
    j = picked.join(ious, keys, "left").join(
        tracks.select("scan_id", "sam_object_id", "track_id", "label", "mean_conf"), ["scan_id", "sam_object_id"])
    two = F.when((F.col("f") == 1) & (F.col("r") == 0), F.coalesce("iou", F.lit(0.0)))
    quality = (0.30 * F.col("mean_conf") + 0.25 * F.col("c.stability") + 0.20 * F.col("c.positive_conf")
               + 0.25 * F.coalesce(two, F.lit(cfg.DEFAULT_AGREEMENT)))
    return j.select(*keys, "track_id", "label", "c.*", two.alias("bidirectional_iou"),
                    F.greatest(F.lit(0.0), F.least(F.lit(1.0), quality)).alias("quality_score"))


def gate_masks(cands: DataFrame, tracks: DataFrame, anchors: DataFrame) -> DataFrame:
    """Adds ``rejection_reasons`` (all that apply, ``;``-joined, null = accepted)."""
    j = cands.join(tracks.select("scan_id", "sam_object_id", "first_anchor_frame", "last_anchor_frame"), ["scan_id", "sam_object_id"])
    exact = anchors.groupBy("scan_id", "sam_object_id", "frame_index").agg(
        F.min_by(boxes.box("x1", "y1", "x2", "y2"), "ordinal").alias("_anchor"))
    j = j.join(exact, ["scan_id", "sam_object_id", "frame_index"], "left")
    largest = literal_map(cfg.MAX_MASK_FRACTION, F.col("label"), cfg.DEFAULT_MAX_FRACTION)
    m = cfg.VISIBILITY_MARGIN
    tests = [
        (F.col("area_fraction") < cfg.MIN_MASK_FRACTION, "mask_too_small"),
        (F.col("area_fraction") > largest, "mask_too_large"),
        (F.col("stability") < cfg.MIN_STABILITY, "low_sam_stability"),
        (F.col("quality_score") < cfg.MIN_QUALITY, "low_combined_mask_quality"),
        (F.col("largest_component_ratio") < cfg.MIN_LARGEST_COMPONENT, "fragmented_mask"),
        (F.col("bidirectional_iou") < cfg.MIN_BIDIRECTIONAL_IOU, "low_bidirectional_agreement"),
        ((F.col("frame_index") < F.col("first_anchor_frame") - m) | (F.col("frame_index") > F.col("last_anchor_frame") + m),
         "outside_anchor_visibility_window"),
        (boxes.iou(boxes.box("x1", "y1", "x2", "y2"), F.col("_anchor")) < cfg.MIN_ANCHOR_BOX_IOU, "anchor_mask_box_mismatch"),
    ]
    tests[-1] = (F.col("_anchor").isNotNull() & tests[-1][0], tests[-1][1])
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in tests]))
    return j.withColumn("rejection_reasons", F.when(F.size(reasons) > 0, F.array_join(reasons, ";"))).drop(
        "_anchor", "first_anchor_frame", "last_anchor_frame")


def area_jumps(cands: DataFrame, ratio: float = cfg.MAX_AREA_JUMP) -> DataFrame:
    """Adds ``area_jump``: the worse one of two adjacent frames whose areas differ too much.

    Adjacent rows meet by an equi-join on frame + 1; the original sequence decides, no cascade.
    """
    key = ["scan_id", "track_id"]
    a = cands.select(*key, "frame_index", F.col("area_fraction").alias("a1"), F.col("quality_score").alias("q1"))
    b = cands.select(*key, (F.col("frame_index") - 1).alias("frame_index"), F.col("area_fraction").alias("a2"), F.col("quality_score").alias("q2"))
    jump = F.greatest("a1", "a2") / F.greatest(F.least("a1", "a2"), F.lit(1e-12)) > ratio
    pairs = a.join(b, [*key, "frame_index"]).where(jump)
    lost = pairs.select(*key, F.when(F.col("q1") < F.col("q2"), F.col("frame_index")).otherwise(F.col("frame_index") + 1).alias("frame_index")).distinct()
    return cands.join(lost.withColumn("area_jump", F.lit(True)), [*key, "frame_index"], "left").na.fill(False, ["area_jump"])


def support_gate(rows: DataFrame, min_frames: int = cfg.MIN_VISIBLE_FRAMES) -> DataFrame:
    """Adds the track's accepted frame count and ``supported``."""
    n = rows.groupBy("scan_id", "track_id").agg(F.count("*").alias("visible_frames"))
    return rows.join(n, ["scan_id", "track_id"]).withColumn("supported", F.col("visible_frames") >= min_frames)


def suppress_after_overlap(records: DataFrame, states: DataFrame, min_frames: int = cfg.MIN_VISIBLE_FRAMES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The support gate after overlap: (records with ``rejection_reasons``, rewritten states, suppressed tracks).

    ``records``: scan_id, frame_index, track_id, label, role, accepted, state and more; ``states``:
    scan_id, frame_index, label, state, reason.  A track with fewer than ``min_frames`` published
    records (tracked object, accepted, visible) loses all its records.  In their frames a label
    becomes unknown unless a published record of it remains; a label without a state row gets one.
    A track that has no published record, and records without a track, stay as they are.
    """
    labelled = records.withColumn("_label", normalize_label("label"))
    published = F.coalesce((F.col("role") == "tracked_object") & F.col("accepted") & (F.col("state") == "visible"), F.lit(False))
    has_track = F.coalesce(F.col("track_id") != "", F.lit(False))
    named, free = labelled.where(has_track), labelled.where(~has_track)
    counted = named.groupBy("scan_id", "track_id").agg(
        F.count(F.when(published, 1)).alias("published_visible_frames"), F.count("*").alias("removed_mask_count"),
        F.max(F.when(published, F.struct("frame_index", "_label")))["_label"].alias("label"))
    few = counted.where(F.col("published_visible_frames").between(1, min_frames - 1))
    suppressed = few.select("scan_id", "track_id", "label", "published_visible_frames", F.lit(min_frames).alias("minimum_visible_frames"),
                            "removed_mask_count", F.lit(SUPPORT_REASON).alias("reason"))
    marks = few.select("scan_id", "track_id", F.lit(SUPPORT_REASON).alias("rejection_reasons"))
    # records without a track share one empty key and take no part in the join
    marked = named.join(marks, ["scan_id", "track_id"], "left").unionByName(free.withColumn("rejection_reasons", F.lit(None).cast("string")))
    removed = F.col("rejection_reasons").isNotNull()
    lost = marked.groupBy("scan_id", "frame_index", F.col("_label").alias("label")).agg(F.max(removed).alias("_lost"), F.max(published & ~removed).alias("_left"))
    lost = lost.where("_lost AND NOT _left AND label IS NOT NULL").select("scan_id", "frame_index", "label", F.lit(True).alias("_lost"))
    rewritten = states.join(lost, ["scan_id", "frame_index", "label"], "full")
    columns = {"state": F.when(F.col("_lost"), F.lit("unknown")).otherwise(F.col("state")), "reason": F.when(F.col("_lost"), F.lit(STATE_REASON)).otherwise(F.col("reason"))}
    return marked.drop("_label"), rewritten.withColumns(columns).drop("_lost"), suppressed


def label_states(frames: DataFrame, labels: DataFrame, visible: DataFrame, rejected: DataFrame, anchors: DataFrame,
                 detected: DataFrame) -> DataFrame:
    """Visible / absent / unknown with a reason for every (frame, label)."""
    key = ["scan_id", "frame_index", "label"]
    w = W.partitionBy("scan_id").orderBy("frame_index")
    order = anchors.select("scan_id", "frame_index").distinct().select(
        "scan_id", "frame_index", F.lit(True).alias("is_anchor"),
        F.lag("frame_index").over(w).alias("prev"), F.lead("frame_index").over(w).alias("next"))
    grid = frames.select("scan_id", "frame_index").withColumn("label", F.explode(F.array(*[F.lit(r) for r in labels]))) \
        if isinstance(labels, list) else frames.select("scan_id", "frame_index").join(labels, "scan_id")
    g = grid.join(order, ["scan_id", "frame_index"], "left")

    def flag(df, name, frame="frame_index"):
        return df.select("scan_id", F.col("frame_index").alias(frame), "label").distinct().withColumn(name, F.lit(True))

    g = g.join(flag(visible, "v"), key, "left").join(flag(rejected, "r"), key, "left").join(flag(detected, "d"), key, "left")
    g = g.join(flag(detected, "dp", "prev"), ["scan_id", "prev", "label"], "left").join(flag(detected, "dn", "next"), ["scan_id", "next", "label"], "left")
    boundary = F.col("prev").isNull() | F.col("next").isNull()
    clear = F.col("dp").isNull() & F.col("dn").isNull()
    reason = (
        F.when(F.col("v"), F.lit("accepted_tracked_mask")).when(F.col("r"), F.lit("tracked_candidate_rejected_by_quality_gate"))
        .when(F.col("is_anchor").isNull(), F.lit("not_a_detector_anchor")).when(F.col("d"), F.lit("detected_but_mask_rejected"))
        .when(boundary, F.lit("boundary_anchor_without_two_sided_evidence"))
        .when(clear, F.lit("three_consecutive_anchor_misses")).otherwise(F.lit("neighboring_anchor_evidence_disagrees"))
    )
    state = F.when(reason == "accepted_tracked_mask", F.lit("visible")).when(
        reason == "three_consecutive_anchor_misses", F.lit("absent")).otherwise(F.lit("unknown"))
    return g.select(*key, state.alias("state"), reason.alias("reason"))
