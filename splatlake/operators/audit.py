"""Audits, batch bookkeeping and evaluation metrics as tables of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from splatlake.operators import masks as ma
from splatlake.operators.quantiles import attach, exact_quantiles
from splatlake.operators.skew import ordered_rank

SURFACE = ["wall", "floor", "ceiling"]
# --- fixed values: batch policy -----------------------------------------------------------
OBJECT_ROLE, OBJECT_SOURCE = "tracked_object", "grounding_dino_sam2_video"
STRUCTURE_ROLE, STRUCTURE_SOURCE = "semantic_room_structure", "segformer_ade_structural"
STRUCTURE_SOURCE_PREFIXES = ["semantic_layout_", "strict_2d_layout_"]
STRUCTURE_SOURCES = ["layout_from_floor_ceiling_object_masks", "segformer_ade_structural"]
MIN_INSTANCE_FRAMES = 5
CLEANUP_MIN_POINTS, CLEANUP_MIN_COMPLETENESS = 500, 0.70


def summarize(df: DataFrame, value: str, by: list[str], with_std: bool = False) -> DataFrame:
    """Count, min, quartiles, max and mean per group; non-numeric and non-finite values drop out."""
    v = F.col(value).try_cast("double")
    v = F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)
    aggs = [F.count(v).alias("count"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean")]
    if with_std:
        aggs.append(F.stddev_pop(v).alias("std"))
    g = attach(df.groupBy(*by).agg(*aggs), exact_quantiles(df.select(*by, v.alias("v")), by, {"v": [0.25, 0.5, 0.75]}), by)
    return g.withColumns({"p25": F.col("q_v")[0], "median": F.col("q_v")[1], "p75": F.col("q_v")[2]}).drop("q_v")


def is_structural(role: Column, source: Column) -> Column:
    s = F.coalesce(source, F.lit(""))
    prefix = F.lit(False)
    for p in STRUCTURE_SOURCE_PREFIXES:
        prefix = prefix | s.startswith(p)
    return role.eqNullSafe(STRUCTURE_ROLE) | prefix | s.isin(STRUCTURE_SOURCES)


def authoritative(label: Column, accepted: Column, state: Column, role: Column, source: Column) -> Column:
    """Accepted and visible, with the role and source that the label requires."""
    structure = label.isin(SURFACE)
    right = F.when(structure, role.eqNullSafe(STRUCTURE_ROLE) & source.eqNullSafe(STRUCTURE_SOURCE)).otherwise(
        role.eqNullSafe(OBJECT_ROLE) & source.eqNullSafe(OBJECT_SOURCE))
    return accepted.eqNullSafe(True) & state.eqNullSafe("visible") & right


def discover_targets(accepted: DataFrame, allow: list[str], excluded: dict[str, str], explicit: list[str], scans: DataFrame | None = None) -> DataFrame:
    """Decision and reason for every accepted or requested label of a scan; ``scans`` adds those without any accepted label."""
    asked = F.array(*[F.lit(e) for e in explicit]).cast("array<string>")
    every = accepted.select("scan_id", "label").distinct().withColumn("accepted_label", F.lit(True))
    extra = (every if scans is None else scans).select("scan_id").distinct().select("scan_id", F.explode(asked).alias("label"))
    j = every.join(extra.withColumn("_x", F.lit(True)), ["scan_id", "label"], "full_outer")
    has = F.coalesce("accepted_label", F.lit(False))
    lab = F.col("label")
    outside = ~lab.isin(explicit) if explicit else F.lit(False)
    decision = (F.when(lab.isin(list(excluded)), "excluded_geometry_policy").when(~lab.isin(allow), "excluded_not_allowlisted")
                .when(outside, "excluded_by_explicit_filter").when(~has, "unavailable").otherwise("selected_volumetric_class"))
    return j.select("scan_id", "label", has.alias("accepted_label"), decision.alias("decision"))


def instance_audit(records: DataFrame, min_frames: int = MIN_INSTANCE_FRAMES) -> DataFrame:
    """Frames and masks per instance, the best instance of each label, and too-short instances."""
    g = records.groupBy("scan_id", "label", "track_id").agg(F.countDistinct("frame_index").alias("frames"), F.count("*").alias("records"))
    best = g.groupBy("scan_id", "label").agg(F.min(F.struct(-F.col("frames"), -F.col("records"), F.col("track_id"))).alias("_b"))
    j = g.join(best, ["scan_id", "label"])
    status = F.when(F.col("frames") < min_frames, F.lit("too_few_frames")).otherwise(F.lit("eligible"))
    return j.select("scan_id", "label", "track_id", "frames", "records", (F.col("track_id") == F.col("_b.track_id")).alias("best"), status.alias("status"))


def key_collisions(keyed: DataFrame) -> DataFrame:
    """Object keys that more than one (label, instance) of a scan produces: (scan_id, object_key, objects)."""
    g = keyed.groupBy("scan_id", "object_key").agg(F.countDistinct("label", "instance_id").alias("objects"))
    return g.where("objects > 1")


def eligible_objects(audit: DataFrame, limit: int | None = None) -> DataFrame:
    """Objects to process in (label, frames desc, key) order; the limit applies per scan."""
    ok = audit.where(F.col("status") == "eligible")
    r = ordered_rank(ok, ["scan_id"], [F.col("label"), F.col("frames").desc(), F.col("track_id")], "position").drop("position_total")
    return r if limit is None else r.where(F.col("position") <= limit)


def dataset_report(frames: DataFrame, runs: DataFrame, image_pixels: int, min_fraction: float = 0.0005) -> DataFrame:
    """Union mask area per frame and its status."""
    px = ma.pixel_count(ma.union_runs(runs, ["scan_id", "frame_index"]), ["scan_id", "frame_index"])
    frac = F.coalesce("pixels", F.lit(0)) / F.lit(float(image_pixels))
    status = F.when(frac == 0, F.lit("included_blank_shared_coordinate_frame")).when(frac < min_fraction, F.lit("mask_too_small")).otherwise(F.lit("included_positive_target_mask"))
    return frames.select("scan_id", "frame_index").join(px, ["scan_id", "frame_index"], "left").select("scan_id", "frame_index", frac.alias("area_fraction"), status.alias("status"))


def audit_parts(frames: DataFrame, records: DataFrame, masks: DataFrame) -> dict[str, DataFrame]:
    """Published records by how far the audit gets with them.

    ``frames``: scan_id, frame_index, has_json, width, height (null for an unreadable image),
    fingerprint, layout_fingerprint; ``records``: scan_id, frame_index, mask_id, label, track_id,
    role, source, accepted, state; ``masks``: scan_id, frame_index, mask_id, width, height of the
    readable ones.  ``told`` are all records of frames that can be checked, ``live`` the accepted and
    visible ones, ``good`` those with a mask of the frame's shape; a record that fails goes no further.
    """
    key, ids = ["scan_id", "frame_index"], ["scan_id", "frame_index", "mask_id"]
    readable = frames.where("has_json AND width IS NOT NULL AND height IS NOT NULL").select(*key, F.col("width").alias("_w"), F.col("height").alias("_h"))
    told = records.join(readable, key).withColumns({c: F.coalesce(c, F.lit("unknown")) for c in ("role", "source")})
    passed = F.col("accepted").eqNullSafe(True) & F.col("state").eqNullSafe("visible")
    told = told.withColumn("_live", passed)
    live = told.where("_live")
    seen = live.join(masks.select(*ids, F.col("width").alias("_mw"), F.col("height").alias("_mh")), ids, "left")
    right = (F.col("_mw") == F.col("_w")) & (F.col("_mh") == F.col("_h"))
    return {"told": told, "live": live, "seen": seen, "good": seen.where(right)}


def overlaps(good: DataFrame, runs: DataFrame, frames: DataFrame) -> DataFrame:
    """Share of a frame's pixels that more than one published mask covers, where there are any."""
    from pyspark.sql import Window as W

    key = ["scan_id", "frame_index"]
    cover = runs.select(*key, "mask_id", "y", "x0", "x1").join(good.select(*key, "mask_id"), [*key, "mask_id"], "left_semi")
    ends = F.array(F.struct(F.col("x0").alias("x"), F.lit(1).alias("d")), F.struct(F.col("x1").alias("x"), F.lit(-1).alias("d")))
    row = W.partitionBy(*key, "y").orderBy("e.x", "e.d")  # one image row: bounded by the masks of a frame
    sweep = cover.select(*key, "y", F.explode(ends).alias("e")).withColumns({
        "_n": F.sum("e.d").over(row.rowsBetween(W.unboundedPreceding, 0)), "_len": F.lead("e.x").over(row) - F.col("e.x")})
    twice = sweep.where("_n > 1").groupBy(*key).agg(F.sum("_len").alias("_px")).where("_px > 0")
    return twice.join(frames.select(*key, "width", "height"), key).select(*key, (F.col("_px") / (F.col("width") * F.col("height"))).alias("overlap_fraction"))


def audit_errors(frames: DataFrame, records: DataFrame, masks: DataFrame, runs: DataFrame, manifests: DataFrame, min_frames: int = 3) -> DataFrame:
    """Problems of published masks: (scan_id, frame_index, error, item), one row per finding.

    Inputs as in :func:`audit_parts`; ``manifests``: scan_id, fingerprint, layout_fingerprint.
    ``frame_index`` is -1 for a track; ``item`` is the mask, the track, or empty for a frame.
    """
    key = ["scan_id", "frame_index"]
    p = audit_parts(frames, records, masks)
    surface, role, source = F.col("label").isin(SURFACE), F.col("role"), F.col("source")

    def rows(df: DataFrame, error: str, item: str | None = "mask_id") -> DataFrame:
        return df.select(*key, F.lit(error).alias("error"), (F.col(item).cast("string") if item else F.lit("")).alias("item"))

    known = frames.where("has_json").join(manifests.select("scan_id", F.col("fingerprint").alias("_f"), F.col("layout_fingerprint").alias("_l")), "scan_id", "left")
    tracked = p["live"].where("track_id IS NOT NULL AND track_id <> ''")
    again = tracked.groupBy(*key, "track_id").agg(F.count("*").alias("_c")).where("_c > 1").withColumn("_k", F.explode(F.sequence(F.lit(2), F.col("_c").cast("int"))))
    short = tracked.groupBy("scan_id", "track_id").agg(F.countDistinct("frame_index").alias("_c")).where(F.col("_c") < min_frames).withColumn("frame_index", F.lit(-1))
    live, seen = p["live"], p["seen"]
    parts = [
        rows(frames.where("NOT has_json"), "missing_detection_json", None),
        rows(known.where(~F.col("fingerprint").eqNullSafe(F.col("_f"))), "tracking_fingerprint_mismatch", None),
        rows(known.where(~F.col("layout_fingerprint").eqNullSafe(F.col("_l"))), "layout_fingerprint_mismatch", None),
        rows(frames.where("has_json AND (width IS NULL OR height IS NULL)"), "unreadable_source_image", None),
        rows(p["told"].where("NOT _live"), "nonaccepted_record_in_canonical_detections"),
        rows(live.where((role == OBJECT_ROLE) & (source != OBJECT_SOURCE)), "object_source_violation"),
        rows(live.where((role == STRUCTURE_ROLE) & (source != STRUCTURE_SOURCE)), "structural_source_violation"),
        rows(live.where(surface & (role != STRUCTURE_ROLE)), "structural_role_violation"),
        rows(live.where(~surface & (role != OBJECT_ROLE)), "object_role_violation"),
        rows(again, "duplicate_track", "track_id"),
        rows(seen.where("_mw IS NULL"), "missing_or_unreadable_mask"),
        rows(seen.where("_mw <> _w OR _mh <> _h"), "mask_shape_mismatch"),
        rows(overlaps(p["good"], runs, frames), "canonical_masks_overlap", None),
        rows(short, "published_track_below_minimum_visible_frames", "track_id"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def audit_warnings(frames: DataFrame, good: DataFrame, labels: list[str]) -> DataFrame:
    """Labels of the prompt list without an accepted mask in a scan."""
    asked = frames.select("scan_id").distinct().withColumn("label", F.explode(F.array(*[F.lit(x) for x in labels])))
    return asked.join(good.select("scan_id", "label").distinct(), ["scan_id", "label"], "left_anti").withColumn("warning", F.lit("no_accepted_masks"))


def audit_counts(good: DataFrame, states: DataFrame) -> DataFrame:
    """(scan_id, kind, name, n): published masks by label, source and role, and label states."""
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("name")) for k in ("label", "source", "role")])).alias("_k")
    masks = good.select("scan_id", kinds).select("scan_id", "_k.*")
    state = states.select("scan_id", F.lit("state").alias("kind"), F.col("state").alias("name"))
    return masks.unionByName(state).groupBy("scan_id", "kind", "name").agg(F.count("*").alias("n"))


def audit_summary(frames: DataFrame, good: DataFrame, overlap: DataFrame, errors: DataFrame, warnings: DataFrame) -> DataFrame:
    """One row per scan: frames, accepted masks, errors, warnings, largest overlap and the status."""
    count = lambda df, name: df.groupBy("scan_id").agg(F.count("*").alias(name))
    most = overlap.groupBy("scan_id").agg(F.max("overlap_fraction").alias("maximum_overlap_fraction"))
    j = count(frames, "frame_count")
    for part in (count(good, "accepted_mask_count"), count(errors, "error_count"), count(warnings, "warning_count"), most):
        j = j.join(part, "scan_id", "left")
    j = j.na.fill(0, ["accepted_mask_count", "error_count", "warning_count"]).na.fill(0.0, ["maximum_overlap_fraction"])
    return j.withColumn("status", F.when(F.col("error_count") == 0, "success").otherwise("failed"))


def stale_files(listing: DataFrame, referenced: DataFrame, errors: DataFrame) -> DataFrame:
    """Listed files that nothing references, only for scans with a clean audit (report, no deletion)."""
    return listing.join(referenced.select("scan_id", "path"), ["scan_id", "path"], "left_anti").join(errors.select("scan_id").distinct(), "scan_id", "left_anti")


def pending_stages(stages: DataFrame, manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """Stages whose fingerprint changed or whose expected outputs are not all listed.

    ``stages``: scan_id, stage, fingerprint, outputs (array); ``manifest``: scan_id, stage, fingerprint.
    """
    known = manifest.select("scan_id", "stage", F.col("fingerprint").alias("_old"))
    want = stages.select("scan_id", "stage", F.explode("outputs").alias("path"))
    missing = want.join(listing.select("scan_id", "path"), ["scan_id", "path"], "left_anti").groupBy("scan_id", "stage").agg(F.count("*").alias("missing_outputs"))
    j = stages.join(known, ["scan_id", "stage"], "left").join(missing, ["scan_id", "stage"], "left").na.fill(0, ["missing_outputs"])
    changed = ~F.col("fingerprint").eqNullSafe(F.col("_old"))
    return j.where(changed | (F.col("missing_outputs") > 0)).select("scan_id", "stage", changed.alias("fingerprint_changed"), "missing_outputs")


def recoverable(summaries: DataFrame, targets: DataFrame, listing: DataFrame) -> DataFrame:
    """Finished (object, variant) results that agree with the targets and whose file is not empty."""
    keys = ["scan_id", "object_key", "label", "instance_id", "variant", "run_id"]
    ok = summaries.where(F.col("status") == "success").join(targets.select(*keys), keys, "left_semi")
    files = listing.where(F.col("size") > 0).select("scan_id", "path")
    return ok.join(files, ["scan_id", "path"], "left_semi").groupBy("scan_id", "object_key", "variant").agg(F.min("path").alias("path"))


def pending(targets: DataFrame, done: DataFrame) -> DataFrame:
    return targets.join(done.select("scan_id", "object_key", "variant"), ["scan_id", "object_key", "variant"], "left_anti")


def batch_status(variants: DataFrame, expected: DataFrame) -> DataFrame:
    """Roll-up per scan over one status row per object."""
    n = variants.groupBy("scan_id").agg(*[F.count(F.when(F.col("status") == s, 1)).alias(s) for s in ("success", "failed", "skipped")], F.count("*").alias("done"))
    j = expected.groupBy("scan_id").agg(F.count("*").alias("planned")).join(n, "scan_id", "left").na.fill(0)
    status = (F.when(F.col("done") < F.col("planned"), "in_progress_checkpoint").when(F.col("failed") > 0, "partial_failure")
              .when(F.col("skipped") > 0, "success_with_skips").otherwise("success"))
    return j.withColumn("batch_status", status)


def inspect_exports(gaussians: DataFrame, by: list[str]) -> DataFrame:
    """Count, centre, span and quantiles of sigma and alpha per export."""
    g = gaussians.groupBy(*by).agg(F.count("*").alias("count"), *[F.avg(a).alias(f"center_{a}") for a in "xyz"], *[(F.max(a) - F.min(a)).alias(f"span_{a}") for a in "xyz"])
    g = attach(g, exact_quantiles(gaussians, by, {n: [0.5, 0.9, 0.99] for n in ("sigma", "alpha")}), by)
    return g.withColumns({f"{n}_p{p}": F.col(f"q_{n}")[i] for n in ("sigma", "alpha") for i, p in enumerate((50, 90, 99))}).drop("q_sigma", "q_alpha")


def select_cleanup(candidates: DataFrame) -> DataFrame:
    """First valid clean-up candidate per object, else the raw export.

    ``candidates``: scan_id, object_key, name, rank, count, alpha_count.
    """
    ok = (F.col("count") >= CLEANUP_MIN_POINTS) & (F.col("count") / F.greatest("alpha_count", F.lit(1)) >= CLEANUP_MIN_COMPLETENESS)
    g = candidates.groupBy("scan_id", "object_key").agg(F.min(F.when(ok, F.struct("rank", "name"))).alias("_c"))
    return g.select("scan_id", "object_key", F.coalesce("_c.name", F.lit("raw")).alias("selected"))


def cap_sigma(gaussians: DataFrame, by: list[str], q: float = 0.97) -> DataFrame:
    """Sigma cut off at its quantile within the export."""
    limit = exact_quantiles(gaussians, by, {"sigma": [q]})
    return attach(gaussians, limit, by).withColumn("sigma", F.least("sigma", F.col("q_sigma")[0])).drop("q_sigma")


def isolation_delta(raw: DataFrame, cleaned: DataFrame, keys: list[str]) -> DataFrame:
    """Change of leakage and recall from the raw to the cleaned export, per view."""
    b = cleaned.select(*keys, F.col("leakage").alias("_l"), F.col("recall").alias("_r"))
    return raw.join(b, keys).select(*keys, (F.col("_l") - F.col("leakage")).alias("delta_leakage"), (F.col("_r") - F.col("recall")).alias("delta_recall"))


def isolation(rendered: DataFrame, target: DataFrame, views: DataFrame, keys: list[str]) -> DataFrame:
    """IoU, precision, recall and leakage of rendered against target masks per view."""
    r, t = ma.union_runs(rendered, keys), ma.union_runs(target, keys)
    nr, nt = ma.pixel_count(r, keys, "rendered_pixels"), ma.pixel_count(t, keys, "target_pixels")
    miss = ma.pixel_count(ma.subtract_runs(r, t, keys, keys), keys, "leaked_pixels")
    j = views.select(*keys).join(nr, keys, "left").join(nt, keys, "left").join(miss, keys, "left").na.fill(0)
    hit = F.col("rendered_pixels") - F.col("leaked_pixels")
    union = F.col("target_pixels") + F.col("leaked_pixels")

    def ratio(a, b):
        return F.when(b > 0, a / b)

    return j.withColumns({"iou": ratio(hit, union), "precision": ratio(hit, F.col("rendered_pixels")), "recall": ratio(hit, F.col("target_pixels")),
                          "leakage": ratio(F.col("leaked_pixels"), F.col("rendered_pixels")),
                          "empty_view_false_positive": (F.col("target_pixels") == 0) & (F.col("rendered_pixels") > 0)})


def macro_average(metrics: DataFrame, item: str, group: str, value: str) -> DataFrame:
    """Mean over items first, then over the items of each group."""
    per = metrics.groupBy(group, item).agg(F.avg(value).alias("_v"))
    return per.groupBy(group).agg(F.avg("_v").alias("macro_mean"), F.count("*").alias("items"))


def bootstrap_ci(metrics: DataFrame, by: list[str], id_col: str, a: str, b: str, replicates: int = 1000, seed: int = 7) -> DataFrame:
    """Paired bootstrap of mean(a - b): each row gets a Poisson(1) weight per replicate from a hash.

    Weighting instead of drawing keeps every replicate a plain aggregation: one pass, no row is
    copied to another task, and results are reproducible.
    """
    u = (F.pmod(F.xxhash64(F.col(id_col), F.col("r"), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40))
    steps, cum, p, w = [0.36787944117144233], 0.36787944117144233, 0.36787944117144233, F.lit(0)
    for k in range(1, 9):
        p = p / k
        cum += p
        steps.append(cum)
    for s in steps:
        w = w + (u >= s).cast("int")
    rows = metrics.select(*by, id_col, (F.col(a) - F.col(b)).alias("_d"), F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("r")).withColumn("_w", w)
    means = rows.groupBy(*by, "r").agg((F.sum(F.col("_d") * F.col("_w")) / F.nullif(F.sum("_w"), F.lit(0))).alias("_m"))
    ci = means.groupBy(*by).agg(F.percentile("_m", F.array(F.lit(0.025), F.lit(0.975))).alias("_c"))
    base = metrics.groupBy(*by).agg(F.avg(F.col(a) - F.col(b)).alias("difference"))
    return base.join(ci, by).select(*by, "difference", F.col("_c")[0].alias("ci_low"), F.col("_c")[1].alias("ci_high"))


def calibration(preds: DataFrame, bins: int = 10) -> DataFrame:
    """Mean confidence and accuracy per confidence bin."""
    b = F.least(F.floor(F.col("confidence") * bins).cast("int"), F.lit(bins - 1))
    return preds.groupBy("scan_id", b.alias("bin")).agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"), F.avg(F.col("correct").cast("int")).alias("accuracy"))


def abstention(preds: DataFrame, thresholds: list[float]) -> DataFrame:
    """Coverage and accuracy of predictions kept at each confidence threshold."""
    t = F.explode(F.array(*[F.lit(v) for v in thresholds])).alias("threshold")
    cells = preds.groupBy("scan_id", "confidence").agg(F.count("*").alias("n"), F.sum(F.col("correct").cast("int")).alias("c"))
    kept = F.col("confidence") >= F.col("threshold")
    return cells.select("scan_id", "confidence", "n", "c", t).groupBy("scan_id", "threshold").agg(
        (F.sum(F.when(kept, F.col("n")).otherwise(0)) / F.sum("n")).alias("coverage"),
        (F.sum(F.when(kept, F.col("c"))) / F.sum(F.when(kept, F.col("n")))).alias("accuracy"))
