"""Detection gates, suppression and prompt planning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from splatlake import config as cfg
from splatlake.functions import boxes, text
from splatlake.functions.weights import literal_map
from splatlake.session import cut

FRAME = ["scan_id", "frame_index"]

BOX = ["x1", "y1", "x2", "y2"]


def iou_text(a: str, b: str) -> str:
    inter = (f"(greatest(0D, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * "
             f"greatest(0D, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)))")
    areas = " + ".join(f"greatest(0D, {t}.x2 - {t}.x1) * greatest(0D, {t}.y2 - {t}.y1)" for t in (a, b))
    return f"coalesce({inter} / nullif({areas} - {inter}, 0D), 0D)"


def gate(detections: DataFrame, thresholds=None, max_fraction=None) -> DataFrame:
    """Adds clipped corners, ``box_area_fraction``, ``accepted`` and the first failing ``rejection_reason``."""
    generic = (F.col("label") == "miscellaneous") & (F.col("prompt_kind") == "generic_fallback")
    threshold = literal_map(thresholds or cfg.DETECTION_THRESHOLDS, F.col("label"), 1e9)
    largest = literal_map(max_fraction or cfg.MAX_BOX_FRACTION, F.col("label"), cfg.DEFAULT_MAX_FRACTION)
    clipped = boxes.clip(boxes.box(*BOX), F.col("width"), F.col("height"))
    # each value is a column of its own, so that it is not computed anew at every use
    d = detections.withColumns({
        **{c: clipped[c] for c in BOX},
        "_least": F.when(generic, F.greatest(threshold, F.lit(cfg.GENERIC_THRESHOLD))).otherwise(threshold),
        "_most": F.when(generic, F.least(largest, F.lit(cfg.GENERIC_MAX_FRACTION))).otherwise(largest),
    })
    d = d.withColumn("box_area_fraction", boxes.area_fraction(boxes.box(*BOX), F.col("width"), F.col("height")))
    frac = F.col("box_area_fraction")
    reason = (
        F.when(F.col("label").isNull(), F.lit("unknown_prompt_label"))
        .when(F.col("confidence") < F.col("_least"), F.lit("below_class_threshold"))
        .when(frac < cfg.MIN_BOX_FRACTION, F.lit("box_too_small"))
        .when(frac > F.col("_most"), F.lit("box_too_large"))
        .when((F.col("x2") <= F.col("x1")) | (F.col("y2") <= F.col("y1")), F.lit("invalid_box"))
    )
    d = d.withColumn("rejection_reason", reason).withColumn("accepted", F.col("rejection_reason").isNull())
    return d.drop("_least", "_most")


def nms(detections: DataFrame, iou: float = cfg.NMS_IOU) -> DataFrame:
    """Greedy same-label suppression per frame: adds ``suppressed_by`` (null = kept).

    Order: prompt kind rank, then confidence, then detection id.  Any threshold above 0 and up to 1 is
    accepted.  Boxes without area and rows without a frame or label neither suppress nor are suppressed.
    """
    if not 0 < iou <= 1:
        raise ValueError("the IoU threshold must lie above 0 and not above 1")
    rank = literal_map(cfg.PROMPT_KIND_RANK, F.col("prompt_kind"), 0)
    keys = [*FRAME, "label"]
    d = detections.withColumn("_o", F.struct((-rank).alias("rank"), (-F.col("confidence")).alias("confidence"), "detection_id"))
    live = F.expr("x2 > x1 AND y2 > y1 AND " + " AND ".join(f"{k} IS NOT NULL" for k in keys))
    boxes = d.where(F.coalesce(live, F.lit(False)))
    # of equal boxes only the first can be kept or suppress anything; the others share its fate
    unlike = cut(boxes.groupBy(*keys, *BOX).agg(F.min("_o").alias("_o")))
    edges = cut(overlaps(unlike, keys, iou))
    lost = greedy_losers(edges, keys)
    winner = edges.join(lost.withColumnRenamed("hi", "lo"), [*keys, "lo"], "left_anti").groupBy(*keys, F.col("hi").alias("_o")).agg(F.min("lo").alias("_by"))
    fate = unlike.join(winner, [*keys, "_o"], "left").withColumnRenamed("_o", "_first")
    by = F.when(F.col("_o") == F.col("_first"), F.col("_by.detection_id")).otherwise(F.coalesce("_by.detection_id", "_first.detection_id"))
    done = boxes.join(fate, [*keys, *BOX]).withColumn("suppressed_by", by)
    flat = d.where(~F.coalesce(live, F.lit(False))).withColumn("suppressed_by", F.lit(None).cast(d.schema["detection_id"].dataType))
    out = [*detections.columns, "suppressed_by"]
    return done.select(*out).unionByName(flat.select(*out))


def overlaps(boxes: DataFrame, keys: list[str], iou: float) -> DataFrame:
    """(keys, lo, hi): pairs of boxes that reach the threshold, ``lo`` before ``hi`` in order.

    On each axis such boxes have sides within a factor of 1 / iou and centres within (1 - iou) / (1 + iou) of
    their mean side, so they share a (level, cell) bucket; a cell of a level is up to four sides long.
    """
    reach, spread = (1 - iou) / (1 + iou) / 2, boxes.select(*keys, "_o", *BOX)
    for s in "xy":
        side, c, size = f"greatest({s}2 - {s}1, 1e-9D)", f"(({s}1 + {s}2) / 2)", f"pow(4D, _l{s} + 1)"
        first, last = (f"int(floor(log2({v}) / 2))" for v in (side, f"{side} * {(1 + 1e-9) / iou}D"))
        r = f"({side} * {reach}D + {size} * 1e-4D)"
        spread = spread.withColumn(f"_l{s}", F.expr(f"explode(sequence({first}, {last}))")).withColumn(
            f"_c{s}", F.expr(f"explode(sequence(bigint(floor(({c} - {r}) / {size})), bigint(floor(({c} + {r}) / {size}))))"))
    cell = ["_lx", "_ly", "_cx", "_cy"]
    one = spread.select(*keys, *cell, F.col("_o").alias("lo"), F.struct(*BOX).alias("_a"))
    two = spread.select(*keys, *cell, F.col("_o").alias("hi"), F.struct(*BOX).alias("_b"))
    met = one.join(two, [*keys, *cell]).where("lo < hi").where(iou_text("_a", "_b") + f" >= {iou}D")
    return met.select(*keys, "lo", "hi").distinct()


def greedy_losers(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, hi): what the greedy choice drops, in rounds on the overlaps that are still open.

    A box without an open earlier neighbour is kept and drops its later neighbours, so the number of
    rounds follows the longest chain of overlaps, whatever the number of boxes.
    """
    lost = edges.select(*keys, "hi").limit(0)
    alive = edges
    while not alive.isEmpty():
        later = alive.select(*keys, F.col("hi").alias("lo")).distinct()
        kept = alive.select(*keys, "lo").distinct().join(later, [*keys, "lo"], "left_anti")
        gone = cut(alive.join(kept, [*keys, "lo"], "left_semi").select(*keys, "hi").distinct())
        lost = lost.unionByName(gone)
        alive = cut(alive.join(gone, [*keys, "hi"], "left_anti").join(gone.withColumnRenamed("hi", "lo"), [*keys, "lo"], "left_anti"))
    return lost


def drop_generic(detections: DataFrame, iou=cfg.GENERIC_OVERLAP_IOU, ios=cfg.GENERIC_CONTAINMENT) -> DataFrame:
    """Generic miscellaneous boxes that duplicate a known class: adds ``suppressed_by`` (null = kept).

    The pair join covers generic boxes against known boxes of the same frame only; the suppressor
    is the known box that comes first.
    """
    generic = (F.col("label") == "miscellaneous") & (F.col("prompt_kind") == "generic_fallback")
    g = detections.where(generic).select(*FRAME, "detection_id", boxes.box("x1", "y1", "x2", "y2").alias("_g"))
    known = detections.where(F.col("label") != "miscellaneous").select(
        *FRAME, F.col("detection_id").alias("_kid"), boxes.box("x1", "y1", "x2", "y2").alias("_k")
    )
    hit = (boxes.iou(F.col("_g"), F.col("_k")) >= iou) | (boxes.intersection_over_smaller(F.col("_g"), F.col("_k")) >= ios)
    by = tile_join(g, known, "_g", "_k").where(hit).groupBy(*FRAME, "detection_id").agg(F.min("_kid").alias("suppressed_by"))
    return detections.join(by, [*FRAME, "detection_id"], "left")


def tile_join(a: DataFrame, b: DataFrame, abox: str, bbox: str, tile: float = 128.0) -> DataFrame:
    """Pairs of boxes of one frame that overlap, met through image tiles (each pair once)."""
    def tiled(df, c):
        out = df
        for axis in "xy":
            lo, hi = (f"int(floor(`{c}`.{axis}{i} / {tile}D))" for i in (1, 2))
            out = out.withColumn(f"_t{axis}", F.expr(f"explode(sequence({lo}, greatest({lo}, {hi})))"))
        return out

    j = tiled(a, abox).join(tiled(b, bbox), [*FRAME, "_tx", "_ty"])
    once = " AND ".join(
        f"_t{x} = int(floor(greatest(`{abox}`.{x}1, `{bbox}`.{x}1) / {tile}D))" for x in "xy"
    )
    return j.where(once).drop("_tx", "_ty")


def drop_conflicts(detections: DataFrame) -> DataFrame:
    """Curtains without window context and blankets that copy a bed: adds ``conflict_reason`` and
    ``conflict_with`` (nulls = kept)."""
    b = boxes.box("x1", "y1", "x2", "y2")
    curtains = detections.where((F.col("label") == "curtain") & (F.col("confidence") < cfg.CURTAIN_ALONE_CONFIDENCE))
    windows = detections.where(F.col("label") == "window").select(*FRAME, b.alias("_w"))
    near = (boxes.intersection_over_smaller(F.col("_c"), F.col("_w")) >= cfg.CURTAIN_WINDOW_IOS) | (
        boxes.center_distance(F.col("_c"), F.col("_w"), F.col("width"), F.col("height")) <= cfg.CURTAIN_WINDOW_DISTANCE
    )
    c = curtains.select(*FRAME, "detection_id", "width", "height", b.alias("_c"))
    held = c.join(windows, FRAME).where(near).select(*FRAME, "detection_id").distinct()
    lone = c.select(*FRAME, "detection_id").join(held, [*FRAME, "detection_id"], "left_anti").select(
        *FRAME, "detection_id", F.lit("curtain_without_window_context").alias("conflict_reason"),
        F.lit(None).cast("bigint").alias("conflict_with"),
    )
    blankets = detections.where(F.col("label") == "blanket").select(*FRAME, "detection_id", b.alias("_c"))
    beds = detections.where(F.col("label") == "bed").select(*FRAME, F.col("detection_id").alias("_bed"), b.alias("_b"))
    one = F.lit(1.0)
    copies = (boxes.intersection(F.col("_c"), F.col("_b")) / F.greatest(one, boxes.area(F.col("_c"))) >= cfg.BLANKET_OVERLAP) & (
        boxes.area(F.col("_c")) / F.greatest(one, boxes.area(F.col("_b"))) >= cfg.BLANKET_AREA_RATIO
    )
    dup = tile_join(blankets, beds, "_c", "_b").where(copies).groupBy(*FRAME, "detection_id").agg(
        F.min("_bed").alias("conflict_with")
    ).select(*FRAME, "detection_id", F.lit("blanket_duplicates_bed_extent").alias("conflict_reason"), "conflict_with")
    return detections.join(lone.unionByName(dup), [*FRAME, "detection_id"], "left")


def label_evidence(detections: DataFrame, scans: DataFrame, labels=None) -> DataFrame:
    """Detections, distinct frames and best confidence per core label; zeros for absent labels."""
    core = F.explode(F.array(*[F.lit(c) for c in (labels or cfg.CORE_LABELS)]))
    grid = scans.select("scan_id").distinct().select("scan_id", core.alias("label"))
    agg = detections.groupBy("scan_id", "label").agg(
        F.count("*").alias("detection_count"), F.countDistinct("frame_index").alias("anchor_frame_count"),
        F.max("confidence").alias("maximum_confidence"),
    )
    return grid.join(agg, ["scan_id", "label"], "left").na.fill(0, ["detection_count", "anchor_frame_count"]).na.fill(
        0.0, ["maximum_confidence"])


def profile_table(spark) -> DataFrame:
    """(profile, always, triggers, labels) from the fixed profile table."""
    rows = [(p, p in cfg.ALWAYS_ACTIVE_PROFILES, v["trigger_labels"], v["labels"]) for p, v in cfg.PROMPT_PROFILES.items()]
    return spark.createDataFrame(rows, "profile string, always boolean, triggers array<string>, labels array<string>")


def active_profiles(evidence: DataFrame, forced: tuple[str, ...] = ()) -> DataFrame:
    """(scan_id, profile, active, matched_triggers); a trigger needs one frame and one detection."""
    spark = evidence.sparkSession
    found = evidence.where("anchor_frame_count >= 1 AND detection_count >= 1").groupBy("scan_id").agg(
        F.collect_set("label").alias("_found"))
    scans = evidence.select("scan_id").distinct().join(found, "scan_id", "left")
    p = profile_table(spark)  # four fixed rows
    j = scans.withColumn("_p", F.explode(F.array(*[F.lit(n) for n in cfg.PROMPT_PROFILES]))).join(
        F.broadcast(p), F.col("_p") == F.col("profile"))
    hit = F.expr("array_intersect(triggers, coalesce(_found, array()))")
    forced_col = F.col("profile").isin(list(forced)) if forced else F.lit(False)
    return j.select("scan_id", "profile", (F.col("always") | forced_col | (F.size(hit) > 0)).alias("active"), hit.alias("matched_triggers"))


def prompt_records(spark) -> DataFrame:
    """The prompt library: (label, prompt, prompt_kind), one row per prompt."""
    rows = [(lab, p, "generic_fallback" if lab == "miscellaneous" else "canonical") for lab, p in cfg.CLASS_PROMPTS.items()]
    for lab, names in cfg.CLASS_PROMPT_ALIASES.items():
        rows += [(lab, n, "named_fallback" if lab == "miscellaneous" else "alias") for n in names]
    rows += [("miscellaneous", p, "generic_fallback") for p in cfg.GENERIC_PROMPTS]
    return spark.createDataFrame(rows, "label string, prompt string, prompt_kind string")


def prompt_plan(profiles: DataFrame) -> DataFrame:
    """Active prompts per scan: (scan_id, pass, label, prompt, prompt_kind).

    The core pass holds canonical core prompts and selected aliases; the expanded pass holds generic
    prompts, and details and named fallbacks of the scan's active profiles.
    """
    spark = profiles.sparkSession
    lib = prompt_records(spark)
    core = set(cfg.CORE_LABELS)
    chosen = [("core", None, lab, a) for lab, names in cfg.CORE_PROMPT_ALIASES.items() for a in names]
    chosen += [("core", None, lab, cfg.CLASS_PROMPTS[lab]) for lab in cfg.CORE_LABELS]
    chosen += [("expanded", None, "miscellaneous", p) for p in cfg.GENERIC_PROMPTS]
    for prof, v in cfg.PROMPT_PROFILES.items():
        details = [lab for lab in v["labels"] if lab not in core]
        chosen += [("expanded", prof, lab, cfg.CLASS_PROMPTS[lab]) for lab in details]
        chosen += [("expanded", prof, lab, a) for lab, names in cfg.PROFILE_PROMPT_ALIASES[prof].items() for a in names]
        chosen += [("expanded", prof, "miscellaneous", p) for p in cfg.MISC_PROMPT_PROFILES[prof]]
    table = spark.createDataFrame(chosen, "pass string, profile string, label string, prompt string").join(lib, ["label", "prompt"])
    always = profiles.select("scan_id").distinct().withColumn("profile", F.lit("*"))
    on = profiles.where("active").select("scan_id", "profile").unionByName(always)
    return on.join(F.broadcast(table.withColumn("profile", F.coalesce("profile", F.lit("*")))), "profile").select(
        "scan_id", "pass", "label", "prompt", "prompt_kind").distinct()


def reason_counts(rows: DataFrame, reasons: str, keys: list[str]) -> DataFrame:
    """Counts per reason; several reasons are joined by ``;``."""
    return rows.select(*keys, F.explode(F.split(reasons, ";")).alias("reason")).groupBy(*keys, "reason").agg(F.count("*").alias("n"))


def canonical_label(raw: DataFrame, prompts: DataFrame, col: str = "raw_label") -> DataFrame:
    """Adds ``label``: ordinal into the prompt list, exact prompt, else first suffix match.

    ``prompts``: (ordinal, prompt, label) with normalised prompts; a fixed vocabulary, broadcast.
    Distinct raw labels are resolved once, so the theta step never sees the detections.
    """
    names = raw.select(col).where(F.col(col).isNotNull()).distinct()
    norm = F.regexp_replace(text.normalize_label(F.col(col)), "^(a|an|the)_", "")
    names = names.withColumn("_n", norm).withColumn("_ord", F.when(F.col(col).rlike(r"^\d+$"), F.col(col).cast("int")))
    p = F.broadcast(prompts.select(F.col("ordinal").alias("_po"), F.col("prompt").alias("_pp"), F.col("label").alias("_pl")))
    exact = F.col("_n") == F.col("_pp")
    suffix = F.col("_n").endswith(F.concat(F.lit("_"), F.col("_pp"))) | F.col("_pp").endswith(F.concat(F.lit("_"), F.col("_n")))
    hit = F.when(F.col("_ord").isNotNull(), F.col("_ord") == F.col("_po")).otherwise(exact | suffix)
    best = names.join(p, hit).groupBy(col).agg(F.min_by("_pl", F.struct(~exact, F.col("_po"))).alias("label"))
    return raw.join(best, col, "left")


def class_ids(id_labels: DataFrame, terms: dict[str, list[str]]) -> DataFrame:
    """(label, class_ids): ids whose name, or a part split at , ; or /, matches a term."""
    rows = ", ".join(f"'{k}', array({', '.join(repr(text_norm(v)) for v in vs)})" for k, vs in terms.items())
    n = id_labels.select("class_id", F.explode(F.expr(f"map({rows})")).alias("label", "terms"), "name")
    whole = text.normalize_label(F.col("name"))
    parts = F.transform(F.split("name", "[,;/]"), text.normalize_label)
    hit = F.exists("terms", lambda t: (whole == t) | F.exists(parts, lambda p: (p == t) | p.startswith(F.concat(t, F.lit("_")))))
    return n.where(hit).groupBy("label").agg(F.sort_array(F.collect_set("class_id")).alias("class_ids"))


def text_norm(value: str) -> str:
    import re

    return re.sub(r"[^a-z0-9]+", "_", value.strip().lower()).strip("_")


def taxonomy_errors(prompts: DataFrame, profile_labels: DataFrame, core: DataFrame) -> DataFrame:
    """Problems of a prompt vocabulary as (error, item): duplicate prompts, labels of profiles or
    core without prompts, and labels that neither core nor a profile reaches."""
    n = prompts.withColumn("_n", text.normalize_label(F.col("prompt")))
    dup = n.groupBy("_n").agg(F.countDistinct("label").alias("c")).where("c > 1").select(
        F.lit("duplicate_normalized_prompt").alias("error"), F.col("_n").alias("item"))
    known = prompts.select("label").distinct()
    unknown = profile_labels.select("label").union(core.select("label")).distinct().join(known, "label", "left_anti").select(
        F.lit("unknown_label").alias("error"), F.col("label").alias("item"))
    reach = core.select("label").union(profile_labels.select("label")).distinct()
    lost = known.join(reach, "label", "left_anti").select(F.lit("unreachable_label").alias("error"), F.col("label").alias("item"))
    return dup.unionByName(unknown).unionByName(lost)
