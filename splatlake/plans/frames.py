"""End to end: candidate frames of videos in; the frames to reconstruct from out."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from splatlake import config as cfg
from splatlake.operators import video as vd
from splatlake.session import cut


def choose_frames(frames: DataFrame, limit: int = cfg.TOTAL_FRAMES) -> DataFrame:
    """Continuity, anchor and loop frames of each scan, merged and capped: the columns of ``frames`` and ``types``.

    ``frames``: scan_id, frame_id, thumb, features, sharpness, descriptors.  Loop candidates come from
    the continuity frames, loop pairs from the pool of anchors and candidates.  A frame of the pool
    counts its descriptors as features from then on.
    """
    key = ["scan_id", "frame_id"]
    looks = frames.drop("descriptors")
    continuity = cut(vd.continuity_frames(looks))
    anchors = cut(vd.anchor_candidates(looks).select(*key))
    pool = cut(vd.loop_pool(anchors, vd.loop_candidates(continuity)))
    described = frames.join(pool, key, "left_semi").select(*key, "descriptors")
    loops = vd.loop_frames(vd.loop_pairs(described))
    types = vd.merge_types({"continuity": continuity, "anchor": anchors, "loop": loops})
    counted = pool.withColumn("_pool", F.lit(True))
    features = F.when(F.col("_pool"), F.coalesce(F.size("descriptors"), F.lit(0))).otherwise(F.col("features"))
    typed = frames.join(types, key).join(counted, key, "left").withColumn("features", features).drop("_pool")
    return vd.final_frames(typed, limit)
