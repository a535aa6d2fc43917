"""Choosing frames of a video: continuity, anchors, loop candidates, loop pairs and the final cap.

Input: scan_id, frame_id, thumb (array of numbers), features, sharpness.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from splatlake import config as cfg
from splatlake.operators.ordered import stream_groups
from splatlake.operators.skew import ordered_rank


def gray_diff(a, b) -> float:
    return float(np.abs(np.asarray(a, dtype=np.float64) - np.asarray(b, dtype=np.float64)).mean())


class Continuity:
    """Last saved frame and the thumbnails saved most recently."""

    def __init__(self):
        self.last_id, self.recent = None, deque(maxlen=cfg.CONTINUITY_RECENT)

    def add(self, frame_id, thumb) -> bool:
        if self.last_id is None:
            save = True
        else:
            gap, diff = frame_id - self.last_id, gray_diff(thumb, self.recent[-1])
            fits = gap >= cfg.CONTINUITY_MIN_GAP and cfg.CONTINUITY_MIN_DIFF <= diff <= cfg.CONTINUITY_MAX_DIFF
            save = gap >= cfg.CONTINUITY_MAX_GAP or (
                fits and all(gray_diff(thumb, g) >= cfg.CONTINUITY_MIN_DIFF for g in self.recent))
        if save:
            self.last_id = frame_id
            self.recent.append(np.array(thumb))
        return save


def continuity_frames(frames: DataFrame) -> DataFrame:
    """Frames that keep visual continuity, in frame order."""
    out = stream_groups(frames, ["scan_id"], [F.col("frame_id")], Continuity,
                        lambda s, r: (s.add(r.frame_id, r.thumb),), ["saved"], "saved boolean")
    return out.where("saved").drop("saved")


def greedy_spread(frames: DataFrame, min_gap: int, min_diff: float, limit: int) -> DataFrame:
    """Best frames by (features, sharpness) that stay apart in time and look; at most ``limit``."""
    def step(chosen, r):
        if len(chosen) >= limit:
            return (False,)
        for fid, g in chosen:
            if abs(r.frame_id - fid) < min_gap or gray_diff(r.thumb, g) < min_diff:
                return (False,)
        chosen.append((r.frame_id, np.array(r.thumb)))
        return (True,)

    order = [F.col("features").desc(), F.col("sharpness").desc(), F.col("frame_id")]
    out = stream_groups(frames, ["scan_id"], order, list, step, ["chosen"], "chosen boolean")
    return out.where("chosen").drop("chosen")


def anchor_candidates(frames: DataFrame) -> DataFrame:
    return greedy_spread(frames, cfg.ANCHOR_MIN_GAP, cfg.ANCHOR_MIN_DIFF, cfg.ANCHOR_MAX)


def loop_candidates(continuity: DataFrame) -> DataFrame:
    return greedy_spread(continuity, cfg.LOOP_MIN_GAP, cfg.LOOP_MIN_DIFF, cfg.LOOP_MAX)


def packed(descriptors) -> np.ndarray:
    """Binary descriptors (arrays of 64-bit words) as one matrix; nothing as no rows."""
    if descriptors is None or not len(descriptors):
        return np.zeros((0, 0), dtype=np.uint64)
    return np.stack([np.asarray(d, dtype=np.int64) for d in descriptors]).view(np.uint64)


def match_count(x: np.ndarray, y: np.ndarray) -> int:
    """Mutually nearest descriptor pairs within the Hamming limit."""
    if not len(x) or not len(y):
        return 0
    dist = np.zeros((len(x), len(y)), dtype=np.int32)
    for word in range(x.shape[1]):
        dist += np.bitwise_count(x[:, word, None] ^ y[None, :, word])
    to, back = dist.argmin(1), dist.argmin(0)
    own = np.arange(len(x))
    return int(((back[to] == own) & (dist[own, to] <= cfg.LOOP_PAIR_HAMMING)).sum())


def mutual_matches(a: pd.Series, b: pd.Series) -> pd.Series:
    """:func:`match_count` for one frame pair per row."""
    return pd.Series([match_count(packed(x), packed(y)) for x, y in zip(a, b)])


def loop_pool(anchors: DataFrame, loops: DataFrame) -> DataFrame:
    """(scan_id, frame_id) of anchors and loop candidates, each frame once: at most the sum of both limits per scan."""
    keys = ["scan_id", "frame_id"]
    return anchors.select(*keys).unionByName(loops.select(*keys)).distinct()


def loop_pairs(pool: DataFrame, gap=cfg.LOOP_PAIR_GAP, min_matches=cfg.LOOP_PAIR_MATCHES, limit=cfg.LOOP_PAIR_MAX, parts: int = 8) -> DataFrame:
    """Far-apart frame pairs with enough matches, best ``limit`` per scan.

    ``pool``: scan_id, frame_id, descriptors, of the frames of :func:`loop_pool`, whose two limits
    bound a scan.  A frame is sent once to each of ``parts`` tasks of its scan, and a task scores the
    pairs whose earlier frame it owns, so no pair carries descriptors through a shuffle.  Frames
    with null or no descriptors match nothing.
    """
    from splatlake.operators.ranking import top_rows

    part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    dealt = pool.select("scan_id", "frame_id", "descriptors", F.pmod(F.xxhash64("frame_id"), F.lit(parts)).cast("int").alias("owner"), part.alias("part"))

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_id")
        frames, looks, mine = pdf["frame_id"].tolist(), [packed(d) for d in pdf["descriptors"]], (pdf["owner"] == pdf["part"]).tolist()
        found = []
        for i in (i for i, m in enumerate(mine) if m):
            for j in range(i + 1, len(frames)):
                if frames[j] - frames[i] >= gap:
                    n = match_count(looks[i], looks[j])
                    if n >= min_matches:
                        found.append((pdf["scan_id"].iloc[0], frames[i], frames[j], n))
        return pd.DataFrame(found, columns=["scan_id", "frame_a", "frame_b", "matches"])

    kinds = {f.name: f.dataType.simpleString() for f in pool.schema}
    scored = dealt.groupBy("scan_id", "part").applyInPandas(score, f"scan_id {kinds['scan_id']}, frame_a {kinds['frame_id']}, frame_b {kinds['frame_id']}, matches int")
    return top_rows(scored, ["scan_id"], [F.col("matches").desc(), F.col("frame_a"), F.col("frame_b")], limit)


def loop_frames(pairs: DataFrame) -> DataFrame:
    """(scan_id, frame_id): both ends of each pair, once."""
    return pairs.select("scan_id", F.explode(F.array("frame_a", "frame_b")).alias("frame_id")).distinct()


def merge_types(parts: dict[str, DataFrame]) -> DataFrame:
    """(scan_id, frame_id, types): which selections a frame belongs to."""
    union = None
    for name, df in parts.items():
        p = df.select("scan_id", "frame_id").withColumn("type", F.lit(name))
        union = p if union is None else union.unionByName(p)
    return union.groupBy("scan_id", "frame_id").agg(F.sort_array(F.collect_set("type")).alias("types"))


class BucketPick:
    """Best frame of the open bucket and the thumbnail picked before it."""

    def __init__(self):
        self.bucket, self.best, self.look, self.prev = None, None, None, None

    def score(self, bucket, thumb, features, sharpness) -> float:
        if bucket != self.bucket:
            self.prev, self.bucket, self.best = self.look, bucket, None
        diff = cfg.CONTINUITY_MIN_DIFF if self.prev is None else gray_diff(thumb, self.prev)
        value = 2.0 * diff + 0.01 * features + 0.001 * sharpness - 2.0 * max(0.0, diff - cfg.CONTINUITY_MAX_DIFF)
        if self.best is None or value > self.best:
            self.best, self.look = value, np.array(thumb)
        return value


def diverse_cap(optional: DataFrame, slots: DataFrame) -> DataFrame:
    """At most ``slots.slots`` frames per scan: one per equal bucket, different from the pick before.

    A bucket ends at its multiple of the size, rounded down as a double; a last frame that rounding
    leaves behind the last bucket is not chosen.
    """
    ranked = ordered_rank(optional, ["scan_id"], [F.col("frame_id")], "pos").join(slots, "scan_id").where("slots > 0")
    size = F.col("pos_total") / F.col("slots").cast("double")
    fits = ranked.where(F.col("pos_total") <= F.col("slots")).select(*optional.columns)
    near = F.ceil(F.col("pos") / size) - 1
    ends = lambda b: F.floor((b + 1) * size) >= F.col("pos")
    bucket = F.when(ends(near - 1), near - 1).when(ends(near), near).otherwise(near + 1).cast("bigint")
    over = ranked.where(F.col("pos_total") > F.col("slots")).withColumn("bucket", bucket).where(F.col("bucket") < F.col("slots"))
    scored = stream_groups(over, ["scan_id"], [F.col("pos")], BucketPick,
                           lambda s, r: (s.score(r.bucket, r.thumb, r.features, r.sharpness),), ["score"], "score double")
    row = F.struct(*optional.columns)
    best = scored.groupBy("scan_id", "bucket").agg(F.max_by(row, F.struct("score", -F.col("pos"))).alias("r")).select("r.*")
    return fits.unionByName(best)


def final_frames(typed: DataFrame, limit: int = cfg.TOTAL_FRAMES) -> DataFrame:
    """At most ``limit`` frames per scan of the merged selection.

    ``typed``: scan_id, frame_id, thumb, features, sharpness, types.  Anchor and loop frames must
    stay; the others fill what is left by :func:`diverse_cap`.  Where the must-keep frames alone reach
    the limit, loop frames go first, then anchors, then more features and sharpness, then earlier frames.
    """
    loop, anchor = (F.coalesce(F.array_contains("types", n), F.lit(False)) for n in ("loop", "anchor"))
    marked = typed.withColumns({"is_loop": loop.cast("int"), "is_anchor": anchor.cast("int")})
    must = (F.col("is_loop") + F.col("is_anchor")) > 0
    slots = marked.groupBy("scan_id").agg((F.lit(limit) - F.count(F.when(must, 1))).alias("slots"))
    order = [F.col(c).desc() for c in ("is_loop", "is_anchor", "features", "sharpness")] + [F.col("frame_id")]
    kept = ordered_rank(marked.where(must), ["scan_id"], order, "pos").where(F.col("pos") <= limit).select(*typed.columns)
    return kept.unionByName(diverse_cap(marked.where(~must).select(*typed.columns), slots))
