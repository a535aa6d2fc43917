"""Ranks, samples and picks over ordered tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from splatlake.operators.skew import ordered_rank


def top_labels(totals: DataFrame, k: int) -> DataFrame:
    """Best ``k`` labels per point with their rank; a point holds at most one row per label."""
    w = W.partitionBy("scan_id", "point_id").orderBy(F.col("score").desc(), "label")
    ranked = totals.withColumn("label_rank", F.row_number().over(w).cast("bigint"))
    return ranked.where(F.col("label_rank") <= k).select("scan_id", "point_id", "label", "label_rank", "score")


def top_rows(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows of each key; the limit is pushed below the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def head_per_frame(masks: DataFrame, n: int) -> DataFrame:
    return top_rows(masks, ["scan_id", "frame_index"], [F.col("mask_id")], n)


def hash_sample(df: DataFrame, keys: list[str], id_col: str, n: int, seed: int = 42) -> DataFrame:
    """Reproducible uniform sample without replacement: the ``n`` smallest seeded hashes per key."""
    return top_rows(df, keys, [F.xxhash64(F.col(id_col), F.lit(seed)), F.col(id_col)], n)


def _picked(df: DataFrame, keys: list[str], order: list[Column], k: int, position: str) -> DataFrame:
    """Rows at the ``k`` positions of each key; only the steps that can hit a row are tried at it, so no list of positions is made."""
    ranked = ordered_rank(df, keys, order, "_r").withColumn("n", F.col("_r_total"))
    near = f"bigint(floor((_r - 1) * {k - 1}D / greatest(n - 1, 1)))"
    hit = f"n <= {k} OR exists(sequence(greatest(0L, {near} - 2), least({k - 1}L, {near} + 2)), i -> bigint({position.format(k=k)}) = _r - 1)"
    return ranked.where(hit).select(*df.columns)


def uniform_pick(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """``k`` evenly spread rows per key, first and last included, positions rounded half to even."""
    if k == 1:
        return top_rows(df, keys, order, 1)
    return _picked(df, keys, order, k, "rint(i * (n - 1) / double({k} - 1))")


def linspace_pick(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """Evenly spread rows with truncated positions; the last position is the last row whatever the product rounds to."""
    return _picked(df, keys, order, k, "CASE WHEN i > 0 AND i = {k} - 1 THEN n - 1 ELSE floor(i * ((n - 1) / greatest(1D, double({k} - 1)))) END")


def anchor_frames(frames: DataFrame, stride: int = 8) -> DataFrame:
    """Every ``stride``-th frame plus the last one of the scan."""
    last = frames.groupBy("scan_id").agg(F.max("frame_index").alias("_last"))
    return frames.join(last, "scan_id").where((F.col("frame_index") % stride == 0) | (F.col("frame_index") == F.col("_last"))).drop("_last")


def label_role(masks: DataFrame) -> DataFrame:
    """Structural when any mask of the label is structural."""
    return masks.groupBy("scan_id", "label").agg(F.bool_or(F.col("role") == "structural").alias("_s")).select(
        "scan_id", "label", F.when(F.col("_s"), F.lit("structural")).otherwise(F.lit("small")).alias("role"))


def merge_first(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Distinct rows of several tables; the earliest table wins and is named by ``source_rank``."""
    union = None
    for i, p in enumerate(parts):
        p = p.select(*keys).withColumn("source_rank", F.lit(i))
        union = p if union is None else union.unionByName(p)
    return union.groupBy(*keys).agg(F.min("source_rank").alias("source_rank"))
