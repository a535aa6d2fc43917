"""Static vote weights of a mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from splatlake import config as cfg
from splatlake.functions.camera import clip


def literal_map(values: dict, key: Column, default) -> Column:
    """A small fixed table as a literal map lookup."""
    text = ", ".join(f"'{k}', {float(v)!r}D" if isinstance(v, float) else f"'{k}', {v}" for k, v in values.items())
    return F.coalesce(F.expr(f"map({text})")[key], F.lit(default))


def label_frequency_weight(masks: DataFrame, power=cfg.FREQUENCY_POWER, lo=cfg.WEIGHT_MIN,
                           hi=cfg.WEIGHT_MAX) -> DataFrame:
    """(scan_id, label, label_mask_count, label_frequency_weight); the median is over labels."""
    counts = masks.groupBy("scan_id", "label").agg(F.count("*").alias("label_mask_count"))
    medians = counts.groupBy("scan_id").agg(F.median("label_mask_count").alias("_median"))
    ratio = F.col("_median") / F.greatest(F.col("label_mask_count"), F.lit(1)).cast("double")
    return counts.join(medians, "scan_id").select(
        "scan_id", "label", "label_mask_count",
        clip(F.pow(ratio, F.lit(power)), lo, hi).alias("label_frequency_weight"),
    )


def mask_area_weight(area_fraction: Column, ref=cfg.AREA_REFERENCE, power=0.5, lo=cfg.WEIGHT_MIN,
                     hi=cfg.WEIGHT_MAX) -> Column:
    return clip(F.pow(F.lit(ref) / F.greatest(area_fraction, F.lit(1e-6)), F.lit(power)), lo, hi)


def is_surface(label: Column) -> Column:
    return label.isin(cfg.SURFACE_LABELS)


def role_weight(label: Column) -> Column:
    return literal_map(cfg.SURFACE_WEIGHTS, label, cfg.OBJECT_WEIGHT)


def mask_dilation(label: Column) -> Column:
    return F.when(is_surface(label), F.lit(0)).otherwise(F.lit(cfg.OBJECT_DILATION))
