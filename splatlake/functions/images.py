"""Thumbnails, sharpness and binary descriptors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def thumb_diff(a: Column, b: Column) -> Column:
    """Mean absolute difference of two equally long gray thumbnails."""
    total = F.aggregate(
        F.zip_with(a, b, lambda p, q: F.abs(p.cast("double") - q.cast("double"))), F.lit(0.0), lambda s, v: s + v
    )
    return total / F.size(a)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two descriptors held as arrays of longs."""
    return F.aggregate(
        F.zip_with(a, b, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v
    )


def sharpness(pixels: DataFrame) -> DataFrame:
    """Population variance of the 4-neighbour Laplacian per frame; borders mirror without repeat.

    Every pixel adds its value to the (mirrored) positions that read it, so one aggregation on the
    pixel key replaces four self joins.
    """
    dims = pixels.groupBy("scan_id", "frame_index").agg(F.max("x").alias("_mx"), F.max("y").alias("_my"))
    px = pixels.join(dims, ["scan_id", "frame_index"])

    def reads(dx, dy):
        # position whose (dx, dy) neighbour is this pixel, plus the mirrored border reader
        x, y = F.col("x") - dx, F.col("y") - dy
        return F.struct(x.alias("x"), y.alias("y"), F.lit(1.0).alias("w"))

    targets = [F.struct(F.col("x").alias("x"), F.col("y").alias("y"), F.lit(-4.0).alias("w"))]
    targets += [reads(dx, dy) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))]
    none = F.struct(F.lit(-1).alias("x"), F.lit(-1).alias("y"), F.lit(0.0).alias("w"))

    def mirror(cond, x, y):
        return F.when(cond, F.struct(x.alias("x"), y.alias("y"), F.lit(1.0).alias("w"))).otherwise(none)

    targets += [
        mirror(F.col("x") == 1, F.lit(0), F.col("y")),
        mirror(F.col("x") == F.col("_mx") - 1, F.col("_mx"), F.col("y")),
        mirror(F.col("y") == 1, F.col("x"), F.lit(0)),
        mirror(F.col("y") == F.col("_my") - 1, F.col("x"), F.col("_my")),
    ]
    spread = px.select("scan_id", "frame_index", "_mx", "_my", "value", F.explode(F.array(*targets)).alias("t"))
    spread = spread.where(
        (F.col("t.x") >= 0) & (F.col("t.y") >= 0) & (F.col("t.x") <= F.col("_mx")) & (F.col("t.y") <= F.col("_my"))
    )
    lap = spread.groupBy("scan_id", "frame_index", "t.x", "t.y").agg(F.sum(F.col("value") * F.col("t.w")).alias("lap"))
    return lap.groupBy("scan_id", "frame_index").agg(F.var_pop("lap").alias("sharpness"))
