"""Joins and rankings that stay spread when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from splatlake.session import cut

# Rows of one key that a single task may take.  The list of hotter keys has at most
# (total rows / HOT_ROWS) entries, which is what makes broadcasting that list safe.
HOT_ROWS = 2_000_000


def spread_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join that shuffles both sides and is never a broadcast.

    Spark guesses the size of a table of generated rows (runs, cells, samples) from the table it was
    made of, so a large one would be sent through the driver.
    """
    return left.join(right.hint("merge"), on, how)


def skew_join(big: DataFrame, small: DataFrame, keys: list[str], spread: list[str],
              hot_rows: int = HOT_ROWS, fan_out: bool = False) -> DataFrame:
    """Inner equi-join; a key of ``big`` above ``hot_rows`` rows is split over several tasks.

    ``spread`` names columns of ``big`` that tell rows of one key apart.  The matching rows of
    ``small`` are repeated once per split of their key, and only for hot keys.  With ``fan_out`` a row of
    ``big`` meets many of ``small``: all shuffle partitions take part, as tasks merged by the bytes that
    they read would each hold a growing share of the pairs.
    """
    hot = (
        big.groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") > hot_rows)
        .select(*keys, F.ceil(F.col("_rows") / hot_rows).cast("int").alias("_splits"))
    )
    splits = F.coalesce("_splits", F.lit(1))
    left = big.join(F.broadcast(hot), keys, "left").withColumn(
        "_part", F.pmod(F.xxhash64(*spread), splits).cast("int")
    ).drop("_splits")
    right = small.join(F.broadcast(hot), keys, "left").withColumn(
        "_part", F.explode(F.sequence(F.lit(0), splits - 1))
    ).drop("_splits")
    on = [*keys, "_part"]
    if fan_out:
        tasks = int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        left, right = left.repartition(tasks, *on), right.repartition(tasks, *on)
    return spread_join(left, right, on).drop("_part")


def ordered_rank(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """``row_number`` per key for groups of any size.

    Rows are range-partitioned on (keys, order), so a large group spans many tasks; each task
    ranks its slice and adds the number of rows that the earlier slices hold for the key.  The
    ranges are fixed by a checkpoint before they are counted.
    """
    ranged = df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_slice", F.spark_partition_id())
    ranged = cut(ranged)
    held = ranged.groupBy(*keys, "_slice").agg(F.count("*").alias("_held"))
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = held.select(*keys, "_slice", F.coalesce(F.sum("_held").over(before), F.lit(0)).alias("_before"),
                          F.sum("_held").over(W.partitionBy(*keys)).alias("_total"))
    local = F.row_number().over(W.partitionBy(*keys, "_slice").orderBy(*order))
    offsets = offsets.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_slice").alias("_at"), "_before", "_total")
    same = F.col("_slice") == F.col("_at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    out = ranged.withColumn("_local", local).join(offsets, same).drop("_at", *[f"_key_{k}" for k in keys])
    return out.withColumn(name, (F.col("_before") + F.col("_local")).cast("bigint")).withColumn(
        f"{name}_total", F.col("_total")
    ).drop("_local", "_before", "_slice", "_total")
