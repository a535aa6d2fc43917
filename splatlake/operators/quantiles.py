"""Exact quantiles of groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from splatlake.operators.skew import ordered_rank


def exact_quantiles(df: DataFrame, keys: list[str], wanted: dict[str, list[float]]) -> DataFrame:
    """(keys, q_<name>: array of quantiles) for each numeric column in ``wanted``.

    Values are ranked over range partitions, so a group spans many tasks, and the two ranks around
    each quantile are interpolated.  Nulls are left out; NaN counts as the largest value.
    """
    values = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("v")) for n in wanted]))
    rows = df.select(*keys, values.alias("_x")).select(*keys, F.col("_x.name").alias("_name"), F.col("_x.v").alias("_v")).where("_v IS NOT NULL")
    ranked = ordered_rank(rows, [*keys, "_name"], [F.col("_v")], "_r")
    at = {(n, k): F.lit(float(q)) * (F.col("_r_total") - 1) for n, qs in wanted.items() for k, q in enumerate(qs)}
    place = F.col("_r") - 1
    chosen = lambda n, p, end: (F.col("_name") == n) & (place == end(p))
    near = reduce(Column.__or__, [chosen(n, p, end) for (n, _), p in at.items() for end in (F.floor, F.ceil)])
    sums = []
    for (n, k), p in at.items():
        sums += [F.max(F.when(chosen(n, p, F.floor), F.col("_v"))).alias(f"_l_{n}_{k}"), F.max(F.when(chosen(n, p, F.ceil), F.col("_v"))).alias(f"_h_{n}_{k}"),
                 F.max(F.when(F.col("_name") == n, p - F.floor(p))).alias(f"_f_{n}_{k}")]
    g = ranked.where(near).groupBy(*keys).agg(*sums)

    def between(n: str, k: int) -> Column:
        low, high, part = F.col(f"_l_{n}_{k}"), F.col(f"_h_{n}_{k}"), F.col(f"_f_{n}_{k}")
        return F.when(part == 0, low).otherwise(low * (1 - part) + high * part)

    return g.select(*keys, *[F.array(*[between(n, k) for k in range(len(qs))]).alias(f"q_{n}") for n, qs in wanted.items()])


def attach(df: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys that may be null."""
    found = found.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in found.columns if c not in keys])
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return df.join(found, same, "left").drop(*[f"_k_{k}" for k in keys])
