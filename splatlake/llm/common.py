"""Small shared helpers: tables, scratch tables, digests, and words of many texts as arrays."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from splatlake.session import checkpoint_dir, cut  # noqa: F401  (cut is used by the operators)

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BASE32 = LETTERS + "234567"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder of ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def bound_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keeps Arrow batches small: they are bounded by rows alone, and rows here hold whole texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def held_out(doc_id: Column) -> Column:
    """Rows kept out of any learning: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled(labels: DataFrame, target: str) -> DataFrame:
    """One row (doc_id, y) per labelled document; a contradictory label counts as 0."""
    return labels.where(F.col("doc_id").isNotNull() & F.col(target).isin(0, 1)).groupBy("doc_id").agg(F.min(target).cast("int").alias("y"))


def base32(hex_digest: Column) -> Column:
    """Base32 text of a hex digest whose length is a multiple of five characters."""
    def four(i: Column) -> Column:
        n = F.conv(F.substring(hex_digest, i * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return F.concat(*[F.substring(F.lit(BASE32), F.shiftright(n, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)])

    return F.array_join(F.transform(F.sequence(F.lit(0), (F.length(hex_digest) / 5).cast("int") - 1), lambda i: four(i.cast("int"))), "")


def slices(frames: Iterator[pd.DataFrame], column: str, most: int) -> Iterator[pd.DataFrame]:
    """Arrow batches cut so that a slice holds about ``most`` characters, one row at least."""
    for pdf in frames:
        size = pdf[column].str.len().fillna(0).to_numpy().astype(np.int64)
        at = np.cumsum(size) // most
        for start, end in zip(bounds := np.flatnonzero(np.diff(at, prepend=-1)), [*bounds[1:], len(pdf)]):
            yield pdf.iloc[start:end]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_classes(split_marks: bool) -> np.ndarray:
    """0 for white space (0x20, 0x09-0x0D), else 1; with ``split_marks`` ASCII punctuation is 2."""
    out = np.ones(256, np.uint8)
    if split_marks:
        out[[c for c in range(33, 127) if not chr(c).isalnum()]] = 2
    out[[0x20, *range(0x09, 0x0E)]] = 0
    return out


def hashed_runs(texts: list[bytes], classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every maximal run of bytes of one class other than 0, in order.

    The hash of a run is a multilinear sum over its bytes with one fixed odd random factor per
    position, finished by ``mix``; no text is looped over in Python.
    """
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    kind = classes[data]
    ends_of = np.cumsum([len(t) + 1 for t in texts])
    change = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    starts = np.concatenate(([0], change)) if len(data) else change
    live = kind[starts] != 0
    if not live.any():
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    lengths = np.diff(np.append(starts, len(data)))
    place = np.arange(len(data)) - np.repeat(starts, lengths)
    factor = mix((np.arange(int(lengths.max()), dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    sums = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * factor[place], starts)
    hashes = mix(sums + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return hashes[live], np.searchsorted(ends_of, starts[live], side="right")
