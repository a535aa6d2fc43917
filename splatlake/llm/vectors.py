"""Near-duplicate vectors: sign hashes of random hyperplanes in several tables, exact check, components.

Two unit vectors at cosine c fall on the same side of a random hyperplane with probability
1 - acos(c) / pi.  A table's code joins ``bits`` such signs; ``bits`` grows with the logarithm of
the number of vectors, so that unrelated vectors rarely meet, and the number of tables follows from
the wanted recall at the threshold.  Both are functions of the row count alone.

Only vectors that share a bucket with another one travel, in blocks of bounded size; a bucket of any
size becomes pairs of blocks.  A task checks all pairs of its blocks in double precision, counts a
pair in the first table that brings it together, and passes on one line per vector (its number of
links, and the smallest vector its block's links reach), never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from splatlake.llm import query
from splatlake.llm.common import bound_batches, cut, table
from splatlake.operators.components import connected_components

BLOCK = 256
PAIRS_AT_ONCE = 40_000


def table_shape(rows: int, threshold: float, recall: float) -> tuple[int, int]:
    """(bits, tables) for a corpus of ``rows`` vectors."""
    bits = min(60, max(8, math.ceil(math.log2(max(rows, 2)))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same))


def sign_codes(vectors: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """One integer per vector and table, its signs against that table's hyperplanes."""
    out = np.zeros((len(vectors), tables), np.int64)
    for t in range(tables):
        planes = np.random.default_rng([seed, t, vectors.shape[1]]).standard_normal((vectors.shape[1], bits))
        out[:, t] = ((vectors @ planes) >= 0) @ (np.int64(1) << np.arange(bits, dtype=np.int64))
    return out


def close_pairs(sizes: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """All row pairs (i < j) of consecutive groups of ``sizes``, for rows i of [first, last)."""
    ends = np.repeat(np.cumsum(sizes), sizes)[first:last]
    rows = np.arange(first, last)
    reps = ends - rows - 1
    left = np.repeat(rows, reps)
    return left, left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(reps) - reps, reps)


def local_roots(n: int, left: np.ndarray, right: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Per vertex the smallest id its links reach."""
    low = ids.copy()
    while True:
        before = low.copy()
        np.minimum.at(low, left, before[right])
        np.minimum.at(low, right, before[left])
        if (low == before).all():
            return low


def check_blocks(threshold: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in frames:
            rest = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            last = rest.iloc[-1]
            tail = int(((rest["t"] == last["t"]) & (rest["code"] == last["code"]) & (rest["dim"] == last["dim"])
                        & (rest["a"] == last["a"]) & (rest["b"] == last["b"])).sum())
            if tail < len(rest):  # the last group may go on in the next batch
                yield from work(rest.iloc[: len(rest) - tail])
                rest = rest.iloc[len(rest) - tail:].reset_index(drop=True)
        if rest is not None and len(rest):
            yield from work(rest)

    def work(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for _, part in pdf.groupby("dim", sort=False):
            key = part[["t", "code", "a", "b"]].to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1))))
            sizes = np.diff(np.append(starts, len(part)))
            vectors = np.stack(part["v"].to_numpy()).astype(np.float64)
            norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
            codes = np.stack(part["codes"].to_numpy())
            ids, copies, side = part["id"].to_numpy(), part["copies"].to_numpy(), part["side"].to_numpy()
            across, t = (part["a"] != part["b"]).to_numpy(), part["t"].to_numpy()
            later = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(part)) - 1
            at = np.cumsum(later) // PAIRS_AT_ONCE
            edges = np.append(np.flatnonzero(np.diff(at, prepend=-1)), len(part))
            links = np.zeros(len(part), np.int64)
            found = []
            for first, last in zip(edges[:-1], edges[1:]):
                i, j = close_pairs(sizes, first, last)
                keep = ~across[i] | (side[i] != side[j])
                i, j = i[keep], j[keep]
                cosine = np.einsum("ij,ij->i", vectors[i], vectors[j]) / (norms[i] * norms[j])
                i, j = i[cosine >= threshold], j[cosine >= threshold]
                earlier = ((codes[i] == codes[j]) & (np.arange(codes.shape[1]) < t[i][:, None])).any(axis=1)
                np.add.at(links, i[~earlier], copies[j[~earlier]])
                np.add.at(links, j[~earlier], copies[i[~earlier]])
                found.append((i, j))
            i, j = (np.concatenate(x) for x in zip(*found))
            # vertices of the local step are vectors, not rows: the first row of a vector stands for it
            names, row = np.unique(ids, return_inverse=True)
            root = local_roots(len(names), row[i], row[j], names)
            out = pd.DataFrame({"id": names, "links": np.bincount(row, weights=links, minlength=len(names)).astype(np.int64), "root": root})
            yield out[(out["links"] > 0) | (out["id"] != out["root"])]

    return run


def near_vectors(rows: DataFrame, threshold: float = 0.95, recall: float = 0.998, seed: int = 7, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of (vec_id, embedding).

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing and
    are their own component, as are vectors of a length no other row has.  Equal vectors are one
    vertex with a number of copies.  A row with a null id counts among the copies of its vector, but
    a vector that only such rows hold links with nothing.  An empty table gives an empty result; other columns are ignored.
    """
    bound_batches(rows.sparkSession)
    v = F.col("embedding").cast("array<double>")
    whole = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    usable = F.coalesce(whole & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = rows.select("vec_id", F.when(usable, v).alias("v")).withColumn("key", F.sha2(F.to_json(F.col("v")), 256))
    ids = cut(rows.select("vec_id", "key"))
    classes = cut(rows.where("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")))
    # the vector of a class is the one of the row that names it
    named = rows.select(F.col("vec_id"), "key", "v").join(classes.withColumnRenamed("key", "_k"), (F.col("key") == F.col("_k")) & (F.col("vec_id") == F.col("id")))
    named = named.select("id", "copies", "v").dropDuplicates(["id"])
    bits, tables = table_shape(classes.count(), threshold, recall)

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            codes = pd.Series([None] * len(pdf), index=pdf.index, dtype=object)
            for _, part in pdf.groupby(pdf["v"].str.len(), sort=False):
                for at, code in zip(part.index, sign_codes(np.stack(part["v"].to_numpy()), bits, tables, seed)):
                    codes[at] = code
            yield pdf.assign(codes=codes)

    coded = cut(named.mapInPandas(hashed, "id bigint, copies bigint, v array<double>, codes array<bigint>"))
    bucket = ["dim", "t", "code"]
    slim = coded.select("id", F.size("v").alias("dim"), F.posexplode("codes").alias("t", "code"))
    crowded = slim.groupBy(*bucket).agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).drop("n")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    met = slim.join(crowded, bucket).withColumn("own", own)
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("id", *bucket, F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    sent = met.join(coded, "id").repartition(*bucket, "a", "b").sortWithinPartitions(*bucket, "a", "b")
    found = cut(sent.mapInPandas(check_blocks(threshold), "id bigint, links bigint, root bigint"))
    totals = found.groupBy("id").agg(F.sum("links").alias("links"))
    comp = connected_components(classes.select("id"), found.select(F.col("id").alias("src"), F.col("root").alias("dst")), [])
    named = cut(classes.where("id IS NOT NULL").join(comp, "id").join(totals, "id", "left").select(
        "key", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    out = ids.join(named, "key", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


ORACLE = """
WITH RECURSIVE u AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS s, b.vec_id AS d FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
reach(s, d) AS (SELECT s, d FROM links UNION SELECT r.s, l.d FROM reach r JOIN links l ON r.d = l.s)
SELECT e.vec_id, CAST((SELECT count(*) FROM links l WHERE l.s = e.vec_id) AS BIGINT) AS n_links,
       least(e.vec_id, coalesce((SELECT min(d) FROM reach r WHERE r.s = e.vec_id), e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce((SELECT min(d) FROM reach r WHERE r.s = e.vec_id), e.vec_id)) AS kept
FROM embeddings e"""


@query("op3_near_vectors", ORACLE)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
