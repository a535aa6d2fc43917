"""Quality scores: random-indexing word vectors, pooled per document, and a small calibrated network.

Tokens are runs of word bytes or of ASCII marks, hashed to a fixed number of buckets.  Every bucket
has a fixed sparse ternary index vector; the context vector of a bucket is the sum of the index
vectors that occur within two tokens of it, over the whole corpus.  These are integer counts, so
their sum does not depend on the partitioning, and each task passes on at most one row per bucket.
A document is the frequency-damped mean of its tokens' unit context vectors, with how far they
spread and the logarithm of their number.  Learning takes a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from splatlake.llm import query
from splatlake.llm.common import bound_batches, byte_classes, cut, hashed_runs, held_out, labelled, mix, slices, table

BUCKETS, WIDTH, NONZEROS, WINDOW = 1 << 14, 32, 2, 2  # the word table has BUCKETS x WIDTH numbers, whatever the corpus
SAMPLE_ROWS = 20_000  # labelled rows that learning may take
SLICE_CHARS = 500_000
FEATURES = WIDTH + 2


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries of each bucket's index vector."""
    seed = mix(np.arange(BUCKETS * NONZEROS, dtype=np.uint64) + np.uint64(0x5851F42D4C957F2D)).reshape(BUCKETS, NONZEROS)
    return (seed % np.uint64(WIDTH)).astype(np.int64), ((seed >> np.uint64(40)) & np.uint64(1)).astype(np.float64) * 2 - 1


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    hashes, owner = hashed_runs(data, byte_classes(True)) if data else (np.empty(0, np.uint64), np.empty(0, np.int64))
    return (hashes >> np.uint64(64 - 14)).astype(np.int64), owner


def context_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    places, signs = index_vectors()
    total, seen = np.zeros(BUCKETS * WIDTH), np.zeros(BUCKETS, np.int64)
    for pdf in slices(frames, "text", SLICE_CHARS):
        bucket, owner = tokens(pdf["text"].tolist())
        seen += np.bincount(bucket, minlength=BUCKETS)
        for step in range(1, WINDOW + 1):
            near = owner[step:] == owner[:-step]
            for at, other in ((bucket[:-step][near], bucket[step:][near]), (bucket[step:][near], bucket[:-step][near])):
                for k in range(NONZEROS):
                    total += np.bincount(at * WIDTH + places[other, k], weights=signs[other, k], minlength=BUCKETS * WIDTH)
    used = np.flatnonzero(seen)
    out = pd.DataFrame(total.reshape(BUCKETS, WIDTH)[used].astype(np.int64), columns=[f"c{k}" for k in range(WIDTH)])
    yield out.assign(bucket=used, seen=seen[used])


def word_table(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Unit context vectors (BUCKETS, WIDTH) and damping weights (BUCKETS) from all texts."""
    names = [f"c{k}" for k in range(WIDTH)]
    schema = ", ".join(f"{c} bigint" for c in [*names, "bucket", "seen"])
    sums = docs.select("text").mapInPandas(context_counts, schema).groupBy("bucket").agg(*[F.sum(c).alias(c) for c in [*names, "seen"]])
    got = sums.toPandas()  # at most BUCKETS rows
    vectors, seen = np.zeros((BUCKETS, WIDTH)), np.zeros(BUCKETS)
    vectors[got["bucket"]] = got[names]
    seen[got["bucket"]] = got["seen"]
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    share = seen / max(seen.sum(), 1)
    return (vectors / np.where(norms == 0, 1, norms)).astype(np.float32), (1e-3 / (1e-3 + share)).astype(np.float32)


def pooled(docs: DataFrame, vectors: np.ndarray, weights: np.ndarray) -> DataFrame:
    """(doc_id, digest, x): the pooled vector of every text, zeros for one without tokens, and the text's digest."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((vectors, weights))  # fixed size: BUCKETS x (WIDTH + 1) floats

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vec, wt = shared.value
        for pdf in slices(frames, "text", SLICE_CHARS // 4):
            bucket, owner = tokens(pdf["text"].tolist())
            x = np.zeros((len(pdf), FEATURES), np.float32)
            if len(bucket):
                starts = np.flatnonzero(np.diff(owner, prepend=-1))
                own, w = owner[starts], wt[bucket]
                mass = np.add.reduceat(w, starts)
                mean = np.add.reduceat(vec[bucket] * w[:, None], starts, axis=0) / mass[:, None]
                x[own, :WIDTH] = mean
                x[own, WIDTH] = 1 - (mean * mean).sum(axis=1)
                x[own, WIDTH + 1] = np.log1p(np.diff(np.append(starts, len(bucket)))) / 10
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "digest": pdf["digest"], "x": list(x)})

    # ids travel as text: with nulls among them pandas would make them floats
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), text_digest(F.col("text")).alias("digest"), "text")
    return rows.mapInPandas(run, "doc_id string, digest string, x array<float>").withColumn("doc_id", F.col("doc_id").cast("bigint"))


def text_digest(text: Column) -> Column:
    return F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


class Network:
    """Two layers, trained by Adam on mini-batches; a temperature fitted on rows kept aside."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 40, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        x = (x - self.mean) / self.scale
        aside = np.arange(len(x)) % 5 == 0
        train, kept = np.flatnonzero(~aside), np.flatnonzero(aside)
        p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden ** -0.5, hidden), np.zeros(1)]
        m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for _ in range(epochs):
            for rows in np.array_split(rng.permutation(train), max(1, len(train) // 128)):
                if not len(rows):
                    continue
                h = np.maximum(x[rows] @ p[0] + p[1], 0)
                d = (sigmoid(h @ p[2] + p[3]) - y[rows]) / len(rows)
                back = np.outer(d, p[2]) * (h > 0)
                step += 1
                for k, g in enumerate((x[rows].T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ d + 1e-4 * p[2], d.sum(keepdims=True))):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    p[k] = p[k] - 0.005 * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
        self.p, self.temperature = p, 1.0
        if len(kept):
            z, grid = self.logits(x[kept]), np.exp(np.linspace(-2, 2, 81))
            loss = [np.logaddexp(0, np.where(y[kept] == 1, -z, z) / t).sum() for t in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.p[0] + self.p[1], 0) @ self.p[2] + self.p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits((x - self.mean) / self.scale) / self.temperature)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of (doc_id, text).

    ``labels``: (doc_id, quality); rows with another value than 0 or 1 are ignored, and rows held
    out are never learned from.  Without two classes to learn from every score is the share of
    label 1, or 0.5 without labels.  Null, empty and blank texts get the score of the zero vector;
    null ids are scored and not held out; repeated rows are scored each.  Other columns are ignored.
    """
    return scored_rows(docs, labels).drop("digest")


def scored_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of :func:`quality_scores` and the digest of the text."""
    bound_batches(docs.sparkSession)
    vectors, weights = word_table(docs)
    x = cut(pooled(docs, vectors, weights))
    known = labelled(labels, "quality").where(~held_out(F.col("doc_id")))
    sample = x.join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS).select("x", "y").toPandas()
    if sample["y"].nunique() < 2:
        share = float(sample["y"].mean()) if len(sample) else 0.5
        score = F.lit(share)
        out = x.withColumn("score", score)
    else:
        net = Network(np.stack(sample["x"].to_numpy()).astype(np.float64), sample["y"].to_numpy().astype(np.float64))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                values = net.score(np.stack(pdf["x"].to_numpy()).astype(np.float64)) if len(pdf) else []
                yield pd.DataFrame({"doc_id": pdf["doc_id"], "digest": pdf["digest"], "score": values})

        out = x.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(run, "doc_id string, digest string, score double")
        out = out.withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "digest")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents predicted to be good; columns as given.

    A row is judged by its own text: of rows with null or repeated ids only those with a good text
    stay, repeated rows stay or go together, null and empty texts share a verdict.
    """
    good = scored_rows(docs, labels).where("predicted = 1").select(F.col("doc_id").alias("_good"), F.col("digest").alias("_digest")).distinct()
    return docs.join(good, F.col("doc_id").cast("bigint").eqNullSafe(F.col("_good")) & (text_digest(F.col("text")) == F.col("_digest")), "left_semi")


@query("op5_quality_model")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
