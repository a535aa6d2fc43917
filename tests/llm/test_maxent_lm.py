"""Language-model scores: counts by brute force, probabilities that sum to one, held-out gain, edge cases."""

import collections
import math
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from splatlake.llm import common, maxent_lm

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORDS.findall("".join(c.lower() if c.isascii() else c for c in text or "")) + [None]


def left_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def check_base(rows, got):
    count = collections.Counter(w for d, t in rows if not left_out(d) for w in words(t))
    n, v = sum(count.values()), len(count)
    want = sorted((str(d), left_out(d), len(words(t)), sum(count[w] > 0 for w in words(t)), n,
                   round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words(t)), 6)) for d, t in rows)
    assert want == sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)


def test_tokens():
    texts = ["Ab c\td", None, "", " \n ", "É x\x00y \x00", "z" * 100_000 + " q", "ab C"]
    hashes, _, owner = maxent_lm.tokens(texts)
    named = {}
    flat = [(k, w) for k, t in enumerate(texts) for w in words(t)]
    assert owner.tolist() == [k for k, _ in flat]
    for h, (_, w) in zip(hashes.tolist(), flat):
        assert named.setdefault(w, h) == h
    assert len(set(named.values())) == len(named)


def test_base_and_gain(spark, sf):
    docs = common.table(spark, sf, "documents")
    got = maxent_lm.document_scores(docs).collect()
    check_base([(r.doc_id, r.text) for r in docs.collect()], got)
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_classes_sum_to_one():
    rng = np.random.default_rng(1)
    weights = rng.normal(0, 1, (maxent_lm.ROWS, maxent_lm.CLASSES)).astype(np.float32)
    hashes, _, owner = maxent_lm.tokens(["a b c d e", "", "f g"])
    rows = maxent_lm.history_rows(hashes, owner)
    every = [maxent_lm.log_class(weights, rows, np.full(len(hashes), c)) for c in range(maxent_lm.CLASSES)]
    assert np.allclose(np.exp(every).sum(axis=0), 1, atol=1e-5)
    one = maxent_lm.history_rows(*maxent_lm.tokens(["f g"])[::2])
    assert (rows[:, -3:] == one).all()  # what stands in other texts does not matter


def test_edges(spark):
    text = "alpha beta gamma delta"
    rows = [(k, text) for k in range(40)] + [(3, text), (None, "alpha omega"), (None, None), (100, ""), (101, " \n"), (102, "word " * 60_000), (2**60 + 1, "é É")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    clash = docs.withColumns({c: F.lit("clash") for c in ("word", "n", "part", "rid", "logs", "known", "far", "ending", "trained", "held_out")})
    check_base(rows, maxent_lm.document_scores(clash).collect())
    assert maxent_lm.document_scores(docs.limit(0)).count() == 0
    out = [d for d in range(200) if left_out(d)][:2]
    unknown = maxent_lm.document_scores(spark.createDataFrame([(d, "a b") for d in out], "doc_id bigint, text string")).collect()
    assert [(r.n_known, r.train_tokens, r.base_score) for r in unknown] == [(0, 0, 0.0)] * 2
    assert all(abs(r.score - 3 * math.log10(1 / maxent_lm.CLASSES)) < 1e-6 for r in unknown)
