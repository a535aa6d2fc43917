"""The prefix trie against a brute force over all prefixes, over chunks and partition boundaries of several sizes."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from splatlake.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            code = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            own.setdefault(c, []).append(((turn is not None, turn or 0), code, role, text))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        whole[c] = own.get(base, [])[:h] + turns[h:]
    members = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids, leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1].encode()) if p else 0)
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(whole[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def made(conversations, chunk):
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(conversations, chunk).collect()), key=repr)


def random_rows(seed, convs=150, most=12):
    rng = random.Random(seed)
    texts = ["", "a", "bb", "é" * 3, None]
    shared = [(rng.choice(["user", "assistant", None]), rng.choice(texts)) for _ in range(most)]
    rows = []
    for c in rng.sample(range(-40, 400), convs):
        kind = rng.random()
        n = rng.choice([1, 2, 3, 9, 10, most])
        turns = shared[:n] if kind < 0.6 else [(rng.choice(["user", "assistant"]), rng.choice(texts)) for _ in range(n)]
        if 0.3 < kind < 0.6 and n > 3:
            turns = turns[:-2] + [("user", rng.choice("xyz"))]
        rows += [(c, k if rng.random() < 0.95 else None, r, t) for k, (r, t) in enumerate(turns)]
    return rows


@pytest.mark.parametrize("chunk", [5, 64])
def test_against_all_prefixes(spark, chunk):
    rows = random_rows(chunk)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 7)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that groups reach over partitions
        assert made(spark.createDataFrame(rows, SCHEMA), chunk) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)


def test_edges(spark):
    rows = [(1, 0, "user", "x"), (1, 0, "user", "x"), (1, None, None, None), (2, 5, "user", ""), (None, 1, "user", "lost"), (7, 0, None, "long " * 50_000),
            (7, 1, "user", "y"), (7, 1, "user", "x"), (5, 0, "", ""), (6, 0, "", ""), (6, 1, "a", "b"), (2**60 + 1, 0, "u", "v"), (2**60 + 2, 0, "u", "v")]
    extra = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("code", "at", "k", "pid", "key", "bytes", "prefix", "root", "base", "h", "_n")})
    assert made(extra, 64) == brute(rows)
    assert made(extra.limit(0), 64) == []
    assert made(extra.where("conv_id IS NULL"), 64) == []
