"""The source audit against a plain recount, and the perfect hash by itself."""

import collections
import re

import numpy as np
from pyspark.sql import functions as F

from splatlake.llm import common, source_audit

TERMS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, min_docs, top):
    rows = [(g or "", s or "", [w.translate({c: c + 32 for c in range(65, 91)}) for w in TERMS.findall(t or "")]) for g, s, t in rows]
    held, count, lang_count = collections.Counter(), collections.Counter(), collections.Counter()
    for g, _, terms in rows:
        held.update((g, w) for w in set(terms))
    kept = {k for k, n in held.items() if n >= min_docs}
    for g, s, terms in rows:
        for w in terms:
            if (g, w) in kept:
                count[g, s, w] += 1
                lang_count[g, w] += 1
    out = []
    for g in {r[0] for r in rows}:
        mine = [w for h, w in kept if h == g]
        share = lambda n, total: 1 + 10**9 * (n + 5) // (total + 5 * len(mine))
        sources = sorted({r[1] for r in rows if r[0] == g})
        total = {s: sum(count[g, s, w] for w in mine) for s in sources}
        p = {s: {w: share(count[g, s, w], total[s]) for w in mine} for s in sources}
        whole = sum(total.values())
        for s in sources:
            pairs = [(t, sum(abs(p[s][w] - p[t][w]) for w in mine)) for t in sources if t != s]
            more = [(w, p[s][w] - share(lang_count[g, w], whole)) for w in mine if count[g, s, w]]
            for part, found, most in (("pair", pairs, None), ("term", [m for m in more if m[1] > 0], top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(g, s, part, item, value, k) for k, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def test_documents(spark, sf):
    docs = common.table(spark, sf, "documents")
    rows = [(r.lang, r.source, r.text) for r in docs.collect()]
    for min_docs, top in ((source_audit.MIN_DOCS, source_audit.TOP), (3, 5)):
        assert sorted(map(tuple, source_audit.source_divergence(docs, min_docs, top).collect())) == plain(rows, min_docs, top)


def test_edges(spark):
    rows = [("en", "a", "One two, TWO three's É é"), ("en", "b", "one\x00two 1one1"), ("en", "b", None), ("en", None, "one one"), (None, "a", "two"), (None, None, "two zwei"),
            ("de", "a", ""), ("de", "b", "12 34"), ("fr", "only", "un deux"), ("en", "a", "One two, TWO three's É é"), ("en", "é", "one " * 300_000 + "x" * 100_000), ("e n", "s p", "one two")]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    clash = docs.withColumns({c: F.lit("clash") for c in ("term", "n", "slot", "item", "value", "kept", "total", "shard", "key", "hash", "doc_id")})
    for min_docs in (1, 2):
        assert sorted(map(tuple, source_audit.source_divergence(clash, min_docs, 3).collect())) == plain(rows, min_docs, 3)
    assert source_audit.source_divergence(docs.limit(0)).count() == 0


def test_perfect_hash():
    hashes = common.mix(np.arange(20_000, dtype=np.uint64) + np.uint64(1))
    hashes[7] = hashes[9]  # keys that the hash cannot tell apart
    perfect = source_audit.PerfectHash(hashes)
    assert sorted(perfect.slots.tolist()) == list(range(len(hashes)))
    found = perfect.find(hashes)
    single = np.array([k for k in range(len(hashes)) if k not in (7, 9)])
    assert (found[single] == perfect.slots[single]).all()
    assert sorted(perfect.rest[int(hashes[7])]) == sorted(perfect.slots[[7, 9]].tolist())


def test_many_shards(spark, sf, monkeypatch):
    docs = common.table(spark, sf, "documents")
    want = sorted(map(tuple, source_audit.source_divergence(docs, 5).collect()))
    monkeypatch.setattr(source_audit, "SHARD_BYTES", 3_000)
    monkeypatch.setattr(source_audit, "PASS_BYTES", 40_000)
    assert sorted(map(tuple, source_audit.source_divergence(docs, 5).collect())) == want
