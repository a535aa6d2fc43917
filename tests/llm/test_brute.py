"""The operators against brute force, public libraries, exact round trips and held-out labels."""

import base64
import collections
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from splatlake.llm import byte_bpe, common, minhash, packing, quality_model, quality_rules, secret_scan, vectors

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark, sf):
    return common.table(spark, sf, "documents")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}


def brute_groups(sets, percent=80):
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    names = sorted(sets)
    for i, a in enumerate(names):
        for b in names[:i]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}


def shingles(text, width):
    words = WORDS.findall("".join(c.lower() if c.isascii() else c for c in text))
    return {tuple(words[i: i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


@pytest.mark.parametrize("width", [2, 5])
def test_near_documents(documents, texts, width):
    sets = {d: shingles(t, width) for d, t in texts.items()}
    want = brute_groups(sets)
    got = {r.doc_id: r for r in minhash.near_documents(documents, width).collect()}
    assert {d: len(s) for d, s in sets.items()} == {d: r.n_shingles for d, r in got.items()}
    assert want == {d: r.component_id for d, r in got.items()}


def test_near_copies_that_only_meet_through_others(spark):
    """A large group of random edits: few pairs are close to one member, many are just too far apart."""
    rng = random.Random(4)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for d in range(300):
        words = list(base)
        for at in rng.sample(range(150), rng.randint(3, 9)):
            words[at] = f"x{rng.random()}"
        rows.append((d, " ".join(words)))
    want = brute_groups({d: shingles(t, 2) for d, t in rows})
    got = {r.doc_id: r.component_id for r in minhash.near_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), 2).collect()}
    assert got == want and 2 < len(set(want.values())) < 200


def test_super_minhash_estimates_similarity():
    rng = np.random.default_rng(1)
    for n, shared in ((40, 20), (400, 320), (3000, 1500)):
        pool = rng.integers(0, 2**63, 2 * n).astype(np.uint64)
        a, b = pool[:n], pool[n - shared: 2 * n - shared]
        sig = minhash.super_minhash(np.concatenate([a, b]), np.repeat([0, 1], n), 2)
        truth = shared / (2 * n - shared)
        assert abs((sig[0] == sig[1]).mean() - truth) < 0.15
        alone = minhash.super_minhash(a, np.zeros(n, np.int64), 1)
        assert (alone[0] == sig[0]).all()
    # without early stopping every place holds the least value over all ranks
    few = minhash.super_minhash(pool[:3], np.zeros(3, np.int64), 1)
    assert (few < np.iinfo(np.uint64).max).all()


def test_vectors_recall_and_precision(spark, sf):
    rows = common.table(spark, sf, "embeddings")
    got = {r.vec_id: r.n_links for r in vectors.near_vectors(rows).collect()}
    data = rows.toPandas().sort_values("vec_id")
    v = np.stack(data["embedding"].to_numpy()).astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    close = (v @ v.T >= 0.95) & ~np.eye(len(v), dtype=bool)
    want = dict(zip(data["vec_id"], close.sum(axis=1)))
    assert all(got[k] <= n for k, n in want.items())
    assert sum(got.values()) >= 0.9 * sum(want.values())


def test_vectors_in_a_crowded_bucket(spark):
    rng = np.random.default_rng(3)
    centre = rng.standard_normal(32)
    data = [(i, (centre + 0.12 * rng.standard_normal(32)).tolist()) for i in range(700)]
    v = np.array([x for _, x in data])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    want = ((v @ v.T >= 0.95).sum(axis=1) - 1)
    got = {r.vec_id: r.n_links for r in vectors.near_vectors(spark.createDataFrame(data, "vec_id bigint, embedding array<double>"), block=64).collect()}
    assert sum(got.values()) >= 0.99 * want.sum() and all(got[i] <= n for i, n in enumerate(want))


def test_quality_model_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = common.table(spark, sf, "labels")
    got = quality_model.quality_scores(common.table(spark, sf, "documents"), labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (got["predicted"] == got["quality"]).mean() >= 0.9
    assert got.loc[got["quality"] == 1, "predicted"].mean() >= 0.95


def base_counts(text):
    words = WORDS.findall(text)
    windows = collections.Counter(tuple(words[i: i + 5]) for i in range(len(words) - 4))
    covered = {k for i in range(len(words) - 4) if windows[tuple(words[i: i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark):
    sf = "/root/testdata/sf0.01"
    labels = common.table(spark, sf, "labels")
    docs = common.table(spark, sf, "documents")
    rows = quality_rules.quality_rules(docs, labels).toPandas().set_index("doc_id")
    for r in docs.collect():
        x = rows.loc[r.doc_id]
        want = base_counts(r.text)
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == want
        assert x.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
    told = labels.toPandas().merge(rows.reset_index(), on="doc_id")
    told = told[told.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 3 == 1) & ~told.base_failed]
    assert told[told.quality == 1].kept.mean() >= 0.97 and told[told.quality == 0].kept.mean() <= 0.2


def test_repeats_overlap_and_touch(spark):
    texts = ["a b c d e a b c d e", "x x x x x x x", "a b c d e f a b c d e f g a b c d e", "a b c d", "p q r s t u v w x y p q r s t"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.n_repeat_words for r in quality_rules.text_counts(rows, "doc_id").collect()}
    assert got == {i: base_counts(t)[4] for i, t in enumerate(texts)}


def test_packing_against_the_tokenizer(documents, texts):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = packing.pack(documents).toPandas()
    want = {}
    for d, e in zip(texts, tok.encode_batch(list(texts.values()), add_special_tokens=False)):
        ids = np.array([*e.ids, 1], "<u4")
        want |= {(d, k // 4096): (k, len(ids[k: k + 4096]), zlib.crc32(ids[k: k + 4096].tobytes())) for k in range(0, len(ids), 4096)}
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows.itertuples()} == want
    for _, own in rows.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own["offset"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]] and own["length"].sum() <= 4096
    assert rows["sequence_id"].nunique() <= -(-rows["length"].sum() // 4096) + 1


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), min_size=1))
def test_plans_use_every_piece_once(histogram):
    used = collections.Counter()
    for copies, lengths in packing.plan_patterns(histogram, 50):
        assert sum(lengths) <= 50
        for n in lengths:
            used[n] += copies
    assert used == histogram


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("abXé 12'\n\t\r stmdrevl.!?\u00a0\u3000\u2028"), st.characters(exclude_categories=["Cs"])), max_size=60), min_size=1, max_size=4))
def test_splits_like_the_pattern(texts):
    import regex

    for text, (starts, ends) in zip(texts, byte_bpe.split_texts(texts)):
        assert [text[a:b] for a, b in zip(starts, ends)] == regex.findall(public_tokenizers.PATTERN, text)


def reference_encoding():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_against_the_library(documents, texts):
    enc = reference_encoding()
    for r in byte_bpe.decode(byte_bpe.encode(documents)).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == enc.encode_ordinary(texts[r.doc_id])
        assert bytes(r.decoded) == texts[r.doc_id].encode()


def test_long_slices_merge_alike():
    enc, table = reference_encoding(), byte_bpe.merges(byte_bpe.default_ranks())
    rng = random.Random(2)
    for text in ("a" * 3000, "ab" * 700, "".join(rng.choice("etaoin") for _ in range(2000)), "é" * 400):
        assert np.frombuffer(table[text], "<u4").tolist() == enc.encode_ordinary(text)
        assert table.merge_long(text.encode()[:200]) == table.merge(text.encode()[:200])


def brute_spans(text):
    out = []
    for number, (kind, pattern, group, least) in enumerate(secret_scan.RULES):
        out += [(m.start(), number, m.end(), kind) for m in re.finditer(pattern, text) if len(m.group(group)) >= least]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


def test_secrets_against_the_expressions(spark, sf):
    texts = [r.text for r in common.table(spark, "/root/testdata/sf0.01", "documents").collect()]
    texts += ["token=secret:abcdefghijk api_key: 'ABCDEFGH' PASSWORD = short AKIA AKIAABCDEFGHIJKL12 é token:token:token=xxxxxxxxx", "deadbeef" * 5 + "\U0001f600" + "0" * 31,
              "-----BEGIN RSA PRIVATE KEY----- ghp_" + "a1" * 20 + " xoxb-1234567890-abc sk_live_" + "z9" * 10, "passwdsecret=aaaaaaaa=bbbb  apikey:\"cccccccc\""]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.spans for r in secret_scan.secret_spans(rows).select("row.doc_id", secret_scan.told(secret_scan.F.col("spans")).alias("spans")).collect()}
    assert got == {i: brute_spans(t) for i, t in enumerate(texts)}


def test_trigram_queries():
    assert secret_scan.trigram_query(r"AKIA[A-Z0-9]+") == [frozenset({"aki", "kia"})]
    assert secret_scan.trigram_query(r"[0-9a-f]{32,}") == []
    assert frozenset({"api", "pik", "ike", "key"}) in secret_scan.trigram_query(secret_scan.RULES[0][1])
    assert secret_scan.trigram_query(r"(abc|x)y*") == [] and len(secret_scan.trigram_query(r"(abc|def)y*")) == 2


def test_pipeline_against_its_stages_by_hand(spark, sf, documents, texts):
    labels = common.table(spark, sf, "labels")
    ruled = {r.doc_id for r in quality_rules.quality_rules(documents, labels).where("kept").collect()}
    docs = documents.where(documents.doc_id.isin(sorted(ruled)))
    good = {r.doc_id for r in quality_model.quality_scores(docs, labels).where("predicted = 1").collect()}
    groups = brute_groups({d: shingles(texts[d], 5) for d in good})
    left = sorted(d for d, g in groups.items() if d == g)
    want = {}
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for d in left:
        text, pos, out = texts[d], 0, ""
        for span in filter(None, brute_spans(text).split(",")):
            start, end = map(int, span.split(":")[1:])
            if start >= pos:
                out += text[pos:start] + secret_scan.MARK
            pos = max(pos, end)
        want[d] = len(tok.encode(out + text[pos:], add_special_tokens=False).ids) + 1
    rows = corpus_pipeline.run(spark, sf).toPandas()
    assert rows.groupby("doc_id")["length"].sum().to_dict() == want and len(left) > 50
    assert rows["sequence_id"].nunique() <= -(-rows["length"].sum() // 4096) + 1
