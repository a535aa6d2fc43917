"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from splatlake.llm import byte_bpe, minhash, packing, quality_model, quality_rules, secret_scan, sharding, url_filter, vectors, warc
from splatlake.llm.common import scratch_path

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASH = ["n", "key", "size", "row", "spans", "node", "id", "code", "band", "y", "x", "shape", "host", "part", "component", "kept", "n_words", "words", "_t", "payload"]
LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "a", 60),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "a", 60),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "a", 60),
    (3, None, None, None, None), (4, "", "en", "b", 0), (5, " \n\t ", None, "b", 4), (6, LONG, "en", "a", len(LONG)),
    (None, "token = abcdefgh12345 and é\U0001f600 more", "fr", None, 20), (None, None, None, None, None),
    (7, "one", "de", "c", 3), (8, "it's 12 o'clock   now\n\n'll see", "en", "c", 30)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 0), (3, None, None), (3, 7, 0), (1, 1, 0)], "doc_id bigint, quality int, toxic int")


def test_sharding(docs, none, spark):
    rows = sharding.with_slots(sharding.kd_shards(docs, shards=4)).collect()
    assert len(rows) == len(ROWS)
    for shard in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert {r.size for r in rows if r.doc_id == 3} == {1} and {r.text_crc32 for r in rows if r.doc_id == 3} == {0}
    assert sharding.with_slots(sharding.kd_shards(none, shards=4)).count() == 0
    by_bytes = sharding.with_slots(sharding.kd_shards(docs, target_bytes=200_000))
    assert 1 < by_bytes.select("shard").distinct().count() <= 3
    path = scratch_path(spark, "shards")
    sharding.write_shards(docs, sharding.with_slots(sharding.kd_shards(docs, shards=4)), path)
    assert spark.read.parquet(path).count() == len(ROWS)


def test_sharding_splits_repeated_rows(spark):
    rows = spark.range(4000).select(F.when(F.col("id") < 1500, -1).otherwise(F.col("id")).alias("doc_id"), F.lit("x" * 50).alias("text"),
                                    F.lit("en").alias("lang"), F.lit("s").alias("source"))
    for docs in (rows, rows.withColumns({"doc_id": F.when(F.col("doc_id") >= 0, F.col("doc_id")), "text": F.when(F.col("doc_id") >= 0, F.col("text"))})):
        sharded = sharding.with_slots(sharding.kd_shards(docs, shards=16))
        sizes = [r["n"] for r in sharded.groupBy("shard").agg(F.sum("size").alias("n")).collect()]
        assert len(sizes) == 16 and max(sizes) - min(sizes) <= 0.05 * max(sizes)
    path = scratch_path(spark, "shards")
    sharding.write_shards(rows.withColumn("clash", F.lit(1)), sharding.with_slots(sharding.kd_shards(rows, shards=4)), path)
    back = spark.read.parquet(path)
    assert back.count() == 4000 and back.select("shard", "slot").distinct().count() == 4000 and back.where("doc_id = -1").count() == 1500


def test_sharding_splits_one_hot_value(spark):
    same = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x" * 50).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    sizes = [r["count"] for r in sharding.kd_shards(same, shards=16).groupBy("shard").count().collect()]
    assert len(sizes) == 16 and max(sizes) - min(sizes) <= 6


def test_warc(spark):
    rows = [(1, "u", "<p>é</p>"), (2, None, "<p>é</p>"), (5, "u", "<p>é</p>"), (5, "u", "<p>é</p>"), (3, "v\r\nX: y", None), (4, "w", ""), (None, "z", "only"), (6, "l", "long " * 50_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({c: F.lit("clash") for c in CLASH})
    path = scratch_path(spark, "warc")
    warc.write_archive(pages, path)
    heads = warc.read_headers(spark, path).collect()
    kind = {(r.page_id, r.record_type, r.refers_to) for r in heads}
    assert kind == {(1, "revisit", 5), (2, "revisit", 5), (5, "response", None), (3, "revisit", 4), (4, "response", None), (None, "response", None), (6, "response", None)}
    assert len(heads) == len(rows) and warc.read_payloads(spark, path).count() == 4
    back = {(r.page_id, r.html) for r in warc.restore_pages(spark, path).collect()}
    assert back == {(i, h or "") for i, _, h in rows}
    import base64
    for r in warc.read_records(spark, path).where("page_id = 5").collect():
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        body = "<p>é</p>".encode()
        assert rest == body + b"\r\n\r\n" and f"Content-Length: {len(body)}".encode() in head
        assert base64.b32encode(hashlib.sha1(body).digest()) in head
    path = scratch_path(spark, "warc")
    warc.write_archive(pages.limit(0), path)
    assert warc.restore_pages(spark, path).count() == 0


def test_warc_small_payloads_are_not_revisited(spark):
    pages = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "longer"), (4, "d", "longer")], "page_id bigint, url string, html string")
    path = scratch_path(spark, "warc")
    warc.write_archive(pages, path, min_revisit_bytes=3)
    assert {(r.page_id, r.record_type) for r in warc.read_headers(spark, path).collect()} == {(1, "response"), (2, "response"), (3, "revisit"), (4, "response")}


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.1]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]),
            (9, [None, 1.0]), (10, [1.0, 0.0, 0.0]), (11, [0.0, 1.0]), (None, [0.0, 2.0]), (None, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumns({c: F.lit("clash") for c in CLASH})
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df).collect()}
    assert {g for g in got if g[0] in (1, 2, 3)} == {(1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False)}
    assert {g for g in got if g[0] in (4, 5, 6, 7, 8, 9, 10)} == {(i, 0, i, True) for i in range(4, 11)}
    assert {(11, 1, 11, True), (None, 1, 11, False), (None, 0, None, True)} <= got
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_near_documents(docs, none):
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_documents(docs, width=2).collect()}
    assert {(1, 11, 1, True), (2, 11, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (7, 1, 7, True)} <= got
    assert (6, 29_999, 6, True) in got and (None, 0, None, True) in got
    assert minhash.near_documents(docs).count() == len(ROWS)
    assert minhash.near_documents(none).count() == 0
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == [1, 3, 4, 5, 6, 7, 8]


def test_near_documents_without_unique_ids(spark):
    """Null ids and repeated ids lose no text, and near copies among them are linked."""
    word = lambda tag, n=60: [f"{tag}{i}" for i in range(n)]
    a, b, c, d, e = (word(t) for t in "abcde")
    near = lambda words: [*words[:-1], "other"]
    rows = [(None, a), (None, b), (None, near(b)), (1, c), (1, d), (5, near(d)), (2, e), (None, e), (3, near(e)), (4, word("f")), (4, word("f"))]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.text) for r in minhash.keep_one(df).collect()), key=str)
    texts = [t for _, t in got]
    assert {" ".join(w) for w in (a, c, d, e, word("f"))} <= set(texts) and len(texts) == len(set(texts)) == 6
    assert sum(t in (" ".join(b), " ".join(near(b))) for t in texts) == 1
    told = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_documents(df).collect()), key=str)
    assert told == sorted([(None, None, True), (None, None, True), (None, None, False), (1, 1, True), (1, 1, True), (5, 1, False),
                           (2, 2, True), (None, 2, False), (3, 2, False), (4, 4, True), (4, 4, True)], key=str)


def test_quality_model(docs, none, labels):
    got = quality_model.quality_scores(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert quality_model.quality_scores(docs, labels.limit(0)).select("score").distinct().collect()[0][0] == 0.5
    assert quality_model.quality_scores(none, labels).count() == 0
    assert quality_model.keep_good(docs, labels).columns == docs.columns


def test_quality_rules(docs, none, labels):
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs, labels).collect()}
    assert (got[3].n_words, got[3].base_failed, got[3].kept) == (0, True, False)
    assert (got[6].n_words, got[6].n_repeat_words) == (30_000, 0) and got[5].n_words == 0
    assert quality_rules.quality_rules(docs, labels).count() == len(ROWS)
    assert quality_rules.quality_rules(none, labels).count() == 0
    kept = quality_rules.keep_passing(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 2, 6}


def test_packing(docs, none):
    rows = packing.pack(docs, keep_ids=True).collect()
    assert {r.length for r in rows if r.doc_id in (3, 4, 5)} == {1}
    assert sum(r.doc_id == 2 for r in rows) == 2 and len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert all(len(r.ids) == 4 * r.length for r in rows)
    long = sorted((r.piece, r.start, r.length) for r in rows if r.doc_id == 6)
    assert all(p == k and s == 4096 * k for k, (p, s, _) in enumerate(long)) and all(n == 4096 for _, _, n in long[:-1])
    assert packing.pack(none).count() == 0


def test_byte_bpe(docs, none):
    rows = byte_bpe.decode(byte_bpe.encode(docs)).collect()
    want = sorted((d, (t or "").encode()) for d, t, *_ in ROWS if d is not None)
    assert sorted((r.doc_id, bytes(r.decoded)) for r in rows if r.doc_id is not None) == want and len(rows) == len(ROWS)
    assert byte_bpe.encode(none).count() == 0


def test_url_filter(spark):
    urls = [(1, "https://M.A.Example.NET/en/4"), (2, "http://x.net"), (3, "http://x.net/"), (4, None), (5, "no url"), (6, "a://b.org/fr/1?x=http://y.net/"),
            (6, "a://b.org/fr/1?x=http://y.net/"), (None, "a://example.com/de/#f"), (7, ""), (8, "x://notexample.com/de/1"), (9, "x://h.com" + "/s" * 500)]
    pages = spark.createDataFrame(urls, "page_id bigint, url string").withColumns({c: F.lit("clash") for c in CLASH})
    got = {(r.page_id, r.host, r.rule, r.verdict) for r in url_filter.judge_urls(pages, url_filter.RULES).collect()}
    assert {(1, "m.a.example.net", "example.net/en/", "allow"), (2, "x.net", None, "allow"), (3, "x.net", "net/", "block"), (4, "", None, "allow"), (5, "", None, "allow"),
            (6, "b.org", "org/fr/", "allow"), (None, "example.com", "example.com/de/", "block"), (8, "notexample.com", None, "allow")} <= got
    assert url_filter.judge_urls(pages, url_filter.RULES).count() == len(urls)
    assert url_filter.judge_urls(pages.limit(0), url_filter.RULES).count() == 0


def test_url_templates_reject_by_labels(spark):
    rows = [(i, f"http://h.com/shop/{'ab'[i % 2]}{i}/buy", "block" if i % 3 else None) for i in range(40)] + [(100 + i, f"http://h.com/news/{i}", "allow") for i in range(40)]
    rows += [(200, "http://h.com/shop/zz/buy", None), (201, "http://h.com/news/77777", None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, said string")
    got = {r.page_id: (r.verdict, r.template) for r in url_filter.judge_urls(pages, [], label="said").collect()}
    assert got[200] == ("block", "/shop/*/buy") and got[201][0] == "allow"


def test_url_templates_decide_pages_without_labels(spark):
    """Label-free templates follow their host and the same shape elsewhere."""
    urls = [f"http://h{i}.net/{s}/{j}" for i in range(6) for s in ("es", "en") for j in range(20)]
    urls += [f"http://a.example.com/{s}/{j}" for s in ("de", "es", "en") for j in range(20)] + [f"http://b.org/{s}/{j}" for s in ("fr", "es") for j in range(20)]
    rules = [("block", "net", "/es/"), ("allow", "net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
    got = url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string"), rules)
    free = {(r.host, r.path.split("/")[1], r.verdict) for r in got.where("rule IS NULL").collect()}
    assert free == {("a.example.com", "es", "block"), ("a.example.com", "en", "allow"), ("b.org", "es", "allow")}


@pytest.mark.parametrize("segments", [20, 33, 200])
def test_url_templates_keep_labelled_branches_of_large_hosts(spark, segments):
    first = [chr(97 + i // 26) + chr(97 + i % 26) + "q" for i in range(segments)]
    urls = [f"http://www.example.com/{s}/x" for s in first] + [f"http://www.example.com/de/{c}" for c in "xyz"]
    got = {r.path.split("/")[1]: (r.verdict, r.template) for r in url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string"), url_filter.RULES).collect()}
    assert got["de"][1].startswith("/de/") and {got[s] for s in first} == {("allow", "/*/x")}


def test_url_templates_run_to_the_end_of_paths(spark):
    """What differs after the eighth segment is told apart, and few labels do not decide for many rows."""
    deep = "http://h.com" + "/s" * 12
    rows = [(i, f"{deep}/{s}/{i}", v) for k, (s, v) in enumerate((("bad", "block"), ("good", "allow"))) for i in range(100 * k, 100 * k + 30)]
    rows += [(300, f"{deep}/bad/300", None), (301, f"{deep}/good/301", None)]
    rows += [(400 + i, f"http://m.com/p/{i}", "block" if i < 3 else None) for i in range(103)]
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id bigint, url string, said string"), [], label="said").collect()}
    assert (got[300], got[301], got[500]) == ("block", "allow", "allow")


def test_secrets(docs, none):
    rows = secret_scan.secret_spans(docs).select("row.doc_id", secret_scan.told(F.col("spans")).alias("spans")).collect()
    assert {r.spans for r in rows if r.doc_id is not None} == {""} and {"assign:0:21"} <= {r.spans for r in rows}
    clean = secret_scan.redact(docs)
    assert clean.columns == docs.columns and clean.count() == len(ROWS)
    assert clean.where("text LIKE '[SECRET] and%'").select("n_chars").first()[0] == len("[SECRET] and é\U0001f600 more")
    assert secret_scan.redact(none).count() == 0


def test_every_stage_takes_empty_tables(spark, none, tmp_path):
    none.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_verdicts_go_by_row(spark):
    good = [(k, f"the quiet river runs past stone number {k} and under the old bridge", "en", "a", 60) for k in range(400)]
    bad = [(1000 + k, "$$$ click ### buy now %%% " * 3 + str(k), "en", "a", 60) for k in range(400)]
    docs = spark.createDataFrame(good + bad, SCHEMA)
    labels = spark.createDataFrame([(r[0], int(r[0] < 1000), 0) for r in good + bad], "doc_id bigint, quality int, toxic int")
    mixed = [(None, t, "en", "a", 60) for _, t, *_ in good[:3] + bad[:5]] + [(7, bad[9][1], "en", "a", 60)] * 2 + [(2**60 + 1, good[9][1], "en", "a", 60)]
    every = docs.union(spark.createDataFrame(mixed, SCHEMA))
    verdict = {r.digest: r.predicted for r in quality_model.scored_rows(every, labels).collect()}
    kept = sorted((str(r.doc_id), r.text) for r in quality_model.keep_good(every, labels).collect())
    judged = [(str(r[0]), r[1], verdict[hashlib.md5(r[1].encode()).hexdigest()]) for r in good + bad + mixed]
    assert kept == sorted((d, t) for d, t, y in judged if y == 1)
    assert {y for d, _, y in judged if d == "None"} == {0, 1}  # null ids with good and with bad texts
    assert len({y for d, _, y in judged if d == "7"}) == 2  # one id with a good and a bad text


def test_added_tokens_keep_their_ids(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = ["a <|endoftext|> b", "x<|startoftext|>y <|ENDOFTEXT|> <|other|>", "<|", "plain text, and more", "<|endoftext|>"]
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    words = packing.WordIds(packing.default_vocabulary())
    for text, ids in zip(texts, words.encode(texts)):
        assert [int.from_bytes(ids[k: k + 4], "little") for k in range(0, len(ids), 4)] == plain.encode(text, add_special_tokens=False).ids
