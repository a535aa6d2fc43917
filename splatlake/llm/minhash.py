"""Near-duplicate documents by SuperMinHash signatures, banding, checks on full sets and components.

SuperMinHash (Ertl 2017) gives every set element one random permutation of the signature's places
and the values rank + uniform along it, so the ranks of an element are correlated and estimates vary
less than with independent hashes.  A set is done as soon as every place holds a value below the
next rank; sets much larger than the signature are done after one rank, so a long text costs about
one number per word.  All documents of a batch advance one rank at a time in numpy.

Bands give buckets.  First every member of a bucket meets its smallest member; a bucket of copies
that agree is done with that.  Buckets that still hold several groups are cut into blocks of bounded
size: a task that holds two blocks counts the shared shingles of all their pairs with one matrix
product and passes on one line per document, the smallest id that its links reach.  Pairs are
never emitted, every link is confirmed on the full shingle sets, and groups come from union-find.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from splatlake.llm import query
from splatlake.llm.common import bound_batches, byte_classes, cut, hashed_runs, mix, slices, table
from splatlake.operators.components import connected_components

PLACES, BANDS, BAND_ROWS = 125, 25, 5
SLICE_CHARS = 300_000
BLOCK = 500


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Hashes of all words, their text numbers, and the texts as bytes with A-Z lowered."""
    low = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    hashes, owner = hashed_runs(low, byte_classes(False)) if low else (np.empty(0, np.uint64), np.empty(0, np.int64))
    return hashes, owner, low


def shingle_sets(hashes: np.ndarray, owner: np.ndarray, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes and their text numbers; a text of few words is one shingle."""
    if not len(hashes):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    counts = np.bincount(owner, minlength=n)
    starts = np.cumsum(counts) - counts
    size = np.minimum(counts, width)
    at = np.arange(len(hashes)) - starts[owner]
    first = at <= (counts - size)[owner]
    pos = np.flatnonzero(first)
    own = owner[pos]
    acc = np.full(len(pos), 0x243F6A8885A308D3, np.uint64)
    for k in range(width):
        here = size[own] > k
        acc[here] = mix(acc[here] * np.uint64(0x9E3779B97F4A7C15) + hashes[pos[here] + k])
    acc ^= mix(size[own].astype(np.uint64))
    order = np.lexsort((acc, own))
    acc, own = acc[order], own[order]
    keep = np.concatenate(([True], (acc[1:] != acc[:-1]) | (own[1:] != own[:-1])))
    return acc[keep], own[keep]


def super_minhash(elements: np.ndarray, owner: np.ndarray, n: int, places: int = PLACES) -> np.ndarray:
    """(n, places) values rank * 2^32 + fraction; sets without elements keep the largest number."""
    sig = np.full(n * places, np.iinfo(np.uint64).max, np.uint64)
    live, own, perm = elements, owner, None
    for rank in range(places):
        if not len(live):
            break
        noise = mix(live + np.uint64(((rank + 1) * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF))
        pick = rank + ((noise >> np.uint64(32)) * np.uint64(places - rank) >> np.uint64(32)).astype(np.int64)
        if perm is None:
            place = pick
        else:
            row = np.arange(len(live))
            place = perm[row, pick].astype(np.int64)
            perm[row, pick] = perm[row, rank]
        value = (np.uint64(rank) << np.uint64(32)) | (mix(noise) & np.uint64(0xFFFFFFFF))
        np.minimum.at(sig, own * places + place, value)
        open_ = sig.reshape(n, places).max(axis=1) >= np.uint64((rank + 1) << 32)
        stay = open_[own]
        live, own = live[stay], own[stay]
        if perm is None:  # place `rank` of the identity has been swapped away
            perm = np.tile(np.arange(places, dtype=np.uint8), (len(live), 1))
            perm[np.arange(len(live)), pick[stay]] = 0
        else:
            perm = perm[stay]
    return sig.reshape(n, places)


def signature_pass(width: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(frames, "text", SLICE_CHARS):
            n = len(pdf)
            hashes, owner, _ = word_hashes(pdf["text"].tolist())
            words = np.bincount(owner, minlength=n)
            order = np.zeros((n, 2), np.uint64)  # two sums over (word, position) name the word sequence
            if len(hashes):
                at = (np.arange(len(hashes)) - (np.cumsum(words) - words)[owner]).astype(np.uint64)
                for k, salt in enumerate((0xA0761D6478BD642F, 0xE7037ED1A0B428DB)):
                    np.add.at(order[:, k], owner, mix(hashes ^ mix(at + np.uint64(salt))))
            elements, own = shingle_sets(hashes, owner, n, width)
            count = np.bincount(own, minlength=n)
            sig = super_minhash(elements, own, n)
            bands = np.zeros((n, BANDS), np.uint64)
            for r in range(BAND_ROWS):
                bands = mix(bands * np.uint64(0x9E3779B97F4A7C15) + sig[:, r::BAND_ROWS])
            none = count == 0
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"], "told": pdf["told"], "n": count.astype(np.int64),
                "key": [None if z else a.tobytes() for z, a in zip(none, np.column_stack([order, words.astype(np.uint64)]))],
                "bands": [None if z else b for z, b in zip(none, bands.view(np.int64))]})

    return run


def set_pass(width: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(frames, "text", SLICE_CHARS):
            hashes, owner, _ = word_hashes(pdf["text"].tolist())
            elements, own = shingle_sets(hashes, owner, len(pdf), width)
            ends = np.searchsorted(own, np.arange(len(pdf)), side="right")
            begins = np.append(0, ends[:-1]) if len(ends) else ends
            yield pd.DataFrame({"id": pdf["id"], "items": [elements[a:b].tobytes() for a, b in zip(begins, ends)]})

    return run


def confirm(frames: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        good = np.zeros(len(pdf), bool)
        for k, (x, y) in enumerate(zip(pdf["x"], pdf["y"])):
            both = np.concatenate((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)))
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            good[k] = 100 * shared >= percent * (len(both) - shared)
        yield pdf.loc[good, ["src", "dst"]]


def confirm_blocks(frames: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    """(src, dst): per document the smallest id its confirmed links inside its blocks reach."""
    held, at = [], None
    for pdf in frames:
        keys = list(zip(pdf["band"], pdf["code"], pdf["a"], pdf["b"]))
        starts = [k for k in range(len(keys)) if k == 0 or keys[k] != keys[k - 1]]
        for begin, end in zip(starts, [*starts[1:], len(keys)]):
            if keys[begin] != at and held:  # the last block pair may go on in the next batch
                yield linked_in_block(pd.concat(held), percent)
                held = []
            at = keys[begin]
            held.append(pdf.iloc[begin:end])
    if held:
        yield linked_in_block(pd.concat(held), percent)


def linked_in_block(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    ids, group, side = rows["id"].to_numpy(), rows["component"].to_numpy(), rows["side"].to_numpy()
    bands, band = np.stack(rows["bands"].to_numpy()), int(rows["band"].iloc[0])
    sets = [np.frombuffer(x, np.uint64) for x in rows["items"]]
    size = np.array([len(x) for x in sets])
    ask = np.triu(group[:, None] != group[None, :], 1)
    if rows["a"].iloc[0] != rows["b"].iloc[0]:
        ask &= side[:, None] != side[None, :]
    ask &= 100 * np.minimum(size[:, None], size[None, :]) >= percent * np.maximum(size[:, None], size[None, :])
    i, j = np.nonzero(ask)
    for k in range(band):  # else an earlier band has checked the pair
        fresh = bands[i, k] != bands[j, k]
        i, j = i[fresh], j[fresh]
    if not len(i):
        return pd.DataFrame({"src": ids[:0], "dst": ids[:0]})
    used = np.unique(np.concatenate((i, j)))
    item, column, count = np.unique(np.concatenate([sets[k] for k in used]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(used)), size[used])
    common = count[column] > 1
    compact = np.cumsum(count > 1) - 1
    shared = np.zeros((len(used), len(used)), np.float32)
    width = int((count > 1).sum())
    for first in range(0, width, 4096):  # a bounded slab of shingles at a time; float32 counts these exactly
        here = common & (compact[column] >= first) & (compact[column] < first + 4096)
        slab = np.zeros((len(used), min(4096, width - first)), np.float32)
        slab[row[here], compact[column[here]] - first] = 1
        shared += slab @ slab.T
    both = shared[np.searchsorted(used, i), np.searchsorted(used, j)].astype(np.int64)
    close = 100 * both >= percent * (size[i] + size[j] - both)
    low = ids.copy()
    while True:
        before = low.copy()
        np.minimum.at(low, i[close], before[j[close]])
        np.minimum.at(low, j[close], before[i[close]])
        if (low == before).all():
            break
    return pd.DataFrame({"src": ids, "dst": low})[low != ids]


def told(text: Column) -> Column:
    """A digest of the text, which tells rows of one id, or of none, apart."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def near_documents(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of (doc_id, text).

    Words are runs of bytes outside 0x20 and 0x09-0x0D after lowering A-Z; a set holds the distinct
    shingles of ``width`` words, or the whole sequence where there are fewer.  Texts that are null,
    empty or blank have an empty set and link with nothing.  Rows of equal word sequences are one
    vertex, whatever their ids.  A group is named by its smallest id, or by null where it has none,
    and keeps one text: that of the smallest id, and of the smallest digest among rows of that id.
    Repeated rows all appear.  An empty table gives an empty result; other columns are ignored.
    """
    return grouped(docs, width, percent).drop("told")


def grouped(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``near_documents`` with the digest ``told`` of every row's text."""
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), told(F.col("text")).alias("told"), "text")
    rows = cut(texts.mapInPandas(signature_pass(width), "doc_id bigint, told binary, n bigint, key binary, bands array<bigint>"))
    row = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "told")
    classes = rows.where("key IS NOT NULL").groupBy("key").agg(F.min(row).alias("row"))
    # one row per class: that of the smallest id
    same = (F.col("_key") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("row.doc_id")) & (F.col("told") == F.col("row.told"))
    vertices = rows.select("doc_id", "told", F.col("key").alias("_key"), "n", "bands").join(classes, same).dropDuplicates(["_key", "doc_id", "told"])
    vertices = cut(vertices.select(F.monotonically_increasing_id().alias("id"), "key", "row", "n", "bands"))
    members = vertices.select("id", "n", F.posexplode("bands").alias("band", "code"))
    bucket = ["band", "code"]
    crowded = members.groupBy(*bucket).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    members = cut(members.join(crowded, bucket))
    meeting = members.select("id").distinct().join(vertices.select("id", "row"), "id")
    texts = texts.join(meeting, F.col("doc_id").eqNullSafe(F.col("row.doc_id")) & (F.col("told") == F.col("row.told"))).dropDuplicates(["id"])
    sets = cut(texts.select("id", "text").mapInPandas(set_pass(width), "id bigint, items binary"))
    lead = members.groupBy(*bucket).agg(F.min(F.struct("id", "n")).alias("_p")).select(*bucket, F.col("_p.id").alias("dst"), F.col("_p.n").alias("_n"))
    fits = F.least("n", "_n") * 100 >= F.greatest("n", "_n") * percent  # the shorter set bounds the overlap
    pairs = cut(members.join(lead, bucket).where((F.col("id") != F.col("dst")) & fits).select(F.col("id").alias("src"), "dst").distinct())
    left, right = sets.select(F.col("id").alias("src"), F.col("items").alias("x")), sets.select(F.col("id").alias("dst"), F.col("items").alias("y"))
    links = cut(pairs.join(left, "src").join(right, "dst").mapInPandas(lambda f: confirm(f, percent), "src bigint, dst bigint"))
    group = cut(connected_components(vertices.select("id"), links, []))
    # buckets that still hold several groups, in blocks
    mixed = cut(members.join(group, "id"))
    several = mixed.groupBy(*bucket).agg(F.count("*").alias("_m"), F.min("component").alias("_a"), F.max("component").alias("_b")).where("_a < _b")
    mixed = mixed.join(several.select(*bucket, F.ceil(F.col("_m") / BLOCK).cast("int").alias("blocks")), bucket)
    mixed = mixed.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    place = [*bucket, "a", "b"]
    mixed = mixed.select("id", "component", *bucket, F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), (F.col("own") > F.col("other")).alias("side"))
    sent = mixed.join(sets, "id").join(vertices.select("id", "bands"), "id").repartition(*place).sortWithinPartitions(*place)
    more = cut(sent.mapInPandas(lambda f: confirm_blocks(f, percent), "src bigint, dst bigint"))
    group = cut(connected_components(vertices.select("id"), links.unionByName(more), []))
    named = cut(vertices.select("id", "key", "row").join(group, "id").select("key", "row", "component"))
    best = named.groupBy("component").agg(F.min("row").alias("best"))
    named = cut(named.select("key", "component").join(best, "component").select("key", "best"))
    out = rows.select("doc_id", "told", F.col("n").alias("n_shingles"), "key").join(named, "key", "left")
    alone, chosen = F.col("key").isNull(), F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("told") == F.col("best.told"))
    return out.select("doc_id", "told", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("component_id"), (alone | chosen).alias("kept"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, each once; columns as given."""
    kept = grouped(docs, width, percent).where("kept").select(F.col("doc_id").alias("_kept"), F.col("told").alias("_of")).distinct()
    rows = docs.withColumn("_told", told(F.col("text")))
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col("_kept")) & F.col("_told").eqNullSafe(F.col("_of"))
    return rows.join(kept, same).dropDuplicates(["doc_id", "_told"]).drop("_kept", "_of", "_told")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 2 THEN [ws[1]]
             ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh FROM w),
x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS s, b.doc_id AS d FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach(s, d) AS (SELECT s, d FROM p UNION SELECT r.s, p.d FROM reach r JOIN p ON r.d = p.s),
c AS (SELECT s AS doc_id, min(d) AS m FROM reach GROUP BY s)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(c.m, s.doc_id)) AS component_id,
       s.doc_id = least(s.doc_id, coalesce(c.m, s.doc_id)) AS kept
FROM s LEFT JOIN c ON s.doc_id = c.doc_id"""


@query("op4_near_documents", ORACLE)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_documents(table(spark, sf_dir, "documents"), width=2, percent=80)
