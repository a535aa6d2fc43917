"""How far the sources of a language differ in the words they use: a recount over minimal perfect hashes.

The first pass counts the documents of every (language, term) exactly and keeps frequent terms.  The
kept terms are dealt into shards of bounded size; a task per shard builds a minimal perfect hash
(levels of bit arrays as in Limasset et al. 2017, slots by rank) and stores the terms in slot order.
The second pass broadcasts the shards, looks every term up, compares it with the stored one, and adds
its count to a dense slot array of its (language, source).  Shards are broadcast up to PASS_BYTES at a
time; a larger vocabulary takes another pass over the documents for each further block of shards.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from splatlake.llm import query
from splatlake.llm.common import bound_batches, byte_classes, cut, hashed_runs, mix, table

MIN_DOCS, TOP = 30, 50  # documents a kept term is in, at least; ranks of the report on terms
SCALE, PRIOR = 1_000_000_000, 5
SHARD_BYTES, PASS_BYTES = 1 << 19, 1 << 25  # stored terms of a shard; shards broadcast at a time
COUNTER_TERMS, DENSE_BYTES, PIECE = 600_000, 1 << 26, 1 << 20  # a task's counters, slot arrays and text pieces
PAIR_CELLS = 1 << 18  # (source, term) cells of one task of the pair sums
SALTS = 64  # parts of a language or group in joins, since one may hold most slots
LEVELS, ROOM = 32, 2  # levels of a perfect hash, bits a key
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms(text: str) -> Iterator[list[bytes]]:
    """Lists of the terms of a text, piece by piece: runs of ASCII letters and of all beyond ASCII."""
    body = text.encode("utf-8", "surrogatepass").translate(FOLD)
    at = 0
    while at < len(body):
        end = body.find(b" ", at + PIECE)
        end = len(body) if end < 0 else end
        yield body[at:end].split()
        at = end


def key_hashes(words: list[bytes], lang: str) -> np.ndarray:
    hashes, _ = hashed_runs([b" ".join(words)], byte_classes(False))
    seed = int.from_bytes(lang.encode("utf-8", "surrogatepass")[:64], "little") * 0x9E3779B97F4A7C15 + len(lang)
    return mix(hashes ^ np.uint64(seed & (2 ** 64 - 1)))


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


class PerfectHash:
    """Slots 0 to n - 1 for n distinct hashes; equal hashes, which cannot be told apart, go to ``rest``."""

    def __init__(self, hashes: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # bits of a level, and the slot before each bit
        left, taken = np.arange(len(hashes)), 0
        self.slots = np.full(len(hashes), -1, np.int64)
        while len(left) and len(self.levels) < LEVELS:
            place = self.place(hashes[left], len(self.levels), ROOM * len(left))
            bits = np.bincount(place, minlength=ROOM * len(left)) == 1
            before = np.cumsum(bits) - bits + taken
            self.levels.append((bits, before.astype(np.int64)))
            done = bits[place]
            self.slots[left[done]] = before[place[done]]
            taken += int(bits.sum())
            left = left[~done]
        self.slots[left] = taken + np.arange(len(left))
        self.rest: dict[int, list[int]] = {}
        for k in left:
            self.rest.setdefault(int(hashes[k]), []).append(int(self.slots[k]))

    @staticmethod
    def place(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
        step = np.uint64((level + 1) * 0xA0761D6478BD642F % 2 ** 64)
        return (mix(hashes + step) % np.uint64(size)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of every hash that is in the set, for others any slot or -1."""
        out, left = np.full(len(hashes), -1, np.int64), np.arange(len(hashes))
        for level, (bits, before) in enumerate(self.levels):
            place = self.place(hashes[left], level, len(bits))
            hit = bits[place]
            out[left[hit]] = before[place[hit]]
            left = left[~hit]
        return out


def document_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, term, n): documents of the task that hold the term; a term comes again when counters are emptied."""
    held: dict[str, Counter] = {}

    def emptied() -> Iterator[pd.DataFrame]:
        for lang, seen in held.items():
            yield pd.DataFrame({"lang": lang, "term": list(seen), "n": list(seen.values())})
        held.clear()

    for pdf in frames:
        for lang, text in zip(pdf["lang"], pdf["text"]):
            seen: set[bytes] = set()
            for words in terms(text):
                seen.update(words)
            held.setdefault(lang, Counter()).update(seen)
            if sum(map(len, held.values())) > COUNTER_TERMS:
                yield from emptied()
    yield from emptied()


def build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row: the perfect hash of a shard's keys, and the keys in slot order."""
    hashes = pdf["hash"].to_numpy().view(np.uint64)
    perfect = PerfectHash(hashes)
    order = np.argsort(perfect.slots)
    keys = [{"lang": a, "term": b} for a, b in zip(pdf["lang"].to_numpy()[order], pdf["term"].to_numpy()[order])]
    blob = pickle.dumps((perfect.levels, perfect.rest))
    return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "hashes": [blob], "keys": [keys]})


def perfect_shards(kept: DataFrame) -> tuple[DataFrame, int]:
    """(shard, hashes, keys, size) of all kept (lang, term), and the number of shards."""
    size = kept.agg(F.sum(F.length("term") + 24)).first()[0] or 0
    shards = -(-size // SHARD_BYTES) or 1

    def dealt(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for lang, part in pdf.groupby("lang", sort=False):
                hashes = key_hashes(part["term"].tolist(), lang)
                yield part.astype({"lang": object}).assign(hash=hashes.view(np.int64), shard=shard_of(hashes, shards))

    rows = kept.mapInPandas(dealt, "lang string, term binary, hash bigint, shard bigint")
    built = rows.groupBy("shard").applyInPandas(build_shard, "shard bigint, hashes binary, keys array<struct<lang: string, term: binary>>")
    return cut(built.withColumn("size", F.length("hashes") + F.size("keys") * 64 + F.aggregate(
        "keys", F.lit(0), lambda n, k: n + F.length(k["term"]).cast("int")))), shards


def recount(docs: DataFrame, tables: DataFrame, shards: int) -> DataFrame:
    """(lang, source, slot, n): occurrences of kept terms; a slot is its shard times 2^32 plus the place in it."""
    spark = docs.sparkSession
    block, held, found = [], 0, None
    sizes = sorted((r["shard"], r["size"]) for r in tables.select("shard", "size").collect())  # two numbers for each SHARD_BYTES of terms
    for k, (shard, size) in enumerate(sizes):
        block.append(shard)
        held += size
        if held > PASS_BYTES or k + 1 == len(sizes):
            part = cut(recount_block(docs, spark, tables.where(F.col("shard").isin(block)), shards))
            found = part if found is None else found.unionByName(part)
            block, held = [], 0
    if found is None:
        return spark.createDataFrame([], "lang string, source string, slot bigint, n bigint")
    return found


def recount_block(docs: DataFrame, spark: SparkSession, tables: DataFrame, shards: int) -> DataFrame:
    rows = tables.collect()  # PASS_BYTES and one shard more at most
    shared = {}
    for r in rows:
        keys = np.empty(len(r["keys"]), object)
        keys[:] = [bytes(k["term"]) for k in r["keys"]]
        shared[r["shard"]] = spark.sparkContext.broadcast((bytes(r["hashes"]), keys, [k["lang"] for k in r["keys"]]))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables_here = {s: opened(*b.value) for s, b in shared.items()}
        seen: dict[tuple[str, str], Counter] = {}
        dense: dict[tuple[str, str, int], np.ndarray] = {}

        def counted() -> None:
            for (lang, source), words in seen.items():
                names = np.empty(len(words), object)
                names[:] = list(words)
                times = np.fromiter(words.values(), np.int64, len(words))
                hashes = key_hashes(names.tolist(), lang)
                shard = shard_of(hashes, shards)
                for s, (perfect, keys, langs) in tables_here.items():
                    mine = np.flatnonzero(shard == s)
                    slot = perfect.find(hashes[mine])
                    mine, slot = mine[slot >= 0], slot[slot >= 0]
                    same = (keys[slot] == names[mine]).astype(bool) & (langs[slot] == lang).astype(bool)
                    mine, slot = mine[same], slot[same]
                    by_hash = [(k, t) for k in np.flatnonzero(shard == s) for t in perfect.rest.get(int(hashes[k]), ())] if perfect.rest else []
                    if len(mine) or by_hash:
                        slots = dense.setdefault((lang, source, s), np.zeros(len(keys), np.int64))
                        slots[slot] += times[mine]  # distinct terms have distinct slots
                        for k, t in by_hash:
                            slots[t] += times[k] * (keys[t] == names[k] and langs[t] == lang)
            seen.clear()

        def emptied() -> Iterator[pd.DataFrame]:
            for (lang, source, s), slots in dense.items():
                used = np.flatnonzero(slots)
                yield pd.DataFrame({"lang": lang, "source": source, "slot": (s << 32) + used, "n": slots[used]})
            dense.clear()

        for pdf in frames:
            for lang, source, text in zip(pdf["lang"], pdf["source"], pdf["text"]):
                words = seen.setdefault((lang, source), Counter())
                for piece in terms(text):
                    words.update(piece)
                if sum(map(len, seen.values())) > COUNTER_TERMS:
                    counted()
                    if sum(a.nbytes for a in dense.values()) > DENSE_BYTES:
                        yield from emptied()
        counted()
        yield from emptied()

    part = docs.mapInPandas(run, "lang string, source string, slot bigint, n bigint")
    return part.groupBy("lang", "source", "slot").agg(F.sum("n").alias("n"))


def opened(blob: bytes, keys: np.ndarray, langs: list[str]) -> tuple[PerfectHash, np.ndarray, np.ndarray]:
    perfect = PerfectHash(np.empty(0, np.uint64))
    perfect.levels, perfect.rest = pickle.loads(blob)
    names = np.empty(len(langs), object)
    names[:] = langs
    return perfect, keys, names


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * kept)) in 64-bit numbers, see ``shares``."""
    base, rest, out = total + kept * PRIOR, count + PRIOR, F.lit(0).cast("bigint")
    for _ in range(3):
        out = out * 1000 + F.call_function("div", rest * 1000, base)
        rest = (rest * 1000) % base
    return out + 1


def shares(count: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """``share`` in 64-bit numbers: three digits of the quotient at a time."""
    base, rest = total + PRIOR * kept, count + PRIOR
    out = np.zeros(np.broadcast(base, rest).shape, np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // base
        rest = rest % base
    return out + 1


def pair_sums(pdf: pd.DataFrame) -> pd.DataFrame:
    """(lang, a, b, value): the part that one block of terms has in the distance of every two sources."""
    whole = pdf["slot"] < 0
    names, totals = pdf["source"][whole].to_numpy(), pdf["total"][whole].to_numpy()
    order = np.argsort(names)
    names, totals = names[order], totals[order]
    slots, col = np.unique(pdf["slot"][~whole].to_numpy(), return_inverse=True)
    count = np.zeros((len(names), len(slots)), np.int64)
    count[np.searchsorted(names, pdf["source"][~whole].to_numpy()), col] = pdf["n"][~whole].to_numpy()
    p = shares(count, totals[:, None], int(pdf["kept"].iloc[0])) if len(slots) else count
    made = [(a, b, v) for k, a in enumerate(names) for b, v in zip(names[k + 1:], np.abs(p[k + 1:] - p[k]).sum(axis=1).tolist())]
    out = pd.DataFrame(made, columns=["a", "b", "value"], dtype=object)
    return out.assign(lang=np.full(len(out), pdf["lang"].iloc[0], object))[["lang", "a", "b", "value"]]


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): the other sources by distance, and the terms a source has more of.

    Null texts, languages and sources are empty ones.  A group without terms and a language without
    kept terms still pair: the former at its prior, the latter at 0.  Repeated rows count each; equal
    values rank by the UTF-8 bytes of the item; an empty table gives no row; other columns are ignored.
    Counts are exact up to a total of 9 x 10^15 occurrences a group.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept = cut(rows.select("lang", "text").mapInPandas(document_counts, "lang string, term binary, n bigint").groupBy("lang", "term").agg(
        F.sum("n").alias("n")).where(F.col("n") >= min_docs).select("lang", "term"))
    tables, shards = perfect_shards(kept)
    counts = recount(rows, tables, shards)
    slots = tables.select("shard", F.posexplode("keys").alias("at", "key")).select(
        (F.shiftleft("shard", 32) + F.col("at")).alias("slot"), F.col("key.term").alias("term"))
    langs = rows.groupBy("lang").agg(F.lit(1)).select("lang").join(kept.groupBy("lang").agg(F.count("*").alias("kept")), "lang", "left").select(
        "lang", F.coalesce("kept", F.lit(0)).cast("bigint").alias("kept"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = cut(rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang").select(
        "lang", "source", "kept", F.coalesce("total", F.lit(0)).cast("bigint").alias("total")))
    whole = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.count("*").alias("sources"))
    return pair_part(counts, groups, whole).unionByName(term_part(counts, groups, whole, slots, top))


def spread_join(counts: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join with a row per language or group, which is repeated for the parts that slots are dealt into."""
    left = counts.withColumn("_salt", F.pmod(F.xxhash64("slot"), F.lit(SALTS)).cast("int"))
    right = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, [*keys, "_salt"]).drop("_salt")


def pair_part(counts: DataFrame, groups: DataFrame, whole: DataFrame) -> DataFrame:
    known = groups.join(whole, "lang").withColumn("blocks", F.ceil(F.col("kept") * F.col("sources") / PAIR_CELLS).cast("int"))
    blocks = known.groupBy("lang").agg(F.max("blocks").alias("blocks"))
    cells = spread_join(counts, blocks, ["lang"]).select("lang", F.pmod(F.xxhash64("slot"), "blocks").cast("int").alias("block"), "source", "slot", "n",
                                              F.lit(0).cast("bigint").alias("total"), F.lit(0).cast("bigint").alias("kept"))
    marks = known.select("lang", F.explode(F.sequence(F.lit(0), F.greatest("blocks", F.lit(1)) - 1)).alias("block"), "source",
                         F.lit(-1).cast("bigint").alias("slot"), F.lit(0).cast("bigint").alias("n"), "total", "kept")
    # the number of kept terms stands in the marked rows; spread to the block's first row by its maximum
    summed = marks.unionByName(cells).groupBy("lang", "block").applyInPandas(
        lambda pdf: pair_sums(pdf.assign(kept=pdf["kept"].max())), "lang string, a string, b string, value bigint")
    pairs = summed.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = pairs.select("lang", F.explode(F.expr("array(named_struct('source', a, 'item', b), named_struct('source', b, 'item', a))")).alias("_p"), "value")
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return both.select("lang", "_p.source", F.lit("pair").alias("part"), "_p.item", "value").withColumn("rank", F.row_number().over(order))


def term_part(counts: DataFrame, groups: DataFrame, whole: DataFrame, slots: DataFrame, top: int) -> DataFrame:
    in_lang = counts.groupBy("slot").agg(F.sum("n").alias("lang_n"))
    more = spread_join(counts, groups.join(whole, "lang"), ["lang", "source"]).join(in_lang, "slot").withColumn(
        "value", share(F.col("n"), F.col("total"), F.col("kept")) - share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))).where("value > 0")
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return more.join(slots, "slot").select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value").withColumn(
        "rank", F.row_number().over(order)).where(F.col("rank") <= top)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
w AS (SELECT id, lang, source, unnest(words) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept k ON k.lang = w.lang AND k.term = w.term GROUP BY ALL),
n AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
cl AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
nl AS (SELECT lang, sum(n) AS total FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
        1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(n.total, 0) + 5 * v.v) AS p
      FROM groups g JOIN kept k ON k.lang = g.lang JOIN v ON v.lang = g.lang
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN n ON n.lang = g.lang AND n.source = g.source),
q AS (SELECT cl.lang, cl.term, 1 + (1000000000::HUGEINT * (cl.n + 5)) // (nl.total + 5 * v.v) AS q
      FROM cl JOIN nl ON nl.lang = cl.lang JOIN v ON v.lang = cl.lang),
pair AS (SELECT g.lang, g.source, h.source AS item, coalesce(x.value, 0) AS value FROM groups g JOIN groups h ON h.lang = g.lang AND h.source <> g.source
      LEFT JOIN (SELECT a.lang, a.source AS s, b.source AS t, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
                 GROUP BY ALL) x ON x.lang = g.lang AND x.s = g.source AND x.t = h.source),
term AS (SELECT p.lang, p.source, p.term AS item, p.p - q.q AS value FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.n > 0 AND p.p > q.q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM
      (SELECT lang, source, 'pair' AS part, item, value FROM pair UNION ALL SELECT lang, source, 'term', item, value FROM term))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""


@query("op13_source_divergence", SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))
