"""Shards from a K-d tree over document metadata, split at distributed weighted medians.

Every node that is to hold several shards is split along the metadata dimension in which its rows
spread widest (measured against the whole corpus).  The weighted median is found on an integer key,
dimension value first and a hash of the row behind it, so that a value shared by a third of all
rows, or a row repeated as often, can be split too.  Each pass counts bytes in 8,192 key ranges of all nodes at once and narrows
every node to the range that holds its median; the driver sees these sums only, at most
8,192 x number of shards, whatever the input.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from splatlake.llm import query
from splatlake.llm.common import cut, table
from splatlake.operators.skew import ordered_rank

VALUE_BITS, TIE_BITS, PASS_BITS = 22, 30, 13
CLOSE = 0.001  # a median range holding less than this share of its node needs no further pass


def document_dimensions() -> dict[str, Column]:
    """Numeric metadata of a document row; names are spread by their checksum."""
    name = lambda c: F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")).cast("double"), F.lit(-1.0))
    return {"source": name("source"), "lang": name("lang"), "length": F.log2(F.col("size").cast("double")),
            "id": F.coalesce(F.col("doc_id").cast("double"), F.lit(-1.0))}


def text_size(text: Column) -> Column:
    """UTF-8 bytes plus 1; a missing text has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard): shards of nearly equal bytes.

    Give the number of ``shards``, or ``target_bytes`` from which it follows.  Null ids, sources or
    languages are an extreme value of their dimension; a null text has size 1 and checksum 0;
    repeated rows are split like others; an empty table gives an empty result.  Other columns are
    ignored.
    """
    body = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    dims = document_dimensions()
    rows = docs.select("doc_id", "source", "lang", text_size(F.col("text")).alias("size"), F.crc32(body).alias("text_crc32"))
    rows = rows.select("doc_id", "size", "text_crc32", *[c.alias(f"d_{n}") for n, c in dims.items()],
                       F.pmod(F.xxhash64("text_crc32", "doc_id", F.monotonically_increasing_id()), F.lit(1 << TIE_BITS)).alias("tie"))
    rows = cut(rows)  # from here on every row has its own place among equal ones
    names = [f"d_{n}" for n in dims]
    whole = rows.agg(F.sum("size").alias("size"), *[f(n).alias(f"{k}{n}") for n in names for k, f in (("lo", F.min), ("hi", F.max))]).first()
    if whole["size"] is None:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"))
    leaves = shards or max(1, math.ceil(whole["size"] / target_bytes))
    span = {n: (whole[f"lo{n}"], (whole[f"hi{n}"] - whole[f"lo{n}"]) or 1.0) for n in names}
    rows = rows.select("doc_id", "size", "text_crc32", "tie", *[((F.col(n) - lo) / width).alias(n) for n, (lo, width) in span.items()])
    held = {0: leaves}  # a node is named by its first shard
    rows = rows.withColumn("node", F.lit(0))
    while any(k > 1 for k in held.values()):
        rows = cut(rows)
        stats = rows.groupBy("node").agg(F.sum("size").alias("size"), *[(F.max(n) - F.min(n)).alias(n) for n in names]).collect()
        widest = {r["node"]: max(range(len(names)), key=lambda k: (r[names[k]], -k)) for r in stats if held[r["node"]] > 1}
        totals = {r["node"]: r["size"] for r in stats if r["node"] in widest}
        keyed = rows.withColumn("key", split_key(F.get(F.array(*names), per_node(widest, leaves))))
        cuts = weighted_cuts(keyed.where("key IS NOT NULL"), leaves, totals, {n: (held[n] // 2) / held[n] for n in totals})
        half = {n: k // 2 for n, k in held.items()}
        right = F.coalesce(F.col("key") >= per_node(cuts, leaves), F.lit(False))
        rows = keyed.withColumn("node", F.when(right, F.col("node") + per_node(half, leaves).cast("int")).otherwise(F.col("node"))).drop("key")
        grown = {}
        for n, k in held.items():
            grown[n] = k // 2 or 1
            if k > 1:
                grown[n + k // 2] = k - k // 2
        held = grown
    return rows.select("doc_id", "size", "text_crc32", F.col("node").alias("shard"))


def per_node(values: dict[int, int], leaves: int) -> Column:
    """The value of the row's node as a bigint, null where there is none."""
    return F.get(F.array(*[F.lit(values.get(n)).cast("bigint") for n in range(leaves)]), F.col("node"))


def split_key(value: Column) -> Column:
    """The dimension's value, then the hash behind it, as one integer."""
    return F.shiftleft(F.floor(value * ((1 << VALUE_BITS) - 1)).cast("bigint"), TIE_BITS) + F.col("tie")


def weighted_cuts(keyed: DataFrame, leaves: int, totals: dict[int, int], share: dict[int, float]) -> dict[int, int]:
    """Per node the key at which ``share`` of its bytes lie below."""
    low, below, done = dict.fromkeys(totals, 0), dict.fromkeys(totals, 0), {}
    shift = VALUE_BITS + TIE_BITS
    while len(done) < len(totals):
        shift -= PASS_BITS
        open_ = {n: low[n] for n in totals if n not in done}
        part = F.shiftright(F.col("key") - per_node(open_, leaves), shift)
        counted: dict[int, list[tuple[int, int]]] = {n: [] for n in open_}
        inside = keyed.select("node", "size", part.alias("part")).where(F.col("part").between(0, (1 << PASS_BITS) - 1))
        for r in inside.groupBy("node", "part").agg(F.sum("size").alias("size")).collect():
            counted[r["node"]].append((r["part"], r["size"]))
        for n in open_:
            goal = share[n] * totals[n]
            for at, size in sorted(counted[n]):
                if below[n] + size >= goal:
                    if size <= CLOSE * totals[n] or shift == 0:
                        nearer = below[n] + size - goal < goal - below[n]
                        done[n] = low[n] + ((at + nearer) << shift)
                    low[n] += at << shift
                    break
                below[n] += size
            else:
                done[n] = low[n] + (1 << (shift + PASS_BITS))
    return done


def with_slots(sharded: DataFrame) -> DataFrame:
    """Adds ``slot``: the row's place in its shard, gapless from 0, for shards of any size."""
    ranked = ordered_rank(sharded, ["shard"], [F.col("doc_id"), F.col("text_crc32")], "_rank")
    return ranked.withColumn("slot", F.col("_rank") - 1).drop("_rank", "_rank_total")


def write_shards(docs: DataFrame, sharded: DataFrame, path: str) -> None:
    """Writes the documents as one folder per shard, sorted by slot; equal rows take their places in turn."""
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    keys = ["_id", "_crc"]
    named = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))  # a null id has a name of its own
    places = sharded.select(named.alias("_id"), F.col("text_crc32").alias("_crc"), "shard", "slot")
    turns = ordered_rank(places, keys, [F.col("shard"), F.col("slot")], "_turn").drop("_turn_total")
    mine = ordered_rank(docs.withColumns({"_id": named, "_crc": crc}), keys, [F.xxhash64(*docs.columns)], "_turn").drop("_turn_total")
    mine.join(turns, [*keys, "_turn"]).drop(*keys, "_turn").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


@query("op1_kd_sharding")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = with_slots(kd_shards(table(spark, sf_dir, "documents"), shards=16))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
