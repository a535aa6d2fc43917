"""Prefix trie of conversations: union over sorted-neighbour LCP edges, deepest first.

A conversation is its turns' digests in order, cut into chunks of CHUNK turns.  Round k sorts the
k-th chunks of all conversations that still share everything before, by (prefix, chunk, id), over
range partitions.  Neighbours are joined by an edge with the length of their longest common prefix.
A task unions its edges in descending depth; every merge of components is a branching node, and the
nodes between two branchings follow from the turns of any member.  Nodes that reach over a partition
boundary lie on the path of the boundary prefix: a task contracts its forest to these paths (at most
2 x (CHUNK + 1) nodes), which are merged by the digest of their prefix.  Conversations whose whole
chunk is shared go on to the next round, so the number of rounds follows the depth of what is shared,
not the longest conversation.  Rounds are closed from the deepest up: what lies below a chunk is
carried into it by one of the conversations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from splatlake.llm import query
from splatlake.llm.common import bound_batches, cut, table
from splatlake.operators.skew import ordered_rank, skew_join

CHUNK, CODE = 64, 32  # turns of a chunk, hex digits of a turn's digest (128 bits)
SHARED, HEAD = 5, 9  # conversations c - c % SHARED lend their first crc32(c) % HEAD turns
ENDS = 50_000  # ids in one piece of the list that is hashed
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
MADE = NODE + ", pid int, key string, parent_key string, above array<string>, own bigint, piece bigint, ids string, root bigint"


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, code, bytes): turns numbered from 0, nulls first, equal turn numbers by digest."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    body = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.substring(F.sha2(body.cast("binary"), 256), 1, CODE).alias("code"), F.octet_length(text).cast("bigint").alias("bytes"))
    return ordered_rank(rows, ["conv_id"], [F.asc_nulls_first("turn"), F.col("code")], "_n").select(
        "conv_id", (F.col("_n") - 1).alias("at"), "code", "bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns with the heads lent by others, and the ids of all conversations."""
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD
    convs = turns.select("conv_id").distinct()
    heads = turns.where(F.col("at") < HEAD - 1).groupBy(F.col("conv_id").alias("base")).agg(
        F.sort_array(F.collect_list(F.struct("at", "code", "bytes"))).alias("turns"))  # HEAD - 1 turns at most
    lent = cut(convs.withColumns({"base": F.col("conv_id") - F.col("conv_id") % SHARED, "h": head}).join(heads, "base", "left").select(
        "conv_id", "h", F.expr(f"slice(coalesce(turns, array()), 1, cast(h as int))").alias("turns")))
    first = lent.select("conv_id", F.inline("turns")).select("conv_id", "at", "code", "bytes")
    sizes = lent.select("conv_id", "h", F.size("turns").cast("bigint").alias("taken"))
    own = skew_join(turns, sizes, ["conv_id"], ["at"]).where("at >= h").select("conv_id", (F.col("at") - F.col("h") + F.col("taken")).alias("at"), "code", "bytes")
    return first.unionByName(own), lent.select("conv_id")


def chunks(turns: DataFrame, convs: DataFrame, chunk: int) -> DataFrame:
    """(conv_id, k, codes, bytes, more): one row per chunk of a conversation, chunk 0 also without turns."""
    parts = turns.groupBy("conv_id", F.floor(F.col("at") / chunk).cast("bigint").alias("k")).agg(
        F.sort_array(F.collect_list(F.struct("at", "code", "bytes"))).alias("t"))  # turns of one chunk
    parts = parts.select("conv_id", "k", F.array_join("t.code", "").alias("codes"), F.col("t.bytes").alias("bytes"))
    last = parts.groupBy("conv_id").agg(F.max("k").alias("last"))
    whole = convs.join(last, "conv_id", "left").join(parts, "conv_id", "left")
    return whole.select("conv_id", F.coalesce("k", F.lit(0)).cast("bigint").alias("k"), F.coalesce("codes", F.lit("")).alias("codes"),
                        F.coalesce("bytes", F.array().cast("array<bigint>")).alias("bytes"), F.coalesce(F.col("k") < F.col("last"), F.lit(False)).alias("more"))


def common(a: str, b: str) -> int:
    """Digests that two chunks share at their beginning."""
    n, most = 0, min(len(a), len(b))
    while n < most and a[n: n + CODE] == b[n: n + CODE]:
        n += CODE
    return n // CODE


def sorted_round(segments: DataFrame) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    """Segments in range partitions (``pid``), and what each partition shares with its neighbours.

    The driver gets two numbers for each partition.
    """
    order = ["prefix", "codes", "conv_id"]
    ranged = cut(segments.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pid", F.spark_partition_id()))

    def ends(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = last = None
        for pdf in frames:
            if len(pdf):
                first = pdf.iloc[0] if first is None else first
                last = pdf.iloc[-1]
        if first is not None:
            yield pd.DataFrame({"pid": [int(first.pid)], "p0": [first.prefix], "c0": [first.codes], "p1": [last.prefix], "c1": [last.codes]})

    edges = ranged.select("pid", "prefix", "codes").mapInPandas(ends, "pid int, p0 string, c0 string, p1 string, c1 string")
    before = W.orderBy("pid")  # one row for each partition
    both = edges.select("pid", "p0", "c0", F.lag("p1").over(before).alias("p"), F.lag("c1").over(before).alias("c"))
    shared = F.pandas_udf(lambda p0, c0, p, c: pd.Series([common(w, y) if v == x else -1 for v, w, x, y in zip(p0, c0, p, c)], dtype="int64"), "bigint")
    left = {r.pid: int(r.n) for r in both.select("pid", shared("p0", "c0", "p", "c").alias("n")).collect()}
    pids = sorted(left)
    return ranged, {p: (left[p], left[q] if q is not None else -1) for p, q in zip(pids, [*pids[1:], None])}


def partitions(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of one range partition at a time; they come one partition after the other."""
    held: list[pd.DataFrame] = []
    for pdf in frames:
        for pid, part in pdf.groupby("pid", sort=False):
            if held and held[0]["pid"].iloc[0] != pid:
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(part)
    if held:
        yield pd.concat(held, ignore_index=True)


def still_shared(ranged: DataFrame, shared: dict[int, tuple[int, int]], chunk: int) -> DataFrame:
    """(conv_id, prefix, more) of segments whose whole chunk is also another's; ``prefix`` now has the chunk in it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in partitions(frames):
            left, right = (n == chunk for n in shared[int(pdf["pid"].iloc[0])])
            full = (pdf["codes"].str.len() == chunk * CODE).to_numpy()
            same = ((pdf["codes"] == pdf["codes"].shift()) & (pdf["prefix"] == pdf["prefix"].shift())).to_numpy()
            same[0] = left
            kept = pdf[full & (same | np.append(same[1:], right))]
            made = [(c, m, prefix_key(a, b)) for c, m, a, b in zip(kept["conv_id"].tolist(), kept["more"].tolist(), kept["prefix"], kept["codes"])]
            yield pd.DataFrame(made, columns=["conv_id", "more", "prefix"], dtype=object)

    return ranged.select("prefix", "codes", "conv_id", "more", "pid").mapInPandas(run, "conv_id bigint, more boolean, prefix string")


def prefix_key(prefix: str, codes: str) -> str:
    return hashlib.sha256((prefix + codes).encode()).hexdigest()


class Forest:
    """The trie nodes of one partition, built by union-find over the edges between sorted neighbours.

    Items are the rows and, along a boundary that the partition shares with its neighbour, one empty
    item for each depth of the shared path; they make every node on the path a node of its own and
    mark it open.  Each prefix has an empty item at depth 0, so that its root is open, too.
    """

    def __init__(self, pdf: pd.DataFrame, left: int, right: int):
        self.ids, self.codes, self.prefix = pdf["conv_id"].to_numpy(), pdf["codes"].tolist(), pdf["prefix"].tolist()
        self.sums = [np.concatenate(([0], np.cumsum(b, dtype=np.int64))) for b in pdf["bytes"]]
        more = pdf["more"].to_numpy()
        tails = list(zip(pdf["tail_children"].tolist(), pdf["tail_leaves"].tolist(), pdf["tail_saved"].tolist()))
        self.depth, self.n, self.least, self.children, self.leaves, self.saved = [], [], [], [], [], []
        self.member, self.open, self.ends, self.parent = [], [], [], []
        self.moved: dict[int, list[int]] = {}  # children of a node
        edges: list[int] = []  # edge k joins items k - 1 and k

        def empty(depth: int, edge: int) -> None:
            edges.append(edge)
            self.add(depth, 0, None, 0, 0, 0, -1, True, [])

        for k, codes in enumerate(self.codes):
            if k and self.prefix[k] == self.prefix[k - 1]:
                edges.append(common(self.codes[k - 1], codes))
            else:
                path = max(left, 0) if k == 0 else 0
                for d in range(path + 1):
                    empty(d, d - 1)
                edges.append(path)
            self.add(len(codes) // CODE, 1, int(self.ids[k]), *tails[k], k, False, [] if more[k] else [k])
        for d in range(right, -1, -1):
            empty(d, d)
        self.union(np.array(edges))

    def add(self, *values) -> int:
        for held, value in zip((self.depth, self.n, self.least, self.children, self.leaves, self.saved, self.member, self.open, self.ends), values):
            held.append(value)
        self.parent.append(-1)
        return len(self.parent) - 1

    def union(self, edges: np.ndarray) -> None:
        up, top = list(range(len(edges))), list(range(len(edges)))  # union-find over items; the highest node of a root item

        def root(k: int) -> int:
            while up[k] != k:
                up[k] = up[up[k]]
                k = up[k]
            return k

        for k in np.argsort(-edges, kind="stable").tolist():
            depth = int(edges[k])
            if depth < 0:
                break
            a, b = root(k - 1), root(k)
            x, y = top[a], top[b]
            if self.depth[x] == depth and self.depth[y] == depth:
                self.absorb(x, y)
            elif self.depth[x] == depth:
                self.hang(y, x)
            elif self.depth[y] == depth:
                self.hang(x, y)
                x = y
            else:
                node = self.add(depth, 0, None, 0, 0, 0, -1, False, [])
                self.hang(x, node)
                self.hang(y, node)
                x = node
            up[b], top[a] = a, x

    def count(self, into: int, node: int) -> None:
        self.n[into] += self.n[node]
        if self.least[node] is not None and (self.least[into] is None or self.least[node] < self.least[into]):
            self.least[into] = self.least[node]
        if self.member[into] < 0:
            self.member[into] = self.member[node]
        self.open[into] = self.open[into] or self.open[node]

    def absorb(self, into: int, node: int) -> None:
        """Two nodes of the same prefix become one."""
        self.count(into, node)
        for held in (self.children, self.leaves, self.saved):
            held[into] += held[node]
        self.ends[into] += self.ends[node]
        self.parent[node] = -2
        for k in self.moved.pop(node, ()):
            self.parent[k] = into
            self.moved.setdefault(into, []).append(k)

    def hang(self, node: int, into: int) -> None:
        """A finished node becomes a child; what an open one holds is counted after the merge."""
        self.count(into, node)
        self.parent[node] = into
        self.moved.setdefault(into, []).append(node)
        if not self.open[node]:
            if not self.children[node]:
                self.leaves[node] = 1
            self.children[into] += 1
            self.leaves[into] += self.leaves[node]
            self.saved[into] += self.saved[node] + self.chain(node, self.depth[into])

    def chain(self, node: int, depth: int) -> int:
        """Savings of the nodes of one chain that are deeper than ``depth``."""
        sums = self.sums[self.member[node]]
        return (self.n[node] - 1) * int(sums[self.depth[node]] - sums[depth])

    def key(self, node: int, depth: int | None = None) -> str:
        row = self.member[node]
        return prefix_key(self.prefix[row], self.codes[row][: CODE * (self.depth[node] if depth is None else depth)])

    def id_lists(self, node: int) -> Iterator[str]:
        """Ids that end at the node, ascending: rows of equal chunks are sorted by id."""
        rows = sorted(self.ends[node])
        for at in range(0, len(rows), ENDS):
            yield ",".join(map(str, self.ids[rows[at: at + ENDS]].tolist()))


def forests(ranged: DataFrame, shared: dict[int, tuple[int, int]], above_turns: int) -> DataFrame:
    """All nodes of one round: finished ones in the columns of ``NODE``, open ones and their ends in parts.

    A finished node below an open one names it by ``parent_key``.
    """
    names = [c.strip().split()[0] for c in MADE.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in partitions(frames):
            pid = int(pdf["pid"].iloc[0])
            roots = pdf["root"].tolist()
            f = Forest(pdf, *shared[pid])
            keys: dict[int, str] = {}
            made: list[tuple] = []
            for v, up in enumerate(f.parent):
                if up == -2:
                    continue
                row, d = f.member[v], f.depth[v]
                if f.open[v]:
                    above = [f.key(v, e) for e in range(d)]
                    own = int(f.sums[row][d] - f.sums[row][d - 1]) if d else 0
                    made.append((f.least[v], above_turns + d, None, f.n[v], f.children[v], f.leaves[v], f.saved[v], None, pid, f.key(v),
                                 above[-1] if d else None, above, own, None, None, roots[row]))
                    made += [(None, None, None, None, None, None, None, None, pid, f.key(v), None, None, None, k, ids, None)
                             for k, ids in enumerate(f.id_lists(v))]
                    continue
                digest = hashlib.sha256()
                for k, ids in enumerate(f.id_lists(v)):
                    digest.update(((("," if k else "") + ids)).encode())
                least, n, start = f.least[v], f.n[v], f.depth[up] + 1
                parent, parent_key = f.least[up], None
                if f.open[up]:
                    parent = roots[row] if f.depth[up] == 0 else None
                    if parent is None:
                        parent_key = keys.get(up) or keys.setdefault(up, f.key(up))
                for e in range(start, d + 1):
                    end = e == d
                    made.append((least, above_turns + e, parent if e == start else least, n, f.children[v] if end else 1, f.leaves[v],
                                 f.saved[v] + f.chain(v, e - 1), digest.hexdigest() if end else NO_ENDS, pid, None,
                                 parent_key if e == start else None, None, None, None, None, None))
                if len(made) > 20_000:
                    yield pd.DataFrame(made, columns=names, dtype=object)
                    made = []
            yield pd.DataFrame(made, columns=names, dtype=object)

    return ranged.mapInPandas(run, MADE)


def hashed_lists(pieces: DataFrame) -> DataFrame:
    """(key, ends_sha256): the pieces of each key hashed in order, one at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, digest = None, None
        for pdf in frames:
            done = []
            for name, ids in zip(pdf["key"], pdf["ids"]):
                if name != key:
                    if key is not None:
                        done.append((key, digest.hexdigest()))
                    key, digest = name, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
            yield pd.DataFrame(done, columns=["key", "ends_sha256"], dtype=object)
        if key is not None:
            yield pd.DataFrame([(key, digest.hexdigest())], columns=["key", "ends_sha256"], dtype=object)

    return pieces.repartition("key").sortWithinPartitions("key", "pid", "piece").select("key", "ids").mapInPandas(run, "key string, ends_sha256 string")


def merged(made: DataFrame, above_turns: int) -> tuple[DataFrame, DataFrame]:
    """The nodes of a round with the parts over partition boundaries put together, and what hangs on each root.

    The second has (conv_id, tail_children, tail_leaves, tail_saved), one row for each prefix of the round.
    """
    parts = made.where("key IS NOT NULL AND ids IS NULL")
    paths = parts.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent_key").alias("parent_key"), F.max("above").alias("above"),
        F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("closed"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"),
        F.max("own").alias("own"), F.min("root").alias("root"))
    paths = cut(paths)
    on_path = paths.where("parent_key IS NOT NULL").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("on_path"))
    nodes = paths.join(on_path, "key", "left").withColumn("n_children", F.col("closed") + F.coalesce("on_path", F.lit(0)))
    # what a node has by itself counts for all nodes above it, too
    own_leaves = F.when(F.col("n_children") == 0, 1).otherwise(F.col("leaves"))
    parts_up = nodes.select(F.explode(F.array_append("above", F.col("key"))).alias("key"), own_leaves.alias("leaves"),
                            (F.col("saved") + (F.col("n_convs") - 1) * F.col("own")).alias("saved"))
    sums = parts_up.groupBy("key").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    lists = hashed_lists(made.where("ids IS NOT NULL").select("key", "pid", "piece", "ids"))
    over = paths.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_parent"))
    whole = nodes.drop("leaves", "saved").join(sums, "key").join(lists, "key", "left").join(over, "parent_key", "left")
    local = F.col("depth") - above_turns
    whole = cut(whole.select("key", "conv_id", "depth", F.when(local == 1, F.col("root")).when(local > 1, F.col("_parent")).alias("parent_conv_id"),
                             "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256")))
    resolved = parts.select("pid", "key").join(paths.select("key", F.col("conv_id").alias("_least")), "key").withColumnRenamed("key", "parent_key")
    cols = [c.strip().split()[0] for c in NODE.split(",")]
    closed = made.where("key IS NULL")
    rows = closed.where("parent_key IS NULL").select(*cols).unionByName(
        closed.where("parent_key IS NOT NULL").join(resolved, ["pid", "parent_key"]).withColumn("parent_conv_id", F.col("_least")).select(*cols))
    below = whole.where(local == 0).select("conv_id", F.col("n_children").alias("tail_children"), F.col("n_leaves").alias("tail_leaves"),
                                           F.col("saved_tokens").alias("tail_saved"))
    return rows.unionByName(whole.where((local > 0) | F.lit(above_turns == 0)).select(*cols)), below


def prefix_trie(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations, see the columns of ``NODE``.

    Rows without conv_id belong to no conversation; null roles and texts are empty ones; null turns
    come first and equal turns are ordered by digest; repeated rows are turns of their own; ids may be
    negative (remainders have the sign of the id).  An empty table has no node, not even a root.
    Other columns are ignored.
    """
    bound_batches(conversations.sparkSession)
    turns, convs = rebuilt(ordered_turns(conversations))
    parts = cut(chunks(turns, convs, chunk))
    least = parts.agg(F.min("conv_id")).first()[0]
    zero = F.lit(0).cast("bigint")
    live = parts.where("k = 0").select("conv_id", "codes", "bytes", "more", F.lit("").alias("prefix"), F.lit(least).cast("bigint").alias("root"))
    rounds, lonely = [], parts.where("k > 0")
    while True:
        level = len(rounds)
        ranged, shared = sorted_round(live)
        rounds.append((ranged, shared))
        if ranged.where("more").isEmpty():
            break
        whole = cut(still_shared(ranged, shared, chunk))
        roots = whole.groupBy("prefix").agg(F.min("conv_id").alias("root"))
        on = skew_join(whole.where("more").select("conv_id", "prefix"), roots, ["prefix"], ["conv_id"])
        live = cut(parts.where(F.col("k") == level + 1).join(on, "conv_id").select("conv_id", "codes", "bytes", "more", "prefix", "root"))
        if live.isEmpty():
            break
        lonely = lonely.join(live.select("conv_id", F.lit(level + 1).cast("bigint").alias("k")), ["conv_id", "k"], "left_anti")
    out, below = alone(lonely, chunk), None
    for level in range(len(rounds) - 1, -1, -1):
        ranged, shared = rounds[level]
        tail = F.when(F.col("more"), F.lit(1)).otherwise(F.lit(0)).cast("bigint")
        if below is None:
            ranged = ranged.withColumns({"tail_children": tail, "tail_leaves": tail, "tail_saved": zero})
        else:
            on = rounds[level + 1][0].select("conv_id", F.lit(True).alias("_on"))
            joined = ranged.join(on, "conv_id", "left").join(below, "conv_id", "left")
            ranged = joined.withColumns({c: F.when(F.col("_on"), F.coalesce(c, zero)).otherwise(zero if c == "tail_saved" else tail) for c in
                                         ("tail_children", "tail_leaves", "tail_saved")}).drop("_on")
            ranged = ranged.repartition("pid").sortWithinPartitions("pid", "prefix", "codes", "conv_id")
        rows, below = merged(cut(forests(ranged, shared, level * chunk)), level * chunk)
        out = out.unionByName(rows)
    return out


def alone(lonely: DataFrame, chunk: int) -> DataFrame:
    """Nodes of chunks that no other conversation leads to."""
    at = F.col("k") * chunk + F.col("_at") + 1
    last = ~F.col("more") & (F.col("_at") == F.size("bytes") - 1)
    ids = F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    return lonely.withColumn("_at", F.explode(F.sequence(F.lit(0), F.size("bytes") - 1))).select(
        "conv_id", at.cast("bigint").alias("depth"), F.col("conv_id").alias("parent_conv_id"), one.alias("n_convs"), F.when(last, zero).otherwise(one).alias("n_children"),
        one.alias("n_leaves"), zero.alias("saved_tokens"), F.when(last, ids).otherwise(NO_ENDS).alias("ends_sha256"))


SQL = r"""
WITH RECURSIVE ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT c, xor(list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split(c::VARCHAR, ''),
        lambda ch: list_concat([ascii(ch)::UBIGINT], list_value(256::UBIGINT, 256, 256, 256, 256, 256, 256, 256))))),
        lambda a, x: CASE WHEN x < 256 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END), 4294967295::UBIGINT) % 9 AS h FROM ids),
t AS (SELECT conv_id AS c, substring(sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS code,
        strlen(coalesce(text, '')) AS b, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, code, b, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, code) - 1 AS i FROM t),
r AS (SELECT h.c, 0 AS part, o.i, o.code, o.b FROM h JOIN o ON o.c = h.c - h.c % 5 WHERE o.i < h.h
      UNION ALL SELECT h.c, 1, o.i, o.code, o.b FROM h JOIN o ON o.c = h.c WHERE o.i >= h.h),
n AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, i) AS d, code, b FROM r),
p AS (SELECT c, d, b, string_agg(code, '') OVER (PARTITION BY c ORDER BY d) AS k FROM n UNION ALL SELECT c, 0, 0, '' FROM ids),
len AS (SELECT c, max(d) AS len FROM p GROUP BY c),
node AS (SELECT p.k, p.d, min(p.c) AS c, count(*) AS n, max(p.b) AS b,
           coalesce(string_agg(CASE WHEN len.len = p.d THEN p.c::VARCHAR END, ',' ORDER BY p.c), '') AS ends FROM p JOIN len ON len.c = p.c GROUP BY p.k, p.d),
up AS (SELECT node.c, node.d, q.c AS parent, q.d AS pd FROM node JOIN node q ON q.d = node.d - 1 AND q.k = left(node.k, 32 * (node.d - 1))),
kids AS (SELECT parent AS c, pd AS d, count(*) AS n FROM up GROUP BY ALL),
own AS (SELECT node.k, node.d, node.c, (node.n - 1) * node.b AS saved, CASE WHEN kids.n IS NULL THEN 1 ELSE 0 END AS leaf, coalesce(kids.n, 0) AS kids
        FROM node LEFT JOIN kids ON kids.c = node.c AND kids.d = node.d),
sub AS (SELECT p.k, p.d, sum(own.saved) AS saved, sum(own.leaf) AS leaves FROM own JOIN p ON p.c = own.c AND p.d <= own.d GROUP BY p.k, p.d)
SELECT node.c AS conv_id, node.d AS depth, up.parent AS parent_conv_id, node.n AS n_convs, own.kids AS n_children, CAST(sub.leaves AS BIGINT) AS n_leaves,
       CAST(sub.saved AS BIGINT) AS saved_tokens, sha256(node.ends) AS ends_sha256
FROM node JOIN own ON own.c = node.c AND own.d = node.d JOIN sub ON sub.k = node.k AND sub.d = node.d LEFT JOIN up ON up.c = node.c AND up.d = node.d
"""


@query("op11_prefix_trie", SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))
