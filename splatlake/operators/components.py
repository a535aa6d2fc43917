"""Connected components and density clusters as keyed, iterated joins."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, functions as F

from splatlake import config as cfg
from splatlake.operators.skew import spread_join
from splatlake.session import cut


def connected_components(vertices: DataFrame, edges: DataFrame, key: list[str]) -> DataFrame:
    """(key, id, component): the smallest vertex id each vertex can reach.

    Edges point from the larger end to the smaller one and are rewritten by the two star steps of
    Kiveris et al. (2014): first every edge is moved to the smallest neighbour of its lower end,
    then all lower neighbours of a vertex are tied to the smallest of them.  Roots are hooked as
    well as leaves, so chains shrink by a constant factor and the number of rounds is logarithmic;
    there is no round limit, because the sum of the lower ends falls in every round that changes
    anything.  Ids may be of any orderable type.  Null ends are no edges.
    """
    def low(e: DataFrame, end: str) -> DataFrame:
        return e.groupBy(*key, "hi").agg(F.min("lo").alias("_low")).withColumnRenamed("hi", end)

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64(*key, "hi", "lo").cast("decimal(38,0)"))).first())

    links = edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select(
        *key, F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo")).distinct()
    links = cut(links)
    before = mark(links)
    while before[0]:
        large = links.join(low(links, "lo"), [*key, "lo"], "left").select(*key, "hi", F.coalesce("_low", "lo").alias("lo")).distinct()
        small = large.join(low(large, "hi"), [*key, "hi"])
        ends = F.expr("CASE WHEN lo = _low THEN array(hi) ELSE array(hi, lo) END")
        links = cut(small.select(*key, F.explode(ends).alias("hi"), F.col("_low").alias("lo")).distinct())
        after = mark(links)
        if after == before:
            break
        before = after
    return vertices.select(*key, "id").join(links.select(*key, F.col("hi").alias("id"), "lo"), [*key, "id"], "left").select(
        *key, "id", F.coalesce("lo", "id").alias("component"))


def offsets(radius: int, include_zero: bool = True) -> Column:
    """All integer steps of a cube as an array of structs."""
    steps = [s for s in itertools.product(range(-radius, radius + 1), repeat=3) if include_zero or any(s)]
    return F.expr("array(" + ", ".join(f"named_struct('i', {a}, 'j', {b}, 'k', {c})" for a, b, c in steps) + ")")


def with_cells(points: DataFrame, size: Column | float, names=("ci", "cj", "ck")) -> DataFrame:
    size = F.lit(float(size)) if not isinstance(size, Column) else size
    return points.withColumns({n: F.floor(F.col(a) / size).cast("int") for n, a in zip(names, "xyz")})


def near_cells(cells: DataFrame, radius: int = 1) -> DataFrame:
    """Each row once per cell of the surrounding cube (``ni``, ``nj``, ``nk``)."""
    return cells.withColumn("_o", F.explode(offsets(radius))).withColumns(
        {f"n{a}": F.col(f"c{a}") + F.col(f"_o.{a}") for a in "ijk"}).drop("_o")


PILLAR = 8  # cells of one column that meet as a block


def adjacent_cells(cells: DataFrame, key: list[str]) -> DataFrame:
    """(key, src, dst) of distinct cells that touch, src before dst.

    Blocks of eight cells of one column meet blocks of the columns around: a cell is sent about six times, not 27.
    """
    column = F.expr("explode(array(" + ", ".join(f"named_struct('i', {a}, 'j', {b})" for a, b in [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)]) + "))")
    lo, hi = (F.floor((F.col("ck") + d) / PILLAR).cast("int") for d in (-1, 1))
    near = cells.select(*key, "ci", "cj", "ck", column.alias("_o"), F.array_distinct(F.array(lo, hi)).alias("_b")).select(
        *key, "ci", "cj", "ck", (F.col("ci") + F.col("_o.i")).alias("ni"), (F.col("cj") + F.col("_o.j")).alias("nj"), F.explode("_b").alias("_block"))
    to = cells.select(*key, F.col("ci").alias("ni"), F.col("cj").alias("nj"), F.col("ck").alias("nk"), F.floor(F.col("ck") / PILLAR).cast("int").alias("_block"))
    src, dst = F.struct("ci", "cj", "ck"), F.struct(F.col("ni").alias("ci"), F.col("nj").alias("cj"), F.col("nk").alias("ck"))
    met = spread_join(near, to, [*key, "ni", "nj", "_block"]).where(F.abs(F.col("nk") - F.col("ck")) <= 1)
    return met.select(*key, src.alias("src"), dst.alias("dst")).where("src < dst")


def voxel_components(cells: DataFrame, key: list[str]) -> DataFrame:
    """Adds ``component`` to occupied cells (ci, cj, ck) under 26-neighbour adjacency."""
    ids = cells.select(*key, "ci", "cj", "ck").distinct().withColumn("id", F.struct("ci", "cj", "ck"))
    comp = connected_components(ids, adjacent_cells(ids, key), key)
    return ids.join(comp, [*key, "id"]).drop("id")


def _boxes(points: DataFrame, size: float, pad: float = 0.0) -> DataFrame:
    """Rows once per box of edge ``size`` (bi, bj, bk) that lies within ``pad`` of their place."""
    for name, axis in zip(("bi", "bj", "bk"), "xyz"):
        lo, hi = (F.floor((F.col(axis) + d) / size) for d in (-pad, pad))
        points = points.withColumn(name, F.explode(F.sequence(lo, hi)) if pad else F.floor(F.col(axis) / size))
    return points


def dbscan(points: DataFrame, key: list[str], eps: float = cfg.DBSCAN_EPS, min_samples: int = cfg.DBSCAN_MIN_SAMPLES) -> DataFrame:
    """Density clusters: (key, point_id, x, y, z, is_core, cluster), cluster null for noise.

    Cells have a diagonal of ``eps``, so points of one cell are all neighbours: a cell with
    ``min_samples`` points is core as a whole and needs no distances.  Core cells are the vertices
    of the component step, so a crowded cell never meets itself point by point.  A cluster is named
    by its smallest core point; a border point joins the smallest cluster that reaches it.
    """
    side = eps / (3.0 ** 0.5) * 0.999999
    p = cut(with_cells(points.select(*key, "point_id", "x", "y", "z"), side))
    cell = [*key, "ci", "cj", "ck"]
    counts = p.groupBy(*cell).agg(F.count("*").alias("n"))
    sparse = p.join(counts.where(F.col("n") < min_samples), cell).drop("n")
    d2 = sum(((F.col(a) - F.col(f"q{a}")) ** 2 for a in "xyz"), F.lit(0.0))
    reach = d2 <= eps * eps
    box = [*key, "bi", "bj", "bk"]

    def boxed(rows: DataFrame, *more: str) -> DataFrame:
        return _boxes(rows, 2 * eps).select(*box, *[F.col(a).alias(f"q{a}") for a in "xyz"], *more)

    def around(rows: DataFrame) -> DataFrame:
        # a point goes to the eight boxes its sphere can touch, and a neighbour lies in one of them; cells would be 125
        return _boxes(rows.select(*key, "point_id", *"xyz"), 2 * eps, eps * 1.001)

    met = spread_join(around(sparse), boxed(p), box).where(reach)
    degree = met.groupBy(*key, "point_id").agg(F.count("*").alias("degree"))
    dense = p.join(counts.where(F.col("n") >= min_samples).drop("n"), cell, "left_semi")
    core = cut(dense.unionByName(sparse.join(degree.where(F.col("degree") >= min_samples), [*key, "point_id"]).drop("degree").select(*dense.columns)))
    # one vertex per core cell, named by its smallest core point
    cells = core.groupBy(*cell).agg(F.min("point_id").alias("id"))
    # pairs of core cells come before their points, so a crowded cell does not meet itself and points are not sent to empty cells
    at = cells.select(*cell, *[F.col(c).cast("double").alias(a) for c, a in zip(("ci", "cj", "ck"), "xyz")])
    near = _boxes(at, 4.0, 2.0).select(*box, "ci", "cj", "ck")
    to = _boxes(at, 4.0).select(*box, *[F.col(f"c{x}").alias(f"n{x}") for x in "ijk"])
    close = [F.abs(F.col(f"n{x}") - F.col(f"c{x}")) <= 2 for x in "ijk"]
    pairs = spread_join(near, to, box).where(close[0] & close[1] & close[2]).where(
        "ni > ci OR (ni = ci AND (nj > cj OR (nj = cj AND nk > ck)))").select(*cell, "ni", "nj", "nk")
    b = core.select(*key, F.col("ci").alias("ni"), F.col("cj").alias("nj"), F.col("ck").alias("nk"), *[F.col(x).alias(f"q{x}") for x in "xyz"])
    a = spread_join(pairs, core.select(*cell, *"xyz"), cell)
    linked = spread_join(a, b, [*key, "ni", "nj", "nk"]).where(reach).select(*cell, "ni", "nj", "nk").distinct()
    to = cells.select(*key, F.col("ci").alias("ni"), F.col("cj").alias("nj"), F.col("ck").alias("nk"), F.col("id").alias("dst"))
    edges = linked.join(cells.withColumnRenamed("id", "src"), cell).join(to, [*key, "ni", "nj", "nk"])
    comp = connected_components(cells, edges, key)
    named = core.join(cells, cell).join(comp, [*key, "id"]).select(*key, "point_id", "x", "y", "z", "ci", "cj", "ck", F.col("component").alias("cluster"))
    rest = p.join(core.select(*key, "point_id"), [*key, "point_id"], "left_anti")
    border = spread_join(around(rest), boxed(named, "cluster"), box).where(reach).groupBy(*key, "point_id").agg(F.min("cluster").alias("cluster"))
    out = rest.join(border, [*key, "point_id"], "left").select(*key, "point_id", "x", "y", "z", F.lit(False).alias("is_core"), "cluster")
    return named.select(*key, "point_id", "x", "y", "z", F.lit(True).alias("is_core"), "cluster").unionByName(out)


def nearest_occupied(cells: DataFrame, sources: DataFrame, key: list[str]) -> DataFrame:
    """Six-neighbour breadth-first distance from every grid cell to its nearest source cell.

    ``cells``: all cells (ci, cj, ck) that may be walked; ``sources``: occupied cells.  Equal
    distances keep the source that comes first in row-major order.  Distances of neighbours differ by
    one at most, so a new front can only run back into the last two; nothing older is read or
    written again, and the walk ends when a front is empty.
    """
    pos = ["ci", "cj", "ck"]
    src = F.struct(*[F.col(c).alias(f"s{c[1]}") for c in pos])
    front = cut(sources.select(*key, *pos).distinct().withColumn("source", src).withColumn("dist", F.lit(0)))
    done, older = [front], None
    steps = F.expr("array(" + ", ".join(f"named_struct('i', {a}, 'j', {b}, 'k', {c})" for a, b, c in
                                        [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]) + ")")
    walkable = cells.select(*key, *pos)
    while not front.isEmpty():
        moved = front.withColumn("_s", F.explode(steps)).select(*key, *[(F.col(c) + F.col(f"_s.{c[1]}")).alias(c) for c in pos], "source")
        fresh = spread_join(moved.groupBy(*key, *pos).agg(F.min("source").alias("source")), walkable, [*key, *pos], "left_semi")
        for known in [front] if older is None else [front, older]:
            fresh = spread_join(fresh, known.select(*key, *pos), [*key, *pos], "left_anti")
        older, front = front, cut(fresh.withColumn("dist", F.lit(len(done))))
        done.append(front)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out
