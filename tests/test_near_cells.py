"""Cells and points that meet by blocks and boxes, against brute force, and how far rows are repeated."""

import itertools
import random

from pyspark.sql import functions as F

from splatlake.operators import components as co


def test_adjacent_cells_over_block_edges(spark):
    rnd = random.Random(5)
    cells = {(k, rnd.randint(-3, 3), rnd.randint(-3, 3), rnd.randint(-18, 18)) for k in "ab" for _ in range(250)}
    df = spark.createDataFrame(sorted(cells), "scan_id string, ci int, cj int, ck int")
    got = [(r.scan_id, tuple(r.src), tuple(r.dst)) for r in co.adjacent_cells(df, ["scan_id"]).collect()]
    want = {(a[0], a[1:], b[1:]) for a, b in itertools.combinations(sorted(cells), 2) if a[0] == b[0] and all(abs(p - q) <= 1 for p, q in zip(a[1:], b[1:]))}
    assert len(got) == len(set(got)) and set(got) == want


def test_a_point_goes_to_few_boxes(spark):
    points = spark.range(2000).select(*[(F.rand(i) * 20 - 10).alias(a) for i, a in enumerate("xyz")])
    assert co._boxes(points, 0.7, 0.35 * 1.001).count() <= 2000 * 8.5  # 125 cells before


def test_clusters_of_spread_and_crowded_points(spark):
    rnd, eps, least = random.Random(9), 0.35, 6
    points = [(i, *(rnd.uniform(-1, 1) for _ in range(3))) for i in range(300)] + [(300 + i, 0.01 * (i % 7), 0.02, 3.0) for i in range(40)]
    got = {r.point_id: (r.is_core, r.cluster) for r in co.dbscan(
        spark.createDataFrame([("s", *p) for p in points], "scan_id string, point_id long, x double, y double, z double"), ["scan_id"], eps, least).collect()}
    near = {p[0]: [q[0] for q in points if sum((a - b) ** 2 for a, b in zip(p[1:], q[1:])) <= eps * eps] for p in points}
    core = {p for p in near if len(near[p]) >= least}
    name = {p: p for p in core}
    while True:
        new = {p: min(name[q] for q in near[p] if q in core) for p in core}
        if new == name:
            break
        name = new
    for p in near:
        reached = [name[q] for q in near[p] if q in core]
        assert got[p] == ((True, name[p]) if p in core else (False, min(reached) if reached else None))
