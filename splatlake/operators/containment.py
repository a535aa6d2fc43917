"""Gaussians against an occupied grid: containment, largest inside scale, cap and shrink.

Occupied cells are packed into blocks of 8 x 8 x 8 bits.  A Gaussian meets the few blocks that its
extent touches once, by an equi-join on the block; all its probes, and every step of a search over
scales, are then tested inside its own row, in batches.  No probe is a row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# --- fixed values: probes, scale search and correction -----------------------------------
PROBE_DIRECTIONS, PROBE_SHELLS, PROBE_SIGMA, SHRINK_STEPS = 42, 2, 2.0, 7
MAX_SIGMA_VOXELS, SHRINK_MARGIN, HALVINGS, SNAP_BELOW, MIN_FACTOR = 1.25, 0.98, 8, 0.10, 1e-4

KEY = ["scan_id", "point_id"]
BLOCK = ["bi", "bj", "bk"]


def ellipsoid_probes(directions: int = PROBE_DIRECTIONS, shells: int = PROBE_SHELLS) -> np.ndarray:
    """(n, 3): six axes, then a Fibonacci sphere, on evenly spaced shells."""
    i = np.arange(directions)
    z = 1.0 - 2.0 * (i + 0.5) / directions
    r, turn = np.sqrt(np.maximum(0.0, 1.0 - z * z)), i * math.pi * (3.0 - math.sqrt(5.0))
    axes = np.array([(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)], float)
    unit = np.vstack((axes, np.column_stack((r * np.cos(turn), r * np.sin(turn), z))))
    return np.vstack([unit * (s + 1) / shells for s in range(shells)])


def pack_cells(occupied: DataFrame) -> DataFrame:
    """(scan_id, bi, bj, bk, bits): 512 cells as eight numbers; repeated cells count once."""
    low = {b: F.shiftright(c, 3).alias(b) for b, c in zip(BLOCK, ("ci", "cj", "ck"))}
    bit = F.expr("shiftleft(1L, int((cj & 7) * 8 + (ck & 7)))")
    rows = occupied.select("scan_id", *low.values(), F.col("ci").bitwiseAND(7).alias("_w"), bit.alias("_b"))
    words = [F.coalesce(F.bit_or(F.when(F.col("_w") == w, F.col("_b"))), F.lit(0).cast("bigint")) for w in range(8)]
    return rows.groupBy("scan_id", *BLOCK).agg(F.array(*words).alias("bits"))


def with_blocks(gaussians: DataFrame, blocks: DataFrame, voxel: float, sigma: str = "sigma") -> DataFrame:
    """Adds the blocks around each Gaussian: ``places`` (three numbers each) and ``words`` (eight each).

    The extent is clipped to the occupied range of the scan, so a Gaussian of any size meets at most
    the blocks of its grid.
    """
    ends = blocks.groupBy("scan_id").agg(*[f(b).alias(f"_{n}{b}") for b in BLOCK for n, f in (("lo", F.min), ("hi", F.max))])
    g = gaussians.select(*KEY, "x", "y", "z", sigma, "rot").join(ends, "scan_id")
    for r, (b, a) in enumerate(zip(BLOCK, "xyz")):
        reach = PROBE_SIGMA * F.sqrt(sum((F.pow(F.col("rot")[3 * r + c] * F.col(sigma)[c], 2) for c in range(3)), F.lit(0.0)))

        def block(v: Column) -> Column:
            return F.floor(v / voxel / 8).cast("int")

        # one cell more on each side: rounding, and a centre moved to the middle of its cell
        first = F.greatest(block(F.col(a) - reach - 1.5 * voxel), F.col(f"_lo{b}"))
        last = F.least(block(F.col(a) + reach + 1.5 * voxel), F.col(f"_hi{b}"))
        g = g.withColumn(b, F.explode_outer(F.when(first <= last, F.sequence(first, last))))
    met = g.select(*KEY, "x", "y", "z", sigma, "rot", *BLOCK).join(blocks, ["scan_id", *BLOCK], "left")
    held = F.collect_list(F.when(F.col("bits").isNotNull(), F.struct(F.array(*BLOCK).alias("p"), "bits")))
    one = met.groupBy(*KEY).agg(*[F.first(c).alias(c) for c in ("x", "y", "z", sigma, "rot")], held.alias("_h"))
    return one.select(*KEY, "x", "y", "z", sigma, "rot", F.flatten("_h.p").alias("places"), F.flatten("_h.bits").alias("words"))


class Packed:
    """The blocks of one batch of Gaussians; tells which points of a row lie in occupied cells."""

    def __init__(self, pdf: pd.DataFrame, voxel: float, sigma: str = "sigma"):
        self.voxel, self.n = voxel, len(pdf)
        self.center = pdf[["x", "y", "z"]].to_numpy(float)
        self.sigma = np.array(pdf[sigma].tolist(), float).reshape(-1, 3)
        self.rot = np.array(pdf["rot"].tolist(), float).reshape(-1, 3, 3)
        counts = pdf["places"].map(len).to_numpy() // 3
        places = np.concatenate([np.asarray(p, np.int64) for p in pdf["places"]] or [np.empty(0, np.int64)]).reshape(-1, 3)
        words = np.concatenate([np.asarray(w, np.int64) for w in pdf["words"]] or [np.empty(0, np.int64)]).reshape(-1, 8)
        self.low = places.min(axis=0) if len(places) else np.zeros(3, np.int64)
        self.span = places.max(axis=0) - self.low + 1 if len(places) else np.ones(3, np.int64)
        keys = self.keys(np.repeat(np.arange(self.n), counts), places)
        order = np.argsort(keys)
        self.sorted, self.words = keys[order], words[order]
        self.probes = ellipsoid_probes()

    def keys(self, row: np.ndarray, block: np.ndarray) -> np.ndarray:
        at = block - self.low
        return ((row * self.span[0] + at[..., 0]) * self.span[1] + at[..., 1]) * self.span[2] + at[..., 2]

    def occupied(self, rows: np.ndarray, points: np.ndarray) -> np.ndarray:
        """``points``: (rows, n, 3) in units of length."""
        if not len(self.sorted):
            return np.zeros(points.shape[:2], bool)
        cell = np.rint(points / self.voxel).astype(np.int64)
        block, inner = cell >> 3, cell & 7
        near = ((block >= self.low) & (block < self.low + self.span)).all(axis=2)
        key = np.where(near, self.keys(rows[:, None], block), -1)
        at = np.searchsorted(self.sorted, key).clip(max=len(self.sorted) - 1)
        bits = self.words[at, inner[..., 0]] >> (inner[..., 1] * 8 + inner[..., 2])
        return near & (self.sorted[at] == key) & ((bits & 1) == 1)

    def probed(self, rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
        """(rows, probes): which probes of the ellipsoids, scaled by ``factor``, are inside."""
        local = self.sigma[rows][:, None, :] * self.probes * (PROBE_SIGMA * factor[:, None, None])
        return self.occupied(rows, self.center[rows][:, None, :] + np.einsum("nij,ndj->ndi", self.rot[rows], local))

    def centers_inside(self, rows: np.ndarray) -> np.ndarray:
        return self.occupied(rows, self.center[rows][:, None, :])[:, 0]

    def largest(self, rows: np.ndarray, steps: int = SHRINK_STEPS) -> np.ndarray:
        """Largest factor in [0, 1] with all probes inside, by bisection."""
        lo, hi = np.zeros(len(rows)), np.ones(len(rows))
        for _ in range(steps):
            mid = (lo + hi) / 2
            inside = self.probed(rows, mid).all(axis=1)
            lo, hi = np.where(inside, mid, lo), np.where(inside, hi, mid)
        return lo


def in_rows(gaussians: DataFrame, occupied: DataFrame, voxel: float, test: Callable[[Packed], tuple[np.ndarray, dict]], schema: str) -> DataFrame:
    """``test`` on batches of Gaussians with their blocks: the rows it speaks of, and its columns beside the key."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for start in range(0, len(pdf), 2000):  # 2,000 x 96 probes at a time
                part = pdf.iloc[start: start + 2000]
                packed = Packed(part, voxel)
                rows, made = test(packed)
                yield pd.DataFrame({"scan_id": part["scan_id"].to_numpy(object)[rows], "point_id": part["point_id"].to_numpy()[rows], **made})

    return with_blocks(gaussians, pack_cells(occupied), voxel).mapInPandas(run, f"scan_id string, point_id bigint, {schema}")


def ellipsoid_inside(gaussians: DataFrame, occupied: DataFrame, voxel: float) -> DataFrame:
    """(scan_id, point_id, center_inside, all_inside, inside_fraction) for oriented Gaussians.

    ``gaussians``: x, y, z, sigma (array of 3), rot (row-major 3 x 3) in the grid's coordinates; the
    cell of a point is its rounded quotient by ``voxel``.  Scans without occupied cells give no row.
    """
    def test(p: Packed) -> tuple[np.ndarray, dict]:
        rows = np.arange(p.n)
        inside = p.probed(rows, np.ones(p.n))
        return rows, {"center_inside": p.centers_inside(rows), "all_inside": inside.all(axis=1), "inside_fraction": inside.mean(axis=1)}

    return in_rows(gaussians, occupied, voxel, test, "center_inside boolean, all_inside boolean, inside_fraction double")


def containment_report(inside: DataFrame, key: list[str]) -> DataFrame:
    """Gaussians, shares of centres and of whole ellipsoids inside, and the mean share of probes, per object."""
    return inside.groupBy(*key).agg(
        F.count("*").alias("gaussians"), F.avg(F.col("center_inside").cast("double")).alias("center_inside_ratio"),
        F.avg(F.col("all_inside").cast("double")).alias("ellipsoid_inside_ratio"), F.avg("inside_fraction").alias("probe_inside_ratio"))


def max_inside_scale(gaussians: DataFrame, occupied: DataFrame, voxel: float, steps: int = SHRINK_STEPS) -> DataFrame:
    """(scan_id, point_id, max_scale) of the Gaussians that stick out: the largest uniform scale that stays inside."""
    def test(p: Packed) -> tuple[np.ndarray, dict]:
        out = np.flatnonzero(~p.probed(np.arange(p.n), np.ones(p.n)).all(axis=1))
        return out, {"max_scale": p.largest(out, steps)}

    return in_rows(gaussians, occupied, voxel, test, "max_scale double")


def constrain_extents(gaussians: DataFrame, occupied: DataFrame, voxel: float) -> DataFrame:
    """Caps sigmas, then shrinks what still sticks out: (scan_id, point_id, x, y, z, sigma, factor, shrunk, snapped, center_inside).

    Sigmas are capped at MAX_SIGMA_VOXELS cells.  A Gaussian with a probe outside is scaled by SHRINK_MARGIN of
    its largest inside scale; below SNAP_BELOW its centre first moves to the middle of its cell.
    Rows that still stick out are halved, HALVINGS times at most, and in the end get MIN_FACTOR at
    the middle of the cell.  A centre outside the support cannot be corrected here (move it first,
    see :func:`cleanup.project_to_support`): it stays and gets MIN_FACTOR.
    """
    top = F.lit(MAX_SIGMA_VOXELS * voxel)
    capped = gaussians.withColumn("sigma", F.transform("sigma", lambda s: F.least(s, top)))

    def test(p: Packed) -> tuple[np.ndarray, dict]:
        every, factor, snapped = np.arange(p.n), np.ones(p.n), np.zeros(p.n, bool)
        home = p.centers_inside(every)
        out = every[~p.probed(every, factor).all(axis=1)]

        def snap(rows: np.ndarray) -> None:
            p.center[rows] = np.rint(p.center[rows] / voxel) * voxel
            snapped[rows] = True

        factor[out] = p.largest(out)
        deep = out[(factor[out] < SNAP_BELOW) & home[out]]
        snap(deep)
        factor[deep] = p.largest(deep)
        factor[out] = np.clip(factor[out] * SHRINK_MARGIN, MIN_FACTOR, 1.0)
        left = out
        for _ in range(HALVINGS):
            left = left[~p.probed(left, factor[left]).all(axis=1)]
            factor[left] = np.maximum(factor[left] / 2, MIN_FACTOR)
        left = left[~p.probed(left, factor[left]).all(axis=1)]
        snap(left[home[left] & ~snapped[left]])
        factor[left] = MIN_FACTOR
        shrunk = np.zeros(p.n, bool)
        shrunk[out] = True
        return every, {"x": p.center[:, 0], "y": p.center[:, 1], "z": p.center[:, 2], "sigma": list(p.sigma * factor[:, None]), "factor": factor,
                       "shrunk": shrunk, "snapped": snapped, "center_inside": home}

    return in_rows(capped, occupied, voxel, test,
                   "x double, y double, z double, sigma array<double>, factor double, shrunk boolean, snapped boolean, center_inside boolean")
