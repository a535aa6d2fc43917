"""Frame choice and multi-resolution support against plain loops."""

import math

import numpy as np

from splatlake.operators import support as su, video as vd
from splatlake.plans.frames import choose_frames

FRAME = "scan_id string, frame_id int, thumb array<double>, features int, sharpness double, descriptors array<array<bigint>>"


def diff(a, b):
    return float(np.abs(np.array(a) - np.array(b)).mean())


def matches(x, y):
    if not x or not y:
        return 0
    d = [[sum((int(p) ^ int(q)).bit_count() if (int(p) ^ int(q)) >= 0 else ((int(p) ^ int(q)) & (2**64 - 1)).bit_count() for p, q in zip(s, t)) for t in y] for s in x]
    n = 0
    for i, row in enumerate(d):
        j = row.index(min(row))
        column = [r[j] for r in d]
        n += column.index(min(column)) == i and row[j] <= 50
    return n


def chosen(frames, limit):
    """One scan: (frame ids, types) of the final selection."""
    frames = sorted(frames, key=lambda f: f["id"])
    kept = []
    for f in frames:
        if kept:
            gap, d = f["id"] - kept[-1]["id"], diff(f["thumb"], kept[-1]["thumb"])
            near = gap >= 6 and 6.5 <= d <= 45 and all(diff(f["thumb"], k["thumb"]) >= 6.5 for k in kept[-5:])
            if not (gap >= 28 or near):
                continue
        kept.append(f)

    def spread(rows, gap, least, most):
        out = []
        for f in sorted(rows, key=lambda f: (-f["features"], -f["sharp"], f["id"])):
            if len(out) < most and all(abs(f["id"] - o["id"]) >= gap and diff(f["thumb"], o["thumb"]) >= least for o in out):
                out.append(f)
        return out

    anchors, loops = spread(frames, 40, 10.0, 25), spread(kept, 35, 8.0, 60)
    pool = sorted({f["id"]: f for f in anchors + loops}.values(), key=lambda f: f["id"])
    pairs = [(-n, a["id"], b["id"]) for i, a in enumerate(pool) for b in pool[i + 1:] if b["id"] - a["id"] >= 120 for n in [matches(a["desc"], b["desc"])] if n >= 30]
    ends = {e for _, a, b in sorted(pairs)[:20] for e in (a, b)}
    for f in pool:
        f["features"] = len(f["desc"])
    types = {}
    for name, ids in (("continuity", {f["id"] for f in kept}), ("anchor", {f["id"] for f in anchors}), ("loop", ends)):
        for i in ids:
            types.setdefault(i, set()).add(name)
    merged = [f for f in frames if f["id"] in types]
    must = [f for f in merged if types[f["id"]] & {"anchor", "loop"}]
    rest = [f for f in merged if f not in must]
    slots = limit - len(must)
    if slots <= 0:
        must = sorted(must, key=lambda f: ("loop" not in types[f["id"]], "anchor" not in types[f["id"]], -f["features"], -f["sharp"], f["id"]))[:limit]
        rest = []
    elif len(rest) > slots:
        size, prev, picked = len(rest) / slots, None, []
        for i in range(slots):
            group = rest[int(i * size):int((i + 1) * size)]
            scores = []
            for f in group:
                d = 6.5 if prev is None else diff(f["thumb"], prev)
                scores.append(2.0 * d + 0.01 * f["features"] + 0.001 * f["sharp"] - 2.0 * max(0.0, d - 45.0))
            best = group[scores.index(max(scores))]
            picked.append(best)
            prev = best["thumb"]
        rest = picked
    return {(f["id"], ",".join(sorted(types[f["id"]]))) for f in must + rest}


def test_choose_frames(spark):
    rng = np.random.default_rng(5)
    places = [rng.integers(-2**62, 2**62, (40, 4)) for _ in range(3)]
    rows = []
    for scan in ("a", "b"):
        for i in range(150):
            look = (rng.random(16) * 60 + 40 * (i // 12 % 3)).round(3).tolist()
            desc = None if i == 7 else [] if i == 11 else [[int(v) for v in r] for r in places[i // 25 % 3]]
            rows.append((scan, 2 * i, look, int(rng.integers(50, 400)), float(rng.integers(0, 200)), desc))
    d = spark.createDataFrame(rows, FRAME)
    for limit in (8, 40):
        got = {}
        for r in choose_frames(d, limit).collect():
            got.setdefault(r.scan_id, set()).add((r.frame_id, ",".join(r.types)))
        for scan in ("a", "b"):
            mine = [dict(id=r[1], thumb=r[2], features=r[3], sharp=r[4], desc=r[5] or []) for r in rows if r[0] == scan]
            assert got[scan] == chosen(mine, limit), (scan, limit)
            assert len(got[scan]) <= limit
    assert any("loop" in t for _, t in got["a"])


def test_no_frames(spark):
    assert choose_frames(spark.createDataFrame([], FRAME)).count() == 0


def test_voxel_levels(spark):
    rng = np.random.default_rng(3)
    ref = [("a", *map(float, p)) for p in rng.random((60, 3)) * 2] + [("few", 0.0, 0.0, 0.0)] * 7
    sigma = [0.0, None, float("nan"), -1.0, 0.01, 0.05, 0.2, 0.6, float("inf")]
    query = [(s, i, *map(float, rng.random(3) * 4), sigma[i % 9]) for s in ("a", "few", "none") for i in range(180)]
    query += [("a", 900, float("nan"), 0.0, 0.0, 0.1), ("a", 901, None, 0.0, 0.0, 0.1), ("a", 902, float("inf"), 0.0, 0.0, 0.1)]
    q = spark.createDataFrame(query, "scan_id string, point_id bigint, x double, y double, z double, sigma double")
    r = spark.createDataFrame(ref, "scan_id string, x double, y double, z double")
    got = {(x.scan_id, x.point_id): (x.level, x.supported) for x in su.voxel_member_levels(q, r, spark.createDataFrame([("a", 0.02)], "scan_id string, spacing double")).collect()}
    assert len(got) == len(query)
    clean = lambda s: s if s is not None and math.isfinite(s) and s > 0 else 0.0
    mine = [(i, (x, y, z), clean(s)) for scan, i, x, y, z, s in query if scan == "a" and i < 900]
    gap = max(0.02, float(np.median([s for *_, s in mine if s > 0])) * 0.5, 1e-5)
    sizes = [max(gap * 0.5, 1e-5)]
    target = float(np.percentile([3 * gap + 3 * s for *_, s in mine], 99)) * 0.5
    while sizes[-1] < target and len(sizes) < 12:
        sizes.append(sizes[-1] * 2)
    near = np.array([p[1:] for p in ref if p[0] == "a"])
    low = np.minimum(near.min(0), np.array([p for _, p, _ in mine]).min(0))
    levels = set()
    for i, p, s in mine:
        level = min(int(np.searchsorted(2 * np.array(sizes), 3 * gap + 3 * s)), len(sizes) - 1)
        levels.add(level)
        cell = lambda v: np.floor((v - low) / sizes[level])
        want = bool((np.abs(cell(near) - cell(np.array(p))).max(1) <= 1).any())
        assert got[("a", i)] == (level, want), i
    assert len(levels) >= 3
    assert all(got[(s, i)] == (None, False) for s in ("few", "none") for i in range(180))
    assert all(got[("a", i)] == (None, False) for i in (900, 901, 902))
