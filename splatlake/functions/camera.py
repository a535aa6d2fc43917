"""Camera, projection and small matrix columns; matrices are row-major double arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from splatlake.operators.quantiles import attach, exact_quantiles
from splatlake import config as cfg


def invert_affine(name: str) -> Column:
    """Inverse of the 4x4 affine matrix column ``name`` by cofactors; null unless 16 long and regular.

    The expression is SQL text: one parse instead of several hundred column calls.
    """
    def m(r, c):
        return f"{name}[{4 * r + c}]"

    def minor(r1, r2, c1, c2):
        return f"({m(r1, c1)} * {m(r2, c2)} - {m(r1, c2)} * {m(r2, c1)})"

    others = [(1, 2), (0, 2), (0, 1)]
    cof = [[("-" if (r + c) % 2 else "") + minor(*others[r], *others[c]) for c in range(3)] for r in range(3)]
    det = "(" + " + ".join(f"{m(0, c)} * {cof[0][c]}" for c in range(3)) + ")"
    inv = [[f"({cof[c][r]} / {det})" for c in range(3)] for r in range(3)]
    rows = []
    for r in range(3):
        shift = " + ".join(f"{inv[r][c]} * {m(c, 3)}" for c in range(3))
        rows += [*inv[r], f"-({shift})"]
    return F.expr(f"CASE WHEN size({name}) = 16 AND {det} <> 0 THEN array({', '.join(rows)}, 0D, 0D, 0D, 1D) END")


def affine_text(matrix: str, x: str, y: str, z: str) -> list[str]:
    """SQL text of the three coordinates of ``matrix * (x, y, z, 1)``."""
    return [f"({matrix}[{4 * r}] * {x} + {matrix}[{4 * r + 1}] * {y} + {matrix}[{4 * r + 2}] * {z} + {matrix}[{4 * r + 3}])"
            for r in range(3)]


def intrinsics(frame: dict, scene: dict, width: Column, height: Column, variant: str = "labelling"):
    """fx, fy, cx, cy from frame values, then scene values, then defaults.

    ``labelling`` replaces both focal lengths by the field of view when either is missing;
    ``batch`` replaces fx and lets a missing fy follow it.
    """
    def pick(key):
        return F.coalesce(frame[key], scene[key])

    raw_fx = pick("fl_x")
    raw_fy = F.coalesce(pick("fl_y"), raw_fx)
    from_angle = width * 0.5 / F.tan(pick("camera_angle_x") * 0.5)
    if variant == "labelling":
        missing = raw_fx.isNull() | raw_fy.isNull()
        fx = F.when(missing, from_angle).otherwise(raw_fx)
        fy = F.when(missing, from_angle).otherwise(raw_fy)
    else:
        fx = F.coalesce(raw_fx, from_angle)
        fy = F.coalesce(raw_fy, fx)
    return fx, fy, F.coalesce(pick("cx"), width / 2.0), F.coalesce(pick("cy"), height / 2.0)


def clip(c: Column, lo, hi) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def sigma_max(scales: Column) -> Column:
    """Largest axis of a log-scale Gaussian."""
    def axis(s):
        s = s.cast("double")
        return F.when(F.isnan(s), s).otherwise(F.exp(clip(s, -20.0, 10.0)))

    return F.array_max(F.transform(scales, axis))


def footprint_radius(radius, depth, fx, fy, k=cfg.FOOTPRINT_SIGMA, lo=cfg.FOOTPRINT_MIN_PX,
                     hi=cfg.FOOTPRINT_MAX_PX, floor=1e-6) -> Column:
    """Screen radius of a Gaussian, clipped to a pixel range."""
    return clip(F.greatest(fx, fy) * float(k) * radius / F.greatest(depth, F.lit(floor)), float(lo), float(hi))


def world_radius(gaussians: DataFrame, fallback: float = cfg.FOOTPRINT_FALLBACK_RADIUS) -> DataFrame:
    """Adds ``radius``: largest axis, with the scan's median where it is not finite and positive."""
    raw = sigma_max(F.col("scale"))
    valid = F.when((raw > 0) & ~F.isnan(raw) & (raw < float("inf")), raw)
    medians = exact_quantiles(gaussians.select("scan_id", valid.alias("r")), ["scan_id"], {"r": [0.5]})
    return attach(gaussians, medians, ["scan_id"]).withColumn("radius", F.coalesce(valid, F.col("q_r")[0], F.lit(fallback))).drop("q_r")


def sigma_alpha(gaussians: DataFrame) -> DataFrame:
    """Adds ``sigma`` (0 without scales) and ``alpha``; logits are recognised per scan."""
    o = F.col("opacity").cast("double")
    ranges = gaussians.groupBy("scan_id").agg(
        F.min(F.when(~F.isnan(o), o)).alias("_lo"), F.max(F.when(~F.isnan(o), o)).alias("_hi")
    )
    logistic = F.lit(1.0) / (F.lit(1.0) + F.exp(-clip(o, -60.0, 60.0)))
    alpha = F.when((F.col("_lo") < 0) | (F.col("_hi") > 1), logistic).otherwise(clip(o, 0.0, 1.0))
    return (
        gaussians.join(ranges, "scan_id")
        .withColumn("sigma", F.coalesce(sigma_max(F.col("scale")), F.lit(0.0)))
        .withColumn("alpha", F.when(o.isNotNull(), alpha))
        .drop("_lo", "_hi")
    )


def quat_to_rotation(q: Column) -> Column:
    """Row-major 3x3 rotation of a WXYZ quaternion (normalised first)."""
    norm = F.greatest(F.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3]), F.lit(1e-12))
    w, x, y, z = (q[i] / norm for i in range(4))
    one, two = F.lit(1.0), F.lit(2.0)
    return F.array(
        one - two * (y * y + z * z), two * (x * y - w * z), two * (x * z + w * y),
        two * (x * y + w * z), one - two * (x * x + z * z), two * (y * z - w * x),
        two * (x * z - w * y), two * (y * z + w * x), one - two * (x * x + y * y),
    )


def to_grid(x, y, z, origin: Column, axes: Column, voxel: Column):
    """Grid cell of a point: ``((p - origin) @ axes) / voxel`` rounded half to even."""
    d = [x - origin[0], y - origin[1], z - origin[2]]
    return tuple(
        F.rint((d[0] * axes[j] + d[1] * axes[3 + j] + d[2] * axes[6 + j]) / voxel).cast("int") for j in range(3)
    )


def in_grid(cell: tuple, counts: Column) -> Column:
    """Whether a grid cell lies within ``counts`` cells per axis."""
    inside = [(c >= 0) & (c < counts[i]) for i, c in enumerate(cell)]
    return inside[0] & inside[1] & inside[2]


def color_to_sh(c: Column) -> Column:
    """8-bit colour to the constant spherical-harmonic coefficient."""
    return (c / 255.0 - 0.5) / 0.28209479177387814


def sh_to_color(c: Column) -> Column:
    return F.rint(clip((c * 0.28209479177387814 + 0.5) * 255.0, 0.0, 255.0)).cast("int")
