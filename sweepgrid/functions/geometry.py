"""Scalar formulas as Columns."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GROUND = (0, 1)


def is_ground(label: str = "lab") -> Column:
    return F.col(label).isin(*GROUND)


def cell(coordinate: str | Column, resolution: float) -> Column:
    """Index of the cell that holds a coordinate."""
    return F.floor((F.col(coordinate) if isinstance(coordinate, str) else coordinate) / F.lit(float(resolution)))


def centre(index: str, resolution: float) -> Column:
    return (F.col(index) + 0.5) * F.lit(float(resolution))


def point_weight(squared_range: Column, s0: float = 0.02, sr: float = 0.005) -> Column:
    """1 / (s0² + (sr r)²): how much a return counts, falling with range."""
    return 1.0 / (F.lit(s0 * s0) + F.lit(sr * sr) * squared_range)


def wrap(angle: Column) -> Column:
    """An angle in [-π, π)."""
    return F.pmod(angle + F.lit(math.pi), F.lit(2 * math.pi)) - F.lit(math.pi)


def encode_heading(yaw: Column, bins: int = 12) -> tuple[Column, Column]:
    """(bin, residual in bins) of a heading."""
    w = 2 * math.pi / bins
    b = (F.floor(F.pmod(yaw + F.lit(w / 2), F.lit(2 * math.pi)) / F.lit(w)) % bins).cast("int")
    return b, wrap(yaw - b * F.lit(w)) / F.lit(w)


def decode_heading(bin_: Column, residual: Column, bins: int = 12) -> Column:
    w = 2 * math.pi / bins
    return (bin_ + residual) * F.lit(w)


def transform(points: DataFrame, poses: DataFrame) -> DataFrame:
    """World coordinates wx, wy, wz = R p + t, with one pose a frame.

    Poses are one row a frame; the join key is the frame, and the planner broadcasts them if small.
    """
    out = points.join(poses, "frame")
    for k, name in enumerate(("wx", "wy", "wz")):
        out = out.withColumn(name, F.col(f"r{k}0") * F.col("x") + F.col(f"r{k}1") * F.col("y") + F.col(f"r{k}2") * F.col("z") + F.col(("tx", "ty", "tz")[k]))
    return out.drop(*[f"r{i}{j}" for i in range(3) for j in range(3)], "tx", "ty", "tz")


def inverse_transform(points: DataFrame, poses: DataFrame, x: str = "wx", y: str = "wy", z: str = "wz") -> DataFrame:
    """Sensor coordinates sx, sy, sz = Rᵀ (p - t) of world points."""
    out = points.join(poses, "frame")
    d = [F.col(c) - F.col(t) for c, t in ((x, "tx"), (y, "ty"), (z, "tz"))]
    for k, name in enumerate(("sx", "sy", "sz")):
        out = out.withColumn(name, sum((F.col(f"r{i}{k}") * d[i] for i in range(1, 3)), F.col(f"r0{k}") * d[0]))
    return out.drop(*[f"r{i}{j}" for i in range(3) for j in range(3)], "tx", "ty", "tz")


def mirrored_rotation(roll: Column, pitch: Column, yaw: Column) -> list[list[Column]]:
    """Rotation of a left-handed simulator's Euler angles (degrees), as seen with y flipped."""
    cr, sr, cp, sp, cy, sy = (f(F.radians(a)) for a in (roll, pitch, yaw) for f in (F.cos, F.sin))
    left = [
        [cp * cy, cy * sp * sr - sy * cr, -cy * sp * cr - sy * sr],
        [cp * sy, sy * sp * sr + cy * cr, -sy * sp * cr + cy * sr],
        [sp, -cp * sr, cp * cr],
    ]
    return [[c if (i == 1) == (j == 1) else -c for j, c in enumerate(row)] for i, row in enumerate(left)]


def project(x: Column, y: Column, z: Column, camera: list[list[float]], extrinsic: list[list[float]]) -> tuple[Column, Column, Column]:
    """(u, v, depth) in the image: camera · extrinsic · p, with tiny depths replaced."""
    cam = [F.lit(r[0]) * x + F.lit(r[1]) * y + F.lit(r[2]) * z + F.lit(r[3]) for r in extrinsic]
    u, v, d = (F.lit(r[0]) * cam[0] + F.lit(r[1]) * cam[1] + F.lit(r[2]) * cam[2] + F.lit(r[3]) for r in camera)
    safe = F.when(F.abs(d) < 1e-6, F.lit(1e-6)).otherwise(d)
    return u / safe, v / safe, d


def to_lidar(x: Column, y: Column, z: Column, rectify: list[list[float]], extrinsic: list[list[float]]) -> list[Column]:
    """A rectified camera's coordinates in the sensor's frame: Rᵀ (R0⁻¹ p - t), with [R | t] the extrinsic."""
    back = np.linalg.inv(np.array(rectify, float))
    raw = [F.lit(float(r[0])) * x + F.lit(float(r[1])) * y + F.lit(float(r[2])) * z for r in back]
    d = [v - F.lit(float(row[3])) for v, row in zip(raw, extrinsic)]
    return [sum((F.lit(float(extrinsic[k][i])) * d[k] for k in range(1, 3)), F.lit(float(extrinsic[0][i])) * d[0]) for i in range(3)]


def label_box(rectify: list[list[float]], extrinsic: list[list[float]]) -> dict[str, Column]:
    """A labelled object (cx, cy, cz: bottom centre in the camera's frame, y down; h, w, l; ry) as a box of the sensor's frame."""
    x, y, z = to_lidar(F.col("cx"), F.col("cy") - F.col("h") / 2, F.col("cz"), rectify, extrinsic)
    return {"cx": x, "cy": y, "cz": z, "l": F.col("l"), "w": F.col("w"), "h": F.col("h"), "yaw": wrap(-F.col("ry") - F.lit(math.pi / 2))}


def in_box(x: Column, y: Column, z: Column, box: dict[str, Column], margin: float = 0.0) -> Column:
    """Whether a point is in an oriented box grown by ``margin``."""
    dx, dy, c, s = x - box["cx"], y - box["cy"], F.cos(box["yaw"]), F.sin(box["yaw"])
    u, v = c * dx + s * dy, c * dy - s * dx
    m = F.lit(float(margin))
    return (F.abs(u) <= box["l"] / 2 + m) & (F.abs(v) <= box["w"] / 2 + m) & (F.abs(z - box["cz"]) <= box["h"] / 2 + m)


def corners(box: dict[str, Column]) -> Column:
    """The eight corners of a box as an array of structs."""
    out = []
    for sx, sy, sz in ((1, 1, -1), (1, -1, -1), (-1, -1, -1), (-1, 1, -1), (1, 1, 1), (1, -1, 1), (-1, -1, 1), (-1, 1, 1)):
        u, v, c, s = box["l"] * (sx / 2), box["w"] * (sy / 2), F.cos(box["yaw"]), F.sin(box["yaw"])
        out.append(F.struct((box["cx"] + c * u - s * v).alias("x"), (box["cy"] + s * u + c * v).alias("y"), (box["cz"] + box["h"] * (sz / 2)).alias("z")))
    return F.array(*out)


def eigenvalues3(a: dict[str, Column]) -> tuple[Column, Column, Column]:
    """Eigenvalues of a symmetric 3×3 matrix, largest first, by the trigonometric formula."""
    q = (a["xx"] + a["yy"] + a["zz"]) / 3
    off = a["xy"] ** 2 + a["xz"] ** 2 + a["yz"] ** 2
    p = F.sqrt(((a["xx"] - q) ** 2 + (a["yy"] - q) ** 2 + (a["zz"] - q) ** 2 + 2 * off) / 6)
    b = {k: F.try_divide(v - q if k[0] == k[1] else v, p) for k, v in a.items()}
    det = b["xx"] * (b["yy"] * b["zz"] - b["yz"] ** 2) - b["xy"] * (b["xy"] * b["zz"] - b["yz"] * b["xz"]) + b["xz"] * (b["xy"] * b["yz"] - b["yy"] * b["xz"])
    phi = F.acos(F.greatest(F.least(det / 2, F.lit(1.0)), F.lit(-1.0))) / 3
    first, last = q + 2 * p * F.cos(phi), q + 2 * p * F.cos(phi + 2 * math.pi / 3)
    return F.coalesce(first, q), F.coalesce(3 * q - first - last, q), F.coalesce(last, q)


def suggested(n_points: Column, full: int = 121_000) -> dict[str, Column]:
    """Clustering parameters scaled to a scan's density."""
    ratio = n_points / F.lit(float(full))
    return {
        "min_points": F.greatest(F.lit(6), F.rint(20 * ratio).cast("int")),
        "n_sample": F.greatest(F.lit(64), F.pow(F.lit(2.0), F.rint(F.log2(F.greatest(256 * ratio, F.lit(64.0))))).cast("int")),
        "voxel": F.greatest(F.lit(0.30), F.least(F.lit(0.80), F.lit(0.30) / F.sqrt(F.greatest(ratio, F.lit(0.05))))),
    }
