"""Canonical frames of clusters: centre, rotation, scale; how they disagree; boxes in and out of them.

A frame is a row (keys, n, r00 … r22, tx, ty, tz, scale, degenerate, skew_ambiguous): a point p of the
cluster is R (p - t) / scale in it. Moments are aggregated by Spark with partial aggregation; only the
3×3 eigenproblems, one per cluster, are solved in Arrow batches.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sweepgrid.functions.geometry import encode_heading, wrap

#: Shares of neighbouring eigenvalues above which axes are arbitrary, and skewness below which signs are.
DEGENERATE, NO_SKEW = 0.85, 1e-3
MODES = ("none", "pca3_skew", "pca2_yaw")
ROTATION = tuple(f"r{i}{j}" for i in range(3) for j in range(3))
_PAIRS = ("xx", "xy", "xz", "yy", "yz", "zz")


def centred(points: DataFrame, keys: list[str]) -> DataFrame:
    """Points with n, tx, ty, tz of their cluster and dx, dy, dz from its centre."""
    mean = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"t{c}") for c in "xyz"])
    return points.select(*keys, *"xyz").join(mean, keys).withColumns({f"d{c}": F.col(c) - F.col(f"t{c}") for c in "xyz"})


def covariance(d: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, t, xx … zz, scale): covariances by n - 1, and the largest distance from the centre."""
    free = F.greatest(F.first("n") - 1, F.lit(1))
    norm = F.max(F.sqrt(sum((F.col(f"d{c}") * F.col(f"d{c}") for c in "xyz"), F.lit(0.0))))
    out = d.groupBy(*keys).agg(F.first("n").alias("n"), *[F.first(f"t{c}").alias(f"t{c}") for c in "xyz"], *[(F.sum(F.col(f"d{a}") * F.col(f"d{b}")) / free).alias(a + b) for a, b in _PAIRS], norm.alias("__far"))
    return out.withColumn("scale", F.when(F.col("__far") > 1e-6, F.col("__far")).otherwise(1.0)).drop("__far")


_AXES = T.StructType([T.StructField(c, T.ArrayType(T.DoubleType())) for c in "lv"])


@F.pandas_udf(_AXES)
def _eigen(xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.DataFrame:
    """Eigenvalues, largest first, and the eigenvectors one after the other."""
    m = np.stack([xx, xy, xz, xy, yy, yz, xz, yz, zz], 1).reshape(-1, 3, 3)
    values, vectors = np.linalg.eigh(m)
    return pd.DataFrame({"l": list(values[:, ::-1]), "v": list(vectors[:, :, ::-1].transpose(0, 2, 1).reshape(-1, 9))})


def eigenframes(cov: DataFrame) -> DataFrame:
    """Adds l (three eigenvalues) and v (nine numbers: the axes) to covariances."""
    return cov.withColumn("__e", _eigen(*_PAIRS)).select("*", "__e.l", "__e.v").drop("__e", *_PAIRS)


def frames(points: DataFrame, keys: list[str], mode: str = "pca2_yaw") -> DataFrame:
    """The canonical frame of every cluster.

    ``none`` only centres and scales; ``pca3_skew`` takes the principal axes, each pointing to positive
    skewness, the last one turned to keep the frame right-handed; ``pca2_yaw`` turns about the vertical by
    the main direction in plan. Flags tell of axes or signs that are arbitrary.
    """
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} is none of {MODES}")
    d = centred(points, keys)
    cov = covariance(d, keys)
    if mode == "none":
        turn = {r: F.lit(float(r[1] == r[2])) for r in ROTATION}
        return cov.select(*keys, "n", *[e.alias(r) for r, e in turn.items()], "tx", "ty", "tz", "scale", F.lit(False).alias("degenerate"), F.lit(False).alias("skew_ambiguous"))
    if mode == "pca2_yaw":
        # without heights the third axis is the vertical
        flat = cov.withColumns({c: F.lit(0.0) for c in ("xz", "yz", "zz")})
        e = eigenframes(flat)
        axes = 1
    else:
        e, axes = eigenframes(cov), 3
    along = [sum((F.col("v")[3 * k + i] * F.col(f"d{c}") for i, c in enumerate("xyz")), F.lit(0.0)) for k in range(axes)]
    moments = [f(p, k) for k, p in enumerate(along) for f in (lambda p, k: F.avg(p * p).alias(f"m2{k}"), lambda p, k: F.avg(p * p * p).alias(f"m3{k}"))]
    skew = d.join(e.select(*keys, "v"), keys).groupBy(*keys).agg(*moments)
    out = e.join(skew, keys)
    deviation = [F.sqrt(F.col(f"m2{k}")) for k in range(axes)]
    skewness = [F.when(s > 1e-9, F.col(f"m3{k}") / (s * s * s + 1e-12)).otherwise(0.0) for k, s in enumerate(deviation)]
    unsure = F.lit(False)
    for s in skewness:
        unsure = unsure | (F.abs(s) < NO_SKEW)
    signs = [F.when(s < 0, -1.0).otherwise(1.0) for s in skewness]
    lam = [F.greatest(F.col("l")[k], F.lit(1e-12)) for k in range(3)]
    if axes == 1:
        bad = lam[1] / lam[0] > DEGENERATE
        yaw = F.atan2(signs[0] * F.col("v")[1], signs[0] * F.col("v")[0])
        turned = out.withColumn("__yaw", yaw)
        c, s, zero, one = F.cos("__yaw"), F.sin("__yaw"), F.lit(0.0), F.lit(1.0)
        turn = dict(zip(ROTATION, (c, s, zero, -s, c, zero, zero, zero, one)))
    else:
        bad = (lam[1] / lam[0] > DEGENERATE) | (lam[2] / lam[1] > DEGENERATE)
        v = [[signs[k] * F.col("v")[3 * k + i] for i in range(3)] for k in range(3)]
        turned = out.withColumns({f"__v{k}{i}": v[k][i] for k in range(3) for i in range(3)})
        w = [[F.col(f"__v{k}{i}") for i in range(3)] for k in range(3)]
        det = sum((w[0][i] * (w[1][(i + 1) % 3] * w[2][(i + 2) % 3] - w[1][(i + 2) % 3] * w[2][(i + 1) % 3]) for i in range(3)), F.lit(0.0))
        turned = turned.withColumn("__hand", F.when(det < 0, -1.0).otherwise(1.0))
        turn = {f"r{k}{i}": w[k][i] * F.col("__hand") if k == 2 else w[k][i] for k in range(3) for i in range(3)}
    return turned.select(*keys, "n", *[e.alias(r) for r, e in turn.items()], "tx", "ty", "tz", "scale", bad.alias("degenerate"), unsure.alias("skew_ambiguous"))


def into(points: DataFrame, frames_: DataFrame, keys: list[str]) -> DataFrame:
    """Adds cx, cy, cz: the points in their cluster's frame."""
    p = points.join(frames_.select(*keys, *ROTATION, "tx", "ty", "tz", "scale"), keys)
    d = [F.col(c) - F.col(f"t{c}") for c in "xyz"]
    out = {f"c{c}": sum((F.col(f"r{k}{i}") * d[i] for i in range(3)), F.lit(0.0)) / F.col("scale") for k, c in enumerate("xyz")}
    return p.withColumns(out).drop(*ROTATION, "tx", "ty", "tz", "scale")


def back(points: DataFrame, frames_: DataFrame, keys: list[str], names: tuple[str, str, str] = ("cx", "cy", "cz")) -> DataFrame:
    """Adds x, y, z of points that are given in their cluster's frame."""
    p = points.join(frames_.select(*keys, *ROTATION, "tx", "ty", "tz", "scale"), keys)
    c = [F.col(n) * F.col("scale") for n in names]
    out = {a: sum((F.col(f"r{k}{i}") * c[k] for k in range(3)), F.lit(0.0)) + F.col(f"t{a}") for i, a in enumerate("xyz")}
    return p.withColumns(out).drop(*ROTATION, "tx", "ty", "tz", "scale")


def frame_yaw(prefix: str = "") -> Column:
    """The heading that a frame adds to those given in the world."""
    return F.atan2(F.col(f"{prefix}r10"), F.col(f"{prefix}r00"))


def features(points: DataFrame, frames_: DataFrame, keys: list[str], max_range: float = 50.0) -> DataFrame:
    """Adds the six inputs of a network to points (x, y, z, agl, intensity): fx, fy, fz, fagl, frange, fint."""
    far = F.sqrt(sum((F.col(c) * F.col(c) for c in "xyz"), F.lit(0.0)))
    out = into(points, frames_, keys).withColumnsRenamed({f"c{c}": f"f{c}" for c in "xyz"})
    return out.withColumns({"fagl": F.col("agl") / 3, "frange": far / max_range, "fint": F.col("intensity")})


def degeneracy(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, l1, l2, l3, second, third): eigenvalues, and each as a share of the one before; near 1 axes are arbitrary."""
    e = eigenframes(covariance(centred(points, keys), keys)).select(*keys, *[F.greatest(F.col("l")[k], F.lit(1e-12)).alias(f"l{k + 1}") for k in range(3)])
    return e.withColumns({"second": F.col("l2") / F.col("l1"), "third": F.col("l3") / F.col("l2")})


def disagreement(a: str = "a_", b: str = "b_") -> Column:
    """Angle in degrees between two rotations, in columns with these prefixes."""
    trace = sum((F.col(a + r) * F.col(b + r) for r in ROTATION), F.lit(0.0))
    return F.degrees(F.acos(F.greatest(F.least((trace - 1) / 2, F.lit(1.0)), F.lit(-1.0))))


def yaw_disagreement(a: str = "a_", b: str = "b_") -> Column:
    """Difference of two frames' headings in degrees, from 0 to 180."""
    d = F.pmod(F.degrees(frame_yaw(a) - frame_yaw(b)), F.lit(360.0))
    return F.least(d, 360.0 - d)


def paired(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Two frames of each cluster side by side, with prefixes a_ and b_."""
    side = lambda f, p: f.select(*keys, *[F.col(c).alias(p + c) for c in (*ROTATION, "degenerate", "skew_ambiguous")])
    return side(a, "a_").join(side(b, "b_"), keys)


def unit(seed: int, name: str, *by: str) -> Column:
    """A number in (0, 1) that follows from the seed, a name and some columns: the same in every run and retry."""
    return (F.pmod(F.xxhash64(F.lit(seed), F.lit(name), *by), F.lit(1 << 30)) + 0.5) / (1 << 30)


def turned(points: DataFrame, angle: Column) -> DataFrame:
    """Points turned about the vertical through the sensor."""
    c, s = F.cos(angle), F.sin(angle)
    return points.withColumns({"x": c * F.col("x") - s * F.col("y"), "y": s * F.col("x") + c * F.col("y")})


def equivariance(points: DataFrame, keys: list[str], mode: str, trials: int = 4, seed: int = 0) -> DataFrame:
    """(keys, trial, angle, error, degenerate): by how many degrees the frame of a turned cluster misses the turned frame.

    The cluster is repeated for each trial, a parameter, and turned by an angle of its own.
    """
    plain = frames(points, keys, mode)
    t = points.select(*keys, *"xyz").withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    angle = (2 * unit(seed, "trial", "trial", *keys) - 1) * math.pi
    moved = frames(turned(t, angle), [*keys, "trial"], mode)
    both = paired(moved.drop("n"), plain.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1)))), [*keys, "trial"]).withColumn("angle", angle)
    # the turned cluster's frame should be R Q', so R' Q is held against R
    c, s = F.cos("angle"), F.sin("angle")
    undone = {f"a_r{k}0": F.col(f"a_r{k}0") * c + F.col(f"a_r{k}1") * s for k in range(3)} | {f"a_r{k}1": F.col(f"a_r{k}1") * c - F.col(f"a_r{k}0") * s for k in range(3)}
    return both.withColumns(undone).select(*keys, "trial", "angle", disagreement().alias("error"), (F.col("a_degenerate") | F.col("b_degenerate")).alias("degenerate"))


def viewpoints(points: DataFrame, keys: list[str], mode: str, ids: list[str], views: tuple[tuple[float, float, float], ...], share: float = 0.5) -> DataFrame:
    """(keys, error, yaw_error, degenerate): how far apart the frames are of what two viewpoints see of a cluster."""
    from sweepgrid.operators.cluster import rank_nearest

    seen = []
    for v in views[:2]:
        d = sum(((F.col(c) - v[i]) * (F.col(c) - v[i]) for i, c in enumerate("xyz")), F.lit(0.0))
        seen.append(frames(rank_nearest(points, keys, d, ids, share), keys, mode))
    return paired(*seen, keys).select(*keys, disagreement().alias("error"), yaw_disagreement().alias("yaw_error"), (F.col("a_degenerate") | F.col("b_degenerate")).alias("degenerate"))


def augmented(points: DataFrame, boxes: DataFrame, keys: list[str], ids: list[str], seed: int = 0, yaw: bool = True, flip: bool = True, drop: float = 0.5, scale: float = 0.08, jitter: float = 0.02, slots: int = 256) -> tuple[DataFrame, DataFrame]:
    """Points (keys, slot, x, y, z, further columns) and boxes (keys, cls, cx … yaw) changed alike.

    In this order: a turn about the sensor, a mirror, point dropout refilled from what is left, a
    scale about the cluster's centre, and jitter. All follow from hashes of the seed and the keys.
    """
    from pyspark.sql import Window

    half = lambda name: 2 * unit(seed, name, *keys) - 1
    angle = half("yaw") * math.pi if yaw else F.lit(0.0)
    side = F.when(unit(seed, "flip", *keys) < 0.5, -1.0).otherwise(1.0) if flip else F.lit(1.0)
    grown = 1 + half("scale") * scale
    p = turned(points, angle).withColumn("y", F.col("y") * side)
    if drop > 0:
        w = Window.partitionBy(*keys)
        order = F.row_number().over(w.orderBy(F.xxhash64(F.lit(seed), *ids), *ids)) - 1
        p = p.withColumn("__r", order).withColumn("__n", F.count(F.lit(1)).over(w))
        kept = F.greatest(F.floor(F.col("__n") * (1 - drop * unit(seed, "drop", *keys))), F.lit(8))
        p = p.withColumn("__k", F.least(kept, F.col("__n")).cast("int")).where("__r < __k")
        p = p.withColumn("slot", F.explode(F.expr(f"sequence(__r, greatest({slots - 1}, __r), __k)"))).where(F.col("slot") < slots).drop("__r", "__n", "__k")
    centre = p.groupBy(*keys).agg(*[F.avg(c).alias(f"__m{c}") for c in "xyz"])
    p = p.join(centre, keys)
    # the sum of twelve uniform numbers less six is near normal
    by = [*ids, "slot"] if drop > 0 else ids
    noise = lambda c: jitter * (sum((unit(seed, f"{c}{k}", *by) for k in range(12)), F.lit(0.0)) - 6)
    p = p.withColumns({c: F.col(f"__m{c}") + (F.col(c) - F.col(f"__m{c}")) * grown + noise(c) for c in "xyz"}).drop("__mx", "__my", "__mz")
    c, s = F.cos(angle), F.sin(angle)
    b = boxes.withColumns({"cx": c * F.col("cx") - s * F.col("cy"), "cy": (s * F.col("cx") + c * F.col("cy")) * side, "yaw": (F.col("yaw") + angle) * side})
    b = b.join(centre, keys).withColumns({f"c{a}": F.col(f"__m{a}") + (F.col(f"c{a}") - F.col(f"__m{a}")) * grown for a in "xyz"} | {d: F.col(d) * grown for d in "lwh"})
    return p, b.drop("__mx", "__my", "__mz")


def targets(boxes: DataFrame, frames_: DataFrame, anchors: DataFrame, keys: list[str]) -> DataFrame:
    """Boxes (keys, cls, cx … yaw) as a network's targets in the cluster's frame: ox, oy, oz, sl, sw, sh, head_bin, head_res."""
    b = boxes.join(frames_.select(*keys, *ROTATION, "tx", "ty", "tz", "scale"), keys).join(_anchored(anchors), F.col("cls") == F.col("a_cls"), "left")
    d = [F.col(f"c{c}") - F.col(f"t{c}") for c in "xyz"]
    offset = {f"o{c}": sum((F.col(f"r{k}{i}") * d[i] for i in range(3)), F.lit(0.0)) / F.col("scale") for k, c in enumerate("xyz")}
    size = {f"s{c}": F.log(F.greatest(F.col(c), F.lit(1e-3)) / F.greatest(_known(f"a_{c}"), F.lit(1e-3))) for c in "lwh"}
    bin_, residual = encode_heading(F.col("yaw") + frame_yaw())
    return b.withColumns(offset | size | {"head_bin": bin_, "head_res": residual}).select(*keys, "cls", *offset, *size, "head_bin", "head_res")


def _anchored(anchors: DataFrame) -> DataFrame:
    """Anchor sizes (cls, l, w, h): few rows, one a class."""
    return anchors.select(*[F.col(c).alias(f"a_{c}") for c in ("cls", "l", "w", "h")])


def _known(anchor: str) -> Column:
    return F.when(F.col(anchor).isNull(), F.raise_error(F.concat(F.lit("no anchor for class "), F.col("cls").cast("string")))).otherwise(F.col(anchor))


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits."""
    powers = F.transform(logits, lambda v: F.exp(v - F.array_max(logits)))
    return F.transform(powers, lambda v: v / F.aggregate(powers, F.lit(0.0), lambda a, x: a + x))


def decoded(predictions: DataFrame, frames_: DataFrame, anchors: DataFrame, keys: list[str], least: float = 0.5) -> DataFrame:
    """Boxes (keys, cls, score, cx, cy, cz, l, w, h, yaw) of a network's outputs.

    Outputs are logits (an array; class 0 is background), ox, oy, oz, sl, sw, sh and heading, all in the
    cluster's frame. The class is the first of the most likely ones; the score is what is not background.
    """
    p = predictions.withColumn("__p", softmax(F.col("logits")))
    p = p.withColumns({"cls": (F.array_position("__p", F.array_max("__p")) - 1).cast("int"), "score": 1 - F.col("__p")[0]}).where(f"cls > 0 AND score >= {least}")
    p = p.join(frames_.select(*keys, *ROTATION, "tx", "ty", "tz", "scale"), keys).join(_anchored(anchors), F.col("cls") == F.col("a_cls"), "left")
    o = [F.col(f"o{c}") * F.col("scale") for c in "xyz"]
    centre = {f"c{c}": sum((F.col(f"r{k}{i}") * o[k] for k in range(3)), F.lit(0.0)) + F.col(f"t{c}") for i, c in enumerate("xyz")}
    size = {c: F.exp(f"s{c}") * _known(f"a_{c}") for c in "lwh"}
    return p.withColumns(centre | size | {"yaw": wrap(F.col("heading") - frame_yaw())}).select(*keys, "cls", "score", *centre, *size, "yaw")
