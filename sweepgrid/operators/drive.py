"""Drivability of map cells and of polar sectors, and score tracking."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RADIAL, AZIMUTH, MAX_RANGE = 24, 72, 70.0
DRIVABLE, MARGINAL, NON_DRIVABLE, UNKNOWN = 0, 1, 2, 3


def neighbour_step(height: Column, keys: tuple[str, ...] = (), ix: str = "ix", iy: str = "iy") -> Column:
    """Largest height difference to the four edge neighbours that have one; 0 without any.

    RANGE frames of exactly one index away replace a self-join; null heights are skipped.
    """
    own = F.coalesce(height, F.lit(0.0))
    steps = []
    for fixed, moving in ((ix, iy), (iy, ix)):
        w = Window.partitionBy(*keys, fixed).orderBy(moving)
        steps += [F.abs(F.max(height).over(w.rangeBetween(d, d)) - own) for d in (-1, 1)]
    return F.coalesce(F.greatest(*steps), F.lit(0.0))


def cell_drivability(cells: DataFrame, res: float = 0.4, keys: tuple[str, ...] = (), sensor: tuple[float, float] = (0.0, 0.0), min_points: int = 5, sigma: float = 0.0, weighted: bool = False, max_rough: float = 0.040, max_step: float = 0.10, step_per_r2: float = 8e-5, max_slope_deg: float = 15.0) -> DataFrame:
    """Adds h, step, slope, rough, score, cls to cells (keys, ix, iy); score is the worst share of a limit."""
    n, s1, s2 = ("gw", "gwz", "gwz2") if weighted else ("ng", "gsum", "gsq")
    ok = F.col("ng") >= min_points
    mean = F.try_divide(F.col(s1), F.col(n))
    out = cells.withColumn("h", F.when(ok, mean)).withColumn("__var", F.when(ok, F.try_divide(F.col(s2), F.col(n)) - mean * mean))
    out = out.withColumn("step", F.when(ok, neighbour_step(F.col("h"), keys)))
    x, y = (F.col("ix") + 0.5) * F.lit(res) - sensor[0], (F.col("iy") + 0.5) * F.lit(res) - sensor[1]
    rough = F.sqrt(F.greatest(F.col("__var") - F.col("step") * F.col("step") / 12 - sigma * sigma, F.lit(0.0)))
    out = out.withColumn("slope", F.degrees(F.atan(F.col("step") / res))).withColumn("rough", rough)
    score = F.greatest(F.col("rough") / max_rough, F.col("step") / (max_step + step_per_r2 * (x * x + y * y)), F.col("slope") / max_slope_deg)
    out = out.withColumn("score", F.when(ok, score))
    return out.withColumn("cls", banded(F.col("score"))).drop("__var")


def banded(score: Column, marginal: float = 1.0, non_drivable: float = 2.0) -> Column:
    return F.when(score.isNull(), UNKNOWN).when(score <= marginal, DRIVABLE).when(score <= non_drivable, MARGINAL).otherwise(NON_DRIVABLE)


def class_mix(cells: DataFrame, bands: tuple[tuple[float, float], ...] = ((0, 10), (10, 20), (20, 30), (30, 50))) -> DataFrame:
    """Counts of each class by band of range (column r)."""
    band = F.lit(None).cast("string")
    for a, b in bands:
        band = F.when((F.col("r") >= a) & (F.col("r") < b), f"{a}-{b}").otherwise(band)
    names = ("drivable", "marginal", "non_drivable", "unknown")
    return cells.withColumn("band", band).where("band IS NOT NULL").groupBy("band").agg(*[F.count_if(F.col("cls") == k).alias(c) for k, c in enumerate(names)], F.count(F.lit(1)).alias("cells"))


def sector(x: str = "x", y: str = "y") -> tuple[Column, Column]:
    """(ring, azimuth) of a point: 24 rings by the square root of range, 72 azimuths; null beyond 70 m."""
    r = F.sqrt(F.col(x) * F.col(x) + F.col(y) * F.col(y))
    near = r <= MAX_RANGE
    ring = F.floor(F.least(F.sqrt(r / MAX_RANGE), F.lit(0.999)) * RADIAL)
    azimuth = F.least(F.greatest(F.floor((F.atan2(F.col(y), F.col(x)) + F.pi()) / (2 * F.pi()) * AZIMUTH), F.lit(0)), F.lit(AZIMUTH - 1))
    return F.when(near, ring), F.when(near, azimuth)


def remove_ground(points: DataFrame, planes: DataFrame, keys: tuple[str, ...] = (), sensor_h: float = 1.73, threshold: float = 0.25) -> DataFrame:
    """Adds ri, ai, ground_z, agl and ground by planes that are given (``sectors.ground_points`` fits its own); without a
    plane the ground is at -sensor_h and none of it."""
    ri, ai = sector()
    out = points.withColumns({"ri": ri, "ai": ai}).join(planes, [*keys, "ri", "ai"], "left")
    plane = F.col("a") * F.col("x") + F.col("b") * F.col("y") + F.col("c")
    out = out.withColumn("ground_z", F.coalesce(plane, F.lit(-sensor_h)))
    return out.withColumn("agl", F.col("z") - F.col("ground_z")).withColumn("ground", F.coalesce(F.col("z") - plane < threshold, F.lit(False)))


def polar_score(sectors: DataFrame, min_points: int = 20, max_rough: float = 0.020, max_step: float = 0.10, step_per_r2: float = 8e-5, max_slope_deg: float = 15.0) -> DataFrame:
    """Adds range, slope_deg, valid, score (null if not valid) and votes, the class by the number of broken limits."""
    r = F.pow((F.col("ri") + 0.5) / RADIAL, F.lit(2.0)) * MAX_RANGE
    out = sectors.withColumns({"range": r, "slope_deg": F.degrees(F.atan("slope")), "valid": F.col("n") >= min_points})
    limit = max_step + step_per_r2 * F.col("range") * F.col("range")
    score = F.greatest(F.col("rough") / max_rough, F.col("step") / limit, F.col("slope_deg") / max_slope_deg)
    broken = (F.col("slope_deg") > max_slope_deg).cast("int") + (F.col("step") > limit).cast("int") + (F.col("rough") > max_rough).cast("int")
    return out.withColumn("score", F.when(F.col("valid"), score)).withColumn("votes", F.when(~F.col("valid"), UNKNOWN).otherwise(F.least(broken, F.lit(2))))


def kerb() -> Column:
    return F.col("valid") & F.col("step").between(0.06, 0.30) & (F.col("rough") < 0.12) & (F.col("slope_deg") < 20.0)


def point_class(ground: str = "ground", cls: str = "cls") -> Column:
    """Class of a point's sector for ground points, else unknown."""
    return F.when(F.col(ground), F.coalesce(F.col(cls), F.lit(UNKNOWN))).otherwise(UNKNOWN)


def tracked(scores: DataFrame, keys: list[str], order: str, value: str, alpha: float = 0.4, band: float = 0.15) -> DataFrame:
    """(keys, order, ema, cls): exponential mean that carries over gaps, and classes that hold near their limits.

    The mean is sequential by nature and folded over each key's ordered values. A class changes only
    where the mean is ``band`` or more from both limits; nearer, the one before holds.
    """
    rows = scores.select(*keys, order, F.col(value).cast("double").alias("ema"))

    def fold(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values([order, "ema"], kind="stable")
        return t.assign(ema=t["ema"].ewm(alpha=alpha, adjust=False, ignore_na=True).mean())

    # a null score carries the mean, so it never comes back; NaN stands for it within pandas
    out = rows.groupBy(*keys).applyInPandas(fold, rows.schema).withColumn("ema", F.nanvl("ema", F.lit(None).cast("double")))
    w = Window.partitionBy(*keys).orderBy(order)
    near = (F.abs(F.col("ema") - 1.0) < band) | (F.abs(F.col("ema") - 2.0) < band)
    moves = F.when((F.row_number().over(w) == 1) | ~F.coalesce(near, F.lit(False)), banded(F.col("ema")))
    out = out.withColumn("__moves", moves)
    return out.select(*keys, order, "ema", F.last("__moves", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("cls"))
