"""World-anchored accumulation of sweeps: gates, weights, drift, shifts, merging, tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sweepgrid.functions.geometry import is_ground, point_weight
from sweepgrid.operators.grid import quantise, shifted

TRUST, PRUNE, MAX_DRIFT, OBS_CAP = 20.0, 90.0, 0.50, 40
#: (resolution, half extent) of each tier in metres.
TIERS = ((0.05, 12.0), (0.10, 25.0), (0.20, 50.0), (0.40, 100.0))


def trusted(points: DataFrame, trust: float = TRUST, moving: Column | None = None) -> DataFrame:
    """Points near enough to be believed, without those of moving things."""
    out = points.where(F.col("x") * F.col("x") + F.col("y") * F.col("y") <= trust * trust)
    return out if moving is None else out.where(~moving)


def weight(range_dims: int = 2) -> Column:
    r2 = F.col("x") * F.col("x") + F.col("y") * F.col("y")
    return point_weight(r2 if range_dims == 2 else r2 + F.col("z") * F.col("z"))


def shift_z(cells: DataFrame, dz: Column | float) -> DataFrame:
    """Cells as if every point had been higher by ``dz``."""
    return shifted(cells, F.lit(dz) if isinstance(dz, float) else dz)


def drift(world: DataFrame, sweep: DataFrame, keys: tuple[str, ...] = (), least: int = 3, common: int = 40, weighted: bool = False) -> DataFrame:
    """(keys, dz, common): median height difference map minus sweep over shared ground cells; 0 if there are few or it is large."""
    n, s = ("gw", "gwz") if weighted else ("ng", "gsum")
    side = lambda d, name: d.where(F.col("ng") >= least).select(*keys, "ix", "iy", (F.col(s) / F.col(n)).alias(name))
    both = side(world, "__a").join(side(sweep, "__b"), [*keys, "ix", "iy"])
    out = both.groupBy(*keys).agg(F.median(F.col("__a") - F.col("__b")).alias("dz"), F.count(F.lit(1)).alias("common"))
    return out.withColumn("dz", F.when((F.col("common") >= common) & (F.abs("dz") <= MAX_DRIFT), F.col("dz")).otherwise(0.0))


def point_drift(world: DataFrame, points: DataFrame, keys: tuple[str, ...] = (), least: int = 3, common: int = 100) -> DataFrame:
    """As ``drift``, by ground points (keys, ix, iy, z) instead of cells: the median of map height minus point."""
    side = world.where(F.col("ng") >= least).select("ix", "iy", (F.col("gsum") / F.col("ng")).alias("__have"))
    out = points.join(side, ["ix", "iy"]).groupBy(*keys).agg(F.median(F.col("__have") - F.col("z")).alias("dz"), F.count(F.lit(1)).alias("common"))
    return out.withColumn("dz", F.when((F.col("common") >= common) & (F.abs("dz") <= MAX_DRIFT), F.col("dz")).otherwise(0.0))


def within(x: float, y: float, res: float, reach: float = PRUNE) -> Column:
    """Whether a cell's centre is within ``reach`` of the sensor."""
    dx, dy = (F.col("ix") + 0.5) * res - x, (F.col("iy") + 0.5) * res - y
    return dx * dx + dy * dy <= reach * reach


def prune(cells: DataFrame, x: float, y: float, res: float, reach: float = PRUNE) -> DataFrame:
    """Cells whose centre is within ``reach`` of the sensor."""
    return cells.where(within(x, y, res, reach))


def near(cells: DataFrame, x: float, y: float, res: float, radius: float) -> DataFrame:
    """Cells within a square window around the sensor; a radius of 0 or less is no filter."""
    if radius <= 0:
        return cells
    cx, cy, r = int(x // res), int(y // res), int(radius / res)
    return cells.where((F.abs(F.col("ix") - cx) <= r) & (F.abs(F.col("iy") - cy) <= r))


def accumulate(points: DataFrame, res: float, keys: tuple[str, ...] = (), range_dims: int = 2) -> DataFrame:
    """All sweeps of world points (wx, wy, wz) in one aggregation, when no drift is compensated."""
    p = points.withColumn("__w", weight(range_dims)).withColumns({"x": F.col("wx"), "y": F.col("wy"), "z": F.col("wz")})
    return quantise(p, res, keys, F.col("__w")).withColumn("n_capped", F.least("n", F.lit(OBS_CAP)))


def into_tiers(points: DataFrame, origin: tuple[float, float] = (0.0, 0.0), tiers: tuple = TIERS, keys: tuple[str, ...] = ()) -> DataFrame:
    """Every tier's cells in one aggregation: each point is dealt to the tiers whose extent holds it."""
    spec = F.array(*[F.struct(F.lit(k).alias("lvl"), F.lit(r).alias("res"), F.lit(round(2 * half / r)).cast("bigint").alias("side")) for k, (r, half) in enumerate(tiers)])
    p = points.withColumn("t", F.explode(spec)).select("*", F.col("t.lvl").alias("lvl"), F.col("t.res").alias("res"), F.col("t.side").alias("side"))
    local = lambda c, o: F.floor((F.col(c) - F.lit(o)) / F.col("res")) + F.expr("side div 2")
    p = p.withColumns({"tx_": local("x", origin[0]), "ty_": local("y", origin[1])}).where("tx_ >= 0 AND tx_ < side AND ty_ >= 0 AND ty_ < side")
    world = lambda c, o: F.col(c) - F.expr("side div 2") + F.rint(F.lit(o) / F.col("res")).cast("bigint")
    p = p.withColumns({"ix": world("tx_", origin[0]), "iy": world("ty_", origin[1])})
    g = is_ground()
    return p.groupBy(*keys, "lvl", "ix", "iy").agg(F.count(F.lit(1)).alias("n"), F.max("z").alias("zmax"), F.min(F.when(g, F.col("z"))).alias("gmin"), F.count_if(g).alias("ng"), F.sum(F.when(g, F.col("z")).otherwise(0.0)).alias("gsum"), F.sum(F.when(g, F.col("z") * F.col("z")).otherwise(0.0)).alias("gsq"))


def recentred(origin: float, position: float, res: float) -> float:
    """A tier's origin moved by whole cells, half-way cases to the even one."""
    return origin + round((position - origin) / res) * res


def in_extent(cells: DataFrame, origin: tuple[float, float], tiers: tuple = TIERS) -> DataFrame:
    """Tier cells that stay when the tiers move to a new origin; the strip that enters is empty."""
    keep = F.lit(False)
    for k, (res, half) in enumerate(tiers):
        side = round(2 * half / res)
        ox, oy = (round(o / res) for o in origin)
        inside = F.col("ix").between(ox - side // 2, ox - side // 2 + side - 1) & F.col("iy").between(oy - side // 2, oy - side // 2 + side - 1)
        keep = keep | ((F.col("lvl") == k) & inside)
    return cells.where(keep)


def map_stats(cells: DataFrame) -> DataFrame:
    return cells.agg(F.count(F.lit(1)).alias("cells"), F.median("n").alias("median_obs"), F.percentile("n", F.lit(0.9)).alias("p90_obs"), F.avg((F.col("n") == 1).cast("int")).alias("single_share"))


def map_sketches(cells: DataFrame, keys: list[str | Column], k: int = 200) -> DataFrame:
    """(keys, cells, singles, sketch) of cells: their number, those seen once, and a quantile sketch of their observations."""
    return cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col("n") == 1).alias("singles"), F.kll_sketch_agg_bigint("n", k).alias("sketch"))


def merged_stats(sketches: DataFrame) -> DataFrame:
    """As ``map_stats``, from sketches of parts of a map: quantiles within the sketches' rank error, the rest exact."""
    both = sketches.agg(F.sum("cells").alias("cells"), F.sum("singles").alias("singles"), F.kll_merge_agg_bigint("sketch").alias("sketch")).where("cells > 0")
    at = lambda q: F.kll_sketch_get_quantile_bigint("sketch", F.lit(q)).cast("double")
    return both.select("cells", at(0.5).alias("median_obs"), at(0.9).alias("p90_obs"), (F.col("singles") / F.col("cells")).alias("single_share"))
