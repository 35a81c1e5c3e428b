"""Variable-resolution elevation grids: mergeable cells, tiers, ground, visibility, classes.

Every accumulator of a cell is a sum, a minimum or a maximum, so one aggregation serves binning,
merging and coarsening, and Spark's partial aggregation combines before it shuffles. Absent evidence
is null, never infinity.
"""

from __future__ import annotations

from functools import reduce
from math import comb
from operator import mul
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sweepgrid.functions.geometry import cell, is_ground

RES0, CLASSES = 0.05, 8
BOUNDS = (10.0, 25.0, 50.0)
DRIVE_LEVEL = 3
HIST = [f"h{k}" for k in range(CLASSES)]
AZIMUTHS, RANGE_BINS, RANGE_STEP = 2048, 202, 0.5


class Kept(NamedTuple):
    """What a cell keeps of a family of its points: their sum of (weight times) height to a power, or an extreme height.

    Families are ``all``, ``ground``, ``other`` (not ground), ``weighted`` (ground, by weight) and a class by its number.
    """

    family: str | int
    rule: str
    power: int = 1


#: The accumulators of a cell; binning, merging and shifting all follow from these rows.
FIELDS = {
    "n": Kept("all", "sum", 0), "zmin": Kept("all", "min"), "zmax": Kept("all", "max"), "zomin": Kept("other", "min"), "zsum": Kept("all", "sum"), "zsq": Kept("all", "sum", 2),
    "ng": Kept("ground", "sum", 0), "gmin": Kept("ground", "min"), "gsum": Kept("ground", "sum"), "gsq": Kept("ground", "sum", 2),
    **{h: Kept(k, "sum", 0) for k, h in enumerate(HIST)},
    "gw": Kept("weighted", "sum", 0), "gwz": Kept("weighted", "sum"), "gwz2": Kept("weighted", "sum", 2),
}


def accumulators(weight: Column | None = None) -> list[Column]:
    z, out = F.col("z"), []
    for name, kept in FIELDS.items():
        if kept.family == "weighted" and weight is None:
            continue
        member = {"all": F.lit(True), "other": ~is_ground()}.get(kept.family, F.col("lab") == kept.family if isinstance(kept.family, int) else is_ground())
        if kept.rule != "sum":
            value = getattr(F, kept.rule)(F.when(member, z))
        elif kept.power == 0 and kept.family != "weighted":
            value = F.count_if(member)
        else:
            term = weight if kept.family == "weighted" else F.lit(1.0)
            for _ in range(kept.power):
                term = term * z
            value = F.sum(F.when(member, term).otherwise(F.lit(0.0)))
        out.append(value.alias(name))
    return out


def shifted(cells: DataFrame, dz: Column) -> DataFrame:
    """Cells as if every point had been higher by ``dz``: extremes move, and a sum of powers follows from the
    lower powers of its family by the binomial theorem."""
    has = {name: kept for name, kept in FIELDS.items() if name in cells.columns}
    sums = {(kept.family, kept.power): F.col(name) for name, kept in has.items() if kept.rule == "sum"}
    moved = {}
    for name, kept in has.items():
        if kept.rule != "sum":
            moved[name] = F.col(name) + dz
        elif kept.power:
            total = F.col(name)
            for j in range(kept.power - 1, -1, -1):
                total = total + sums[kept.family, j] * reduce(mul, [dz] * (kept.power - j)) * comb(kept.power, j)
            moved[name] = total
    return cells.withColumns(moved)


def quantise(points: DataFrame, res: float = RES0, keys: tuple[str, ...] = (), weight: Column | None = None) -> DataFrame:
    """Cells (keys, ix, iy) with their accumulators."""
    return points.withColumns({"ix": cell("x", res), "iy": cell("y", res)}).groupBy(*keys, "ix", "iy").agg(*accumulators(weight))


def merge(cells: DataFrame, keys: list[str | Column], fields: list[str] | None = None) -> DataFrame:
    """Combine cells that share ``keys``; ``fields`` keeps only those accumulators."""
    have = [f for f in FIELDS if f in cells.columns and (fields is None or f in fields)]
    return cells.groupBy(*keys).agg(*[getattr(F, FIELDS[f].rule)(f).alias(f) for f in have])


def merge_maps(*maps: DataFrame, keys: tuple[str, ...] = ("ix", "iy")) -> DataFrame:
    """One map of several: matching cells combine, the others stay."""
    out = maps[0]
    for m in maps[1:]:
        out = out.unionByName(m, allowMissingColumns=True)
    return merge(out, list(keys))


def block_level(ix: str = "ix", iy: str = "iy", res: float = RES0, bounds: tuple[float, ...] = BOUNDS) -> Column:
    """Tier of a cell from the nearest point of its block, coarsest first, so no block straddles tiers."""
    out = F.lit(0)
    for level in (1, 2, 3):
        side = res * 2**level
        near = []
        for i in (ix, iy):
            low = F.shiftright(F.col(i), level) * F.lit(side)
            high = low + F.lit(side)
            near.append(F.when(low > 0, low).when(high < 0, high).otherwise(F.lit(0.0)))
        out = F.when(F.sqrt(near[0] * near[0] + near[1] * near[1]) >= bounds[level - 1], level).otherwise(out)
    return out


def foveate(cells: DataFrame, keys: tuple[str, ...] = (), res: float = RES0) -> DataFrame:
    """Roll cells up to their tier: (keys, lvl, px, py) with accumulators, res and centre."""
    out = cells.withColumn("lvl", block_level(res=res))
    shift = lambda c: F.expr(f"shiftright({c}, lvl)")
    out = merge(out.withColumns({"px": shift("ix"), "py": shift("iy")}), [*keys, "lvl", "px", "py"])
    side = F.lit(res) * F.pow(F.lit(2.0), F.col("lvl"))
    return out.withColumn("res", side).withColumns({"cx": (F.col("px") + 0.5) * F.col("res"), "cy": (F.col("py") + 0.5) * F.col("res")})


def coarsen(cells: DataFrame, level: int = DRIVE_LEVEL, keys: tuple[str, ...] = ()) -> DataFrame:
    """Cells of 2**level times the side, keyed (keys, ix, iy)."""
    return merge(cells.withColumns({"ix": F.shiftright("ix", level), "iy": F.shiftright("iy", level)}), [*keys, "ix", "iy"])


def sensor_foveate(world: DataFrame, sensor_x: float, sensor_y: float, res: float = RES0) -> DataFrame:
    """Roll a world map up by tiers seen from a sensor: levels from relative indices, keys from world ones."""
    ox, oy = (int(v // res) for v in (sensor_x, sensor_y))
    out = world.withColumns({"__x": F.col("ix") - ox, "__y": F.col("iy") - oy}).withColumn("lvl", block_level("__x", "__y", res))
    return merge(out.withColumns({"px": F.expr("shiftright(ix, lvl)"), "py": F.expr("shiftright(iy, lvl)")}), ["lvl", "px", "py"])


def ground_percentile(points: DataFrame, res: float = 0.25, percent: int = 20, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per cell the ground height at sorted position (count * percent) // 100."""
    g = points.where(is_ground()).withColumns({"gx": cell("x", res), "gy": cell("y", res)})
    group = Window.partitionBy(*keys, "gx", "gy")
    g = g.withColumn("__r", F.row_number().over(group.orderBy("z"))).withColumn("cnt", F.count(F.lit(1)).over(group))
    return g.where(F.col("__r") == F.expr(f"cnt * {percent} div 100 + 1")).select(*keys, "gx", "gy", "cnt", F.col("z").alias("height"))


def azimuth_bin(x: str | Column = "x", y: str | Column = "y") -> Column:
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    return F.least(F.greatest(F.floor((F.atan2(y, x) + F.pi()) * AZIMUTHS / (2 * F.pi())), F.lit(0)), F.lit(AZIMUTHS - 1))


def visibility(points: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, az, rb, tmin): lowest elevation tangent seen in a direction at this range or beyond."""
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    p = points.withColumn("r", r).where("r > 1e-3").withColumns({"az": azimuth_bin(), "rb": F.least(F.floor(F.col("r") / RANGE_STEP), F.lit(RANGE_BINS - 1)), "t": F.col("z") / F.col("r")})
    own = p.groupBy(*keys, "az", "rb").agg(F.min("t").alias("t"))
    beyond = Window.partitionBy(*keys, "az").orderBy(F.desc("rb")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return own.select(*keys, "az", "rb", F.min("t").over(beyond).alias("tmin"))


def ray_low(cells: DataFrame, vis: DataFrame, x: str = "cx", y: str = "cy", keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds zray, the lowest height at a cell that rays to what lies beyond it allow; null if none.

    Cells and visibility rows are put in one ordered stream per azimuth, and a cell takes the next
    visibility row at or after its bin: an as-of join in one window, without a range join.
    """
    r = F.sqrt(F.col(x) * F.col(x) + F.col(y) * F.col(y))
    probe = cells.withColumn("__r", r).withColumns({"az": azimuth_bin(x, y), "__b": F.least(F.floor((F.col("__r") + RANGE_STEP) / RANGE_STEP) + 1, F.lit(RANGE_BINS - 1))})
    side = vis.select(*keys, "az", F.col("rb").alias("__b"), "tmin", F.lit(1).alias("__kind"))
    both = probe.withColumn("__kind", F.lit(0)).unionByName(side, allowMissingColumns=True)
    ahead = Window.partitionBy(*keys, "az").orderBy(F.desc("__b"), F.desc("__kind")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("tmin", F.min("tmin").over(ahead)).where("__kind = 0")
    return both.withColumn("zray", F.col("tmin") * F.col("__r")).drop("__kind", "__b", "__r", "az", "tmin")


def majority(critical: int = 6, least: int = 3) -> Column:
    """Class of most points, the lowest on ties; ``least`` points of the critical class claim the cell."""
    best = F.greatest(*[F.struct(F.col(h).alias("c"), F.lit(-k).alias("k")) for k, h in enumerate(HIST)])
    return F.when(F.col(HIST[critical]) >= least, critical).otherwise(-best["k"]).cast("int")


def derived(cells: DataFrame) -> DataFrame:
    """Adds rough, dip, obsh, clear from a cell's accumulators, ground height ``zg`` and ``trend``."""
    mean = F.try_divide(F.col("gsum"), F.col("ng"))
    var = F.try_divide(F.col("gsq"), F.col("ng")) - mean * mean
    return cells.withColumns({
        "rough": F.when(F.col("ng") > 2, F.sqrt(F.greatest(var, F.lit(0.0)))).otherwise(F.lit(0.0)),
        "dip": F.coalesce("gmin", "zg") - F.col("trend"),
        "obsh": F.col("zmax") - F.col("zg"),
        "clear": F.col("zomin") - F.col("zg"),
    })


def traversable(height: float = 2.2, max_step: float = 0.12, max_dip: float = 0.10, max_rough: float = 0.08) -> Column:
    """Whether a vehicle of this height may cross: known ground, no solid obstacle, little step, dip and roughness."""
    known = F.col("gdist") < 2.0
    swept = F.coalesce(F.col("zray") - F.col("zg") < height, F.lit(False))
    under = F.coalesce(F.col("clear") > height, F.lit(True)) & known & swept
    solid = (F.col("obsh") > 0.12) & ~under
    return known & ~solid & (F.col("step") < max_step) & (F.col("dip") > -max_dip) & (F.col("rough") < max_rough)


def memory_ratio(cells: DataFrame, res: float = RES0) -> DataFrame:
    """Cells kept against a uniform fine grid over the same extent."""
    side = F.lit(res) * F.pow(F.lit(2.0), F.col("lvl"))
    extent = cells.agg(F.count(F.lit(1)).alias("cells"), F.min(F.col("px") * side).alias("x0"), F.max((F.col("px") + 1) * side).alias("x1"), F.min(F.col("py") * side).alias("y0"), F.max((F.col("py") + 1) * side).alias("y1"))
    fine = (F.rint((F.col("x1") - F.col("x0")) / res) * F.rint((F.col("y1") - F.col("y0")) / res)).cast("bigint")
    return extent.select("cells", fine.alias("uniform_cells"), (fine / F.col("cells")).alias("ratio"))
