"""Queries of grids, visibility, transforms and maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sweepgrid.functions import geometry as geo
from sweepgrid.operators import grid, worldmap
from sweepgrid.sources import fixtures as fx
from sweepgrid.sources import sinks

PTS, WIDE = fx.points_sql(fx.NEAR), fx.points_sql(fx.WIDE)
_HIST = ", ".join(f"count(*) FILTER (lab = {k}) AS h{k}" for k in range(8))
_HSUM = ", ".join(f"sum(h{k})::BIGINT AS h{k}" for k in range(8))
_AGG = f"count(*) AS n, min(z) AS zmin, max(z) AS zmax, min(CASE WHEN lab NOT IN (0,1) THEN z END) AS zomin, sum(z) AS zsum, sum(z*z) AS zsq, count(*) FILTER (lab IN (0,1)) AS ng, min(CASE WHEN lab IN (0,1) THEN z END) AS gmin, sum(CASE WHEN lab IN (0,1) THEN z ELSE 0 END) AS gsum, sum(CASE WHEN lab IN (0,1) THEN z*z ELSE 0 END) AS gsq, {_HIST}"
_MERGE = f"sum(n)::BIGINT AS n, min(zmin) AS zmin, max(zmax) AS zmax, min(zomin) AS zomin, sum(zsum) AS zsum, sum(zsq) AS zsq, sum(ng)::BIGINT AS ng, min(gmin) AS gmin, sum(gsum) AS gsum, sum(gsq) AS gsq, {_HSUM}"


def _cell(c: str, res: float) -> str:
    return f"cast(floor({c}/cast({res} as double)) as bigint)"


def _quantised(res: float = 0.05, name: str = "cells", keys: str = "") -> str:
    return f"{name} AS (SELECT {keys} {_cell('x', res)} AS ix, {_cell('y', res)} AS iy, {_AGG} FROM points GROUP BY ALL)"


def _near(i: str, level: int) -> str:
    side = f"cast({0.05 * 2**level} as double)"
    low = f"(({i} >> {level}) * {side})"
    return f"(CASE WHEN {low} > 0 THEN {low} WHEN {low} + {side} < 0 THEN {low} + {side} ELSE 0 END)"


def _level(ix: str = "ix", iy: str = "iy") -> str:
    tests = " ".join(f"WHEN sqrt({_near(ix, k)}*{_near(ix, k)} + {_near(iy, k)}*{_near(iy, k)}) >= {grid.BOUNDS[k - 1]} THEN {k}" for k in (3, 2, 1))
    return f"(CASE {tests} ELSE 0 END)"


QUERIES, ORACLES = {}, {}


def _add(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


@_add("q_quantise", f"WITH {PTS} SELECT frame, {_cell('x', 0.05)} AS ix, {_cell('y', 0.05)} AS iy, {_AGG} FROM points GROUP BY ALL")
def quantise(spark: SparkSession, d: str) -> DataFrame:
    return grid.quantise(fx.points(spark, d), keys=("frame",))


@_add("q_foveate", f"WITH {WIDE}, {_quantised()}, l AS (SELECT *, {_level()} AS lvl FROM cells), f AS (SELECT lvl, ix >> lvl AS px, iy >> lvl AS py, {_MERGE} FROM l GROUP BY ALL) SELECT *, 0.05::DOUBLE * pow(2.0, lvl) AS res, (px + 0.5) * (0.05::DOUBLE * pow(2.0, lvl)) AS cx, (py + 0.5) * (0.05::DOUBLE * pow(2.0, lvl)) AS cy FROM f")
def foveate(spark: SparkSession, d: str) -> DataFrame:
    p = fx.points(spark, d, fx.WIDE)
    return grid.foveate(grid.quantise(p))


@_add("q_coarsen_merge", f"WITH {PTS} SELECT {_cell('x', 0.05)} >> 3 AS ix, {_cell('y', 0.05)} >> 3 AS iy, {_AGG} FROM points GROUP BY ALL")
def coarsen_merge(spark: SparkSession, d: str) -> DataFrame:
    """Both halves of the sweeps, binned apart, merged and coarsened: the same as binning all at the coarse side."""
    p = fx.points(spark, d)
    halves = [grid.quantise(p.where(F.col("frame") % 2 == k)) for k in (0, 1)]
    return grid.coarsen(grid.merge_maps(*halves))


@_add("q_sensor_foveate", f"WITH {WIDE}, {_quantised()}, l AS (SELECT *, {_level('(ix - 60)', '(iy + 41)')} AS lvl FROM cells) SELECT lvl, ix >> lvl AS px, iy >> lvl AS py, {_MERGE} FROM l GROUP BY ALL")
def sensor_foveate(spark: SparkSession, d: str) -> DataFrame:
    return grid.sensor_foveate(grid.quantise(fx.points(spark, d, fx.WIDE)), 3.02, -2.01)


@_add("q_ground_pct", f"""WITH {PTS}, g AS (SELECT frame, {_cell('x', 0.25)} AS gx, {_cell('y', 0.25)} AS gy, z FROM points WHERE lab IN (0,1)),
r AS (SELECT *, row_number() OVER (PARTITION BY frame, gx, gy ORDER BY z) AS k, count(*) OVER (PARTITION BY frame, gx, gy) AS cnt FROM g)
SELECT frame, gx, gy, cnt, z AS height FROM r WHERE k = cnt * 20 // 100 + 1""")
def ground_pct(spark: SparkSession, d: str) -> DataFrame:
    return grid.ground_percentile(fx.points(spark, d), keys=("frame",))


_AZ = "least(greatest(cast(floor((atan2({y}, {x}) + pi()) * 2048 / (2 * pi())) as bigint), 0), 2047)"
_VIS = f"""v0 AS (SELECT frame, {_AZ.format(x='x', y='y')} AS az, least(cast(floor(sqrt(x*x+y*y)/0.5) as bigint), 201) AS rb, min(z/sqrt(x*x+y*y)) AS t FROM points WHERE sqrt(x*x+y*y) > 1e-3 GROUP BY ALL),
vis AS (SELECT frame, az, rb, min(t) OVER (PARTITION BY frame, az ORDER BY rb ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS tmin FROM v0)"""


@_add("q_visibility", f"WITH {PTS}, {_VIS} SELECT * FROM vis")
def visibility(spark: SparkSession, d: str) -> DataFrame:
    return grid.visibility(fx.points(spark, d), ("frame",))


_C04 = f"c AS (SELECT frame, {_cell('x', 0.4)} AS ix, {_cell('y', 0.4)} AS iy, count(*) AS n FROM points GROUP BY ALL), k AS (SELECT *, (ix+0.5)*0.4::DOUBLE AS cx, (iy+0.5)*0.4::DOUBLE AS cy FROM c)"


@_add("q_raylow", f"""WITH {PTS}, {_VIS}, {_C04}, p AS (SELECT *, {_AZ.format(x='cx', y='cy')} AS az, least(cast(floor((sqrt(cx*cx+cy*cy)+0.5)/0.5) as bigint)+1, 201) AS b FROM k)
SELECT p.frame, ix, iy, n, (SELECT min(tmin) FROM vis v WHERE v.frame = p.frame AND v.az = p.az AND v.rb >= p.b) * sqrt(cx*cx+cy*cy) AS zray FROM p""")
def raylow(spark: SparkSession, d: str) -> DataFrame:
    p = fx.points(spark, d)
    c = p.withColumns({"ix": geo.cell("x", 0.4), "iy": geo.cell("y", 0.4)}).groupBy("frame", "ix", "iy").agg(F.count(F.lit(1)).alias("n"))
    c = c.withColumns({"cx": geo.centre("ix", 0.4), "cy": geo.centre("iy", 0.4)})
    return grid.ray_low(c, grid.visibility(p, ("frame",)), keys=("frame",)).select("frame", "ix", "iy", "n", "zray")


@_add("q_classify", f"""WITH {PTS}, {_quantised(0.4, keys='frame,')}, u AS (SELECT frame, ix, iy, h6, unnest([h0,h1,h2,h3,h4,h5,h6,h7]) AS c, unnest(range(8)) AS k FROM cells),
b AS (SELECT frame, ix, iy, h6, arg_max(k, c * 100 - k) AS best FROM u GROUP BY ALL) SELECT frame, ix, iy, CASE WHEN h6 >= 3 THEN 6 ELSE best END::INT AS cls FROM b""")
def classify(spark: SparkSession, d: str) -> DataFrame:
    return grid.quantise(fx.points(spark, d), 0.4, ("frame",)).select("frame", "ix", "iy", grid.majority().alias("cls"))


@_add("q_memory_ratio", f"""WITH {WIDE}, {_quantised()}, f AS (SELECT DISTINCT {_level()} AS lvl, ix >> {_level()} AS px, iy >> {_level()} AS py FROM cells),
e AS (SELECT count(*) AS cells, min(px*(0.05::DOUBLE*pow(2.0,lvl))) x0, max((px+1)*(0.05::DOUBLE*pow(2.0,lvl))) x1, min(py*(0.05::DOUBLE*pow(2.0,lvl))) y0, max((py+1)*(0.05::DOUBLE*pow(2.0,lvl))) y1 FROM f)
SELECT cells, (round_even((x1-x0)/0.05::DOUBLE, 0)*round_even((y1-y0)/0.05::DOUBLE, 0))::BIGINT AS uniform_cells, (round_even((x1-x0)/0.05::DOUBLE, 0)*round_even((y1-y0)/0.05::DOUBLE, 0))::BIGINT / cells::DOUBLE AS ratio FROM e""")
def memory_ratio(spark: SparkSession, d: str) -> DataFrame:
    return grid.memory_ratio(grid.foveate(grid.quantise(fx.points(spark, d, fx.WIDE))))


_TIERS = ", ".join(f"({k}, {r}::DOUBLE, {round(2 * h / r)})" for k, (r, h) in enumerate(worldmap.TIERS))


@_add("q_tiers", f"""WITH {WIDE}, t(lvl, res, side) AS (VALUES {_TIERS}),
p AS (SELECT lvl, side, z, lab, cast(floor((x-1.0)/res) as bigint) + side//2 AS tx, cast(floor((y+0.4)/res) as bigint) + side//2 AS ty, round_even(1.0/res, 0)::BIGINT AS wx, round_even(-0.4/res, 0)::BIGINT AS wy FROM points, t)
SELECT lvl::INT AS lvl, tx - side//2 + wx AS ix, ty - side//2 + wy AS iy, count(*) AS n, max(z) AS zmax, min(CASE WHEN lab IN (0,1) THEN z END) AS gmin, count(*) FILTER (lab IN (0,1)) AS ng, sum(CASE WHEN lab IN (0,1) THEN z ELSE 0 END) AS gsum, sum(CASE WHEN lab IN (0,1) THEN z*z ELSE 0 END) AS gsq
FROM p WHERE tx >= 0 AND tx < side AND ty >= 0 AND ty < side GROUP BY ALL""")
def tiers(spark: SparkSession, d: str) -> DataFrame:
    return worldmap.into_tiers(fx.points(spark, d, fx.WIDE), (1.0, -0.4))


_KEEP = " OR ".join(f"(lvl = {k} AND ix BETWEEN {round(4.0 / r) - round(2 * h / r) // 2} AND {round(4.0 / r) - round(2 * h / r) // 2 + round(2 * h / r) - 1} AND iy BETWEEN {round(2.0 / r) - round(2 * h / r) // 2} AND {round(2.0 / r) - round(2 * h / r) // 2 + round(2 * h / r) - 1})" for k, (r, h) in enumerate(worldmap.TIERS))


@_add("q_recentre", f"""WITH {WIDE}, t(lvl, res, side) AS (VALUES {_TIERS}), p AS (SELECT lvl::INT AS lvl, cast(floor(x/res) as bigint) AS ix, cast(floor(y/res) as bigint) AS iy, side FROM points, t),
c AS (SELECT lvl, ix, iy, count(*) AS n FROM p WHERE ix >= -(side//2) AND ix < side - side//2 AND iy >= -(side//2) AND iy < side - side//2 GROUP BY ALL) SELECT * FROM c WHERE {_KEEP}""")
def recentre(spark: SparkSession, d: str) -> DataFrame:
    return worldmap.in_extent(worldmap.into_tiers(fx.points(spark, d, fx.WIDE)).select("lvl", "ix", "iy", "n"), (4.0, 2.0))


_WORLD = "w AS (SELECT p.*, r00*x + r01*y + r02*z + tx AS wx, r10*x + r11*y + r12*z + ty AS wy, r20*x + r21*y + r22*z + tz AS wz, tx, ty, tz, r00, r01, r02, r10, r11, r12, r20, r21, r22 FROM points p JOIN poses USING (frame))"


@_add("q_transform_pose", f"WITH {PTS}, {fx.poses_sql()}, {_WORLD} SELECT ok, pk, sk, ln, frame, round(wx, 6) + 0.0 AS wx, round(wy, 6) + 0.0 AS wy, round(wz, 6) + 0.0 AS wz, round(r00*(wx-tx)+r10*(wy-ty)+r20*(wz-tz), 6) + 0.0 AS sx, round(r01*(wx-tx)+r11*(wy-ty)+r21*(wz-tz), 6) + 0.0 AS sy FROM w")
def transform_pose(spark: SparkSession, d: str) -> DataFrame:
    """World coordinates, and back again."""
    poses = fx.poses(spark)
    w = geo.inverse_transform(geo.transform(fx.points(spark, d), poses), poses)
    return w.select("ok", "pk", "sk", "ln", "frame", *[(F.round(c, 6) + 0.0).alias(c) for c in ("wx", "wy", "wz", "sx", "sy")])


CAMERA = [[700.0, 0.0, 621.0, 45.0], [0.0, 700.0, 187.5, -0.25], [0.0, 0.0, 1.0, 0.005]]
EXTRINSIC = [[0.0, -1.0, 0.0, -0.004], [0.0, 0.0, -1.0, -0.076], [1.0, 0.0, 0.0, -0.27]]


@_add("q_project_camera", f"""WITH {PTS}, c AS (SELECT *, 0.0*x + -1.0*y + 0.0*z + -0.004 AS a, 0.0*x + 0.0*y + -1.0*z + -0.076 AS b, 1.0*x + 0.0*y + 0.0*z + -0.27 AS e FROM points),
i AS (SELECT *, 700.0::DOUBLE*a + 0.0*b + 621.0::DOUBLE*e + 45.0 AS u0, 0.0*a + 700.0::DOUBLE*b + 187.5::DOUBLE*e + -0.25 AS v0, 0.0*a + 0.0*b + 1.0*e + 0.005::DOUBLE AS depth FROM c)
SELECT ok, pk, sk, ln, round(u0/depth, 6) AS u, round(v0/depth, 6) AS v, round(depth, 6) AS depth FROM i WHERE depth > 0.5 AND u0/depth >= 0 AND u0/depth < 1242 AND v0/depth >= 0 AND v0/depth < 375""")
def project_camera(spark: SparkSession, d: str) -> DataFrame:
    u, v, depth = geo.project(F.col("x"), F.col("y"), F.col("z"), CAMERA, EXTRINSIC)
    p = fx.points(spark, d).withColumns({"u": u, "v": v, "depth": depth}).where("depth > 0.5 AND u >= 0 AND u < 1242 AND v >= 0 AND v < 375")
    return p.select("ok", "pk", "sk", "ln", *[F.round(c, 6).alias(c) for c in ("u", "v", "depth")])


@_add("q_fov_filter", f"WITH {WIDE} SELECT ok, pk, sk, ln, frame FROM points WHERE sqrt(x*x+y*y) > 1 AND sqrt(x*x+y*y) < 50 AND abs(degrees(atan2(y, x))) <= 40")
def fov_filter(spark: SparkSession, d: str) -> DataFrame:
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    return fx.points(spark, d, fx.WIDE).where((r > 1) & (r < 50) & (F.abs(F.degrees(F.atan2("y", "x"))) <= 40)).select("ok", "pk", "sk", "ln", "frame")


_W = "1.0/(0.0004::DOUBLE + 0.000025::DOUBLE*(x*x+y*y))"


@_add("q_weighted_ground", f"WITH {PTS} SELECT {_cell('x', 0.4)} AS ix, {_cell('y', 0.4)} AS iy, count(*) AS n, round(sum(CASE WHEN lab IN (0,1) THEN {_W} ELSE 0 END), 4) AS gw, round(sum(CASE WHEN lab IN (0,1) THEN {_W}*z ELSE 0 END), 4) AS gwz, round(sum(CASE WHEN lab IN (0,1) THEN {_W}*z*z ELSE 0 END), 4) AS gwz2 FROM points WHERE x*x+y*y <= 400 GROUP BY ALL")
def weighted_ground(spark: SparkSession, d: str) -> DataFrame:
    c = grid.quantise(worldmap.trusted(fx.points(spark, d)), 0.4, weight=worldmap.weight())
    return c.select("ix", "iy", "n", *[F.round(k, 4).alias(k) for k in ("gw", "gwz", "gwz2")])


def _side(name: str, rest: int) -> str:
    return f"{name} AS (SELECT {_cell('x', 0.4)} AS ix, {_cell('y', 0.4)} AS iy, count(*) AS n, count(*) FILTER (lab IN (0,1)) AS ng, sum(CASE WHEN lab IN (0,1) THEN z ELSE 0 END) AS gsum, sum(CASE WHEN lab IN (0,1) THEN z*z ELSE 0 END) AS gsq, max(z) AS zmax, min(CASE WHEN lab IN (0,1) THEN z END) AS gmin FROM points WHERE frame % 2 = {rest} GROUP BY ALL)"


@_add("q_align_z", f"""WITH {PTS}, {_side('a', 0)}, {_side('b', 1)}, m AS (SELECT median(a.gsum/a.ng - b.gsum/b.ng) AS dz, count(*) AS common FROM a JOIN b USING (ix, iy) WHERE a.ng >= 3 AND b.ng >= 3)
SELECT CASE WHEN common >= 40 AND abs(dz) <= 0.5 THEN round(dz, 9) ELSE 0.0 END AS dz, common FROM m""")
def align_z(spark: SparkSession, d: str) -> DataFrame:
    p = fx.points(spark, d)
    a, b = (grid.quantise(p.where(F.col("frame") % 2 == k), 0.4) for k in (0, 1))
    return worldmap.drift(a, b).select(F.round("dz", 9).alias("dz"), "common")


@_add("q_shift_z", f"WITH {PTS}, points2 AS (SELECT * REPLACE (z + 0.25 AS z) FROM points) SELECT {_cell('x', 0.4)} AS ix, {_cell('y', 0.4)} AS iy, {_AGG} FROM points2 GROUP BY ALL")
def shift_z(spark: SparkSession, d: str) -> DataFrame:
    """Shifted accumulators equal those of shifted points."""
    return worldmap.shift_z(grid.quantise(fx.points(spark, d), 0.4), 0.25)


_MERGED = f"WITH {PTS} SELECT {_cell('x', 0.2)} AS ix, {_cell('y', 0.2)} AS iy, {_AGG} FROM points GROUP BY ALL"


@_add("q_map_merge", _MERGED)
def map_merge(spark: SparkSession, d: str) -> DataFrame:
    """Two maps, of the first sweeps and of the others, merged by cell."""
    p = fx.points(spark, d)
    return grid.merge_maps(grid.quantise(p.where("frame < 4"), 0.2), grid.quantise(p.where("frame >= 4"), 0.2))


@_add("q_accumulate", f"WITH {PTS}, {fx.poses_sql()}, {_WORLD} SELECT {_cell('wx', 0.4)} AS ix, {_cell('wy', 0.4)} AS iy, count(*) AS n, least(count(*), 40) AS n_capped, count(*) FILTER (lab IN (0,1)) AS ng, round(sum(CASE WHEN lab IN (0,1) THEN {_W} ELSE 0 END), 3) AS gw, max(wz) AS zmax FROM w WHERE x*x+y*y <= 400 AND lab NOT IN (5, 6) GROUP BY ALL")
def accumulate(spark: SparkSession, d: str) -> DataFrame:
    """Sweeps at their poses, moving things held out, in one aggregation."""
    p = worldmap.trusted(fx.points(spark, d), moving=F.col("lab").isin(5, 6))
    return worldmap.accumulate(geo.transform(p, fx.poses(spark)), 0.4).select("ix", "iy", "n", "n_capped", "ng", F.round("gw", 3).alias("gw"), "zmax")


@_add("q_prune_window", f"WITH {WIDE}, c AS (SELECT {_cell('x', 0.4)} AS ix, {_cell('y', 0.4)} AS iy, count(*) AS n FROM points GROUP BY ALL) SELECT * FROM c WHERE ((ix+0.5)*0.4::DOUBLE - 3.0)*((ix+0.5)*0.4::DOUBLE - 3.0) + ((iy+0.5)*0.4::DOUBLE + 2.0)*((iy+0.5)*0.4::DOUBLE + 2.0) <= 1600 AND abs(ix - 7) <= 75 AND abs(iy + 5) <= 75")
def prune_window(spark: SparkSession, d: str) -> DataFrame:
    p = fx.points(spark, d, fx.WIDE)
    c = p.withColumns({"ix": geo.cell("x", 0.4), "iy": geo.cell("y", 0.4)}).groupBy("ix", "iy").agg(F.count(F.lit(1)).alias("n"))
    return worldmap.near(worldmap.prune(c, 3.0, -2.0, 0.4, 40.0), 3.0, -2.0, 0.4, 30.0)


@_add("q_map_stats", f"WITH {WIDE}, c AS (SELECT {_cell('x', 0.4)} AS ix, {_cell('y', 0.4)} AS iy, count(*) AS n FROM points GROUP BY ALL) SELECT count(*) AS cells, median(n)::DOUBLE AS median_obs, quantile_cont(n, 0.9)::DOUBLE AS p90_obs, round(avg((n = 1)::INT), 9) AS single_share FROM c")
def map_stats(spark: SparkSession, d: str) -> DataFrame:
    p = fx.points(spark, d, fx.WIDE)
    c = p.withColumns({"ix": geo.cell("x", 0.4), "iy": geo.cell("y", 0.4)}).groupBy("ix", "iy").agg(F.count(F.lit(1)).alias("n"))
    return worldmap.map_stats(c).withColumn("single_share", F.round("single_share", 9))


@_add("q_payload_quant", f"WITH {PTS}, c AS (SELECT {_cell('x', 0.4)} AS ix, {_cell('y', 0.4)} AS iy, max(z) AS h FROM points GROUP BY ALL) SELECT ix, iy, (ix - 2)::SMALLINT AS dx, (iy + 2)::SMALLINT AS dy, trunc(least(greatest(h * 1000.0, -32000), 32000))::SMALLINT AS mm FROM c WHERE abs(ix - 2) <= 30 AND abs(iy + 2) <= 30")
def payload_quant(spark: SparkSession, d: str) -> DataFrame:
    p = fx.points(spark, d)
    c = p.withColumns({"ix": geo.cell("x", 0.4), "iy": geo.cell("y", 0.4)}).groupBy("ix", "iy").agg(F.max("z").alias("h"))
    return sinks.window(c, 1.0, -0.5, 0.4, 12.0).select("ix", "iy", "dx", "dy", "mm")


@_add("q_frame_mirror", f"WITH {PTS} SELECT frame, count(*) AS n, sum(-y) AS sy, max(-y) AS my FROM points GROUP BY ALL")
def frame_mirror(spark: SparkSession, d: str) -> DataFrame:
    p = fx.points(spark, d).withColumn("y", -F.col("y"))
    return p.groupBy("frame").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("sy"), F.max("y").alias("my"))


def _chain(rows: str, frames: int, res: float, common: int, tag: str = "") -> str:
    """CTEs of a map over frames in order: the drift of each against the map before, then the map with it taken out.

    A fixed chain of steps, as the drift of a sweep needs the map of all sweeps before it."""
    out = [f"{tag}s AS MATERIALIZED (SELECT frame, {_cell('wx', res)} AS ix, {_cell('wy', res)} AS iy, count(*) AS n, count(*) FILTER (lab IN (0,1)) AS ng, sum(CASE WHEN lab IN (0,1) THEN wz ELSE 0 END) AS gsum, sum(CASE WHEN lab IN (0,1) THEN wz*wz ELSE 0 END) AS gsq, max(wz) AS zmax, min(CASE WHEN lab IN (0,1) THEN wz END) AS gmin FROM w WHERE x*x+y*y <= 400 AND lab NOT IN (5, 6) AND {rows} GROUP BY ALL)"]
    for k in range(frames):
        drift = f"SELECT CASE WHEN count(*) >= {common} AND abs(median(m.gsum/m.ng - s.gsum/s.ng)) <= 0.5 THEN median(m.gsum/m.ng - s.gsum/s.ng) ELSE 0.0 END AS dz FROM {tag}m{k - 1} m JOIN {tag}s s USING (ix, iy) WHERE s.frame = {k} AND m.ng >= 3 AND s.ng >= 3"
        out.append(f"{tag}d{k} AS MATERIALIZED ({drift if k else 'SELECT 0.0::DOUBLE AS dz'})")
        moved = f"SELECT ix, iy, n, ng, gsum + ng*dz AS gsum, gsq + 2*gsum*dz + ng*(dz*dz) AS gsq, zmax + dz AS zmax, gmin + dz AS gmin FROM {tag}s, {tag}d{k} WHERE frame = {k}"
        both = f"SELECT ix, iy, n, ng, gsum, gsq, zmax, gmin FROM {tag}m{k - 1} UNION ALL {moved}" if k else moved
        near = f"pow((ix+0.5)*{res}::DOUBLE - {k * 0.5}, 2) + pow((iy+0.5)*{res}::DOUBLE - {k * 0.25}, 2) <= 8100"
        out.append(f"{tag}m{k} AS MATERIALIZED (SELECT ix, iy, sum(n)::BIGINT AS n, sum(ng)::BIGINT AS ng, sum(gsum) AS gsum, sum(gsq) AS gsq, max(zmax) AS zmax, min(gmin) AS gmin FROM ({both}) WHERE {near} GROUP BY ALL)")
    return ",\n".join(out)


#: Sweeps whose heights creep up by a 32nd of a metre each, so that there is drift to take out.
_CREEP = _WORLD.replace("r20*x + r21*y + r22*z + tz AS wz", "r20*x + r21*y + r22*z + tz + p.frame/32.0::DOUBLE AS wz")


def _creeping(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return fx.points(spark, d).withColumn("moving", F.col("lab").isin(5, 6)), fx.poses(spark).withColumn("tz", F.col("tz") + F.col("frame") / F.lit(32.0))


_SEQ = "SELECT '{m}' AS map_id, ix, iy, least(n, 40) AS n, ng, round(gsum, 6) AS gsum, round(gsq, 6) AS gsq, round(zmax, 6) AS zmax, round(gmin, 6) AS gmin FROM {m}m9"


@_add("q_worldmap_seq", f"WITH {PTS}, {fx.poses_sql()}, {_CREEP}, {_chain('ok % 2 = 0', 10, 1.6, 40, 'm0')}, {_chain('ok % 2 = 1', 10, 1.6, 40, 'm1')} {_SEQ.format(m='m0')} UNION ALL {_SEQ.format(m='m1')}")
def worldmap_seq(spark: SparkSession, d: str) -> DataFrame:
    """Sweeps one after the other with drift taken out, in cells of 1.6 m; two maps, of even and odd orders."""
    from sweepgrid.streaming.tables import WorldTable

    points, poses = _creeping(spark, d)
    out = []
    for k in (0, 1):
        world = WorldTable(spark, res=1.6)
        world.ingest_all(points.where(F.col("ok") % 2 == k), poses)
        out.append(world.read().select(F.lit(f"m{k}").alias("map_id"), "ix", "iy", F.least("n", F.lit(worldmap.OBS_CAP)).alias("n"), "ng", *[F.round(c, 6).alias(c) for c in ("gsum", "gsq", "zmax", "gmin")]))
    return out[0].unionByName(out[1])


@_add("q_world_drift", f"WITH {PTS}, {fx.poses_sql()}, {_CREEP}, {_chain('true', 10, 1.6, 40)} " + " UNION ALL ".join(f"SELECT {k} AS frame, round(dz, 9) + 0.0 AS dz FROM d{k}" for k in range(10)))
def world_drift(spark: SparkSession, d: str) -> DataFrame:
    """The drift that was taken out of each sweep, against the map of the sweeps before it."""
    from sweepgrid.streaming.tables import WorldTable

    world = WorldTable(spark, res=1.6)
    world.ingest_all(*_creeping(spark, d))
    return spark.createDataFrame(sorted(world.drifts.items()), "frame INT, dz DOUBLE").select("frame", (F.round("dz", 9) + 0.0).alias("dz"))


_PLAIN = f"WITH {PTS}, {fx.poses_sql()}, {_WORLD} SELECT {_cell('wx', 0.4)} AS ix, {_cell('wy', 0.4)} AS iy, least(count(*), 40) AS n, count(*) FILTER (lab IN (0,1)) AS ng, sum(CASE WHEN lab IN (0,1) THEN wz ELSE 0 END) AS gsum, round(sum(CASE WHEN lab IN (0,1) THEN {_W} ELSE 0 END), 3) AS gw, max(wz) AS zmax FROM w WHERE x*x+y*y <= 400 AND lab NOT IN (5, 6) GROUP BY ALL"


@_add("q_world_plain", _PLAIN)
def world_plain(spark: SparkSession, d: str) -> DataFrame:
    """Sweeps merged one after the other into a table, weighted, without what moves, and with drift left alone."""
    from sweepgrid.streaming.tables import WorldTable

    world = WorldTable(spark, align=False)
    world.ingest_all(fx.points(spark, d).withColumn("moving", F.col("lab").isin(5, 6)), fx.poses(spark))
    return world.read().select("ix", "iy", F.least("n", F.lit(worldmap.OBS_CAP)).alias("n"), "ng", "gsum", F.round("gw", 3).alias("gw"), "zmax")


def _tier_sql(name: str, test: str, x: float, y: float) -> str:
    return f"""{name}p AS (SELECT lvl, side, z, lab, cast(floor((x-{x})/res) as bigint) + side//2 AS tx, cast(floor((y-{y})/res) as bigint) + side//2 AS ty, round_even({x}/res, 0)::BIGINT AS wx, round_even({y}/res, 0)::BIGINT AS wy FROM points, t WHERE {test}),
{name} AS (SELECT lvl::INT AS lvl, tx - side//2 + wx AS ix, ty - side//2 + wy AS iy, count(*) AS n, max(z) AS zmax, count(*) FILTER (lab IN (0,1)) AS ng, sum(CASE WHEN lab IN (0,1) THEN z ELSE 0 END) AS gsum FROM {name}p WHERE tx >= 0 AND tx < side AND ty >= 0 AND ty < side GROUP BY ALL)"""


@_add("q_tier_ingest", f"WITH {WIDE}, t(lvl, res, side) AS (VALUES {_TIERS}), {_tier_sql('a', 'frame < 5', 0.0, 0.0)}, {_tier_sql('b', 'frame >= 5', 4.0, 2.0)}, u AS (SELECT * FROM a WHERE {_KEEP} UNION ALL SELECT * FROM b) SELECT lvl, ix, iy, sum(n)::BIGINT AS n, max(zmax) AS zmax, sum(ng)::BIGINT AS ng, sum(gsum) AS gsum FROM u GROUP BY ALL")
def tier_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Two groups of sweeps into tiers that move with the sensor in between."""
    from sweepgrid.streaming.tables import ingest_tiers

    p = fx.points(spark, d, fx.WIDE)
    first = ingest_tiers(None, p.where("frame < 5"), (0.0, 0.0))
    return ingest_tiers(first, p.where("frame >= 5"), (4.0, 2.0), align=False).select("lvl", "ix", "iy", "n", "zmax", "ng", "gsum")


@_add("q_stream_map")
def stream_map(spark: SparkSession, d: str) -> DataFrame:
    """Sweeps as a stream of files, one a micro-batch, merged into a table with drift taken out; the map after the last."""
    from sweepgrid.sources.workspace import work_folder
    from sweepgrid.streaming.tables import WorldTable

    folder, p = work_folder(spark, "sweeps"), fx.points(spark, d).withColumn("moving", F.col("lab").isin(5, 6))
    for f in range(fx.FRAMES):  # files in the order of their frames
        p.where(F.col("frame") == f).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    world = WorldTable(spark)
    stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    world.into(stream, fx.poses(spark), f"{folder}/checkpoint").awaitTermination()
    return world.read().select("ix", "iy", F.least("n", F.lit(worldmap.OBS_CAP)).alias("n"), "ng", "gsum", F.round("gw", 3).alias("gw"), "zmax")


@_add("q_keyed_map", _PLAIN)
def keyed_map(spark: SparkSession, d: str) -> DataFrame:
    """Sweeps as a stream, a file a micro-batch, into tiles of keyed state; the map as it lies in the state store."""
    from sweepgrid.sources.workspace import work_folder
    from sweepgrid.streaming import keyed

    folder, p = work_folder(spark, "keyed"), fx.points(spark, d).withColumn("map_id", F.lit("m")).withColumn("moving", F.col("lab").isin(5, 6))
    sweeps = spark.range(fx.FRAMES).select(F.lit("m").alias("map_id"), F.col("id").cast("int").alias("frame"))
    for low, high in ((0, 4), (4, fx.FRAMES)):
        for name, rows in (("points", p), ("sweeps", sweeps)):
            rows.where(F.col("frame").between(low, high - 1)).repartition(1).write.mode("append").parquet(f"{folder}/{name}")
    streams = [spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/{name}") for name, rows in (("points", p), ("sweeps", sweeps))]
    keyed.KeyedMap().start(*streams, keyed.with_previous(fx.poses(spark)), f"{folder}/checkpoint").awaitTermination()
    return keyed.read(spark, f"{folder}/checkpoint").select("ix", "iy", F.least("n", F.lit(worldmap.OBS_CAP)).alias("n"), "ng", "gsum", F.round("gw", 3).alias("gw"), "zmax")
