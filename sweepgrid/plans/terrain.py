"""Queries of drivability, sectors, tracking and data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sweepgrid.functions import geometry as geo
from sweepgrid.operators import drive, grid, quality, raster, sectors
from sweepgrid.plans.mapping import _AGG, PTS, WIDE, _cell
from sweepgrid.sources import fixtures as fx
from sweepgrid.sources import sinks

QUERIES, ORACLES = {}, {}


def _add(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


def _steps(h: str, part: str = "", own: str = "h") -> str:
    p = f"{part}, " if part else ""
    tests = []
    for a, b in (("ix", "iy"), ("iy", "ix")):
        tests += [f"abs(max({h}) OVER (PARTITION BY {p}{a} ORDER BY {b} RANGE BETWEEN {d} AND {d}) - coalesce({own}, 0))" for d in ("1 PRECEDING", "1 FOLLOWING")]
    tests = [t.replace("1 PRECEDING AND 1 PRECEDING", "1 PRECEDING AND 1 PRECEDING") for t in tests]
    return f"coalesce(greatest({', '.join(tests)}), 0)"


_DRIVE = f"""c AS (SELECT {_cell('x', 0.4)} AS ix, {_cell('y', 0.4)} AS iy, {_AGG} FROM points GROUP BY ALL),
m AS (SELECT *, CASE WHEN ng >= 3 THEN gsum/ng END AS h, CASE WHEN ng >= 3 THEN gsq/ng - (gsum/ng)*(gsum/ng) END AS var FROM c),
s AS (SELECT *, CASE WHEN h IS NOT NULL THEN {_steps('h')} END AS step FROM m),
r AS (SELECT *, degrees(atan(step/0.4::DOUBLE)) AS slope, sqrt(greatest(var - step*step/12, 0)) AS rough, (ix+0.5)*0.4::DOUBLE AS cx, (iy+0.5)*0.4::DOUBLE AS cy FROM s),
o AS (SELECT *, CASE WHEN h IS NOT NULL THEN greatest(rough/0.040::DOUBLE, step/(0.10::DOUBLE + 0.00008::DOUBLE*(cx*cx+cy*cy)), slope/15.0) END AS score FROM r),
drive AS (SELECT *, CASE WHEN score IS NULL THEN 3 WHEN score <= 1.0 THEN 0 WHEN score <= 2.0 THEN 1 ELSE 2 END AS cls FROM o)"""


def _driven(spark: SparkSession, d: str) -> DataFrame:
    return drive.cell_drivability(grid.quantise(fx.points(spark, d), 0.4), min_points=3)


@_add("q_drivability", f"WITH {PTS}, {_DRIVE} SELECT ix, iy, n, ng, round(h, 9) + 0.0 AS h, round(step, 9) + 0.0 AS step, round(rough, 6) + 0.0 AS rough, round(score, 6) + 0.0 AS score, cls FROM drive")
def drivability(spark: SparkSession, d: str) -> DataFrame:
    return _driven(spark, d).select("ix", "iy", "n", "ng", *[(F.round(c, k) + 0.0).alias(c) for c, k in (("h", 9), ("step", 9), ("rough", 6), ("score", 6))], "cls")


@_add("q_class_mix_bands", f"""WITH {PTS}, {_DRIVE}, b AS (SELECT cls, CASE WHEN r < 10 THEN '0-10' WHEN r < 20 THEN '10-20' WHEN r < 30 THEN '20-30' WHEN r < 50 THEN '30-50' END AS band FROM (SELECT cls, sqrt(cx*cx+cy*cy) AS r FROM drive))
SELECT band, count(*) FILTER (cls=0) AS drivable, count(*) FILTER (cls=1) AS marginal, count(*) FILTER (cls=2) AS non_drivable, count(*) FILTER (cls=3) AS unknown, count(*) AS cells FROM b WHERE band IS NOT NULL GROUP BY ALL""")
def class_mix_bands(spark: SparkSession, d: str) -> DataFrame:
    cx, cy = geo.centre("ix", 0.4), geo.centre("iy", 0.4)
    return drive.class_mix(_driven(spark, d).withColumn("r", F.sqrt(cx * cx + cy * cy)))


@_add("q_payloads")
def payloads(spark: SparkSession, d: str) -> DataFrame:
    cells = _driven(spark, d).withColumn("frame", F.lit(0))
    return sinks.payloads(sinks.window(cells, 0.0, 0.0, 0.4))


@_add("q_traversable_flat", f"""WITH {PTS}, c AS (SELECT {_cell('x', 0.4)} AS ix, {_cell('y', 0.4)} AS iy, {_AGG} FROM points GROUP BY ALL),
k AS (SELECT *, -1.75::DOUBLE AS zg, -1.75::DOUBLE AS trend, abs(ix) % 5 * 0.5 AS gdist, CASE WHEN abs(iy) % 3 > 0 THEN -1.0 END AS zray, 0.05 AS step FROM c),
e AS (SELECT *, CASE WHEN ng > 2 THEN sqrt(greatest(gsq/ng - (gsum/ng)*(gsum/ng), 0)) ELSE 0 END AS rough, coalesce(gmin, zg) - trend AS dip, zmax - zg AS obsh, zomin - zg AS clear FROM k)
SELECT ix, iy, round(rough, 6) AS rough, dip, obsh, clear, gdist < 2.0 AND NOT (obsh > 0.12 AND NOT (coalesce(clear > 2.2, true) AND gdist < 2.0 AND coalesce(zray - zg < 2.2, false))) AND step < 0.12 AND dip > -0.10 AND rough < 0.08 AS trav FROM e""")
def traversable_flat(spark: SparkSession, d: str) -> DataFrame:
    c = grid.quantise(fx.points(spark, d), 0.4).withColumns({"zg": F.lit(-1.75), "trend": F.lit(-1.75), "gdist": F.abs("ix") % 5 * 0.5, "zray": F.when(F.abs("iy") % 3 > 0, -1.0), "step": F.lit(0.05)})
    return grid.derived(c).select("ix", "iy", F.round("rough", 6).alias("rough"), "dip", "obsh", "clear", grid.traversable().alias("trav"))


@_add("q_raster_derive")
def raster_derive(spark: SparkSession, d: str) -> DataFrame:
    """The whole single-sweep query: tiers, ground raster, visibility, derived fields, traversability."""
    p = fx.points(spark, d).where(F.col("x") * F.col("x") + F.col("y") * F.col("y") < 100.0 * 100.0)
    cells = grid.foveate(grid.quantise(p, keys=("frame",)), ("frame",))
    surface = raster.ground_surfaces(grid.ground_percentile(p, keys=("frame",)), ["frame"])
    m = raster.bilinear(cells, surface, ["frame"], ["height", "gdist", "step", "trend"]).withColumnRenamed("height", "zg")
    m = grid.ray_low(grid.derived(m), grid.visibility(p, ("frame",)), keys=("frame",))
    return m.select("frame", "lvl", "px", "py", "n", "zg", "gdist", "step", "trend", "rough", "dip", "obsh", "clear", "zray", grid.majority().alias("cls"), grid.traversable().alias("trav"))


_RI = "cast(floor(least(sqrt(sqrt(x*x+y*y)/70.0::DOUBLE), 0.999::DOUBLE)*24) as bigint)"
_AI = "least(greatest(cast(floor((atan2(y, x)+pi())/(2*pi())*72) as bigint), 0), 71)"
_PLANES = f"""sp AS (SELECT *, {_RI} AS ri, {_AI} AS ai FROM points WHERE sqrt(x*x+y*y) <= 70),
r0 AS (SELECT *, row_number() OVER (PARTITION BY frame, ri, ai ORDER BY z, ok, pk, sk, ln) AS rk, count(*) OVER (PARTITION BY frame, ri, ai) AS cnt FROM sp),
r1 AS (SELECT *, greatest(cast(floor(cnt*0.25::DOUBLE) as int), 3) AS s0 FROM r0 WHERE cnt >= 8),
r2 AS (SELECT *, CASE WHEN max(CASE WHEN rk = s0 THEN z END) OVER (PARTITION BY frame, ri, ai) - min(z) OVER (PARTITION BY frame, ri, ai) > 1.0 THEN greatest(s0//2, 3) ELSE s0 END AS s1 FROM r1),
q AS (SELECT frame, ri, ai, count(*)::DOUBLE AS n, sum(x) sx, sum(y) sy, sum(z) sz, sum(x*x) xx, sum(x*y) xy, sum(y*y) yy, sum(x*z) xz, sum(y*z) yz FROM r2 WHERE rk <= s1 GROUP BY ALL),
d0 AS (SELECT *, sz/n AS mean, xx*(yy*n-sy*sy) - xy*(xy*n-sy*sx) + sx*(xy*sy-yy*sx) AS det, xz*(yy*n-sy*sy) - xy*(yz*n-sy*sz) + sx*(yz*sy-yy*sz) AS da, xx*(yz*n-sz*sy) - xz*(xy*n-sy*sx) + sx*(xy*sz-yz*sx) AS db, xx*(yy*sz-yz*sy) - xy*(xy*sz-yz*sx) + xz*(xy*sy-yy*sx) AS dc FROM q),
d1 AS (SELECT frame, ri, ai, mean, CASE WHEN abs(det) < 1e-12 THEN 0 ELSE da/det END AS a, CASE WHEN abs(det) < 1e-12 THEN 0 ELSE db/det END AS b, CASE WHEN abs(det) < 1e-12 THEN mean ELSE dc/det END AS c FROM d0),
d2 AS (SELECT frame, ri, ai, sqrt(a*a+b*b) > 0.35::DOUBLE AS steep, mean, a, b, c FROM d1),
d3 AS (SELECT frame, ri, ai, CASE WHEN steep THEN 0 ELSE a END AS a, CASE WHEN steep THEN 0 ELSE b END AS b, CASE WHEN steep THEN mean ELSE c END AS c FROM d2),
planes AS (SELECT frame, ri, ai, CASE WHEN o THEN 0 ELSE a END AS a, CASE WHEN o THEN 0 ELSE b END AS b, CASE WHEN o THEN -1.73::DOUBLE ELSE c END AS c FROM (SELECT *, c > 1.5::DOUBLE-1.73::DOUBLE OR c < -2.0::DOUBLE-1.73::DOUBLE AS o FROM d3)),
g AS (SELECT p.*, a, b, c, {_RI.replace('x', 'p.x').replace('y', 'p.y').replace('map.x', 'max')} AS ri, {_AI.replace('atan2(y, x)', 'atan2(p.y, p.x)')} AS ai FROM points p LEFT JOIN planes s ON s.frame = p.frame AND sqrt(p.x*p.x+p.y*p.y) <= 70 AND s.ri = {_RI.replace('x*x+y*y', 'p.x*p.x+p.y*p.y')} AND s.ai = {_AI.replace('atan2(y, x)', 'atan2(p.y, p.x)')})"""
_PLANES = _PLANES.replace(_PLANES[_PLANES.index("g AS (SELECT p.*"):], f"g AS (SELECT p.*, s.a, s.b, s.c, p.z - coalesce(s.a*p.x+s.b*p.y+s.c, -1.73::DOUBLE) AS agl, coalesce(p.z - (s.a*p.x+s.b*p.y+s.c) < 0.25::DOUBLE, false) AS ground FROM (SELECT *, CASE WHEN sqrt(x*x+y*y) <= 70 THEN {_RI} END AS ri, CASE WHEN sqrt(x*x+y*y) <= 70 THEN {_AI} END AS ai FROM points) p LEFT JOIN planes s ON s.frame = p.frame AND s.ri = p.ri AND s.ai = p.ai)")
_STATS = f"""{_PLANES},
f1 AS (SELECT frame, ri, ai, median(agl) AS md, avg(x) AS mx, avg(y) AS my, count(*) AS n FROM g WHERE ground AND a IS NOT NULL GROUP BY ALL),
f2 AS (SELECT g.frame, g.ri, g.ai, 1.4826::DOUBLE*median(abs(agl-md)) AS mad FROM g JOIN f1 USING (frame, ri, ai) WHERE ground AND a IS NOT NULL GROUP BY ALL),
sectors AS (SELECT p.frame, p.ri, p.ai, sqrt(a*a+b*b) AS slope, CASE WHEN n > 4 THEN mad ELSE 0 END AS rough, CASE WHEN n > 4 THEN a*mx+b*my+c ELSE 0 END AS h, coalesce(n, 0) AS n FROM planes p LEFT JOIN f1 USING (frame, ri, ai) LEFT JOIN f2 USING (frame, ri, ai))"""


#: All sweeps as one, so that sectors hold enough points to be graded.
_POOLED = PTS.replace("cast(sk%10 as int) frame", "0 AS frame")


def _sectors(spark: SparkSession, d: str, pooled: bool = False) -> DataFrame:
    p = fx.points(spark, d)
    p = p.withColumn("frame", F.lit(0)) if pooled else p
    return sectors.sectors(p, ("frame",))


@_add("q_sector_ground", f"WITH {PTS}, {_STATS} SELECT frame, ri, ai, round(slope, 7) + 0.0 AS slope, round(rough, 7) + 0.0 AS rough, round(h, 7) + 0.0 AS h, n FROM sectors")
def sector_ground(spark: SparkSession, d: str) -> DataFrame:
    return _sectors(spark, d).select("frame", "ri", "ai", *[(F.round(c, 7) + 0.0).alias(c) for c in ("slope", "rough", "h")], "n")


@_add("q_ground_points", f"WITH {PTS}, {_PLANES} SELECT frame, ground, count(*) AS n, round(avg(agl), 6) AS mean_agl FROM g GROUP BY ALL")
def ground_share(spark: SparkSession, d: str) -> DataFrame:
    p = fx.points(spark, d)
    g = sectors.ground_points(p, ("frame",))
    return g.groupBy("frame", "ground").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("agl"), 6).alias("mean_agl"))


_STEP = f"""{_STATS}, mv(dr, da) AS (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)),
st AS (SELECT s.frame, s.ri, s.ai, max(abs(s.h - o.h)) AS step FROM sectors s, mv, sectors o WHERE s.n >= 5 AND o.n >= 5 AND o.frame = s.frame AND o.ri = s.ri + dr AND o.ai = (s.ai + da + 72) % 72 GROUP BY ALL),
feat AS (SELECT s.*, coalesce(step, 0) AS step, pow((s.ri + 0.5)/24, 2.0)*70.0 AS range, degrees(atan(slope)) AS slope_deg, s.n >= 20 AS valid FROM sectors s LEFT JOIN st USING (frame, ri, ai)),
scored AS (SELECT *, CASE WHEN valid THEN greatest(rough/0.020::DOUBLE, step/(0.10::DOUBLE+0.00008::DOUBLE*range*range), slope_deg/15.0) END AS score,
 CASE WHEN NOT valid THEN 3 ELSE least((slope_deg > 15.0)::INT + (step > 0.10::DOUBLE+0.00008::DOUBLE*range*range)::INT + (rough > 0.020::DOUBLE)::INT, 2) END AS votes FROM feat)"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return drive.polar_score(sectors.sector_step(_sectors(spark, d, pooled=True), ("frame",)))


@_add("q_sector_step", f"WITH {PTS}, {_STEP} SELECT frame, ri, ai, round(step, 7) + 0.0 AS step FROM feat")
def sector_step(spark: SparkSession, d: str) -> DataFrame:
    return sectors.sector_step(_sectors(spark, d), ("frame",)).select("frame", "ri", "ai", (F.round("step", 7) + 0.0).alias("step"))


@_add("q_polar_drivability", f"WITH {_POOLED}, {_STEP} SELECT frame, ri, ai, n, round(score, 7) + 0.0 AS score, votes, CASE WHEN score IS NULL THEN 3 WHEN score <= 1 THEN 0 WHEN score <= 2 THEN 1 ELSE 2 END AS cls FROM scored")
def polar_drivability(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("frame", "ri", "ai", "n", (F.round("score", 7) + 0.0).alias("score"), "votes", drive.banded(F.col("score")).alias("cls"))


@_add("q_polar_smooth", f"""WITH {_POOLED}, {_STEP}, mv5(dr, da) AS (VALUES (0, 1), (0, -1), (1, 0), (-1, 0), (0, 0)),
sm AS (SELECT s.frame, s.ri, s.ai, median(o.score) AS smooth FROM scored s, mv5, scored o WHERE o.frame = s.frame AND o.ri = least(greatest(s.ri + dr, 0), 23) AND o.ai = (s.ai + da + 72) % 72 GROUP BY ALL)
SELECT s.frame, s.ri, s.ai, CASE WHEN s.score IS NOT NULL THEN round(smooth, 7) + 0.0 END AS smooth FROM scored s LEFT JOIN sm USING (frame, ri, ai)""")
def polar_smooth(spark: SparkSession, d: str) -> DataFrame:
    return sectors.polar_smooth(_scored(spark, d), ("frame",)).select("frame", "ri", "ai", (F.round("smooth", 7) + 0.0).alias("smooth"))


@_add("q_kerb", f"WITH {_POOLED}, {_STEP} SELECT frame, ri, ai, n FROM scored WHERE valid AND round(step, 6) BETWEEN 0.06 AND 0.30 AND rough < 0.12 AND slope_deg < 20.0")
def kerb(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).withColumn("step", F.round("step", 6)).where(drive.kerb()).select("frame", "ri", "ai", "n")


@_add("q_point_class", f"WITH {PTS}, {_STEP}, gg AS (SELECT g.ground, s.votes FROM (SELECT g.*, {_RI} AS ri, {_AI} AS ai FROM g) g LEFT JOIN scored s ON s.frame = g.frame AND s.ri = g.ri AND s.ai = g.ai AND sqrt(x*x+y*y) <= 70) SELECT CASE WHEN ground THEN coalesce(votes, 3) ELSE 3 END::INT AS cls, count(*) AS n FROM gg GROUP BY ALL")
def point_class(spark: SparkSession, d: str) -> DataFrame:
    """Every point with its sector's verdict."""
    p = fx.points(spark, d)
    s = drive.polar_score(sectors.sector_step(sectors.sectors(p, ("frame",)), ("frame",)))
    g = drive.remove_ground(p, s.select("frame", "ri", "ai", "a", "b", "c"), ("frame",))
    lifted = g.join(s.select("frame", "ri", "ai", F.col("votes").alias("cls")), ["frame", "ri", "ai"], "left")
    return lifted.groupBy(drive.point_class().cast("int").alias("cls")).agg(F.count(F.lit(1)).alias("n"))


_TRACKED = """WITH e AS (SELECT user_id, list({'k': event_id, 'v': CASE WHEN event_id % 7 = 0 THEN NULL ELSE value/100 END} ORDER BY event_id) AS l FROM events GROUP BY user_id),
f AS (SELECT user_id, unnest(list_transform(range(1, len(l)+1), lambda i: l[i].k)) AS event_id,
 unnest(list_transform(range(1, len(l)+1), lambda i: list_reduce(list_transform(l[1:i], lambda e: e.v), lambda a, b: CASE WHEN b IS NULL THEN a WHEN a IS NULL THEN b ELSE 0.4::DOUBLE*b + (1 - 0.4::DOUBLE)*a END))) AS ema FROM e),
g AS (SELECT *, row_number() OVER w AS rn, coalesce(abs(ema - 1) < 0.15 OR abs(ema - 2) < 0.15, false) AS near, CASE WHEN ema IS NULL THEN 3 WHEN ema <= 1 THEN 0 WHEN ema <= 2 THEN 1 ELSE 2 END AS band FROM f WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, round(ema, 6) AS ema, last_value(CASE WHEN rn = 1 OR NOT near THEN band END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS cls FROM g"""


@_add("q_ema_tracker", _TRACKED)
def ema_tracker(spark: SparkSession, d: str) -> DataFrame:
    e = fx.table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_id") % 7 != 0, F.col("value") / 100).alias("v"))
    return drive.tracked(e, ["user_id"], "event_id", "v").select("user_id", "event_id", F.round("ema", 6).alias("ema"), "cls")


@_add("q_tracker_stream", _TRACKED)
def tracker_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same over a stream in three micro-batches, with the mean and the class of each key in the state store."""
    from sweepgrid.sources.workspace import work_folder
    from sweepgrid.streaming import tracker

    folder = work_folder(spark, "tracker")
    e = fx.table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_id") % 7 != 0, F.col("value") / 100).alias("v"))
    low, high = e.select(F.min("event_id"), F.max("event_id")).first()
    for k in range(3):
        part = e.where(F.expr(f"(event_id - {low}) * 3 div ({high} - {low} + 1) = {k}")) if low is not None else e.limit(0)
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    tracker.write(stream, ["user_id"], "event_id", "v", f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema("user_id BIGINT, event_id BIGINT, ema DOUBLE, cls INT").parquet(f"{folder}/out").withColumn("ema", F.round("ema", 6))


@_add("q_cpu_delta", """WITH t AS (SELECT user_id AS pid, event_id, epoch_us(ts)/1e6 AS t, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS cpu FROM events),
l AS (SELECT pid, list({'t': t, 'cpu': cpu, 'bt': t, 'bc': cpu, 'v': NULL::DOUBLE} ORDER BY t, cpu) AS l FROM t GROUP BY pid),
f AS (SELECT pid, unnest(list_transform(range(1, len(l)+1), lambda i: list_reduce(l[1:i], lambda a, b: {'t': b.t, 'cpu': b.cpu, 'bt': CASE WHEN b.t - a.bt >= 0.25 THEN b.t ELSE a.bt END, 'bc': CASE WHEN b.t - a.bt >= 0.25 THEN b.cpu ELSE a.bc END, 'v': CASE WHEN b.t - a.bt >= 0.25 THEN greatest(b.cpu - a.bc, 0)/(b.t - a.bt) END}))) AS s FROM l)
SELECT pid, s.t AS t, round(s.v, 6) AS cores FROM f""")
def cpu_delta(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    t = fx.table(spark, d, "events").select(F.col("user_id").alias("pid"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), F.sum("value").over(w).alias("cpu"))
    return quality.cores_used(t, "pid", "t", "cpu").withColumn("cores", F.round("cores", 6))


@_add("q_frame_stats", """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS k FROM events)
SELECT event_type, count(*) AS frames, round(median(value), 6) AS median_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms, round(quantile_cont(value, 0.99), 6) AS p99_ms FROM r WHERE k <= 120 GROUP BY ALL""")
def frame_stats(spark: SparkSession, d: str) -> DataFrame:
    out = quality.frame_times(fx.table(spark, d, "events"), "event_type", "event_id", "value")
    return out.select("event_type", "frames", *[F.round(c, 6).alias(c) for c in ("median_ms", "p95_ms", "p99_ms")])


@_add("q_frame_windows", """SELECT event_type, date_diff('day', DATE '1970-01-01', ts::DATE)::BIGINT AS day, count(*) AS frames, round(median(value), 6) AS median_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms, round(quantile_cont(value, 0.99), 6) AS p99_ms, round(1000/greatest(median(value), 1e-6), 6) AS fps FROM events GROUP BY ALL""")
def frame_windows(spark: SparkSession, d: str) -> DataFrame:
    """Frame times by day of a stream in four micro-batches, some samples sent twice; each day as it is written when it is over."""
    from sweepgrid.sources.workspace import work_folder
    from sweepgrid.streaming import telemetry

    folder, e = work_folder(spark, "telemetry"), fx.table(spark, d, "events").select("event_type", "event_id", F.expr("timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', ts))").alias("ts"), "value")
    cuts = e.agg(F.percentile_approx("event_id", [0.25, 0.5, 0.75], 1000)).first()[0] or []
    low = F.lit(True)
    for high in [*cuts, None]:
        part = e.where(low & (F.col("event_id") <= high) if high is not None else low)
        part.unionByName(part.where("event_id % 10 = 0")).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        low = F.col("event_id") > high if high is not None else low
    telemetry.closing(e, "ts", "1 day", "40 days").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    telemetry.write(stream, f"{folder}/out", f"{folder}/checkpoint", "event_type", "ts", "value", "event_id", "1 day", "40 days").awaitTermination()
    names = ("median_ms", "p95_ms", "p99_ms", "fps")
    out = spark.read.schema("event_type STRING, start TIMESTAMP, frames BIGINT, " + ", ".join(f"{c} DOUBLE" for c in names)).parquet(f"{folder}/out")
    return out.select("event_type", F.expr("unix_micros(start) div 86400000000").alias("day"), "frames", *[F.round(c, 6).alias(c) for c in names])


@_add("q_validate_scan", f"""WITH {WIDE}, b AS (SELECT frame, least(cast(floor((z+5)/0.05::DOUBLE) as bigint), 199) AS b, count(*) AS c FROM points WHERE z BETWEEN -5 AND 5 GROUP BY ALL),
m AS (SELECT frame, arg_max(b, c*1000 - b) AS bin FROM b GROUP BY ALL), s AS (SELECT frame, count(*) AS n, min(lab/7.0::DOUBLE) AS i_min, max(lab/7.0::DOUBLE) AS i_max, max(x*x+y*y) AS max_r2 FROM points GROUP BY ALL)
SELECT s.*, bin*0.05::DOUBLE - 5 AS modal_z, abs(-(bin*0.05::DOUBLE-5) - 1.73) > 0.5 AS warn_height, i_max > 1.001 OR i_max - i_min < 1e-6 AS warn_intensity, n < 60000 AS warn_density FROM s LEFT JOIN m USING (frame)""")
def validate_scan(spark: SparkSession, d: str) -> DataFrame:
    return quality.validate_scans(fx.points(spark, d, fx.WIDE), ["frame"], 1.73, F.col("lab") / F.lit(7.0))


@_add("q_half_sweeps", f"WITH {PTS} SELECT frame, round(avg((y < -1e-3)::INT), 9) AS share, avg((y < -1e-3)::INT) < 0.01 OR avg((y < -1e-3)::INT) > 0.99 AS half FROM points GROUP BY ALL")
def half_sweeps(spark: SparkSession, d: str) -> DataFrame:
    return quality.half_sweeps(fx.points(spark, d)).select("frame", F.round("share", 9).alias("share"), "half")


_NOISE = """np AS (SELECT frame, x, y, z FROM points WHERE lab IN (0,1) AND x*x+y*y < 64), nm AS (SELECT frame, count(*) n, avg(x) mx, avg(y) my, avg(z) mz FROM np GROUP BY ALL HAVING count(*) >= 50),
nd AS (SELECT frame, n, x-mx AS x, y-my AS y, z-mz AS z FROM np JOIN nm USING (frame)), ns AS (SELECT frame, first(n) n, sum(x*x) xx, sum(x*y) xy, sum(y*y) yy, sum(x*z) xz, sum(y*z) yz, sum(z*z) zz FROM nd GROUP BY ALL),
nf AS (SELECT *, (xz*yy-yz*xy)/(xx*yy-xy*xy) AS a, (xx*yz-xy*xz)/(xx*yy-xy*xy) AS b FROM ns), r AS (SELECT sqrt(greatest(zz-a*xz-b*yz, 0)/n) AS residual, degrees(atan(sqrt(a*a+b*b))) AS tilt_deg FROM nf)"""


@_add("q_quality_checks", f"""WITH {PTS}, p AS (SELECT frame, count(*) n, avg((y < -1e-3)::INT) s, count(*) FILTER (lab=6) w, avg((lab/7.0::DOUBLE > 0.9)::INT) sat, max(lab) l FROM points GROUP BY ALL),
a AS (SELECT count(*) frames, count(*) FILTER (s < 0.01 OR s > 0.99) half, sum(w) walkers, avg(n) density, avg(sat) sat, count(*) FILTER (l > 0) labelled FROM p),
{_NOISE}, z AS (SELECT median(residual) AS noise FROM r)
SELECT unnest(['half_sweeps','pedestrians','depressions','grid_labels','metadata','density','intensity','range_noise']) AS "check", unnest([half, walkers, 4, labelled, 10, floor(density), round_even(sat*1000, 0), round_even(noise*1000, 0)]::BIGINT[]) AS value, unnest([half = 0, walkers > 0, true, labelled = frames, frames = 10, density >= 84700, sat < 0.5, coalesce(noise <= 0.04, true)]) AS ok FROM a, z""")
def quality_checks(spark: SparkSession, d: str) -> DataFrame:
    meta = spark.range(fx.FRAMES).select(F.col("id").cast("int").alias("frame"), (F.col("id") % 2).alias("inside"), (F.col("id") % 5 / F.lit(4.0)).alias("depth"))
    return quality.capture_checks(fx.points(spark, d), meta, F.col("lab") / F.lit(7.0), F.col("lab") == 6)


@_add("q_quality_report", f"""WITH c AS ({ORACLES['q_quality_checks']}) SELECT count(*) FILTER (NOT ok) AS failed, to_json(list({{'check': "check", 'value': value, 'ok': ok}} ORDER BY "check"))::VARCHAR AS report FROM c""")
def quality_report(spark: SparkSession, d: str) -> DataFrame:
    return sinks.report(quality_checks(spark, d))


@_add("q_range_noise", f"""WITH {PTS}, {_NOISE}
SELECT count(*) AS frames, round(median(residual), 6) AS residual, round(median(tilt_deg), 6) AS tilt_deg FROM r""")
def range_noise(spark: SparkSession, d: str) -> DataFrame:
    p = fx.points(spark, d).where(geo.is_ground() & (F.col("x") * F.col("x") + F.col("y") * F.col("y") < 64))
    r = quality.plane_residual(p, ["frame"])
    return r.agg(F.count(F.lit(1)).alias("frames"), F.round(F.median("residual"), 6).alias("residual"), F.round(F.median("tilt_deg"), 6).alias("tilt_deg"))
