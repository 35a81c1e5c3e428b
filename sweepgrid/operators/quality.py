"""Acceptance checks of a capture and of single scans."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from sweepgrid.functions.geometry import is_ground

REFERENCE_POINTS = 121_000
NOISE_RADIUS, MAX_NOISE = 8.0, 0.040


def half_sweeps(points: DataFrame, frame: str = "frame") -> DataFrame:
    """Frames whose points lie on one side of the sensor: (frame, share, half)."""
    share = F.avg((F.col("y") < -1e-3).cast("double"))
    return points.groupBy(frame).agg(share.alias("share")).withColumn("half", (F.col("share") < 0.01) | (F.col("share") > 0.99))


def capture_checks(points: DataFrame, metadata: DataFrame, intensity: Column, walker: Column, frame: str = "frame") -> DataFrame:
    """(check, value, ok): one row a check over the points and the metadata table (frame, inside, depth).

    The last one is the ground's scatter in millimetres about the plane of each sweep within
    ``NOISE_RADIUS``, against the roughness that still counts as drivable; without ground there it passes.
    """
    ground = points.where(is_ground() & (F.col("x") * F.col("x") + F.col("y") * F.col("y") < NOISE_RADIUS * NOISE_RADIUS))
    noise = plane_residual(ground, [frame]).agg(F.median("residual").alias("noise"))
    per = points.groupBy(frame).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("y") < -1e-3).cast("double")).alias("share"), F.count_if(walker).alias("walkers"), F.avg(intensity).alias("mean_i"), F.avg((intensity > 0.9).cast("double")).alias("saturated"), F.max("lab").alias("lab"))
    a = per.agg(
        F.count(F.lit(1)).alias("frames"), F.count_if((F.col("share") < 0.01) | (F.col("share") > 0.99)).alias("half"), F.sum("walkers").alias("walkers"), F.avg("n").alias("density"),
        F.avg("saturated").alias("saturated"), F.count_if(F.col("lab") > 0).alias("labelled"),
    )
    m = metadata.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("inside") > 0).alias("inside"), F.countDistinct(F.when(F.col("depth") != 0, F.col("depth"))).alias("depths"))
    both = per.select(frame).join(metadata.select(frame), frame, "full").select(F.lit(1)).agg(F.count(F.lit(1)).alias("known"))
    one = a.join(F.broadcast(m)).join(F.broadcast(both)).join(F.broadcast(noise))  # four tables of one row
    rows = [
        ("half_sweeps", F.col("half"), F.col("half") == 0),
        ("pedestrians", F.col("walkers"), F.col("walkers") > 0),
        ("depressions", F.col("depths"), (F.col("inside") > 0) & (F.col("depths") > 1)),
        ("grid_labels", F.col("labelled"), (F.col("frames") > 0) & (F.col("labelled") == F.col("frames"))),
        ("metadata", F.col("rows"), (F.col("rows") == F.col("frames")) & (F.col("known") == F.col("frames"))),
        ("density", F.floor("density"), F.col("density") >= 0.7 * REFERENCE_POINTS),
        ("intensity", F.rint(F.col("saturated") * 1000), F.col("saturated") < 0.5),
        ("range_noise", F.rint(F.col("noise") * 1000), F.coalesce(F.col("noise") <= MAX_NOISE, F.lit(True))),
    ]
    packed = F.array(*[F.struct(F.lit(n).alias("check"), v.cast("bigint").alias("value"), ok.alias("ok")) for n, v, ok in rows])
    return one.select(F.explode(packed).alias("r")).select("r.*")


def plane_residual(points: DataFrame, keys: list[str], least: int = 50) -> DataFrame:
    """(keys, n, residual, tilt_deg) of the least-squares plane through each group's points, by moments."""
    mean = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{c}") for c in "xyz"]).where(F.col("n") >= least)
    d = points.join(mean, keys).select(*keys, "n", *[(F.col(c) - F.col(f"m{c}")).alias(c) for c in "xyz"])
    s = d.groupBy(*keys).agg(F.first("n").alias("n"), *[F.sum(F.col(a) * F.col(b)).alias(a + b) for a, b in ("xx", "xy", "yy", "xz", "yz", "zz")])
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    s = s.withColumns({"a": F.try_divide(F.col("xz") * F.col("yy") - F.col("yz") * F.col("xy"), det), "b": F.try_divide(F.col("xx") * F.col("yz") - F.col("xy") * F.col("xz"), det)})
    left = F.col("zz") - F.col("a") * F.col("xz") - F.col("b") * F.col("yz")
    return s.select(*keys, "n", F.sqrt(F.greatest(left, F.lit(0.0)) / F.col("n")).alias("residual"), F.degrees(F.atan(F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b")))).alias("tilt_deg"))


def validate_scans(points: DataFrame, keys: list[str], sensor_h: float, intensity: Column) -> DataFrame:
    """Per scan: n, modal_z (200 bins over ±5 m, the lowest on ties), ranges and warnings as flags."""
    b = F.least(F.floor((F.col("z") + 5) / F.lit(0.05)), F.lit(199))
    p = points.withColumn("__i", intensity)
    bins = p.where(F.col("z").between(-5, 5)).withColumn("b", b).groupBy(*keys, "b").agg(F.count(F.lit(1)).alias("c"))
    modal = bins.groupBy(*keys).agg((-F.max(F.struct("c", (-F.col("b")).alias("k")))["k"]).alias("bin"))
    s = p.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("__i").alias("i_min"), F.max("__i").alias("i_max"), F.max(F.col("x") * F.col("x") + F.col("y") * F.col("y")).alias("max_r2"))
    out = s.join(modal, keys, "left").withColumn("modal_z", F.col("bin") * 0.05 - 5)
    return out.withColumns({"warn_height": F.abs(-F.col("modal_z") - sensor_h) > 0.5, "warn_intensity": (F.col("i_max") > 1.001) | (F.col("i_max") - F.col("i_min") < 1e-6), "warn_density": F.col("n") < 60_000}).drop("bin")


def actors(points: DataFrame, keys: list[str], least: int = 20, ego: float = 4.0) -> DataFrame:
    """Hull of every actor's points: n, centre, extents along its main direction, yaw; the carrier itself goes."""
    from sweepgrid.operators.cluster import pca_yaw

    f = pca_yaw(points, keys).where(F.col("n") >= least).where(F.sqrt(F.col("mx") * F.col("mx") + F.col("my") * F.col("my")) >= ego)
    p = points.join(f, keys).withColumns({"__u": F.cos("yaw") * (F.col("x") - F.col("mx")) + F.sin("yaw") * (F.col("y") - F.col("my")), "__v": F.cos("yaw") * (F.col("y") - F.col("my")) - F.sin("yaw") * (F.col("x") - F.col("mx"))})
    return p.groupBy(*keys, "n", "mx", "my", "yaw").agg(((F.min("z") + F.max("z")) / 2).alias("cz"), (F.max("__u") - F.min("__u")).alias("l"), (F.max("__v") - F.min("__v")).alias("w"), (F.max("z") - F.min("z")).alias("h"))


def cores_used(samples: DataFrame, key: str, time: str, cpu: str, least: float = 0.25) -> DataFrame:
    """(key, time, cores) since the last sample that was published; negative differences count as none.

    A sample within ``least`` seconds of it has no value and leaves it as the baseline; one without
    CPU seconds ends it. The fold is sequential by nature and runs over each key's ordered samples.
    """

    def fold(t: pa.Table) -> pa.Table:
        t = t.sort_by([(time, "ascending"), (cpu, "ascending")])
        base, cores = None, []
        for now, used in zip(t.column(time).to_pylist(), t.column(cpu).to_pylist()):
            value = None
            if used is None or now is None:
                base = None
            elif base is None:
                base = now, used
            elif now - base[0] >= least:
                value = max(used - base[1], 0.0) / (now - base[0])
                base = now, used
            cores.append(value)
        return t.select([key, time]).append_column("cores", pa.array(cores, pa.float64()))

    rows = samples.select(key, F.col(time).cast("double").alias(time), F.col(cpu).cast("double").alias(cpu))
    schema = StructType([rows.schema[key], rows.schema[time], StructField("cores", DoubleType())])
    return rows.groupBy(key).applyInArrow(fold, schema)


def frame_summary(ms: str) -> list[Column]:
    """How many frames, the median, 95th and 99th percentile of their times, and the rate that the median allows."""
    median = F.median(ms)
    return [F.count(F.lit(1)).alias("frames"), median.alias("median_ms"), F.percentile(ms, F.lit(0.95)).alias("p95_ms"), F.percentile(ms, F.lit(0.99)).alias("p99_ms"), (1000.0 / F.greatest(median, F.lit(1e-6))).alias("fps")]


def frame_times(times: DataFrame, key: str, order: str, ms: str, last: int = 120) -> DataFrame:
    """Median, 95th and 99th percentile and rate of the last frames of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return times.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= last).groupBy(key).agg(*frame_summary(ms))
