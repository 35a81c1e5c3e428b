"""Frame times by windows of event time, and map statistics from sketches."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from sweepgrid.operators import worldmap
from sweepgrid.streaming import telemetry
from sweepgrid.streaming.tables import WorldTable
from test_worldmap import drive

T0 = dt.datetime(2024, 5, 1)
SCHEMA = "sensor STRING, frame BIGINT, ts TIMESTAMP, ms DOUBLE"


def sample(frame, second, ms, sensor="a"):
    return (sensor, frame, T0 + dt.timedelta(seconds=second), float(ms))


def fed(spark, folder, batches):
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")  # a query for each, so all but the first are restarts
        telemetry.write(stream, f"{folder}/out", f"{folder}/c", "sensor", "ts", "ms", "frame", "10 seconds", "5 seconds").awaitTermination()
    out = spark.read.schema("sensor STRING, start TIMESTAMP, frames BIGINT, median_ms DOUBLE, p95_ms DOUBLE, p99_ms DOUBLE, fps DOUBLE").parquet(f"{folder}/out")
    return {(r.sensor, (r.start - T0).total_seconds()): r for r in out.collect() if r.sensor is not None}


def test_repeated_samples_count_once_and_late_ones_not_at_all(spark, tmp_path):
    first = [sample(k, k, 20 + k) for k in range(12)]
    again = [sample(k, k, 20 + k) for k in (8, 9, 11)] + [sample(12, 12, 50)]  # sent twice
    tardy = [sample(100, 9, 1000), sample(13, 40, 60)]  # out of order, but within the lateness
    late = [sample(101, 5, 5000), sample(102, 28, 5000), sample(14, 41, 61)]  # behind the watermark of 35 s
    close = telemetry.closing(spark.createDataFrame([sample(14, 41, 61)], SCHEMA), "ts", "10 seconds", "5 seconds").collect()
    got = fed(spark, tmp_path, [first, again, tardy, late, [tuple(r) for r in close]])
    assert {k[1]: r.frames for k, r in got.items()} == {0: 11, 10: 3, 40: 2}
    assert got["a", 0].median_ms == pytest.approx(np.median([*range(20, 30), 1000])) and got["a", 10].p95_ms == pytest.approx(np.percentile([30, 31, 50], 95))
    assert got["a", 40].fps == pytest.approx(1000 / 60.5)


def test_a_table_has_the_same_windows(spark):
    rows = [sample(k, k / 3, random.Random(k).random() * 50, "ab"[k % 2]) for k in range(90)]
    got = telemetry.frame_windows(spark.createDataFrame(rows + rows[:5], SCHEMA), "sensor", "ts", "ms", "frame", "10 seconds").collect()
    assert len(got) == 6 and all(r.frames == 15 for r in got)
    one = next(r for r in got if r.sensor == "a" and r.start == T0)
    assert one.median_ms == pytest.approx(np.median([r[3] for r in rows if r[0] == "a" and r[2] < T0 + dt.timedelta(seconds=10)]))


def test_sketches_of_tiles_give_the_map_s_statistics(spark, tmp_path):
    points, poses = (spark.createDataFrame(t).withColumn("frame", F.col("frame").cast("int")) for t in drive([(0, 0), (30, 5), (75, 0), (100, 40)], 4000))
    table = WorldTable(spark, str(tmp_path / "m"), res=0.8, tile=16, align=False, sketches=True)
    table.ingest_all(points, poses)
    exact, got = worldmap.map_stats(table.read()).first(), table.stats().first()
    assert got.cells == exact.cells and got.single_share == pytest.approx(exact.single_share)
    n = np.sort([r.n for r in table.read().select("n").collect()])
    for value, q in ((got.median_obs, 0.5), (got.p90_obs, 0.9)):
        low, high = (np.searchsorted(n, value, side) / len(n) for side in ("left", "right"))
        assert low - 0.03 <= q <= high + 0.03  # sketches of 200 err by less than 0.03 of the ranks
    assert "sketch" in "".join(table.stats().inputFiles()) and any(t["cuts"] for t in table.state["tiles"].values())
    plain = WorldTable(spark, str(tmp_path / "m"), res=0.8, tile=16, align=False)
    assert tuple(plain.stats().first())[0] == exact.cells


def test_rank_error_of_many_merged_sketches(spark):
    cells = spark.range(200_000).select((F.col("id") % 500).alias("tile"), (F.pmod(F.xxhash64("id"), F.lit(100_000))).alias("n"))
    got = worldmap.merged_stats(worldmap.map_sketches(cells, ["tile"])).first()
    assert abs(got.median_obs / 100_000 - 0.5) < 0.03 and abs(got.p90_obs / 100_000 - 0.9) < 0.03 and got.cells == 200_000
