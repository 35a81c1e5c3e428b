"""Table functions from SQL, and tracks in the state store."""

import random

import pytest
from pyspark.sql import functions as F
from sweepgrid.operators import cluster, drive, sectors, tables
from sweepgrid.plans import catalogue
from sweepgrid.sources import fixtures as fx
from sweepgrid.streaming import tracker

SF = "/root/testdata/sf0.01"


def test_clusters_by_sql(spark):
    got = catalogue.queries()["q_sweep_clusters_sql"](spark, SF)
    p = sectors.ground_points(fx.points(spark, SF), ("frame",)).where("NOT ground")
    want = cluster.cluster_points(p, ["frame"], 0.35, 8, 6000).where("cluster_id IS NOT NULL").groupBy("frame", "cluster_id")
    want = want.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{c}{k}") for c in "xyz" for k, f in ((0, F.min), (1, F.max))])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect())) and got.count() > 3


def test_table_functions_say_what_they_miss(spark):
    tables.register(spark)
    for sql in ("SELECT * FROM sweep_clusters(TABLE(SELECT 1 AS frame, 2.0D AS x), 0.3D, 8, 60)", "SELECT * FROM sweep_clusters(TABLE(SELECT 1 AS frame, 2.0D AS x, 1D AS y, 1D AS z), -1D, 8, 60)"):
        with pytest.raises(Exception, match="have no y, z|positive constant"):
            spark.sql(sql).collect()
    assert spark.sql("SELECT * FROM box_buckets(0D, 0D, 3D, 4D, 0D, 4D)").count() == 4
    assert spark.sql("SELECT * FROM box_buckets(NULL, 0D, 3D, 4D, 0D, 4D)").count() == 0


def test_tracks_for_any_cut_and_after_a_restart(spark, tmp_path):
    r = random.Random(3)
    rows = [(s, k, None if r.random() < 0.2 else r.choice([0.9, 1.1, 1.0, 2.05, 1.9, 3.0])) for s in range(6) for k in range(40)]
    rows[0] = (0, 0, None)
    df = spark.createDataFrame(rows, "s INT, k BIGINT, v DOUBLE")
    want = sorted((x.s, x.k, None if x.ema is None else round(x.ema, 9), x.cls) for x in drive.tracked(df, ["s"], "k", "v").collect())
    for cut in ([40], [3, 4, 40]):
        folder, low = f"{tmp_path}/{len(cut)}", 0
        for high in cut:  # a query for each part: every one but the first is a restart
            df.where(F.col("k").between(low, high - 1)).coalesce(1).write.mode("append").parquet(f"{folder}/in")
            tracker.write(spark.readStream.schema(df.schema).parquet(f"{folder}/in"), ["s"], "k", "v", f"{folder}/out", f"{folder}/c").awaitTermination()
            low = high
        got = spark.read.parquet(f"{folder}/out").collect()
        assert sorted((x.s, x.k, None if x.ema is None else round(x.ema, 9), x.cls) for x in got) == want
    late = spark.createDataFrame([(0, 5, 9.0), (0, 40, None)], df.schema)
    late.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    tracker.write(spark.readStream.schema(df.schema).parquet(f"{folder}/in"), ["s"], "k", "v", f"{folder}/out", f"{folder}/c").awaitTermination()
    extra = sorted((x.k, x.cls) for x in spark.read.parquet(f"{folder}/out").where("s = 0 AND k IN (5, 40)").collect() if (x.k, x.cls) not in [(w[1], w[3]) for w in want if w[0] == 0 and w[1] == 5])
    assert extra[0] == (5, None) and extra[1][0] == 40 and extra[1][1] == [w[3] for w in want if w[0] == 0][-1]


def test_a_sweep_is_held_as_numbers():
    """A task holds three numbers a point (each in 8 bytes), not objects."""
    import tracemalloc

    from sweepgrid.operators import tables

    one = tables.SweepClusters.func()
    tracemalloc.start()
    for k in range(20_000):
        one.eval({"frame": 1, "x": k / 7, "y": float(k % 5), "z": k / 9}, 0.5, 1, 10**6)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 40 * 20_000
    got = list(one.terminate())
    assert sum(g[2] for g in got) == 20_000 and (got[0][3], max(g[6] for g in got), max(g[8] for g in got)) == (0.0, 4.0, 19_999 / 9)
