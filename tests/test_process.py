"""A whole sweep's way against its parts, and what had no test of its own."""

import pandas as pd
import pytest
from pyspark.sql import functions as F
from sweepgrid.operators import drive, labelling, worldmap
from sweepgrid.sources import fixtures as fx
from sweepgrid.sources import readers, sinks
from sweepgrid.streaming.process import STAGES, SweepProcess
from sweepgrid.streaming.tables import WorldTable

SF = "/root/testdata/sf0.01"


def test_a_sweep_is_its_stages(spark, tmp_path):
    points, poses = fx.points(spark, SF).where("frame < 2"), fx.poses(spark)
    table = labelling.class_table(spark, ["Background", "Car", "Pedestrian"])
    run = SweepProcess(WorldTable(spark, str(tmp_path / "a"), res=1.6), table, voxel=0.35, least=8, min_points=3)
    sweeps = list(run.all(points, poses))
    assert [s.frame for s in sweeps] == [0, 1] and all(list(s.ms) == list(STAGES) and min(s.ms.values()) > 0 for s in sweeps)
    want = labelling.label_points(points, ["frame"], table, voxel=0.35, least=8)
    count = lambda d: sorted(map(tuple, d.groupBy("frame", "grid", "provenance").count().collect()))
    assert count(sweeps[0].points.unionByName(sweeps[1].points)) == count(want)
    assert sum(sweeps[0].counts.values()) == sweeps[0].boxes.count() > 0
    other = WorldTable(spark, str(tmp_path / "b"), res=1.6)
    other.ingest_all(want.withColumns({"lab": F.col("grid"), "moving": F.col("grid").isin(5, 6)}), poses)
    key = lambda d: sorted((r.ix, r.iy, r.n, r.ng, round(r.gw, 6), round(r.zmax, 6)) for r in d.collect())
    assert key(run.world.read()) == key(other.read())
    at = poses.where("frame = 1").first()
    graded = drive.cell_drivability(worldmap.near(other.read(), at.tx, at.ty, 1.6, 40.0), 1.6, sensor=(at.tx, at.ty), min_points=3, weighted=True)
    assert sorted((r.ix, r.iy, r.cls) for r in sweeps[1].cells.collect()) == sorted((r.ix, r.iy, r.cls) for r in graded.collect())
    assert sweeps[1].cells.where("cls <> 3").count() > 20


def test_frames_with_both_files(spark):
    scans = spark.createDataFrame([(f, 0.0) for f in (5, 2, 2, 9)], "frame BIGINT, x DOUBLE")
    meta = spark.createDataFrame([(2.0,), (5.0,), (7.0,)], "sample_id DOUBLE")
    assert [r.frame for r in readers.complete_frames(scans, meta).collect()] == [2, 5]


def test_last_row_of_a_frame_table(spark, tmp_path):
    for name, rows in (("a", [(1, 1.0), (2, 2.0), (1, 3.0)]), ("b", [(2, 4.0), (3, 5.0)])):
        pd.DataFrame(rows, columns=["sample_id", "ego_x"]).assign(image_path="p").to_csv(tmp_path / f"{name}.csv", index=False)
    got = readers.drive_table(spark, str(tmp_path))
    assert {r.sample_id: r.ego_x for r in got.collect()} == {1: 3.0, 2: 4.0, 3: 5.0} and got.columns == ["sample_id", "ego_x"]


def test_only_the_newest_row_is_kept(spark):
    target = {}
    for rows in ([(3, "c"), (1, "a")], [(2, "b")], [], [(7, "g"), (6, "f")]):
        sinks.latest_only(spark.createDataFrame(rows, "frame INT, payload STRING"), target)
    assert target == {"frame": 7, "payload": "g"}


def test_closest_pairs(spark):
    df = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.9), (2, 3, 0.5), (4, 5, 0.1)], "a INT, b INT, s DOUBLE")
    assert [(r.a, r.b) for r in labelling.closest(df, "s", ["a", "b"], 3).collect()] == [(1, 3), (1, 2), (2, 3)]
    assert labelling.closest(df.limit(0), "s", ["a", "b"], 3).count() == 0


def test_unknown_classes_stop(spark):
    with pytest.raises(KeyError):
        labelling.class_table(spark, ["Background", "Ship"])
