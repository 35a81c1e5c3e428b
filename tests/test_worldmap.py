"""The world map: tiles of a table with a manifest, and tiles as keyed state; restarts, pruning, drift."""

import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from sweepgrid.functions import geometry as geo
from sweepgrid.operators import grid
from sweepgrid.sources import fixtures as fx
from sweepgrid.streaming import keyed
from sweepgrid.streaming.tables import WorldTable, _place
from world_state import RULES, folded

SF = "/root/testdata/sf0.001"


def rows_of(cells):
    cells = cells if isinstance(cells, pd.DataFrame) else cells.select("ix", "iy", *RULES).toPandas()
    return sorted((int(r.ix), int(r.iy), *(None if v != v or v is None else round(float(v), 6) + 0.0 for v in r[2:])) for r in cells[["ix", "iy", *RULES]].itertuples(index=False))


def drive(positions, n=3000, seed=1):
    """(points, poses) of sweeps along positions, without rotation; heights creep, some move."""
    r, points = np.random.default_rng(seed), []
    for f in range(len(positions)):
        xy = r.uniform(-25, 25, (n, 2)).round(3)
        points.append(pd.DataFrame({"frame": f, "x": xy[:, 0], "y": xy[:, 1], "z": (r.integers(0, 16, n) / 64 + f / 32), "lab": np.where(r.random(n) < 0.7, 0, r.integers(0, 7, n))}))
    poses = pd.DataFrame([(f, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, float(x), float(y), 0.0) for f, (x, y) in enumerate(positions)], columns=["frame", *[f"r{i}{j}" for i in range(3) for j in range(3)], "tx", "ty", "tz"])
    return pd.concat(points, ignore_index=True), poses


def sweeps_of(points, poses):
    for f, t in points.groupby("frame"):
        x, y = poses.loc[poses["frame"] == f, ["tx", "ty"]].iloc[0]
        yield t.assign(wx=t["x"] + x, wy=t["y"] + y, wz=t["z"]), x, y


@pytest.fixture(scope="module")
def route():
    """Out of reach of the start and back again."""
    return drive([(0, 0), (10, 5), (55, 8), (105, 8), (130, -20), (100, 0), (60, 0), (45, 3)])


@pytest.fixture(scope="module")
def frames(spark, route):
    return spark.createDataFrame(route[0]).withColumn("frame", F.col("frame").cast("int")), spark.createDataFrame(route[1]).withColumn("frame", F.col("frame").cast("int"))


@pytest.mark.parametrize("align,res,tile", [(True, 2.0, 8), (False, 0.4, 64)])
def test_table_is_the_folded_map(spark, tmp_path, route, frames, align, res, tile):
    want, drifts = folded(sweeps_of(*route), res=res, common=20, align=align)
    table = WorldTable(spark, f"file://{tmp_path}/a", res=res, common=20, align=align, tile=tile)
    table.ingest_all(*frames)
    assert rows_of(table.read()) == rows_of(want)
    assert table.version == 8 and [table.drifts[f] for f in range(8)] == pytest.approx(drifts)
    assert any(drifts) == align


def test_a_sweep_reads_and_writes_its_tiles_only(spark, tmp_path, frames):
    table = WorldTable(spark, str(tmp_path / "a"), res=1.0, tile=16, common=20)
    points, poses = frames
    before = {}
    for f in range(5):
        table.ingest_all(points.where(F.col("frame") == f), poses)
        now = table.state["tiles"]
        x = poses.where(F.col("frame") == f).first()
        for k, t in now.items():
            near = _place(k, x.tx, x.ty, 16.0, 20.1) != "out"
            assert near or t["files"] == before[k]["files"]  # beyond the trusted range, files stay
        written = {p.name for p in Path(tmp_path / "a/cells").iterdir() if p.name.startswith(f"{f + 1:012d}")}
        assert len(written) == 1
        assert {p.name for p in Path(tmp_path / "a/cells" / written.pop()).glob("tile=*")} <= {f"tile={k}" for k in now if _place(k, x.tx, x.ty, 16.0, 20.1) != "out"}
        before = now
    read = table._tiles({k: t for k, t in list(now.items())[:2]}).inputFiles()
    assert {f.split("tile=")[1].split("/")[0] for f in read} == set(list(now)[:2])
    # files of versions that nobody can read any more are gone
    held = {t["files"] for n in table.store.names("manifest") for t in table.store.get(f"manifest/{n}")["tiles"].values()}
    assert len(table.store.names("manifest")) == 3 and set(table.store.names("cells")) == held


def test_killed_run_resumes_at_the_committed_version(spark, tmp_path, route, frames, monkeypatch):
    want, _ = folded(sweeps_of(*route), res=2.0, common=20)
    folder, calls = str(tmp_path / "a"), []

    def dying(self, state, commit=WorldTable._commit):
        calls.append(state["version"])
        if len(calls) == 4:
            raise RuntimeError("killed between the files and the manifest")
        commit(self, state)

    monkeypatch.setattr(WorldTable, "_commit", dying)
    first = WorldTable(spark, folder, res=2.0, common=20)
    with pytest.raises(RuntimeError):
        first.ingest_all(*frames, source="drive")
    again = WorldTable(spark, folder, res=2.0, common=20)
    assert again.version == 3 and again.state["sources"] == {"drive": [0, 2]}
    again.ingest_all(*frames, source="drive")
    assert rows_of(again.read()) == rows_of(want) and sorted(again.drifts) == [3, 4, 5, 6, 7]
    again.ingest_all(*frames, source="drive")  # once more changes nothing
    assert again.version == 8 and rows_of(again.read()) == rows_of(want)


def test_another_process_goes_on(spark, tmp_path, route, frames):
    points, poses = frames
    folder = str(tmp_path / "a")
    WorldTable(spark, folder, res=2.0, common=20).ingest_all(points.where("frame < 3"), poses)
    route[0].to_parquet(tmp_path / "points.parquet")
    route[1].to_parquet(tmp_path / "poses.parquet")
    code = f"""
from pyspark.sql import SparkSession
from sweepgrid.streaming.tables import WorldTable
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate()
WorldTable(spark, {folder!r}, res=2.0, common=20).ingest_all(spark.read.parquet("file://{tmp_path}/points.parquet").where("frame >= 3"), spark.read.parquet("file://{tmp_path}/poses.parquet"))
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=240, env={**os.environ, "PYTHONPATH": os.environ["PYTHONPATH"]})
    want, _ = folded(sweeps_of(*route), res=2.0, common=20)
    assert rows_of(WorldTable(spark, folder, res=2.0).read()) == rows_of(want)


def test_stream_into_the_table(spark, tmp_path, route, frames, monkeypatch):
    points, poses = frames
    for low, high in ((0, 3), (3, 5), (5, 8)):
        points.where(F.col("frame").between(low, high - 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    calls = []

    def dying(self, state, commit=WorldTable._commit):
        calls.append(state["version"])
        if len(calls) == 5:
            raise RuntimeError("killed amid a micro-batch")
        commit(self, state)

    monkeypatch.setattr(WorldTable, "_commit", dying)
    table = WorldTable(spark, str(tmp_path / "a"), res=2.0, common=20)
    with pytest.raises(Exception, match="killed"):
        table.into(stream(), poses, str(tmp_path / "c")).awaitTermination()
    again = WorldTable(spark, str(tmp_path / "a"), res=2.0, common=20)
    again.into(stream(), poses, str(tmp_path / "c")).awaitTermination()
    want, _ = folded(sweeps_of(*route), res=2.0, common=20)
    assert again.version == 8 and rows_of(again.read()) == rows_of(want)


def test_reset_and_what_moves(spark, tmp_path, frames):
    points, poses = frames
    table = WorldTable(spark, str(tmp_path / "a"), res=2.0)
    assert table.read() is None
    table.ingest_all(points.where("frame = 0"), poses, "drive")
    assert table.read().count() > 100
    table.reset()
    assert table.read() is None
    table.ingest_all(points.where("frame < 2").withColumn("moving", F.col("frame") == 0), poses, "drive")
    assert table.read().agg(F.sum("n")).first()[0] == points.where("frame = 1 AND x*x + y*y <= 400").count()


def test_shift_follows_from_the_rows(spark):
    p = spark.createDataFrame([(0.1, 0.1, z / 8, lab, 2.0) for z in range(9) for lab in range(8)], "x DOUBLE, y DOUBLE, z DOUBLE, lab INT, w DOUBLE")
    up = grid.quantise(p.withColumn("z", F.col("z") + 0.375), 0.4, weight=F.col("w"))
    assert grid.shifted(grid.quantise(p, 0.4, weight=F.col("w")), F.lit(0.375)).collect() == up.collect()


@pytest.fixture(scope="module")
def started(spark):
    def start(folder, points, poses, batches, **options):
        """Both streams, a file a micro-batch; again on the same folder with more batches."""
        p, s = points.withColumn("map_id", F.lit("m")), poses.select(F.lit("m").alias("map_id"), "frame")
        for low, high in batches:
            for name, rows in (("points", p), ("sweeps", s)):
                rows.where(F.col("frame").between(low, high - 1)).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")
        streams = [spark.readStream.schema(r.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/{n}") for n, r in (("points", p), ("sweeps", s))]
        q = keyed.KeyedMap(**options).start(*streams, keyed.with_previous(poses), f"{folder}/checkpoint")
        q.awaitTermination()
        return keyed.read(spark, f"{folder}/checkpoint")

    return start


def test_keyed_map_is_the_folded_map_also_after_a_stop(spark, tmp_path, route, frames, started):
    want, _ = folded(sweeps_of(*route), res=2.0, align=False)
    options = {"tiers": (2.0, 4.0), "tile": 8}
    started(str(tmp_path / "two"), *frames, [(0, 3)], **options)
    two = started(str(tmp_path / "two"), *frames, [(3, 5), (5, 8)], **options)
    assert rows_of(two.where("tier = 0")) == rows_of(want)
    coarse, _ = folded(sweeps_of(*route), res=4.0, align=False)
    assert rows_of(two.where("tier = 1")) == rows_of(coarse)


def test_idle_tiles_are_cleared_by_their_timer(spark, tmp_path, started):
    points, poses = drive([(0, 0), (500, 0), (1000, 0), (1500, 0)], 200)
    points, poses = (spark.createDataFrame(d).withColumn("frame", F.col("frame").cast("int")) for d in (points, poses))
    left = started(str(tmp_path / "t"), points, poses, [(k, k + 1) for k in range(4)], tiers=(2.0,), tile=8, late="0 seconds", idle_ms=1)
    assert left.where("ix < 650").isEmpty() and left.count() > 50


def test_a_tile_folds_its_points_as_they_come(monkeypatch):
    """However many points a micro-batch has for a tile, one chunk of them is held."""
    import numpy as np
    import pandas as pd
    from sweepgrid.streaming import keyed

    class Held:
        def __init__(self):
            self.rows, self.value = {}, None

        iterator = lambda self: iter(self.rows.items())
        updateValue = lambda self, k, v: self.rows.__setitem__(k, v)
        exists = lambda self: self.value is not None
        get = lambda self: self.value
        update = lambda self, v: setattr(self, "value", v)

    r, seen, cells_of = np.random.default_rng(1), [], keyed.cells_of
    monkeypatch.setattr(keyed, "cells_of", lambda p: seen.append(len(p)) or cells_of(p))
    n = 4000
    t = pd.DataFrame({"frame": r.integers(0, 2, n), "prev": 0, "kind": 1, "ix": r.integers(0, 9, n), "iy": r.integers(0, 9, n), "z": r.integers(0, 64, n) / 64, "lab": r.integers(0, 7, n), "w": 1.0, "ts": pd.Timestamp("2000-01-01"), "sx": np.nan, "sy": np.nan})
    state = keyed.TileState((0.4,), 1e9, 1000)
    state.cells, state.heard = Held(), Held()
    rows = list(state.handleInputRows(("m", 0, 0, 0), (t[k : k + 100] for k in range(0, n, 100)), None))
    assert max(seen) <= 100 and rows[0]["cells"].tolist() == [81] and state.heard.value == (1, None)
    want = cells_of(t)
    assert all(np.allclose([np.nan if v is None else v for v in state.cells.rows[k]], want.loc[k].to_numpy(float), equal_nan=True) for k in want.index)
