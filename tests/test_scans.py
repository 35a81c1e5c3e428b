"""Sensor files as data sources: ranges, pushed filters, replay, and writers that leave nothing half done."""

import time
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from sweepgrid.sources import readers, scans


@pytest.fixture(scope="module")
def capture(spark, tmp_path_factory):
    """Six scans with labels, in two folders."""
    folder, r, rows = tmp_path_factory.mktemp("capture"), np.random.default_rng(1), {}
    scans.register(spark)
    for d in ("scans", "labels"):
        (folder / d).mkdir()
    for f in range(6):
        n = 1000 + 100 * f
        rows[f] = r.normal(0, 20, (n, 4)).astype("<f4"), (r.integers(0, 1 << 32, n)).astype("<u4")
        (folder / f"scans/drive_{f:06d}.bin").write_bytes(rows[f][0].tobytes())
        (folder / f"labels/drive_{f:06d}.label").write_bytes(rows[f][1].tobytes())
    return folder, rows


def read(spark, capture, **options):
    return spark.read.format("scans").options(path=f"file://{capture[0]}/scans", labels=f"file://{capture[0]}/labels", **options).load()


def test_one_scan_is_many_ranges(spark, capture):
    df = read(spark, capture, rangebytes=160 * 16 + 7)
    assert df.rdd.getNumPartitions() == sum(-(-len(p) // 160) for p, _ in capture[1].values())
    t = df.toPandas().sort_values(["frame", "pid"])
    assert np.array_equal(t[["x", "y", "z", "intensity"]].to_numpy("f4"), np.concatenate([p for p, _ in capture[1].values()]))
    w = np.concatenate([w for _, w in capture[1].values()])
    assert (t["semantic"].to_numpy() == w & 0xFFFF).all() and (t["instance"].to_numpy() == w >> 16).all()
    assert sorted(map(tuple, readers.scan(spark, f"{capture[0]}/scans").collect())) == sorted(map(tuple, df.drop("semantic", "instance").collect()))


def test_a_large_scan_is_not_read_to_plan_it(spark, tmp_path):
    with open(tmp_path / "7.bin", "wb") as f:
        f.truncate(1 << 30)  # a hole of a gigabyte
    scans.register(spark)
    df = spark.read.format("scans").option("path", str(tmp_path)).load()
    assert df.rdd.getNumPartitions() == 16


def test_filters_on_frame_choose_files(spark, capture):
    for where, frames in (("frame = 3", [3]), ("frame IN (1, 5)", [1, 5]), ("frame >= 2 AND frame < 4 AND x > 0", [2, 3]), ("frame = 99", [])):
        df = read(spark, capture).where(where)
        assert df.rdd.getNumPartitions() == max(1, len(frames))
        want = sum(int((capture[1][f][0][:, 0] > 0).sum()) if "x" in where else len(capture[1][f][0]) for f in frames)
        assert df.count() == want


def test_missing_labels_and_empty_folder(spark, capture, tmp_path):
    df = spark.read.format("scans").option("path", f"{capture[0]}/scans").load()
    assert df.where("semantic IS NOT NULL").isEmpty() and df.count() == sum(len(p) for p, _ in capture[1].values())
    (tmp_path / "none").mkdir()
    assert spark.read.format("scans").option("path", str(tmp_path / "none")).load().count() == 0


def replay(spark, capture, out, checkpoint, **options):
    s = spark.readStream.format("scans").options(path=f"{capture[0]}/scans", **options).load()
    seen = []

    def step(batch, k):
        seen.append(sorted(r[0] for r in batch.select("frame").distinct().collect()))
        time.sleep(out)

    return s.writeStream.foreachBatch(step).option("checkpointLocation", str(checkpoint)).start(), seen


def wait(q, seen, last, seconds=40):
    end = time.time() + seconds
    while time.time() < end and not any(last in s for s in seen):
        time.sleep(0.1)
    q.stop()


def test_replay_goes_on_at_its_offset(spark, capture, tmp_path):
    q, first = replay(spark, capture, 0, tmp_path / "c", perbatch=2)
    wait(q, first, 1)
    q, rest = replay(spark, capture, 0, tmp_path / "c", perbatch=2)
    wait(q, rest, 5)
    frames = [f for s in first + rest for f in s]
    assert sorted(set(frames)) == list(range(6)) and first[0] == [0, 1]
    # a batch that was not committed when the query stopped comes once more, nothing is left out
    assert [s for s in first + rest if s] == sorted([s for s in first + rest if s]) and rest[0] != [0, 1] or len(first) == 1


def test_latest_only_skips_what_it_missed(spark, capture, tmp_path):
    q, seen = replay(spark, capture, 0.5, tmp_path / "c", rate=20, latest="true")
    wait(q, seen, 5)
    frames = [f for s in seen for f in s]
    assert frames == sorted(frames) and frames[-1] == 5 and all(len(s) <= 1 for s in seen) and len(frames) < 6


def test_written_scans_read_back(spark, capture, tmp_path):
    df = read(spark, capture)
    scans.write_scans(df, f"file://{tmp_path}/out")
    back = spark.read.format("scans").options(path=f"{tmp_path}/out", labels=f"{tmp_path}/out").load()
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert sorted(p.name for p in Path(tmp_path / "out").iterdir()) == sorted(f"{f:06d}.{s}" for f in range(6) for s in ("bin", "label"))
    scans.write_scans(df.where("frame = 4"), f"file://{tmp_path}/out", "overwrite")
    assert sorted(p.name for p in Path(tmp_path / "out").iterdir()) == ["000004.bin", "000004.label"]


@pytest.fixture(scope="module")
def proposals(spark):
    r = np.random.default_rng(3)
    return spark.createDataFrame(pd.DataFrame([{"frame": int(k // 3), "points": r.normal(0, 1, 256 * 5).astype("f4").tolist(), **{c: float(np.float32(r.normal())) for c in scans.META}} for k in range(60)]))


def test_shards_of_arrays(spark, tmp_path, proposals):
    scans.write_proposals(proposals, f"file://{tmp_path}/s", 7)
    assert sorted(p.name for p in Path(tmp_path / "s").iterdir()) == ["shard_0000.npz", "shard_0001.npz", "shard_0002.npz"]
    z = np.load(tmp_path / "s/shard_0001.npz")
    assert z["points"].shape == (21, 256, 5) and z["meta"].shape == (21, 9) and z["frame"].dtype == np.int32 and set(z["frame"]) == set(range(7, 14))
    key = lambda d: sorted((r.frame, round(r.cx, 5), tuple(round(v, 5) for v in r.points)) for r in d.collect())
    back = spark.read.format("proposal_shards").option("path", f"{tmp_path}/s").load()
    assert key(back) == key(proposals)


def test_a_failed_task_leaves_no_shard(spark, tmp_path, proposals):
    scans.write_proposals(proposals.where("frame < 7"), f"file://{tmp_path}/s", 7)
    bad = proposals.withColumn("points", F.when((F.col("frame") == 15) & (F.col("cx") == F.col("cx")), F.slice("points", 1, 3)).otherwise(F.col("points")))
    with pytest.raises(Exception, match="reshape|Writ|write"):
        scans.write_proposals(bad, f"file://{tmp_path}/s", 7, "overwrite")
    assert [p.name for p in Path(tmp_path / "s").iterdir()] == ["shard_0000.npz"]
    assert spark.read.format("proposal_shards").option("path", f"{tmp_path}/s").load().count() == 21


def test_a_scan_is_written_as_its_rows_come():
    """The first piece of a file is there after the first batch, and pieces of a frame make one file."""
    import numpy as np
    import pyarrow as pa
    from sweepgrid.sources import scans

    taken = []

    def batches():
        for k in range(4):
            taken.append(k)
            frame = np.array([0, 0, 0] if k < 2 else [0, 1, 1])
            yield pa.RecordBatch.from_pydict({"frame": frame, **{c: np.full(3, float(k)) for c in ("x", "y", "z", "intensity")}, "semantic": np.full(3, k), "instance": np.full(3, 7)})
            if k == 2:
                return

    files, whole, when = {}, [], None
    for name, content in scans.ScanWriter("/nowhere", False).files(batches()):
        when = when or list(taken)
        if content is None:
            whole.append(name)
        else:
            files[name] = files.get(name, b"") + content
    assert when == [0] and whole == ["000000.bin", "000000.label"]
    assert np.frombuffer(files["000000.bin"], "<f4").reshape(-1, 4)[:, 0].tolist() == [0, 0, 0, 1, 1, 1, 2]
    assert np.frombuffer(files["000001.label"], "<u4").tolist() == [2 | 7 << 16] * 2
