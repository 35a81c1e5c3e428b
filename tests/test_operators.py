import io
import math
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from sweepgrid.functions import geometry as geo
from sweepgrid.operators import cluster, drive, evaluate, grid, order, raster, tiles, worldmap
from sweepgrid.sources import fixtures as fx
from sweepgrid.sources import readers
from sweepgrid.streaming.tables import ingest_tiers

SF = "/root/testdata/sf0.001"


def box(x=0.0, y=0.0, z=0.0, length=4.0, w=2.0, h=2.0, yaw=0.0):
    return [float(v) for v in (x, y, z, length, w, h, yaw)]


def monte_carlo(a, b, n=200_000):
    r = np.random.default_rng(0)
    p = r.uniform(-6, 6, (n, 3))

    def inside(q):
        d = p[:, :2] - q[:2]
        c, s = math.cos(q[6]), math.sin(q[6])
        return (abs(c * d[:, 0] + s * d[:, 1]) <= q[3] / 2) & (abs(c * d[:, 1] - s * d[:, 0]) <= q[4] / 2) & (abs(p[:, 2] - q[2]) <= q[5] / 2)

    i, j = inside(a), inside(b)
    return (i & j).sum() / max(1, (i | j).sum())


def test_iou():
    one = box()
    assert evaluate.box_iou([one], [one])[0] == pytest.approx(1)
    assert evaluate.box_iou([box(yaw=0.7)], [box(yaw=0.7 + math.pi)])[0] == pytest.approx(1)
    assert evaluate.box_iou([one], [box(x=2)])[0] == pytest.approx(4 / 12)
    assert evaluate.box_iou([one], [box(yaw=math.pi / 2)])[0] == pytest.approx(8 / 24)
    assert evaluate.box_iou([one], [box(x=10)])[0] == 0 and evaluate.box_iou([one], [box(z=5)])[0] == 0
    assert evaluate.box_iou([box(length=4)], [box(x=4)])[0] == pytest.approx(0)
    r = np.random.default_rng(3)
    for _ in range(12):
        a, b = (np.concatenate([r.uniform(-1.5, 1.5, 3), r.uniform(1, 4, 3), r.uniform(-3, 3, 1)]) for _ in range(2))
        got = evaluate.box_iou([a], [b])[0]
        assert got == pytest.approx(evaluate.box_iou([b], [a])[0]) and got == pytest.approx(monte_carlo(a, b), abs=0.02)


def test_nms_and_match(spark):
    rows = [(1, 1, 0, 0.9, *box()), (1, 2, 0, 0.8, *box(x=0.2)), (1, 3, 0, 0.7, *box(x=9)), (1, 4, 1, 0.6, *box())]
    schema = "frame int, id bigint, cls int, score double, " + ", ".join(f"{c} double" for c in evaluate.BOX)
    d = spark.createDataFrame(rows, schema)
    assert sorted(r.id for r in evaluate.nms(d, ["frame", "cls"], 0.5).collect()) == [1, 3, 4]
    assert evaluate.nms(d, ["frame", "cls"], 0).count() == 4
    truth = d.where("id IN (1, 3)").drop("score")
    got = {r.id: (r.tp, r.gt_id) for r in evaluate.match(d, truth, ["frame", "cls"], 0.5).collect()}
    assert got == {1: (True, 1), 2: (False, None), 3: (True, 3), 4: (False, None)}
    pairs = d.alias("a").join(d.alias("b"), "frame").select(F.col("a.id").alias("i"), F.col("b.id").alias("j"), *[F.col(f"a.{c}").alias(f"a_{c}") for c in evaluate.BOX], *[F.col(f"b.{c}").alias(f"b_{c}") for c in evaluate.BOX])
    iou = {(r.i, r.j): r.iou for r in evaluate.with_iou(pairs).collect()}
    assert iou[1, 1] == pytest.approx(1) and iou[1, 3] == 0 and 0.8 < iou[1, 2] < 1


def test_average_precision_by_hand(spark):
    rows = [(0, i, 1 - i / 10, t, 3) for i, t in enumerate([True, False, True, True, False])]
    curve = evaluate.pr_curve(spark.createDataFrame(rows, "g int, id bigint, score double, tp boolean, n_gt bigint"), ["g"], "id")
    got = evaluate.average_precision(curve, ["g"]).first()
    assert got.ap == pytest.approx((1 + 0.75 + 0.75) / 3) and got.max_recall == 1


def flood(voxels):
    left, label = set(map(tuple, voxels)), {}
    while left:
        todo = [min(left)]
        name = todo[0]
        left.discard(name)
        while todo:
            v = todo.pop()
            label[v] = name
            for d in np.ndindex(3, 3, 3):
                u = tuple(int(a + b - 1) for a, b in zip(v, d))
                if u in left:
                    left.discard(u)
                    todo.append(u)
    return label


def test_clusters(spark):
    r = np.random.default_rng(5)
    xyz = np.concatenate([r.normal(c, 0.3, (60, 3)) for c in ((0, 0, 0), (4, 0, 0), (0, 5, 1))] + [r.uniform(-8, 8, (40, 3))])
    v = np.floor((xyz - xyz.min(0)) / 0.5).astype(int)
    label = flood(v)
    mine = cluster.voxel_labels(*v.T)
    assert len(set(mine)) == len(set(label.values()))
    assert len({(a, label[tuple(map(int, b))]) for a, b in zip(mine, v)}) == len(set(mine))
    p = spark.createDataFrame(pd.DataFrame({"frame": 0, "pid": range(len(xyz)), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]}))
    got = cluster.cluster_points(p, ["frame"], 0.5, 20, 6000).groupBy("cluster_id").count().collect()
    sizes = pd.Series([label[tuple(map(int, b))] for b in v]).value_counts()
    assert sorted(g["count"] for g in got if g.cluster_id is not None) == sorted(int(s) for s in sizes if s >= 20)
    vox = spark.createDataFrame([(0, *map(int, b)) for b in v], "frame int, vx bigint, vy bigint, vz bigint")
    spread = {(g.vx, g.vy, g.vz): (g.lx, g.ly, g.lz) for g in tiles.connected(vox, ["frame"], 4).collect()}
    assert spread == label


def test_sampling_is_exact_and_repeatable(spark):
    p = spark.range(30).select(F.lit(0).alias("c"), "id").unionByName(spark.range(500).select(F.lit(1).alias("c"), "id"))
    a, b = (cluster.sample(q, ["c"], ["id"], 64, 3) for q in (p, p.repartition(7)))
    assert a.groupBy("c").count().where("count <> 64").isEmpty() and a.where("c = 0").select("id").distinct().count() == 30
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_eigenvalues(spark):
    r = np.random.default_rng(1)
    ms = [np.cov(r.normal(size=(3, 20))) for _ in range(20)] + [np.eye(3), np.diag([3.0, 1.0, 1.0])]
    rows = [(i, *(float(m[a, b]) for a, b in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)))) for i, m in enumerate(ms)]
    names = ("xx", "xy", "xz", "yy", "yz", "zz")
    t = spark.createDataFrame(rows, "i int, " + ", ".join(f"{n} double" for n in names))
    got = t.select("i", *[e.alias(f"l{k}") for k, e in enumerate(geo.eigenvalues3({n: F.col(n) for n in names}))]).collect()
    for g in got:
        assert [g.l0, g.l1, g.l2] == pytest.approx(np.linalg.eigvalsh(ms[g.i])[::-1].tolist(), abs=1e-7)


def test_quantise_is_mergeable_and_foveation_conserves(spark):
    p = fx.points(spark, SF, fx.WIDE)
    parts = [grid.quantise(p.where(f"ok % 3 = {k}")) for k in range(3)]
    assert sorted(map(str, grid.merge_maps(*parts).collect())) == sorted(map(str, grid.quantise(p).collect()))
    f = grid.foveate(grid.quantise(p))
    assert f.agg(F.sum("n")).first()[0] == p.count()
    cells = f.select("lvl", "px", "py").collect()
    seen = {(c.lvl, c.px, c.py) for c in cells}
    assert not any((k, c.px >> (k - c.lvl), c.py >> (k - c.lvl)) in seen for c in cells for k in range(c.lvl + 1, 4))


def test_tiers(spark):
    r = np.random.default_rng(2)
    p = spark.createDataFrame(pd.DataFrame(r.uniform(-8, 8, (2000, 2)), columns=["x", "y"]).assign(z=1.0, lab=0, pid=range(2000)))
    one = ((0.5, 10.0),)
    t = worldmap.into_tiers(p, tiers=one)
    assert t.agg(F.sum("n")).first()[0] == 2000 and t.where("abs(gsum / ng - 1.0) > 1e-12").isEmpty()
    assert worldmap.into_tiers(p.unionByName(p), tiers=one).agg(F.sum("n")).first()[0] == 4000
    far = p.withColumn("x", F.col("x") + 100)
    assert worldmap.into_tiers(far, tiers=one).isEmpty()
    kept = worldmap.in_extent(t, (4.0, 0.0), one)
    assert kept.agg(F.min("ix"), F.max("ix")).first()[0] >= -12 and 0 < kept.count() < t.count()
    assert worldmap.recentred(0.0, 0.75, 0.5) == 1.0 and worldmap.recentred(0.0, 0.25, 0.5) == 0.0


def test_tracker(spark):
    rows = [(0, k, v) for k, v in enumerate([None, 0.5, None, 2.0, 1.0, 1.05, 3.0, 3.0])]
    got = drive.tracked(spark.createDataFrame(rows, "s int, k bigint, v double"), ["s"], "k", "v").orderBy("k").collect()
    ema, want = None, []
    for _, _, v in rows:
        ema = ema if v is None else v if ema is None else 0.4 * v + 0.6 * ema
        want.append(ema)
    assert [g.ema for g in got] == pytest.approx(want) and got[0].cls == drive.UNKNOWN


def test_raster_filters():
    r = np.random.default_rng(4)
    a = r.normal(size=(23, 31))
    a[r.random(a.shape) < 0.8] = np.nan
    filled, dist = raster.nearest_fill(a)
    seen = np.argwhere(~np.isnan(a))
    for i, j in np.ndindex(a.shape):
        d = np.sqrt(((seen - [i, j]) ** 2).sum(1))
        assert dist[i, j] == pytest.approx(d.min())
        assert filled[i, j] in [a[tuple(s)] for s in seen[np.isclose(d, d.min())]]
    padded = np.pad(filled, 2, "edge")
    assert raster.minimum(filled)[7, 9] == padded[7:12, 9:14].min() and raster.minimum(filled)[0, 0] == padded[:5, :5].min()
    assert raster.mean(filled, 5)[3, 4] == pytest.approx(padded[3:8, 4:9].mean())
    assert raster.median3(filled)[5, 6] == np.median(filled[4:7, 5:8])


def test_transforms_round_trip(spark):
    poses = fx.poses(spark)
    p = fx.points(spark, SF)
    back = geo.inverse_transform(geo.transform(p, poses), poses)
    assert back.agg(F.max(F.abs(F.col("sx") - F.col("x")) + F.abs(F.col("sy") - F.col("y")) + F.abs(F.col("sz") - F.col("z")))).first()[0] < 1e-9
    turned = spark.createDataFrame([(10.0, 20.0, 30.0)], "r double, p double, y double").select(*[c.alias(f"c{i}{j}") for i, row in enumerate(geo.mirrored_rotation(F.col("r"), F.col("p"), F.col("y"))) for j, c in enumerate(row)]).first()
    m = np.array(list(turned)).reshape(3, 3)
    assert m @ m.T == pytest.approx(np.eye(3)) and np.linalg.det(m) == pytest.approx(1)
    h = spark.range(40).select((F.col("id") * 0.37 - 7).alias("a")).select("a", *[c.alias(n) for c, n in zip(geo.encode_heading(F.col("a")), ("b", "r"))])
    assert h.where(F.abs(F.sin((geo.decode_heading(F.col("b"), F.col("r")) - F.col("a")) / 2)) > 1e-9).isEmpty() and h.where("abs(r) > 0.5000001").isEmpty()


def test_readers(spark, tmp_path):
    a = np.arange(20, dtype="<f4").reshape(5, 4)
    (tmp_path / "scans").mkdir()
    (tmp_path / "scans/000007.bin").write_bytes(a.tobytes())
    (tmp_path / "scans/000007.label").write_bytes(np.array([0x00010003, 2, 5, 99, 0], "<u4").tobytes())
    lut = spark.createDataFrame([(3, 1, False), (2, 2, False), (5, 5, True), (0, 0, False)], "raw bigint, cls int, moving boolean")
    got = readers.labelled_scan(spark, str(tmp_path / "scans"), str(tmp_path / "scans"), lut).orderBy("pid").collect()
    assert [(g.frame, g.pid, g.x, g.lab, g.moving) for g in got] == [(7, k, float(4 * k), c, m) for k, (c, m) in enumerate([(1, False), (2, False), (5, True), (7, False), (0, False)])]
    assert [r.instance for r in readers.point_labels(spark, str(tmp_path / "scans")).orderBy("pid").collect()][0] == 1
    (tmp_path / "label").mkdir()
    (tmp_path / "label/000003.txt").write_text("Car 0.1 2.0 0.5 1 2 3 4 1.5 1.6 3.9 1 2 3 0.1\nshort line\n")
    o = readers.object_labels(spark, str(tmp_path / "label")).collect()
    assert len(o) == 1 and o[0].frame == 3 and o[0].type == "Car" and o[0].occlusion == 2 and o[0].l == 3.9
    (tmp_path / "calib").mkdir()
    (tmp_path / "calib/000003.txt").write_text("P2: 1 2 3\nR0_rect: 4 5\n\n")
    c = readers.camera(readers.calibration(spark, str(tmp_path / "calib"))).first()
    assert c.P2 == [1, 2, 3] and c.R0_rect == [4, 5] and c.Tr_velo_to_cam is None
    buffer = io.BytesIO()
    np.savez(buffer, points=np.array([[1, 2, 3, 2.0], [4, 5, 6, 1.0]], np.float32))
    (tmp_path / "lidar_000004.npz").write_bytes(buffer.getvalue())
    s = readers.simulator_scan(spark, str(tmp_path)).orderBy("pid").collect()
    assert [(r.frame, r.y, r.intensity) for r in s] == [(4, -2.0, 1.0), (4, -5.0, 0.5)]
    ids = np.array([7, 1000], np.uint32)
    assert readers.decode_ids(ids.view(np.float32)).tolist() == [7, 1000] == readers.decode_ids(ids.astype(np.float32)).tolist()
    (tmp_path / "drive.csv").write_text("sample_id,ego_x,scan_path\n1,2.5,a\n1,3.5,b\n2,4,c\n")
    d = {r.sample_id: r.ego_x for r in readers.drive_table(spark, str(tmp_path / "drive.csv")).collect()}
    assert d == {1.0: 3.5, 2.0: 4.0}
    (tmp_path / "poses.txt").write_text("1 0 0 5 0 1 0 6 0 0 1 7\n")
    tr = np.eye(4)[:3]
    assert readers.odometry(spark, str(tmp_path / "poses.txt"), tr).first().tx == 5
    with pytest.raises(ValueError):
        readers.odometry(spark, str(tmp_path / "poses.txt"), None)
    assert readers.synthetic_scene(spark, 1000, 5, 50).count() == 1250


def test_tiers_take_drift_out(spark):
    r = np.random.default_rng(3)
    p = spark.createDataFrame(pd.DataFrame(r.uniform(-8, 8, (4000, 2)), columns=["x", "y"]).assign(z=1.0, lab=0))
    one = ((0.5, 10.0),)
    first = ingest_tiers(None, p, (0.0, 0.0), one)
    both = ingest_tiers(first, p.withColumn("z", F.lit(1.2)), (0.0, 0.0), one)
    assert both.agg(F.sum("n")).first()[0] == 8000 and both.where("abs(gsum / ng - 1.0) > 1e-9").isEmpty()
    raw = ingest_tiers(first, p.withColumn("z", F.lit(1.2)), (0.0, 0.0), one, align=False)
    assert raw.where("abs(gsum / ng - 1.1) > 1e-9").isEmpty()


def test_split_calibration_and_named_fields(spark, tmp_path):
    drive_ = tmp_path / "day/calib"
    drive_.mkdir(parents=True)
    (drive_ / "calib_velo_to_cam.txt").write_text("calib_time: 15-Mar-2012 11:37:16\nR: 1 2 3 4 5 6 7 8 9\nT: 10 11 12\n")
    (drive_ / "calib_cam_to_cam.txt").write_text("R_rect_00: 1 0 0 0 1 0 0 0 1\nP_rect_02: 1 2 3 4 5 6 7 8 9 10 11 12\nS_rect_02: 1242 375\n")
    c = readers.split_calibration(spark, str(tmp_path / "day")).first()
    assert c.V2C == [1, 2, 3, 10, 4, 5, 6, 11, 7, 8, 9, 12] and c.P2[-1] == 12 and (c.width, c.height) == (1242, 375)
    (tmp_path / "gt").mkdir()
    for n in ("um_000002", "um_000001"):
        (tmp_path / f"gt/{n}.png").write_bytes(b"x")
    assert [(r.stem, r.frame) for r in readers.frame_stems(spark, str(tmp_path / "gt")).collect()] == [("um_000001", 1), ("um_000002", 2)]
    a = np.array([(1.0, 9.0, 2.0, 3.0, 0.5)], [("x", "f8"), ("ring", "f8"), ("y", "f8"), ("z", "f8"), ("intensity", "f8")])
    (tmp_path / "npz").mkdir()
    with open(tmp_path / "npz/lidar_000001.npz", "wb") as f:
        np.savez(f, xyz=a)
    with open(tmp_path / "npz/lidar_000002.npz", "wb") as f:
        np.savez(f, points=np.arange(6.0).reshape(1, 6))
    s = readers.simulator_scan(spark, str(tmp_path / "npz")).orderBy("frame").collect()
    assert [(r.x, r.y, r.z, r.intensity) for r in s] == [(1.0, -2.0, 3.0, 0.5), (0.0, -1.0, 2.0, 0.0)]
    from sweepgrid.sources import sinks

    sinks.write_shards(spark.createDataFrame([(1, 2), (700, 3)], "frame INT, n INT"), str(tmp_path / "shards"))
    assert sorted(tuple(r) for r in readers.read_shards(spark, str(tmp_path / "shards")).collect()) == [(1, 2), (700, 3)]


def test_bilinear_keeps_cells_without_a_raster(spark):
    cells = spark.createDataFrame([(1, 0.1, 0.1), (2, 0.1, 0.1)], "frame INT, cx DOUBLE, cy DOUBLE")
    r = spark.createDataFrame([(1, x, y, float(x + y)) for x in range(3) for y in range(3)], "frame INT, gx BIGINT, gy BIGINT, height DOUBLE")
    got = {g.frame: g.height for g in raster.bilinear(cells, r, ["frame"], ["height"]).collect()}
    assert got[1] == pytest.approx(0.8) and got[2] is None


def test_classes_hold_near_their_limits(spark):
    """A mean within the band of either limit keeps the class before, whatever that is."""
    values = [0.5, 1.1, 1.2, 1.9, 2.05, 0.95, 0.2, None, 2.6]
    got = drive.tracked(spark.createDataFrame([(0, k, v) for k, v in enumerate(values)], "s INT, k BIGINT, v DOUBLE"), ["s"], "k", "v", alpha=1.0).orderBy("k").collect()
    assert [g.cls for g in got] == [0, 0, 1, 1, 1, 1, 0, 0, 2]


def test_boxes_of_labels_and_back(spark):
    r = np.random.default_rng(1)
    a = 0.02
    rect = [[math.cos(a), -math.sin(a), 0.0], [math.sin(a), math.cos(a), 0.0], [0.0, 0.0, 1.0]]
    ext = [[0.0, -1.0, 0.0, -0.004], [0.0, 0.0, -1.0, -0.076], [1.0, 0.0, 0.0, -0.27]]
    p = r.normal(size=(20, 3)) * 10
    cam = (np.array(rect) @ (np.array(ext)[:, :3] @ p.T + np.array(ext)[:, 3:])).T
    d = spark.createDataFrame(pd.DataFrame(cam, columns=["x", "y", "z"]))
    back = d.select(*[c.alias(n) for c, n in zip(geo.to_lidar(F.col("x"), F.col("y"), F.col("z"), rect, ext), "abc")]).toPandas().to_numpy()
    assert np.allclose(back, p)
    one = spark.createDataFrame([(1.0, 2.0, 10.0, 1.5, 1.6, 3.9, 0.5)], "cx DOUBLE, cy DOUBLE, cz DOUBLE, h DOUBLE, w DOUBLE, l DOUBLE, ry DOUBLE")
    b = one.select(*[c.alias(n) for n, c in geo.label_box(np.eye(3).tolist(), ext).items()]).first()
    assert (b.cx, b.cy, b.cz) == pytest.approx((10.27, -1.004, -1.326)) and b.yaw == pytest.approx(-0.5 - math.pi / 2)


def test_images_and_capture_frames(spark, tmp_path):
    r = np.random.default_rng(6)
    image = r.integers(0, 256, (9, 7, 3), dtype=np.uint8)
    image[:3, :, 2] = 0
    lines, above = b"", np.zeros((7, 3), int)
    for i, row in enumerate(image.astype(int)):
        left, corner = np.vstack([np.zeros((1, 3), int), row[:-1]]), np.vstack([np.zeros((1, 3), int), above[:-1]])
        p = left + above - corner
        near = np.abs(np.stack([p - left, p - above, p - corner]))
        guess = [0 * row, left, above, (left + above) // 2, np.choose(near.argmin(0), [left, above, corner])][i % 5]
        lines += bytes([i % 5]) + ((row - guess) & 255).astype(np.uint8).tobytes()
        above = row
    chunk = lambda kind, body: len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", (7).to_bytes(4, "big") + (9).to_bytes(4, "big") + bytes([8, 2, 0, 0, 0])) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    assert (readers.decode_png(png) == image).all()
    (tmp_path / "gt").mkdir()
    (tmp_path / "gt/um_000003.png").write_bytes(png)
    px = readers.road_images(spark, str(tmp_path / "gt")).collect()
    assert len(px) == 63 and all(x.frame == 3 and x.road == (image[x.v, x.u, 2] > 0) and x.valid == (image[x.v, x.u, 0] > 0) for x in px)
    for folder, name, n in (("raw_lidar", "lidar", (1, 2, 3)), ("semantic_lidar", "semantic", (1, 2))):
        (tmp_path / folder).mkdir()
        for k in n:
            with open(tmp_path / folder / f"{name}_{k:06d}.npz", "wb") as f:
                np.savez(f, points=np.ones((2, 4 if name == "lidar" else 6), np.float32))
    meta = spark.createDataFrame([(1.0, 5.0, 6.0, 0.5, 0.0, 0.0, 0.0), (3.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)], "sample_id DOUBLE, ego_x DOUBLE, ego_y DOUBLE, ego_z DOUBLE, ego_roll DOUBLE, ego_pitch DOUBLE, ego_yaw DOUBLE")
    raw, semantic, poses = readers.simulator_frames(spark, str(tmp_path), meta)
    assert {x.frame for x in raw.collect()} == {x.frame for x in semantic.collect()} == {1}
    q = poses.first()
    assert (q.frame, q.tx, q.ty, q.tz, q.r00) == (1, 5.0, -6.0, pytest.approx(2.9), 1.0)
    (tmp_path / "calib.txt").write_text("P0: 1 2 3\nTr: 1 0 0 0 0 1 0 0 0 0 1 0\n")
    (tmp_path / "poses.txt").write_text("1 0 0 5 0 1 0 6 0 0 1 7\n")
    assert readers.odometry(spark, str(tmp_path / "poses.txt"), str(tmp_path / "calib.txt")).first().tz == 7


@pytest.mark.parametrize("parts", [2, 64])
def test_numbers_in_parts(spark, parts):
    """One key with most rows, ties, nulls in order and key, and parts that stay empty."""
    r = np.random.default_rng(7)
    rows = [(0, i, float(r.integers(0, 40))) for i in range(900)] + [(1, 900, 2.0), (None, 901, 1.0), (None, 902, 0.5), (0, 903, None), (0, 904, None)]
    d = spark.createDataFrame(rows, "k INT, id INT, v DOUBLE")
    for down in (False, True):
        got = {x.id: x.rn for x in order.numbered(d, ["k"], "v", [F.col("id")], down, parts).collect()}
        for key in (0, 1, None):
            mine = sorted((x for x in rows if x[0] == key), key=lambda x: (x[2] is None, 0 if x[2] is None else -x[2] if down else x[2], x[1]))
            assert [got[x[1]] for x in mine] == list(range(1, len(mine) + 1))
    assert order.numbered(d.where("false"), [], "v", parts=parts).collect() == []
