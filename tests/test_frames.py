"""Canonical frames, targets and labels against plain numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from sweepgrid.operators import frames, labelling

KEYS = ["k"]


@pytest.fixture(scope="module")
def clouds():
    r = np.random.default_rng(5)
    out = {}
    for k in range(6):
        x = r.gamma(1.5, size=(40 + 10 * k, 3)) * [4.0, 1.5, 0.7]
        a = r.uniform(-3, 3)
        out[k] = x @ np.array([[math.cos(a), math.sin(a), 0], [-math.sin(a), math.cos(a), 0], [0, 0, 1]]) + r.uniform(-20, 20, 3)
    out[6] = np.tile([1.0, 2.0, 3.0], (4, 1))  # one place
    out[7] = np.array([[0.0, 0, 0]])
    return out


@pytest.fixture(scope="module")
def points(spark, clouds):
    return spark.createDataFrame([(k, i, *map(float, p)) for k, c in clouds.items() for i, p in enumerate(c)], "k INT, id INT, x DOUBLE, y DOUBLE, z DOUBLE")


def rotation(row):
    return np.array([[row[f"r{i}{j}"] for j in range(3)] for i in range(3)])


def test_three_axes(points, clouds):
    got = {f.k: f for f in frames.frames(points, KEYS, "pca3_skew").collect()}
    for k in range(6):
        x = clouds[k] - clouds[k].mean(0)
        values, vectors = np.linalg.eigh(np.cov(x.T))
        axes = []
        for v in vectors[:, ::-1].T:
            axes.append(-v if (x @ v).__pow__(3).mean() < 0 else v)
        if np.linalg.det(axes) < 0:
            axes[2] = -axes[2]
        assert np.allclose(rotation(got[k]), axes, atol=1e-7)
        lam = values[::-1]
        assert got[k].degenerate == bool(lam[1] / lam[0] > 0.85 or lam[2] / lam[1] > 0.85)
        assert got[k].scale == pytest.approx(np.linalg.norm(x, axis=1).max())
    assert got[6].scale == 1.0 and got[6].skew_ambiguous and got[6].degenerate and got[7].n == 1


def test_yaw_and_none(points, clouds):
    got = {f.k: f for f in frames.frames(points, KEYS, "pca2_yaw").collect()}
    for k in range(6):
        xy = (clouds[k] - clouds[k].mean(0))[:, :2]
        v = np.linalg.eigh(np.cov(xy.T))[1][:, 1]
        v = -v if ((xy @ v) ** 3).mean() < 0 else v
        assert np.allclose(rotation(got[k])[0, :2], v, atol=1e-7) and rotation(got[k])[2].tolist() == [0, 0, 1]
    plain = frames.frames(points, KEYS, "none").collect()
    assert all((rotation(f) == np.eye(3)).all() for f in plain)
    with pytest.raises(ValueError):
        frames.frames(points, KEYS, "other")


def test_viewpoints_and_degeneracy(points):
    seen = frames.viewpoints(points.where("k < 6"), KEYS, "pca2_yaw", ["id"], ((50.0, 0, 0), (-50.0, 0, 0))).collect()
    assert len(seen) == 6 and all(0 <= s.error <= 180 and s.error == pytest.approx(s.yaw_error, abs=1e-4) for s in seen)
    assert all(0 <= d.third <= 1 and 0 <= d.second <= 1 for d in frames.degeneracy(points.where("k < 6"), KEYS).collect())


def test_targets_decode_to_the_boxes(spark, points):
    boxes = spark.createDataFrame([(k, 1 + k % 2, 3.0 + k, -2.0, 0.5, 4.0, 1.8, 1.5, 0.4 * k - 1.0) for k in range(6)], "k INT, cls INT, cx DOUBLE, cy DOUBLE, cz DOUBLE, l DOUBLE, w DOUBLE, h DOUBLE, yaw DOUBLE")
    anchors = spark.createDataFrame([(1, 3.9, 1.6, 1.5), (2, 0.8, 0.6, 1.7)], "cls INT, l DOUBLE, w DOUBLE, h DOUBLE")
    f = frames.frames(points, KEYS, "pca2_yaw")
    t = frames.targets(boxes, f, anchors, KEYS)
    heading = (F.col("head_bin") + F.col("head_res")) * (2 * math.pi / 12)
    logits = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda c: F.when(c == F.col("cls"), 5.0).otherwise(0.0))
    got = frames.decoded(t.select("k", logits.alias("logits"), "ox", "oy", "oz", "sl", "sw", "sh", heading.alias("heading")), f, anchors, KEYS).collect()
    want = {b.k: b for b in boxes.collect()}
    assert len(got) == 6
    for g in got:
        for c in ("cls", "cx", "cy", "cz", "l", "w", "h"):
            assert g[c] == pytest.approx(want[g.k][c]), c
        assert math.cos(g.yaw - want[g.k].yaw) == pytest.approx(1) and g.score == pytest.approx(1 - 1 / (math.e**5 + 2))
    with pytest.raises(Exception, match="no anchor"):
        frames.targets(boxes, f, anchors.where("cls = 1"), KEYS).collect()


def test_augmentation_moves_points_and_boxes_alike(spark, points):
    boxes = points.groupBy("k").agg(*[F.avg(c).alias(f"c{c}") for c in "xyz"]).selectExpr("k", "1 AS cls", "cx", "cy", "cz", "4D AS l", "2D AS w", "1D AS h", "0.3D AS yaw")
    p, b = frames.augmented(points, boxes, KEYS, ["id"], seed=2, drop=0.0, jitter=0.0)
    centre = {r.k: r for r in p.groupBy("k").agg(*[F.avg(c).alias(c) for c in "xyz"]).collect()}
    for r in b.collect():
        assert [r.cx, r.cy, r.cz] == pytest.approx([centre[r.k].x, centre[r.k].y, centre[r.k].z])
        assert 0.92 <= r.l / 4 <= 1.08 and r.w == pytest.approx(r.l / 2)
    full, _ = frames.augmented(points.where("k < 6"), boxes, KEYS, ["id"], seed=2)
    counts = {r.k: (r.n, r.m) for r in full.groupBy("k").agg(F.count("*").alias("n"), F.countDistinct("id").alias("m")).collect()}
    assert all(n == 256 and m >= 8 for n, m in counts.values())
    again, _ = frames.augmented(points.where("k < 6").repartition(3), boxes, KEYS, ["id"], seed=2)
    key = lambda d: sorted((r.k, r.slot, r.id) for r in d.collect())
    assert key(full) == key(again)


def test_labels_end_to_end(spark):
    r = np.random.default_rng(2)
    ground = [(0, i, 0, 0, 0, *map(float, (*r.uniform(-12, 12, 2), -1.73 + r.normal() * 0.01))) for i in range(30_000)]
    car = [(0, 10_000 + i, 0, 0, 0, *map(float, r.uniform((4, 3, -1.4), (8, 4.7, 0.2)))) for i in range(400)]
    lone = [(0, 20_000, 0, 0, 0, -9.0, -9.0, 2.0)]
    p = spark.createDataFrame(ground + car + lone, "frame INT, ok INT, pk INT, sk INT, ln INT, x DOUBLE, y DOUBLE, z DOUBLE")
    got = labelling.label_points(p, ["frame"], labelling.class_table(spark, ["Background", "Car", "Pedestrian"]))
    n = {(g.provenance, g.grid): g["count"] for g in got.groupBy("provenance", "grid").count().collect()}
    assert sum(n.values()) == 30_401 and n["ground", 0] > 28_000 and n["car", 5] > 300 and n[("unclustered", 7)] >= 1
    with pytest.raises(KeyError):
        labelling.class_table(spark, ["Background", "Boat"])
    with pytest.raises(Exception, match="no grid class"):
        labelling.checked(spark.createDataFrame([(9,)], "cls INT"), labelling.class_table(spark, ["Background"]), "cls").collect()
