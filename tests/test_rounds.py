"""What is greedy or global by nature, done by rounds and tiles, against a plain loop."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from sweepgrid.operators import cluster, evaluate, labelling, tiles

BOXES = "frame INT, id BIGINT, score DOUBLE, " + ", ".join(f"{c} DOUBLE" for c in evaluate.BOX)


def crowd(r, n, spread, ids=0):
    return [(int(r.integers(0, 2)), ids + k, float(r.integers(0, 20)) / 20, *(float(v) for v in (*r.uniform(-spread, spread, 2), r.uniform(-0.5, 0.5), *r.uniform(1, 6, 2), r.uniform(1, 2), r.uniform(-4, 4)))) for k in range(n)]


def iou(a, b):
    return float(evaluate.box_iou([a[3:]], [b[3:]])[0])


@pytest.mark.parametrize("task_pairs", [0, 150, 10**6])
@pytest.mark.parametrize("n,spread", [(120, 8), (80, 30)])
def test_suppression_is_the_greedy_one(spark, n, spread, task_pairs):
    rows, want = crowd(np.random.default_rng(n), n, spread), []
    for b in sorted(rows, key=lambda b: (-b[2], b[1])):
        if all(k[0] != b[0] or iou(k, b) < 0.2 for k in want):
            want.append(b)
    got = evaluate.nms(spark.createDataFrame(rows, BOXES), ["frame"], 0.2, task_pairs=task_pairs)
    assert sorted(r.id for r in got.collect()) == sorted(b[1] for b in want) and len(want) < n
    assert got.columns == ["frame", "id", "score", *evaluate.BOX]


def test_suppression_along_a_chain(spark):
    """Every box overlaps the next only, scores fall along the chain: as many rounds as boxes go."""
    rows = [(0, k, 1 - k / 100, k * 1.5, 0.0, 0.0, 2.0, 1.0, 1.0, 0.0) for k in range(9)]
    got = evaluate.nms(spark.createDataFrame([(r[0], r[1], r[2], *map(float, r[3:])) for r in rows], BOXES), ["frame"], 0.1, task_pairs=0)
    assert sorted(r.id for r in got.collect()) == [0, 2, 4, 6, 8]


@pytest.mark.parametrize("n,spread", [(90, 8), (240, 16)])
@pytest.mark.parametrize("task_pairs", [0, 100, 10**6])
def test_matching_is_the_greedy_one(spark, n, spread, task_pairs):
    r = np.random.default_rng(n)
    found, truth = crowd(r, n, spread), crowd(r, n // 2, spread, 1000)
    taken, want = set(), {}
    for b in sorted(found, key=lambda b: (-b[2], b[1])):
        free = [(-iou(b, t), t[1]) for t in truth if t[0] == b[0] and t[1] not in taken]
        best = min(free, default=(0, None))
        want[b[1]] = best[1] if -best[0] >= 0.15 else None
        taken.add(want[b[1]])
    got = evaluate.match(spark.createDataFrame(found, BOXES), spark.createDataFrame(truth, BOXES).drop("score"), ["frame"], 0.15, task_pairs).collect()
    assert {g.id: g.gt_id for g in got} == want and all(g.tp == (g.gt_id is not None) for g in got)
    assert sum(v is not None for v in want.values()) > 10


def test_nothing_to_match(spark):
    some, none = spark.createDataFrame(crowd(np.random.default_rng(1), 3, 5), BOXES), spark.createDataFrame([], BOXES)
    assert [g.tp for g in evaluate.match(some, none.drop("score"), ["frame"]).collect()] == [False] * 3
    assert evaluate.match(none, some.drop("score"), ["frame"]).count() == 0 and evaluate.nms(none, ["frame"], 0.5).count() == 0


def walk(v):
    left, label = set(v), {}
    while left:
        name = min(left)
        todo = [name]
        left.discard(name)
        while todo:
            x, y, z = todo.pop()
            label[x, y, z] = name
            for u in [(x + i, y + j, z + k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]:
                if u in left:
                    left.discard(u)
                    todo.append(u)
    return label


def test_components_across_tiles(spark):
    """A spiral through all tiles, a diagonal, dust and a second cloud; tiles of 4, so 64 along an axis and two levels."""
    spiral, x, y, step = [], 0, 0, 250
    for turn in range(24):
        for _ in range(step):
            spiral.append((x, y, 0))
            x, y = x + (turn % 4 == 0) - (turn % 4 == 2), y + (turn % 4 == 1) - (turn % 4 == 3)
        step -= 9
    r = np.random.default_rng(2)
    dust = [tuple(map(int, v)) for v in r.integers(-40, 40, (1500, 3)) * (1, 1, 0) + r.integers(0, 4, (1500, 3)) * (0, 0, 1) + (0, 0, 3)]
    clouds = {0: spiral + [(-k, -k, 5 - k) for k in range(1, 60)] + dust, 1: dust[:300]}
    rows = [(f, *v) for f, vs in clouds.items() for v in vs]
    got = tiles.connected(spark.createDataFrame(rows, "frame INT, vx INT, vy INT, vz INT"), ["frame"], 4).collect()
    for f, vs in clouds.items():
        assert {(g.vx, g.vy, g.vz): (g.lx, g.ly, g.lz) for g in got if g.frame == f} == walk(set(vs))
    assert tiles.connected(spark.createDataFrame([], "vx INT, vy INT, vz INT"), []).count() == 0


def test_clusters_of_a_cloud_are_those_of_a_sweep(spark):
    r = np.random.default_rng(4)
    xyz = np.concatenate([r.normal(c, 0.6, (150, 3)) for c in r.uniform(-30, 30, (12, 3)) * (1, 1, 0.02)] + [r.uniform(-30, 30, (300, 3))])
    p = spark.createDataFrame(pd.DataFrame({"frame": r.integers(0, 2, len(xyz)), "pid": range(len(xyz)), **dict(zip("xyz", xyz.T))}))
    key = lambda d: sorted((g.pid, g.cluster_id) for g in d.collect())
    one = key(cluster.cluster_points(p, ["frame"], 0.5, 20, 200))
    assert key(tiles.clusters(p, ["frame"], 0.5, 20, 200, tile=8)) == one and len({c for _, c in one}) > 5
    pooled = p.withColumn("frame", F.lit(0))
    assert key(tiles.clusters(p, [], 0.5, 20, 200, tile=16)) == key(cluster.cluster_points(pooled, ["frame"], 0.5, 20, 200))


def copies(r, n, times, ids=0):
    """Boxes of which each comes several times, with ids and scores of their own."""
    boxes = [b[3:] for b in crowd(r, n, 6)]
    return [(0, ids + k * n + j, float(r.integers(0, 50)) / 50, *b) for k in range(times) for j, b in enumerate(boxes)]


@pytest.fixture
def pairs_met(monkeypatch):
    """Rows of each call of ``overlaps``."""
    seen, overlaps = [], evaluate.overlaps

    def watched(*args, **more):
        out = overlaps(*args, **more)
        seen.append(out.count())
        return out

    monkeypatch.setattr(evaluate, "overlaps", watched)
    return seen


@pytest.mark.parametrize("task_pairs", [0, 10**6])
def test_equal_boxes_are_suppressed_as_one(spark, pairs_met, task_pairs):
    flat = (1.0, 1.0, 0.0, 0.0, 1.0, 1.0, 0.0)  # overlaps nothing, not even its equal
    rows, want = [*copies(np.random.default_rng(5), 10, 40), (0, 900, 0.5, *flat), (0, 901, 0.4, *flat), (0, 902, 0.4, *flat)], []
    rows += [(0, 910, None, *rows[3][3:]), (1, 911, None, *rows[3][3:]), (1, 912, None, *rows[3][3:])]
    for b in sorted(rows, key=lambda b: (-1.0 if b[2] is None else -b[2], b[1]) if b[2] is not None else (1.0, b[1])):
        if all(k[0] != b[0] or iou(k, b) < 0.2 for k in want):
            want.append(b)
    got = evaluate.nms(spark.createDataFrame(rows, BOXES), ["frame"], 0.2, task_pairs=task_pairs)
    assert sorted(r.id for r in got.collect()) == sorted(b[1] for b in want) and {900, 901, 902, 911} < {b[1] for b in want}
    assert pairs_met and max(pairs_met) <= 14**2


@pytest.mark.parametrize("task_pairs", [0, 10**6])
def test_equal_boxes_are_matched_by_kinds(spark, pairs_met, task_pairs):
    """With ids that occur once; a loop over all pairs says what each detection gets."""
    r = np.random.default_rng(6)
    found, truth = copies(r, 12, 20), copies(r, 6, 15, 1000)
    taken, want = set(), {}
    for b in sorted(found, key=lambda b: (-b[2], b[1])):
        best = min(((-iou(b, t), t[1]) for t in truth if t[1] not in taken), default=(0, None))
        want[b[1]] = best[1] if -best[0] >= 0.15 else None
        taken.add(want[b[1]])
    got = evaluate.match(spark.createDataFrame(found, BOXES), spark.createDataFrame(truth, BOXES).drop("score"), ["frame"], 0.15, task_pairs).collect()
    assert {g.id: g.gt_id for g in got} == want and len({v for v in want.values() if v is not None}) > 30
    assert pairs_met and max(pairs_met) <= 12 * 6


def test_overlap_without_headings_is_not_rounded():
    """Sides on a lattice of eighths: what is shared is exact, so equal overlaps are equal numbers, as in SQL."""
    r = np.random.default_rng(7)
    a, b = (np.concatenate([r.integers(-24, 24, (4000, 3)) / 8, r.integers(4, 40, (4000, 3)) / 8, np.zeros((4000, 1))], 1) for _ in "ab")
    shared = np.prod([np.maximum(np.minimum(a[:, k] + a[:, k + 3] / 2, b[:, k] + b[:, k + 3] / 2) - np.maximum(a[:, k] - a[:, k + 3] / 2, b[:, k] - b[:, k + 3] / 2), 0) for k in range(3)], axis=0)
    assert (evaluate.box_iou(a, b) == shared / (a[:, 3:6].prod(1) + b[:, 3:6].prod(1) - shared)).all()


def test_best_pairs_of_equal_boxes(spark, pairs_met):
    r = np.random.default_rng(8)
    found, truth = copies(r, 12, 20), copies(r, 6, 15, 1000)
    want = {t[1]: min(((-round(iou(t, b), 9), b[1]) for b in found if iou(t, b) > 0), default=(0, None))[1] for t in truth}
    typed = [spark.createDataFrame(x, BOXES).withColumn("cls", F.col("id") % 3) for x in (truth, found)]
    got = labelling.best_pairs(typed[0].drop("score"), typed[1], ["frame"]).collect()
    assert {g.gt_id: g.id for g in got} == want and all(g.cls == g.id % 3 and g.gt_cls == g.gt_id % 3 for g in got if g.id is not None)
    assert pairs_met and max(pairs_met) <= 12 * 6


def test_a_sweep_is_clustered_by_its_voxels(spark):
    """No task holds a sweep's points, and points without a place are in no cluster."""
    r = np.random.default_rng(9)
    xyz = np.concatenate([r.normal(c, 0.3, (60, 3)) for c in ((0, 0, 0), (9, 0, 0), (0, 9, 1))])
    p = spark.createDataFrame(pd.DataFrame({"frame": 0, "pid": range(len(xyz)), **dict(zip("xyz", xyz.T))}))
    odd = spark.createDataFrame([(0, 900, None, 0.0, 0.0), (0, 901, float("nan"), 0.0, 0.0), (None, 902, 0.0, 0.0, 0.0)], "frame BIGINT, pid BIGINT, x DOUBLE, y DOUBLE, z DOUBLE")
    got = cluster.cluster_points(p.unionByName(odd), ["frame"], 0.5, 20, 200)
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()
    rows = {g.pid: g.cluster_id for g in got.collect()}
    want = {g.pid: g.cluster_id for g in tiles.clusters(p, ["frame"], 0.5, 20, 200, tile=8).collect()}
    assert rows == want | {900: None, 901: None, 902: None} and len(set(want.values())) > 2


@pytest.mark.parametrize("dealt", [0, 10**6])
def test_points_meet_different_boxes(spark, monkeypatch, dealt):
    monkeypatch.setattr(evaluate, "DEALT", dealt)
    r = np.random.default_rng(10)
    boxes = spark.createDataFrame(copies(r, 5, 8), BOXES).withColumn("cls", F.col("id") % 3).drop("score")
    points = spark.createDataFrame([(0, *(float(v) for v in r.uniform(-6, 6, 3) * (1, 1, 0.1))) for _ in range(400)], "frame INT, x DOUBLE, y DOUBLE, z DOUBLE")
    count = lambda b: evaluate.points_in_boxes(points, b, ["frame"]).groupBy("frame", "id").agg(F.count(F.lit(1)).alias("n"))
    kinds = evaluate.different(boxes, ["frame"])
    got = evaluate.of_equals(boxes, kinds, count(kinds), ["frame"])
    assert kinds.count() == 5 and {g.id: g.n for g in got.collect()} == {g.id: g.n for g in count(boxes).collect()}
    assert ("merge" in count(boxes)._jdf.queryExecution().logical().toString().lower()) == (dealt == 0)
