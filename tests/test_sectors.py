"""Ground by sector against a loop over sectors, for any cut into batches; and what the plans read."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from sweepgrid.operators import drive, sectors
from sweepgrid.plans import catalogue

SF = "/root/testdata/sf0.001"


def cloud(n, seed=1):
    r = np.random.default_rng(seed)
    t = pd.DataFrame({"frame": r.integers(0, 3, n), "ok": range(n), "x": r.uniform(-60, 60, n), "y": r.uniform(-60, 60, n)})
    t["z"] = np.where(r.random(n) < 0.7, -1.73 + 0.02 * t["x"] + r.normal(0, 0.05, n), r.uniform(-2, 3, n))
    t.loc[t["x"].abs() < 8, "z"] = 2.5  # no ground at all
    return t


def by_hand(t):
    """Sector -> (plane, ground points, MAD, height) and point -> (ground, agl)."""
    r = np.sqrt(t["x"] ** 2 + t["y"] ** 2)
    t = t.assign(ri=np.floor(np.minimum(np.sqrt(r / 70), 0.999) * 24), ai=np.clip(np.floor((np.arctan2(t["y"], t["x"]) + np.pi) / (2 * np.pi) * 72), 0, 71))
    found, points = {}, {k: (False, z + 1.73) for k, z in zip(t["ok"], t["z"])}
    for key, s in t[r <= 70].groupby(["frame", "ri", "ai"]):
        if len(s) < 8:
            continue
        s = s.sort_values("z")
        k = max(len(s) // 4, 3)
        if s["z"].iloc[k - 1] - s["z"].iloc[0] > 1:
            k = max(k // 2, 3)
        low = s.iloc[:k]
        m = np.stack([low["x"], low["y"], np.ones(k)], 1)
        a, b, c = np.linalg.lstsq(m, low["z"], rcond=None)[0] if abs(np.linalg.det(m.T @ m)) >= 1e-12 else (0, 0, low["z"].mean())
        if np.hypot(a, b) > 0.35:
            a, b, c = 0, 0, low["z"].mean()
        if c > 1.5 - 1.73 or c < -2 - 1.73:
            a, b, c = 0, 0, -1.73
        agl = s["z"] - (a * s["x"] + b * s["y"] + c)
        g = agl < 0.25
        n = int(g.sum())
        mad = 1.4826 * np.median(np.abs(agl[g] - np.median(agl[g]))) if n > 4 else 0
        found[tuple(map(int, key))] = (a, b, c, n, mad, a * s["x"][g].mean() + b * s["y"][g].mean() + c if n > 4 else 0)
        points |= {i: (bool(x), v) for i, x, v in zip(s["ok"], g, agl)}
    return found, points


@pytest.mark.parametrize("batch", [7, 10000])
def test_planes_ground_and_scatter(spark, batch):
    t = cloud(12_000)
    found, points = by_hand(t)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(t)
        got = {(r.frame, r.ri, r.ai): (r.a, r.b, r.c, r.n, r.rough, r.h) for r in sectors.sectors(df, ("frame",)).collect()}
        each = {r.ok: (r.ground, r.agl) for r in sectors.ground_points(df, ("frame",)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.keys() == found.keys() and len(got) > 300
    for k, v in found.items():
        assert got[k] == pytest.approx(v, abs=1e-6), k
    assert each.keys() == points.keys()
    assert sum(each[k][0] != v[0] for k, v in points.items()) == 0
    assert all(each[k][1] == pytest.approx(v[1], abs=1e-6) for k, v in points.items())


def test_planes_that_are_given(spark):
    df = spark.createDataFrame(cloud(3000))
    own = sectors.ground_points(df, ("frame",)).select("ok", "ground", F.round("agl", 9).alias("agl"))
    planes = sectors.sectors(df, ("frame",)).select("frame", "ri", "ai", "a", "b", "c")
    given = drive.remove_ground(df, planes, ("frame",)).select("ok", "ground", F.round("agl", 9).alias("agl"))
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, given.collect()))


def test_neighbours_wrap_and_rings_end(spark):
    r = np.random.default_rng(2)
    h, n, v = r.random((24, 72)), r.integers(3, 9, (24, 72)), np.where(r.random((24, 72)) < 0.3, np.nan, r.random((24, 72)))
    there = r.random((24, 72)) < 0.8
    rows = [(0, i, j, float(h[i, j]), int(n[i, j]), None if np.isnan(v[i, j]) else float(v[i, j])) for i, j in np.argwhere(there).tolist()]
    df = spark.createDataFrame(rows, "frame INT, ri INT, ai INT, h DOUBLE, n BIGINT, score DOUBLE")
    step = {(r.ri, r.ai): r.step for r in sectors.sector_step(df, ("frame",)).collect()}
    smooth = {(r.ri, r.ai): r.smooth for r in sectors.polar_smooth(df.drop("frame")).collect()}
    for _, i, j, *_ in rows:
        near = [(i, (j + 1) % 72), (i, (j - 1) % 72), (i + 1, j), (i - 1, j)]
        ok = [abs(h[i, j] - h[p]) for p in near if 0 <= p[0] < 24 and there[p] and n[p] >= 5 and n[i, j] >= 5]
        assert step[i, j] == pytest.approx(max(ok, default=0.0))
        clamped = [v[min(max(a, 0), 23), b] for a, b in [(i, j), *near] if there[min(max(a, 0), 23), b]]
        clamped = [x for x in clamped if not np.isnan(x)]
        assert smooth[i, j] == (None if np.isnan(v[i, j]) else pytest.approx(np.median(clamped)))


@pytest.mark.parametrize("name,scans,exchanges", [("q_sector_ground", 1, 1), ("q_polar_drivability", 1, 2), ("q_kerb", 1, 2), ("q_polar_smooth", 1, 3), ("q_ground_points", 1, 2)])
def test_points_are_read_once(spark, name, scans, exchanges):
    plan = catalogue.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("FileScan", plan)) == scans and len(re.findall(r"\bExchange ", plan)) <= exchanges
