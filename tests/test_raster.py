"""Rasters by strips and blocks against brute force and against whole arrays."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from sweepgrid.operators import raster


def brute(a):
    """Distance and the values that are as near, of each cell."""
    seen = np.argwhere(~np.isnan(a))
    near = {}
    for i, j in np.ndindex(a.shape):
        d = ((seen - (i, j)) ** 2).sum(1)
        near[i, j] = d.min(), seen[d == d.min()]
    return near


@pytest.mark.parametrize("shape,share", [((1, 1), 1), ((1, 40), 0.1), ((40, 1), 0.1), ((23, 31), 0.02), ((23, 31), 0.3), ((31, 17), 0.005), ((12, 12), 1)])
def test_nearest_fill_is_exact(shape, share):
    r = np.random.default_rng(shape[0] * 100 + int(share * 10))
    for _ in range(6):
        a = np.where(r.random(shape) < share, r.random(shape), np.nan)
        a[r.integers(0, shape[0]), r.integers(0, shape[1])] = 0.5
        filled, distance = raster.nearest_fill(a)
        for (i, j), (d, cells) in brute(a).items():
            assert distance[i, j] ** 2 == pytest.approx(d) and filled[i, j] in {a[tuple(c)] for c in cells}


def whole(t):
    """A sweep's surfaces from one array."""
    ox, oy = t["gx"].min(), t["gy"].min()
    raw = np.full((t["gx"].max() - ox + 1, t["gy"].max() - oy + 1), np.nan)
    raw[t["gx"] - ox, t["gy"] - oy] = t["height"]
    filled, distance = raster.nearest_fill(raw)
    r = raster.median3(filled)
    out = {"height": r, "gdist": distance * raster.RES, "step": r - raster.minimum(r), "trend": raster.mean(r)}
    return {(int(i + ox), int(j + oy)): tuple(v[i, j] for v in out.values()) for i, j in np.ndindex(r.shape)}


@pytest.mark.parametrize("block", [9, 10, 16, 512])
def test_blocks_are_the_whole(spark, block):
    r, rows = np.random.default_rng(7), []
    for f, (nx, ny, n) in enumerate([(45, 33, 60), (3, 50, 20), (1, 1, 1), (20, 20, 400)]):
        at = {(int(a), int(b)) for a, b in zip(r.integers(-nx // 2, nx // 2 + 1, n), r.integers(5, 5 + ny, n))}
        rows += [(f, a, b, float(r.random())) for a, b in sorted(at)]
    t = pd.DataFrame(rows, columns=["frame", "gx", "gy", "height"])
    got = raster.ground_surfaces(spark.createDataFrame(t), ["frame"], block).toPandas()
    for f, part in t.groupby("frame"):
        mine = {(g.gx, g.gy): (g.height, g.gdist, g.step, g.trend) for g in got[got["frame"] == f].itertuples()}
        want = whole(part)
        assert mine.keys() == want.keys()
        for k, v in want.items():
            assert mine[k] == pytest.approx(v, abs=1e-12)


def test_a_raster_of_sixteen_million_cells(spark):
    r = np.random.default_rng(1)
    n = 4096
    t = pd.DataFrame({"gx": r.integers(0, n, 20_000), "gy": r.integers(0, n, 20_000)}).drop_duplicates()
    t = pd.concat([t, pd.DataFrame({"gx": [0, n - 1], "gy": [0, n - 1]})]).drop_duplicates()
    cells = spark.createDataFrame(t.assign(height=(t["gx"] % 7) / 8))
    began = time.time()
    got = raster.ground_surfaces(cells, []).agg(F.count(F.lit(1)).alias("n"), F.max("gdist").alias("far"), F.count_if(F.col("gdist") == 0).alias("seen")).first()
    assert got["n"] == n * n and got["seen"] == len(t) and 0 < got["far"] < 200
    assert time.time() - began < 240
