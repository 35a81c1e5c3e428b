"""Voxel clusters, their orientation and canonical frames, sampling, features and classification."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sweepgrid.operators.order import numbered
from sweepgrid.sources.workspace import written

VOXEL, MIN_POINTS, MAX_POINTS, SAMPLE = 0.30, 20, 6000, 256
#: Narrow rows that every executor may hold beside the points they meet; more meet them by sort-merge.
BROADCAST = 200_000


def voxel_labels(ix: np.ndarray, iy: np.ndarray, iz: np.ndarray) -> np.ndarray:
    """Label of each voxel's 26-connected component: its smallest voxel in (x, y, z) order."""
    v, place = np.unique(np.stack([ix, iy, iz], 1), axis=0, return_inverse=True)
    v = v - v.min(0) + 1
    size = v.max(0) + 2
    key = (v[:, 0] * size[1] + v[:, 1]) * size[2] + v[:, 2]
    label = np.arange(len(v))
    edges = []
    for dx, dy, dz in ((x, y, z) for x in (0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) if (x, y, z) > (0, 0, 0)):
        other = key + (dx * size[1] + dy) * size[2] + dz
        at = np.minimum(np.searchsorted(key, other), len(key) - 1)
        hit = np.flatnonzero(key[at] == other)
        edges.append((hit, at[hit]))
    a, b = (np.concatenate(x) for x in zip(*edges))
    while True:
        new = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label[place.reshape(-1)]
        label = new


def cluster_points(points: DataFrame, keys: list[str], voxel: float = VOXEL, least: int = MIN_POINTS, most: int = MAX_POINTS) -> DataFrame:
    """Adds cluster_id per sweep: 0, 1, … by the clusters' smallest voxel; null outside the size limits.

    Points are counted by voxel, and a sweep's voxels, which the sensor bounds however many points they hold, are the unit
    of work; ``tiles.clusters`` does the same to clouds of any extent. The points are read three times.
    """
    named = lambda df: df.withColumnsRenamed({k: f"__{k}" for k in keys})
    met = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    low = points.groupBy(*keys).agg(*[F.min(F.col(c).cast("double")).alias(f"__low_{c}") for c in "xyz"])
    places = [f"__v{c}" for c in "xyz"]
    at = {v: F.when(~F.isnan(F.col(c).cast("double")), F.floor((F.col(c).cast("double") - F.col(f"__low_{c}")) / voxel)) for c, v in zip("xyz", places)}
    p = points.join(F.broadcast(named(low)), met).select(*points.columns, *[e.alias(v) for v, e in at.items()])  # a row a sweep
    types = dict(points.dtypes)

    def work(t: pa.Table) -> pa.Table:
        kinds, place = np.unique(voxel_labels(*(t.column(v).to_numpy() for v in places)), return_inverse=True)
        count = np.bincount(place, t.column("__n").to_numpy(), len(kinds))
        good = (count >= least) & (count <= most)
        keep = pa.array(good[place])
        number = np.where(good, np.cumsum(good) - 1, 0)[place]
        return t.drop_columns(["__n"]).append_column("cluster_id", pa.array(number, pa.int64())).filter(keep)

    count = p.groupBy(*keys, *places).agg(F.count(F.lit(1)).alias("__n")).where(" AND ".join(f"{v} IS NOT NULL" for v in places))
    voxels = written(count.groupBy(*keys).applyInArrow(work, "".join(f"`{k}` {types[k]}, " for k in keys) + "".join(f"{v} BIGINT, " for v in places) + "cluster_id BIGINT"), "voxels")
    voxels = named(voxels.withColumnsRenamed({v: f"_{v}" for v in places}))
    voxels = F.broadcast(voxels) if voxels.count() <= BROADCAST else voxels.hint("merge")
    return p.join(voxels, [*met, *[F.col(v) == F.col(f"_{v}") for v in places]], "left").select(*points.columns, "cluster_id")


def pca_yaw(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, mx, my, yaw): direction of most spread in plan, pointing where the third moment is positive."""
    mean = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    d = points.join(mean, keys).withColumns({"dx": F.col("x") - F.col("mx"), "dy": F.col("y") - F.col("my")})
    m = d.groupBy(*keys).agg(F.sum(F.col("dx") * F.col("dx")).alias("a"), F.sum(F.col("dx") * F.col("dy")).alias("b"), F.sum(F.col("dy") * F.col("dy")).alias("c"))
    half, det = (F.col("a") + F.col("c")) / 2, F.col("a") * F.col("c") - F.col("b") * F.col("b")
    lam = half + F.sqrt(F.greatest(half * half - det, F.lit(0.0)))
    tilted = F.abs("b") > 1e-15
    m = m.withColumns({"vx": F.when(tilted, lam - F.col("c")).when(F.col("a") >= F.col("c"), 1.0).otherwise(0.0), "vy": F.when(tilted, F.col("b")).when(F.col("a") >= F.col("c"), 0.0).otherwise(1.0)})
    skew = d.join(m.select(*keys, "vx", "vy"), keys).groupBy(*keys).agg(F.sum(F.pow(F.col("dx") * F.col("vx") + F.col("dy") * F.col("vy"), F.lit(3.0))).alias("skew"))
    out = mean.join(m, keys).join(skew, keys)
    sign = F.when(F.col("skew") < 0, -1.0).otherwise(1.0)
    return out.select(*keys, "n", "mx", "my", F.when(F.col("n") < 3, 0.0).otherwise(F.atan2(sign * F.col("vy"), sign * F.col("vx"))).alias("yaw"))


def canonical(points: DataFrame, frames: DataFrame, keys: list[str], max_range: float = 50.0) -> DataFrame:
    """Features fx, fy, fz (turned, centred, scaled to the unit ball), fagl, frange of cluster points."""
    p = points.join(frames.select(*keys, "yaw"), keys)
    w = Window.partitionBy(*keys)
    d = {c: F.col(c) - F.avg(c).over(w) for c in "xyz"}
    p = p.withColumns({f"__{c}": e for c, e in d.items()})
    c, s = F.cos("yaw"), F.sin("yaw")
    p = p.withColumns({"__u": c * F.col("__x") + s * F.col("__y"), "__v": c * F.col("__y") - s * F.col("__x")})
    p = p.withColumn("__s", F.greatest(F.sqrt(F.max(F.col("__u") * F.col("__u") + F.col("__v") * F.col("__v") + F.col("__z") * F.col("__z")).over(w)), F.lit(1e-6)))
    out = p.withColumns({"fx": F.col("__u") / F.col("__s"), "fy": F.col("__v") / F.col("__s"), "fz": F.col("__z") / F.col("__s"), "frange": F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")) / max_range})
    if "agl" in points.columns:
        out = out.withColumn("fagl", F.col("agl") / 3)
    return out.drop("__x", "__y", "__z", "__u", "__v", "__s")


def sample(points: DataFrame, keys: list[str], ids: list[str], n: int = SAMPLE, seed: int = 0) -> DataFrame:
    """Exactly ``n`` points of each cluster in a seeded order by hash (column slot); short clusters go round again."""
    w = Window.partitionBy(*keys)
    p = points.withColumns({"__r": F.row_number().over(w.orderBy(F.xxhash64(F.lit(seed), *ids), *ids)) - 1, "__n": F.count(F.lit(1)).over(w)})
    p = p.where(F.col("__r") < n)
    slots = F.sequence(F.col("__r"), F.lit(n - 1), F.least(F.col("__n"), F.lit(n)).cast("int"))
    return p.withColumn("slot", F.explode(slots)).drop("__r", "__n")


def split_blocks(frames: DataFrame, column: str = "frame", blocks: int = 20, val: float = 0.1, test: float = 0.1, seed: int | None = None) -> DataFrame:
    """(column, block, split): near-equal runs of frames, the first ones longer by one, dealt whole to train, val and test."""
    b = numbered(frames.select(column).distinct(), [], column)
    whole = b.agg(F.count(F.lit(1)).alias("__n"))
    b = b.join(F.broadcast(whole)).withColumns({"__q": F.expr(f"__n div {blocks}"), "__r": F.col("__n") % blocks})  # one row
    long = F.col("__r") * (F.col("__q") + 1)
    block = F.when(F.col("rn") <= long, F.expr("(rn - 1) div (__q + 1)") + 1).otherwise(F.col("__r") + F.expr("(rn - 1 - __r * (__q + 1)) div __q") + 1)
    b = b.select(column, block.cast("int").alias("block"))
    key = F.col("block") if seed is None else F.xxhash64(F.lit(seed), "block")
    order = b.select("block").distinct().withColumn("__o", F.row_number().over(Window.orderBy(key, "block")))  # a row a block
    nv, nt = round(blocks * val), round(blocks * test)
    split = F.when(F.col("__o") <= nv, "val").when(F.col("__o") <= nv + nt, "test").otherwise("train")
    return b.join(order, "block").select(column, "block", split.alias("split"))


def proposal_labels(fractions: DataFrame, keys: list[str]) -> DataFrame:
    """Class of each cluster from the shares of its points in boxes (columns gt, cls, frac, ignored): the best
    box from a half on, background up to a twentieth, dropped between and where ignored boxes hold a part."""
    best = fractions.where("NOT ignored").groupBy(*keys).agg(F.max(F.struct("frac", (-F.col("gt")).alias("g"), "cls")).alias("best"))
    bad = fractions.where("ignored").groupBy(*keys).agg(F.max("frac").alias("bad"))
    out = best.join(bad, keys, "full")
    frac = F.coalesce(F.col("best.frac"), F.lit(0.0))
    keep = (F.coalesce(F.col("bad"), F.lit(0.0)) <= 0.05) & ((frac >= 0.5) | (frac <= 0.05))
    return out.where(keep).select(*keys, F.when(frac >= 0.5, F.col("best.cls")).otherwise(0).alias("cls"), F.when(frac >= 0.5, -F.col("best.g")).alias("gt"), frac.alias("frac"))


Classifier = Callable[[pd.DataFrame], np.ndarray]


def geometric_classifier(extents: pd.DataFrame) -> np.ndarray:
    """Stand-in for a trained network, whose weights are not public: class probabilities from a box's size
    (columns l, w, h) as (background, car, pedestrian)."""
    size = extents[["l", "w", "h"]].to_numpy(float)
    car = np.exp(-(((size - [4.0, 1.7, 1.6]) / [1.5, 0.6, 0.5]) ** 2).sum(1))
    walker = np.exp(-(((size - [0.7, 0.6, 1.7]) / [0.4, 0.4, 0.4]) ** 2).sum(1))
    rest = np.maximum(1 - car - walker, 0.05)
    p = np.stack([rest, car, walker], 1)
    return p / p.sum(1, keepdims=True)


def classify(extents: DataFrame, model: Classifier = geometric_classifier, least: float = 0.5) -> DataFrame:
    """Adds cls and score = 1 - p(background) to clusters; rows below ``least`` and background go."""
    schema = T.StructType([*extents.schema.fields, T.StructField("cls", T.IntegerType()), T.StructField("score", T.DoubleType())])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            p = model(t)
            top = p.argmax(1)
            keep = (top > 0) & (1 - p[:, 0] >= least)
            yield t.assign(cls=top.astype("int32"), score=1 - p[:, 0])[keep]

    return extents.mapInPandas(work, schema)


def rank_nearest(points: DataFrame, keys: list[str], distance: Column, ids: list[str], share: float = 0.5, least: int = 8) -> DataFrame:
    """The nearest part of each cluster to a viewpoint: what a second sensor would still see."""
    w = Window.partitionBy(*keys)
    p = points.withColumns({"__r": F.row_number().over(w.orderBy(distance, *ids)), "__n": F.count(F.lit(1)).over(w)})
    return p.where(F.col("__r") <= F.greatest(F.floor(F.col("__n") * share), F.lit(least))).drop("__r", "__n")
