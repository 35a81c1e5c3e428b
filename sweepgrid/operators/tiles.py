"""Connected voxels of clouds of any size: components within tiles, then components of components.

Each tile labels its voxels by itself. Voxels on the faces of tiles meet their neighbours in other tiles by an
equality join, which gives edges between labels. Tiles are then put together eight by eight along each axis: edges
inside one such block are settled there by one task and leave; the others go on to the next level. So the number of
levels is the logarithm of the cloud's extent, whatever the shape of a component, and a task holds the edges across
the inner faces of its block: the surface of tiles, never the voxels inside.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sweepgrid.operators.cluster import MAX_POINTS, MIN_POINTS, VOXEL, voxel_labels
from sweepgrid.operators.order import numbered
from sweepgrid.sources.workspace import written

PLACE = ("vx", "vy", "vz")
#: Voxels along a tile, and tiles along a block.
TILE, FAN = 64, 8
_AHEAD = [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) if (x, y, z) > (0, 0, 0)]


def smallest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest number of each of 0 … n - 1's component, with edges a - b; the forest is halved as it is walked."""
    parent = np.arange(n)
    while len(a):
        low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
        open_ = low != high
        a, b, low, high = a[open_], b[open_], low[open_], high[open_]
        np.minimum.at(parent, high, low)
        while (parent[parent] != parent).any():
            parent = parent[parent]
    return parent


def connected(voxels: DataFrame, keys: list[str], tile: int = TILE) -> DataFrame:
    """(keys, vx, vy, vz, lx, ly, lz) of the different voxels: each with the smallest voxel of its 26-connected component."""
    label = ("lx", "ly", "lz")
    types = dict(voxels.dtypes)
    by = "".join(f"`{k}` {types[k]}, " for k in keys)
    numbers = lambda names: ", ".join(f"{c} BIGINT" for c in names)

    def alone(t: pa.Table) -> pa.Table:
        v = np.stack([t.column(c).to_numpy() for c in PLACE], 1)
        name = np.unique(v, axis=0)[voxel_labels(*v.T)]
        for k, c in enumerate(label):
            t = t.append_column(c, pa.array(name[:, k]))
        return t.select([*keys, *PLACE, *label])

    cut = [F.floor(F.col(c) / tile).alias(f"t{c}") for c in PLACE]
    own = voxels.select(*keys, *[F.col(c).cast("bigint").alias(c) for c in PLACE]).distinct()
    own = written(own.select("*", *cut).groupBy(*keys, *[f"t{c}" for c in PLACE]).applyInArrow(alone, f"{by}{numbers(PLACE + label)}"), "tile-labels")

    # edges between labels of neighbours in different tiles; only voxels on a face can have one
    rest = [F.pmod(F.col(c), F.lit(tile)) for c in PLACE]
    face = own.where(F.greatest(*[F.when((r == 0) | (r == tile - 1), 1).otherwise(0) for r in rest]) == 1)
    moves = F.array(*[F.struct(*[F.lit(d).alias(c) for c, d in zip(PLACE, m)]) for m in _AHEAD])
    sent = face.withColumn("m", F.explode(moves)).select(*keys, *[F.col(c).alias(f"a{c}") for c in label], *[F.floor(F.col(c) / tile).alias(f"o{c}") for c in PLACE], *[(F.col(c) + F.col(f"m.{c}")).alias(c) for c in PLACE])
    other = " OR ".join(f"o{c} <> floor({c} / {tile})" for c in PLACE)
    # each end says in which tile it lies, its label says nothing of that
    edges = sent.where(other).join(face.select(*keys, *PLACE, *[F.col(c).alias(f"b{c}") for c in label]), [*keys, *PLACE])
    ends = [f"{s}{c}" for s in "ab" for c in label]
    edges = written(edges.select(*keys, *[F.col(f"o{c}").alias(f"p{c}") for c in PLACE], *[F.floor(F.col(c) / tile).alias(f"q{c}") for c in PLACE], *ends).distinct(), "tile-edges")

    def settled(t: pa.Table) -> pa.Table:
        a, b = (np.stack([t.column(f"{s}{c}").to_numpy() for c in label], 1) for s in "ab")
        names, place = np.unique(np.concatenate([a, b]), axis=0, return_inverse=True)
        place = place.reshape(-1)
        root = smallest(place[: len(a)], place[len(a) :], len(names))
        moved = np.flatnonzero(root != np.arange(len(names)))
        head = t.select(keys).slice(0, 1).take(pa.array(np.zeros(len(moved), np.int64))) if keys else None
        columns = {k: head.column(k) for k in keys} | {c: pa.array(names[moved, k]) for k, c in enumerate(label)} | {f"n{c}": pa.array(names[root[moved], k]) for k, c in enumerate(label)}
        return pa.table(columns)

    def renamed(df: DataFrame, names: DataFrame, at: tuple[str, ...]) -> DataFrame:
        """Labels in columns ``at`` by their new names."""
        new = names.select(*keys, *[F.col(c).alias(a) for c, a in zip(label, at)], *[F.col(f"n{c}") for c in label])
        out = df.join(new, [*keys, *at], "left")
        return out.withColumns({a: F.coalesce(f"n{c}", a) for c, a in zip(label, at)}).drop(*[f"n{c}" for c in label])

    side, done = 1, own
    # blocks are counted from the first tile of all, so that tiles on both sides of nought come together
    low = edges.agg(*[F.min(F.least(f"p{c}", f"q{c}")).alias(c) for c in PLACE]).first()
    while not edges.isEmpty():
        side *= FAN
        block = lambda s: [F.floor((F.col(f"{s}{c}") - low[c]) / side) for c in PLACE]  # noqa: B023, E731
        inside = F.lit(True)
        for p, q in zip(block("p"), block("q")):
            inside = inside & (p == q)
        # labels name voxels, so an edge is settled in the block of its ends; null where it goes on
        names = edges.where(inside).groupBy(*keys, *[b.alias(f"g{c}") for b, c in zip(block("p"), PLACE)]).applyInArrow(settled, f"{by}{numbers(label)}, {numbers([f'n{c}' for c in label])}")
        names = written(names, "tile-names")
        edges = edges.where(~inside)
        for s in "ab":
            edges = renamed(edges, names, tuple(f"{s}{c}" for c in label))
        edges = written(edges.distinct(), "tile-edges")
        done = renamed(done, names, label)
    return done.select(*keys, *PLACE, *label)


def clusters(points: DataFrame, keys: list[str], voxel: float = VOXEL, least: int = MIN_POINTS, most: int = MAX_POINTS, tile: int = TILE) -> DataFrame:
    """As ``cluster.cluster_points``, of clouds that no task could hold: adds cluster_id, 0, 1, … by the clusters' smallest
    voxel, null outside the size limits. Voxels are counted from each cloud's smallest coordinates."""
    low = points.groupBy(*keys).agg(*[F.min(c).alias(f"__{c}") for c in "xyz"])
    joined = points.join(low, keys) if keys else points.join(F.broadcast(low))  # one row
    p = joined.withColumns({v: F.floor((F.col(c) - F.col(f"__{c}")) / voxel) for c, v in zip("xyz", PLACE)}).drop("__x", "__y", "__z")
    voxels = connected(p, keys, tile)
    count = p.groupBy(*keys, *PLACE).agg(F.count(F.lit(1)).alias("__n")).join(voxels, [*keys, *PLACE])
    sizes = count.groupBy(*keys, "lx", "ly", "lz").agg(F.sum("__n").alias("__n")).where(F.col("__n").between(least, most))
    number = numbered(sizes, keys, "lx", [F.col("ly"), F.col("lz")]).select(*keys, "lx", "ly", "lz", (F.col("rn") - 1).cast("bigint").alias("cluster_id"))
    named = voxels.join(number, [*keys, "lx", "ly", "lz"], "left").select(*keys, *PLACE, "cluster_id")
    return p.join(named, [*keys, *PLACE]).select(*points.columns, "cluster_id")
