"""The world map as a table of cells: each sweep is merged by Spark jobs, whatever the map's size.

Sweeps follow one another, as the drift of each is measured against the map so far; within a sweep all
work is joins and aggregations over the cells of the tiles it touches. A version counts once its manifest is
written, so a killed run resumes at the last one, and a lost executor costs its tasks only.
"""

from __future__ import annotations

import math
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sweepgrid.functions import geometry as geo
from sweepgrid.operators import grid, worldmap
from sweepgrid.sources.store import Store
from sweepgrid.sources.workspace import work_folder

POSITION = ("tx", "ty", "tz")


def sweep_cells(points: DataFrame, poses: DataFrame, res: float = 0.4, trust: float = worldmap.TRUST, range_dims: int = 2) -> DataFrame:
    """World cells of sweeps, keyed by frame: trusted points that do not move, weighted by range.

    A boolean column ``moving``, if there is one, marks what is held out.
    """
    moving = F.coalesce(F.col("moving"), F.lit(False)) if "moving" in points.columns else None
    near = worldmap.trusted(points, trust, moving).withColumn("__w", worldmap.weight(range_dims))
    world = geo.transform(near, poses).withColumns({"x": F.col("wx"), "y": F.col("wy"), "z": F.col("wz")})
    return grid.quantise(world, res, ("frame",), F.col("__w"))


class WorldTable:
    """One map in a folder, which any process can go on with.

    ``cells/<name>/tile=…`` hold cells by square tiles; ``manifest/<version>`` names the files of each tile and is
    written last, so a version is there whole or not at all. A sweep reads and rewrites the tiles that it touches.
    Other tiles keep their files: those out of reach leave the manifest, and those that the circle of ``reach`` cuts
    keep the sensor's position, by which their cells are filtered when they are read. Sweeps of a named source, and
    micro-batches of a stream, are counted in the manifest with the cells, so what is repeated after a failure begins
    with the first sweep that is not in the map. The ``kept`` last versions stay readable. With ``sketches``, each
    tile's statistics lie beside its files.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, res: float = 0.4, reach: float = worldmap.PRUNE, common: int = 40, align: bool = True, weighted: bool = False, tile: int = 64, kept: int = 3, sketches: bool = False):
        self.spark, self.folder = spark, (folder or work_folder(spark, "world")).rstrip("/")
        self.res, self.reach, self.common, self.align, self.weighted, self.tile, self.kept, self.sketches = res, reach, common, align, weighted, tile, kept, sketches
        self.store, self.drifts = Store(spark, self.folder), {}

    @property
    def state(self) -> dict:
        """The last committed version: its number, ``tiles`` (files and positions yet to prune by), ``sources``."""
        names = [n for n in self.store.names("manifest") if not n.startswith(".")]
        return self.store.get(f"manifest/{names[-1]}") if names else {"version": 0, "tiles": {}, "sources": {}}

    @property
    def version(self) -> int:
        return self.state["version"]

    def _tiles(self, tiles: dict) -> DataFrame | None:
        """Cells of tiles of a manifest, without those that a sensor's position since has left out of reach."""
        if not tiles:
            return None
        out = self.spark.read.parquet(*[f"{self.folder}/cells/{t['files']}/tile={k}" for k, t in sorted(tiles.items())])
        cuts: dict[tuple, list[str]] = {}
        for k, t in tiles.items():
            for x, y in t["cuts"]:
                cuts.setdefault((x, y), []).append(k)
        for (x, y), names in cuts.items():
            out = out.where(~tile_of(self.tile).isin(names) | worldmap.within(x, y, self.res, self.reach))
        return out

    def read(self) -> DataFrame | None:
        """The cells of the map; None while it is empty."""
        return self._tiles(self.state["tiles"])

    def stats(self) -> DataFrame | None:
        """``worldmap.map_stats`` of the map from its tiles' sketches; only tiles that are still to be pruned are read."""
        tiles = self.state["tiles"]
        if not self.sketches or not tiles:
            return worldmap.map_stats(self.read()) if tiles else None
        parts = []
        if cut := {k: t for k, t in tiles.items() if t["cuts"]}:
            parts.append(worldmap.map_sketches(self._tiles(cut), [tile_of(self.tile).alias("tile")]))
        for files in sorted({t["files"] for t in tiles.values() if not t["cuts"]}):
            parts.append(self.spark.read.parquet(f"{self.folder}/sketches/{files}").where(F.col("tile").isin([k for k, t in tiles.items() if t["files"] == files and not t["cuts"]])))
        return worldmap.merged_stats(reduce(DataFrame.unionByName, [p.select("cells", "singles", "sketch") for p in parts]))

    def reset(self) -> None:
        """The next sweep begins a new map; its sources begin again too."""
        now = self.state
        self._commit({"version": now["version"] + 1, "tiles": {}, "sources": {}})
        self.drifts = {}

    def _commit(self, state: dict) -> None:
        self.store.put(f"manifest/{state['version']:012d}", state)
        old = [n for n in self.store.names("manifest") if not n.startswith(".")][: -self.kept]
        if old:
            held = {t["files"] for n in self.store.names("manifest")[-self.kept :] for t in self.store.get(f"manifest/{n}")["tiles"].values()}
            for name in old:
                for files in {t["files"] for t in self.store.get(f"manifest/{name}")["tiles"].values()} - held:
                    self.store.remove(f"cells/{files}")
                    self.store.remove(f"sketches/{files}")
                self.store.remove(f"manifest/{name}")

    def ingest(self, cells: DataFrame, x: float, y: float, frame: int | None = None, touched: list[str] | None = None, source: str | None = None, batch: int = 0) -> float:
        """Merge one sweep's cells, seen from (x, y), and commit; the drift that was taken out of it.

        ``touched`` names the cells' tiles where the caller knows them; the sensor bounds their number.
        """
        now = self.state
        if touched is None:
            touched = [r[0] for r in cells.select(tile_of(self.tile)).distinct().collect()]
        # a tile that was cut often is rewritten, so that it is read by a filter of bounded size
        touched = set(touched) | {k for k, t in now["tiles"].items() if len(t["cuts"]) >= 64}
        world, dz = self._tiles({k: t for k, t in now["tiles"].items() if k in touched}), 0.0
        if world is not None and self.align:
            row = worldmap.drift(world, cells, common=self.common, weighted=self.weighted).first()
            dz = float(row["dz"]) if row is not None and row["dz"] is not None else 0.0
        new = worldmap.shift_z(cells, dz) if dz else cells
        merged = new if world is None else grid.merge_maps(world, new.select(*world.columns))
        name = f"{now['version'] + 1:012d}-{uuid.uuid4().hex[:12]}"
        kept = worldmap.prune(merged, x, y, self.res, self.reach).withColumn("tile", tile_of(self.tile))
        kept.repartition("tile").write.partitionBy("tile").parquet(f"{self.folder}/cells/{name}")
        if self.sketches:
            worldmap.map_sketches(self.spark.read.schema(kept.schema).parquet(f"{self.folder}/cells/{name}"), ["tile"]).coalesce(1).write.parquet(f"{self.folder}/sketches/{name}")
        tiles = {n.removeprefix("tile="): {"files": name, "cuts": []} for n in self.store.names(f"cells/{name}") if n.startswith("tile=")}
        for k, t in now["tiles"].items():
            if k not in touched and (place := _place(k, x, y, self.res * self.tile, self.reach)) != "out":
                tiles[k] = {"files": t["files"], "cuts": t["cuts"] + ([[x, y]] if place == "cut" else [])}
        sources = now["sources"] | ({source: [batch, frame]} if source is not None else {})
        self._commit({"version": now["version"] + 1, "tiles": tiles, "sources": sources, "frame": frame, "dz": dz})
        self.drifts[frame] = dz
        return dz

    def ingest_all(self, points: DataFrame, poses: DataFrame, source: str | None = None, batch: int = 0) -> None:
        """All sweeps in order of their frames, each after the map of the one before. Points are read once.

        Sweeps of a named ``source`` that the map has already are left out.
        """
        done = self.state["sources"].get(source) if source is not None else None
        if done is not None and done[0] > batch:
            return
        if done is not None and done[0] == batch:
            points = points.where(F.col("frame") > done[1])
        staged = f"staged/{uuid.uuid4().hex}"
        cells = sweep_cells(points, poses, self.res).withColumn("tile", tile_of(self.tile))
        cells.repartition("frame").write.partitionBy("frame", "tile").parquet(f"{self.folder}/{staged}")
        sweeps = points.select("frame").distinct().join(poses.select("frame", "tx", "ty"), "frame").orderBy("frame")
        for f, x, y in sweeps.toLocalIterator():
            touched = [n.removeprefix("tile=") for n in self.store.names(f"{staged}/frame={f}") if n.startswith("tile=")]
            if touched:
                self.ingest(self.spark.read.parquet(f"{self.folder}/{staged}/frame={f}").drop("tile"), x, y, f, touched, source, batch)
        self.store.remove(staged)

    def into(self, stream: DataFrame, poses: DataFrame, checkpoint: str, **trigger):
        """A streaming query that merges each micro-batch's sweeps, each once, also after a failure amid a batch."""

        def step(batch: DataFrame, batch_id: int) -> None:
            self.ingest_all(batch, poses, checkpoint, batch_id)

        return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step).trigger(**(trigger or {"availableNow": True})).start()


def tile_of(side: int) -> Column:
    """The name of the square tile that holds a cell (ix, iy)."""
    return F.concat_ws("_", *[F.floor(F.col(c) / side).cast("string") for c in ("ix", "iy")])


def _place(tile: str, x: float, y: float, side: float, reach: float) -> str:
    """Whether a circle of ``reach`` around (x, y) leaves a tile ``out``, holds it whole (``in``) or cuts it (``cut``)."""
    ends = [(int(k) * side - c, int(k) * side + side - c) for k, c in zip(tile.split("_"), (x, y))]
    far = math.hypot(*[max(abs(a), abs(b)) for a, b in ends])
    near = math.hypot(*[0.0 if a <= 0.0 <= b else min(abs(a), abs(b)) for a, b in ends])
    return "out" if near > reach else "in" if far <= reach else "cut"


def ingest_tiers(world: DataFrame | None, points: DataFrame, position: tuple[float, float], tiers: tuple = worldmap.TIERS, align: bool = True) -> DataFrame:
    """Tier cells (lvl, ix, iy, …) after one more sweep of world points (x, y, z, lab) seen from ``position``.

    Tiers move with the sensor by whole cells: what leaves them goes, the strip that enters is empty.
    Drift is measured on the coarsest tier, by the sweep's ground points.
    """
    if world is not None and align:
        lvl, res = len(tiers) - 1, tiers[-1][0]
        cell = {"ix": geo.cell("x", res), "iy": geo.cell("y", res)}
        sample = points.where(geo.is_ground()).withColumns(cell)
        dz = worldmap.point_drift(world.where(F.col("lvl") == lvl), sample).select(F.coalesce("dz", F.lit(0.0)).alias("__dz"))
        points = points.join(F.broadcast(dz)).withColumn("z", F.col("z") + F.col("__dz")).drop("__dz")  # one row
    new = worldmap.into_tiers(points, position, tiers)
    if world is None:
        return new
    both = worldmap.in_extent(world, position, tiers).unionByName(new)
    return both.groupBy("lvl", "ix", "iy").agg(*[F.sum(c).alias(c) if c in ("n", "ng", "gsum", "gsq") else F.max(c).alias(c) if c == "zmax" else F.min(c).alias(c) for c in new.columns if c not in ("lvl", "ix", "iy")])
