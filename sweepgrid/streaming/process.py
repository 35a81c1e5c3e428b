"""One sweep from its points to a graded map: ground, detection, labels, accumulation, drivability, each with its time."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sweepgrid.operators import cluster, drive, labelling, worldmap
from sweepgrid.operators.sectors import ground_points
from sweepgrid.sources.workspace import written
from sweepgrid.streaming.tables import WorldTable, sweep_cells

STAGES = ("ground", "detect", "label", "accumulate", "drivability")


@dataclass
class Sweep:
    """What came of one sweep; every table is written, so its stage's time is the work's."""

    frame: int
    points: DataFrame | None = None
    boxes: DataFrame | None = None
    cells: DataFrame | None = None
    drift: float = 0.0
    counts: dict[str, int] = field(default_factory=dict)
    ms: dict[str, float] = field(default_factory=dict)

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        yield
        self.ms[name] = (time.perf_counter() - began) * 1000


class SweepProcess:
    """Feeds sweeps to a map one after the other. ``table`` is a class table whose class 0 is background; points of the
    grid classes ``moving`` are labelled but do not enter the map. Cells are graded within ``radius`` of the sensor."""

    def __init__(self, world: WorldTable, table: DataFrame, moving: tuple[str, ...] = ("car", "pedestrian"), model: cluster.Classifier = cluster.geometric_classifier, voxel: float = cluster.VOXEL, least: int = cluster.MIN_POINTS, most: int = cluster.MAX_POINTS, radius: float = 40.0, min_points: int = 5):
        self.world, self.table, self.moving = world, table, [labelling.GRID.index(m) for m in moving]
        self.model, self.voxel, self.least, self.most, self.radius, self.min_points = model, voxel, least, most, radius, min_points
        self.names = {r["cls"]: r["name"] for r in table.select("cls", "name").collect()}  # a row a class

    def process(self, points: DataFrame, poses: DataFrame, frame: int) -> Sweep:
        """One sweep of ``points`` (frame, x, y, z, …), which the sensor bounds."""
        out, keys = Sweep(frame), ["frame"]
        pose = poses.where(F.col("frame") == frame)
        with out.stage("ground"):
            marked = written(ground_points(points.where(F.col("frame") == frame), ("frame",)).drop("ri", "ai"), "ground")
        with out.stage("detect"):
            rest, out.boxes = labelling.detected(marked, keys, self.model, self.voxel, self.least, self.most)
            out.counts = {self.names[r["cls"]]: r["n"] for r in out.boxes.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).collect()}
        with out.stage("label"):
            out.points = written(labelling.labelled(marked, rest, out.boxes, keys, self.table), "labelled")
        at = pose.select("tx", "ty").first()
        with out.stage("accumulate"):
            seen = out.points.withColumns({"lab": F.col("grid"), "moving": F.col("grid").isin(self.moving)})
            cells = written(sweep_cells(seen, pose, self.world.res).drop("frame"), "sweep-cells")
            out.drift = self.world.ingest(cells, at["tx"], at["ty"], frame)
        with out.stage("drivability"):
            near = worldmap.near(self.world.read(), at["tx"], at["ty"], self.world.res, self.radius)
            out.cells = written(drive.cell_drivability(near, self.world.res, sensor=(at["tx"], at["ty"]), min_points=self.min_points, weighted=True), "graded")
        return out

    def all(self, points: DataFrame, poses: DataFrame) -> Iterator[Sweep]:
        """Sweeps in order of their frames, of points that are read once."""
        kept = written(points, "sweeps")
        for (frame,) in kept.select("frame").distinct().orderBy("frame").toLocalIterator():
            yield self.process(kept, poses, frame)
