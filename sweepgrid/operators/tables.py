"""Table functions for SQL: boxes to the buckets that they cover, sweeps to their clusters.

``register`` makes them known to a session:

``box_buckets(cx, cy, l, w, reach, bucket)`` gives the buckets (bx, by) that a box with a margin touches, so that points
meet boxes by an equality join, as in ``evaluate.points_in_boxes``.

``sweep_clusters(TABLE(points) PARTITION BY frame, voxel, least, most)`` reads each sweep's points (frame, x, y, z) and gives
its clusters with their points' number and bounds, as ``cluster.cluster_points`` numbers them. It asks for its
partitions itself where the query does not name any.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, PartitioningColumn, SelectedColumn

from sweepgrid.operators.cluster import voxel_labels


@udtf(returnType="bx BIGINT, by BIGINT")
class BoxBuckets:
    def eval(self, cx: float, cy: float, l: float, w: float, margin: float, bucket: float) -> Iterator[tuple[int, int]]:  # noqa: E741
        if None in (cx, cy, l, w):
            return
        reach = math.sqrt(l * l + w * w) / 2 + 2 * margin
        for bx in range(math.floor((cx - reach) / bucket), math.floor((cx + reach) / bucket) + 1):
            for by in range(math.floor((cy - reach) / bucket), math.floor((cy + reach) / bucket) + 1):
                yield bx, by


#: Points whose voxels are worked out at once.
STEP = 1 << 19


def told(names: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """The different rows of ``names`` in order, each with its points' number and bounds."""
    kinds, place = np.unique(names, axis=0, return_inverse=True)
    place, count = place.reshape(-1), np.zeros(len(kinds), np.int64)
    bounds = np.full((len(kinds), 3), np.inf), np.full((len(kinds), 3), -np.inf)
    np.add.at(count, place, n)
    np.minimum.at(bounds[0], place, low)
    np.maximum.at(bounds[1], place, high)
    return kinds, count, *bounds


@udtf
class SweepClusters:
    """A sweep is one partition, of which a task holds three numbers a point and the voxels."""

    def __init__(self, analyzed: AnalyzeResult | None = None):
        self.xyz, self.frame, self.options = array("d"), None, None

    @staticmethod
    def analyze(points: AnalyzeArgument, voxel: AnalyzeArgument, least: AnalyzeArgument, most: AnalyzeArgument) -> AnalyzeResult:
        if not points.isTable:
            raise ValueError("the first argument is a table")
        fields = {f.name: f.dataType for f in points.dataType.fields}
        if missing := {"frame", "x", "y", "z"} - fields.keys():
            raise ValueError(f"the points have no {', '.join(sorted(missing))}")
        for name, value in (("voxel", voxel), ("least", least), ("most", most)):
            if value.value is None or float(value.value) <= 0:
                raise ValueError(f"{name} is a positive constant")
        schema = T.StructType([T.StructField("frame", fields["frame"]), T.StructField("cluster_id", T.LongType()), T.StructField("n", T.LongType()), *(T.StructField(f"{c}{k}", T.DoubleType()) for c in "xyz" for k in (0, 1))])
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn("frame")], select=[SelectedColumn(c) for c in ("frame", "x", "y", "z")])

    def eval(self, row, voxel, least, most) -> None:
        self.frame, self.options = row["frame"], (float(voxel), int(least), int(most))
        for c in "xyz":
            v = row[c]
            self.xyz.append(math.nan if v is None else v)

    def terminate(self) -> Iterator[tuple]:
        if not self.xyz:
            return
        voxel, least, most = self.options
        xyz = np.frombuffer(self.xyz).reshape(-1, 3)
        origin, parts = xyz.min(0), []
        for k in range(0, len(xyz), STEP):
            p = xyz[k : k + STEP]
            parts.append(told(np.floor((p - origin) / voxel).astype(np.int64), np.ones(len(p), np.int64), p, p))
        v, n, low, high = told(*(np.concatenate(c) for c in zip(*parts)))
        _, n, low, high = told(voxel_labels(*v.T)[:, None], n, low, high)
        good = np.flatnonzero((n >= least) & (n <= most))
        for k, c in enumerate(good):
            yield (self.frame, k, int(n[c]), *(float(e) for pair in zip(low[c], high[c]) for e in pair))


def register(spark: SparkSession) -> None:
    spark.udtf.register("box_buckets", BoxBuckets)
    spark.udtf.register("sweep_clusters", SweepClusters)
