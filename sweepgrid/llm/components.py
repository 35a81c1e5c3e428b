"""Connected components of a large graph, by rounds of smallest labels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sweepgrid.llm.shared import handing_back, materialise

#: Edges that a task takes together at most.
AT_ONCE = 1 << 18


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each vertex to the smallest one that these edges lead to."""
    vertex, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(vertex))
    while ((lx := label[x]) != (ly := label[y])).any():
        np.minimum.at(label, np.maximum(lx, ly), np.minimum(lx, ly))
        while ((up := label[label]) != label).any():
            label = up
    leaf = np.flatnonzero(label != np.arange(len(vertex)))
    return vertex[leaf], vertex[label[leaf]]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition as stars, so many at once; what they connect stays connected."""

    def out(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        a, b = stars(t.column("a").to_numpy(), t.column("b").to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= AT_ONCE:
            yield out(held)
            held, n = [], 0
    if n:
        yield out(held)


def contracting(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work``, which yields edges (a, b), with stars made of them in the same worker: a second
    mapInArrow behind it would give each task two workers, and the executor would hold them all."""
    return lambda batches: _contracted(work(batches))


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b), a the larger, with the same components: stars within each task."""
    return edges.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).where("a <> b").mapInArrow(handing_back(_contracted), "a BIGINT, b BIGINT")


def are_stars(edges: DataFrame) -> bool:
    """Whether no vertex has two edges of which it is the larger end, or is the smaller end of others too."""
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")).unionByName(edges.select(F.col("b").alias("id"), F.lit(0).alias("leaf"), F.lit(1).alias("centre")))
    return ends.groupBy("id").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre")).where("leaf + centre > 1").isEmpty()


def components(edges: DataFrame, contract: bool = True) -> DataFrame:
    """(id, label): the smallest id of each vertex's component, for vertices that have an edge.

    Alternates large-star and small-star rounds, each linear in the edges and with partial
    aggregation of the smallest neighbour, until the edges form stars. Before each round every task
    makes stars of the edges it reads, so that rounds, whose stages cost the driver memory, are few.
    Every step is cut off by a written table; nothing is gathered but whether the edges are stars.
    Without ``contract`` the edges come from tasks that have made stars of them (``contracting``).
    """
    now = materialise((contracted(edges) if contract else edges).distinct(), "edges")
    while not are_stars(now := materialise(contracted(now), "edges")):
        # large star: every larger neighbour of a vertex is tied to the vertex's smallest neighbour
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        # small star: every smaller neighbour of a vertex, and the vertex, are tied to the smallest
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b"))).where("a > b").distinct()
        now = materialise(small, "edges")
    return now.select(F.col("a").alias("id"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("label")).distinct())
