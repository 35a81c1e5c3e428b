"""What leaves the engine: dashboard payloads, shards, reports, the latest frame."""

from __future__ import annotations

import base64
import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sweepgrid.operators.order import numbered


def quantised(value: Column, scale: float = 1000.0, most: int = 32_000) -> Column:
    """Millimetres in a short integer, clamped, towards zero."""
    return F.least(F.greatest(value * scale, F.lit(float(-most))), F.lit(float(most))).cast("smallint")


def window(cells: DataFrame, ego_x: float, ego_y: float, res: float, half: float = 80.0) -> DataFrame:
    """Cells around the vehicle with offsets dx, dy from its own cell and the height in millimetres."""
    cx, cy, r = int(ego_x // res), int(ego_y // res), int(half / res)
    near = cells.where((F.abs(F.col("ix") - cx) <= r) & (F.abs(F.col("iy") - cy) <= r))
    return near.withColumns({"dx": (F.col("ix") - cx).cast("smallint"), "dy": (F.col("iy") - cy).cast("smallint"), "mm": quantised(F.col("h"))})


def payloads(cells: DataFrame, frame: str = "frame") -> DataFrame:
    """(frame, n, payload): a JSON document with base64 planes of little-endian numbers; a frame's window is bounded."""

    def work(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["dy", "dx"])
        plane = lambda c, kind: base64.b64encode(t[c].fillna(0).to_numpy().astype(kind).tobytes()).decode()
        doc = pd.Series({"n": len(t), "dx": plane("dx", "<i2"), "dy": plane("dy", "<i2"), "mm": plane("mm", "<i2"), "cls": plane("cls", "u1"), "mix": np.bincount(t["cls"], minlength=4).tolist()})
        return pd.DataFrame({frame: [t[frame].iloc[0]], "n": [len(t)], "payload": [doc.to_json()]})

    return cells.select(frame, "dx", "dy", "mm", "cls").groupBy(frame).applyInPandas(work, f"{frame} {dict(cells.dtypes)[frame]}, n bigint, payload string")


#: Points of a piece of a document: base64 of whole threes joins without padding.
PIECE = 3 * 16_384


def document_pieces(points: DataFrame, order: list[str], frame: str = "frame", scale: float = 50.0) -> DataFrame:
    """(frame, n, section, k, text): the document of each sweep in pieces, whose texts by section and k make it up.

    No task holds more than a piece. ``order`` begins with a number.
    """
    types = dict(points.dtypes)
    rows = numbered(points.select(frame, *order, "x", "y", "z", "lab"), [frame], order[0], [F.col(c) for c in order[1:]])
    cut = rows.select(frame, "rn", "x", "y", "z", "lab", F.expr(f"(rn - 1) div {PIECE}").alias("k"))

    def work(t: pa.Table) -> pa.Table:
        t = t.sort_by("rn")
        text = lambda a: base64.b64encode(a.tobytes()).decode().replace("/", "\\/")
        xyz = np.clip(np.round(np.stack([t.column(c).to_numpy().astype(float) for c in "xyz"], 1) * scale), -32768, 32767).astype("<i2")
        head = {c: pa.array([t.column(c)[0].as_py()] * 2, t.schema.field(c).type) for c in (frame, "k")}
        return pa.table({frame: head[frame], "section": pa.array([1, 3], pa.int32()), "k": head["k"], "text": [text(xyz), text(t.column("lab").to_numpy().astype("u1"))]})

    body = cut.groupBy(frame, "k").applyInArrow(work, f"`{frame}` {types[frame]}, section INT, k BIGINT, text STRING")
    count = points.groupBy(F.col(frame).alias("__frame")).agg(F.count(F.lit(1)).alias("n"))  # a row a sweep
    begin = F.concat(F.lit('{"frame":'), F.col("__frame").cast("bigint").cast("string"), F.lit(',"n":'), F.col("n").cast("string"), F.lit(f',"scale":{json.dumps(scale)},"xyz":"'))
    marks = F.array(*[F.struct(F.lit(k).alias("section"), F.lit(0).cast("bigint").alias("k"), t.alias("text")) for k, t in ((0, begin), (2, F.lit('","cls":"')), (4, F.lit('"}')))])
    rest = count.select(F.col("__frame").alias(frame), "n", F.explode(marks).alias("m")).select(frame, "n", "m.*")
    met = F.col(frame).eqNullSafe(F.col("__frame"))
    return body.join(F.broadcast(count), met).select(frame, "n", "section", "k", "text").unionByName(rest)


def exported(points: DataFrame, order: list[str], frame: str = "frame", scale: float = 50.0) -> DataFrame:
    """(frame, n, document): a JSON document of each sweep for a viewer, bounded by the sensor or a subsample before.

    Coordinates are 2 cm in short integers, half-way cases to the even one, followed by the classes;
    both are base64 of little-endian numbers. Sweeps too large for one value come by ``document_pieces``.
    """
    pieces = document_pieces(points, order, frame, scale)
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("section", "k", "text"))), lambda p: p["text"]), "")
    return pieces.groupBy(frame).agg(F.max("n").alias("n"), whole.alias("document"))


def write_shards(proposals: DataFrame, path: str, frames: int = 500) -> None:
    """Proposals in directories of ``frames`` frames each."""
    proposals.withColumn("shard", F.expr(f"frame div {frames}")).write.mode("overwrite").partitionBy("shard").parquet(path)


def report(checks: DataFrame) -> DataFrame:
    """(failed, report): how many checks fail, and all of them as JSON. A capture has a handful."""
    row = F.struct("check", "value", "ok")
    return checks.agg(F.count_if(~F.col("ok")).alias("failed"), F.to_json(F.sort_array(F.collect_list(row)), {"ignoreNullFields": "false"}).alias("report"))


def strided(frames: DataFrame, stride: int, column: str = "frame") -> DataFrame:
    """Every ``stride``-th frame in order."""
    kept = numbered(frames.select(column).distinct(), [], column).where((F.col("rn") - 1) % stride == 0)
    return frames.join(kept.select(column), column, "left_semi")


def latest_only(batch: DataFrame, target: dict, frame: str = "frame") -> None:
    """For foreachBatch: keeps the newest row in ``target`` and drops what it overtakes."""
    row = batch.orderBy(F.desc(frame)).limit(1).collect()
    if row and row[0][frame] > target.get(frame, -1):
        target.update(row[0].asDict())


