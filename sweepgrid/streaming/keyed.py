"""The world map as keyed state of a stream: each tile's cells lie in the state store, and nothing is collected.

Two streams feed the map. Sweeps tell of themselves (frame, the frame before, time, position) to every tile that
their circle of ``reach`` touches; points go to the tile of their cell. A tile merges points into its map state by
the rules of ``grid.FIELDS`` and drops cells beyond ``reach`` of each sweep it hears of. A tile that a sweep did not
reach has nothing left within reach: it finds out from the frame before the next one it hears of, and a timer that
only sweeps put off clears it from the store in the meantime. Drift needs the whole map at once and is left to
``tables.WorldTable``.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sweepgrid.functions import geometry as geo
from sweepgrid.operators import grid, worldmap

_SETTING = "spark.sql.streaming.stateStore.providerClass"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CELL = "ix BIGINT, iy BIGINT"
VALUE = ", ".join(f"{n} {'BIGINT' if k.rule == 'sum' and k.power == 0 and k.family != 'weighted' else 'DOUBLE'}" for n, k in grid.FIELDS.items())
KEYS = ("map_id", "tier", "tx", "ty")
_COUNTS = {n for n, k in grid.FIELDS.items() if k.rule == "sum" and k.power == 0 and k.family != "weighted"}


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB."""
    before = spark.conf.get(_SETTING, None)
    spark.conf.set(_SETTING, PROVIDER)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_SETTING)
        else:
            spark.conf.set(_SETTING, before)


def cells_of(points: pd.DataFrame) -> pd.DataFrame:
    """Accumulators of points (ix, iy, z, lab, w), indexed by cell."""
    z, ground, out = points["z"], points["lab"].isin(geo.GROUND), {}
    for name, kept in grid.FIELDS.items():
        member = {"all": ground | True, "ground": ground, "weighted": ground, "other": ~ground}.get(kept.family, points["lab"] == kept.family)
        term = z**kept.power * (points["w"] if kept.family == "weighted" else 1.0) if kept.rule == "sum" else z
        out[name] = term.where(member, 0.0 if kept.rule == "sum" else np.nan)
    return merged(pd.DataFrame({"ix": points["ix"], "iy": points["iy"], **out}))


def merged(cells: pd.DataFrame) -> pd.DataFrame:
    """Rows of equal cells as one, by the rule of each accumulator."""
    return cells.groupby(["ix", "iy"]).agg({n: k.rule for n, k in grid.FIELDS.items()})


def together(parts: list[pd.DataFrame]) -> pd.DataFrame:
    """Cells of all parts, each indexed by cell."""
    return parts[0] if len(parts) == 1 else merged(pd.concat([p.reset_index() for p in parts]))


class TileState(StatefulProcessor):
    """Cells of one tile, the last sweep it heard of, and a timer that clears it."""

    def __init__(self, tiers: tuple[float, ...], reach: float, idle_ms: int):
        self.tiers, self.reach, self.idle_ms = tiers, reach, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cells = handle.getMapState("cells", CELL, VALUE)
        self.heard = handle.getValueState("heard", "frame BIGINT, swept BIGINT")

    def _held(self) -> pd.DataFrame:
        rows = [(*k, *v) for k, v in self.cells.iterator()]
        return pd.DataFrame(rows, columns=["ix", "iy", *grid.FIELDS]).astype({n: "float64" for n in grid.FIELDS}).set_index(["ix", "iy"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # a tile's cells and the sweeps of a micro-batch bound what is held, however many points come
        parts, sweeps = {}, []
        for chunk in rows:
            sweeps.append(chunk[chunk["kind"] == 0])
            for turn, points in chunk[chunk["kind"] == 1].groupby(["frame", "prev"]):
                own = parts.setdefault(turn, [])
                own.append(cells_of(points))
                if len(own) == 16:
                    own[:] = [together(own)]
        swept_now = pd.concat(sweeps, ignore_index=True)
        heard = dict(list(swept_now.groupby(["frame", "prev"])))
        held = self._held()
        last, swept = self.heard.get() if self.heard.exists() else (None, None)
        before, res = held, self.tiers[key[KEYS.index("tier")]]
        for frame, prev in sorted(parts.keys() | heard.keys()):
            if last is not None and last < prev:
                held = held.iloc[:0]  # a sweep went by without reaching this tile
            last = frame if last is None else max(last, frame)
            if (frame, prev) in parts:
                held = together([held, *parts[frame, prev]] if len(held) else parts[frame, prev])
            seen = heard.get((frame, prev), swept_now.iloc[:0])
            if len(seen):
                swept = frame if swept is None else max(swept, frame)
            if len(seen) and len(held):
                ix, iy = (held.index.get_level_values(c) for c in ("ix", "iy"))
                far = ((ix + 0.5) * res - seen["sx"].iloc[0]) ** 2 + ((iy + 0.5) * res - seen["sy"].iloc[0]) ** 2 > self.reach**2
                held = held[~far]
        for cell in before.index.difference(held.index):
            self.cells.removeKey((int(cell[0]), int(cell[1])))
        both = held.index.intersection(before.index)
        same = set(both[(held.loc[both].fillna(np.inf) == before.loc[both].fillna(np.inf)).all(axis=1)]) if len(both) else set()
        for cell, values in zip(held.index, held.itertuples(index=False)):
            if cell not in same:
                self.cells.updateValue((int(cell[0]), int(cell[1])), tuple(None if v != v else int(v) if n in _COUNTS else float(v) for n, v in zip(grid.FIELDS, values)))
        self.heard.update((int(last), None if swept is None else int(swept)))
        if len(swept_now):
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(swept_now["ts"].max().timestamp() * 1000) + self.idle_ms)
        yield pd.DataFrame({**dict(zip(KEYS, ([k] for k in key))), "frame": [int(last)], "cells": [len(held)]})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.cells.clear()
        self.heard.clear()
        yield pd.DataFrame({**dict(zip(KEYS, ([k] for k in key))), "frame": [-1], "cells": [0]})

    def close(self) -> None:
        pass


def _tile(ix: Column, side: int) -> Column:
    return F.floor(ix / side)


class KeyedMap:
    """A map by tiles (map_id, tier, tx, ty) in the state store of one streaming query; ``tiers`` are cell sizes."""

    def __init__(self, tiers: tuple[float, ...] = (0.4,), reach: float = worldmap.PRUNE, trust: float = worldmap.TRUST, tile: int = 32, late: str = "10 seconds", idle_ms: int = 1000):
        if len(set(tiers)) != len(tiers) or not tiers:
            raise ValueError("tiers must be different cell sizes")
        self.tiers, self.reach, self.trust, self.tile, self.late, self.idle_ms = tiers, reach, trust, tile, late, idle_ms

    def tiles(self, points: DataFrame, sweeps: DataFrame, poses: DataFrame) -> DataFrame:
        """Rows for the tiles. ``points`` (map_id, frame, x, y, z, lab, perhaps moving) and ``sweeps`` (map_id, frame) are
        streams; ``poses`` (frame, prev, ts, r00 … tz) is a table, with ``prev`` the frame before, null for the first."""
        when = poses.select("frame", F.coalesce("prev", "frame").cast("bigint").alias("prev"), "ts")
        moving = F.coalesce(F.col("moving"), F.lit(False)) if "moving" in points.columns else None
        near = worldmap.trusted(points, self.trust, moving).withColumn("w", worldmap.weight())
        p = geo.transform(near, poses.drop("prev", "ts")).join(when, "frame")
        level = F.posexplode(F.array(*[F.lit(float(r)) for r in self.tiers]))
        p = p.select("*", level.alias("tier", "res")).select("map_id", "tier", F.floor(F.col("wx") / F.col("res")).alias("ix"), F.floor(F.col("wy") / F.col("res")).alias("iy"), F.col("wz").alias("z"), "lab", "w", F.col("frame").cast("bigint").alias("frame"), "prev", "ts", F.lit(1).alias("kind"))
        p = p.withColumns({"tx": _tile(F.col("ix"), self.tile), "ty": _tile(F.col("iy"), self.tile)})
        s = sweeps.select("map_id", "frame").join(poses.select("frame", F.col("tx").alias("sx"), F.col("ty").alias("sy")), "frame").join(when, "frame").select("*", level.alias("tier", "res"))
        side = F.col("res") * self.tile
        span = lambda c: F.sequence(F.floor((F.col(c) - self.reach) / side), F.floor((F.col(c) + self.reach) / side))
        s = s.withColumn("tx", F.explode(span("sx"))).withColumn("ty", F.explode(span("sy")))
        # only tiles that the circle touches hear of a sweep
        gap = lambda t, c: F.greatest(F.col(t) * side - F.col(c), F.col(c) - (F.col(t) + 1) * side, F.lit(0.0))
        s = s.where(gap("tx", "sx") * gap("tx", "sx") + gap("ty", "sy") * gap("ty", "sy") <= self.reach * self.reach)
        s = s.select("map_id", "tier", "tx", "ty", F.col("frame").cast("bigint").alias("frame"), "prev", "ts", "sx", "sy", F.lit(0).alias("kind"))
        return p.unionByName(s, allowMissingColumns=True)

    def start(self, points: DataFrame, sweeps: DataFrame, poses: DataFrame, checkpoint: str, **trigger):
        """The streaming query; started again on its checkpoint, it goes on with the map. Its rows tell the cells of each tile."""
        with rocks(points.sparkSession):
            rows = self.tiles(points, sweeps, poses).withWatermark("ts", self.late)
            types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
            schema = ", ".join([*(f"{k} {types[k]}" for k in KEYS), "frame BIGINT", "cells BIGINT"])
            out = rows.groupBy(*KEYS).transformWithStateInPandas(TileState(self.tiers, self.reach, self.idle_ms), schema, "Update", "EventTime")
            return out.writeStream.option("checkpointLocation", checkpoint).outputMode("update").format("noop").trigger(**(trigger or {"availableNow": True})).start()


def read(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(map_id, tier, tx, ty, ix, iy, accumulators) of the map as of the last micro-batch, from the state store.

    Tiles that the last sweep of their map did not reach are no part of it, whether their timer has cleared them or not.
    """
    state = lambda name: spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()
    heard = state("heard").select("key.*", "value.*")
    last = heard.groupBy("map_id").agg(F.max("swept").alias("last"))
    now = heard.join(last, "map_id").where("swept = last OR frame > coalesce(last, -1)").select(*KEYS)
    return state("cells").select("key.*", "user_map_key.*", "user_map_value.*").join(now, list(KEYS), "left_semi")


def with_previous(poses: DataFrame, period: float = 0.1) -> DataFrame:
    """Adds the frame before (null for the first) and a time, ``period`` seconds a frame; the first watermark is the epoch, so times come after it."""
    from pyspark.sql import Window

    w = Window.orderBy("frame")  # a row a sweep
    return poses.withColumn("prev", F.lag("frame").over(w)).withColumn("ts", F.timestamp_micros(((F.col("frame") + 1) * int(period * 1e6)).cast("bigint")))
