"""Scores of sectors tracked over a stream: the mean and the class of each key lie in the state store.

The same as ``drive.tracked`` for any cut of the rows into micro-batches, as long as a key's rows come in order. Rows that
come at or before the last one of their key are late: they change nothing and come back with neither mean nor class.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sweepgrid.operators.drive import DRIVABLE, MARGINAL, NON_DRIVABLE, UNKNOWN
from sweepgrid.streaming.keyed import rocks


def banded(mean: float | None) -> int:
    return UNKNOWN if mean is None else DRIVABLE if mean <= 1.0 else MARGINAL if mean <= 2.0 else NON_DRIVABLE


class TrackState(StatefulProcessor):
    """The last place, the mean and the class of one key."""

    def __init__(self, keys: list[str], order: str, alpha: float, band: float):
        self.keys, self.order, self.alpha, self.band = keys, order, alpha, band

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.track = handle.getValueState("track", "last BIGINT, ema DOUBLE, held INT")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # a key's rows of one micro-batch
        t = pd.concat(list(rows), ignore_index=True).sort_values([self.order, "value"], kind="stable")
        last, mean, cls = self.track.get() if self.track.exists() else (None, None, None)
        begun, means, classes = last, [], []
        for at, value in zip(t[self.order].tolist(), t["value"].tolist()):
            if begun is not None and at <= begun:
                means.append(None)
                classes.append(None)
                continue
            if value == value and value is not None:
                mean = value if mean is None else self.alpha * value + (1 - self.alpha) * mean
            held = mean is not None and (abs(mean - 1.0) < self.band or abs(mean - 2.0) < self.band)
            cls = banded(mean) if cls is None or not held else cls
            last = at
            means.append(mean)
            classes.append(cls)
        if last is not None:
            self.track.update((int(last), None if mean is None else float(mean), int(cls) if cls is not None else None))
        yield pd.DataFrame({**{k: [v] * len(t) for k, v in zip(self.keys, key)}, self.order: t[self.order].to_numpy(), "ema": pd.array(means, "Float64"), "cls": pd.array(classes, "Int32")})

    def close(self) -> None:
        pass


def tracked(scores: DataFrame, keys: list[str], order: str, value: str, alpha: float = 0.4, band: float = 0.15) -> DataFrame:
    """(keys, order, ema, cls) of a stream of scores; start it within ``keyed.rocks`` or with that state store set."""
    types = dict(scores.dtypes)
    rows = scores.select(*keys, F.col(order).cast("bigint").alias(order), F.col(value).cast("double").alias("value"))
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + f", `{order}` BIGINT, ema DOUBLE, cls INT"
    return rows.groupBy(*keys).transformWithStateInPandas(TrackState(keys, order, alpha, band), schema, "Append", "None")


def write(scores: DataFrame, keys: list[str], order: str, value: str, path: str, checkpoint: str, **trigger):
    """The streaming query that adds each row's mean and class to Parquet files below ``path``, each row once."""
    with rocks(scores.sparkSession):
        out = tracked(scores, keys, order, value)
        return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
