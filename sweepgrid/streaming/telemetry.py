"""Frame times of a stream by windows of event time.

A sample that comes again within the lateness counts once, one that comes later than the watermark is left out, and a
window is told once, when the watermark has passed its end; so what has been written never changes. A capture is closed
by a last sample (``closing``) far enough ahead for its windows to end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sweepgrid.operators.quality import frame_summary
from sweepgrid.streaming.keyed import rocks


def frame_windows(samples: DataFrame, key: str, time: str, ms: str, sample: str, width: str = "12 seconds", late: str = "2 seconds") -> DataFrame:
    """(key, start, frames, median_ms, p95_ms, p99_ms, fps) by key and window of ``width``, of a stream or a table.

    ``sample`` tells a key's samples apart. Of a stream, the state is a window's times, which a sensor's rate bounds.
    """
    rows = samples.withWatermark(time, late) if samples.isStreaming else samples
    rows = rows.dropDuplicatesWithinWatermark([key, sample]) if samples.isStreaming else rows.dropDuplicates([key, sample])
    out = rows.groupBy(key, F.window(time, width).alias("w")).agg(*frame_summary(ms))
    return out.select(key, F.col("w.start").alias("start"), *[c for c in out.columns if c not in (key, "w")])


def write(samples: DataFrame, path: str, checkpoint: str, key: str, time: str, ms: str, sample: str, width: str = "12 seconds", late: str = "2 seconds", **trigger):
    """The streaming query that writes each window below ``path`` once it is over."""
    with rocks(samples.sparkSession):
        out = frame_windows(samples, key, time, ms, sample, width, late)
        return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def closing(samples: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """One row that lies two windows and the lateness behind the last of ``samples``, all else null."""
    end = samples.agg((F.max(time) + F.expr(f"INTERVAL {width}") + F.expr(f"INTERVAL {width}") + F.expr(f"INTERVAL {late}")).alias(time)).where(F.col(time).isNotNull())
    return end.select(*[F.col(f.name) if f.name == time else F.lit(None).cast(f.dataType).alias(f.name) for f in samples.schema.fields])
