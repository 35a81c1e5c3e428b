"""Deterministic clouds, poses, boxes and telemetry derived from the star-schema tables.

Coordinates are multiples of 1/64 m (``near``) or 1/16 m (``wide``), so sums of heights and of their
squares are exact in any order of summation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NEAR, WIDE = 64, 16
FRAMES = 10

_H1 = "(ok*7919+pk*104729+sk*31+ln*131)%1000003"
_H2 = "(pk*15485+sk*611953+ok*13+ln*7)%1000003"
_H3 = "(ok*101+pk*211+sk*307+q*37+ln)%1000003"


def _columns(scale: int) -> list[str]:
    return [
        "ok", "pk", "sk", "ln", "cast(h3%8 as int) lab", "cast(sk%10 as int) frame",
        f"(h1%2048-1024)/cast({scale} as double) x", f"(h2%2048-1024)/cast({scale} as double) y",
        "case when h3%8 in (0,1) then cast(-1.75 as double)+((h1+h2)%8)/cast(64 as double)+(case when h1%2048>=1536 then 16 else 0 end)/cast(64 as double) else cast(-1.75 as double)+((h1+h3)%192)/cast(64 as double) end z",
    ]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str, scale: int = NEAR) -> DataFrame:
    """(ok, pk, sk, ln, lab, frame, x, y, z): a row of lineitem is a return of the sensor."""
    li = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey ok", "l_partkey pk", "l_suppkey sk", "cast(l_linenumber as bigint) ln", "cast(l_quantity as bigint) q")
    return li.selectExpr("*", f"{_H1} h1", f"{_H2} h2", f"{_H3} h3").selectExpr(*_columns(scale))


def points_sql(scale: int = NEAR) -> str:
    """The same cloud as CTEs ``li``, ``h`` and ``points`` for a WITH clause."""
    return (
        "li AS (SELECT l_orderkey ok, l_partkey pk, l_suppkey sk, cast(l_linenumber as bigint) ln, cast(l_quantity as bigint) q FROM lineitem),\n"
        f"h AS (SELECT *, {_H1} h1, {_H2} h2, {_H3} h3 FROM li),\n"
        f"points AS (SELECT {', '.join(_columns(scale))} FROM h)"
    )


#: Yaw 0.1 rad and (0.5, 0.25, 0) m further with each frame.
_POSE = ["cast(id as int) frame", "cos(id*0.1D) r00", "-sin(id*0.1D) r01", "0.0D r02", "sin(id*0.1D) r10", "cos(id*0.1D) r11", "0.0D r12", "0.0D r20", "0.0D r21", "1.0D r22", "id*0.5D tx", "id*0.25D ty", "0.0D tz"]


def poses(spark: SparkSession) -> DataFrame:
    return spark.range(FRAMES).selectExpr(*_POSE)


def poses_sql() -> str:
    columns = ", ".join(_POSE).replace("0.1D", "0.1::DOUBLE").replace("0.0D", "0.0::DOUBLE").replace("1.0D", "1.0::DOUBLE").replace("0.5D", "0.5::DOUBLE").replace("0.25D", "0.25::DOUBLE")
    return f"poses AS (SELECT {columns} FROM (SELECT range AS id FROM range({FRAMES})))"


#: Boxes on the ground, a third of them cars, with a dyadic size and one of eight headings.
_BOX = [
    "p_partkey id", "cast(p_partkey%10 as int) frame", "cast(p_partkey%3 as int) cls",
    "((p_partkey*7919)%1024-512)/64.0D cx", "((p_partkey*104729)%1024-512)/64.0D cy", "-1.0D cz",
    "2.0D+(p_partkey%8)/4.0D l", "1.0D+(p_partkey%4)/4.0D w", "1.5D h", "(p_partkey%8)*0.39269908169872414D yaw", "p_retailprice",
]


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, frame, cls, cx, cy, cz, l, w, h, yaw): ground truth from ``part``."""
    return table(spark, sf_dir, "part").selectExpr(*_BOX).drop("p_retailprice")


def boxes_sql() -> str:
    import re

    columns = re.sub(r"(\d+\.\d+)D\b", r"\1::DOUBLE", ", ".join(_BOX))
    return f"boxes AS (SELECT {columns} FROM part)"


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth moved by up to 0.5 m, one in seven gone, scored by the price's digits."""
    b = table(spark, sf_dir, "part").selectExpr(*_BOX).where("id % 7 <> 0")
    return b.select(
        "id", "frame", "cls", (F.col("cx") + (F.col("id") % 5 - 2) / F.lit(8.0)).alias("cx"), (F.col("cy") + (F.col("id") % 3 - 1) / F.lit(4.0)).alias("cy"),
        "cz", "l", "w", "h", "yaw", F.expr("(cast(floor(p_retailprice*100) as bigint) * 7919 % 1000) / 1000.0D").alias("score"),
    )
