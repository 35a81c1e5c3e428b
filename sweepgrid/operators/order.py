"""Positions in an order, also where one key has most rows.

A window over one key is one task. Here each key's order is cut at approximate quantiles first: the
parts are numbered by windows of their own, and what lies before a part comes from a window over
the parts' totals, of which a key has a few dozen. Where the cuts fall never changes the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = 64


def in_parts(rows: DataFrame, keys: list[str], by: str, descending: bool = False, parts: int = PARTS) -> DataFrame:
    """Adds __part: 0, 1, … in the order of the number ``by``; null comes last."""
    cuts = rows.groupBy(*keys).agg(F.percentile_approx(by, [k / parts for k in range(1, parts)], 1000).alias("__cuts"))
    beyond = F.filter("__cuts", lambda c: c > F.col(by)) if descending else F.filter("__cuts", lambda c: c < F.col(by))
    met = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    cuts = cuts.withColumnsRenamed({k: f"__{k}" for k in keys})
    joined = rows.join(cuts, met, "left") if keys else rows.join(F.broadcast(cuts))  # one row
    return joined.withColumn("__part", F.when(F.col(by).isNull(), parts).otherwise(F.coalesce(F.size(beyond), F.lit(0)))).drop("__cuts", *[f"__{k}" for k in keys])


def running(rows: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds running sums, the row itself included, in ``order`` within __part and over the parts before it."""
    within = Window.partitionBy(*keys, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = rows.groupBy(*keys, "__part").agg(*[F.sum(e).alias(f"__{n}") for n, e in sums.items()])
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__part").alias("__p"), *[F.coalesce(F.sum(f"__{n}").over(earlier), F.lit(0)).alias(f"__b_{n}") for n in sums])
    met = [F.col("__part") == F.col("__p"), *[F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]]
    out = rows.withColumns({n: F.sum(e).over(within) for n, e in sums.items()}).join(before, met)
    return out.withColumns({n: F.col(n) + F.col(f"__b_{n}") for n in sums}).drop("__p", *[f"__{k}" for k in keys], *[f"__b_{n}" for n in sums])


def numbered(rows: DataFrame, keys: list[str], by: str, ties: list[Column] | None = None, descending: bool = False, parts: int = PARTS) -> DataFrame:
    """Adds rn: 1, 2, … in the order of ``by``, then of ``ties``; null comes last."""
    first = F.desc_nulls_last(by) if descending else F.asc_nulls_last(by)
    return running(in_parts(rows, keys, by, descending, parts), keys, [first, *(ties or [])], {"rn": F.lit(1)}).drop("__part")
