"""Ground planes by sector: one exchange of the points by sector, and one pass over each sector's points in order.

A sector of a sweep is bounded by the sensor, a sweep's sectors by the lattice (24 rings of 72). Everything that a sector's
points decide, they decide together in one pass: the plane, what is ground, and the scatter of the ground; so a query
reads its points once, whatever it asks of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sweepgrid.operators.drive import AZIMUTH, RADIAL, sector

SENSOR_H, SEED_SHARE, MAX_SLOPE, THRESHOLD, LEAST = 1.73, 0.25, 0.35, 0.25, 8


def _codes(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Equal numbers for equal values, nulls among them."""
    out = pc.dictionary_encode(column, null_encoding="encode")
    return (out.combine_chunks() if isinstance(out, pa.ChunkedArray) else out).indices.to_numpy(zero_copy_only=False)


def whole_groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Tables that hold all rows of each of their groups; rows of a group come one after the other."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = [_codes(batch.column(c)) for c in names]
        other = np.flatnonzero(np.logical_or.reduce([c != c[-1] for c in codes]))
        cut = int(other[-1]) + 1 if len(other) else 0
        same = not cut and held and all(held[-1].column(c)[-1].as_py() == batch.column(c)[0].as_py() for c in names)
        if not same:
            done = [*held, batch.slice(0, cut)] if cut else held
            if done:
                yield pa.Table.from_batches(done)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


class Sectors:
    """Planes, ground and scatter of sectors whose points lie one after the other, by rising height."""

    def __init__(self, t: pa.Table, names: list[str], sensor_h: float, seed_share: float, max_slope: float, threshold: float):
        n = len(t)
        cut = np.zeros(n, dtype=bool)
        cut[0] = True
        for c in names:
            codes = _codes(t.column(c))
            cut[1:] |= codes[1:] != codes[:-1]
        self.begin = np.flatnonzero(cut)
        self.count = np.diff(np.append(self.begin, n))
        self.group = np.cumsum(cut) - 1
        self.x, self.y, self.z = (t.column(c).to_numpy().astype(np.float64) for c in "xyz")
        self.has = (self.count >= LEAST) & ~pc.is_null(t.column("ri")).to_numpy()[self.begin]
        with np.errstate(all="ignore"):
            self._fit(sensor_h, seed_share, max_slope)
            self.plane = self.a[self.group] * self.x + self.b[self.group] * self.y + self.c[self.group]
            self.ground_z = np.where(self.has[self.group], self.plane, -sensor_h)
            self.agl = self.z - self.ground_z
            self.ground = self.has[self.group] & (self.z - self.plane < threshold)

    def _sum(self, v: np.ndarray) -> np.ndarray:
        return np.add.reduceat(v, self.begin)

    def _fit(self, sensor_h: float, seed_share: float, max_slope: float) -> None:
        """Least squares over the lowest points of each sector; level at their mean where that is no plane or too steep."""
        seeds = np.maximum(np.floor(self.count * seed_share).astype(np.int64), 3)
        top = self.begin + np.minimum(seeds, self.count) - 1
        seeds = np.where(self.z[top] - self.z[self.begin] > 1.0, np.maximum(seeds // 2, 3), seeds)
        seed = (np.arange(len(self.z)) - self.begin[self.group] < seeds[self.group]).astype(np.float64)
        x, y, z = self.x, self.y, self.z
        n, sx, sy, sz, xx, xy, yy, xz, yz = (self._sum(np.where(seed > 0, v, 0.0)) for v in (np.ones(len(z)), x, y, z, x * x, x * y, y * y, x * z, y * z))
        # the normal equations by cofactors of the first column of moments
        p, q, r = yy * n - sy * sy, xy * n - sy * sx, xy * sy - yy * sx
        det = xx * p - xy * q + sx * r
        mean = sz / n
        a = (xz * p - xy * (yz * n - sy * sz) + sx * (yz * sy - yy * sz)) / det
        b = (xx * (yz * n - sz * sy) - xz * q + sx * (xy * sz - yz * sx)) / det
        c = (xx * (yy * sz - yz * sy) - xy * (xy * sz - yz * sx) + xz * r) / det
        level = (np.abs(det) < 1e-12) | (np.sqrt(a * a + b * b) > max_slope)
        a, b, c = np.where(level, 0.0, a), np.where(level, 0.0, b), np.where(level, mean, c)
        off = (c > 1.5 - sensor_h) | (c < -2.0 - sensor_h)
        self.a, self.b, self.c = np.where(off, 0.0, a), np.where(off, 0.0, b), np.where(off, -sensor_h, c)

    def _median(self, v: np.ndarray, group: np.ndarray) -> np.ndarray:
        """The median of each sector's values, not a number where it has none."""
        order = np.lexsort((v, group))
        size = np.bincount(group, minlength=len(self.begin))
        begin = np.cumsum(size) - size
        v = np.append(v[order], np.nan)
        low, high = (np.where(size > 0, begin + k, len(v) - 1) for k in ((size - 1) // 2, size // 2))
        return v[low] + (v[high] - v[low]) * 0.5

    def scatter(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ground points, 1.4826 times their median absolute deviation, height at their centroid) of each sector."""
        on = self.ground
        group, agl = self.group[on], self.agl[on]
        n = np.bincount(group, minlength=len(self.begin))
        mad = 1.4826 * self._median(np.abs(agl - self._median(agl, group)[group]), group)
        with np.errstate(all="ignore"):
            mx, my = (self._sum(np.where(on, v, 0.0)) / n for v in (self.x, self.y))
            height = self.a * mx + self.b * my + self.c
        return n, np.where(n > 4, mad, 0.0), np.where(n > 4, height, 0.0)


def _dealt(points: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """Points by sector and rising height. Those out of range have no plane and are spread by their place."""
    ri, ai = sector()
    p = points.withColumns({"ri": ri, "ai": ai}).withColumn("__at", F.coalesce("ai", F.pmod(F.xxhash64("x", "y", "z"), F.lit(AZIMUTH))))
    return p.repartition(*keys, "ri", "__at").sortWithinPartitions(*keys, "ri", "__at", "z", *[c for c in order if c in points.columns])


def _limits(sensor_h: float, seed_share: float, max_slope: float, threshold: float) -> dict:
    return {"sensor_h": sensor_h, "seed_share": seed_share, "max_slope": max_slope, "threshold": threshold}


def ground_points(points: DataFrame, keys: tuple[str, ...] = (), order: tuple[str, ...] = ("ok", "pk", "sk", "ln"), sensor_h: float = SENSOR_H, seed_share: float = SEED_SHARE, max_slope: float = MAX_SLOPE, threshold: float = THRESHOLD) -> DataFrame:
    """Points with ri, ai, ground_z, agl (height above ground) and ground; without a plane the ground is at -sensor_h and none of it."""
    names, limits = [*keys, "ri", "__at"], _limits(sensor_h, seed_share, max_slope, threshold)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, names):
            s = Sectors(t, names, **limits)
            yield from t.drop_columns(["__at"]).append_column("ground_z", pa.array(s.ground_z)).append_column("agl", pa.array(s.agl)).append_column("ground", pa.array(s.ground)).to_batches()

    p = _dealt(points, keys, order)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in p.schema.fields if f.name != "__at")
    return p.mapInArrow(work, f"{kept}, ground_z DOUBLE, agl DOUBLE, ground BOOLEAN")


def sectors(points: DataFrame, keys: tuple[str, ...] = (), order: tuple[str, ...] = ("ok", "pk", "sk", "ln"), sensor_h: float = SENSOR_H, seed_share: float = SEED_SHARE, max_slope: float = MAX_SLOPE, threshold: float = THRESHOLD) -> DataFrame:
    """(keys, ri, ai, a, b, c, slope, rough, h, n) of each sector with 8 points or more: its plane z = a x + b y + c, the
    plane's slope, 1.4826 MAD of the ground's residuals, the height at the ground's centroid, and the ground's points."""
    names, limits = [*keys, "ri", "__at"], _limits(sensor_h, seed_share, max_slope, threshold)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, names):
            s = Sectors(t, names, **limits)
            n, rough, h = s.scatter()
            has = np.flatnonzero(s.has)
            head = t.select([*keys, "ri", "ai"]).take(pa.array(s.begin[has]))
            for c, v in (("a", s.a), ("b", s.b), ("c", s.c), ("slope", np.sqrt(s.a * s.a + s.b * s.b)), ("rough", rough), ("h", h), ("n", n.astype(np.int64))):
                head = head.append_column(c, pa.array(v[has]))
            yield from head.to_batches()

    p = _dealt(points.select(*dict.fromkeys([*keys, "x", "y", "z", *[c for c in order if c in points.columns]])), keys, order)
    types = dict(p.dtypes)
    return p.mapInArrow(work, ", ".join(f"`{c}` {types[c]}" for c in (*keys, "ri", "ai")) + ", a DOUBLE, b DOUBLE, c DOUBLE, slope DOUBLE, rough DOUBLE, h DOUBLE, n BIGINT")


def _on_lattice(rows: DataFrame, keys: tuple[str, ...], inputs: list[str], name: str, f: Callable[..., np.ndarray]) -> DataFrame:
    """Adds a column that ``f`` works out from each sweep's lattices (24 x 72, not a number where there is nothing)."""
    types = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in rows.columns if c != name) + f", `{name}` DOUBLE"

    def work(t: pa.Table) -> pa.Table:
        at = t.column("ri").to_numpy().astype(np.int64), t.column("ai").to_numpy().astype(np.int64)
        grids = []
        for c in inputs:
            g = np.full((RADIAL, AZIMUTH), np.nan)
            g[at] = pc.fill_null(t.column(c).cast(pa.float64()), float("nan")).to_numpy()
            grids.append(g)
        if name in t.column_names:
            t = t.drop_columns([name])
        with np.errstate(all="ignore"):
            return t.append_column(name, pa.array(f(*grids)[at], from_pandas=True))

    return rows.groupBy(*keys).applyInArrow(work, schema)


def _around(g: np.ndarray, beyond: np.ndarray, past: np.ndarray) -> list[np.ndarray]:
    """What the four neighbours of each sector hold; azimuth wraps, ``beyond`` and ``past`` lie inside and outside the rings."""
    return [np.roll(g, 1, 1), np.roll(g, -1, 1), np.concatenate([beyond[None], g[:-1]]), np.concatenate([g[1:], past[None]])]


def sector_step(rows: DataFrame, keys: tuple[str, ...] = (), least: int = 5) -> DataFrame:
    """Adds step: the largest height difference to the four neighbours, both with ``least`` points; 0 without any."""
    none = np.full(AZIMUTH, np.nan)

    def step(h: np.ndarray, n: np.ndarray) -> np.ndarray:
        h = np.where(n >= least, h, np.nan)
        return np.fmax.reduce([np.abs(h - o) for o in _around(h, none, none)] + [np.zeros(h.shape)])

    return _on_lattice(rows, keys, ["h", "n"], "step", step)


def polar_smooth(rows: DataFrame, keys: tuple[str, ...] = (), value: str = "score") -> DataFrame:
    """Adds smooth: the median over a sector and its four neighbours, where the sector itself has a value; rings end in themselves."""

    def smooth(v: np.ndarray) -> np.ndarray:
        all_ = np.sort(np.stack([v, *_around(v, v[0], v[-1])]), axis=0)  # what is not a number comes last
        size = (~np.isnan(all_)).sum(0)
        low, high = (np.take_along_axis(all_, np.maximum(k, 0)[None], 0)[0] for k in ((size - 1) // 2, np.minimum(size // 2, 4)))
        return np.where(np.isnan(v), np.nan, low + (high - low) * 0.5)

    return _on_lattice(rows, keys, [value], "smooth", smooth)
