"""Dense filters over ground rasters: hole filling, median, step and trend."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

RES, STEP_CELLS, TREND_CELLS = 0.25, 5, 17


def windows(a: np.ndarray, size: int) -> np.ndarray:
    half = size // 2
    return np.lib.stride_tricks.sliding_window_view(np.pad(a, half, "edge"), (size, size))


def median3(a: np.ndarray) -> np.ndarray:
    return np.median(windows(a, 3), axis=(2, 3))


def minimum(a: np.ndarray, size: int = STEP_CELLS) -> np.ndarray:
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (size // 2, size // 2)
        a = np.lib.stride_tricks.sliding_window_view(np.pad(a, pad, "edge"), size, axis=axis).min(-1)
    return a


def mean(a: np.ndarray, size: int = TREND_CELLS) -> np.ndarray:
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (size // 2, size // 2)
        a = np.lib.stride_tricks.sliding_window_view(np.pad(a, pad, "edge"), size, axis=axis).mean(-1)
    return a


def row_sources(seen: np.ndarray) -> np.ndarray:
    """For each cell the column of the nearest seen cell of its row, the left one of two; -1 in a row without any."""
    n = seen.shape[1]
    x, far = np.arange(n), 4 * n + 4
    left = np.maximum.accumulate(np.where(seen, x, -far), 1)
    right = np.minimum.accumulate(np.where(seen, x, far + n)[:, ::-1], 1)[:, ::-1]
    return np.where(seen.any(1)[:, None], np.where(x - left <= right - x, left, right), -1)


def column_sources(rows: np.ndarray, across: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` rows and each column, which of ``rows`` (rising) has the nearest seen cell, the first of equals.

    ``across`` holds the squared distance along each of the rows. The distances from one row are a parabola over the
    column, so this is the lower envelope of parabolas, built and read in one scan each; all columns at once.
    """
    columns = across.shape[1]
    lane, top = np.arange(columns), np.zeros(columns, np.int64)
    owner, begin = np.zeros((len(rows), columns), np.int64), np.zeros((len(rows), columns), np.int64)
    cost = lambda x, k: (x - rows[k]) ** 2 + across[k, lane]
    for k in range(1, len(rows)):
        while True:  # parabolas that the new one beats where they begin are no part of the envelope
            at = begin[top, lane]
            beaten = (top >= 0) & (cost(at, owner[top, lane]) > cost(at, k))
            if not beaten.any():
                break
            top = top - beaten
            if (top < 0).any():
                owner[0, top < 0], begin[0, top < 0], top = k, 0, np.maximum(top, 0)
        last = owner[top, lane]
        # the last row where the one before is at least as near
        gap = np.maximum(2 * (rows[k] - rows[last]), 1)
        start = (rows[k] ** 2 - rows[last] ** 2 + across[k] - across[last, lane]) // gap + 1
        new = (last != k) & (start < n)
        top = top + new
        owner[top[new], lane[new]], begin[top[new], lane[new]] = k, np.maximum(start[new], 0)
    out = np.empty((n, columns), np.int64)
    for x in range(n - 1, -1, -1):
        out[x] = owner[top, lane]
        top = np.maximum(top - (begin[top, lane] == x), 0)
    return out


def nearest_fill(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(holes filled with the nearest value, distance to it in cells): exact Euclidean, a pass over rows and one over columns."""
    seen = ~np.isnan(a)
    rows = np.flatnonzero(seen.any(1))
    source = row_sources(seen[rows])
    across = (source - np.arange(a.shape[1])) ** 2
    k = column_sources(rows, across, a.shape[0])
    x = np.arange(a.shape[1])[None, :]
    return a[rows[k], source[k, x]], np.sqrt((rows[k] - np.arange(a.shape[0])[:, None]) ** 2 + across[k, x])


#: Cells along a block of a raster, and how far a surface looks beyond its own cells.
BLOCK = 512
_HALO = TREND_CELLS // 2 + 1


def _surface(filled: np.ndarray, before: tuple[int, int], shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(median, step, trend) of a block of ``shape`` within ``filled``, which has ``before`` cells ahead of the block and
    ends at the raster's border or a halo beyond the block."""
    r = median3(filled)
    half, cut, pad = TREND_CELLS // 2, [], []
    for axis in (0, 1):
        low, high = before[axis], filled.shape[axis] - before[axis] - shape[axis]
        a, b = min(low, half), min(high, half)
        cut.append(slice(low - a, low + shape[axis] + b))
        pad.append((half - a, half - b))  # beyond the raster, its edge goes on
    wide = np.pad(r[tuple(cut)], pad, "edge")
    inner = tuple(slice(half - STEP_CELLS // 2, half + n + STEP_CELLS // 2) for n in shape)
    low, trend = wide[inner], wide
    for axis in (0, 1):
        low = np.lib.stride_tricks.sliding_window_view(low, STEP_CELLS, axis=axis).min(-1)
        trend = np.lib.stride_tricks.sliding_window_view(trend, TREND_CELLS, axis=axis).mean(-1)
    own = wide[half : half + shape[0], half : half + shape[1]]
    return own, own - low, trend


def ground_surfaces(cells: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """(keys, gx, gy, height, gdist, step, trend) over the bounding raster of each sweep's ground cells, of any size.

    A pass over strips of rows finds the nearest value along each row, one over strips of columns the nearest of all, and
    one over blocks with a halo the surfaces; tasks hold a strip or a block, never a raster. A block is a halo wide at least.
    """
    from pyspark.sql import functions as F

    if block < _HALO:
        raise ValueError(f"a block has {_HALO} cells or more along each side")

    types = dict(cells.dtypes)
    by = "".join(f"`{k}` {types[k]}, " for k in keys)
    box = cells.groupBy(*keys).agg(F.min("gx").alias("__ox"), F.min("gy").alias("__oy"), (F.max("gx") - F.min("gx") + 1).alias("__nx"), (F.max("gy") - F.min("gy") + 1).alias("__ny"))
    framed = cells.select(*keys, "gx", "gy", "height").join(box, keys) if keys else cells.select("gx", "gy", "height").join(F.broadcast(box))  # one row
    size = ("__nx", "__ny", "__ox", "__oy")
    whole = ", ".join(f"{c} BIGINT" for c in size)

    def same(t: pa.Table, n: int) -> dict[str, pa.Array]:
        """The keys and the raster's bounds, n times."""
        return {c: pa.array([t.column(c)[0].as_py()] * n, t.schema.field(c).type) for c in (*keys, *size)}

    def lists(a: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(np.ascontiguousarray(a).reshape(-1)))

    def along_rows(t: pa.Table) -> pa.Table:
        ox, oy, ny = (t.column(c)[0].as_py() for c in ("__ox", "__oy", "__ny"))
        rows, place = np.unique(t.column("gx").to_numpy() - ox, return_inverse=True)
        raw = np.full((len(rows), ny), np.nan)
        raw[place, t.column("gy").to_numpy() - oy] = t.column("height").to_numpy()
        source = row_sources(~np.isnan(raw))
        across, value, out = (source - np.arange(ny)) ** 2, np.take_along_axis(raw, source, 1), []
        for k, begin in enumerate(range(0, ny, block)):
            part = slice(begin, begin + block)
            out.append(pa.table({**same(t, len(rows)), "row": pa.array(rows), "strip": pa.array(np.full(len(rows), k)), "across": lists(across[:, part]), "value": lists(value[:, part])}))
        return pa.concat_tables(out)

    strips = framed.withColumn("__strip", F.floor((F.col("gx") - F.col("__ox")) / block)).groupBy(*keys, "__strip").applyInArrow(along_rows, f"{by}{whole}, row BIGINT, strip BIGINT, across ARRAY<BIGINT>, value ARRAY<DOUBLE>")

    def along_columns(t: pa.Table) -> pa.Table:
        t = t.sort_by("row")
        rows, (nx, ny), strip = t.column("row").to_numpy(), (t.column(c)[0].as_py() for c in ("__nx", "__ny")), t.column("strip")[0].as_py()
        across, value = (np.stack(t.column(c).to_numpy()) for c in ("across", "value"))
        k, x = column_sources(rows, across, nx), np.arange(across.shape[1])[None, :]
        filled, square, out = value[k, x], (rows[k] - np.arange(nx)[:, None]) ** 2 + across[k, x], []
        width = filled.shape[1]
        for b in range(-(-nx // block)):
            low, high = max(0, b * block - _HALO), min(nx, (b + 1) * block + _HALO)
            # each block gets its own columns, and the first or last of the strips beside it
            for to, part in ((strip, slice(0, width)), (strip - 1, slice(0, min(width, _HALO))), (strip + 1, slice(max(0, width - _HALO), width))):
                if 0 <= to < -(-ny // block):
                    n = high - low
                    out.append(pa.table({**same(t, n), "brow": pa.array(np.full(n, b)), "strip": pa.array(np.full(n, to)), "row": pa.array(np.arange(low, high)), "column": pa.array(np.full(n, strip * block + part.start)), "value": lists(filled[low:high, part]), "square": lists(square[low:high, part])}))
        return pa.concat_tables(out)

    blocks = strips.groupBy(*keys, "strip").applyInArrow(along_columns, f"{by}{whole}, brow BIGINT, strip BIGINT, row BIGINT, column BIGINT, value ARRAY<DOUBLE>, square ARRAY<BIGINT>")

    def over_block(t: pa.Table) -> pa.Table:
        nx, ny, ox, oy, b, strip = (t.column(c)[0].as_py() for c in ("__nx", "__ny", "__ox", "__oy", "brow", "strip"))
        (x0, x1), (y0, y1) = ((k * block, min(n, (k + 1) * block)) for k, n in ((b, nx), (strip, ny)))
        xa, xb, ya, yb = max(0, x0 - _HALO), min(nx, x1 + _HALO), max(0, y0 - _HALO), min(ny, y1 + _HALO)
        filled, square = np.empty((xb - xa, yb - ya)), np.empty((xb - xa, yb - ya))
        for row, column, value, d in zip(*(t.column(c).to_numpy() for c in ("row", "column", "value", "square"))):
            filled[row - xa, column - ya : column - ya + len(value)] = value
            square[row - xa, column - ya : column - ya + len(d)] = d
        height, step, trend = _surface(filled, (x0 - xa, y0 - ya), (x1 - x0, y1 - y0))
        i, j = np.indices(height.shape).reshape(2, -1)
        distance = np.sqrt(square[x0 - xa : x1 - xa, y0 - ya : y1 - ya]) * RES
        head = {k: v for k, v in same(t, len(i)).items() if k in keys}
        return pa.table(head | {"gx": i + x0 + ox, "gy": j + y0 + oy} | {c: v.reshape(-1) for c, v in (("height", height), ("gdist", distance), ("step", step), ("trend", trend))})

    return blocks.groupBy(*keys, "brow", "strip").applyInArrow(over_block, f"{by}gx bigint, gy bigint, height double, gdist double, step double, trend double")


def bilinear(cells: DataFrame, raster: DataFrame, keys: list[str], values: list[str], x: str = "cx", y: str = "cy", res: float = RES) -> DataFrame:
    """Adds each raster value at the cells' places, by equality joins with the four taps; null where a
    sweep has no raster."""
    from pyspark.sql import functions as F

    box = raster.groupBy(*keys).agg(F.min("gx").alias("__ox"), F.min("gy").alias("__oy"), (F.max("gx") - F.min("gx") + 1).alias("__nx"), (F.max("gy") - F.min("gy") + 1).alias("__ny"))
    c = cells.join(box, keys, "left")
    clip = lambda v, o, n: F.least(F.greatest(F.col(v) / res - F.col(o), F.lit(0.0)), F.col(n) - 1.001)
    c = c.withColumns({"__fx": clip(x, "__ox", "__nx"), "__fy": clip(y, "__oy", "__ny")})
    c = c.withColumns({"__ix": F.floor("__fx"), "__iy": F.floor("__fy")}).withColumns({"__ux": F.col("__fx") - F.floor("__fx"), "__uy": F.col("__fy") - F.floor("__fy")})
    total = {v: F.lit(0.0) for v in values}
    for dx in (0, 1):
        for dy in (0, 1):
            tap = raster.select(*keys, F.col("gx").alias("__gx"), F.col("gy").alias("__gy"), *[F.col(v).alias(f"__{v}{dx}{dy}") for v in values])
            c = c.withColumns({"__gx": F.col("__ix") + F.col("__ox") + dx, "__gy": F.col("__iy") + F.col("__oy") + dy}).join(tap, [*keys, "__gx", "__gy"], "left").drop("__gx", "__gy")
            share = (F.col("__ux") if dx else 1 - F.col("__ux")) * (F.col("__uy") if dy else 1 - F.col("__uy"))
            total = {v: t + share * F.col(f"__{v}{dx}{dy}") for v, t in total.items()}
    out = c.withColumns(total)
    return out.drop(*[n for n in out.columns if n.startswith("__")])
