"""Readers of sensor files, and of their text side files."""

from __future__ import annotations

import io
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FRAME = r"([0-9]+)[^/0-9]*$"


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    out = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1)
    return out.select(F.regexp_extract(stem, _FRAME, 1).cast("bigint").alias("frame"), "content")


def _rows(files: DataFrame, decode: Callable[[bytes], pd.DataFrame], schema: str) -> DataFrame:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for frame, content in zip(batch["frame"], batch["content"]):
                t = decode(bytes(content))
                t.insert(0, "frame", frame)
                t.insert(1, "pid", np.arange(len(t)))
                yield t

    return files.mapInPandas(work, f"frame bigint, pid bigint, {schema}")


def scan(spark: SparkSession, path: str, pattern: str = "*.bin") -> DataFrame:
    """(frame, pid, x, y, z, intensity) of little-endian float32 quadruples."""
    return _rows(_files(spark, path, pattern), lambda b: pd.DataFrame(np.frombuffer(b, "<f4").reshape(-1, 4).astype(float), columns=["x", "y", "z", "intensity"]), "x double, y double, z double, intensity double")


def point_labels(spark: SparkSession, path: str, pattern: str = "*.label") -> DataFrame:
    """(frame, pid, semantic, instance) of unsigned 32-bit words: the low and high half."""
    return _rows(_files(spark, path, pattern), lambda b: pd.DataFrame({"semantic": (w := np.frombuffer(b, "<u4")) & 0xFFFF, "instance": w >> 16}).astype("int64"), "semantic bigint, instance bigint")


def labelled_scan(spark: SparkSession, scans: str, labels: str, lut: DataFrame) -> DataFrame:
    """Scans with grid class and moving flag by a table (raw, cls, moving); unknown ids are the last class."""
    p = scan(spark, scans).join(point_labels(spark, labels), ["frame", "pid"], "left")
    return p.join(lut.withColumnRenamed("raw", "semantic"), "semantic", "left").select("frame", "pid", "x", "y", "z", "intensity", F.coalesce("cls", F.lit(7)).alias("lab"), F.coalesce("moving", F.lit(False)).alias("moving"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]+)?$", 1)
    return spark.read.option("recursiveFileLookup", "true").text(path).withColumn("frame", F.regexp_extract(stem, _FRAME, 1).cast("bigint"))


def object_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labelled objects of 15 fields a line; shorter lines are skipped."""
    f = _lines(spark, path).withColumn("f", F.split(F.trim("value"), " +")).where(F.size("f") >= 15)
    names = ("truncation", "occlusion", "alpha", "x1", "y1", "x2", "y2", "h", "w", "l", "cx", "cy", "cz", "ry")
    columns = [F.col("f")[i + 1].cast("double").alias(n) for i, n in enumerate(names)]
    return f.select("frame", F.col("f")[0].alias("type"), *columns).withColumn("occlusion", F.col("occlusion").cast("int"))


def calibration(spark: SparkSession, path: str) -> DataFrame:
    """(frame, name, values) of lines ``name: number …``."""
    f = _lines(spark, path).where(F.col("value").contains(":"))
    parts = F.split(F.trim(F.regexp_extract("value", ":(.*)$", 1)), " +")
    return f.select("frame", F.trim(F.substring_index("value", ":", 1)).alias("name"), F.transform(parts, lambda v: v.try_cast("double")).alias("values"))


def camera(calib: DataFrame) -> DataFrame:
    """One row a frame with the matrices P2, R0_rect and Tr_velo_to_cam; absent ones are null."""
    return calib.groupBy("frame").pivot("name", ["P2", "R0_rect", "Tr_velo_to_cam"]).agg(F.first("values"))


def odometry(spark: SparkSession, path: str, tr: np.ndarray | str | None) -> DataFrame:
    """Poses of a trajectory file (12 numbers a line) in the sensor's frame: Tr⁻¹ · T · Tr.

    ``tr`` is the matrix or the path of a calibration file that has it. A trajectory is a small text
    file of one row a frame and is read on the driver.
    """
    if isinstance(tr, str):
        row = calibration(spark, tr).where("name = 'Tr'").select("values").first()
        tr = None if row is None else np.array(row["values"], float)
    if tr is None:
        raise ValueError("the calibration has no Tr")
    t = np.eye(4)
    t[:3] = np.asarray(tr, float).reshape(3, 4)
    lines = [r.value for r in spark.read.text(path).collect()]
    rows = []
    for i, line in enumerate(x for x in lines if x.strip()):
        m = np.eye(4)
        m[:3] = np.array(line.split(), float).reshape(3, 4)
        m = np.linalg.inv(t) @ m @ t
        rows.append((i, *m[:3, :3].reshape(-1).tolist(), *m[:3, 3].tolist()))
    return spark.createDataFrame(rows, "frame int, " + ", ".join(f"r{i}{j} double" for i in range(3) for j in range(3)) + ", tx double, ty double, tz double")


def drive_table(spark: SparkSession, path: str) -> DataFrame:
    """A simulator's frame table, its last row a frame in the order of files and of lines; path columns are dropped."""
    from pyspark.sql import Window

    # within a split, rows are numbered as they are read; splits are ordered by where they begin
    t = spark.read.option("header", "true").csv(path).withColumn("__at", F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("k")))
    last = Window.partitionBy("sample_id").orderBy(F.desc("__at"))
    t = t.withColumn("__r", F.row_number().over(last)).where("__r = 1")
    return t.select(*[F.col(c).try_cast("double").alias(c) for c in t.columns if not c.startswith("__") and "path" not in c])


def decode_ids(values: np.ndarray) -> np.ndarray:
    """Ids kept in float32, as numbers or as the bit patterns of unsigned integers."""
    v = np.asarray(values, np.float32)
    as_numbers = len(v) > 0 and float(np.nanmax(v)) > 1e-6
    return v.astype(np.int64) if as_numbers else v.view(np.uint32).astype(np.int64)


def _array(content: bytes, fields: tuple[str, ...] = ()) -> np.ndarray:
    """The point array of an archive, or its named fields if it is structured; absent fields are left out."""
    with np.load(io.BytesIO(content), allow_pickle=False) as z:
        name = next((k for k in ("points", "data", "arr_0", "pointcloud", "lidar", "xyz") if k in z.files), None)
        if name is None:
            raise ValueError(f"no point array among {z.files}")
        a = z[name]
    if a.dtype.names:
        a = np.stack([a[n].astype(np.float64) for n in fields or a.dtype.names if n in a.dtype.names], 1)
    if a.ndim != 2 or a.shape[1] < 3:
        raise ValueError(f"points of shape {a.shape}")
    return a


def simulator_scan(spark: SparkSession, path: str, pattern: str = "lidar_*.npz", mirror: bool = True, intensity: int | str = 3) -> DataFrame:
    """(frame, pid, x, y, z, intensity), y mirrored to a right-handed frame; intensities above 1 are scaled to it.

    ``intensity`` is a column's place, or the field's name in structured arrays. Arrays of six columns
    and more are a semantic sensor's, whose fourth is an angle, and have none.
    """

    def decode(b: bytes) -> pd.DataFrame:
        a = _array(b, ("x", "y", "z", intensity if isinstance(intensity, str) else "intensity")).astype(np.float64)
        at = intensity if isinstance(intensity, int) else 3
        i = a[:, at] if at < a.shape[1] < 6 else np.zeros(len(a))
        top = i.max(initial=0.0)
        return pd.DataFrame({"x": a[:, 0], "y": -a[:, 1] if mirror else a[:, 1], "z": a[:, 2], "intensity": i / top if top > 1.001 else i})

    return _rows(_files(spark, path, pattern), decode, "x double, y double, z double, intensity double")


def simulator_semantic(spark: SparkSession, path: str, pattern: str = "semantic_*.npz", mirror: bool = True) -> DataFrame:
    """(frame, pid, x, y, z, obj, tag) of a semantic sensor's six columns."""

    def decode(b: bytes) -> pd.DataFrame:
        a = _array(b)
        ids = [decode_ids(a[:, k]) for k in (4, 5)]
        return pd.DataFrame({"x": a[:, 0].astype(float), "y": (-a[:, 1] if mirror else a[:, 1]).astype(float), "z": a[:, 2].astype(float), "obj": ids[0], "tag": ids[1]})

    return _rows(_files(spark, path, pattern), decode, "x double, y double, z double, obj bigint, tag bigint")


def simulator_frames(spark: SparkSession, root: str, meta: DataFrame, mount_z: float = 2.4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(points, semantic points, poses) of the frames of a capture that have a scan of both kinds and a row of metadata.

    Poses are (frame, r00 … r22, tx, ty, tz) of the sensor, ``mount_z`` above the vehicle's origin, with y
    to the left.
    """
    from sweepgrid.functions.geometry import mirrored_rotation

    raw, semantic = simulator_scan(spark, f"{root}/raw_lidar"), simulator_semantic(spark, f"{root}/semantic_lidar")
    both = raw.select("frame").distinct().join(semantic.select("frame").distinct(), "frame")
    known = meta.withColumn("frame", F.col("sample_id").cast("bigint")).join(both, "frame", "left_semi")
    r = mirrored_rotation(F.col("ego_roll"), F.col("ego_pitch"), F.col("ego_yaw"))
    lift = [row[2] * mount_z for row in r]
    turn = [c.alias(f"r{i}{j}") for i, row in enumerate(r) for j, c in enumerate(row)]
    poses = known.select("frame", *turn, (F.col("ego_x") + lift[0]).alias("tx"), (lift[1] - F.col("ego_y")).alias("ty"), (F.col("ego_z") + lift[2]).alias("tz"))
    keep = lambda d: d.join(known.select("frame"), "frame", "left_semi")
    return keep(raw), keep(semantic), poses


def decode_png(content: bytes) -> np.ndarray:
    """(rows, columns, channels) of an 8-bit PNG without palette or interlacing."""
    if content[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG image")
    at, head, data = 8, b"", b""
    while at < len(content):
        size, kind = int.from_bytes(content[at : at + 4], "big"), content[at + 4 : at + 8]
        body = content[at + 8 : at + 8 + size]
        head, data = (body, data) if kind == b"IHDR" else (head, data + body) if kind == b"IDAT" else (head, data)
        at += 12 + size
    width, height, depth, colour = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big"), head[8], head[9]
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or channels is None or head[12]:
        raise ValueError("not a plain 8-bit image")
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, 1 + width * channels)
    out, above = np.zeros((height, width, channels), np.uint8), np.zeros((width, channels), np.int64)
    for i in range(height):
        kind, now = int(lines[i, 0]), lines[i, 1:].reshape(width, channels).astype(np.int64)
        if kind == 1:
            now = now.cumsum(0)
        elif kind == 2:
            now = now + above
        elif kind in (3, 4):
            left = corner = np.zeros(channels, np.int64)
            for j in range(width):
                up = above[j]
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    near = np.abs(np.stack([p - left, p - up, p - corner]))
                    guess = np.choose(near.argmin(0), [left, up, corner])
                now[j] = left = (now[j] + guess) & 255
                corner = up
        above = now & 255
        out[i] = above
    return out


def road_images(spark: SparkSession, path: str, pattern: str = "*.png") -> DataFrame:
    """(frame, u, v, road, valid) of ground-truth images: blue marks the road, red what is labelled at all."""

    def decode(b: bytes) -> pd.DataFrame:
        a = decode_png(b)
        v, u = np.indices(a.shape[:2]).reshape(2, -1)
        return pd.DataFrame({"u": u, "v": v, "road": (a[:, :, 2] > 0).reshape(-1), "valid": (a[:, :, 0] > 0).reshape(-1)}).astype({"u": "int32", "v": "int32"})

    return _rows(_files(spark, path, pattern), decode, "u int, v int, road boolean, valid boolean").drop("pid")


def complete_frames(scans: DataFrame, meta: DataFrame, key: str = "frame") -> DataFrame:
    """Frames that have both a scan and a row of metadata, in order."""
    return scans.select(key).distinct().join(meta.select(F.col("sample_id").cast("bigint").alias(key)), key, "left_semi").orderBy(key)


def road_pixels(pixels: DataFrame) -> DataFrame:
    """(frame, u, v, road, valid) of decoded ground-truth pixels (frame, u, v, red, blue)."""
    return pixels.select("frame", "u", "v", (F.col("blue") > 0).alias("road"), (F.col("red") > 0).alias("valid"))


def synthetic_scene(spark: SparkSession, n: int = 20_000, objects: int = 6, points: int = 600, seed: int = 0) -> DataFrame:
    """(x, y, z, obj, pid): rippled ground and a ring of upright boxes on it, from hashes of the row
    number, so it is the same on any cluster."""
    unit = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "id"), F.lit(1 << 20)) + 0.5) / (1 << 20)
    x, y = unit(1) * 64 - 32, unit(2) * 64 - 32
    ground = spark.range(n).select("id", x.alias("x"), y.alias("y"), (F.sin(x / 5) * 0.01 - 1.8 + unit(3) * 0.02).alias("z"), F.lit(0).alias("obj"))
    which = F.floor(F.col("id") / points)
    angle, far = which * (2 * math.pi / objects), 10 + 2 * which
    boxes = spark.range(objects * points).select(
        (F.col("id") + n).alias("id"), (F.cos(angle) * far + unit(4) * 3 - 1.5).alias("x"), (F.sin(angle) * far + unit(5) * 1.6 - 0.8).alias("y"), (unit(6) * 1.4 - 1.75).alias("z"), (which + 1).cast("int").alias("obj"),
    )
    return ground.unionByName(boxes).withColumnRenamed("id", "pid")


def split_calibration(spark: SparkSession, path: str) -> DataFrame:
    """(drive, V2C, R0, P2, width, height) of drives whose calibration lies in two files, one row a drive.

    A drive is the folder that holds ``calib_cam_to_cam.txt``; without the other file V2C is null.
    """
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "calib_*_to_cam.txt").text(path)
    numbers = F.transform(F.split(F.trim(F.regexp_extract("value", "^[^:]*:(.*)$", 1)), " +"), lambda v: v.try_cast("double"))
    rows = lines.select(F.regexp_extract(F.input_file_name(), "^(.*)/[^/]+$", 1).alias("drive"), F.regexp_extract(F.input_file_name(), "([^/]+)[.]txt$", 1).alias("file"), F.substring_index("value", ":", 1).alias("name"), numbers.alias("v"))
    take = lambda file, name: F.first(F.when((F.col("file") == file) & (F.col("name") == name), F.col("v")), ignorenulls=True)
    of = rows.groupBy("drive").agg(take("calib_velo_to_cam", "R").alias("r"), take("calib_velo_to_cam", "T").alias("t"), take("calib_cam_to_cam", "R_rect_00").alias("R0"), take("calib_cam_to_cam", "P_rect_02").alias("P2"), take("calib_cam_to_cam", "S_rect_02").alias("s"), F.max((F.col("file") == "calib_cam_to_cam").cast("int")).alias("known"))
    rigid = F.concat(*[x for k in range(3) for x in (F.slice("r", 3 * k + 1, 3), F.slice("t", k + 1, 1))])
    return of.where("known = 1").select("drive", rigid.alias("V2C"), "R0", "P2", F.col("s")[0].cast("int").alias("width"), F.col("s")[1].cast("int").alias("height"))


def frame_stems(spark: SparkSession, path: str, pattern: str = "*.png") -> DataFrame:
    """(stem, frame) of the files below a folder, in order of the stems; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path")
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1)
    return files.select(stem.alias("stem"), F.regexp_extract(stem, _FRAME, 1).cast("bigint").alias("frame")).orderBy("stem")


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Proposals of all shards that ``sinks.write_shards`` wrote below a folder."""
    return spark.read.parquet(path).drop("shard")
