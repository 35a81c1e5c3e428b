"""Data sources of sensor files: scans by byte ranges, their replay as a stream, and shards of proposals.

``scans`` reads folders of ``<frame>.bin`` (little-endian float32 x, y, z, intensity) with ``<frame>.label`` (unsigned
32 bit) beside them. Files are cut into ranges at record borders, so one large scan is many partitions, and filters
on ``frame`` decide which files are planned at all. As a stream it replays the frames in order: an offset is a number
of frames, so a query that starts again goes on where it was. ``proposal_shards`` reads and writes compressed arrays.
Writers put files under hidden names and move them when the job commits; what a failed job wrote is taken away.

Paths go through ``pyarrow.fs``, which must know the store that the executors share.
"""

from __future__ import annotations

import io
import time
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

RECORD, LABEL = 16, 4
RANGE_BYTES = 64 << 20
SAMPLE, CHANNELS, META = 256, 5, ("cls", "cx", "cy", "cz", "l", "w", "h", "yaw", "n")
SCAN = "frame BIGINT, pid BIGINT, x DOUBLE, y DOUBLE, z DOUBLE, intensity DOUBLE, semantic BIGINT, instance BIGINT"
PROPOSAL = f"frame INT, points ARRAY<FLOAT>, {', '.join(f'{c} FLOAT' for c in META)}"


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    fs, path = pafs.FileSystem.from_uri(uri) if ":/" in uri else (pafs.LocalFileSystem(), uri)
    return fs, path.rstrip("/")


def _listed(uri: str, suffix: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files below a folder, but for hidden ones."""
    fs, path = opened(uri)
    found = fs.get_file_info(pafs.FileSelector(path, recursive=True, allow_not_found=True))
    return sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and f.base_name.endswith(suffix) and not f.base_name.startswith("."))


def _number(path: str) -> int:
    """The last number in a file's name."""
    stem, digits = path.rsplit("/", 1)[-1].rsplit(".", 1)[0], ""
    for c in reversed(stem):
        if c.isdigit():
            digits = c + digits
        elif digits:
            break
    return int(digits) if digits else -1


@dataclass
class Range(ds.InputPartition):
    """Records ``first`` to before ``last`` of one scan."""

    path: str
    frame: int
    first: int
    last: int


@dataclass
class _Files:
    """What one read or stream works on."""

    path: str
    labels: str | None
    range_bytes: int
    allowed: list = field(default_factory=list)

    def ranges(self, files: Iterable[tuple[str, int]]) -> list[Range]:
        step, out = max(1, self.range_bytes // RECORD), []
        for path, size in files:
            frame, n = _number(path), size // RECORD
            out += [Range(path, frame, k, min(n, k + step)) for k in range(0, n, step)]
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(self.path)
        labels, where = opened(self.labels) if self.labels else (None, "")
        step = 1 << 16
        with fs.open_input_file(part.path) as scan:
            words = labels.open_input_file(f"{where}/{part.path.rsplit('/', 1)[-1].removesuffix('.bin')}.label") if labels else None
            for k in range(part.first, part.last, step):
                n = min(step, part.last - k)
                rows = np.frombuffer(scan.read_at(n * RECORD, k * RECORD), "<f4").reshape(-1, 4).astype(np.float64)
                raw = np.frombuffer(words.read_at(n * LABEL, k * LABEL), "<u4") if words else None
                kinds = [pa.array((raw & 0xFFFF).astype(np.int64)), pa.array((raw >> 16).astype(np.int64))] if words else [pa.nulls(n, pa.int64())] * 2
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part.frame)), pa.array(np.arange(k, k + n)), *(pa.array(rows[:, j]) for j in range(4)), *kinds], names=["frame", "pid", "x", "y", "z", "intensity", "semantic", "instance"])
            if words:
                words.close()


_TESTS = {ds.EqualTo: lambda f, v: f == v, ds.GreaterThan: lambda f, v: f > v, ds.GreaterThanOrEqual: lambda f, v: f >= v, ds.LessThan: lambda f, v: f < v, ds.LessThanOrEqual: lambda f, v: f <= v, ds.In: lambda f, v: f in v}


class ScanReader(ds.DataSourceReader):
    def __init__(self, files: _Files):
        self.files = files

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        """Comparisons of the frame choose files and need no second look."""
        for f in filters:
            if type(f) in _TESTS and f.attribute == ("frame",):
                self.files.allowed.append((type(f), f.value))
            elif isinstance(f, ds.IsNotNull) and f.attribute == ("frame",):
                continue
            else:
                yield f

    def partitions(self) -> list[Range]:
        wanted = [(p, n) for p, n in _listed(self.files.path, ".bin") if all(_TESTS[kind](_number(p), value) for kind, value in self.files.allowed)]
        return self.files.ranges(wanted) or [Range("", -1, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        return self.files.read(part) if part.path else iter(())


class ReplayReader(ds.DataSourceStreamReader):
    """Frames in order, ``perbatch`` to a micro-batch; with ``rate``, as many as have come due a second since the query
    began; with ``latest``, only the newest of those, as a viewer wants it."""

    def __init__(self, files: _Files, options: dict):
        self.files, self.per, self.rate = files, int(options.get("perbatch", 1)), float(options.get("rate", 0))
        self.latest = options.get("latest", "false").lower() == "true"
        self.begun, self.at, self.frames = time.monotonic(), None, sorted(_listed(files.path, ".bin"), key=lambda f: (_number(f[0]), f[0]))

    def initialOffset(self) -> dict:
        return {"frames": 0}

    def latestOffset(self) -> dict:
        # counted from where the query stands when it starts, which partitions() and commit() tell
        now = self.at or 0
        due = now + self.per if not self.rate else self.first + int((time.monotonic() - self.begun) * self.rate) if self.at is not None else 1
        return {"frames": max(now, min(due, len(self.frames)))}

    @property
    def first(self) -> int:
        return getattr(self, "_first", 0)

    def partitions(self, start: dict, end: dict) -> list[Range]:
        if self.at is None:
            self._first, self.begun = start["frames"], time.monotonic()
        self.at = end["frames"]
        chosen = self.frames[start["frames"] : end["frames"]]
        return self.files.ranges(chosen[-1:] if self.latest else chosen) or [Range("", -1, 0, 0)]

    def commit(self, end: dict) -> None:
        self.at = max(self.at or 0, end["frames"])

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        return self.files.read(part) if part.path else iter(())


@dataclass
class Written(ds.WriterCommitMessage):
    """Files of one task: (hidden path, name it will have)."""

    files: list


class _Moving(ds.DataSourceArrowWriter):
    """Files come to light when the job commits. An overwriting job takes the old ones away at that moment."""

    suffixes: tuple[str, ...] = ()

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def files(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes | None]]:
        """(name, what comes next in that file), None once it is whole."""
        raise NotImplementedError

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, path = opened(self.path)
        fs.create_dir(path, recursive=True)
        done, streams = [], {}
        try:
            try:
                for name, content in self.files(batches):
                    if content is None:
                        streams.pop(name).close()
                        continue
                    if name not in streams:
                        hidden = f"{path}/.{self.job}-{uuid.uuid4().hex}"
                        done.append((hidden, f"{path}/{name}"))
                        streams[name] = fs.open_output_stream(hidden)
                    streams[name].write(content)
            finally:
                for out in streams.values():
                    out.close()
        except Exception:
            self._taken_away(done)
            raise
        return Written(done)

    def _taken_away(self, files: list) -> None:
        fs, _ = opened(self.path)
        for hidden, _ in files:
            if fs.get_file_info(hidden).type == pafs.FileType.File:
                fs.delete_file(hidden)

    def commit(self, messages: list) -> None:
        fs, path = opened(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        names = [name for _, name in files]
        if len(set(names)) != len(names):
            self.abort(messages)
            raise ValueError("two tasks wrote one file; partition by what names it")
        if self.overwrite:
            for suffix in self.suffixes:
                for old, _ in _listed(self.path, suffix):
                    fs.delete_file(old)
        for hidden, name in files:
            fs.move(hidden, name)
        self._swept(fs, path)

    def abort(self, messages: list) -> None:
        self._taken_away([f for m in messages if m is not None for f in m.files])
        self._swept(*opened(self.path))

    def _swept(self, fs: pafs.FileSystem, path: str) -> None:
        """Takes away what tasks of this job left that were run twice or lost."""
        for f in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)):
            if f.base_name.startswith(f".{self.job}-"):
                fs.delete_file(f.path)


def _runs(batches: Iterator[pa.RecordBatch], key) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows of equal key within a batch; the next batch may go on with the last key."""
    for batch in batches:
        keys = key(batch)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else []
        for a, b in zip(cuts, cuts[1:]):
            yield int(keys[a]), batch.slice(a, b - a)


def _by(batches: Iterator[pa.RecordBatch], key) -> Iterator[tuple[int, pa.Table]]:
    """Rows of equal key, which come one after the other."""
    held, name = [], None
    for own, rows in _runs(batches, key):
        if held and own != name:
            yield name, pa.Table.from_batches(held)
            held = []
        name = own
        held.append(rows)
    if held:
        yield name, pa.Table.from_batches(held)


class ScanWriter(_Moving):
    suffixes = (".bin", ".label")

    def files(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes | None]]:
        """A scan grows with the batches; a task holds one of them, never a scan."""
        last = None
        for frame, t in _runs(batches, lambda b: b.column("frame").to_numpy()):
            number = lambda c: np.nan_to_num(t.column(c).to_numpy(zero_copy_only=False))  # noqa: B023, E731
            if last is not None and frame != last:
                yield from ((f"{last:06d}{s}", None) for s in self.suffixes)
            yield f"{frame:06d}.bin", np.stack([number(c) for c in ("x", "y", "z", "intensity")], 1).astype("<f4").tobytes()
            yield f"{frame:06d}.label", (number("semantic").astype(np.uint32) | number("instance").astype(np.uint32) << np.uint32(16)).astype("<u4").tobytes()
            last = frame


class ScanSource(ds.DataSource):
    """``spark.read.format("scans")`` with options path, labels, rangebytes; as a stream perbatch, rate, latest too."""

    @classmethod
    def name(cls) -> str:
        return "scans"

    def schema(self) -> str:
        return SCAN

    def _files(self) -> _Files:
        return _Files(self.options["path"], self.options.get("labels"), int(self.options.get("rangebytes", RANGE_BYTES)))

    def reader(self, schema) -> ScanReader:
        return ScanReader(self._files())

    def streamReader(self, schema) -> ReplayReader:
        return ReplayReader(self._files(), self.options)

    def writer(self, schema, overwrite: bool) -> ScanWriter:
        return ScanWriter(self.options["path"], overwrite)


class ShardReader(ds.DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Range]:
        return [Range(p, -1, 0, n) for p, n in _listed(self.path, ".npz")] or [Range("", -1, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.path:
            fs, _ = opened(self.path)
            with fs.open_input_file(part.path) as f:
                shard = np.load(io.BytesIO(f.read()))
            points, meta, frame = shard["points"], shard["meta"], shard["frame"]
            for k in range(0, len(frame), 1024):
                p = points[k : k + 1024].astype(np.float32)
                size = p[0].size
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * size), pa.array(p.reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array(frame[k : k + 1024].astype(np.int32)), lists, *(pa.array(meta[k : k + 1024, j].astype(np.float32)) for j in range(len(META)))], names=["frame", "points", *META])


class ShardWriter(_Moving):
    suffixes = (".npz",)

    def __init__(self, path: str, overwrite: bool, frames: int):
        super().__init__(path, overwrite)
        self.frames = frames

    def files(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes | None]]:
        for shard, t in _by(batches, lambda b: b.column("frame").to_numpy() // self.frames):
            out = io.BytesIO()
            points = t.column("points").combine_chunks().flatten().to_numpy().astype(np.float32).reshape(len(t), -1, CHANNELS)
            np.savez_compressed(out, points=points, meta=np.stack([t.column(c).to_numpy() for c in META], 1).astype(np.float32), frame=t.column("frame").to_numpy().astype(np.int32))
            yield f"shard_{shard:04d}.npz", out.getvalue()
            yield f"shard_{shard:04d}.npz", None


class ShardSource(ds.DataSource):
    """``proposal_shards``: arrays ``points`` (n, 256, 5), ``meta`` (n, 9) and ``frame`` (n) of ``frames`` frames a file."""

    @classmethod
    def name(cls) -> str:
        return "proposal_shards"

    def schema(self) -> str:
        return PROPOSAL

    def reader(self, schema) -> ShardReader:
        return ShardReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> ShardWriter:
        return ShardWriter(self.options["path"], overwrite, int(self.options.get("frames", 500)))


def register(spark: SparkSession) -> None:
    """Makes both sources known to a session, and lets Spark hand filters to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ScanSource)
    spark.dataSource.register(ShardSource)


def write_scans(points: DataFrame, path: str, mode: str = "append") -> None:
    """Scans of points (frame, pid, x, y, z, intensity, semantic, instance), a file a frame in order of pid."""
    register(points.sparkSession)
    kinds = {c.split()[0]: c.split()[1] for c in SCAN.split(", ")}
    rows = points.select(*[F.col(c).cast(k) if c in points.columns else F.lit(None).cast(k).alias(c) for c, k in kinds.items()])
    rows.repartition("frame").sortWithinPartitions("frame", "pid").write.format("scans").mode(mode).save(path)


def write_proposals(proposals: DataFrame, path: str, frames: int = 500, mode: str = "append") -> None:
    """Shards of proposals (frame, points as 256 x 5 numbers, meta columns), ``frames`` frames to a file."""
    register(proposals.sparkSession)
    rows = proposals.select(F.col("frame").cast("int"), F.col("points").cast("array<float>"), *[F.col(c).cast("float") for c in META])
    rows.repartition(F.expr(f"frame div {frames}")).sortWithinPartitions("frame", *META).write.format("proposal_shards").option("frames", frames).mode(mode).save(path)
