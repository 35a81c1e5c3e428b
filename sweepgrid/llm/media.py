"""Media columns: payloads kept as images in archives, read by a Spark data source.

Each payload is stored losslessly as an 8-bit greyscale PNG of 64 samples a row, packed with
others into ZIP archives (members are stored, the PNG itself is compressed). The data source
``archive_media`` plans partitions as byte ranges of archives: of those that a manifest names, by
its stretches (a Parquet table of archive, begin, upto and the part of the archive's directory that
lists the members between), or of all in a folder, by their sizes. A reader opens its archive once,
takes the members whose local header begins in its range and streams them as Arrow record batches
bounded in bytes. It reads each member by its offset with retries of its own, for which alone the
archive is opened anew, so one bad member never costs the others.

Defined cases: a null payload text counts as empty; payloads are padded with zero bytes to a
positive multiple of 64 and the length before that is kept in the image (chunk ``noTe``); equal
payloads give equal images; rows with null or repeated ``doc_id`` are members of their own. A
member that stays unreadable after all retries is a row with ``error`` set and ``media`` null. An
empty folder or table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import time
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from sweepgrid.llm.shared import shared_folder, table

UNIT = 64
_PNG = b"\x89PNG\r\n\x1a\n"
MEMBER = "archive STRING, name STRING, doc_id BIGINT, offset BIGINT, media BINARY, attempts INT, error STRING"
_ARROW = pa.schema([("archive", pa.string()), ("name", pa.string()), ("doc_id", pa.int64()), ("offset", pa.int64()), ("media", pa.binary()), ("attempts", pa.int32()), ("error", pa.string())])


def padded(data: bytes, unit: int = UNIT) -> bytes:
    """``data`` with zero bytes up to a positive multiple of ``unit``."""
    return data + bytes(max(unit, -(-len(data) // unit) * unit) - len(data))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes, length: int, level: int = 1) -> bytes:
    """A greyscale PNG whose samples are the payload, 64 a row, with the unpadded length noted."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    lines = np.zeros((len(rows), UNIT + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", UNIT, len(rows), 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"noTe", struct.pack(">Q", length)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> tuple[np.ndarray, int]:
    """(samples as rows of 64, unpadded length) of an image from ``encode_png``; checksums are checked."""
    if media[:8] != _PNG:
        raise ValueError("not a PNG image")
    at, parts, found = 8, [], {}
    while at < len(media):
        size, kind = struct.unpack_from(">I4s", media, at)
        data = media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + data) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise ValueError(f"chunk {kind!r} is damaged")
        parts.append(data) if kind == b"IDAT" else found.setdefault(kind, data)
        at += 12 + size
    width, height, depth, colour = struct.unpack_from(">IIBB", found[b"IHDR"])
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, width + 1)
    if depth != 8 or colour != 0 or width != UNIT or lines[:, 0].any():
        raise ValueError("not an image of this kind")
    return lines[:, 1:], struct.unpack(">Q", found[b"noTe"])[0]


def feature(samples: np.ndarray) -> str:
    """Shape, mean, standard deviation, and the share of samples in each quarter of the range."""
    flat = samples.reshape(-1)
    counts = np.bincount(flat >> 6, minlength=4)
    mean = float(flat.mean())
    spread = float(np.sqrt(max(0.0, float(np.square(flat, dtype=np.float64).mean()) - mean * mean)))
    return f"{samples.shape[1]}x{samples.shape[0]};mean={mean:.4f};std={spread:.4f};" + ",".join(f"{c / len(flat):.4f}" for c in counts)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


class ArchiveWriter:
    """A ZIP archive of stored members, with 64-bit sizes where needed."""

    def __init__(self, uri: str):
        self.uri = uri
        fs, path = open_fs(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.out, self.at, self.entries = fs.open_output_stream(path, compression=None), 0, []
        #: (begin, end, begin and end in the directory) of stretches of members, once closed.
        self.stretches: list[tuple[int, int, int, int]] = []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, data: bytes) -> None:
        raw, crc = name.encode(), zlib.crc32(data)
        self.entries.append((raw, crc, len(data), self.at))
        self._put(struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0x800, 0, 0, 33, crc, len(data), len(data), len(raw), 0) + raw + data)

    def close(self, range_bytes: int = 64 << 20) -> None:
        """Write the directory; a stretch of members, each of about ``range_bytes``, is told with its part of the directory."""
        begin, cuts = self.at, []
        for raw, crc, size, at in self.entries:
            if not cuts or at - cuts[-1][0] >= range_bytes:
                cuts.append((at, self.at))
            extra = struct.pack("<HHQ", 1, 8, at)
            self._put(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0x800, 0, 0, 33, crc, size, size, len(raw), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + raw + extra)
        self.stretches = [(at, to, part, part_end) for (at, part), (to, part_end) in zip(cuts, [*cuts[1:], (begin, self.at)])]
        size, n, where = self.at - begin, len(self.entries), self.at
        self._put(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, size, begin))
        self._put(struct.pack("<IIQI", 0x07064B50, 0, where, 1))
        self._put(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), min(size, 0xFFFFFFFF), 0xFFFFFFFF, 0))
        self.out.close()


def directory(file: pa.NativeFile) -> Iterator[tuple[str, int, int, int]]:
    """(name, crc, size, offset of the local header) of each member, from the archive's directory."""
    end = file.size()
    tail_at = max(0, end - 22 - 0xFFFF)
    tail = file.read_at(end - tail_at, tail_at)
    at = tail.rfind(struct.pack("<I", 0x06054B50))
    if at < 0:
        raise ValueError("no archive directory")
    n, size, begin = struct.unpack_from("<HII", tail, at + 10)
    locator = tail.rfind(struct.pack("<I", 0x07064B50), 0, at)
    if locator >= 0 and (0xFFFF in (n,) or 0xFFFFFFFF in (size, begin)):
        where = struct.unpack_from("<Q", tail, locator + 8)[0]
        n, size, begin = struct.unpack_from("<QQQ", file.read_at(56, where), 32)
    yield from members_of(file.read_at(size, begin))


def members_of(data: bytes) -> Iterator[tuple[str, int, int, int]]:
    """(name, crc, size, offset of the local header) of each member that a part of a directory lists."""
    at = 0
    while at < len(data):
        crc, _, plain, name_size, extra_size, note_size = struct.unpack_from("<IIIHHH", data, at + 16)
        offset = struct.unpack_from("<I", data, at + 42)[0]
        name = data[at + 46 : at + 46 + name_size].decode()
        if offset == 0xFFFFFFFF:
            offset = struct.unpack_from("<Q", data, at + 46 + name_size + 4)[0]
        yield name, crc, plain, offset
        at += 46 + name_size + extra_size + note_size


class ByteRange(InputPartition):
    """The members of ``archive`` whose local header begins in [begin, end); ``listed`` is where its directory lists them, if known."""

    def __init__(self, archive: str, begin: int, end: int, listed: tuple[int, int] | None = None):
        self.archive, self.begin, self.end, self.listed = archive, begin, end, listed


class Handle:
    """An archive opened once for a range of its members, and anew after a failure only."""

    def __init__(self, fs: pafs.FileSystem, archive: str):
        self.fs, self.archive, self.file = fs, archive, None

    def read_at(self, size: int, offset: int) -> bytes:
        if self.file is None:
            self.file = self.fs.open_input_file(self.archive)
        return self.file.read_at(size, offset)

    def close(self) -> None:
        if self.file is not None:
            file, self.file = self.file, None
            file.close()


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.manifest = options["path"], options.get("manifest")
        self.range_bytes = int(options.get("range_bytes", 64 << 20))
        self.batch_bytes = int(options.get("batch_bytes", 4 << 20))
        self.retries = int(options.get("retries", 3))

    def partitions(self) -> list[ByteRange]:
        """A stretch of the manifest, or ``range_bytes`` of a file of the folder, for each range: bounded by bytes, not members."""
        if self.manifest is not None:
            fs, path = open_fs(self.manifest)
            rows = pq.read_table(path, filesystem=fs, columns=["archive", "begin", "upto", "listed", "listed_end"])
            out = [ByteRange(open_fs(a)[1], begin, end, (x, y)) for a, begin, end, x, y in sorted(zip(*(c.to_pylist() for c in rows.columns)))]
            return out or [ByteRange("", 0, 0)]
        fs, path = open_fs(self.folder)
        info = fs.get_file_info(pafs.FileSelector(path, recursive=True, allow_not_found=True))
        found = [(x.path, x.size) for x in info if x.type == pafs.FileType.File and x.path.endswith(".zip")]
        out = [ByteRange(name, at, min(at + self.range_bytes, size)) for name, size in sorted(found) for at in range(0, size, self.range_bytes)]
        return out or [ByteRange("", 0, 0)]

    def member(self, file: Handle, offset: int, size: int, crc: int) -> tuple[bytes | None, int, str | None]:
        """(bytes, attempts, error) of one member: after a failed attempt the archive is opened anew at the offset."""
        error = None
        for attempt in range(1, self.retries + 2):
            try:
                head = file.read_at(30, offset)
                magic, name_size, extra_size = struct.unpack_from("<I", head)[0], *struct.unpack_from("<HH", head, 26)
                if magic != 0x04034B50:
                    raise ValueError("no member begins here")
                data = file.read_at(size, offset + 30 + name_size + extra_size)
                if len(data) != size or zlib.crc32(data) != crc:
                    raise ValueError("member is damaged")
                return data, attempt, None
            except (OSError, ValueError, struct.error) as e:
                error = f"{type(e).__name__}: {e}"
                file.close()
                time.sleep(min(1.0, 0.05 * 2 ** (attempt - 1)) if attempt <= self.retries else 0)
        return None, self.retries + 1, error

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        file = Handle(open_fs(self.folder)[0], partition.archive)
        try:
            yield from self.members(file, partition)
        finally:
            file.close()

    def listed(self, file: Handle, partition: ByteRange) -> list[tuple[int, str, int, int]]:
        """(offset, name, crc, size) of the range's members, from its part of the directory where that is known."""
        if partition.listed is None:
            with file.fs.open_input_file(partition.archive) as whole:
                found = list(directory(whole))
        else:
            begin, end = partition.listed
            found = members_of(file.read_at(end - begin, begin))
        return sorted((o, n, c, s) for n, c, s, o in found if partition.begin <= o < partition.end)

    def members(self, file: Handle, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for offset, name, crc, length in self.listed(file, partition):
            data, attempts, error = self.member(file, offset, length, crc)
            key = name.rpartition("/")[2].removesuffix(".png")
            rows.append((partition.archive, name, None if key == "null" else int(key), offset, data, attempts, error))
            size += length
            if size >= self.batch_bytes:
                yield self._batch(rows)
                rows, size = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


class ArchiveMedia(DataSource):
    """``spark.read.format("archive_media").load(folder)``; options manifest, range_bytes, batch_bytes, retries."""

    @classmethod
    def name(cls) -> str:
        return "archive_media"

    def schema(self) -> str:
        return MEMBER

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


def write_archives(docs: DataFrame, folder: str, archive_bytes: int = 256 << 20, range_bytes: int = 64 << 20) -> str:
    """Encode every row's text and write archives; the path of the manifest (archive, begin, upto, listed, listed_end):
    for each stretch of about ``range_bytes`` of an archive, where its members are and where the directory lists them.

    A repeated task writes archives of its own below ``attempts``; the manifest names those that count.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt, n, seq, writer = uuid.uuid4().hex, 0, 0, None

        def closed() -> pa.RecordBatch:
            writer.close(range_bytes)
            columns = zip(*((writer.uri, *x) for x in writer.stretches))
            return pa.RecordBatch.from_pydict(dict(zip(("archive", "begin", "upto", "listed", "listed_end"), map(list, columns))))

        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for i in range(batch.num_rows):
                key, text = ids[i].as_py(), texts[i].as_py()
                data = (text or "").encode()
                if writer is None:
                    writer = ArchiveWriter(f"{folder}/{attempt}-{n:05d}.zip")
                    n += 1
                writer.add(f"{seq}/{'null' if key is None else key}.png", encode_png(padded(data), len(data)))
                seq += 1
                if writer.at >= archive_bytes:
                    yield closed()
                    writer = None
        if writer is not None:
            yield closed()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    path = f"{folder}-manifest"
    rows.mapInArrow(write, "archive STRING, begin BIGINT, upto BIGINT, listed BIGINT, listed_end BIGINT").write.parquet(path)
    return path


def read_archives(spark: SparkSession, folder: str, manifest: str | None = None, **options) -> DataFrame:
    """All members below ``folder``; with a manifest, only the archives that it names are planned, by its stretches."""
    spark.dataSource.register(ArchiveMedia)
    given = options if manifest is None else options | {"manifest": manifest}
    return spark.read.format("archive_media").options(**{k: str(v) for k, v in given.items()}).load(folder)


def described(members: DataFrame) -> DataFrame:
    """Decode each member and compute its digests and feature. A member with an error raises."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {k: [] for k in ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for i in range(batch.num_rows):
                media, error = batch.column("media")[i].as_py(), batch.column("error")[i].as_py()
                if error is not None:
                    raise OSError(f"{batch.column('name')[i].as_py()}: {error}")
                samples, length = decode_png(media)
                payload = samples.tobytes()
                row = (batch.column("doc_id")[i].as_py(), length, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples))
                for k, v in zip(out, row):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.string() if k in ("payload_sha256", "media_sha256", "feature") else pa.int64()) for k, v in out.items()], names=list(out))

    schema = "doc_id BIGINT, n_bytes BIGINT, payload_bytes BIGINT, payload_sha256 STRING, tail_crc32 BIGINT, media_bytes BIGINT, media_sha256 STRING, feature STRING"
    return members.select("doc_id", "name", "media", "error").mapInArrow(work, schema)


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "media")
    manifest = write_archives(table(spark, sf_dir, "documents"), folder)
    return described(read_archives(spark, folder, manifest))
