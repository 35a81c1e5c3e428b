"""WARC archives as seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each holding whole records, with a seek table
in a skippable frame at the end (the public seekable format: magic 0x184D2A5E, then per frame its
compressed and plain size, footer magic 0x8F92EAB1). A record index maps record identifiers to
(bundle, frame, offset in the frame's plain bytes, length), so one record costs one frame.

Tasks write under a name of their own attempt, so a repeated attempt never touches the bundles of
another; only bundles named by the index rows that Spark accepted are read.

Defined cases: a null html is an empty payload; records of payloads below ``least_bytes`` are
always responses; of equal larger payloads that with the largest page_id is the response and the
others revisit it (rows that repeat that page_id and payload are responses too); a null page_id is
written as ``null`` and revisits any row with an id and the same payload. An empty table gives an
empty result. Further columns are left alone.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sweepgrid.llm.shared import materialise, shared_folder, table

_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Plain bytes after which a frame is closed, and compressed bytes after which a bundle is.
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 256 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "page_id BIGINT, bundle STRING, frame_at BIGINT, frame_bytes BIGINT, offset BIGINT, length BIGINT"
READ = "page_id BIGINT, record_type STRING, refers_to BIGINT, read_bytes BIGINT, read_digest STRING, header_bytes BIGINT, header_digest STRING, html BINARY"


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def record(page_id: int | None, url: str | None, kind: str, payload: bytes, digest: str, length: int, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit has no payload but names the digest and length of the full one."""
    body = b"" if kind == "revisit" else payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {length}",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{'null' if refers_to is None else refers_to}>"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and content of one record."""
    end = data.index(b"\r\n\r\n")
    lines = data[:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = dict(x.split(": ", 1) for x in lines[1:])
    size = int(head["Content-Length"])
    body = data[end + 4 : end + 4 + size]
    if len(body) != size or data[end + 4 + size :] != b"\r\n\r\n":
        raise ValueError(f"record {head.get('WARC-Record-ID')} is cut")
    return head, body


class BundleWriter:
    """Writes records into frames; ``close`` appends the seek table and returns the index rows."""

    def __init__(self, uri: str, level: int = 3, frame_bytes: int = FRAME_BYTES):
        self.uri, self.frame_bytes = uri, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level, write_content_size=True)
        fs, path = open_fs(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = fs.open_output_stream(path, compression=None)
        self.at, self.frames, self.rows = 0, [], []
        self.plain, self.pending, self.size = [], [], 0

    def add(self, key: int | None, data: bytes) -> None:
        self.pending.append((key, self.size, len(data)))
        self.plain.append(data)
        self.size += len(data)
        if self.size >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        if not self.plain:
            return
        packed = self.zstd.compress(b"".join(self.plain))
        self.out.write(packed)
        self.rows += [(k, self.uri, self.at, len(packed), o, n) for k, o, n in self.pending]
        self.frames.append((len(packed), self.size))
        self.at += len(packed)
        self.plain, self.pending, self.size = [], [], 0

    def close(self) -> list[tuple]:
        self.flush()
        body = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, _SEEKABLE)
        self.out.write(struct.pack("<II", _SKIPPABLE, len(body)) + body)
        self.out.close()
        return self.rows


def seek_table(uri: str) -> list[tuple[int, int, int, int]]:
    """(offset, compressed size, plain offset, plain size) of each frame, read from the bundle's end."""
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as f:
        size = f.size()
        n, flags, magic = struct.unpack("<IBI", f.read_at(9, size - 9))
        if magic != _SEEKABLE:
            raise ValueError(f"{uri}: no seek table")
        entry = 12 if flags & 0x80 else 8
        raw = f.read_at(n * entry, size - 9 - n * entry)
    out, at, plain = [], 0, 0
    for i in range(n):
        c, p = struct.unpack_from("<II", raw, i * entry)
        out.append((at, c, plain, p))
        at, plain = at + c, plain + p
    return out


def read_record(bundle: str, frame_at: int, frame_bytes: int, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record by its index entry."""
    fs, path = open_fs(bundle)
    with fs.open_input_file(path) as f:
        packed = f.read_at(frame_bytes, frame_at)
    return parse(zstandard.ZstdDecompressor().decompress(packed)[offset : offset + length])


def roles(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """(page_id, url, payload, digest, length, kind, refers_to): which records are responses.

    A first pass reads digests only, and keeps those of larger payloads that occur more than once,
    with partial aggregation. It names the rows that become revisits, by page_id and digest; a second
    pass tells each page by that key, so pages of a common payload stay dealt over all tasks.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    base = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    base = base.select("*", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("bigint").alias("length"))
    keys = materialise(base.select("page_id", "digest", "length").where(F.col("length") >= least_bytes), "warc-digests")
    best = keys.groupBy("digest", "length").agg(F.max("page_id").alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1 AND best IS NOT NULL").drop("n")
    told = keys.distinct().join(best, ["digest", "length"]).where(~F.col("page_id").eqNullSafe(F.col("best")))
    told = materialise(told.select(F.col("page_id").alias("of"), F.col("digest").alias("same"), F.col("best").alias("refers_to")), "warc-revisits")
    met = base.join(told, F.col("page_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("same")), "left")
    return met.select("page_id", "url", "payload", "digest", "length", F.when(F.col("refers_to").isNotNull(), "revisit").otherwise("response").alias("kind"), "refers_to")


def write_bundles(pages: DataFrame, folder: str, least_bytes: int = 1000, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write one or more bundles per partition; the record index, as a written table."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("bundle", pa.string()), ("frame_at", pa.int64()), ("frame_bytes", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])
        attempt, n, writer = uuid.uuid4().hex, 0, None

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*writer.close()), schema)], schema=schema)

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "kind", "payload", "digest", "length", "refers_to")]
            for i in range(batch.num_rows):
                page_id, url, kind, payload, digest, length, refers_to = (c[i].as_py() for c in columns)
                if writer is None:
                    writer = BundleWriter(f"{folder}/{attempt}-{n:05d}.warc.zst", frame_bytes=frame_bytes)
                    n += 1
                writer.add(page_id, record(page_id, url, kind, payload, digest, length, refers_to))
                if writer.at >= bundle_bytes:
                    yield closed()
                    writer = None
        if writer is not None:
            yield closed()

    return materialise(roles(pages, least_bytes).mapInArrow(write, INDEX), "warc-index")


def read_bundles(index: DataFrame, payloads: bool = False) -> DataFrame:
    """Every record of the index, read through its frame; payload digests are computed from what was read."""
    frames = index.groupBy("bundle", "frame_at", "frame_bytes").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("records"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("read_bytes", pa.int64()), ("read_digest", pa.string()), ("header_bytes", pa.int64()), ("header_digest", pa.string()), ("html", pa.binary())])
        zstd, name, file = zstandard.ZstdDecompressor(), None, None
        number = lambda x: None if x == "<urn:page:null>" or x is None else int(x[10:-1])
        for batch in batches:
            for i in range(batch.num_rows):
                bundle, at, size, records = (batch.column(k)[i].as_py() for k in range(4))
                if bundle != name:
                    fs, path = open_fs(bundle)
                    name, file = bundle, fs.open_input_file(path)
                plain = zstd.decompress(file.read_at(size, at))
                rows = []
                for r in records:
                    head, body = parse(plain[r["offset"] : r["offset"] + r["length"]])
                    rows.append((
                        number(head["WARC-Record-ID"]), head["WARC-Type"], number(head.get("WARC-Refers-To")), len(body), hashlib.sha1(body).hexdigest(),
                        int(head["WARC-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:"), body if payloads else None,
                    ))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    return frames.repartition("bundle", "frame_at").mapInArrow(read, READ)


def resolved(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: revisits take what their response held.

    Only responses that some revisit names are looked up. The look-up is a sort-merge join, which
    cuts a response with very many revisits into several tasks.
    """
    revisit = F.col("record_type") == "revisit"
    records = materialise(records.drop("html"), "warc-read")
    named = records.where(revisit).select(F.col("refers_to").alias("to_id"), F.col("header_digest").alias("to_digest")).distinct()
    held = records.where(~revisit).select(F.col("page_id").alias("to_id"), F.col("read_digest").alias("to_digest"), F.col("read_bytes").alias("to_bytes")).join(named, ["to_id", "to_digest"], "left_semi").groupBy("to_id", "to_digest").agg(F.first("to_bytes").alias("to_bytes"))
    joined = records.where(revisit).join(held.hint("merge"), (F.col("refers_to") == F.col("to_id")) & (F.col("header_digest") == F.col("to_digest")), "left")
    checked = lambda found: F.when(found.isNull() | (found != F.col("header_digest")), F.raise_error(F.lit("payload digest differs"))).otherwise(found).alias("payload_digest")
    responses = records.where(~revisit).select("page_id", F.col("read_bytes").alias("payload_bytes"), checked(F.col("read_digest")), "record_type", "refers_to")
    return responses.unionByName(joined.select("page_id", F.col("to_bytes").alias("payload_bytes"), checked(F.col("to_digest")), "record_type", "refers_to"))


def op4_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_bundles(table(spark, sf_dir, "pages"), shared_folder(spark, "warc"))
    return resolved(read_bundles(index))


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT d, b, max(page_id) AS best FROM p WHERE b >= 1000 GROUP BY d, b)
SELECT p.page_id, p.b AS payload_bytes, p.d AS payload_digest,
       CASE WHEN m.best IS NULL OR m.best = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN m.best <> p.page_id THEN m.best END AS refers_to
FROM p LEFT JOIN m ON p.d = m.d AND p.b = m.b
"""
