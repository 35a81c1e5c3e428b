"""Reading tables, the shared work folder, and sizes of inputs."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(names: list[str], *wanted: str) -> list[str]:
    """Names like the wanted ones that no column of ``names`` has, in any case of letters."""
    taken, out = {n.lower() for n in names}, []
    for w in wanted:
        while w.lower() in taken:
            w += "_"
        taken.add(w.lower())
        out.append(w)
    return out


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only where that setting is absent and Spark runs in one process, as in local tests, a temporary
    folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/sweepgrid-shared"
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again, which cuts its lineage.

    The files of the shuffles behind it are dropped as soon as the table is written.
    """
    spark = df.sparkSession
    path = shared_folder(spark, what)
    with shuffle_files_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffle_files_dropped(spark: SparkSession):
    """Actions inside leave no shuffle files behind."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def text_bytes(df: DataFrame) -> int:
    """Bytes of all texts."""
    return int(df.selectExpr("coalesce(sum(octet_length(text)), 0L) AS n").first()["n"])


def give_back() -> None:
    """Memory that was freed goes back to the system, as far as the allocators can tell it apart."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:  # glibc only
        trim(0)


def handing_back(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` for mapInArrow, after which the worker gives back what it freed: workers of earlier
    tasks wait beside those of later ones, and count in the executor's memory until they are ended."""

    def then(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        give_back()

    return then
