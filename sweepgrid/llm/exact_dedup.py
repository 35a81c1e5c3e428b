"""Exact deduplication against a persistent digest index.

The index is a table with one row per distinct normalised text, bucketed and sorted by its
SHA-256 digest. New data comes in batches by ranges of the id, so that what is stored first has the
smallest one. Each batch is reduced to one row per digest before any shuffle of it, anti-joined with
the index by sort-merge on the buckets, and what is new is appended. Every append adds a file to each
bucket; ``compact`` writes them as one again. An index that no name was given for lies in the folder that
driver and executors share, asks for no warehouse, and is dropped once its answers are written. A named one keeps with each digest the run that brought it, and digests of the run
itself count as new: a run that died between its appends and its answer can be repeated, and gives the
answer it would have given. A run is named by the caller or by a fingerprint of its ids and digests.

Defined cases: a null text counts as empty; texts are equal when identical after replacing each
run of ``[\\x20\\x09-\\x0D]`` by one space; of equal texts the row with the smallest ``doc_id``
stays (a null ``doc_id`` comes after all others, and of rows with equal ``doc_id`` and text one
row stays, in an order by the other columns); an empty table gives an empty result. Only
``doc_id`` and ``text`` are read, so further columns of any name do no harm.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sweepgrid.llm.shared import materialise, shared_folder, table, unused
from sweepgrid.sources.store import Store

#: Characters that count as white space, as a character class.
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
INDEX_COLUMNS = "digest STRING, keep_id BIGINT, run STRING"


def normalised(text: str = "text") -> F.Column:
    """The text whose identity counts."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE_RUN, " ")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest) of every row."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.sha2(F.encode(normalised(), "UTF-8"), 256).alias("digest"))


class DigestIndex:
    """A digest index kept as a bucketed table in the session's catalogue."""

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int = 64):
        self.spark, self.buckets = spark, buckets
        self.name, self.folder = name or f"digest_index_{uuid.uuid4().hex}", None if name else shared_folder(spark, "digest-index")
        home = spark.conf.get("spark.sql.warehouse.dir", "").removeprefix("file:").rstrip("/")
        if name and not spark.sparkContext.master.startswith("local") and os.path.normpath(home or "spark-warehouse") in ("spark-warehouse", os.path.join(os.getcwd(), "spark-warehouse")):
            raise ValueError("spark.sql.warehouse.dir must name a folder that driver and executors share")

    def _exists(self, suffix: str = "") -> bool:
        return self.spark.catalog.tableExists(self.name + suffix)

    def _rename(self, old: str, new: str) -> None:
        self.spark.sql(f"ALTER TABLE {self.name}{old} RENAME TO {self.name}{new}")

    def _recover(self) -> None:
        """Finish a ``compact`` that died between its steps: the new table is whole once the old one has been renamed."""
        if self._exists("_replaced"):
            if not self._exists():
                self._rename("_compacted" if self._exists("_compacted") else "_replaced", "")
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_replaced")

    def table(self) -> DataFrame | None:
        self._recover()
        return self.spark.table(self.name) if self._exists() else None

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """The rows of each bucket in one partition, by Spark's own number of the bucket, so that each
        bucket gets one file: with tasks times buckets of them, listing takes the driver's memory."""
        return rows.repartitionById(self.buckets, F.pmod(F.hash("digest"), F.lit(self.buckets)))

    def _save(self, rows: DataFrame, suffix: str = "") -> None:
        """Append to a table, which the first rows make; without a name it lies in the index's own folder."""
        out = self._dealt(rows).write.bucketBy(self.buckets, "digest").sortBy("digest").mode("append")
        if self.folder and not self._exists(suffix):
            out = out.option("path", f"{self.folder}/{uuid.uuid4().hex}")
        out.saveAsTable(self.name + suffix)

    def add(self, hashed: DataFrame, run: str = "") -> None:
        """Append the digests of ``hashed`` (doc_id, digest) that the index does not hold.

        A digest that it holds keeps its keep_id: what was stored first stays.
        """
        new = hashed.groupBy("digest").agg(F.min("doc_id").alias("keep_id")).withColumn("run", F.lit(run))
        known = self.table()
        if known is not None:
            new = new.join(known.select("digest").hint("merge"), "digest", "left_anti")
        self._save(new)

    def add_in_batches(self, hashed: DataFrame, batches: int = 2, run: str = "") -> None:
        """Append ``hashed`` by ranges of doc_id, smallest first and null last.

        The bounds are approximate quantiles, so batches are about equal whatever the ids are.
        """
        bounds = hashed.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000).alias("b")).first()["b"] or []
        low = F.lit(True)
        for b in sorted(set(bounds)):
            self.add(hashed.where(low & (F.col("doc_id") <= b)), run)
            low = F.col("doc_id") > b
        self.add(hashed.where(F.coalesce(low, F.lit(True)) | F.col("doc_id").isNull()), run)

    def compact(self) -> None:
        """One sorted file per bucket again. The old table goes last, so one of both is whole at any time."""
        if self.table() is None:
            return
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_compacted")
        self._save(self.table(), "_compacted")
        self._rename("", "_replaced")
        self._rename("_compacted", "")
        self._recover()

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        if self.folder:  # a table with a path of its own leaves its files
            Store(self.spark, self.folder).remove("")


def run_of(hashed: DataFrame) -> str:
    """A fingerprint of the rows (doc_id, digest), in any order."""
    one = F.xxhash64("doc_id", "digest")
    row = hashed.agg(F.count(F.lit(1)), F.bit_xor(one), F.sum((one % 1_000_000_007).cast("decimal(38,0)"))).first()
    return "-".join(str(v) for v in row)


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, batches: int = 2, run: str | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    ``group_size`` counts the rows of this input that have the text. With an index that already
    holds a text, keep_id is the id stored there and no row of this input is kept for it, but for
    texts that this same ``run`` has brought.
    """
    hashed = materialise(digests(docs), "digests")
    target = index or DigestIndex(docs.sparkSession)
    run = run or (run_of(hashed) if index is not None else "")
    older = target.table()
    if older is not None:
        older = materialise(older.where(F.col("run") != run).select("digest", F.lit(False).alias("fresh")), "digest-index")
    target.add_in_batches(hashed, batches, run)
    sizes = hashed.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    known = target.table().select("digest", "keep_id").hint("merge").join(sizes, "digest")
    known = known.join(older, "digest", "left") if older is not None else known.withColumn("fresh", F.lit(None).cast("boolean"))
    known = materialise(known.withColumn("fresh", F.coalesce("fresh", F.lit(True))), "digest-groups")
    if index is None:
        target.drop()
    return hashed.join(known, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("fresh") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def keep_first(docs: DataFrame, index: DigestIndex | None = None, run: str | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one per normalised text that the index
    did not hold before this ``run``.

    Rows that also share the ``doc_id`` are told apart by their place in the input.
    """
    names = docs.columns
    row, digest = unused(names, "row", "digest")
    tagged = materialise(docs.withColumn(row, F.monotonically_increasing_id()).withColumn(digest, F.sha2(F.encode(normalised(), "UTF-8"), 256)), "tagged")
    keys = tagged.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(f"`{row}`").alias("place"), F.col(f"`{digest}`").alias("digest"))
    target = index or DigestIndex(docs.sparkSession)
    run = run or (run_of(keys) if index is not None else "")
    older = target.table()
    older = materialise(older.where(F.col("run") != run).select("digest"), "digest-index") if older is not None else None
    target.add_in_batches(keys.select("doc_id", "digest"), run=run)
    first = keys.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place")).alias("best"))
    stored = target.table().select("digest", "keep_id").hint("merge")
    kept = first.join(stored, "digest").where(F.col("best.doc_id").eqNullSafe(F.col("keep_id")))
    kept = kept if older is None else kept.join(older, "digest", "left_anti")
    kept = materialise(kept.select(F.col("best.place").alias("place")), "kept-rows")
    if index is None:
        target.drop()
    return tagged.join(kept.withColumnRenamed("place", row).hint("merge"), row, "left_semi").select(*[F.col(f"`{c}`") for c in names])


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS d FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY d) AS keep_id, count(*) OVER (PARTITION BY d) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY d) AS kept, d AS text_sha256
FROM t
"""
