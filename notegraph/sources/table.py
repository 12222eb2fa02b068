"""The stored notes table: append-only folders and a small table that says which ones are current.

Rows are partitioned by a hash of (path, block of chunks). A save writes the buckets it touches to a
folder of its own, then appends their numbers to `versions`; that append is what makes them current. A
save that fails on the way leaves the table as it was, and readers of the old folders go on.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from notegraph.operators.corpus import chunk_block
from notegraph.schema import CHUNK_KEY, NOTES_SCHEMA, SCHEMA_VERSION

BUCKETS = 256
_VERSIONS = "schema_version int, generation int, save string, bucket int, buckets int, filled boolean"


def _bucket(buckets: int, block: Column) -> Column:
    return F.pmod(F.xxhash64("path", block), F.lit(buckets)).cast("int")


def _current(spark: SparkSession, root: str, version: int) -> tuple[int, dict[int, Row]]:
    """(number of buckets, bucket -> its latest save): one short record per bucket."""
    try:
        versions = spark.read.schema(_VERSIONS).parquet(f"{root}/versions").where(F.col("schema_version") >= version)
        latest = F.max(F.struct("generation", "save", "filled")).alias("latest")
        rows = versions.groupBy("bucket", "buckets").agg(latest).collect()
    except AnalysisException:  # nothing saved yet
        rows = []
    return (rows[0].buckets if rows else 0), {r.bucket: r.latest for r in rows}


def load_notes(
    spark: SparkSession, root: str, only: list[int] | None = None, version: int = SCHEMA_VERSION
) -> DataFrame:
    """The current rows, or an empty table when none were saved under this schema version or a later one.

    Only the current folders are listed; `only` limits the read to some buckets.
    """
    _, current = _current(spark, root, version)
    folders = [
        f"{root}/notes/{latest.save}/bucket={bucket}"
        for bucket, latest in sorted(current.items())
        if latest.filled and (only is None or bucket in only)
    ]
    if not folders:
        return spark.createDataFrame([], NOTES_SCHEMA)
    return spark.read.schema(NOTES_SCHEMA).parquet(*folders)


def touched_buckets(spark: SparkSession, root: str, blocks: DataFrame) -> list[int] | None:
    """Buckets that hold the given (path, block) keys; None when the table is still empty."""
    buckets, current = _current(spark, root, SCHEMA_VERSION)
    if not current:
        return None
    return sorted(r.bucket for r in blocks.select(_bucket(buckets, F.col("block")).alias("bucket")).distinct().collect())


def remove_superseded(spark: SparkSession, root: str) -> int:
    """Delete the folders of buckets that newer saves replaced; returns how many. Not while old ones are being read."""
    _, current = _current(spark, root, SCHEMA_VERSION)
    hadoop = spark._jvm.org.apache.hadoop.fs
    saves = hadoop.Path(f"{root}/notes")
    files = saves.getFileSystem(spark._jsc.hadoopConfiguration())
    removed = 0
    for folder in files.globStatus(hadoop.Path(saves, "*/bucket=*")) or []:
        path = folder.getPath()
        latest = current.get(int(path.getName().removeprefix("bucket=")))
        if latest is not None and latest.save != path.getParent().getName():
            removed += files.delete(path, True)
    return removed


def save_notes(notes: DataFrame, root: str, only: list[int] | None = None, buckets: int = BUCKETS) -> None:
    """Make `notes` the current rows of the table, or of the buckets in `only`."""
    if only == []:
        return
    spark = notes.sparkSession
    known, current = _current(spark, root, SCHEMA_VERSION)
    buckets = known or buckets
    written = list(range(buckets)) if only is None else only
    generation = max((latest.generation for latest in current.values()), default=0) + 1
    save = uuid.uuid4().hex
    rows = notes.withColumn("bucket", _bucket(buckets, chunk_block(F.col("chunk_index")))).where(
        F.col("bucket").isin(written)
    )
    # Rebalancing lets Spark split large buckets over tasks and put small ones together. In order of
    # path, the columns that change detection reads shrink to little, and paths can be skipped to.
    rows = rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", *CHUNK_KEY)
    rows.write.partitionBy("bucket").parquet(f"{root}/notes/{save}")
    try:
        saved = spark.read.parquet(f"{root}/notes/{save}")
        filled = {r.bucket for r in saved.select("bucket").distinct().collect()}
    except AnalysisException:  # no row was left
        filled = set()
    # One writer at a time: a save that another one overtook must not be mixed with it.
    if any(latest.generation >= generation for latest in _current(spark, root, SCHEMA_VERSION)[1].values()):
        raise RuntimeError(f"another save to {root} was made meanwhile; run this one again")
    marks = [(SCHEMA_VERSION, generation, save, b, buckets, b in filled) for b in written]
    spark.createDataFrame(marks, _VERSIONS).coalesce(1).write.mode("append").parquet(f"{root}/versions")
