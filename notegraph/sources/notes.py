"""Reading notes from files or tables, and checking stored vectors."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notegraph.functions.text import fingerprint, normalise_path, path_not_ignored, unix_newlines

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"


def _as_notes(rows: DataFrame, ignore_prefixes: Iterable[str]) -> DataFrame:
    return (
        rows.where(path_not_ignored(F.col("path"), ignore_prefixes))
        .where(F.col("content").isNotNull())
        .withColumn("content", unix_newlines(F.col("content")))
        .withColumn("content_hash", fingerprint(F.col("content")))
    )


UNREADABLE = "unreadable: gone, damaged or no UTF-8"


def _files(spark: SparkSession, root: str) -> tuple[DataFrame, Column]:
    """The note files below root, and their paths from there."""
    base = re.sub(_SCHEME, "", root).rstrip("/")
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.md")
        .option("ignoreCorruptFiles", True)
        .option("ignoreMissingFiles", True)
        .load(root)
    )
    absolute = F.regexp_replace("path", _SCHEME, "")
    return files, normalise_path(F.substring(absolute, len(base) + 2, 1 << 30)).alias("path")


def list_notes(spark: SparkSession, root: str, ignore_prefixes: Iterable[str] = ()) -> DataFrame:
    """(path, modified_at) of all `**/*.md` below root, readable or not; no file is opened.

    What is gone is decided by this listing, never by what could be read.
    """
    files, path = _files(spark, root)
    rows = files.select(path, F.col("modificationTime").alias("modified_at"))
    return rows.where(path_not_ignored(F.col("path"), ignore_prefixes))


def scan_errors(listing: DataFrame, notes: DataFrame) -> DataFrame:
    """(path, reason) of listed notes that the scan did not give."""
    missed = listing.select("path").join(notes.select("path"), "path", "left_anti")
    return missed.select("path", F.lit(UNREADABLE).alias("reason"))


def scan_notes(spark: SparkSession, root: str, ignore_prefixes: Iterable[str] = ()) -> DataFrame:
    """All `**/*.md` below root as (path, content, modified_at, content_hash).

    Files that cannot be read or are no UTF-8 are left out here; `list_notes` has them, and
    `scan_errors` tells them. Names that start with `_` or `.` are not listed by Spark.
    """
    files, path = _files(spark, root)
    rows = files.select(
        path,
        F.try_validate_utf8(F.col("content").cast("string")).alias("content"),
        F.col("modificationTime").alias("modified_at"),
    )
    return _as_notes(rows, ignore_prefixes)


def notes_from_table(
    table: DataFrame, path: Column, text: Column, modified_at: Column, ignore_prefixes: Iterable[str] = ()
) -> DataFrame:
    """The same columns as scan_notes from any table holding one note per row."""
    rows = table.select(
        normalise_path(path).alias("path"), text.alias("content"), modified_at.alias("modified_at")
    )
    return _as_notes(rows, ignore_prefixes)


def _bad_embedding(dim: int) -> Column:
    return F.col("embedding").isNull() | (F.size("embedding") != dim)


def invalid_embeddings(notes: DataFrame, dim: int) -> DataFrame:
    """Rows whose vector is missing or has another length than dim."""
    return notes.where(_bad_embedding(dim))


def validate_embeddings(notes: DataFrame, dim: int) -> DataFrame:
    """One row of counts: rows, missing vectors, vectors of another length, valid vectors."""
    missing = F.col("embedding").isNull()
    return notes.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(missing).alias("missing"),
        F.count_if(~missing & _bad_embedding(dim)).alias("wrong_length"),
        F.count_if(~_bad_embedding(dim)).alias("valid"),
    )


def spread_small(rows: DataFrame) -> DataFrame:
    """Spread an input of fewer splits than there are cores, such as one small file, over all of them.

    Inputs worth a cluster have more splits than cores and are left as they are.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows
