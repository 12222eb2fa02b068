"""Bringing the notes table up to date with the notes on disk."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notegraph.operators.chunk import chunk_notes
from notegraph.operators.corpus import (
    changed_texts,
    detect_changes,
    health_metrics,
    inventory,
    note_blocks,
    note_metadata,
    pruned_paths,
    remove_notes,
    stale_chunks,
    upsert_notes,
)
from notegraph.operators.embed import Embedder, embed_chunks, hash_embed
from notegraph.operators.materialise import materialise, materialise_columns
from notegraph.operators.patches import append_log, error_log
from notegraph.operators.sized import BROADCAST_ROWS, if_small, is_small
from notegraph.operators.vector_index import build_index, update_index
from notegraph.schema import CHUNK_KEY, NOTES_SCHEMA, Settings
from notegraph.sources.notes import list_notes, scan_errors, scan_notes, validate_embeddings
from notegraph.sources.table import BUCKETS, load_notes, save_notes, touched_buckets


@dataclass(frozen=True)
class Populated:
    """The new notes table, the change set, the chunks whose embedding failed, and listed notes that could not be
    read (path, reason); these keep what is stored of them."""

    notes: DataFrame
    changes: DataFrame
    failed: DataFrame
    unread: DataFrame


@dataclass(frozen=True)
class Report:
    """What populate_table did and left: the change set, unread notes, and after the save the counts of missing and
    wrong vectors and the size of the table (one row each)."""

    changes: DataFrame
    unread: DataFrame
    check: DataFrame
    metrics: DataFrame


def embed_changes(texts: DataFrame, settings: Settings, embedder: Embedder | None, now) -> DataFrame:
    """Chunks of changed notes with vectors, written out once: they are dear and used twice.

    Chunks are put in place by key before they get their vectors, which spreads the model calls
    evenly and moves the rows while they are still small.
    """
    chunks = chunk_notes(texts, settings.chunk_size).repartition(*CHUNK_KEY)
    if embedder is None:
        embedded = hash_embed(chunks, settings.dimensions).withColumn("error", F.lit(None).cast("string"))
    else:
        embedded = embed_chunks(chunks, embedder, settings.embedding_batch_size, settings.dimensions)
    return materialise_columns(embedded.withColumn("last_embedded_at", F.lit(now).cast(T.TimestampType())))


@dataclass(frozen=True)
class _Work:
    """What a run has to do: changed notes and notes that are gone, and what it could not read, all written out."""

    changes: DataFrame
    gone: DataFrame
    unread: DataFrame


def _find_work(disk: DataFrame, notes: DataFrame, settings: Settings, listing: DataFrame | None) -> _Work:
    """The texts are gone through once, for an inventory of short rows; the changed ones are read again."""
    found = materialise(inventory(disk))
    metadata = materialise(note_metadata(notes))
    present = (found if listing is None else listing).select("path")
    if settings.replace_stale:
        # A note that became empty has no chunks left; its old ones go when stale chunks go.
        present = present.join(found.where("n_chars = 0"), "path", "left_anti")
    return _Work(
        materialise(detect_changes(found, metadata, settings.force_reembed_all)),
        materialise(pruned_paths(metadata, present)),
        materialise(scan_errors(found if listing is None else listing, found)),
    )


def _do_work(
    work: _Work, disk: DataFrame, notes: DataFrame, settings: Settings, now, embedder: Embedder | None
) -> Populated:
    new = embed_changes(changed_texts(disk, if_small(work.changes)), settings, embedder, now)
    stale = stale_chunks(work.changes, settings.chunk_size) if settings.replace_stale else None
    keys = new.count() + (stale.count() if stale is not None else 0)
    few = keys <= BROADCAST_ROWS
    if few or is_small(work.gone):
        upserted = upsert_notes(remove_notes(notes, work.gone, few=is_small(work.gone)), new, stale, few=few)
    else:
        upserted = upsert_notes(notes, new, stale, removed=work.gone)
    return Populated(
        upserted,
        work.changes,
        new.where(F.col("error").isNotNull()),
        work.unread,
    )


def populate(
    disk: DataFrame,
    notes: DataFrame,
    settings: Settings,
    now,
    embedder: Embedder | None = None,
    listing: DataFrame | None = None,
) -> Populated:
    """Detect, chunk, embed, upsert and prune; `notes` are all current rows.

    `listing` has the paths of all notes that exist, also of those that `disk` has no text of; without it, `disk`
    is taken to be complete.
    """
    return _do_work(_find_work(disk, notes, settings, listing), disk, notes, settings, now, embedder)


def populate_table(
    spark: SparkSession,
    disk: DataFrame | str,
    root: str,
    settings: Settings,
    now,
    embedder: Embedder | None = None,
    log_folder: str | None = None,
    listing: DataFrame | None = None,
    buckets: int = BUCKETS,
    index_root: str | None = None,
) -> Report:
    """populate() on the stored table, reading and writing only the buckets that change.

    `disk` is a table of notes, or a folder, which is then listed and scanned. What is gone is decided by the listing, so
    that a note which cannot be read keeps what is stored of it; a table is taken to be complete unless `listing` is given.

    `index_root` names the vector index beside the table (`operators.vector_index`): it is built with the first save and
    then brought up to date in the cells of changed and pruned notes.

    What changed is found from four narrow columns. `buckets` is for a table's first save: choose it so that a bucket
    holds some 256 MB to 1 GB, because a changed note rewrites its bucket.
    """
    if isinstance(disk, str):
        listing = list_notes(spark, disk, settings.ignore_prefixes) if listing is None else listing
        disk = scan_notes(spark, disk, settings.ignore_prefixes)
    work = _find_work(disk, load_notes(spark, root), settings, listing)
    last_new = F.ceil(F.col("n_chars") / F.lit(settings.chunk_size)).cast("int") - 1
    changed = work.changes.select("path", F.greatest("last_chunk", last_new).alias("last_chunk"))
    only = touched_buckets(spark, root, note_blocks(changed.unionByName(work.gone)))

    done = _do_work(work, disk, load_notes(spark, root, only), settings, now, embedder)
    save_notes(done.notes.select(*NOTES_SCHEMA.fieldNames()), root, only, buckets)
    if index_root is not None and only is None:
        build_index(load_notes(spark, root), index_root, settings.dimensions)
    elif index_root is not None:
        update_index(load_notes(spark, root, only), work.changes.select("path").union(work.gone.select("path")), index_root)
    if log_folder is not None:
        append_log(error_log(done.failed, "EMBED", now), log_folder)
        append_log(error_log(work.unread.withColumnRenamed("reason", "error"), "SCAN", now), log_folder)
    stored = load_notes(spark, root)
    return Report(work.changes, work.unread, validate_embeddings(stored, settings.dimensions), health_metrics(stored))
