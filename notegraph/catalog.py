"""The registered queries: every operator over the whole of its test tables.

Times leave as microseconds (-1 for none) and texts as digests, so that results compare by value.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notegraph import stand_ins as s
from notegraph.functions.sections import merge_section
from notegraph.functions.text import link_exists
from notegraph.operators import corpus, events, links, patches, similar
from notegraph.operators.chunk import chunk_notes
from notegraph.operators.embed import hash_embed
from notegraph.operators.materialise import materialise, shared_folder
from notegraph.operators.vector_index import build_index, knn_in_index, similar_to_indexed, update_index
from notegraph.plans.link import link_notes, suggest_links
from notegraph.plans.populate import populate, populate_table
from notegraph.schema import CHUNK_KEY, EVENT_IGNORE_SUFFIXES, Settings
from notegraph.sources import notes as notes_source
from notegraph.sources.notes import validate_embeddings
from notegraph.sources.table import load_notes, save_notes
from notegraph.streaming import events as streams

HOUR = 3600.0
NOW = "2024-06-01 00:00:00"
THRESHOLD = 0.25
SETTINGS = Settings(dimensions=s.DIMENSIONS)
PREFIXES = ("src1/", "src2/en/", "src3/fr/")
SUFFIXES = (*EVENT_IGNORE_SUFFIXES, "9.md")

Query = Callable[[SparkSession, str], DataFrame]


def _us(column: str, name: str) -> Column:
    return F.coalesce(F.unix_micros(column), F.lit(-1)).alias(name)


def _digest(column: str, name: str) -> Column:
    return F.md5(F.col(column)).alias(name)


def _event_rows(rows: DataFrame) -> DataFrame:
    return rows.select("event_id", "path", "kind", _us("ts", "us"))


def _burst_rows(rows: DataFrame) -> DataFrame:
    return rows.select("event_id", "path", "kind", _us("ts", "us"), _us("first_ts", "first_us"), "n_events")


def _chunk_rows(notes: DataFrame) -> DataFrame:
    return notes.select(
        *CHUNK_KEY,
        "chunk_start",
        "chunk_end",
        "content_hash",
        _us("modified_at", "modified_us"),
        _us("last_embedded_at", "embedded_us"),
        _us("last_backlinked_at", "backlinked_us"),
        _digest("raw_content", "chunk_hash"),
    )


# ---- sources, texts, chunks, vectors


def scan_notes(spark, folder):
    notes = s.disk_notes(spark, folder)
    return notes.select("path", _us("modified_at", "modified_us"), "content_hash", F.length("content").alias("n_chars"))


def filter_ignored(spark, folder):
    return events.filter_ignored(s.disk_notes(spark, folder), PREFIXES, SUFFIXES).select("path")


def fingerprint(spark, folder):
    return s.linked_texts(spark, folder).select("path", _digest("content", "content_hash"))


def chunk_fixed(spark, folder):
    chunks = chunk_notes(s.disk_notes(spark, folder), 1000)
    return chunks.select(*CHUNK_KEY, "chunk_start", "chunk_end", "content_hash", _digest("raw_content", "chunk_hash"))


def hash_embedding(spark, folder):
    chunks = hash_embed(chunk_notes(s.disk_notes(spark, folder), 1000), s.DIMENSIONS)
    cells = chunks.select(*CHUNK_KEY, F.posexplode("embedding").alias("bucket", "weight"))
    return cells.where(F.col("weight") != 0).withColumn("weight", F.round(F.col("weight").cast("double"), 6))


def embedding_check(spark, folder):
    vectors = s.table(spark, folder, "embeddings")
    damaged = F.when(F.col("label") == 3, None).when(F.col("label") == 4, F.slice("embedding", 1, 10))
    return validate_embeddings(vectors.select(damaged.otherwise(F.col("embedding")).alias("embedding")), s.DIMENSIONS)


# ---- upkeep of the notes table


def note_metadata(spark, folder):
    metadata = corpus.note_metadata(s.stored_chunks(spark, folder))
    return metadata.select("path", "content_hash", "mixed", _us("embedded_at", "embedded_us"), "last_chunk")


def _changes(spark, folder, force=False):
    metadata = corpus.note_metadata(s.stored_chunks(spark, folder))
    return corpus.detect_changes(s.disk_notes(spark, folder), metadata, force)


def detect_changes(spark, folder):
    return _changes(spark, folder).select("path", "reason")


def detect_changes_forced(spark, folder):
    return _changes(spark, folder, force=True).select("path", "reason")


def _new_chunks(spark, folder, changes):
    """Written out once: the upsert uses them twice."""
    chunks = chunk_notes(corpus.changed_texts(s.disk_notes(spark, folder), changes), 1000)
    embedded = hash_embed(chunks, s.DIMENSIONS)
    return materialise(embedded.withColumn("last_embedded_at", F.lit(NOW).cast("timestamp")))


def upsert_notes(spark, folder):
    changes = materialise(_changes(spark, folder))
    stale = corpus.stale_chunks(changes, 1000)
    return _chunk_rows(corpus.upsert_notes(s.stored_notes(spark, folder), _new_chunks(spark, folder, changes), stale))


def upsert_notes_keeping_stale(spark, folder):
    new = _new_chunks(spark, folder, _changes(spark, folder))
    return _chunk_rows(corpus.upsert_notes(s.stored_notes(spark, folder), new))


def prune_deleted(spark, folder):
    notes = corpus.prune(s.stored_chunks(spark, folder), s.disk_notes(spark, folder))
    return _chunk_rows(notes)


def pruned_paths(spark, folder):
    metadata = corpus.note_metadata(s.stored_chunks(spark, folder))
    return corpus.pruned_paths(metadata, s.disk_notes(spark, folder))


def health_metrics(spark, folder):
    notes = s.stored_notes(spark, folder)
    chunk = F.col("chunk_index")
    damaged = F.when(chunk == 3, None).when(chunk == 4, F.slice("embedding", 1, 10)).otherwise(F.col("embedding"))
    return corpus.health_metrics(notes.withColumn("embedding", damaged))


def sample_paths(spark, folder):
    return corpus.sample_paths(s.stored_chunks(spark, folder))


def notes_needing_backlinks(spark, folder):
    return corpus.notes_needing_backlinks(s.stored_chunks(spark, folder))


def mark_backlinked(spark, folder):
    done = s.disk_notes(spark, folder).where(F.split("path", "/")[0].isin("src6", "src7")).select("path")
    return _chunk_rows(corpus.mark_backlinked(s.stored_chunks(spark, folder), done, NOW))


def _partly_read(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Notes on disk of which some could not be read, and the listing of all."""
    notes = s.disk_notes(spark, folder)
    number = F.regexp_extract("path", r"([0-9]+)\.md$", 1).cast("long")
    return notes.where(F.pmod(number, F.lit(97)) != 5), notes.select("path")


def scan_errors(spark, folder):
    notes, listing = _partly_read(spark, folder)
    return notes_source.scan_errors(listing, notes)


def populate_notes(spark, folder):
    notes, listing = _partly_read(spark, folder)
    result = populate(notes, s.stored_notes(spark, folder), SETTINGS, NOW, listing=listing)
    return _chunk_rows(result.notes)


def populate_stored(spark, folder):
    """The same on a stored table: only the buckets that change are read and written."""
    root = f"{shared_folder(spark)}/notes-{uuid.uuid4().hex}"
    save_notes(s.stored_notes(spark, folder), root, buckets=16)
    notes, listing = _partly_read(spark, folder)
    populate_table(spark, notes, root, SETTINGS, NOW, listing=listing)
    return _chunk_rows(load_notes(spark, root))


# ---- similarity


def _rounded(matches: DataFrame) -> DataFrame:
    """Results are compared at six digits; ranks are not."""
    return matches.withColumn("similarity", F.round("similarity", 6))


def similar_to_note(spark, folder):
    return _rounded(similar.similar_to(s.vector_notes(spark, folder), "n3.md", 5))


def _knn(method: str, level: str = "chunk", **options) -> Query:
    def query(spark, folder):
        notes = s.vector_notes(spark, folder)
        return _rounded(similar.knn_join(similar.note_vectors(notes), notes, 5, level, method, dim=s.DIMENSIONS, **options))

    return query


def _stored_index(spark: SparkSession, folder: str) -> tuple[DataFrame, str]:
    """All vectors, and an index that was built on an earlier state of them and then brought up to date.

    Before, a third of the notes was not there, a third had the opposite vectors, and a third had namesakes that are gone.
    """
    notes = s.vector_notes(spark, folder)
    third = F.pmod(F.xxhash64("path"), F.lit(3))
    before = F.when(third == 1, F.transform("embedding", lambda x: -x)).otherwise(F.col("embedding"))
    gone = notes.where(third == 2).withColumn("path", F.concat(F.lit("gone/"), "path"))
    root = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    build_index(notes.where(third != 0).withColumn("embedding", before).unionByName(gone), root, s.DIMENSIONS, cell_rows=50)
    update_index(notes, notes.where(third != 2).select("path").union(gone.select("path")), root)
    return notes, root


def _knn_stored(level: str) -> Query:
    def query(spark, folder):
        notes, root = _stored_index(spark, folder)
        return _rounded(knn_in_index(similar.note_vectors(notes), root, 5, level, block_rows=100))

    return query


def similar_to_stored(spark, folder):
    return _rounded(similar_to_indexed(*_stored_index(spark, folder), "n3.md", 5))


def note_similarity(spark, folder):
    """Documents to chunks to built-in vectors to the nearest notes of every note."""
    chunks = chunk_notes(s.disk_notes(spark, folder), 1000).repartition(*CHUNK_KEY)
    # The search reads the vectors several times, so they are written out once.
    notes = materialise(hash_embed(chunks, s.DIMENSIONS).select(*CHUNK_KEY, "embedding"))
    return _rounded(similar.knn_join(similar.note_vectors(notes), notes, 5, "note", dim=s.DIMENSIONS))


# ---- links


def link_exists_query(spark, folder):
    pairs = s.neighbour_pairs(spark, folder).join(s.linked_texts(spark, folder), "path")
    return pairs.select("path", "similar_path", link_exists(F.col("content"), F.col("similar_path")).alias("linked"))


def _pairs(spark, folder):
    notes = s.vector_notes(spark, folder)
    matches = _rounded(similar.knn_join(similar.note_vectors(notes), notes, 5, dim=s.DIMENSIONS))
    near = s.neighbour_pairs(spark, folder)
    near = near.withColumn("rank", F.col("rank") + 5)
    return links.candidate_pairs(
        matches.select(near.columns).unionByName(near), s.linked_texts(spark, folder)
    )


def candidate_pairs(spark, folder):
    return _pairs(spark, folder).select(
        "path", "similar_path", "similarity", "rank",
        _digest("note_abstract", "note_digest"), _digest("similar_abstract", "similar_digest"),
    )


def decide_links(spark, folder):
    """Every third rank comes without a reason, so it is an error and not approved."""
    given = links.similarity_decider(THRESHOLD)
    reason = F.when(F.col("rank") % 3 != 0, given.getField("reason"))
    decider = F.struct(given.getField("should_link").alias("should_link"), reason.alias("reason"))
    decided = links.decide_links(_pairs(spark, folder), decider)
    return decided.select("path", "similar_path", "should_link", "reason", "error", "agent_name")


def section_links(spark, folder):
    return links.section_links(s.linked_texts(spark, folder))


def section_links_reference(spark, folder):
    return links.section_links(s.linked_texts(spark, folder), "reference")


def _approved(spark, folder):
    """Every note with the two that follow it, all approved."""
    return s.neighbour_pairs(spark, folder).select(
        "path", "similar_path", "rank", F.lit(True).alias("should_link"), F.lit("near").alias("reason")
    )


def new_section_links(spark, folder):
    new = links.new_section_links(_approved(spark, folder), s.linked_texts(spark, folder))
    return new.select("path", "similar_path", "reason")


def render_bullets(spark, folder):
    return links.render_bullets(_approved(spark, folder))


def _merged(mode: str) -> Query:
    def query(spark, folder):
        texts = s.linked_texts(spark, folder)
        bullets = F.concat(F.lit("- [["), "path", F.lit("]] - why"))
        return texts.select("path", F.md5(merge_section(F.col("content"), bullets, mode)).alias("merged_digest"))

    return query


def _patch_rows(rows: DataFrame) -> DataFrame:
    return rows.select("path", _digest("before", "before_digest"), _digest("after", "after_digest"), "comment", "agent")


def _built(mode: str) -> Query:
    return lambda spark, folder: _patch_rows(
        links.build_patches(s.linked_texts(spark, folder), _approved(spark, folder), mode)
    )


def _resolved(spark, folder):
    return patches.resolve_patches(s.patches(spark, folder), s.linked_texts(spark, folder))


def resolve_patches(spark, folder):
    return _resolved(spark, folder).select(
        "patch_id", "path", "status", "reason", F.coalesce("before_mismatch", F.lit(False)).alias("before_mismatch"),
        _digest("new_content", "new_digest"),
    )


def apply_patches(spark, folder):
    texts = patches.apply_patches(s.linked_texts(spark, folder), _resolved(spark, folder))
    return texts.select("path", _digest("content", "content_hash"))


def patch_log_summary(spark, folder):
    return patches.log_summary(patches.patch_log(_resolved(spark, folder), NOW))


def _link_inputs(spark, folder):
    """All texts, and their own chunks with built-in vectors."""
    texts = s.linked_texts(spark, folder)
    dated = texts.select("*", F.lit(s.START).cast("timestamp").alias("modified_at"), F.md5("content").alias("content_hash"))
    notes = hash_embed(chunk_notes(dated, 1000).repartition(*CHUNK_KEY), s.DIMENSIONS)
    never = F.lit(None).cast("timestamp").alias("last_backlinked_at")
    # The search reads the vectors several times, so they are written out once.
    notes = materialise(notes.select(*CHUNK_KEY, "embedding", "modified_at", never))
    return notes, texts, links.similarity_decider(THRESHOLD)


def suggest(spark, folder):
    notes, texts, decider = _link_inputs(spark, folder)
    return _patch_rows(suggest_links(notes, texts, decider, SETTINGS))


def link_all(spark, folder):
    notes, texts, decider = _link_inputs(spark, folder)
    linked = link_notes(notes, texts, decider, SETTINGS, NOW)
    return linked.notes.select(*CHUNK_KEY, _us("last_backlinked_at", "backlinked_us"))


# ---- events


def event_kinds(spark, folder):
    return _event_rows(events.event_kinds(s.raw_events(spark, folder)))


def route_events(spark, folder):
    routed = events.route_events(s.raw_events(spark, folder))
    return routed.select("event_id", "path", "handler")


def suppress_self_writes(spark, folder):
    return _event_rows(events.suppress_self_writes(s.raw_events(spark, folder), s.agent_writes(spark, folder), HOUR))


def debounce_events(spark, folder):
    return _event_rows(events.debounce_events(s.raw_events(spark, folder), 6 * HOUR, steps_per_bucket=4))


def coalesce_events(spark, folder):
    return _burst_rows(events.coalesce_events(s.raw_events(spark, folder), 6 * HOUR))


def coalesce_two_timer(spark, folder):
    return _burst_rows(events.coalesce_two_timer(s.raw_events(spark, folder), 600.0, 3 * HOUR))


def _clean_events(idle: float | None) -> Query:
    def query(spark, folder):
        raw, writes = s.raw_events(spark, folder), s.agent_writes(spark, folder)
        cleaned = events.clean_events(raw, writes, HOUR, 3 * HOUR if idle is None else HOUR, HOUR, idle_seconds=idle)
        return cleaned.select("event_id", "path", "kind", _us("ts", "us"), "n_events", "handler")

    return query


def _event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The event table read as a stream, shaped like raw_events."""
    schema = s.table(spark, folder, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    return s.file_events(stream)


def _run(stream: DataFrame, finish: Callable[[], None] | None = None) -> DataFrame:
    """Run a stream over what there is now, then over what `finish` adds, and give its output as a table.

    A stream keeps one state store per shuffle partition, so it gets no more of them than cores.
    """
    spark = stream.sparkSession
    target = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", min(int(partitions), spark.sparkContext.defaultParallelism))
    try:
        writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{target}/state")
        writer = writer.outputMode("append").trigger(availableNow=True)
        writer.start(f"{target}/rows").awaitTermination()
        if finish:
            finish()
            writer.start(f"{target}/rows").awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    return spark.read.schema(stream.schema).parquet(f"{target}/rows")


def _ended(spark: SparkSession, folder: str, build: Callable[[Callable[[], DataFrame]], DataFrame]) -> DataFrame:
    """The output of the stream that build(source) makes of the event table, run until every row has left it.

    When the table has been read, a marker far behind the last event moves the watermark past all of them. It is a
    write, so that it also ends a stream of writes, and is filtered out of the output.
    """
    marks, path = f"{shared_folder(spark)}/marks-{uuid.uuid4().hex}", f"end-{uuid.uuid4().hex}.md"
    raw = s.raw_events(spark, folder)
    raw.limit(0).write.parquet(marks)

    def source() -> DataFrame:
        return _event_stream(spark, folder).unionByName(spark.readStream.schema(raw.schema).parquet(marks))

    def finish() -> None:
        last = F.coalesce(F.max("ts"), F.lit(NOW).cast("timestamp")) + F.expr("INTERVAL 365 DAYS")
        marker = raw.agg(last.alias("ts")).select(
            F.lit(0).cast(raw.schema["event_id"].dataType).alias("event_id"), F.lit(path).alias("path"),
            F.lit("moved").alias("kind"), "ts",
        )
        marker.write.mode("append").parquet(marks)

    return _run(build(source), finish).where(F.col("path") != path)


def debounce_stream(spark, folder):
    return _event_rows(_ended(spark, folder, lambda source: streams.debounce_stream(source(), 6 * HOUR, ordered=True)))


def coalesce_stream(spark, folder):
    return _burst_rows(_ended(spark, folder, lambda source: streams.coalesce_stream(source(), 6 * HOUR)))


def coalesce_two_timer_stream(spark, folder):
    return _burst_rows(_ended(spark, folder, lambda source: streams.coalesce_two_timer_stream(source(), 600, 3 * HOUR)))


def suppress_stream(spark, folder):
    def build(source):
        return streams.suppress_stream(source(), source().where(F.col("kind") == "moved"), HOUR)

    return _event_rows(_ended(spark, folder, build))


def _clean_stream(idle: float | None) -> Query:
    def query(spark, folder):
        def build(source):
            writes = source().where(F.col("kind") == "moved")
            return streams.clean_stream(
                source(), HOUR, 3 * HOUR if idle is None else HOUR, writes=writes, self_write_seconds=HOUR, idle_seconds=idle
            )

        return _ended(spark, folder, build).select("event_id", "path", "kind", _us("ts", "us"), "n_events", "handler")

    return query


QUERIES: dict[str, Query] = {
    "scan_notes": scan_notes,
    "scan_errors": scan_errors,
    "filter_ignored": filter_ignored,
    "fingerprint": fingerprint,
    "chunk_fixed": chunk_fixed,
    "hash_embed": hash_embedding,
    "embedding_check": embedding_check,
    "note_metadata": note_metadata,
    "detect_changes": detect_changes,
    "detect_changes_forced": detect_changes_forced,
    "upsert_notes": upsert_notes,
    "upsert_notes_keeping_stale": upsert_notes_keeping_stale,
    "prune_deleted": prune_deleted,
    "pruned_paths": pruned_paths,
    "health_metrics": health_metrics,
    "sample_paths": sample_paths,
    "notes_needing_backlinks": notes_needing_backlinks,
    "mark_backlinked": mark_backlinked,
    "populate": populate_notes,
    "populate_stored": populate_stored,
    "similar_to_note": similar_to_note,
    "knn_exact": _knn("auto"),
    "knn_small_queries": _knn("small_queries"),
    "similar_notes_small_queries": _knn("small_queries", "note"),
    "knn_blocked": _knn("blocked", block_rows=300),
    "knn_indexed": _knn("indexed", block_rows=100, pivots=8),
    "similar_notes_distinct": _knn("auto", "note"),
    "similar_notes_indexed": _knn("indexed", "note", block_rows=100, pivots=8),
    "similar_to_stored": similar_to_stored,
    "knn_stored": _knn_stored("chunk"),
    "similar_notes_stored": _knn_stored("note"),
    "note_similarity": note_similarity,
    "link_exists": link_exists_query,
    "candidate_pairs": candidate_pairs,
    "decide_links": decide_links,
    "section_links": section_links,
    "section_links_reference": section_links_reference,
    "new_section_links": new_section_links,
    "render_bullets": render_bullets,
    "merge_section": _merged("full"),
    "merge_section_reference": _merged("reference"),
    "build_patches": _built("full"),
    "build_patches_reference": _built("reference"),
    "resolve_patches": resolve_patches,
    "apply_patches": apply_patches,
    "patch_log_summary": patch_log_summary,
    "suggest_links": suggest,
    "link_notes": link_all,
    "event_kinds": event_kinds,
    "route_events": route_events,
    "suppress_self_writes": suppress_self_writes,
    "debounce_events": debounce_events,
    "coalesce_events": coalesce_events,
    "coalesce_two_timer": coalesce_two_timer,
    "clean_events": _clean_events(None),
    "clean_events_flush": _clean_events(3 * HOUR),
    "debounce_stream": debounce_stream,
    "coalesce_stream": coalesce_stream,
    "suppress_stream": suppress_stream,
    "coalesce_two_timer_stream": coalesce_two_timer_stream,
    "clean_stream": _clean_stream(None),
    "clean_stream_flush": _clean_stream(3 * HOUR),
    # Earlier names of the same.
    "coalesce_stream_ended": coalesce_stream,
    "suppress_stream_ended": suppress_stream,
    "clean_stream_ended": _clean_stream(None),
}
