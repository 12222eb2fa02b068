"""Domain tables derived from the given test tables. Each uses every row of its source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notegraph.operators.chunk import chunk_notes
from notegraph.operators.embed import hash_embed
from notegraph.schema import NOTES_SCHEMA
from notegraph.sources.notes import notes_from_table, spread_small

START = "2024-01-01 00:00:00"
DIMENSIONS = 64


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    # The tables hold zoneless UTC times, so the session has to read and compare them as UTC.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of texts; work on each text is dear, so a small file is spread over all cores."""
    return spread_small(table(spark, folder, name))


def _minutes(number: str):
    return F.timestamp_seconds(F.unix_timestamp(F.lit(START)) + F.col(number) * 60)


def disk_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Notes on disk: every document, one minute apart."""
    documents = texts(spark, folder, "documents")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md")))
    return notes_from_table(documents, path, F.col("text"), _minutes("doc_id"))


def stored_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """An earlier state of the notes table, without vectors.

    Per source of the document: src0 was not there, src1 had another text, src2 has no embedding
    time, src3 was embedded before its change, src4 was twice as long, in src5 the first chunk is of
    another version; the rest is up to date. All pages were notes that are gone now.
    """
    source = F.split("path", "/")[0]
    minute = F.expr("INTERVAL 1 MINUTE")
    text = (
        F.when(source == "src1", F.concat("content", F.lit(" (old)")))
        .when(source == "src4", F.concat("content", "content"))
        .otherwise(F.col("content"))
    )
    disk = disk_notes(spark, folder).where(source != "src0")
    pages = texts(spark, folder, "pages")
    gone = pages.select(
        F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".md")).alias("path"),
        F.col("html").alias("content"),
        _minutes("page_id").alias("modified_at"),
    )
    before = disk.select("path", text.alias("content"), "modified_at").unionByName(gone)
    embedded = (
        F.when(source == "src2", F.lit(None))
        .when(source == "src3", F.col("modified_at") - minute)
        .otherwise(F.col("modified_at") + minute)
    )
    language = F.split("path", "/")[1]
    linked = F.when(language == "en", F.col("modified_at") + minute).when(
        language == "fr", F.col("modified_at") - minute
    )
    other_version = (source == "src5") & (F.col("chunk_index") == 0)
    return (
        chunk_notes(before, 1000)
        .withColumn("content_hash", F.when(other_version, F.lit("old")).otherwise(F.col("content_hash")))
        .withColumn("last_embedded_at", embedded.cast(T.TimestampType()))
        .withColumn("last_backlinked_at", linked.cast(T.TimestampType()))
        .select(*[c for c in NOTES_SCHEMA.fieldNames() if c != "embedding"])
    )


def stored_notes(spark: SparkSession, folder: str) -> DataFrame:
    """stored_chunks with built-in vectors."""
    return hash_embed(stored_chunks(spark, folder), DIMENSIONS).select(*NOTES_SCHEMA.fieldNames())


def vector_notes(spark: SparkSession, folder: str) -> DataFrame:
    """The given vectors as notes of two chunks each. Every 25th vector has a near copy in a note of its own, whose
    path comes first and which is a little further from, or nearer to, any query."""
    vectors = table(spark, folder, "embeddings")
    note = F.floor(F.col("vec_id") / 2).cast("long")
    close = F.transform("embedding", lambda x, i: F.when(i == 0, x + 0.0001).otherwise(x).cast("float"))
    own = vectors.select(
        F.concat(F.lit("n"), note.cast("string"), F.lit(".md")).alias("path"),
        (F.col("vec_id") - note * 2).cast("int").alias("chunk_index"),
        "embedding",
    )
    copies = vectors.where(F.pmod("vec_id", F.lit(25)) == 0).select(
        F.concat(F.lit("c"), F.col("vec_id").cast("string"), F.lit(".md")).alias("path"),
        F.lit(0).alias("chunk_index"),
        close.alias("embedding"),
    )
    return own.unionByName(copies)


def file_events(events: DataFrame) -> DataFrame:
    """File events from rows of the events table: one path per user, the kind from the event type."""
    suffix = F.when(F.pmod("user_id", F.lit(7)) == 0, ".txt").otherwise(".md")
    kind = (
        F.when(F.col("event_type") == "click", "modified")
        .when(F.col("event_type") == "view", "opened")
        .when(F.col("event_type") == "signup", "created")
        .when(F.col("event_type") == "error", "deleted")
        .otherwise("moved")
    )
    return events.select(
        "event_id",
        F.concat(F.lit("u"), F.col("user_id").cast("string"), suffix).alias("path"),
        kind.alias("kind"),
        F.col("ts").cast(T.TimestampType()).alias("ts"),
    )


def raw_events(spark: SparkSession, folder: str) -> DataFrame:
    return file_events(table(spark, folder, "events"))


def agent_writes(spark: SparkSession, folder: str) -> DataFrame:
    """Writes by the linker itself: the purchase events."""
    return raw_events(spark, folder).where(F.col("kind") == "moved").select("path", "ts")


def linked_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Current texts of the vector notes: every document, with all variants of a link section."""
    documents = texts(spark, folder, "documents")
    later = lambda n: (F.col("doc_id") + n).cast("string")
    variant = F.pmod("doc_id", F.lit(7))
    content = F.concat(
        "text",
        F.when(variant == 0, "")
        .when(variant == 1, "\n")
        .when(variant == 2, "\n\n")
        .when(variant == 3, "\n\n## Backlinks\n")
        .when(variant == 4, F.concat(F.lit("\n\n## Backlinks\n- [[n"), later(1), F.lit("]] - seen\n")))
        # The next heading directly below: its bullets are none of the section's.
        .when(variant == 6, F.concat(F.lit("\n## Backlinks\n## Next\n- [[n"), later(1), F.lit(".md]] - other\nz\n")))
        .otherwise(
            F.concat(
                F.lit("\n## backlinks\n- [[n"), later(1), F.lit(".md]] - seen\n-  [[n"), later(2),
                F.lit(".md]] - seen\n## Next\nmore\n"),
            )
        ),
    )
    return documents.select(F.concat(F.lit("n"), later(0), F.lit(".md")).alias("path"), content.alias("content"))


def neighbour_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Each note with the two that follow it."""
    documents = table(spark, folder, "documents").select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("n"))
    name = lambda c: F.concat(F.lit("n"), c.cast("string"), F.lit(".md"))
    return documents.select(
        name(F.col("doc_id")).alias("path"),
        name(F.col("doc_id") + F.col("n")).alias("similar_path"),
        F.lit(0.9).alias("similarity"),
        F.col("n").alias("rank"),
    )


def patches(spark: SparkSession, folder: str) -> DataFrame:
    """One patch per turn of the conversations, of all kinds; most notes get several."""
    now = linked_texts(spark, folder).withColumnRenamed("content", "current")
    case = F.pmod("conv_id", F.lit(11))
    name = F.concat(F.lit("n"), F.col("conv_id").cast("string"), F.lit(".md"))
    path = F.when(case.isin(5, 8, 9, 10), F.concat(F.lit("new/"), name)).otherwise(name)
    turns = table(spark, folder, "conversations").withColumn("path", path).join(now, "path", "left")
    action = (
        F.when(case == 3, "APPEND")
        .when(case.isin(4, 5), "CREATE")
        .when(case.isin(6, 8), "DELETE")
        .when(case.isin(7, 9), "RENAME")
    )
    return turns.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("patch_id"),
        "path",
        F.timestamp_seconds(F.unix_timestamp(F.lit(START)) + F.col("turn") * 60).alias("ts"),
        action.alias("action"),
        F.when(case == 1, "old").otherwise(F.col("current")).alias("before"),
        F.when(case == 2, F.col("current")).otherwise(F.concat(F.coalesce("current", F.lit("")), "text")).alias("after"),
        F.col("text").alias("content"),
        F.when(F.col("role") == "user", F.md5(F.lit("x"))).alias("seen_hash"),
    )
