"""Table schemas, fixed values and job settings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import types as T

# The table version and the key columns of the notes table.
SCHEMA_VERSION = 7
CHUNK_KEY = ["path", "chunk_index"]

# Rows of one note are spread over join and write keys in blocks of this many chunks, so that a
# note holding a large part of the corpus never meets in one task.
CHUNKS_PER_BLOCK = 1024

NOTES_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("chunk_index", T.IntegerType(), False),
        T.StructField("chunk_start", T.IntegerType()),
        T.StructField("chunk_end", T.IntegerType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("modified_at", T.TimestampType()),
        T.StructField("last_embedded_at", T.TimestampType()),
        T.StructField("last_backlinked_at", T.TimestampType()),
        T.StructField("raw_content", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)

# A change event. event_id orders events of one instant.
EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("path", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("ts", T.TimestampType()),
    ]
)


@dataclass(frozen=True)
class Settings:
    """Parameters of a run. The defaults are fixed values."""

    chunk_size: int = 1000
    embedding_batch_size: int = 50
    dimensions: int = 1024
    force_reembed_all: bool = False
    ignore_prefixes: tuple[str, ...] = (".git/", "ai_logs/", "node_modules/")
    top_k: int = 5
    level: str = "chunk"
    section_mode: str = "full"
    replace_stale: bool = True
    stamp_all_considered: bool = False
    agent: str = "BacklinkerAgent"


# What the live event filter ignores.
EVENT_IGNORE_PREFIXES = (".git/", "ai_logs/", "node_modules/", ".DS_Store")
EVENT_IGNORE_SUFFIXES = (".tmp", "~", ".swp", ".swx", ".crswap")


def build_session(app_name: str = "notegraph", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators are planned for; keyword values override them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
