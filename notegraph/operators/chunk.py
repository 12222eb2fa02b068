"""Cutting note texts into chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegraph.functions.text import fingerprint


def chunk_notes(notes: DataFrame, size: int = 1000) -> DataFrame:
    """Fixed-size, non-overlapping character chunks of (path, content, modified_at).

    One pass per text and no shuffle: a bounded regular expression cuts the text, so the cost is
    linear in its length (taking substrings by position is quadratic in Spark's UTF-8 strings).
    Empty texts give no chunk.
    """
    if "content_hash" not in notes.columns:
        notes = notes.withColumn("content_hash", fingerprint(F.col("content")))
    pieces = F.regexp_extract_all("content", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    cut = notes.where(F.length("content") > 0).select(
        "path", "content_hash", "modified_at", F.posexplode(pieces).alias("chunk_index", "raw_content")
    )
    start = F.col("chunk_index") * F.lit(size)
    return cut.select(
        "path",
        "chunk_index",
        start.alias("chunk_start"),
        (start + F.length("raw_content")).alias("chunk_end"),
        "content_hash",
        "modified_at",
        "raw_content",
    )
