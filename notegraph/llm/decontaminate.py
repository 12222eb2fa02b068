"""Benchmark decontamination: a prefix-filtered join of item windows with documents, in DataFrame functions only.

A window is a set of short shingles that must all occur. So the prefix that a join needs is one shingle: the rarest
one in the documents. A document position whose shingle equals it is a candidate; the offset of the shingle in the
window tells where the window would start, which must lie inside the document, and then the words are compared.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from notegraph.llm.common import lower_ascii, shared_checkpoint

WINDOW, SHINGLE = 10, 3
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows that one block of the join broadcasts; a window takes some 400 bytes. More windows make more blocks.
WINDOWS_PER_BLOCK = 50_000


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case; none for null."""
    return F.coalesce(F.filter(F.split(lower_ascii(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != ""), F.array().cast("array<string>"))


def _shingle(array: str, at: Column, size: int) -> Column:
    """A hash of `size` words from a place on; null beyond the end."""
    parts = [F.get(array, at + k) for k in range(size)]
    return F.when(parts[-1].isNotNull(), F.xxhash64(F.lit(size), *parts))


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Different windows: window_id, window (words), items (their item_ids as strings, no doubles)."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w"))
    start = F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0))))
    cut = items.where(F.size("w") > 0).select("item", "w", start.alias("s")).select("item", F.slice("w", F.col("s") + 1, size).alias("window"))
    cut = cut.groupBy("window").agg(F.collect_set("item").alias("items"))
    return cut.select(F.xxhash64("window").alias("window_id"), "window", "items")


def prefixes(documents: DataFrame, found: DataFrame, blocks: int, shingle: int) -> DataFrame:
    """For each window the shingle that is rarest in the documents (ties: smaller hash, then first place): window_id,
    window, offset, key."""
    k = F.least(F.size("window"), F.lit(shingle))
    places = found.select("window_id", "window", k.alias("k"), F.explode(F.sequence(F.lit(0), F.size("window") - k)).alias("offset"))
    key = F.coalesce(*[F.when(F.col("k") == n, _shingle("window", F.col("offset"), n)) for n in range(1, shingle + 1)])
    places = places.select("window_id", "window", "k", "offset", key.alias("key"))
    sizes = [r["k"] for r in places.select("k").distinct().collect()]
    wanted = places.select("key").distinct()
    seen = None
    for block in range(blocks):
        part = wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block)
        counted = positions(documents, sizes).join(F.broadcast(part), "key").groupBy("key").agg(F.count("*").alias("n"))
        seen = counted if seen is None else seen.unionByName(counted)
    ranked = places.join(seen, "key", "left").select("*", F.coalesce("n", F.lit(0)).alias("seen"))
    order = Window.partitionBy("window_id").orderBy("seen", "key", "offset")
    return ranked.withColumn("r", F.row_number().over(order)).where("r = 1").select("window_id", "window", "offset", "key")


def positions(documents: DataFrame, sizes: list[int]) -> DataFrame:
    """One row for each position of each document and shingle size: row columns, w, pos, key (null beyond the end).
    A document without words has one row."""
    rows = documents.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)))).alias("pos"))
    if len(sizes) == 1:
        return rows.select("*", _shingle("w", F.col("pos"), sizes[0]).alias("key"))
    keys = F.array(*[_shingle("w", F.col("pos"), n) for n in sizes]) if sizes else F.array(F.lit(None).cast("bigint"))
    return rows.select("*", F.explode(keys).alias("key"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW, shingle: int = SHINGLE, per_block: int = WINDOWS_PER_BLOCK) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and `copy`, a hash of the text.

    A word is hit if it lies inside an occurrence of a window of any item. Rows that are the same in doc_id and text
    count as one document whose result each of them gets; a null text has no words; an item without words no window;
    an empty benchmark leaves every document clean. Items with the same id count as one.
    """
    found = shared_checkpoint(windows(benchmark, size))
    n = found.count()
    blocks = max(1, math.ceil(n / per_block))
    keyed = documents.select("doc_id", F.xxhash64("text").alias("copy"), words(F.col("text")).alias("w"))
    first = shared_checkpoint(prefixes(keyed, found, blocks, shingle))
    sizes = [r["k"] for r in first.select(F.least(F.size("window"), F.lit(shingle)).alias("k")).distinct().collect()]
    hits = None
    for block in range(blocks):
        part = first if blocks == 1 else first.where(F.pmod("window_id", F.lit(blocks)) == block)
        rows = positions(keyed, sizes)
        start = F.col("pos") - F.col("offset")
        fits = (F.col("key") == F.col("prefix")) & (start >= 0) & (start + F.size("window") <= F.size("w"))
        fits &= F.slice("w", F.greatest(start, F.lit(0)) + 1, F.size("window")) == F.col("window")
        joined = rows.join(F.broadcast(part.withColumnRenamed("key", "prefix")), fits, "left")
        # The first position stands for the document, whether or not it is hit.
        joined = joined.where(F.col("window").isNotNull() | (F.col("pos") == 0)).select(
            "doc_id", "copy", F.size("w").alias("n_words"), F.when(F.col("window").isNotNull(), start).alias("start"),
            F.size("window").alias("n"), "window_id",
        )
        hits = joined if hits is None else hits.unionByName(joined)
    span = F.when(F.col("start").isNotNull(), F.struct("start", "n"))
    documents_hit = hits.groupBy("doc_id", "copy").agg(
        F.max("n_words").cast("long").alias("n_words"), F.collect_set(span).alias("spans"), F.collect_set("window_id").alias("ids")
    )
    # Covered words: spans in order, each adds what lies behind the furthest end so far.
    zero = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("end"))

    def cover(a: Column, s: Column) -> Column:
        end = (s["start"] + s["n"]).cast("long")
        return F.struct(
            (a["hit"] + F.greatest(F.lit(0).cast("long"), end - F.greatest(a["end"], s["start"].cast("long")))).alias("hit"),
            F.greatest(a["end"], end).alias("end"),
        )

    hit = F.aggregate(F.array_sort("spans"), zero, cover)["hit"]
    covered = shared_checkpoint(documents_hit.select("doc_id", "copy", "n_words", hit.alias("n_hit"), "ids"))
    named = covered.select("doc_id", "copy", F.explode("ids").alias("window_id")).join(found.select("window_id", "items"), "window_id")
    named = named.select("doc_id", "copy", F.explode("items").alias("item")).groupBy("doc_id", "copy").agg(F.collect_set("item").alias("items"))
    c, d = covered.drop("ids").alias("c"), named.alias("d")
    same = F.col("c.doc_id").eqNullSafe(F.col("d.doc_id")) & F.col("c.copy").eqNullSafe(F.col("d.copy"))
    items = F.coalesce(F.sort_array("items"), F.array().cast("array<string>"))
    return c.join(d, same, "left").select(
        "c.doc_id", "c.copy", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
