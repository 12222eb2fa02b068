"""Winnowing: fingerprints from the smallest hashes of runs of text units, in DataFrame functions only.

A unit is a run of at most 16 characters without white space (so a text without blanks has units too). Each run of
GRAM units has a hash; of each WINDOW runs in a row the smallest hash is chosen, the rightmost of equal ones, and
kept with its position. Two texts that share WINDOW + GRAM - 1 units in a row share a fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from notegraph.llm.common import shared_checkpoint

GRAM, WINDOW = 5, 8
LAST_POSITION = (1 << 30) - 1


def fingerprint(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """Chosen runs in order of position, each as one number: the hash in the high 34 bits, and below it the position
    counted downwards, so that the least number of a window is its smallest hash, the rightmost of equal ones.

    Texts with fewer units than a run have one run, of all units; texts without units have none; texts with fewer
    runs than a window have one window.
    """
    text = F.coalesce(text, F.lit(""))
    broken = F.when(text.rlike(r"\S{17}"), F.regexp_replace(text, r"(\S{16})", "$1 ")).otherwise(text)
    units = F.filter(F.split(broken, r"\s+"), lambda w: w != "")

    def starts(a: Column, size: int) -> Column:
        return F.slice(a, 1, F.greatest(F.size(a) - (size - 1), F.least(F.size(a), F.lit(1))))

    # get() takes constant time; slice() in their place would copy the array for every position.
    def runs(u: Column) -> Column:
        def run(w: Column, i: Column) -> Column:
            hashed = F.xxhash64(w, *[F.get(u, i + k) for k in range(1, gram)])
            return hashed.bitwiseAND(F.lit(~LAST_POSITION)) + (F.lit(LAST_POSITION) - i)

        return F.transform(starts(u, gram), run)

    def chosen(h: Column) -> Column:
        def least(x: Column, i: Column) -> Column:
            return F.least(x, *[F.get(h, i + k) for k in range(1, window)])  # null beyond the end, which least() leaves out

        return F.array_distinct(F.transform(starts(h, window), least))

    return _let(_let(units, runs), chosen)


def position(chosen: Column) -> Column:
    return F.lit(LAST_POSITION) - chosen.bitwiseAND(F.lit(LAST_POSITION))


def hash_of(chosen: Column) -> Column:
    return F.shiftright(chosen, 30)


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def as_text(prints: Column) -> Column:
    """pos:hash of every fingerprint, comma-joined."""
    return F.array_join(F.transform(prints, lambda p: F.concat_ws(":", position(p), hash_of(p))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes in proportion to all hashes of two fingerprints; 1 for two without any, 0 for one without any."""

    def hashes(p: Column) -> Column:
        return F.array_distinct(F.transform(p, hash_of))

    both = F.struct(hashes(a).alias("a"), hashes(b).alias("b"))

    def ratio(x: Column) -> Column:
        def share(shared: Column) -> Column:
            total = F.size(x["a"]) + F.size(x["b"]) - shared
            return F.when(total == 0, F.lit(1.0)).otherwise(shared / total)

        return _let(F.size(F.array_intersect(x["a"], x["b"])), share)

    return _let(both, ratio)


def bucketed(documents: DataFrame, rows_per_bucket: int = 64) -> tuple[DataFrame, DataFrame]:
    """doc_id, text, bucket: documents in buckets of neighbouring ids; and the first text of each bucket.

    Order: doc_id (null first), then text. Buckets come from approximate quantiles of the id, so only as many limits
    as there are buckets go to the driver; an id that repeats stays in one bucket.
    """
    spark = documents.sparkSession
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = rows.agg(F.count("*")).first()[0]
    buckets = max(1, min(n // rows_per_bucket, 12 * shuffles))
    points = [k / buckets for k in range(1, buckets)]
    limits = rows.agg(F.percentile_approx("doc_id", points, 50 * buckets)).first()[0] if points and n else None
    limits = sorted(set(limits or []))
    if limits:
        # The number of limits at or below an id, by binary search in a constant array.
        at = F.array(*[F.lit(x) for x in limits])
        steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(limits).bit_length()))])
        below = F.aggregate(steps, F.lit(0), lambda n, step: n + F.when(F.get(at, n + step - 1) <= F.col("doc_id"), step).otherwise(0))
        rows = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), 0).otherwise(below))
    else:
        rows = rows.withColumn("bucket", F.lit(0))
    firsts = rows.groupBy("bucket").agg(F.min(F.struct("doc_id", "text"))["text"].alias("first"))
    return rows, firsts


def neighbours(documents: DataFrame) -> DataFrame:
    """The rows of `bucketed` with `edge`, the text that follows the bucket's last row: the first one of the next
    bucket, and after the last bucket the first one of all. The window without a key sees one row per bucket."""
    rows, firsts = bucketed(documents)
    firsts = shared_checkpoint(firsts)
    order = firsts.select("bucket", F.lead("bucket").over(Window.orderBy("bucket")).alias("next"), F.min("bucket").over(Window.partitionBy()).alias("least"))
    following = order.select("bucket", F.coalesce("next", "least").alias("next"))
    edge = following.join(firsts.select(F.col("bucket").alias("next"), F.col("first").alias("edge")), "next").select("bucket", "edge")
    return rows.join(edge, "bucket")


def edited(text: Column, following: Column) -> Column:
    """The text whose last floor(n / 2) characters are replaced by the first as many of another."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(following, F.lit(1), half))


def fingerprints(documents: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    A null text counts as empty. A lone document follows itself.
    """
    order = Window.partitionBy("bucket").orderBy("doc_id", "text")
    rows = neighbours(documents)
    rows = rows.withColumn("following", F.coalesce(F.lead("text").over(order), "edge"))
    last = F.lead("bucket").over(order).isNull()
    rows = rows.select(
        "doc_id", "text", "bucket", edited(F.col("text"), F.col("following")).alias("changed"), fingerprint(F.col("text"), gram, window).alias("own"),
        F.when(last, fingerprint(F.col("edge"), gram, window)).alias("beyond"),
    )
    rows = rows.withColumn("next_own", F.coalesce("beyond", F.lead("own").over(order)))
    rows = rows.select("*", fingerprint(F.col("changed"), gram, window).alias("other"))
    return rows.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("changed").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("own")).alias("fingerprint"), as_text(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
