"""Helpers of the corpus operators: tables, held-out rows, the bytes of a text column in Arrow batches."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from notegraph.operators.materialise import shared_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: As a table for bytes: A-Z in lower case, every other byte as it is.
LOWER_BYTES = np.arange(256, dtype=np.uint8)
LOWER_BYTES[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and no other character changed."""
    return F.translate(text, UPPER, LOWER)


def held_out(doc_id: Column, divisor: int, remainder: int) -> Column:
    """Whether the row is kept from training: crc32 of the id as text leaves that remainder. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % divisor == remainder, F.lit(True))


def shared_checkpoint(frame: DataFrame) -> DataFrame:
    """Written once to the folder that all executors share, so that lost executors do not cost the work again."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows together, and where each row starts and the last ends. Null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def give_back() -> None:
    """Memory that a Python worker has freed goes back to the system, since the worker outlives its task and its stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def sliced(batches: Iterator[pa.RecordBatch], column: str, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The batches cut between rows, so that one piece has about `most` bytes of text at most, or a single row."""
    for batch in batches:
        _, offsets = utf8(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end
    give_back()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of every stretch, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


#: ASCII white space, as bytes.
BLANK_BYTES = np.zeros(256, bool)
BLANK_BYTES[[9, 10, 11, 12, 13, 32]] = True
_random = np.random.Generator(np.random.PCG64(20240601))
_BYTE, _LOW, _HIGH = (_random.integers(1, 2**64, n, dtype=np.uint64) | np.uint64(1) for n in (256, 1 << 16, 1 << 16))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def spans(data: np.ndarray, offsets: np.ndarray, outside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes that are not in the table `outside`, within rows: start, length, row."""
    inside = ~outside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = inside & (edge[:-1] | ~np.r_[False, inside[:-1]])
    ends = inside & (edge[1:] | ~np.r_[inside[1:], False])
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1 - starts, np.searchsorted(offsets, starts, "right") - 1


def hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch of bytes. Some 2^20 bytes are held at a time, or a single longer stretch."""
    out = np.zeros(len(starts), np.uint64)
    ends, at = np.cumsum(lengths), 0
    while at < len(starts):
        until = max(at + 1, int(np.searchsorted(ends, ends[at] - lengths[at] + (1 << 20), "right")))
        out[at:until] = _hashes(data, starts[at:until], lengths[at:until])
        at = until
    return out


def _hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    place = ragged(np.zeros(len(starts), np.int64), lengths)
    value = _BYTE[data[ragged(starts, lengths)]] * _LOW[place & 0xFFFF]
    if len(place) and int(lengths.max()) > 1 << 16:
        far = place >> 16  # 0, and so without effect, in the words that others have
        value *= np.where(far > 0, _HIGH[far & 0xFFFF], np.uint64(1))
    return mixed(np.add.reduceat(value, np.r_[0, np.cumsum(lengths)[:-1]]) + lengths.astype(np.uint64) * _HIGH[0])


def shingles(words: np.ndarray, rows: np.ndarray, n_rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `size` words within rows (of all words where a row has fewer), and their rows."""
    counts = np.bincount(rows, minlength=n_rows)
    first = np.r_[0, np.cumsum(counts)[:-1]]
    runs = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    starts = ragged(first, runs)
    rows = np.repeat(np.arange(n_rows), runs)
    lengths = np.minimum(counts[rows], size)
    total = np.zeros(len(starts), np.uint64)
    for k in range(size):
        used = k < lengths
        total[used] = mixed(total[used] * _LOW[2 * k + 1] + words[starts[used] + k])
    return mixed(total + lengths.astype(np.uint64)), rows


def written(frame: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read back: like a checkpoint, but columnar and compressed."""
    spark = frame.sparkSession
    folder = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    frame.write.parquet(folder)
    return spark.read.schema(frame.schema).parquet(folder)


def grouped(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Rows that come sorted by the keys as one table per key. A key's rows may come in several batches."""
    rest = None
    for batch in batches:
        rows = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
        if not len(rows):
            continue
        new = np.zeros(len(rows) - 1, bool)
        for key in keys:
            column = rows.column(key).combine_chunks()
            new |= pc.fill_null(pc.not_equal(column[1:], column[:-1]), True).to_numpy(zero_copy_only=False)
        cuts = np.r_[0, np.flatnonzero(new) + 1]
        for start, end in zip(cuts[:-1], cuts[1:]):
            yield rows.slice(start, end - start)
        rest = rows.slice(cuts[-1])
    if rest is not None and len(rest):
        yield rest


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """The rows with their places `at` from 0 in that order, written. One count per partition goes to the driver."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = written(ranged.withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    counts = ranged.groupBy(part.alias("part")).count().orderBy("part").collect()
    before, total = [], 0
    for row in counts:
        before.append((row["part"], total))
        total += row["count"]
    offsets = rows.sparkSession.createDataFrame(before, "part bigint, before bigint")
    joined = ranged.withColumn("part", part).join(F.broadcast(offsets), "part")
    return joined.withColumn("at", F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "before", "place")
