"""Product codes of vectors: each part's nearest codebook entry, found through memoised grid cells.

Components become integers floor(1024 x), so distances, means and ties are exact. To find the nearest entry of a part,
its coarse cell (a box of CELL units a side) is looked up. The first part in a cell finds the cell's candidates: entries
whose least distance to the box is not above the smallest of all largest distances, so that no other entry can be
nearest anywhere in the box. They are cached, and each part of the cell is then compared exactly with them alone. A cache
belongs to one task and one codebook, and starts anew when it holds MEMO cells.

Codebooks are trained by Spark: every task adds up its parts per entry and reports one row per used entry; Spark sums
these rows, and only the sums, bounded by the codebook's size, go to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from notegraph.llm.common import ragged, written
from notegraph.operators.sized import if_small

SCALE = 1024
PARTS, ENTRIES, ROUNDS = 4, 256, 4
CELL = 32
MEMO = 1 << 16
SLICE = 4096  # parts worked on at a time
#: Integers beyond this would overflow squared distances of 64 bits.
LARGEST = 1 << 26


def finite(embedding: Column) -> Column:
    return embedding.isNotNull() & ~F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def integers(column: pa.Array, length: int) -> np.ndarray:
    values = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    if len(values) and np.abs(values).max() > LARGEST:
        raise ValueError(f"components beyond {LARGEST // SCALE} in absolute value have no exact distance in 64 bits")
    return values.astype(np.int32).reshape(len(column), length)


def edges(length: int, parts: int = PARTS) -> np.ndarray:
    """Where parts start and the last ends; equal parts, or the first ones longer by one where that is not possible."""
    return np.r_[0, np.cumsum([length // parts + (k < length % parts) for k in range(parts)])]


class Grid:
    """Nearest entries of a codebook by cells whose candidates are remembered."""

    def __init__(self, book: np.ndarray, cell: int = CELL, memo: int = MEMO):
        self.book, self.cell, self.most = book.astype(np.int64), cell, memo
        self.memo: dict[bytes, np.ndarray] = {}

    def candidates(self, cells: np.ndarray) -> list[np.ndarray]:
        """For each cell (a row of box numbers) the entries that no other one dominates across its box."""
        least = np.zeros((len(cells), len(self.book)), np.int64)
        most = np.zeros_like(least)
        for k in range(cells.shape[1]):
            boxes, place = np.unique(cells[:, k], return_inverse=True)
            low = boxes[:, None].astype(np.int64) * self.cell
            high = low + self.cell - 1
            entry = self.book[:, k]
            least += (np.maximum(np.maximum(low - entry, entry - high), 0) ** 2)[place]
            most += (np.maximum(np.abs(entry - low), np.abs(entry - high)) ** 2)[place]
        kept = least <= most.min(1, keepdims=True)
        numbers = np.nonzero(kept)[1]
        return np.split(numbers, np.cumsum(kept.sum(1))[:-1])

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of each row; of equally near entries the first."""
        out = [self._nearest(rows[k : k + SLICE]) for k in range(0, len(rows), SLICE)]
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*out))

    def _nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cells, member = np.unique(np.floor_divide(rows, self.cell), axis=0, return_inverse=True)
        member = member.ravel()
        keys = [c.tobytes() for c in cells]
        unknown = [k for k, key in enumerate(keys) if key not in self.memo]
        if len(self.memo) + len(unknown) > self.most:
            self.memo.clear()
            unknown = list(range(len(keys)))
        if unknown:
            self.memo.update(zip((keys[k] for k in unknown), self.candidates(cells[unknown])))
        lists = [self.memo[key] for key in keys]
        sizes = np.array([len(x) for x in lists])
        starts = np.r_[0, np.cumsum(sizes)[:-1]]
        numbers = np.concatenate(lists)
        # Every row beside each candidate of its cell, a bounded number of rows at a time.
        best, distance = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        per_row = sizes[member]
        ends = np.cumsum(per_row)
        at = 0
        while at < len(rows):
            until = max(at + 1, int(np.searchsorted(ends, ends[at] - per_row[at] + (1 << 17), "right")))
            n = per_row[at:until]
            entry = numbers[ragged(starts[member[at:until]], n)]
            apart = np.repeat(rows[at:until].astype(np.int64), n, axis=0) - self.book[entry]
            squares = np.einsum("ij,ij->i", apart, apart)
            first = np.r_[0, np.cumsum(n)[:-1]]
            low = np.minimum.reduceat(squares, first)
            hit = np.flatnonzero(squares == np.repeat(low, n))
            owner = np.repeat(np.arange(len(n)), n)[hit]
            _, leading = np.unique(owner, return_index=True)
            best[at:until], distance[at:until] = entry[hit[leading]], low
            at = until
        return best, distance


def vectors_of(batch: pa.RecordBatch, length: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("ints").to_pylist()), np.int32).reshape(batch.num_rows, length)


def sums_of(vectors: DataFrame, books: list[np.ndarray], length: int, cell: int) -> DataFrame:
    """part, entry, n, total (sums of the parts whose nearest entry it is), one row per used entry."""
    cuts = edges(length, len(books))
    width = int(np.diff(cuts).max())

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = [Grid(b, cell) for b in books]
        n = np.zeros((len(books), len(books[0])), np.int64)
        total = np.zeros((*n.shape, width), np.int64)
        for batch in batches:
            rows = vectors_of(batch, length)
            for p, grid in enumerate(grids):
                part = rows[:, cuts[p] : cuts[p + 1]]
                best, _ = grid.nearest(part)
                n[p] += np.bincount(best, minlength=n.shape[1])
                np.add.at(total[p][:, : part.shape[1]], best, part)
        p, e = np.nonzero(n)
        if len(p):
            totals = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * width), pa.array(total[p, e].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(n[p, e]), totals], ["part", "entry", "n", "total"])

    told = vectors.select("ints").mapInArrow(add, "part int, entry int, n bigint, total array<bigint>")
    sums = F.array(*(F.sum(F.col("total")[k]) for k in range(width))) if width else F.array().cast("array<bigint>")
    return told.groupBy("part", "entry").agg(F.sum("n").alias("n"), sums.alias("total"))


def codebooks(vectors: DataFrame, length: int, parts: int, entries: int, rounds: int, cell: int) -> list[np.ndarray]:
    """The trained entries of each part. They start as the parts of the smallest ids."""
    cuts = edges(length, parts)
    first = vectors.orderBy(F.asc_nulls_last("vec_id"), "ints").limit(entries).select("ints").collect()
    start = np.stack([np.frombuffer(r["ints"], np.int32) for r in first]).astype(np.int64)
    books = [start[:, cuts[p] : cuts[p + 1]].copy() for p in range(parts)]
    for _ in range(rounds):
        for row in sums_of(vectors, books, length, cell).collect():
            book = books[row["part"]]
            book[row["entry"]] = np.array(row["total"], np.int64)[: book.shape[1]] // row["n"]
    return books


def compress(
    embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, cell: int = CELL
) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 of every vector that is not null and all finite.

    Vectors are taken to have one length, that of the smallest id's vector; others have no parts to be
    compared and are left out like null ones. Where the length is no multiple of the parts, the first parts are longer by one.
    Rows that repeat an id are vectors of their own; those with equal ids start the codebook in the order of their bytes, and ids
    that are null come last. With fewer vectors than entries the codebook has one entry per vector; equal entries tie, and
    the first of them is taken. An empty table gives no rows. Extra columns take no part.
    """
    rows = embeddings.select("vec_id", "label", "embedding").where(finite(F.col("embedding")))
    smallest = rows.orderBy(F.asc_nulls_last("vec_id"), "embedding").select(F.size("embedding").alias("n")).first()
    length = smallest["n"] if smallest else 0
    rows = rows.where(F.size("embedding") == length)

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ints = integers(batch.column("embedding"), length)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([x.tobytes() for x in ints], pa.binary())], ["vec_id", "label", "ints"])

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    kept = f"vec_id {types['vec_id']}, label {types['label']}"
    vectors = written(rows.mapInArrow(scale, f"{kept}, ints binary"))
    books = codebooks(vectors, length, parts, entries, rounds, cell) if smallest else [np.zeros((0, 0), np.int64)] * parts
    cuts = edges(length, parts)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = [Grid(b, cell) for b in books]
        for batch in batches:
            ints = vectors_of(batch, length)
            found = [grid.nearest(ints[:, cuts[p] : cuts[p + 1]]) for p, grid in enumerate(grids)]
            code = np.stack([best for best, _ in found], 1)
            error = sum(distance for _, distance in found)
            digits = len(f"{max(entries - 1, 0):x}")
            text = ["".join(f"{x:0{digits}x}" for x in row) for row in code.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(text, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    coded = written(vectors.mapInArrow(encode, f"{kept}, code string, error bigint"))
    by_label = written(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    listed = ",".join(str(x) for book in books for entry in book.tolist() for x in entry)
    digest = hashlib.sha256(listed.encode()).hexdigest()
    out = coded.join(if_small(by_label), coded["label"].eqNullSafe(F.col("of")), "left")
    return out.select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
