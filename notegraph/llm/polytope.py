"""Near-duplicate vectors by cross-polytope hashing: links between vectors of one label with a cosine of 0.93 or more.

A rotation (three times random signs and a fast Hadamard transform) takes a unit vector near one of the 2 d vertices
+-e_k of the cross-polytope: that of its largest coordinate. Vectors at a small angle share a vertex with a good
chance, and with nearly all of it when each is put into the buckets of its PROBES largest coordinates. For two of the
64-dimensional vectors at a cosine of exactly 0.93 the chance to meet is 0.976 in one table of three probes and 0.9994 in
two (measured; closer pairs meet more often).

Equal vectors of one label are one class, of which one row goes on. A task takes a bucket (label, table, vertex),
compares all its vectors exactly, however many there are, and reports a number of links
per class and the tree edges that connect them: never pairs, which grow with the square of a group of near copies. A
pair that meets in several buckets counts in the first of them only, which both vectors' codes tell. Buckets
beyond BLOCK_VALUES are cut into blocks, and pairs of blocks go to tasks of their own, so no group of near copies,
however large, is one task, and nothing is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from notegraph.llm.common import grouped, written
from notegraph.llm.jaccard import components
from notegraph.operators.sized import if_small

COSINE = 0.93
TABLES, PROBES = 2, 3
LEAF = 2048  # vectors compared with others at a time
BLOCK_VALUES = 1 << 22  # numbers of a block: 65,536 vectors of 64 dimensions
SCORES = 1 << 20  # cosines held at a time

_FOUND = "v bigint, links bigint, root bigint"


@cache
def signs(width: int, table: int) -> np.ndarray:
    """The random signs of a rotation of vectors of a width."""
    return np.random.Generator(np.random.PCG64([20240601, width, table])).choice(np.array([-1.0, 1.0]), (3, width))


def hadamard(rows: np.ndarray) -> np.ndarray:
    """The fast Hadamard transform of each row; the width is a power of two."""
    n, width = rows.shape
    step = 1
    while step < width:
        pairs = rows.reshape(n, width // (2 * step), 2, step)
        rows = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(n, width)
        step *= 2
    return rows / np.sqrt(width)


def vertices(unit: np.ndarray, table: int, probes: int) -> np.ndarray:
    """For each row the `probes` vertices of the cross-polytope that it is nearest to after a rotation, nearest first.

    A vertex is twice the number of its coordinate, plus one where that is negative.
    """
    width = 1 << max(int(unit.shape[1]) - 1, 0).bit_length()
    rows = np.zeros((len(unit), width))
    rows[:, : unit.shape[1]] = unit
    for flip in signs(width, table):
        rows = hadamard(rows * flip)
    near = np.stack([rows, -rows], 2).reshape(len(rows), 2 * width)
    probes = min(probes, 2 * width)
    found = np.argpartition(-near, probes - 1, 1)[:, :probes] if probes < 2 * width else np.tile(np.arange(probes), (len(rows), 1))
    order = np.argsort(-np.take_along_axis(near, found, 1), 1, kind="stable")
    return np.take_along_axis(found, order, 1).astype(np.int32)


def bucket_codes(unit: np.ndarray, tables: int, probes: int) -> np.ndarray:
    """The buckets of each row in all tables, as numbers that differ between tables."""
    width = 2 << max(int(unit.shape[1]) - 1, 0).bit_length()
    return np.concatenate([vertices(unit, t, probes) + t * width for t in range(tables)], 1)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision; scaled first, so that no finite vector overflows."""
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def first_shared(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest code that both rows of a pair have; every pair has one."""
    shared = (left[:, :, None] == right[:, None, :]).any(2)
    return np.where(shared, left, np.iinfo(left.dtype).max).min(1)


class Bucket:
    """Links among the vectors of a bucket, as a number per vector and a forest that connects linked ones."""

    def __init__(self, unit: np.ndarray, weight: np.ndarray, sides: np.ndarray, cosine: float, leaf: int):
        self.unit, self.weight, self.sides, self.cosine, self.leaf = unit, weight, sides, cosine, leaf
        self.across = bool((sides == 2).any())
        self.links = np.zeros(len(unit), np.int64)
        self.root = np.arange(len(unit))

    def search(self, codes: np.ndarray, code: int) -> None:
        """All links whose first shared code is this one, `leaf` vectors against others at a time."""
        rows = np.arange(len(self.unit))
        left, right = (rows[self.sides != 2], rows[self.sides == 2]) if self.across else (rows, rows)
        for start in range(0, len(right), self.leaf):
            others = right[start : start + self.leaf]
            ahead = left if self.across else left[: others[-1]]  # a pair once
            step = max(1, SCORES // len(others))
            for at in range(0, len(ahead), step):
                some = ahead[at : at + step]
                a, b = np.nonzero(self.unit[some] @ self.unit[others].T >= self.cosine)
                a, b = some[a], others[b]
                if not self.across:
                    a, b = a[a < b], b[a < b]
                first = first_shared(codes[a], codes[b]) == code
                a, b = a[first], b[first]
                np.add.at(self.links, a, self.weight[b])
                np.add.at(self.links, b, self.weight[a])
                self.connect(a, b)

    def connect(self, a: np.ndarray, b: np.ndarray) -> None:
        """Hang the larger root of every pair below the smaller one until each pair has one root."""
        while len(a):
            low, high = np.minimum(self.root[a], self.root[b]), np.maximum(self.root[a], self.root[b])
            differ = low != high
            a, b = a[differ], b[differ]
            np.minimum.at(self.root, high[differ], low[differ])
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def with_codes(classes: DataFrame, tables: int, probes: int) -> DataFrame:
    """classes (v, label, dim, m, embedding) with `codes`, the buckets of the vector."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = pa.Table.from_batches([batch]).filter(pa.array(dims == dim)).combine_chunks()
                codes = bucket_codes(unit_rows(matrix(part.column("embedding"))), tables, probes)
                offsets = pa.array(np.arange(len(codes) + 1, dtype=np.int32) * codes.shape[1])
                yield from part.append_column("codes", pa.ListArray.from_arrays(offsets, pa.array(codes.ravel()))).to_batches()

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema)
    return classes.mapInArrow(measure, f"{schema}, codes array<int>")


def bucket_links(rows: DataFrame, cosine: float, leaf: int) -> DataFrame:
    """v, links, root of every bucket. rows: label, dim, cell, i, j (blocks), side, v, m, codes, embedding."""
    keys = ["label", "dim", "cell", "i", "j"]
    rows = rows.repartition(*keys).sortWithinPartitions(*keys)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, *keys):
            if len(table) < 2:
                continue
            ids, weight, sides = (table.column(c).to_numpy() for c in ("v", "m", "side"))
            bucket = Bucket(unit_rows(matrix(table.column("embedding"))), weight, sides, cosine, leaf)
            codes = table.column("codes").combine_chunks().flatten().to_numpy().reshape(len(table), -1)
            bucket.search(codes, table.column("cell")[0].as_py())
            linked = np.flatnonzero(bucket.links)
            if len(linked):
                columns = (ids[linked], bucket.links[linked], ids[bucket.root[linked]])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["v", "links", "root"])

    return rows.mapInArrow(search, _FOUND)


def in_blocks(rows: DataFrame, block_values: int) -> DataFrame:
    """Rows (label, dim, codes, ...) once per bucket; those of large buckets once per pair of their block with another.

    Buckets are counted first, on short rows that Spark pre-aggregates.
    """
    key = ["label", "dim", "cell"]
    cells = rows.select("*", F.explode("codes").alias("cell"))
    counts = cells.groupBy(*key).agg(F.ceil(F.count("*") * F.col("dim") / block_values).cast("int").alias("blocks"))
    large = written(counts.where("blocks > 1"))
    cells = cells.join(if_small(large), key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cells = cells.withColumn("own", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    return cells.select(
        *key, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.cast("int").alias("side"), "v", "m", "codes", "embedding"
    )


def comparable(embedding: Column) -> Column:
    """Whether a vector has an angle to others: not null, not zero, and no null or non-finite component."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(embedding, lambda x: x != 0), F.lit(False))


def near_duplicates(
    embeddings: DataFrame, cosine: float = COSINE, tables: int = TABLES, probes: int = PROBES, leaf: int = LEAF, block_values: int = BLOCK_VALUES
) -> DataFrame:
    """vec_id, n_links, component_id (smallest vec_id reachable by links, itself included), kept, for every row.

    Vectors are compared when their labels are equal and not null and they have the same length. A vector that is null,
    empty, zero, or holds null or non-finite components is linked with nothing. Every row is a vector: one that repeats a
    vec_id counts on its own, and is linked with its copies. Rows without vec_id count as links of others, and their
    component_id is the smallest id there is in their component, or null; they are not kept. An empty table gives
    no rows; extra columns take no part. Every link that is counted has the cosine asked for, in double precision.
    """
    vector = F.col("embedding")
    usable = F.col("label").isNotNull() & comparable(vector)
    digests = [F.when(usable, F.xxhash64(F.lit(salt), "label", vector)).alias(f"d{salt}") for salt in (1, 2)]
    rows = embeddings.select("vec_id", F.col("label").cast("string").alias("label"), "embedding").select("*", *digests)
    held = written(rows.select("vec_id", "d1", "d2"))
    classes = rows.where("d1 IS NOT NULL").groupBy("d1", "d2").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("m"), F.first("label").alias("label"), F.first("embedding").alias("embedding")
    )
    classes = written(classes.withColumn("dim", F.size("embedding")).withColumn("v", F.monotonically_increasing_id()))
    coded = written(with_codes(classes.select("v", "label", "dim", "m", "embedding"), tables, probes))
    found = written(bucket_links(in_blocks(coded, block_values), cosine, leaf))

    edges = found.where("v <> root").select(F.col("v").alias("a"), F.col("root").alias("b"))
    labels = written(components(edges).withColumnsRenamed({"vertex": "v", "label": "group"}))
    links = found.groupBy("v").agg(F.sum("links").alias("links"))
    # Only classes of several rows or with links have anything to add to a row of their own.
    named = classes.select("v", "d1", "d2", "m", "rep").join(links, "v", "left").join(labels, "v", "left").where("m > 1 OR links > 0")
    named = written(named.withColumn("group", F.coalesce("group", "v")))
    least = written(named.groupBy("group").agg(F.min("rep").alias("component")))
    named = written(named.join(if_small(least), "group").select("d1", "d2", "component", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n")))
    out = held.join(if_small(named), ["d1", "d2"], "left")
    component = F.coalesce("component", "vec_id")
    kept = F.coalesce(F.col("vec_id") == component, F.lit(False))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), kept.alias("kept"))
