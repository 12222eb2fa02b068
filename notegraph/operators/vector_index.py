"""A stored index of vectors, kept beside the notes table: exact nearest notes that read only the cells that can matter.

Vectors lie in cells around pivots, found through a tree of two levels (top pivots, then the pivots nearest to them). A
cell is a folder of rows; a small table tells for each cell its current folder, number of rows and radius, the
largest angle between its pivot and a row. An update rewrites the cells it touches into new folders and then appends
their numbers, which makes them current; one writer at a time. Pivots stay, radii follow the rows, so answers are
exact whatever was inserted, changed or removed since. Build anew when cells have grown uneven.

Angles obey the triangle inequality: no row of a cell is nearer to a query than the angle to its pivot less its radius.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notegraph.functions.vectors import unit_rows
from notegraph.operators.materialise import materialise
from notegraph.operators.similar import (
    ANGLE_SLACK, Cells, drop_surplus_copies, note_vectors, similar_to, _cell_search, _part, _rank, _search_strips, _seed_search,
    _strips, _FOUND, _SEED,
)
from notegraph.operators.sized import if_small, is_small

CELL_ROWS = 4096  # rows that a cell is planned for
PIVOT_BYTES = 32 << 20  # pivots are sent to every task, so there are no more of them
BLOCK_ROWS = 8192  # rows of one side that a task compares

_ROWS = "path string, chunk_index int, embedding array<float>, angle double"
_CURRENT = "generation int, save string, cell int, n long, radius double"


@dataclass(frozen=True)
class Index:
    """Pivots (one unit row per cell), the top pivot of each, and the current folder, rows and radius of filled cells."""

    root: str
    pivots: np.ndarray
    tops: np.ndarray
    current: dict[int, Row]

    @property
    def dim(self) -> int:
        return self.pivots.shape[1]

    def rows(self, spark: SparkSession, cells: list[int] | None = None) -> DataFrame:
        """The rows of these cells, by default all; nothing else is listed or read."""
        wanted = self.current if cells is None else cells
        folders = [f"{self.root}/rows/{self.current[c].save}/cell={c}" for c in sorted(wanted) if c in self.current]
        if not folders:
            return spark.createDataFrame([], _ROWS).withColumn("cell", F.lit(0))
        found = spark.read.schema(_ROWS).parquet(*folders)
        return found.withColumn("cell", F.regexp_extract(F.col("_metadata.file_path"), r"/cell=(\d+)/", 1).cast("int"))

    def place(self, rows: DataFrame) -> DataFrame:
        """The rows with their cell and the angle to its pivot: the nearest pivot below the nearest top one."""
        pivots, tops = self.pivots, self.tops
        upper = np.unique(tops)

        @F.arrow_udf(T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())]))
        def nearest(vectors: pa.Array) -> pa.Array:
            units = unit_rows(vectors) if len(vectors) else np.zeros((0, pivots.shape[1]))
            cell, best = np.zeros(len(units), np.int32), np.zeros(len(units))
            above = upper[(units @ pivots[upper].T).argmax(axis=1)] if len(units) else np.zeros(0, int)
            for top in np.unique(above):
                below, own = np.flatnonzero(tops == top), above == top
                cosines = units[own] @ pivots[below].T
                cell[own], best[own] = below[cosines.argmax(axis=1)], cosines.max(axis=1)
            return pa.StructArray.from_arrays([pa.array(cell), pa.array(np.arccos(np.clip(best, -1.0, 1.0)))], ["cell", "angle"])

        placed = rows.withColumn("place", nearest(F.col("embedding")))
        return placed.select(*rows.columns, "place.cell", "place.angle")


def _usable(rows: DataFrame, dim: int) -> DataFrame:
    """Rows with a direction and the length asked for; the others are in no cell."""
    vector = F.col("embedding")
    finite = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(vector, lambda x: x != 0)
    return rows.where(F.size(vector) == dim).where(finite)


def open_index(spark: SparkSession, root: str) -> Index:
    """One short row per cell and its pivot."""
    tree = spark.read.parquet(f"{root}/tree").orderBy("cell").collect()
    pivots = np.array([r["pivot"] for r in tree]).reshape(len(tree), -1)
    try:
        latest = F.max(F.struct("generation", "save", "n", "radius")).alias("latest")
        rows = spark.read.schema(_CURRENT).parquet(f"{root}/current").groupBy("cell").agg(latest).collect()
    except AnalysisException:  # nothing was saved
        rows = []
    return Index(root, pivots, np.array([r["top"] for r in tree], int), {r["cell"]: r["latest"] for r in rows if r["latest"].n})


def _save(spark: SparkSession, root: str, placed: DataFrame, emptied: list[int], generation: int) -> None:
    save = uuid.uuid4().hex
    ordered = placed.hint("rebalance", "cell").sortWithinPartitions("cell", "path", "chunk_index")
    ordered.write.partitionBy("cell").parquet(f"{root}/rows/{save}")
    try:
        saved = spark.read.parquet(f"{root}/rows/{save}").groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius"))
        filled = [(generation, save, int(r["cell"]), r["n"], r["radius"]) for r in saved.collect()]
    except AnalysisException:  # no row was left
        filled = []
    left = [(generation, save, c, 0, 0.0) for c in emptied if c not in {f[2] for f in filled}]
    spark.createDataFrame(filled + left, _CURRENT).coalesce(1).write.mode("append").parquet(f"{root}/current")


def build_index(notes: DataFrame, root: str, dim: int, cell_rows: int = CELL_ROWS) -> None:
    """Index all vectors of length `dim` of the notes (path, chunk_index, embedding) in a new folder.

    Pivots are a fixed sample of the vectors, one per `cell_rows` rows, bounded by PIVOT_BYTES.
    """
    spark = notes.sparkSession
    rows = _usable(notes.select("path", F.col("chunk_index").cast("int").alias("chunk_index"), F.col("embedding").cast("array<float>").alias("embedding")), dim)
    most = max(1, PIVOT_BYTES // (8 * max(dim, 1)))
    cells = min(most, max(1, math.ceil(rows.count() / cell_rows)))
    sample = rows.orderBy(F.xxhash64("path", "chunk_index"), "path", "chunk_index").select("embedding").limit(cells).toArrow()
    pivots = unit_rows(sample["embedding"])
    pivots = np.unique(pivots, axis=0) if len(pivots) else np.zeros((1, dim))
    upper = np.linspace(0, len(pivots) - 1, math.ceil(math.sqrt(len(pivots)))).astype(int)
    tops = upper[(pivots @ pivots[upper].T).argmax(axis=1)]
    tops[upper] = upper
    tree = [(k, int(t), p.tolist()) for k, (t, p) in enumerate(zip(tops, pivots))]
    spark.createDataFrame(tree, "cell int, top int, pivot array<double>").coalesce(1).write.parquet(f"{root}/tree")
    _save(spark, root, Index(root, pivots, tops, {}).place(rows), [], 1)


def update_index(notes: DataFrame, paths: DataFrame, root: str) -> int:
    """Bring the index up to date: `paths` are notes that changed or are gone, `notes` has the rows they have now.

    Only cells that hold a row of these notes, or get one, are read and written. Returns their number.
    """
    spark = notes.sparkSession
    index = open_index(spark, root)
    paths = materialise(paths.select("path").distinct())
    few = if_small(paths)
    rows = notes.select("path", F.col("chunk_index").cast("int").alias("chunk_index"), F.col("embedding").cast("array<float>").alias("embedding"))
    new = materialise(index.place(_usable(rows, index.dim).join(few, "path", "left_semi")))
    old = index.rows(spark).select("path", "cell").join(few, "path", "left_semi")
    cells = sorted(r["cell"] for r in old.select("cell").union(new.select("cell")).distinct().collect())
    if not cells:
        return 0
    kept = index.rows(spark, cells).join(few, "path", "left_anti").select(*new.columns)
    generation = max((latest.generation for latest in index.current.values()), default=0) + 1
    _save(spark, root, kept.unionByName(new), cells, generation)
    return len(cells)


def similar_in_index(spark: SparkSession, root: str, path: str, vector: list[float], k: int = 5) -> DataFrame:
    """similar_to by the index: the k chunks of other notes that are most similar to a note with this vector.

    The nearest cells that hold k rows of other notes give a score to reach; then cells are read that may hold better ones.
    """
    index = open_index(spark, root)
    query = np.asarray(vector, float)
    query = query / (np.linalg.norm(query) or 1.0)
    cells = np.array(sorted(index.current), int)
    gap = np.arccos(np.clip(index.pivots[cells] @ query, -1.0, 1.0)) - np.array([index.current[c].radius for c in cells]) - ANGLE_SLACK
    bound = np.cos(np.clip(gap, 0.0, np.pi))
    order = cells[np.argsort(gap, kind="stable")]
    asked = spark.createDataFrame([(path, 0, [float(x) for x in vector])], "path string, chunk_index int, embedding array<float>")

    def best(some: list[int]) -> DataFrame:
        held = index.rows(spark, some).where(F.col("path") != path).select("path", "chunk_index", "embedding")
        return similar_to(held.unionByName(asked), path, k)

    read, found = 0, []
    while read < len(order) and len(found) < k:  # doubles, so a note that fills whole cells costs few turns
        read = min(len(order), max(1, 2 * read))
        found = best([int(c) for c in order[:read]]).collect()
    least = found[-1]["similarity"] if len(found) == k else -2.0
    may = set(cells[bound >= least - ANGLE_SLACK].tolist()) | {int(c) for c in order[:read]}
    return best(sorted(may))


def knn_in_index(queries: DataFrame, root: str, k: int = 5, level: str = "chunk", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """knn_join by the index: the k best matches of each query (path, embedding), exact, from the cells that can hold them.

    Each block of queries of a cell meets a block nearby first; its worst k-th score then leaves out cells by their radius.
    The cells that are left for any block are read once, and strips of queries meet strips of them, see knn_join.
    """
    spark = queries.sparkSession
    index = open_index(spark, root)
    by_note = level == "note"
    queries = _usable(queries.select(F.col("path").alias("path"), F.col("embedding").cast("array<float>").alias("embedding")), index.dim)
    placed = materialise(index.place(queries))
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()
    cells = np.array(sorted(index.current), int)
    parts = np.array([math.ceil(index.current[c].n / block_rows) for c in cells], int)
    radii = np.array([index.current[c].radius for c in cells])
    pivots = index.pivots
    q_parts = {r["cell"]: math.ceil(r["n"] / block_rows) for r in sizes}
    q_radii = {r["cell"]: r["radius"] for r in sizes}
    if not len(cells) or not sizes:
        return spark.createDataFrame([], _FOUND + ", rank int").drop(*(["chunk_index"] if by_note else []))
    key = ["q_cell", "q_part", "c_cell", "c_part"]
    key_schema = ", ".join(f"{c} int" for c in key)
    seeds = []
    for q, n in q_parts.items():  # one row per block of queries
        near = int(np.argmax(pivots[cells] @ pivots[q]))
        seeds += [(int(q), p, int(cells[near]), p % int(parts[near])) for p in range(n)]
    seeds = spark.createDataFrame(seeds, key_schema)
    lookup = spark.createDataFrame([(int(c), int(p)) for c, p in q_parts.items()], "q_cell int, parts int")
    placed = placed.withColumnRenamed("cell", "q_cell").drop("angle").join(F.broadcast(lookup), "q_cell")
    placed = placed.withColumn("q_part", _part(F.col("parts"), "path")).drop("parts")
    c_lookup = spark.createDataFrame([(int(c), int(p)) for c, p in zip(cells, parts)], "c_cell int, parts int")

    def rows_of(wanted: list[int]) -> DataFrame:
        """Only the cells that are named are read."""
        return index.rows(spark, wanted).withColumnRenamed("cell", "c_cell").drop("angle")

    def search(pairs: DataFrame, function, schema: str) -> DataFrame:
        """Blocks of queries with blocks of rows."""
        wanted = [r["c_cell"] for r in pairs.select("c_cell").distinct().collect()]
        rows = rows_of(wanted).join(F.broadcast(c_lookup), "c_cell")
        rows = rows.withColumn("c_part", _part(F.col("parts"), "path", "chunk_index")).drop("parts")
        named = F.broadcast(pairs) if is_small(pairs) else pairs
        left = placed.join(named, key[:2]).groupBy(*key)
        return left.cogroup(rows.join(named, key[2:]).groupBy(*key)).applyInArrow(function, schema)

    first = materialise(search(seeds, _seed_search(k, by_note), _SEED))
    reached = first.groupBy("q_cell", "q_part", "path").agg(F.min("similarity").alias("kth"))
    reached = reached.groupBy("q_cell", "q_part").agg(F.min("kth").alias("kth"))

    held = spark.sparkContext.broadcast((pivots, q_radii, {int(c): float(r) for c, r in zip(cells, radii)}))  # the fields of Cells

    def may_matter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cells that the bounds of some block of queries do not rule out."""
        wanted, known = np.zeros(len(cells), bool), Cells(*held.value)
        for batch in batches:
            for q, kth in zip(*(batch.column(c).to_pylist() for c in ("q_cell", "kth"))):
                wanted |= np.cos(known.gaps(q, cells)) >= kth - ANGLE_SLACK
        yield pa.RecordBatch.from_arrays([pa.array(cells[wanted].astype(np.int32))], ["c_cell"])

    matter = [r["c_cell"] for r in reached.mapInArrow(may_matter, "c_cell int").distinct().collect()]
    corpus = drop_surplus_copies(rows_of(matter).withColumnRenamed("c_cell", "cell"), k)
    asked = placed.select("path", "embedding", F.col("q_cell").alias("cell"))
    strips = _strips(sum(r["n"] for r in sizes), sum(index.current[c].n for c in matter), index.dim)
    found = _search_strips(asked, corpus, _cell_search(k, by_note, block_rows, held), strips)
    result = _rank(found, k, by_note)
    return result.drop("chunk_index") if by_note else result


def similar_to_indexed(notes: DataFrame, root: str, path: str, k: int = 5) -> DataFrame:
    """similar_to for a note of the table, by the index beside it; empty when the note has no vector."""
    found = note_vectors(notes).where(F.col("path") == path).where(F.col("embedding").isNotNull()).take(1)
    if not found or not any(found[0].embedding):
        return similar_to(notes.where(F.lit(False)), path, k)
    return similar_in_index(notes.sparkSession, root, path, found[0].embedding, k)
