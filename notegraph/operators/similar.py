"""Exact nearest notes by cosine similarity.

`similar_to` answers for one note with one scan. `knn_join` answers for many notes. When one side is
counted and small, it is broadcast and the other side is only scanned, so a few changed notes are
searched in a large corpus without moving it. Otherwise both sides are cut into a few even strips, each pair
of strips is one task that hands on only its best k per query, and a window ranks those. Inside a task a block of
queries meets slices of the corpus; what k others beat by more than the error of single precision is left out, the rest is
scored in double precision. Strips are made from hashes of the row keys, so no path, cell or group of copies decides
how much a task gets, and their number, not that of blocks, says how often a row is sent.

For large inputs `knn_join` first assigns all vectors to cells around sampled pivots. Angles obey
the triangle inequality, so a pair of cells can be left out whenever even its closest possible
vectors are worse than the k best a query already has; tasks look that up for each block of queries. The answer stays exact.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notegraph.functions.vectors import DIGITS, cosine_to, nearest_pivot, unit_rows
from notegraph.operators.materialise import materialise
from notegraph.operators.sized import is_small

BROADCAST_BYTES = 32 << 20  # vectors of a side that may be sent to every task
BLOCK_BYTES = 8 << 20  # rows of a block, and single-precision vectors of a strip of queries
PACK_ROWS = 256  # rows added to a block at a time
BLOCK_ROWS = 1024  # queries compared at a time
SLICE_SCORES = 1 << 22  # scores held at a time while queries have no score to beat
TILE_SCORES = 1 << 19  # scores held at a time afterwards
TILE_RUN = 256  # scores of which the highest is compared first
MERGE_ROWS = 1 << 14  # rows after which the scores to beat are raised
START_ROWS = 1024  # rows that give a query its first scores to beat
FIRST_ROWS = 4096  # rows of cells nearby that queries meet first
EXACT_CELLS = 1 << 21  # numbers of pairs scored in double precision at a time
TASK_SCORES = 400_000_000  # scores that are worth a task
MOST_TASKS = 128  # beyond this many tasks, tasks grow
MOST_STRIPS = 32  # beyond this many strips of a side, strips grow (up to BLOCK_BYTES) instead
MOST_LEFT = 0.5  # share of the pairs that cells must rule out to be worth picking columns
INDEX_SCORES = 16_000_000_000  # with more scores, look for pairs to leave out
MAX_PIVOTS = 256
ANGLE_SLACK = 1e-5  # covers rounding of scores and of angles

_FOUND = "path string, similar_path string, chunk_index int, similarity double"
_SEED = "q_cell int, q_part int, " + _FOUND


def note_vectors(notes: DataFrame) -> DataFrame:
    """The vector a note is searched with: that of its first chunk."""
    return notes.where(F.col("chunk_index") == 0).select("path", "embedding")


def similar_to(notes: DataFrame, path: str, k: int = 5) -> DataFrame:
    """The k chunks of other notes most similar to one note; empty when it has no vector."""
    found = note_vectors(notes).where(F.col("path") == path).where(F.col("embedding").isNotNull()).take(1)
    vector = found[0].embedding if found else []
    if not any(vector):
        scored = notes.where(F.lit(False)).withColumn("similarity", F.lit(None).cast("double"))
    else:
        others = notes.where((F.col("path") != path) & (F.size("embedding") == len(vector)))
        scored = others.withColumn("similarity", cosine_to(vector)(F.col("embedding")))
    return (
        scored.where(F.col("similarity").isNotNull())
        .select(F.col("path").alias("similar_path"), "chunk_index", "similarity")
        .orderBy(F.col("similarity").desc(), "similar_path", "chunk_index")
        .limit(k)
    )


@dataclass
class _Side:
    """Rows of one side in a task: unit vectors, the same in single precision, and, once two sides have met, a number
    for each path."""

    units: np.ndarray
    short: np.ndarray
    codes: np.ndarray

    def some(self, rows: np.ndarray) -> _Side:
        return _Side(self.units[rows], self.short[rows], self.codes[rows])

    def __len__(self) -> int:
        return len(self.codes)


@dataclass
class _Strip:
    """Rows of a table that have a direction, and their vectors."""

    rows: pa.Table
    units: np.ndarray
    short: np.ndarray

    def __len__(self) -> int:
        return len(self.rows)


def _strip(table: pa.Table) -> _Strip:
    """Rows of the corpus are put in order of path and chunk."""
    if "chunk_index" in table.column_names:
        table = table.sort_by([("path", "ascending"), ("chunk_index", "ascending")])
    vectors = unit_rows(table["embedding"])
    table = table.drop_columns("embedding")
    if not (usable := vectors.any(axis=1)).all():
        table, vectors = table.filter(pa.array(usable)), vectors[usable]
    return _Strip(table, vectors, vectors.astype(np.float32))


def _sides(queries: _Strip, corpus: _Strip) -> tuple[_Side, _Side]:
    paths = pa.chunked_array([*queries.rows["path"].chunks, *corpus.rows["path"].chunks], pa.string())
    codes = paths.combine_chunks().dictionary_encode().indices.to_numpy()
    return (
        _Side(queries.units, queries.short, codes[: len(queries)]),
        _Side(corpus.units, corpus.short, codes[len(queries) :]),
    )


_Matches = tuple[np.ndarray, np.ndarray, np.ndarray]  # row, column, score: by row, best first


def _nothing() -> _Matches:
    return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)


def _kth(row: np.ndarray, score: np.ndarray, n: int, k: int) -> np.ndarray:
    """The k-th score of each row; -2 where it has fewer. Scores stand by row, best first."""
    ends = np.searchsorted(row, np.arange(n), "right")
    full = ends - np.searchsorted(row, np.arange(n), "left") >= k
    least = np.full(n, -2.0)
    least[full] = score[ends[full] - 1]
    return least


def _reached(found: _Matches, n: int, k: int, floor: np.ndarray | None = None) -> np.ndarray:
    """The score that a row's matches have to reach: the k-th one found, or the one known beforehand."""
    least = _kth(found[0], found[2], n, k)
    return least if floor is None else np.maximum(least, floor)


def _over(short: np.ndarray, columns: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where products of rows reach the bound of their row. Only runs of TILE_RUN products whose highest does are looked into."""
    near = short @ columns.T
    n, width = near.shape
    if width % TILE_RUN:
        return np.nonzero(near >= least[:, None])
    runs = near.reshape(n, -1, TILE_RUN)
    row, run = np.nonzero(runs.max(axis=2) >= least[:, None])
    which, place = np.nonzero(runs[row, run] >= least[row, None])
    return row[which], run[which] * TILE_RUN + place


def _best(
    queries: _Side, corpus: _Side, columns: range | np.ndarray, k: int, by_note: bool, found: _Matches, floor: np.ndarray | None = None
) -> _Matches:
    """The k best of each query row among these columns (ascending) of the corpus, or their notes, and those found before.

    Products in single precision leave out what is worse than k others, or than `floor`, by more than their error; the
    scores of the rest are taken in double precision.
    """
    n, dim = queries.short.shape
    error = 2 * (dim + 8) * 6e-8
    tile = max(TILE_RUN, TILE_SCORES // max(1, n) // TILE_RUN * TILE_RUN)
    exact_rows = max(1, EXACT_CELLS // max(1, dim))
    given = floor is not None and bool((floor > -2.0).all())
    at = 0
    while at < len(columns):
        least = _reached(found, n, k, floor)
        known = bool((least > -2.0).all())
        # Bounds of a few rows let many pass, so the first slices are short.
        size = MERGE_ROWS if given else min(MERGE_ROWS, max(START_ROWS, at)) if known else max(1, min(SLICE_SCORES // max(1, n), START_ROWS))
        some = columns[at : at + size]
        at += len(some)
        of = lambda part: corpus.short[slice(part.start, part.stop) if isinstance(part, range) else part]
        if known:
            bound = (least - error).astype(np.float32)
            hits = []
            for start in range(0, len(some), tile):
                row, column = _over(queries.short, of(some[start : start + tile]), bound)
                hits.append((row, column + start))
            row, column = (np.concatenate(both) for both in zip(*hits))
        else:
            near, codes = queries.short @ of(some).T, corpus.codes[slice(some.start, some.stop) if isinstance(some, range) else some]
            others = np.where(queries.codes[:, None] == codes[None, :], np.float32(-2), near)
            if by_note:  # columns are in path order, so a note is a run of them
                others = np.maximum.reduceat(others, np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]), axis=1)
            if (width := others.shape[1]) >= k:
                least = np.maximum(least, np.partition(others, width - k, axis=1)[:, width - k])
            row, column = np.nonzero(near >= (least - error).astype(np.float32)[:, None])
        column = column + some.start if isinstance(some, range) else some[column]
        other = queries.codes[row] != corpus.codes[column]
        row, column = row[other], column[other]
        if not len(row):
            continue
        score = np.zeros(len(row))
        for start in range(0, len(row), exact_rows):
            part = slice(start, start + exact_rows)
            score[part] = np.einsum("ij,ij->i", queries.units[row[part]], corpus.units[column[part]])
        row, column, score = (np.concatenate(both) for both in zip(found, (row, column, np.round(score, DIGITS))))
        order = np.lexsort((column, -score, row))
        row, column, score = row[order], column[order], score[order]
        if by_note:  # the best of each note
            first = np.sort(np.unique(row * (int(corpus.codes.max()) + 1) + corpus.codes[column], return_index=True)[1])
            row, column, score = row[first], column[first], score[first]
        chosen = np.arange(len(row)) - np.searchsorted(row, row, "left") < k
        found = row[chosen], column[chosen], score[chosen]
    return found


def _joined(corpus: _Strip, parts: list[_Matches], held: pa.Table | None, k: int, by_note: bool) -> pa.Table:
    """The k best per row of the queries (row, similar_path, chunk_index, similarity) among those held and new ones: by row, best first."""
    row, column, score = (np.concatenate(c) for c in zip(_nothing(), *parts))
    found = pa.table(
        {
            "row": row,
            "similar_path": corpus.rows["path"].take(pa.array(column)),
            "chunk_index": corpus.rows["chunk_index"].take(pa.array(column)).cast(pa.int32()),
            "similarity": score,
        }
    )
    if held is not None:
        if not len(row):
            return held
        found = pa.concat_tables([held, found])
    paths = found["similar_path"].combine_chunks().dictionary_encode()
    rank = np.zeros(len(paths.dictionary), np.int64)
    rank[pc.sort_indices(paths.dictionary).to_numpy()] = np.arange(len(rank))
    row, path, score = found["row"].to_numpy(), rank[paths.indices.to_numpy()], found["similarity"].to_numpy()
    order = np.lexsort((found["chunk_index"].to_numpy(), path, -score, row))
    if by_note:  # the best of each note
        order = order[np.sort(np.unique(row[order] * (len(rank) + 1) + path[order], return_index=True)[1])]
    row = row[order]
    return found.take(pa.array(order[np.arange(len(row)) - np.searchsorted(row, row, "left") < k])).combine_chunks()


def _floor(held: pa.Table | None, n: int, k: int) -> np.ndarray:
    """What matches have to reach by those held already."""
    return np.full(n, -2.0) if held is None else _kth(held["row"].to_numpy(), held["similarity"].to_numpy(), n, k)


def _matched(queries: pa.Table, held: pa.Table) -> pa.Table:
    paths = queries["path"].take(held["row"]).cast(pa.string())
    return held.drop_columns("row").add_column(0, "path", paths)


def _best_rows(queries: pa.Table, corpus: pa.Table, k: int, by_note: bool) -> pa.Table:
    """The k best corpus rows (or notes) of each query row within one pair of blocks. Queries with fewer than k answers
    here, which put no bound on later pairs, have a row without a path at -1."""
    asked, searched = _strip(queries), _strip(corpus)
    found = _strip_search(k, by_note, BLOCK_ROWS)(asked, searched, None)
    short = np.flatnonzero(np.bincount(found["row"].to_numpy(), minlength=len(asked)) < k)
    none = {
        "path": asked.rows["path"].take(pa.array(short)).cast(pa.string()),
        "similar_path": pa.nulls(len(short), pa.string()),
        "chunk_index": pa.nulls(len(short), pa.int32()),
        "similarity": np.full(len(short), -1.0),
    }
    return pa.concat_tables([_matched(asked.rows, found), pa.table(none)])


@dataclass
class Cells:
    """Pivots of cells, and the largest angle between the pivot of a cell and a row of it, for both sides."""

    pivots: np.ndarray
    q_radii: dict[int, float]
    c_radii: dict[int, float]

    def gaps(self, q_cell: int, c_cells: np.ndarray) -> np.ndarray:
        """The least angle that rows of a cell of queries and of each of these cells can have."""
        angles = np.arccos(np.clip(self.pivots[c_cells] @ self.pivots[q_cell], -1.0, 1.0))
        radii = np.array([self.c_radii[int(c)] for c in c_cells])
        return np.clip(angles - self.q_radii[q_cell] - radii - ANGLE_SLACK, 0.0, np.pi)


def _runs(cells: np.ndarray) -> dict[int, np.ndarray]:
    """The rows of each cell, ascending."""
    order = np.argsort(cells, kind="stable")
    cuts = np.flatnonzero(np.diff(cells[order])) + 1
    return {int(cells[rows[0]]): rows for rows in np.split(order, cuts)} if len(order) else {}


_Search = Callable[[_Strip, _Strip, "pa.Table | None"], pa.Table]  # queries, corpus, what is held: what is held then


def _strip_search(k: int, by_note: bool, block_rows: int) -> _Search:
    """A strip of queries against rows of the corpus, a block of `block_rows` queries at a time."""

    def search(queries: _Strip, corpus: _Strip, held: pa.Table | None) -> pa.Table:
        (left, right), floor, parts = _sides(queries, corpus), _floor(held, len(queries), k), []
        for start in range(0, len(left) if len(right) else 0, block_rows):
            rows = np.arange(start, min(start + block_rows, len(left)))
            row, column, score = _best(left.some(rows), right, range(len(right)), k, by_note, _nothing(), floor[rows])
            parts.append((rows[row], column, score))
        return _joined(corpus, parts, held, k, by_note)

    return search


def _cell_search(k: int, by_note: bool, block_rows: int, sent) -> _Search:
    """The same where rows have cells: what cells nearby reach leaves out those whose closest rows are worse.

    Where that leaves most pairs in, all of them are compared in large blocks, which takes less time than to pick columns.
    """

    def search(queries: _Strip, corpus: _Strip, held: pa.Table | None) -> pa.Table:
        (left, right), floor = _sides(queries, corpus), _floor(held, len(queries), k)
        cells, columns_of = Cells(*sent.value), _runs(corpus.rows["cell"].to_numpy())
        c_cells = np.array(list(columns_of), int)
        sizes = np.array([len(rows) for rows in columns_of.values()], int)
        columns = lambda chosen: np.sort(np.concatenate([columns_of[int(c)] for c in c_cells[chosen]]))
        blocks, pairs = [], 0
        for q_cell, q_rows in (_runs(queries.rows["cell"].to_numpy()) if len(c_cells) else {}).items():
            gaps = cells.gaps(q_cell, c_cells)
            order = np.argsort(gaps, kind="stable")
            first = int(np.searchsorted(np.cumsum(sizes[order]), FIRST_ROWS)) + 1
            for start in range(0, len(q_rows), block_rows):
                rows = q_rows[start : start + block_rows]
                found, rest = _nothing(), np.ones(len(c_cells), bool)
                if (floor[rows] == -2.0).any():
                    found = _best(left.some(rows), right, columns(order[:first]), k, by_note, _nothing(), floor[rows])
                    floor[rows] = _reached(found, len(rows), k, floor[rows])
                    rest[order[:first]] = False
                rest &= np.cos(gaps) >= floor[rows].min() - ANGLE_SLACK
                blocks.append((rows, rest, found))
                pairs += len(rows) * int(sizes[rest].sum())
        parts = []
        if pairs > MOST_LEFT * len(left) * len(right):
            starts = range(0, len(left), block_rows)
            blocks = [(np.arange(start, min(start + block_rows, len(left))), None, _nothing()) for start in starts]
        for rows, rest, found in blocks:
            if rest is None or rest.any():
                chosen = range(len(right)) if rest is None else columns(rest)
                found = _best(left.some(rows), right, chosen, k, by_note, found, floor[rows])
            parts.append((rows[found[0]], found[1], found[2]))
        return _joined(corpus, parts, held, k, by_note)

    return search


def _strips(n_queries: int, n_corpus: int, dim: int) -> tuple[int, int]:
    """Parts of both sides, a task for each pair. A task holds its strip of queries and goes through that of the corpus, so
    the former is bounded; matches are ranked over the parts of the corpus, so these are few."""
    most = max(1, BLOCK_BYTES // (4 * max(dim, 1)))
    tasks = min(MOST_TASKS, math.ceil(max(1, n_queries * n_corpus / TASK_SCORES)))
    q_parts = max(min(MOST_STRIPS, math.ceil(math.sqrt(tasks) * 3), tasks), math.ceil(n_queries / most))
    return q_parts, math.ceil(tasks / q_parts)


def _packed(rows: DataFrame) -> DataFrame:
    """Each partition as a few large rows (name, block), each with a compressed table of about BLOCK_BYTES."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, waiting, size, made = TaskContext.get().partitionId(), [], 0, 0
        for last, batch in chain(((False, b) for b in batches), [(True, None)]):
            for start in range(0, len(batch) if batch else 0, PACK_ROWS):
                waiting.append(batch.slice(start, PACK_ROWS))
                size += waiting[-1].nbytes
                if size >= BLOCK_BYTES:
                    yield _block(f"{partition}-{made}", waiting)
                    waiting, size, made = [], 0, made + 1
            if last and waiting:
                yield _block(f"{partition}-{made}", waiting)

    return rows.mapInArrow(pack, "name string, block binary")


def _to_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _from_bytes(data) -> pa.Table:
    """A table; its paths are plain strings whatever Spark sends."""
    table = pa.ipc.open_stream(data).read_all()
    at = table.schema.get_field_index("path")
    return table.set_column(at, "path", table["path"].cast(pa.string()))


def _block(name: str, batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([_to_bytes(pa.Table.from_batches(batches))], pa.binary())], ["name", "block"])


def _search_strips(queries: DataFrame, corpus: DataFrame, search: _Search, strips: tuple[int, int]) -> DataFrame:
    """Every strip of the queries meets every strip of the corpus in a task of its own.

    Both sides are packed into blocks that are written once to the shared folder. A task reads the blocks of its strips from
    there, one of the corpus at a time, and hands on the best of all of them: no row is sent once per strip of the other side.
    """
    q_parts, c_parts = strips
    spark = queries.sparkSession
    asked = materialise(_packed(queries.repartition(q_parts)))
    searched = materialise(_packed(corpus))

    def compare(pairs: Iterator) -> Iterator[tuple[bytes]]:
        sides, held, name, block = {}, {}, None, None
        for (c_name, c_block), (q_name, q_block) in pairs:
            if q_name not in sides:
                sides[q_name], held[q_name] = _strip(_from_bytes(q_block)), None
            if c_name != name:
                name, block = c_name, _strip(_from_bytes(c_block))
            held[q_name] = search(sides[q_name], block, held[q_name])
        for q_name, found in held.items():
            yield (_to_bytes(_matched(sides[q_name].rows, found)),)

    found = searched.rdd.coalesce(c_parts).cartesian(asked.rdd).mapPartitions(compare)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0):
                yield from _from_bytes(block.as_py()).to_batches()

    return spark.createDataFrame(found, "found binary").mapInArrow(unpack, _FOUND)


def _seed_search(k: int, by_note: bool) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def search(key: tuple, queries: pa.Table, corpus: pa.Table) -> pa.Table:
        found = _best_rows(queries, corpus, k, by_note)
        cell, part = (pa.array(np.full(len(found), x.as_py(), dtype=np.int32)) for x in key[:2])
        return pa.table({"q_cell": cell, "q_part": part, **dict(zip(found.column_names, found.columns))})

    return search


def _rank(found: DataFrame, k: int, by_note: bool) -> DataFrame:
    """The k best of all block pairs. Spark cuts each task's share to k per query before shuffling."""
    order = [F.col("similarity").desc(), "similar_path"]
    if by_note:
        found = found.groupBy("path", "similar_path").agg(F.max("similarity").alias("similarity"))
    else:
        order.append("chunk_index")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("path").orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


def _sent(rows: DataFrame):
    """A side that was counted and is small, as a broadcast variable."""
    return rows.sparkSession.sparkContext.broadcast(_to_bytes(rows.toArrow()))


def _knn_small_corpus(queries: DataFrame, corpus: DataFrame, k: int, by_note: bool) -> DataFrame:
    """Each task has the whole corpus and answers its queries for good."""
    sent, search = _sent(corpus), _strip_search(k, by_note, BLOCK_ROWS)

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        everything = _strip(_from_bytes(sent.value))
        for batch in batches:
            asked = _strip(pa.Table.from_batches([batch]))
            yield from _matched(asked.rows, search(asked, everything, None)).combine_chunks().to_batches()

    return _rank(queries.mapInArrow(answers, _FOUND), k, by_note)


def _knn_small_queries(queries: DataFrame, corpus: DataFrame, k: int, by_note: bool) -> DataFrame:
    """Each task has all queries and keeps their k best of its part of the corpus."""
    sent, search = _sent(queries), _strip_search(k, by_note, BLOCK_ROWS)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, held = _strip(_from_bytes(sent.value)), None
        for batch in batches:
            held = search(wanted, _strip(pa.Table.from_batches([batch])), held)
        if held is not None:
            yield from _matched(wanted.rows, held).combine_chunks().to_batches()

    return _rank(corpus.mapInArrow(best, _FOUND), k, by_note)


def _part(parts: int | Column, *keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(parts) if isinstance(parts, int) else parts).cast("int")


def drop_surplus_copies(corpus: DataFrame, k: int) -> DataFrame:
    """Leave out copies of a vector that can never be among the k best of any query.

    Equal vectors score equally for every query, and ties go to the first path and chunk. So of each
    vector only the first k chunks of the first k + 1 notes matter (one note may be the query's own).
    Vectors that occur at most k times have no such copies; only the others, by a count of hashes, are moved.
    """
    number = F.xxhash64("embedding").alias("number")
    many = materialise(corpus.groupBy(number).count().where(F.col("count") > k).select("number"))
    if is_small(many):
        numbered, many = corpus.withColumn("number", number), F.broadcast(many)
        once = numbered.join(many, "number", "left_anti").drop("number")
        return once.unionByName(_first_copies(numbered.join(many, "number", "left_semi").drop("number"), k))
    return _first_copies(corpus, k)


def _first_copies(corpus: DataFrame, k: int) -> DataFrame:
    same_note = Window.partitionBy("embedding", "path").orderBy("chunk_index")
    same_vector = Window.partitionBy("embedding").orderBy("path")
    return (
        corpus.withColumn("nth_chunk", F.row_number().over(same_note))
        .where(F.col("nth_chunk") <= k)
        .withColumn("nth_note", F.dense_rank().over(same_vector))
        .where(F.col("nth_note") <= k + 1)
        .drop("nth_chunk", "nth_note")
    )


def _pivots(corpus: DataFrame, count: int) -> np.ndarray:
    """A fixed sample of at most MAX_PIVOTS vectors, small enough for the driver."""
    sample = corpus.orderBy(F.xxhash64("path", "chunk_index"), "path", "chunk_index").select("embedding").limit(count)
    units = unit_rows(sample.toArrow()["embedding"])
    return units[units.any(axis=1)] if len(units) else units


def _cells(rows: DataFrame, pivots: np.ndarray) -> tuple[DataFrame, dict[int, tuple[int, float]]]:
    """Rows with their cell, and (rows, radius) of each cell: one small record per pivot."""
    placed = rows.withColumn("place", nearest_pivot(pivots)(F.col("embedding")))
    placed = placed.select("*", "place.cell", "place.angle").drop("place")
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")).collect()
    return placed.drop("angle"), {r.cell: (r.n, r.radius) for r in sizes}


def _knn_indexed(
    queries: DataFrame, corpus: DataFrame, k: int, by_note: bool, block_rows: int, pivots: int, strips: tuple[int, int]
) -> DataFrame:
    centres = _pivots(corpus, pivots)
    if len(centres) == 0:
        return _search_strips(queries, corpus, _strip_search(k, by_note, block_rows), strips)
    queries, q_cells = _cells(queries, centres)
    corpus, c_cells = _cells(corpus, centres)
    radii = lambda cells: {c: radius for c, (_, radius) in cells.items()}
    sent = corpus.sparkSession.sparkContext.broadcast((centres, radii(q_cells), radii(c_cells)))  # the fields of Cells
    return _search_strips(queries, corpus, _cell_search(k, by_note, block_rows, sent), strips)


def knn_join(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 5,
    level: str = "chunk",
    method: str = "auto",
    block_rows: int | None = None,
    pivots: int | None = None,
    dim: int | None = None,
) -> DataFrame:
    """The k best matches in `corpus` (path, chunk_index, embedding) of each query (path, embedding).

    A note never matches itself. level="chunk" ranks chunks, so one note may take several places;
    level="note" ranks notes by their best chunk. `dim` is the length of usable vectors; others, and
    those that are NULL or zero, are left out (validate_embeddings counts them). Without `dim` all
    vectors of the corpus must have one length. Columns: path, similar_path, [chunk_index,] similarity, rank.

    method: "small_corpus" and "small_queries" broadcast that side, "blocked" compares all pairs of
    blocks, "indexed" leaves out those that cannot matter, "auto" picks by the counted inputs.
    """
    methods = ("auto", "small_corpus", "small_queries", "blocked", "indexed")
    if level not in ("chunk", "note") or method not in methods:
        raise ValueError(f"unknown level {level!r} or method {method!r}")
    by_note = level == "note"
    size = F.size("embedding")
    seen = corpus.where(F.col("embedding").isNotNull()).agg(
        F.min(size).alias("least"), F.max(size).alias("most"), F.count_if(size == (dim or size)).alias("n")
    ).first()
    if dim is None and seen.least != seen.most:
        raise ValueError(f"vectors of {seen.least} to {seen.most} numbers: say which length counts with dim=")
    dim, n_corpus = dim or seen.most or 1, seen.n
    n_queries = queries.count()
    usable = F.size("embedding") == dim
    # Aliases keep the two sides apart where both come from one table.
    queries = queries.where(usable).select(F.col("path").alias("path"), F.col("embedding").alias("embedding"))
    corpus = corpus.where(usable).select("path", F.col("chunk_index").cast("int"), "embedding")

    if method == "auto":
        fits = lambda rows: rows * max(dim, 1) * 8 <= BROADCAST_BYTES
        method = (
            "small_corpus" if fits(n_corpus)
            else "small_queries" if fits(n_queries)
            else "indexed" if n_queries * n_corpus > INDEX_SCORES
            else "blocked"
        )
    strips = _strips(n_queries, n_corpus, dim)
    if method == "small_corpus":
        result = _knn_small_corpus(queries, corpus, k, by_note)
    elif method == "small_queries":
        result = _knn_small_queries(queries, corpus, k, by_note)
    else:
        corpus, block_rows = drop_surplus_copies(corpus, k), block_rows or BLOCK_ROWS
        if method == "indexed":
            pivots = min(pivots or math.ceil(n_corpus / FIRST_ROWS), MAX_PIVOTS)
            found = _knn_indexed(queries, corpus, k, by_note, block_rows, max(1, pivots), strips)
        else:
            found = _search_strips(queries, corpus, _strip_search(k, by_note, block_rows), strips)
        result = _rank(found, k, by_note)
    if by_note:
        result = result.drop("chunk_index")
    return result
