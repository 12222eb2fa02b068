"""Quality classifier: an additive model of lookup tables, one per feature and one per chosen pair of features.

The tables are learned by boosting that goes through the features in turn: each turn fits a shallow tree to the
gradient over the bins of one feature (or over the grid of a pair) and adds a small part of it to the table.
Scoring adds up table entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from notegraph.llm.common import BLANK_BYTES, hashes, held_out, sliced, spans, utf8

#: Labelled rows that the model is fitted on at most, chosen by a hash of the id.
TRAINING_ROWS = 20_000
BINS, GRID, PAIRS, ROUNDS, PAIR_ROUNDS, RATE = 48, 12, 4, 120, 60, 0.1
FEATURES = (
    "length words letters digits marks signs bars upper lines word_length word_spread line_length distinct_words "
    "repeated_lines top_byte words_with_signs"
).split()


def _bytes_in(text: str) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(text.encode())] = True
    return found


SIGNS = _bytes_in("#$%&*@^~<>{}[]\\/=+_`|")
MARKS = _bytes_in(".,;:!?'\"-()")
LETTERS = np.array([chr(x).isalpha() or x >= 0x80 for x in range(256)])
CLASSES = np.stack([LETTERS, _bytes_in("0123456789"), MARKS, SIGNS, _bytes_in("|"), _bytes_in("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _bytes_in("\n")])
NEWLINE = _bytes_in("\n")


def features(column: pa.Array) -> np.ndarray:
    """One row of numbers per text, from the whole text; a null text counts as empty and gives zeros."""
    data, offsets = utf8(column)
    n = len(offsets) - 1
    size = np.diff(offsets)
    histogram = np.stack([np.bincount(data[a:b], minlength=256) for a, b in zip(offsets[:-1], offsets[1:])]) if n else np.zeros((0, 256))
    share = histogram @ CLASSES.T / np.maximum(size, 1)[:, None]
    starts, lengths, rows = spans(data, offsets, BLANK_BYTES)
    words = np.bincount(rows, minlength=n)
    some = np.maximum(words, 1)
    mean = np.bincount(rows, lengths, n) / some
    spread = np.sqrt(np.maximum(np.bincount(rows, lengths.astype(float) ** 2, n) / some - mean**2, 0))
    signs = np.r_[0, np.cumsum(SIGNS[data])]
    signed = np.bincount(rows, signs[starts + lengths] > signs[starts], n) / some

    def distinct(starts: np.ndarray, lengths: np.ndarray, rows: np.ndarray) -> np.ndarray:
        # Rows are in order already, so a sort by hash and then a stable one by row finds equal neighbours.
        found = hashes(data, starts, lengths)
        order = np.lexsort((found, rows))
        new = np.r_[True, (found[order][1:] != found[order][:-1]) | (rows[order][1:] != rows[order][:-1])][: len(rows)]
        return np.bincount(rows[order][new], minlength=n)

    line_starts, line_lengths, line_rows = spans(data, offsets, NEWLINE)
    lines = np.maximum(np.bincount(line_rows, minlength=n), 1)
    visible = histogram.copy()
    visible[:, BLANK_BYTES] = 0
    columns = [
        np.log1p(size), np.log1p(words), *share.T[:6], share[:, 6], mean, spread, np.log1p(size / lines),
        distinct(starts, lengths, rows) / some, 1 - distinct(line_starts, line_lengths, line_rows) / lines,
        visible.max(1, initial=0) / np.maximum(size, 1), signed,
    ]
    found = np.stack(columns, 1) if n else np.zeros((0, len(columns)))
    return np.where(size[:, None] > 0, found, 0.0)


@dataclass
class Additive:
    """Lookup tables on binned features: score = 1 / (1 + exp(-(base + entries)))."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grid_edges: list[np.ndarray] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for k, (edges, values) in enumerate(zip(self.edges, self.tables)):
            total += values[np.searchsorted(edges, x[:, k], "right")]
        for (i, j), values in zip(self.pairs, self.grids):
            total += values[
                np.searchsorted(self.grid_edges[i], x[:, i], "right"), np.searchsorted(self.grid_edges[j], x[:, j], "right")
            ]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _step(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree with at most three leaves over ordered bins: the step of each bin."""
    cuts, leaves = [0, len(g)], 1
    while leaves < 3:
        best = (1e-6, 0)
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b - a > 1:
                gl, hl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
                gs, hs = g[a:b].sum(), h[a:b].sum()
                gain = _gain(gl, hl) + _gain(gs - gl, hs - hl) - _gain(gs, hs)
                at = int(gain.argmax())
                best = max(best, (float(gain[at]), a + at + 1))
        if not best[1]:
            break
        cuts, leaves = sorted([*cuts, best[1]]), leaves + 1
    out = np.zeros(len(g))
    for a, b in zip(cuts[:-1], cuts[1:]):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return out


def _grid_step(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """A tree of one cut along each axis (four leaves) over a grid: the step of each cell, and its gain."""
    gc, hc = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    gain = np.zeros((g.shape[0] - 1, g.shape[1] - 1))
    if not gain.size:
        return np.zeros(g.shape), 0.0
    for total_g, total_h, sign in ((gc, hc, 1),):
        a, ah = total_g[:-1, :-1], total_h[:-1, :-1]
        b, bh = total_g[:-1, -1:] - a, total_h[:-1, -1:] - ah
        c, ch = total_g[-1:, :-1] - a, total_h[-1:, :-1] - ah
        d, dh = total_g[-1, -1] - a - b - c, total_h[-1, -1] - ah - bh - ch
        gain = _gain(a, ah) + _gain(b, bh) + _gain(c, ch) + _gain(d, dh) - _gain(total_g[-1, -1], total_h[-1, -1])
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.zeros(g.shape)
    for rows in (slice(0, i + 1), slice(i + 1, None)):
        for cols in (slice(0, j + 1), slice(j + 1, None)):
            out[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + 1.0)
    return out, float(gain[i, j])


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    """Learns the tables. Without rows, or with one label only, the model is the smoothed share of label 1."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = Additive(base=float(np.log(share / (1 - share))))
    if len(y) == 0 or y.min() == y.max():
        return model
    k = x.shape[1]
    model.edges = [_cuts(x[:, i], BINS) for i in range(k)]
    model.grid_edges = [_cuts(x[:, i], GRID) for i in range(k)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = [np.searchsorted(e, x[:, i], "right") for i, e in enumerate(model.edges)]
    cells = [np.searchsorted(e, x[:, i], "right") for i, e in enumerate(model.grid_edges)]
    total = np.full(len(y), model.base)

    def gradient(at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return np.bincount(at, y - p, size), np.bincount(at, p * (1 - p), size)

    for _ in range(ROUNDS):
        for i in range(k):
            step = RATE * _step(*gradient(bins[i], len(model.tables[i])))
            model.tables[i] += step
            total += step[bins[i]]

    def cell(i: int, j: int) -> tuple[np.ndarray, tuple[int, int]]:
        shape = (len(model.grid_edges[i]) + 1, len(model.grid_edges[j]) + 1)
        return cells[i] * shape[1] + cells[j], shape

    gains = []
    for i in range(k):
        for j in range(i + 1, k):
            at, shape = cell(i, j)
            g, h = gradient(at, shape[0] * shape[1])
            gains.append((_grid_step(g.reshape(shape), h.reshape(shape))[1], i, j))
    model.pairs = [(i, j) for gain, i, j in sorted(gains, reverse=True)[:PAIRS] if gain > 0]
    model.grids = [np.zeros(cell(i, j)[1]) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for values, (i, j) in zip(model.grids, model.pairs):
            at, shape = cell(i, j)
            g, h = gradient(at, shape[0] * shape[1])
            step = RATE * _grid_step(g.reshape(shape), h.reshape(shape))[0]
            values += step
            total += step.ravel()[at]
    return model


def training_rows(labels: DataFrame, label: str, divisor: int, remainder: int, rows: int) -> DataFrame:
    """At most `rows` labelled ids (doc_id, label) that may be learned from, chosen by a hash of the id."""
    ids = labels.where(F.col(label).isNotNull() & ~held_out(F.col("doc_id"), divisor, remainder))
    ids = ids.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def train(documents: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> Additive:
    """The model of `labels.quality`, from rows whose crc32 of the id leaves 0 or 2 of 3. Bounded by `rows`."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            x = features(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))],
                ["label", "x"],
            )

    chosen = training_rows(labels, "quality", 3, 1, rows)
    found = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("label", "text")
    table = found.mapInArrow(measure, "label int, x array<double>").toArrow()
    x = np.array(table["x"].to_pylist(), float).reshape(-1, len(FEATURES))
    y = table["label"].to_numpy().astype(float)
    order = np.lexsort((*x.T, y))
    return fit(x[order], y[order])


def score_quality(documents: DataFrame, model: Additive, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keep` columns with score and predicted for every row. Null and empty texts are scored as zeros."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            s = held.value.score(features(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*keep, "score", "predicted"]
            )

    chosen = documents.select(*dict.fromkeys([*keep, "text"]))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*keep).schema)
    return chosen.mapInArrow(score, f"{kinds}, score double, predicted int")


def keep_good(documents: DataFrame, model: Additive) -> DataFrame:
    """The documents with a score of 0.5 or more, all columns as they are, whatever their names. Each row is judged by
    its text alone, so rows that are repeated stay or go together; null and empty texts are judged as zeros."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            yield batch.filter(pa.array(held.value.score(features(batch.column("text"))) >= 0.5))

    return documents.mapInArrow(judge, documents.schema)
