"""Toxicity: a bidirectional gated recurrent network over words, with attention pooling, trained in numpy.

A word enters as an embedding of the word and the mean embedding of its character runs. Overlapping windows of words
are scored, and a text has the score of its highest window. Labels belong to texts, so after a first round over all
windows training goes on with the highest window of each text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from notegraph.llm.common import LOWER_BYTES, hashes, held_out, ragged, sliced, spans, utf8

#: Labelled texts that the model is trained on at most, and windows of one text.
POSITIVES, NEGATIVES, WINDOWS_PER_TEXT = 1500, 2500, 24
WIDTH, STRIDE = 64, 54
HIDDEN, DIM, WORDS, GRAMS = 8, 8, 1 << 15, 1 << 14
ROUNDS, BATCH, RATE = 5, 128, 0.01
#: Bytes outside words: ASCII other than letters and digits.
OUTSIDE = np.array([x < 128 and not chr(x).isalnum() for x in range(256)])


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Words of all texts: number of the word among different ones, row; and of the different ones the buckets of the
    word and of its character runs (with their word's number)."""
    data, offsets = utf8(column)
    data = LOWER_BYTES[data]
    starts, lengths, rows = spans(data, offsets, OUTSIDE)
    found, first, codes = np.unique(hashes(data, starts, lengths), return_index=True, return_inverse=True)
    starts, lengths = starts[first], lengths[first]
    # Each word between a 1 and a 2; runs of three bytes, and the first five.
    size = lengths + 2
    place = np.cumsum(size) - size
    padded = np.zeros(int(size.sum()) + 3, np.uint64)
    padded[ragged(place + 1, lengths)] = data[ragged(starts, lengths)]
    padded[place], padded[place + size - 1] = 1, 2
    at = ragged(place, lengths)
    three = (padded[at] << np.uint64(16)) | (padded[at + 1] << np.uint64(8)) | padded[at + 2]
    head = np.zeros(len(place), np.uint64)
    for k in range(5):
        head = head * np.uint64(257) + np.where(k < lengths, padded[place + np.minimum(k, lengths - 1) + 1], 0)
    grams = np.r_[three, head | np.uint64(1 << 60)] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 14)
    owners = np.r_[np.repeat(np.arange(len(place)), lengths), np.arange(len(place))]
    return codes, rows, (found % np.uint64(WORDS)).astype(np.int64), (grams.astype(np.int64), owners)


def windows_of(rows: np.ndarray, n_rows: int, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping windows that cover all words of each row: first word, length, row. With `most`, evenly chosen."""
    counts = np.bincount(rows, minlength=n_rows)
    first = np.cumsum(counts) - counts
    per_row = np.where(counts > 0, np.maximum(1, -(-(counts - WIDTH) // STRIDE) + 1), 0)
    owner = np.repeat(np.arange(n_rows), per_row)
    k = ragged(np.zeros(n_rows, np.int64), per_row)
    if most is not None:
        keep = (k * most) // np.maximum(per_row[owner], most) != ((k - 1) * most) // np.maximum(per_row[owner], most)
        owner, k = owner[keep], k[keep]
    # The last window ends with the text.
    start = np.minimum(k * STRIDE, np.maximum(counts[owner] - WIDTH, 0))
    return first[owner] + start, np.minimum(counts[owner], WIDTH), owner


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters by name, float32."""

    def __init__(self, seed: int = 7):
        r = np.random.Generator(np.random.PCG64(seed))

        def normal(scale: float, *shape: int) -> np.ndarray:
            return (scale * r.standard_normal(shape)).astype(np.float32)

        h = HIDDEN
        self.p = {"words": normal(0.05, WORDS, DIM), "grams": normal(0.3, GRAMS, DIM)}
        for d in ("f", "b"):
            self.p |= {f"x{d}": normal(0.4, 2 * DIM, 3 * h), f"c{d}": np.zeros(3 * h, np.float32), f"u{d}": normal(0.3, h, 3 * h)}
        self.p |= {"v": normal(0.3, 2 * h), "w": normal(0.3, 2 * h), "b": np.array([-1.0], np.float32)}

    def inputs(self, words: np.ndarray, grams: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """One row per different word: its own embedding beside the mean of its character runs' ones."""
        ids, owners = grams
        n = len(words)
        counts = np.maximum(np.bincount(owners, minlength=n), 1)
        held = self.p["grams"][ids]
        chars = np.stack([np.bincount(owners, held[:, k], n) for k in range(DIM)], 1) / counts[:, None] if n else np.zeros((0, DIM))
        return np.concatenate([self.p["words"][words], chars], 1).astype(np.float32)

    def forward(self, x: np.ndarray, codes: np.ndarray, start: np.ndarray, length: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows. x: rows of `inputs`; codes: the words of all texts. keep: gets what training needs."""
        steps = int(length.max(initial=1))
        at = np.minimum(start[None, :] + np.arange(steps)[:, None], max(len(codes) - 1, 0))
        used = (np.arange(steps)[:, None] < length[None, :])[:, :, None]
        word = codes[at]
        full = bool(used.all())
        h, n = HIDDEN, len(start)
        states = np.zeros((steps, n, 2 * h), np.float32)
        trace = []
        for k, d in enumerate("fb"):
            projected = x @ self.p[f"x{d}"] + self.p[f"c{d}"]
            u = self.p[f"u{d}"]
            state = np.zeros((n, h), np.float32)
            for t in range(steps) if d == "f" else reversed(range(steps)):
                a = projected[word[t]]
                zr = _sigmoid(a[:, : 2 * h] + state @ u[:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                rs = r * state
                new = np.tanh(a[:, 2 * h :] + rs @ u[:, 2 * h :])
                if keep is not None:
                    trace.append((d, t, state, z, r, rs, new))
                following = state + z * (new - state)
                state = following if full else np.where(used[t], following, state)
                states[t, :, k * h : (k + 1) * h] = state
        e = states @ self.p["v"]
        e = np.where(used[:, :, 0], e, -1e9)
        weight = np.exp(e - e.max(0))
        weight *= used[:, :, 0]
        weight /= np.maximum(weight.sum(0), 1e-9)
        pooled = np.einsum("tn,tnk->nk", weight, states)
        if keep is not None:
            keep |= {"word": word, "used": used, "states": states, "trace": trace, "weight": weight, "pooled": pooled}
        return pooled @ self.p["w"] + self.p["b"][0]

    def gradients(self, x: np.ndarray, slope: np.ndarray, keep: dict) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of parameters and of the rows of x, given the slope of the loss by each logit."""
        h = HIDDEN
        states, weight, used, word = keep["states"], keep["weight"], keep["used"], keep["word"]
        g = {"w": slope @ keep["pooled"], "b": np.array([slope.sum()], np.float32)}
        d_pooled = slope[:, None] * self.p["w"]
        d_states = weight[:, :, None] * d_pooled
        d_weight = np.einsum("tnk,nk->tn", states, d_pooled)
        d_e = weight * (d_weight - (weight * d_weight).sum(0))
        g["v"] = np.einsum("tn,tnk->k", d_e, states)
        d_states += d_e[:, :, None] * self.p["v"]
        d_x = np.zeros_like(x)
        for k, d in enumerate("fb"):
            u = self.p[f"u{d}"]
            g[f"u{d}"] = np.zeros_like(u)
            d_projected = np.zeros((len(x), 3 * h), np.float32)
            back = np.zeros(states.shape[1:2] + (h,), np.float32)
            for way, t, state, z, r, rs, new in reversed(keep["trace"]):
                if way != d:
                    continue
                total = back + d_states[t, :, k * h : (k + 1) * h]
                real = total * used[t]
                d_new = real * z * (1 - new * new)
                d_z = real * (new - state) * z * (1 - z)
                d_rs = d_new @ u[:, 2 * h :].T
                d_r = d_rs * state * r * (1 - r)
                d_zr = np.concatenate([d_z, d_r], 1)
                g[f"u{d}"][:, : 2 * h] += state.T @ d_zr
                g[f"u{d}"][:, 2 * h :] += rs.T @ d_new
                back = total - real + real * (1 - z) + d_rs * r + d_zr @ u[:, : 2 * h].T
                np.add.at(d_projected, word[t], np.concatenate([d_zr, d_new], 1))
            g[f"x{d}"], g[f"c{d}"] = x.T @ d_projected, d_projected.sum(0)
            d_x += d_projected @ self.p[f"x{d}"].T
        return g, d_x


class Adam:
    def __init__(self, p: dict[str, np.ndarray]):
        self.p, self.t = p, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.s = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, g: dict[str, np.ndarray], rate: float) -> None:
        self.t += 1
        for k, d in g.items():
            self.m[k] += 0.1 * (d - self.m[k])
            self.s[k] += 0.01 * (d * d - self.s[k])
            scale = rate * np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t)
            self.p[k] -= (scale * self.m[k] / (np.sqrt(self.s[k]) + 1e-8)).astype(np.float32)


def train_network(texts: list[str], owners: np.ndarray, labels: np.ndarray) -> Network:
    """texts: windows of labelled texts; owners: the text each belongs to (from 0); labels: one per text.

    Without texts, or with one label only, the network is left as it starts.
    """
    network = Network()
    if not len(texts) or labels.min() == labels.max():
        return network
    codes, rows, words, grams = words_of(pa.array(texts))
    counts = np.bincount(rows, minlength=len(texts))
    start, length = np.cumsum(counts) - counts, np.minimum(counts, WIDTH)
    some = np.flatnonzero(length > 0)
    order = np.argsort(grams[1], kind="stable")
    gram_ids, gram_ends = grams[0][order], np.r_[0, np.cumsum(np.bincount(grams[1], minlength=len(words)))]
    adam, r = Adam(network.p), np.random.Generator(np.random.PCG64(11))
    target = labels[owners].astype(np.float32)
    for turn in range(ROUNDS):
        if turn == 0:
            chosen = r.permutation(some)[:8000]
        else:
            x = network.inputs(words, grams)
            logits = np.full(len(texts), -1e9)
            for part in np.array_split(some, max(1, len(some) // 1024)):
                logits[part] = network.forward(x, codes, start[part], length[part])
            best = np.lexsort((logits, owners))
            best = best[np.r_[owners[best][1:] != owners[best][:-1], True]]
            other = r.permutation(some[target[some] == 0])[: len(labels) // 2]
            chosen = r.permutation(np.r_[best[length[best] > 0], other])
        rate = RATE * (1 if turn < ROUNDS - 2 else 0.3)
        # Few windows make small batches, so that there are enough steps.
        for part in np.array_split(chosen, max(1, len(chosen) // min(BATCH, max(4, len(chosen) // 60)))):
            # Only the words of this batch take part.
            inner = ragged(start[part], length[part])
            used, local = np.unique(codes[inner], return_inverse=True)
            gram_counts = gram_ends[used + 1] - gram_ends[used]
            ids = gram_ids[ragged(gram_ends[used], gram_counts)]
            own = np.repeat(np.arange(len(used)), gram_counts)
            x = network.inputs(words[used], (ids, own))
            first = np.cumsum(length[part]) - length[part]
            keep: dict = {}
            p = _sigmoid(network.forward(x, local, first, length[part], keep))
            g, d_x = network.gradients(x, (p - target[part]).astype(np.float32) / len(part), keep)
            g["words"], g["grams"] = np.zeros_like(network.p["words"]), np.zeros_like(network.p["grams"])
            np.add.at(g["words"], words[used], d_x[:, :DIM])
            np.add.at(g["grams"], ids, (d_x[:, DIM:] / np.maximum(gram_counts, 1)[:, None])[own])
            adam.step(g, rate)
    return network


def train(documents: DataFrame, labels: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> Network:
    """The network of `labels.toxic`, from rows whose crc32 of the id does not leave 2 of 4.

    At most `positives` and `negatives` texts are used, chosen by a hash of the id, and of each text at most
    WINDOWS_PER_TEXT windows, evenly spread. This bounds what the driver gets.
    """
    ids = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"), 4, 2)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = ids.where("label = 1").orderBy(*order).limit(positives).unionByName(ids.where("label <> 1").orderBy(*order).limit(negatives))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            data, offsets = utf8(batch.column("text"))
            starts, lengths, rows = spans(LOWER_BYTES[data], offsets, OUTSIDE)
            first, n, owner = windows_of(rows, batch.num_rows, WINDOWS_PER_TEXT)
            texts = [data[starts[a] : starts[a + k - 1] + lengths[a + k - 1]].tobytes().decode() for a, k in zip(first, n)]
            taken = batch.select(["doc_id", "label"]).take(pa.array(owner))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(first), pa.array(texts, pa.string())], ["doc_id", "label", "place", "window"])

    found = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = found.mapInArrow(cut, f"doc_id {kind}, label int, place bigint, window string").toArrow().to_pandas()
    rows = rows.sort_values(["doc_id", "place", "window"])
    ids, owners = np.unique(rows["doc_id"].to_numpy(), return_inverse=True)
    target = np.zeros(len(ids), np.int64)
    target[owners] = rows["label"].to_numpy()
    return train_network(rows["window"].tolist(), owners, target)


def scores(network: Network, column: pa.Array) -> np.ndarray:
    """The highest score of the overlapping windows of each text; a text without words has that of no input."""
    codes, rows, words, grams = words_of(column)
    x = network.inputs(words, grams)
    first, length, owner = windows_of(rows, len(column))
    logits = np.full(len(column), -np.inf)
    order = np.argsort(-length, kind="stable")
    for at in range(0, len(order), 1024):
        part = order[at : at + 1024]
        np.maximum.at(logits, owner[part], network.forward(x, codes, first[part], length[part]))
    logits[np.isinf(logits)] = network.p["b"][0]
    return _sigmoid(logits)


def score_toxicity(documents: DataFrame, network: Network, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted for every row, whole texts; null and empty texts are scored as texts without words."""
    held = documents.sparkSession.sparkContext.broadcast(network)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            s = scores(held.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, score double, predicted int")
