"""Best-fit packing by exact complements: documents become token pieces, pieces fill sequences of a fixed size.

How pieces are packed depends on the number of pieces of each length only. These counts (one per possible length)
go to the driver; the plan made there is a list of runs "so many sequences of these lengths", at most a few
thousand. Every piece then finds its place by its length and its number among the pieces of that length.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from notegraph.llm.common import ragged, shared_checkpoint, sliced, utf8

CAPACITY = 1024
END_ID = 2
SPECIAL = "<|endoftext|>"
#: Words whose ids a Python worker keeps; beyond it the store starts anew.
KEPT_WORDS = 250_000
#: Words that are tokenized in one text.
JOINED = 200
#: White space of the tokenizer's pattern, below U+10000.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
LETTER, NUMBER, OTHER, SPACE = 1, 2, 3, 4


class WordIds:
    """Ids of texts by way of their words: a word that was met before is not tokenized again."""

    def __init__(self, path: str):
        import unicodedata

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        kinds = {"L": LETTER, "N": NUMBER}
        self.kinds = np.array([kinds.get(unicodedata.category(chr(x))[0], OTHER) for x in range(0x10000)], np.uint8)
        self.kinds[WHITE] = SPACE
        self.bytes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for word, k in self.tokenizer.get_vocab().items():
            self.bytes[k] = len(word)  # one sign of the vocabulary stands for one byte
        self.clear()

    def clear(self) -> None:
        self.places: dict[str, int] = {}
        self.ids, self.ends = array("I"), array("Q", [0])

    def words(self, points: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Which code points start a word as the tokenizer cuts them; rows: where each text starts, and the end.

        A space before a run of letters, of numbers or of other signs belongs to it. The last of several white
        characters before such a run stands alone or goes to it. An apostrophe takes s, t, re, ve, m, ll, d.
        """
        kind = self.kinds[points]
        first = np.zeros(len(points) + 1, bool)
        first[rows] = True
        white, blank = kind == SPACE, points == 32
        after_blank = np.r_[False, blank[:-1]] & ~first[:-1]
        run = np.r_[True, kind[1:] != kind[:-1]] | first[:-1]
        last_white = white & ~np.r_[white[1:], True] & ~first[1:]
        starts = first[:-1] | (run & (white | ~after_blank)) | last_white
        quotes = np.flatnonzero((points == 39) & run & ~after_blank)
        quotes = quotes[quotes + 1 < len(points)]
        quotes = quotes[(kind[quotes + 1] == LETTER) & ~first[quotes + 1]]
        for tail in ("s", "t", "m", "d", "re", "ve", "ll"):
            at, fits = quotes, np.ones(len(quotes), bool)
            for k, letter in enumerate(tail, 1):
                inside = np.minimum(at + k, len(points) - 1)
                fits &= (at + k < len(points)) & (points[inside] == ord(letter)) & ~first[inside]
            at = at[fits]
            starts[at + 1] = False
            end = at + 1 + len(tail)
            end = end[end < len(points)]
            starts[end[kind[end] == LETTER]] = True
        return starts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and how many each text has."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = pc.match_substring(texts, SPECIAL).to_numpy(zero_copy_only=False)
        data, offsets = utf8(texts)
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        place = np.r_[0, np.cumsum(width)]
        rows = np.searchsorted(place, offsets)
        high = np.flatnonzero(points >= 0x10000)
        whole[np.unique(np.searchsorted(rows, high, "right") - 1)] = True
        starts = np.flatnonzero(self.words(np.where(points < 0x10000, points, 0xFFFF), rows))
        words = pa.LargeStringArray.from_buffers(
            len(starts), pa.py_buffer(np.r_[place[starts], offsets[-1]].astype(np.int64)), pa.py_buffer(data.tobytes())
        ).dictionary_encode()
        known = self.known(words.dictionary.to_numpy(zero_copy_only=False))
        held = known[words.indices.to_numpy()]
        ids, ends = np.frombuffer(self.ids, np.uint32), np.frombuffer(self.ends, np.uint64).astype(np.int64)
        lengths = ends[held + 1] - ends[held]
        flat = ids[ragged(ends[held], lengths)]
        cut = np.r_[0, np.cumsum(lengths)][np.searchsorted(starts, rows)]
        counts = np.diff(cut)
        if whole.any():
            parts = [flat[cut[i] : cut[i + 1]] for i in range(len(texts))]
            for i in np.flatnonzero(whole):
                parts[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
            flat, counts = np.concatenate(parts), np.array([len(x) for x in parts])
        return flat, counts

    def known(self, words: np.ndarray) -> np.ndarray:
        found = np.fromiter((self.places.get(x, -1) for x in words), np.int64, len(words))
        missing = np.flatnonzero(found < 0)
        if len(self.places) + len(missing) > KEPT_WORDS and self.places:
            self.clear()
            missing = np.arange(len(words))
        places = self.places
        if not len(missing):
            return found
        new = words[missing].tolist()
        plain = np.fromiter((x[0] == " " and x[1:].isalpha() for x in new), bool, len(new))
        order = [*np.flatnonzero(plain).tolist(), *np.flatnonzero(~plain).tolist()]
        at = int(plain.sum())
        runs = [[new[i] for i in order[k : min(k + JOINED, at)]] for k in range(0, at, JOINED)]
        # Words of a space and letters are cut apart again wherever they stand, so many can go in one text.
        encoded = self.tokenizer.encode_batch_fast([*map("".join, runs), *(new[i] for i in order[at:])], add_special_tokens=False)
        lengths = []
        for run, ids in zip(runs, encoded):
            ends = np.cumsum([len(x.encode()) for x in run])
            cut = np.searchsorted(np.cumsum(self.bytes[ids.ids]), ends, "right")
            lengths.append(np.diff(cut, prepend=0))
        lengths.append(np.array([len(x.ids) for x in encoded[len(runs) :]], np.int64))
        added = np.cumsum(np.concatenate(lengths)) + len(self.ids)
        first = len(self.ends) - 1
        self.ends.frombytes(added.astype(np.uint64).tobytes())
        self.ids.extend(chain.from_iterable(x.ids for x in encoded))
        places.update(zip((new[i] for i in order), range(first, first + len(order))))
        found[missing[order]] = np.arange(first, first + len(order))
        return found


_stores: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _stores:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        _stores[path] = WordIds(path)
    return _stores[path]


def token_pieces(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The token pieces of every document: doc_id, piece, start, length, ids_crc32.

    Only documents longer than the capacity are cut; their first piece holds what is over and may be shorter.
    A null or empty text is the end id alone. Rows that repeat an id are packed each for itself.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = word_ids(tokenizer)
        for batch in sliced(batches, "text"):
            flat, counts = store.encode(batch.column("text"))
            at, row, piece, start, length, crc = 0, [], [], [], [], []
            for i, n in enumerate(counts.tolist()):
                ids = np.empty(n + 1, "<u4")
                ids[:n], ids[n] = flat[at : at + n], end_id
                at, raw, begin, size = at + n, ids.tobytes(), 0, (n + 1) % capacity or capacity
                for k in range(-(-(n + 1) // capacity)):
                    row.append(i)
                    piece.append(k)
                    start.append(begin)
                    length.append(size)
                    crc.append(zlib.crc32(raw[4 * begin : 4 * (begin + size)]))
                    begin, size = begin + size, capacity
            doc = batch.column("doc_id").take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [doc, pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    return documents.select("doc_id", "text").mapInArrow(cut, schema)


def packing_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """Runs (times, lengths): so many sequences hold pieces of these lengths. Uses every piece once.

    First come combinations that fill a sequence exactly: for each length, from the longest, the gap is looked up
    among single lengths, sums of two and sums of three, as far as pieces of all of them are left. What remains is
    packed by best fit: the longest piece opens a sequence, and the longest that still fits follows.
    """
    left = [0] * (capacity + 1)
    for length, n in counts.items():
        left[length] = n
    runs: list[tuple[int, tuple[int, ...]]] = []

    def sums() -> int:
        """Bit s is set if two pieces that are left have the lengths' sum s."""
        have = sum(1 << n for n in range(1, capacity) if left[n])
        both = 0
        for n in range(1, capacity):
            if left[n]:
                both |= (have if left[n] > 1 else have & ~(1 << n)) << n
        return both

    def pair(total: int) -> tuple[int, ...]:
        for long in range(total - 1, (total - 1) // 2, -1):
            short = total - long
            if left[long] and left[short] and (long != short or left[long] > 1):
                return long, short
        return ()

    def complement(gap: int, two: int) -> tuple[int, ...]:
        if left[gap]:
            return (gap,)
        if two >> gap & 1 and (found := pair(gap)):
            return found
        for third in range(gap - 2, 0, -1):
            if left[third] and two >> (gap - third) & 1:
                left[third] -= 1
                found = pair(gap - third)
                left[third] += 1
                if found:
                    return third, *found
        return ()

    def use(lengths: tuple[int, ...]) -> None:
        need = Counter(lengths)
        times = min(left[n] // k for n, k in need.items())
        for n, k in need.items():
            left[n] -= k * times
        runs.append((times, lengths))

    if left[capacity]:
        use((capacity,))
    for length in range(capacity - 1, 0, -1):
        while left[length]:
            left[length] -= 1
            found = complement(capacity - length, sums())
            left[length] += 1
            if not found:
                break
            use((length, *found))
    for length in range(capacity, 0, -1):
        open_runs = [(left[length], (length,), capacity - length)] if left[length] else []
        left[length] = 0
        while open_runs:
            times, lengths, gap = open_runs.pop()
            fit = next((n for n in range(gap, 0, -1) if left[n]), 0)
            if not fit:
                runs.append((times, lengths))
                continue
            each = min(gap // fit, max(1, left[fit] // times))
            filled = min(times, left[fit] // each)
            left[fit] -= filled * each
            open_runs.append((filled, lengths + (fit,) * each, gap - fit * each))
            if filled < times:
                open_runs.append((times - filled, lengths, gap))
    return runs


def plan_slots(runs: Iterable[tuple[int, tuple[int, ...]]]) -> dict[int, np.ndarray]:
    """For each length, rows (first number, first sequence, offset): where its pieces go, by their numbers."""
    taken: Counter = Counter()
    slots: dict[int, list] = {}
    sequence = 0
    for times, lengths in runs:
        offset = 0
        for n in lengths:
            slots.setdefault(n, []).append((taken[n], sequence, offset))
            taken[n] += times
            offset += n
        sequence += times
    return {n: np.array(rows, np.int64) for n, rows in slots.items()}


def pack(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece; no rows for an empty table.

    Pieces of one length are alike, so ties are settled by any numbering; here it goes by part and doc_id.
    """
    pieces = shared_checkpoint(token_pieces(documents, tokenizer, capacity, end_id).withColumn("part", F.spark_partition_id()))
    groups = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = documents.sparkSession.sparkContext.broadcast(plan_slots(packing_plan(counts, capacity)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = groups.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start")
    numbered = pieces.withColumn("number", F.row_number().over(within)).join(before, ["length", "part"])
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    numbered = numbered.select(*columns, (F.col("before") + F.col("number") - 1).alias("number"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(x).to_numpy() for x in ("length", "number"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                rows = slots.value[int(length[part[0]])]
                row = rows[np.searchsorted(rows[:, 0], number[part], "right") - 1]
                sequence[part], offset[part] = row[:, 1] + number[part] - row[:, 0], row[:, 2]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(x) for x in columns), pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"]
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return numbered.mapInArrow(
        place, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    )
