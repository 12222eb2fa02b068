import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from notegraph.llm.packing import pack, packing_plan, word_ids
from helpers import CLASHING, awkward

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_ids_are_the_tokenizers(tmp_path):
    store = word_ids(PATH)
    r = random.Random(1)
    signs = [*"abst dre vm'l 's're'' \n\t 12٣é漢😀.,-_ #  \x1c'  ", "<|endoftext|>", " the", "ing"]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 40))) for _ in range(3000)] + [None, "", "x" * 5000]
    flat, counts = store.encode(pa.array(texts))
    at = 0
    for text, n in zip(texts, counts):
        assert list(flat[at : at + n]) == store.tokenizer.encode(text or "", add_special_tokens=False).ids
        at += n


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_once(seed):
    r = random.Random(seed)
    counts = {r.randint(1, 64): r.randint(1, 50) for _ in range(r.randint(0, 40))}
    runs = packing_plan(counts, 64)
    used: dict = {}
    for times, lengths in runs:
        assert times > 0 and sum(lengths) <= 64
        for n in lengths:
            used[n] = used.get(n, 0) + times
    assert used == counts
    total = sum(n * k for n, k in counts.items())
    # Best fit decreasing needs at most 11/9 of the least number, and one more.
    assert sum(t for t, _ in runs) <= -(-total // 64) * 11 / 9 + sum(1 for n in counts if n > 32) * 50 + 1


def test_exact_combinations_come_first():
    assert sorted(packing_plan({40: 1, 24: 1, 30: 1, 20: 1, 14: 1, 50: 1, 7: 2}, 64)) == [(1, (30, 20, 7, 7)), (1, (40, 24)), (1, (50, 14))]


def test_pack(spark):
    rows = awkward()
    docs = spark.createDataFrame([(i, t, "x", 1, "k", "n", "t", "l", "s", "r") for i, t, *_ in rows], CLASHING)
    got = pack(docs.repartition(3), PATH).collect()
    tokenizer = word_ids(PATH).tokenizer
    expected = []
    for i, text, *_ in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        start, size, piece = 0, len(ids) % 1024 or min(1024, len(ids)), 0
        while start < len(ids):
            expected.append((i, piece, start, size, zlib.crc32(ids[start : start + size].tobytes())))
            start, size, piece = start + size, 1024, piece + 1
    assert sorted(tuple(r)[:5] for r in got) == sorted(expected)
    by_sequence: dict = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert pack(docs.limit(0), PATH).count() == 0
