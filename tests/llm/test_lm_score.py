import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from notegraph.llm import lm_score
from notegraph.llm.common import utf8
from helpers import CLASHING, awkward, documents, random_texts


def tokens(text):
    out = []
    for word in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({k: " " for k in (9, 10, 11, 12, 13)}).split(" "):
        if word:
            out.append(word)
    return [*out, None]


def base(rows):
    learned = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(x for t in learned for x in tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        found = tokens(t)
        out.append((i, len(found), sum(counts[x] > 0 for x in found), total, sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in found)))
    return out


def check(docs, rows):
    got = lm_score.score(docs, *lm_score.train(docs)).collect()
    expected = sorted(base(rows))
    got = sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["held_out"], r["score"]) for r in got)
    assert len(got) == len(expected)
    for g, e in zip(got, expected):
        assert g[:4] == e[:4] and g[4] == pytest.approx(e[4], abs=1e-6)
        assert g[5] == (zlib.crc32(str(g[0]).encode()) % 7 == 2)
        assert g[6] < 0
    return {g[0]: g[6] for g in got}


def test_base_and_dealing(spark, monkeypatch):
    texts = random_texts(60, 2, 40, 300) + ["New WORDS only\there", "é É"]
    rows = list(enumerate(texts))
    scores = check(documents(spark, texts).repartition(3), rows)
    monkeypatch.setattr(lm_score, "FREQUENT", 20)  # more tokens are joined
    again = check(documents(spark, texts).repartition(7), rows)
    assert all(again[k] == pytest.approx(v, rel=1e-5) for k, v in scores.items())


def test_awkward_rows(spark):
    rows = [(i, t) for i, t, *_ in awkward()]
    docs = spark.createDataFrame([(i, t, "x", 1, "k", "n", "t", "l", "s", "r") for i, t in rows], CLASHING)
    check(docs, rows)
    empty = docs.limit(0)
    assert lm_score.score(empty, *lm_score.train(empty)).count() == 0


def model_of(texts):
    data, offsets = utf8(pa.array(texts))
    code = lm_score.huffman(np.r_[np.bincount(data, minlength=256), len(texts)])
    totals = np.zeros((lm_score.CONTEXTS, lm_score.SLOTS * lm_score.WIDTH), np.int32)
    lm_score.count_symbols(data, offsets, totals)
    return code, lm_score.log_odds(totals, code)


def test_a_code_is_a_code():
    code = lm_score.huffman(np.arange(257))
    assert sum(2.0 ** -int(n) for n in code.length) == pytest.approx(1)


def test_probabilities_sum_to_one():
    """Over the first symbol, given the untouched start of a text."""
    code, tables = model_of(random_texts(50, 1))
    # A text of one byte: p(byte) * p(end | byte); the empty text: p(end). Sum p(byte) by scoring both parts.
    one = np.arange(128, dtype=np.uint8)
    whole = lm_score.log_probabilities(one, np.arange(129), code, tables)
    empty = lm_score.log_probabilities(np.zeros(0, np.uint8), np.zeros(2, np.int64), code, tables)
    assert math.exp(empty[0]) + np.exp(whole).sum() <= 1 + 1e-6


def test_learns_and_keeps_texts_apart():
    texts = random_texts(300, 7, 60, 50)
    code, tables = model_of(texts[:200])
    data, offsets = utf8(pa.array(texts[200:]))
    got = lm_score.log_probabilities(data, offsets, code, tables)
    order0 = np.bincount(data, minlength=256)
    p = order0[order0 > 0] / len(data)
    assert -got.sum() / math.log(2) / len(data) < -(p * np.log2(p)).sum() * 0.8
    for k in (0, 17, 99):
        alone = lm_score.log_probabilities(*utf8(pa.array([texts[200 + k]])), code, tables)
        assert alone[0] == pytest.approx(got[k], rel=1e-5)


def test_tables_grow_with_the_training_bytes(spark, monkeypatch):
    sizes = [lm_score.table_rows(n) for n in (0, 10**6, 10**8, 10**9, 3 * 10**10)]
    assert sizes == sorted(sizes) and sizes[0] == lm_score.SLOTS and len(set(sizes[1:])) == 4
    monkeypatch.setattr(lm_score, "ROWS_PER_ROOT", 1000)  # a small corpus as large as it takes
    texts = random_texts(300, 7, 60, 50)
    docs = documents(spark, texts).repartition(3)
    model, _ = lm_score.train(docs)
    learned = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2]
    data, offsets = utf8(pa.array(learned))
    slots = lm_score.table_rows(len(data))
    assert slots > lm_score.SLOTS and model.tables.shape == (lm_score.CONTEXTS, slots * lm_score.WIDTH)
    totals = np.zeros((lm_score.CONTEXTS, slots * lm_score.WIDTH), np.int32)
    lm_score.count_symbols(data, offsets, totals)
    assert (model.tables == lm_score.log_odds(totals, model.code)).all()


def test_more_rows_predict_better():
    """Contexts that shared a row of a small table have their own in a larger one."""
    texts = random_texts(4000, 3, 5000, 80)
    data, offsets = utf8(pa.array(texts[:3600]))
    code = lm_score.huffman(np.r_[np.bincount(data, minlength=256), 3600])
    held, at = utf8(pa.array(texts[3600:]))
    got = []
    for slots in (1 << 9, 1 << 16):
        totals = np.zeros((lm_score.CONTEXTS, slots * lm_score.WIDTH), np.int32)
        lm_score.count_symbols(data, offsets, totals)
        got.append(lm_score.log_probabilities(held, at, code, lm_score.log_odds(totals, code)).sum())
    assert got[1] > got[0]


def test_counted_inputs_are_those_of_all_bits(monkeypatch):
    texts = [*random_texts(40, 5, 60, 50), "", "é"]
    code, tables = model_of(random_texts(60, 6, 60, 50))
    totals = np.zeros(lm_score.GATES * lm_score.MEETINGS, np.int64)
    lm_score.count_inputs(*utf8(pa.array(texts)), code, tables, totals)
    text, starts = lm_score.symbols(*utf8(pa.array(texts)))
    contexts = lm_score.context_rows(text, starts)
    gates, expected = lm_score.gates_of(tables, contexts), Counter()
    for at, symbol in enumerate(text):
        for depth in range(code.length[symbol]):
            odds = [int(tables[k][contexts[k][at] + code.node[depth, symbol]]) for k in range(lm_score.CONTEXTS)]
            near = [np.sign(x) * min(lm_score.STEPS[lm_score.STEPS >= 0], key=lambda s: abs(s - abs(x))) for x in odds]
            cell = int(gates[at])
            for x in near:
                cell = cell * len(lm_score.STEPS) + int(np.flatnonzero(lm_score.STEPS == (x if code.bit[depth, symbol] else -x))[0])
            expected[cell] += 1
    assert {int(c): int(totals[c]) for c in np.flatnonzero(totals)} == expected


def test_weights_are_fitted_on_every_training_row(spark, monkeypatch):
    """No limit on rows or on their length: every bit of every training text counts, each against the other half."""
    texts = random_texts(900, 8, 12, 40) + ["a long text " * 2000]
    learned = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2]
    assert len(learned) > 600
    seen = []
    fit = lm_score.fit_weights
    monkeypatch.setattr(lm_score, "fit_weights", lambda cells, counts: seen.append(int(counts.sum())) or fit(cells, counts))
    models = [lm_score.train(documents(spark, texts).repartition(n))[0] for n in (3, 7)]
    text, _ = lm_score.symbols(*utf8(pa.array(learned)))
    assert seen == [int(models[0].code.length[text].sum())] * 2
    assert models[0].start == pytest.approx(models[1].start, rel=1e-5)
    assert (models[0].start != lm_score.equal_weights()).any()


def test_tables_laid_out_for_reading_say_the_same():
    texts = random_texts(300, 9, 60, 50)
    code, tables = model_of(texts[:200])
    laid = lm_score.laid_out(tables)
    text, starts = lm_score.symbols(*utf8(pa.array(texts[200:])))
    rows = lm_score.context_numbers(text, starts, lm_score.SLOTS)
    longest, depths = lm_score.by_depth(code.length[text])
    assert [m for m, _ in depths] == [int((code.length[text] > d).sum()) for d in range(len(depths))]
    node, bit = lm_score.path_bits(code, laid.node(code.node), text[longest], depths)
    for k, at in enumerate(lm_score.context_rows(text, starts)):
        got = lm_score.look_up(laid.nodes[k], rows[k][longest], node, depths)
        for d, (m, bits) in enumerate(depths):
            here = longest[:m]
            assert (got[bits] == tables[k][at[here] + code.node[d, text[here]]]).all()
            assert (bit[bits] == code.bit[d, text[here]]).all()
    scores = [lm_score.log_probabilities(*utf8(pa.array(texts[200:])), code, t) for t in (tables, laid)]
    assert (scores[0] == scores[1]).all()


def test_a_task_hands_on_a_slot_once():
    """Both halves of a slot go to Spark in one row, and parts are summed before."""
    parts = [(np.array([2, 3, 9], np.uint32), np.array([5, 1, 2])), (np.array([3, 4], np.uint32), np.array([4, 7]))]
    batch = lm_score._cells(*lm_score._summed(parts))
    assert batch.to_pydict() == {"slot": [1, 2, 4], "c": [10, 7, 2], "others": [5, 7, 0]}
    assert lm_score._cells(*lm_score._summed([(np.zeros(0, np.uint32), np.zeros(0, np.int64))])).num_rows == 0


def test_tokens_are_found_among_the_frequent_ones_by_hash_and_compared():
    frequent, words = ["a", "bb", "é", "ccc", "dd"], ["dd", "zz", "é", "A", "a", "bbb", "x" * 70_000]
    keys = lm_score.token_hashes(pa.array(frequent))
    order = np.argsort(keys)
    among = pa.array(frequent).take(pa.array(order))
    got = lm_score.positions(pa.array(words), among, keys[order])
    assert [None if k < 0 else among[int(k)].as_py() for k in got] == ["dd", None, "é", None, "a", None, None]
    for none in (lm_score.positions(pa.array(words), pa.array([], pa.string()), keys[:0]), lm_score.positions(pa.array([], pa.string()), among, keys[order])):
        assert (none == -1).all()


def test_tokens_with_the_same_hash_are_told_apart(monkeypatch):
    """Words that only share a hash with a frequent one are not taken for it; they are joined instead."""
    monkeypatch.setattr(lm_score, "token_hashes", lambda words: np.full(len(words), 7, np.uint64))
    got = lm_score.positions(pa.array(["b", "c", "a"]), pa.array(["a", "b"]), np.full(2, 7, np.uint64))
    assert got.tolist() == [-1, -1, 0]


@pytest.mark.parametrize("piece", [1, 7, 64, 1 << 15])
def test_texts_worked_off_in_pieces_have_the_same_contexts(monkeypatch, piece):
    monkeypatch.setattr(lm_score, "PIECE", piece)
    texts = [*random_texts(30, 4, 20), "", "", "a", "ab", "abc", "abcd", "", "long word" * 40, "é", " "]
    data, offsets = utf8(pa.array(texts))
    text, starts, rows = lm_score.pieces(data, offsets, 1 << 17)
    whole, expected = lm_score.symbols(data, offsets)
    assert (text == whole).all() and (starts == expected).all()
    for a, b in zip(rows, lm_score.context_numbers(whole, starts, 1 << 17)):
        assert (a == b).all()
    for k in range(len(texts)):  # and each text those it has alone
        alone = lm_score.context_numbers(*lm_score.symbols(*utf8(pa.array([texts[k]]))), 1 << 17)
        assert all((r[starts[k] : starts[k + 1]] == x).all() for r, x in zip(rows, alone))
    none = lm_score.pieces(data[:0], offsets[:1], 1 << 17)
    assert len(none[0]) == 0 and all(len(r) == 0 for r in none[2])


def test_rows_are_fetched_once_for_all_bits_of_a_place(monkeypatch):
    """The tables are read a row a place, and a cell a bit only beyond the first nodes."""
    code, tables = model_of(random_texts(200, 9, 60, 50))
    laid = lm_score.laid_out(tables)
    text, starts = lm_score.symbols(*utf8(pa.array([*random_texts(50, 10, 60, 50), "Qé~"])))
    rows = lm_score.context_numbers(text, starts, lm_score.SLOTS)[0]
    longest, depths = lm_score.by_depth(code.length[text])
    nodes = laid.node(code.node)
    node, _ = lm_score.path_bits(code, nodes, text[longest], depths)
    beyond = np.flatnonzero(node >= lm_score.HEAD)
    cells = lm_score.asked(node.copy(), depths, lm_score.deep_from(nodes))
    assert (cells[1] == beyond).all() and len(beyond) and (cells[3] == node[beyond]).all()
    fetched, take = [], np.take

    def counted(a, at, *args, **kwargs):
        if np.shares_memory(a, laid.nodes[0]):
            fetched.append(len(at))
        return take(a, at, *args, **kwargs)

    monkeypatch.setattr(np, "take", counted)
    lm_score.look_up(laid.nodes[0], rows[longest], node, depths)
    assert fetched == [len(text), len(beyond)] and sum(fetched) < len(node)
