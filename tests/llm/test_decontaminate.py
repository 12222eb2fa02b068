import hashlib
import re

import pytest

from notegraph.llm.decontaminate import decontaminate
from helpers import CLASHING, awkward, documents, random_texts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(texts, items):
    out = []
    for text in texts:
        w = words(text)
        hit, ids = set(), set()
        for item_id, item in items:
            v = words(item)
            size = min(10, len(v))
            for s in range(len(v) - size + 1) if v else ():
                for at in range(len(w) - size + 1):
                    if w[at : at + size] == v[s : s + size]:
                        hit |= set(range(at, at + size))
                        ids.add(str(item_id))
        out.append((len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


def run(spark, docs, items, **more):
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = decontaminate(docs, bench, **more).collect()
    return {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rows}


@pytest.mark.parametrize("seed,vocabulary", [(1, 2), (2, 5), (3, 40)])
def test_brute_force(spark, seed, vocabulary):
    texts = random_texts(60, seed, 60, vocabulary) + ["A, b.c W1 w1", "É é w1"]
    items = [(k * 7, t) for k, t in enumerate(random_texts(12, seed + 9, 25, vocabulary))]
    # Items cut from documents, short items, an item twice, one without words, a null.
    items += [(100 + k, " ".join(words(t)[3:20])) for k, t in enumerate(texts[:8])] + [(200, "w1"), (201, "w1 w0"), (202, "w0 w1 w1"), (200, "w1"), (300, ".."), (301, None)]
    assert run(spark, documents(spark, texts), items) == dict(enumerate(brute(texts, items)))


def test_blocks_give_the_same(spark):
    texts = random_texts(30, 4, 60, 3)
    items = [(k, t) for k, t in enumerate(random_texts(6, 5, 30, 3))]
    assert run(spark, documents(spark, texts), items, per_block=20) == run(spark, documents(spark, texts), items)


def test_awkward_rows_and_clashing_columns(spark):
    rows = awkward()
    docs = spark.createDataFrame([(i, t, "x", 1, "k", "n", "t", "l", "s", "r") for i, t, *_ in rows], CLASHING)
    items = [(1, "same text here again and again"), (2, "word word word word word word word word word word end")]
    expected = dict(zip((r[0] for r in rows), brute([r[1] for r in rows], items)))
    assert run(spark, docs, items) == expected
    assert decontaminate(docs.limit(0), spark.createDataFrame(items, "item_id bigint, text string")).count() == 0
    clean = run(spark, docs, [])
    assert all(not x[4] for x in clean.values()) and len(clean) == len(expected)
