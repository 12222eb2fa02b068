import random

import numpy as np
import pyarrow as pa
import pytest

from notegraph.llm import jaccard
from notegraph.llm.jaccard import Tree, bucket_pairs, components, distinct_shingles, jaccard_components, one_of_each
from helpers import CLASHING, awkward, documents


def shingle_set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({k: " " for k in (9, 10, 11, 12, 13)})
    words = [w for w in words.split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted((i, len(s), find(i)) for i, s in sets)


def near_copies(r, base, n, edits):
    out = []
    for _ in range(n):
        words = base.split()
        for _ in range(r.randint(0, edits)):
            words[r.randrange(len(words))] = f"e{r.random()}"
        out.append(" ".join(words))
    return out


def corpus(seed):
    r = random.Random(seed)

    def text(n):
        return " ".join(f"w{r.randint(0, 500)}" for _ in range(n))

    passage = text(60)
    texts = []
    for size in (6, 12, 40, 120, 300):
        for _ in range(4):
            texts += near_copies(r, text(size), 6, max(1, size // 40))
    texts += [f"{text(40)} {passage} {text(20)}" for _ in range(40)]  # a common passage
    texts += near_copies(r, text(120), 60, 4)  # a large group whose members differ among themselves
    texts += [text(r.randint(1, 8)) for _ in range(20)] + [texts[3].upper(), texts[5] + "  ", texts[5]]
    r.shuffle(texts)
    return texts


def got(docs):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_components(docs).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, seed, monkeypatch):
    texts = corpus(seed)
    rows = list(enumerate(texts))
    expected = brute(rows)
    assert got(documents(spark, texts).repartition(3)) == expected
    if seed == 1:
        # Without leaders, and with buckets cut into blocks, all pairs come from the trees.
        monkeypatch.setattr(jaccard, "STAR_ROUNDS", 0)
        monkeypatch.setattr(jaccard, "BLOCK", 16)
        assert got(documents(spark, texts)) == expected
        # Ids that are texts, in an order of their own.
        named = got(documents(spark, texts).selectExpr("concat('d', doc_id) AS doc_id", "text"))
        least = {c: min(f"d{i}" for i, _, o in expected if o == c) for _, _, c in expected}
        assert named == sorted((f"d{i}", n, least[c]) for i, n, c in expected)


def test_awkward_rows(spark):
    rows = [(i, t) for i, t, *_ in awkward()]
    docs = spark.createDataFrame([(i, t, "x", 1, "k", "n", "t", "l", "s", "r") for i, t in [*rows, (None, "no id")]], CLASHING)
    rows_got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_components(docs).where("doc_id IS NOT NULL").collect())
    assert [(i, n) for i, n, _ in rows_got] == sorted((i, len(shingle_set(t))) for i, t in rows)
    assert {i: c for i, _, c in rows_got}[10] == 9 and all(c == i for i, n, c in rows_got if n == 0)
    assert jaccard_components(docs.limit(0)).count() == 0
    kept = one_of_each(docs, jaccard_components(docs))
    assert sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()) == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9]
    assert kept.columns == docs.columns
    assert one_of_each(docs.limit(0), jaccard_components(docs.limit(0))).count() == 0


def one_of_each_brute(rows):
    """Texts of the rows that stay: of each group of linked texts one row, rows without words all."""
    texts = sorted({t for _, t in rows if shingle_set(t)})
    group = {t: c for t, (_, _, c) in zip(texts, brute(list(enumerate(texts))))}
    return sorted(str(t) for _, t in rows if not shingle_set(t)), len(set(group.values())), group


def test_no_document_is_lost(spark):
    """Ids that are repeated with other texts, rows that are repeated as they are, and rows without id."""
    r = random.Random(8)
    base = [" ".join(f"w{r.randint(0, 300)}" for _ in range(60)) for _ in range(12)]
    rows = [(1, base[0]), (1, base[0]), (2, base[1]), (2, base[0]), (None, base[2]), (None, base[2]), (None, base[3]), (5, base[3]), (None, None), (None, ""), (6, " "), (6, " ")]
    for k in range(120):
        text = base[r.randrange(12)] if r.random() < 0.5 else near_copies(r, base[r.randrange(12)], 1, 3)[0]
        rows.append((r.choice([None, r.randint(0, 30)]), text))
    docs = spark.createDataFrame([(i, t, k % 3, "x") for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, score int, key string")
    kept = one_of_each(docs, jaccard_components(docs)).collect()
    without, n, group = one_of_each_brute(rows)
    assert sorted(str(x["text"]) for x in kept if not shingle_set(x["text"])) == without
    assert sorted(group[x["text"]] for x in kept if shingle_set(x["text"])) == sorted(set(group.values())) and n == len(kept) - len(without)
    few = spark.createDataFrame([(i, t) for i, t in rows[:6]], "doc_id bigint, text string")
    assert sorted(one_of_each(few, jaccard_components(few)).collect(), key=str) == sorted([(1, base[0]), (2, base[1]), (None, base[2])], key=str)


def test_tree_against_all_pairs():
    r = np.random.default_rng(4)
    base = r.poisson(5, (12, jaccard.GROUPS))
    points = np.maximum(base[r.integers(0, 12, 400)] + r.integers(-1, 2, (400, jaccard.GROUPS)), 0)
    sizes = points.sum(1)
    labels = r.integers(0, 50, 400)
    ids = r.permutation(1000)[:400]
    tree = Tree(points, sizes)
    overlap = np.minimum(points[:, None], points[None]).sum(2)
    fits = (9 * overlap >= 4 * (sizes[:, None] + sizes)) & (5 * sizes[:, None] >= 4 * sizes) & (5 * sizes >= 4 * sizes[:, None])
    for k in range(400):
        assert sorted(tree.near(points[k], int(sizes[k]))) == np.flatnonzero(fits[k]).tolist()
    a, b = bucket_pairs(ids, sizes, labels, np.zeros(400, int), points)
    expected = {(min(ids[i], ids[j]), max(ids[i], ids[j])) for i in range(400) for j in range(i) if fits[i, j] and labels[i] != labels[j]}
    assert set(zip(a, b)) == expected


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, k) for k in range(2000, 2100)]
    got = {x["vertex"]: x["label"] for x in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    near: dict = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    expected = {}
    for start in sorted(near):
        todo = [start] if start not in expected else []
        while todo:
            x = todo.pop()
            if x not in expected:
                expected[x] = start
                todo += near[x]
    assert got == expected
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_sets_of_one_batch_are_apart():
    found, n = distinct_shingles(pa.array(["a b c d e", "a b c d e f", None, "a", "A"]))
    assert n.tolist() == [1, 2, 0, 1, 1] and found[0] in found[1:3] and found[3] == found[4]
