import random

import numpy as np
import pytest

from notegraph.llm.polytope import hadamard, near_duplicates, vertices

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, cosine=0.93):
    """vec_id, n_links, component_id, kept of each row, by all pairs."""
    n = len(rows)
    unit = [None] * n
    for k, (_, vector, label) in enumerate(rows):
        ok = vector is not None and label is not None and len(vector) and all(x is not None and np.isfinite(x) for x in vector)
        if ok and any(x != 0 for x in vector):
            v = np.array(vector, np.float32).astype(np.float64)
            v = v / np.abs(v).max()
            unit[k] = v / np.sqrt(v @ v)
    near = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine] for i in range(n)]
    out, seen = [None] * n, set()
    for i in range(n):
        if i in seen:
            continue
        group, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in group:
                    group.add(j)
                    todo.append(j)
        seen |= group
        least = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
        for j in group:
            out[j] = (rows[j][0], len(near[j]), least, rows[j][0] is not None and rows[j][0] == least)
    return sorted(out, key=repr)


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def planted(seed, n=400, width=16, groups=12):
    """Random vectors, groups of near and exact copies, one group with a third of all rows."""
    r = np.random.default_rng(seed)
    rows = []
    centres = r.normal(size=(groups, width))
    for k in range(n):
        g = 0 if k % 3 == 0 else int(r.integers(0, groups))
        noise = [0.0, 0.08, 0.25][int(r.integers(0, 3))]
        vector = centres[g] + r.normal(size=width) * noise if r.random() < 0.7 else r.normal(size=width)
        rows.append((k, [float(np.float32(x)) for x in vector * r.choice([1.0, 2.0])], int(g % 3)))
    return rows


def test_transform_is_a_rotation():
    rows = np.random.default_rng(0).normal(size=(5, 16))
    turned = hadamard(rows)
    assert np.allclose(turned @ turned.T, rows @ rows.T) and np.allclose(hadamard(turned), rows)


def test_vertices_are_the_nearest_ones():
    unit = np.random.default_rng(1).normal(size=(50, 12))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    every = vertices(unit, 0, 32)
    assert (np.sort(every, 1) == np.arange(32)).all() and (vertices(unit, 0, 3) == every[:, :3]).all()
    assert (every[:, 0] // 2 == every[:, -1] // 2).all()  # the nearest and the farthest are opposite


def test_recall_at_the_threshold():
    r = np.random.default_rng(2)
    a = r.normal(size=(4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = r.normal(size=(4000, 64))
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    met = [(vertices(a, t, 3)[:, :, None] == vertices(b, t, 3)[:, None, :]).any((1, 2)) for t in (0, 1)]
    assert met[0].mean() > 0.96 and (met[0] | met[1]).mean() > 0.997


@pytest.mark.parametrize("seed,leaf,block_values", [(0, 2048, 1 << 22), (1, 16, 1 << 22), (2, 2048, 16 * 20), (3, 16, 16 * 40)])
def test_links_equal_all_pairs(spark, seed, leaf, block_values):
    rows = planted(seed)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    # With all vertices as probes nothing can be missed, however buckets are split and cut.
    assert got(near_duplicates(frame, probes=32, leaf=1 << 20 if leaf > 16 else 64, block_values=block_values)) == brute(rows)
    found, expected = {r[0]: r[1] for r in got(near_duplicates(frame, leaf=leaf, block_values=block_values))}, {r[0]: r[1] for r in brute(rows)}
    assert all(found[k] <= expected[k] for k in expected)  # none below the threshold, none counted twice
    assert sum(found.values()) >= 0.98 * sum(expected.values())


def test_links_do_not_depend_on_the_size_of_buckets(spark):
    """A bucket of more vectors than are compared at a time has the same links."""
    r = np.random.default_rng(5)
    centre = r.normal(size=64)
    rows = [(i, [float(x) for x in centre + 0.27 * r.normal(size=64)], 1) for i in range(200)]
    frame = spark.createDataFrame(rows, SCHEMA)
    few, all_at_once = got(near_duplicates(frame, leaf=8)), got(near_duplicates(frame, leaf=1 << 20))
    assert few == all_at_once and sum(row[1] for row in few) > 1000


def test_awkward_rows(spark):
    one, near, nan, inf = [1.0, 0.0, 0.5], [1.0, 0.01, 0.5], float("nan"), float("inf")
    rows = [
        (1, one, 1), (2, one, 1), (2, one, 1), (2, near, 1), (3, one, 2), (4, one, None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0, 0.0], 1), (8, [1.0, None, 0.5], 1),
        (9, [1.0, nan, 0.5], 1), (10, [1.0, inf, 0.5], 1), (None, near, 1), (None, [0.0, 1.0, 0.0], 1), (11, [1.0, 0.0], 1), (12, [-1.0, 0.0, -0.5], 1), (13, [2.0], 1), (14, [3.0], 1),
        (15, [3e38, 0.0, 1.5e38], 1),
    ]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert got(near_duplicates(frame)) == brute(rows)
    assert got(near_duplicates(frame.selectExpr("*", "1 AS v", "2 AS m", "'x' AS codes", "3 AS d1", "4 AS cell"))) == brute(rows)
    doubles = frame.selectExpr("vec_id", "CAST(embedding AS array<double>) AS embedding", "CAST(label AS string) AS label")
    assert got(near_duplicates(doubles)) == brute(rows)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
