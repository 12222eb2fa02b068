import hashlib

import numpy as np
import pytest

from notegraph.llm.gridcodes import Grid, compress

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, entries=256, rounds=4, parts=4):
    kept = [(i, np.floor(np.array(v, np.float32).astype(np.float64) * 1024).astype(int), lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    ints = np.stack([v for _, v, _ in kept])
    cut = np.array_split(np.arange(ints.shape[1]), parts)
    books = [ints[:entries][:, c].copy() for c in cut]

    def assign():
        out = []
        for c, book in zip(cut, books):
            d = ((ints[:, None, c] - book[None]) ** 2).sum(2)
            out.append((d.argmin(1), d.min(1)))
        return out

    for _ in range(rounds):
        for (best, _), c, book in zip(assign(), cut, books):
            for e in set(best):
                book[e] = ints[best == e][:, c].sum(0) // (best == e).sum()
    found = assign()
    error = sum(d for _, d in found)
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    totals = {}
    for (_, _, lab), e in zip(kept, error):
        totals[lab] = totals.get(lab, 0) + int(e)
    return sorted(((i, lab, "".join(f"{best[k]:02x}" for best, _ in found), int(error[k]), totals[lab], digest) for k, (i, _, lab) in enumerate(kept)), key=repr)


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def vectors(seed, n, width, spread=0.2):
    r = np.random.default_rng(seed)
    rows = [(k, [float(np.float32(x)) for x in r.normal(size=width) * spread], int(r.integers(0, 3))) for k in range(n)]
    return [(k, rows[3][1], 1) if k % 3 == 0 and k > n // 2 else (k, v, lab) for k, v, lab in rows]


@pytest.mark.parametrize("cell,memo", [(8, 1 << 16), (128, 1 << 16), (4096, 1 << 16), (64, 5)])
def test_nearest_is_exact_whatever_the_cells(cell, memo):
    r = np.random.default_rng(cell)
    book = r.integers(-60, 60, (40, 4))
    book[7] = book[3]  # a tie everywhere
    rows = np.concatenate([r.integers(-90, 90, (9000, 4)), book]).astype(np.int32)
    grid = Grid(book, cell, memo)
    for _ in range(2):
        best, distance = grid.nearest(rows)
        d = ((rows[:, None].astype(int) - book[None]) ** 2).sum(2)
        assert (best == d.argmin(1)).all() and (distance == d.min(1)).all()
    assert memo == 5 or len(grid.memo) == len(np.unique(rows // cell, axis=0))


def test_cells_leave_out_dominated_entries():
    grid = Grid(np.array([[0, 0], [10, 10], [1000, 1000]]), 16)
    assert [x.tolist() for x in grid.candidates(np.array([[0, 0], [62, 62]]))] == [[0, 1], [2]]


@pytest.mark.parametrize("n,width", [(600, 16), (300, 8), (20, 8), (257, 10), (30, 3)])
def test_codes_equal_brute_force(spark, n, width):
    rows = vectors(n, n, width)
    assert got(compress(spark.createDataFrame(rows, SCHEMA).repartition(5))) == brute(rows)


def test_awkward_rows(spark):
    good = vectors(5, 40, 8)
    bad = [(100, None, 1), (101, [None] * 8, 1), (102, [float("nan")] * 8, 1), (103, [float("inf")] * 8, None)]
    rows = good + [(50, good[4][1], None), (51, good[5][1], None), (None, good[6][1], 2), (39, good[39][1], good[39][2])] + bad
    assert got(compress(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    wider = spark.createDataFrame(rows + [(104, [1.0], 1)], SCHEMA).selectExpr("*", "1 AS code", "2 AS ints", "3 AS entry", "4 AS `of`")
    assert got(compress(wider)) == brute(rows)  # a vector of another length is left out
    assert got(compress(spark.createDataFrame([(1, [], 1), (2, [], 1)], SCHEMA)))[0][2:5] == ("00000000", 0, 0)


def test_empty_table(spark):
    assert compress(spark.createDataFrame([], SCHEMA)).collect() == []
    assert compress(spark.createDataFrame([(1, None, 1)], SCHEMA)).collect() == []
