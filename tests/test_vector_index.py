import random

import numpy as np
import pytest

from notegraph.operators.similar import knn_join, note_vectors, similar_to
from notegraph.operators.vector_index import build_index, knn_in_index, open_index, similar_in_index, similar_to_indexed, update_index
from notegraph.plans.populate import populate_table
from notegraph.schema import Settings
from notegraph.sources.table import load_notes

SCHEMA = "path string, chunk_index int, embedding array<float>"
DIM = 12


def clustered(seed, n, groups=15, spread=0.1):
    """(path, chunk, vector): clusters, one vector that a third of the rows share, and unusable vectors."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, DIM))
    rows = []
    for k in range(n):
        vector = centres[0] if k % 3 == 0 else centres[r.integers(0, groups)] + r.normal(size=DIM) * spread
        rows.append((f"n{k // 2}.md", k % 2, [float(np.float32(x)) for x in vector]))
    return rows + [("none.md", 0, None), ("zero.md", 0, [0.0] * DIM), ("short.md", 0, [1.0, 2.0])]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def found(df):
    return sorted((tuple(x for x in r if not isinstance(x, float)), round(next(x for x in r if isinstance(x, float)), 9)) for r in df.collect())


def same_answers(spark, rows, root, block_rows=40):
    notes = frame(spark, rows)
    for level in ("chunk", "note"):
        expected = found(knn_join(note_vectors(notes), notes, 4, level, "blocked", dim=DIM))
        assert found(knn_in_index(note_vectors(notes), root, 4, level, block_rows)) == expected
    for path in ("n0.md", "n1.md", "n7.md", "zero.md", "absent.md"):
        usable = notes.where("size(embedding) = 12")
        assert found(similar_to_indexed(notes, root, path, 5)) == found(similar_to(usable, path, 5))


@pytest.mark.parametrize("seed, spread", [(1, 0.05), (2, 2.0)])
def test_answers_are_exact_through_updates(spark, tmp_path, seed, spread):
    root, r = str(tmp_path / "index"), random.Random(seed)
    rows = clustered(seed, 160, spread=spread)
    build_index(frame(spark, rows), root, DIM, cell_rows=10)
    same_answers(spark, rows, root)
    # Some notes change, some go, some come, one vector gets unusable.
    changed = {f"n{k}.md" for k in r.sample(range(80), 12)}
    gone = {f"n{k}.md" for k in r.sample(range(80), 8)} - changed
    after = [(p, c, [-x for x in v] if v and p in changed else v) for p, c, v in rows if p not in gone]
    after = [(p, c, [0.0] * DIM if p == min(changed) else v) for p, c, v in after] + [(f"new{k}.md", 0, v) for k, (_, _, v) in enumerate(clustered(9, 10))]
    touched = changed | gone | {p for p, _, _ in after if p.startswith("new")}
    update_index(frame(spark, after), spark.createDataFrame([(p,) for p in touched], "path string"), root)
    same_answers(spark, after, root)
    index = open_index(spark, root)
    assert sum(c.n for c in index.current.values()) == sum(1 for _, _, v in after if v and len(v) == DIM and any(v))


def test_only_cells_that_matter_are_read_and_written(spark, tmp_path):
    root = str(tmp_path / "index")
    rows = clustered(3, 400, groups=20, spread=0.01)
    build_index(frame(spark, rows), root, DIM, cell_rows=10)
    before = open_index(spark, root)
    assert len(before.current) > 10
    vector = next(v for p, c, v in rows if p == "n1.md" and c == 0)
    read = {f.split("/cell=")[1].split("/")[0] for f in similar_in_index(spark, root, "n1.md", vector, 5).inputFiles() if "/cell=" in f}
    assert 0 < len(read) < len(before.current) / 2
    one = [("n1.md", 0, vector), ("n1.md", 1, vector)]
    assert 0 < update_index(frame(spark, one), spark.createDataFrame([("n1.md",)], "path string"), root) <= 3
    after = open_index(spark, root)
    assert sum(after.current[c] != before.current.get(c) for c in after.current) <= 3
    assert update_index(frame(spark, []), spark.createDataFrame([("absent.md",)], "path string"), root) == 0


def test_empty_index(spark, tmp_path):
    root = str(tmp_path / "index")
    build_index(frame(spark, []), root, DIM)
    notes = frame(spark, clustered(1, 6))
    assert knn_in_index(note_vectors(notes), root, 3).collect() == [] and similar_to_indexed(notes, root, "n0.md").collect() == []
    update_index(notes, notes.select("path"), root)
    same_answers(spark, clustered(1, 6), root)


def test_populate_maintains_the_index(spark, tmp_path):
    settings, root, index = Settings(dimensions=32, chunk_size=40), str(tmp_path / "t"), str(tmp_path / "i")

    def run(texts, now):
        disk = spark.createDataFrame([(p, t) for p, t in texts.items()], "path string, content string")
        disk = disk.selectExpr("path", "content", "timestamp'2024-01-01' AS modified_at", "md5(content) AS content_hash")
        populate_table(spark, disk, root, settings, now, buckets=4, index_root=index)
        notes = load_notes(spark, root)
        expected = found(knn_join(note_vectors(notes), notes, 3, "chunk", "blocked", dim=32))
        assert found(knn_in_index(note_vectors(notes), index, 3)) == expected and expected

    texts = {f"a{k}.md": f"words about {k % 4} and number {k} " * (1 + k % 3) for k in range(12)}
    run(texts, "2024-02-01 00:00:00")
    texts |= {"a3.md": "something else entirely", "b.md": "a new note about 2"}
    del texts["a5.md"]
    run(texts, "2024-03-01 00:00:00")
