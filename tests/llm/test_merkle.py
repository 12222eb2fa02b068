import hashlib
import random
import zlib

import pytest

from notegraph.llm.merkle import grow, levels_above, manifest, position, proofs, siblings
from helpers import SCHEMA, awkward


def digest(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    out = b""
    for value in (doc_id, source, lang, n_chars, text):
        data = None if value is None else str(value).encode()
        out += b"-" if data is None else f"{len(data)}:".encode() + data
    return hashlib.sha256(out).hexdigest()


def climb(nodes):
    """The end of a tree and each base node's path, by plain levels."""
    paths = [[] for _ in nodes]
    where = list(range(len(nodes)))
    while len(nodes) > 1:
        for path, w in zip(paths, where):
            first = w - w % 3
            path.append((nodes[first:w], nodes[w + 1 : first + 3]))
        where = [w // 3 for w in where]
        nodes = [digest(*nodes[k : k + 3]) for k in range(0, len(nodes), 3)]
    return nodes[0], paths


def brute(rows):
    """doc_id, leaf, subroot, root, proof, folded root of each row, as sorted tuples."""
    first = lambda x: (x is not None, x or 0)
    by_source = {}
    for row in rows:
        by_source.setdefault(row[3], []).append(row)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        held = sorted(by_source[name], key=lambda r: (first(r[0]), leaf(*r)))
        trees[name] = (held, *climb([leaf(*r) for r in held]))
    root, above = climb([trees[n][1] for n in names])
    out = []
    for name, upper in zip(names, above):
        held, subroot, paths = trees[name]
        for row, path in zip(held, paths):
            doc_id, text, lang, source, n_chars = row
            even = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
            node = leaf(doc_id, text.replace("\n", "") if even and text else text, lang, source, n_chars)
            for left, right in path + upper:
                node = digest(*left, node, *right)
            proof = "".join("".join(left + right) for left, right in path + upper)
            out.append((doc_id, leaf(*row), subroot, root, proof, node, node == root))
    return sorted(out, key=repr)


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("size", [1, 2, 3, 4, 9, 10, 26, 27, 28, 80, 82])
def test_positions_are_those_of_the_log(size):
    base = [digest(str(k)).encode() for k in range(size)]
    height = levels_above(size)
    log = grow(base, height)
    nodes, level = base, 0
    while True:
        assert [log[p] for p in position(level, range(len(nodes)), size, height)] == nodes
        if len(nodes) == 1:
            break
        nodes, level = [hashlib.sha256(b"".join(nodes[k : k + 3])).hexdigest().encode() for k in range(0, len(nodes), 3)], level + 1
    assert level == height and len(log) == position(height, 0, size, height) + 1
    lefts, rights = siblings(b"".join(bytes.fromhex(d.decode()) for d in log), size, height)
    _, paths = climb([d.decode() for d in base])
    for k, path in enumerate(paths):
        assert ["".join(x) for x, _ in path] == [left[k // 3**n] for n, left in enumerate(lefts)]
        assert ["".join(y) for _, y in path] == [right[k // 3**n] for n, right in enumerate(rights)]


@pytest.mark.parametrize("levels", [1, 2, 8])
def test_manifest_equals_plain_levels(spark, levels):
    r = random.Random(levels)
    rows = [(k, f"text {k}\n" * r.randint(0, 3), r.choice([None, "en"]), r.choice(["hot", "hot", "b", "c", "é", None]), r.choice([None, k])) for k in range(130)]
    rows += [(900 + k, "a\nb", "en", f"single {k}", 3) for k in range(11)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(proofs(manifest(frame, levels=levels))) == brute(rows)


def test_only_changed_texts_fail(spark):
    rows = [(k, "line\nline", "en", "s", 9) for k in range(40)]
    for row in proofs(manifest(spark.createDataFrame(rows, SCHEMA), levels=1)).collect():
        assert row["verified"] == (zlib.crc32(str(row["doc_id"]).encode()) % 2 == 1)


def test_awkward_rows(spark):
    rows = awkward() + [(None, None, None, None, None), (None, "a\nb", "", "", 0), (3, "\n", "en", "s", 1)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert got(proofs(manifest(frame, levels=1))) == brute(rows)
    wider = frame.selectExpr("*", "1 AS tree", "2 AS idx", "'x' AS digest", "3 AS at", "4 AS place", "'y' AS named")
    assert got(proofs(manifest(wider, levels=1))) == brute(rows)


def test_empty_table(spark):
    found = manifest(spark.createDataFrame([], SCHEMA))
    assert found.root is None and proofs(found).collect() == []
