from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from notegraph.functions import text
from notegraph.operators.chunk import chunk_notes

PATHS = ["a/b.md", "a//b.md", "./a/b.md", "a/./b.md", "a/b/", "a.b.md", ".hidden", "x/.hidden.md", "x.", "a..", "plain", "d.ir/f"]


def one(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("v"))).collect()]


def test_posix_path(spark):
    assert one(spark, PATHS, text.posix_path) == [PurePosixPath(p).as_posix() for p in PATHS]
    assert one(spark, ["a\\b\\\\c.md"], text.normalise_path) == ["a/b/c.md"]


def test_path_stem(spark):
    names = [p for p in PATHS if not p.endswith("/")]
    assert one(spark, names, text.path_stem) == [PurePosixPath(p).stem for p in names]


def test_strip_is_wider_than_spaces(spark):
    values = ["  a b \n", "\t x ", "\x1cy\x1f", "", "\n \n", "é\xa0"]
    assert one(spark, values, text.strip_both) == [v.strip() for v in values]
    assert one(spark, values, text.strip_end) == [v.rstrip() for v in values]


def test_fingerprint_is_md5_of_utf8(spark):
    import hashlib

    values = ["", "abc", "é😀\n"]
    assert one(spark, values, text.fingerprint) == [hashlib.md5(v.encode()).hexdigest() for v in values]


def test_newlines(spark):
    assert one(spark, ["a\r\nb\rc\n"], text.unix_newlines) == ["a\nb\nc\n"]


@pytest.mark.parametrize(
    "content, target, linked",
    [
        ("see [[d/a.md]]", "d/a.md", True),
        ("see [[a]]", "d/a.md", True),
        ("see [[d/a.md|alias]]", "d/a.md", False),
        ("see [[a.b]]", "a.b.md", True),
        ("see a.md", "a.md", False),
    ],
)
def test_link_exists(spark, content, target, linked):
    row = spark.createDataFrame([(content, target)], "c string, t string")
    assert row.select(text.link_exists(F.col("c"), F.col("t"))).first()[0] is linked


def test_ignore_rules(spark):
    values = ["a.md", ".git/x.md", "n/.git/x.md", "a.md~", "a.swp"]
    kept = one(
        spark, values, lambda p: text.path_not_ignored(p, [".git/"]) & text.path_not_temporary(p, ["~", ".swp"])
    )
    assert kept == [True, False, True, False, False]


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_chunks_are_slices(spark, size):
    texts = {"empty": "", "exact": "x" * 1000, "over": "y" * 1001, "wide": "aé😀\n" * 500, "small": "z"}
    rows = spark.createDataFrame([(k, v, None) for k, v in texts.items()], "path string, content string, modified_at timestamp")
    got = sorted(
        (r.path, r.chunk_index, r.chunk_start, r.chunk_end, r.raw_content) for r in chunk_notes(rows, size).collect()
    )
    expected = sorted(
        (k, i // size, i, min(i + size, len(v)), v[i : i + size]) for k, v in texts.items() for i in range(0, len(v), size)
    )
    assert got == expected
