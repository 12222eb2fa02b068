import datetime as dt
import hashlib
import os
import re
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from notegraph.operators import corpus
from notegraph.operators.chunk import chunk_notes
from notegraph.operators.embed import embed_chunks, hash_embed
from notegraph.plans.populate import populate, populate_table
from notegraph.schema import NOTES_SCHEMA, Settings
from notegraph.sources.notes import UNREADABLE, invalid_embeddings, list_notes, scan_notes, validate_embeddings
from notegraph.sources.table import load_notes, remove_superseded, save_notes

T0 = dt.datetime(2024, 1, 1)
LATER = dt.datetime(2024, 1, 2)
SETTINGS = Settings(dimensions=8, chunk_size=10, embedding_batch_size=3)


def disk(spark, notes, modified=T0):
    from notegraph.sources.notes import notes_from_table

    rows = spark.createDataFrame([(p, c) for p, c in notes.items()], "p string, c string")
    return notes_from_table(rows, F.col("p"), F.col("c"), F.lit(modified))


def test_scan_reads_relative_paths_utf8_and_newlines(spark, tmp_path):
    (tmp_path / "sub dir").mkdir()
    (tmp_path / "ai_logs").mkdir()
    (tmp_path / "Note1.md").write_bytes("This is note 1.".encode())
    (tmp_path / "sub dir" / "Nöte2.md").write_bytes("## Heading\r\nSome details 😀.".encode())
    (tmp_path / "bad.md").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "other.txt").write_text("no")
    (tmp_path / "ai_logs" / "x.md").write_text("ignored")
    rows = {r.path: r for r in scan_notes(spark, str(tmp_path), ["ai_logs/"]).collect()}
    assert set(rows) == {"Note1.md", "sub dir/Nöte2.md"}
    assert rows["sub dir/Nöte2.md"].content == "## Heading\nSome details 😀."
    changed = dt.datetime.fromtimestamp((tmp_path / "Note1.md").stat().st_mtime, dt.timezone.utc).replace(tzinfo=None)
    assert abs(rows["Note1.md"].modified_at - changed) < dt.timedelta(milliseconds=2)


def stored_row(path, index, digest, embedded):
    return (path, index, 0, 1, digest, T0, embedded, None, "x", [1.0])


def test_reasons_in_order(spark):
    md5 = hashlib.md5(b"text").hexdigest()
    on_disk = disk(spark, dict.fromkeys(["new", "hash", "mixed", "notime", "mtime", "same"], "text") | {"empty": ""})
    before, after = T0 - dt.timedelta(1), T0 + dt.timedelta(1)
    stored = spark.createDataFrame(
        [
            stored_row("hash", 0, "old", None),
            stored_row("mixed", 0, md5, after),
            stored_row("mixed", 1, "old", after),
            stored_row("notime", 0, md5, None),
            stored_row("mtime", 0, md5, before),
            stored_row("same", 0, md5, after),
            stored_row("empty", 0, "old", None),
        ],
        NOTES_SCHEMA,
    )
    metadata = corpus.note_metadata(stored)
    got = {r.path: r.reason for r in corpus.detect_changes(on_disk, metadata).collect()}
    assert got == {
        "new": corpus.REASON_NEW,
        "hash": corpus.REASON_CHANGED,
        "mixed": corpus.REASON_CHANGED,
        "notime": corpus.REASON_NO_TIME,
        "mtime": corpus.REASON_MODIFIED,
    }
    forced = corpus.detect_changes(on_disk, metadata, force=True).collect()
    assert {r.reason for r in forced} == {corpus.REASON_FORCED} and len(forced) == 6


def rows(notes):
    return sorted((r.path, r.chunk_index, r.raw_content) for r in notes.collect())


def test_populate_is_incremental_and_idempotent(spark):
    empty = spark.createDataFrame([], NOTES_SCHEMA)
    first = populate(disk(spark, {"a.md": "x" * 25, "b.md": "short", "c.md": "gone"}), empty, SETTINGS, T0)
    assert rows(first.notes) == [
        ("a.md", 0, "x" * 10), ("a.md", 1, "x" * 10), ("a.md", 2, "x" * 5), ("b.md", 0, "short"), ("c.md", 0, "gone"),
    ]
    linked = corpus.mark_backlinked(first.notes, spark.createDataFrame([("a.md",)], "path string"), T0)
    again = populate(disk(spark, {"a.md": "x" * 25, "b.md": "short", "c.md": "gone"}), linked, SETTINGS, LATER)
    assert again.changes.count() == 0
    assert rows(again.notes) == rows(first.notes)

    shrunk = disk(spark, {"a.md": "y" * 12, "b.md": "short", "d.md": "new"})
    second = populate(shrunk, linked, SETTINGS, LATER)
    assert rows(second.notes) == [
        ("a.md", 0, "y" * 10), ("a.md", 1, "yy"), ("b.md", 0, "short"), ("d.md", 0, "new"),
    ]
    stamps = {(r.path, r.chunk_index): (r.last_embedded_at, r.last_backlinked_at) for r in second.notes.collect()}
    assert stamps["a.md", 0] == (LATER, T0) and stamps["b.md", 0] == (T0, None) and stamps["d.md", 0] == (LATER, None)

    kept = populate(shrunk, linked, Settings(dimensions=8, chunk_size=10, replace_stale=False), LATER)
    assert ("a.md", 2, "x" * 5) in rows(kept.notes)


def fake_embedder(texts):
    if any("bad" in t for t in texts):
        raise ValueError("refused")
    return np.full((len(texts), 8), 0.5)


def test_a_failing_batch_leaves_the_others(spark):
    chunks = chunk_notes(disk(spark, {f"{i:02}.md": "bad" if i == 4 else f"ok {i}" for i in range(9)}), 10)
    got = embed_chunks(chunks.coalesce(1).orderBy("path"), fake_embedder, 3).collect()
    assert len(got) == 9
    failed = sorted(r.path for r in got if r.embedding is None)
    assert failed == ["03.md", "04.md", "05.md"]
    assert all("refused" in r.error for r in got if r.embedding is None)
    assert all(len(r.embedding) == 8 for r in got if r.error is None)


def test_vectors_are_checked(spark):
    chunks = chunk_notes(disk(spark, {"a.md": "t"}), 10)
    long = embed_chunks(chunks, lambda texts: np.ones((len(texts), 3)), 5, dim=8).first()
    wild = embed_chunks(chunks, lambda texts: np.full((len(texts), 8), np.nan), 5, dim=8).first()
    assert long.embedding is None and "not 8" in long.error and wild.embedding is None and "finite" in wild.error


def test_one_call_per_batch(spark):
    calls = spark.sparkContext.accumulator(0)

    def counting(texts):
        calls.add(1)
        return np.zeros((len(texts), 4)) + 1

    chunks = chunk_notes(disk(spark, {f"{i}.md": "t" for i in range(120)}), 10).coalesce(1)
    assert embed_chunks(chunks, counting, 50).where("error IS NULL").count() == 120
    assert calls.value == 3


def test_populate_calls_the_model_once_per_text(spark):
    seen = spark.sparkContext.accumulator(0)

    def counting(texts):
        seen.add(len(texts))
        return np.ones((len(texts), 1024)) * 0.01

    notes = {"Note1.md": "This is note 1.", "subfolder/Note2.md": "## Heading for Note 2\nSome details."}
    settings = Settings(embedding_batch_size=10)
    done = populate(disk(spark, notes), spark.createDataFrame([], NOTES_SCHEMA), settings, LATER, counting)
    got = {r.path: r for r in done.notes.collect()}
    assert done.notes.count() == 2 and seen.value == 2
    assert {p: r.raw_content for p, r in got.items()} == notes
    for path, row in got.items():
        assert row.content_hash == hashlib.md5(notes[path].encode()).hexdigest()
        assert (row.modified_at, row.last_embedded_at, row.last_backlinked_at) == (T0, LATER, None)
        assert len(row.embedding) == 1024 and row.chunk_end == len(notes[path])


def test_failed_chunks_keep_their_old_row_and_are_tried_again(spark):
    settings = Settings(dimensions=8, chunk_size=10, embedding_batch_size=1)
    first = populate(disk(spark, {"a.md": "one"}), spark.createDataFrame([], NOTES_SCHEMA), settings, T0, fake_embedder)
    second = populate(disk(spark, {"a.md": "bad"}), first.notes, settings, LATER, fake_embedder)
    assert rows(second.notes) == [("a.md", 0, "one")]
    assert [r.path for r in second.failed.collect()] == ["a.md"]
    third = populate(disk(spark, {"a.md": "good"}), second.notes, settings, LATER, fake_embedder)
    assert rows(third.notes) == [("a.md", 0, "good")]


def test_populate_table_rewrites_touched_buckets_only(spark, tmp_path):
    root = str(tmp_path / "notes")
    assert load_notes(spark, root).count() == 0
    notes = {f"n{i}.md": f"note number {i}" for i in range(200)}
    populate_table(spark, disk(spark, notes), root, SETTINGS, T0)
    assert rows(load_notes(spark, root)) == rows(chunk_notes(disk(spark, notes), 10))
    saves = lambda: sorted((tmp_path / "notes" / "notes").iterdir(), key=lambda p: p.stat().st_mtime)
    assert len(saves()) == 1

    assert populate_table(spark, disk(spark, notes), root, SETTINGS, LATER).changes.count() == 0
    assert len(saves()) == 1

    del notes["n7.md"]
    notes["n8.md"] = "changed"
    notes["new.md"] = "brand new"
    log = str(tmp_path / "log")
    changes = populate_table(spark, disk(spark, notes), root, SETTINGS, LATER, log_folder=log).changes
    assert {r.path for r in changes.collect()} == {"n8.md", "new.md"}
    assert rows(load_notes(spark, root)) == rows(chunk_notes(disk(spark, notes), 10))
    assert len(saves()) == 2 and 1 <= len(list(saves()[1].glob("bucket=*"))) <= 3


def test_an_unfinished_save_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "notes")
    notes = {f"n{i}.md": "text" for i in range(20)}
    populate_table(spark, disk(spark, notes), root, SETTINGS, T0)
    before = rows(load_notes(spark, root))
    stray = load_notes(spark, root).withColumn("bucket", F.lit(1))
    stray.write.partitionBy("bucket").parquet(f"{root}/notes/unfinished")
    assert rows(load_notes(spark, root)) == before
    notes["new.md"] = "more"
    populate_table(spark, disk(spark, notes), root, SETTINGS, LATER)
    assert rows(load_notes(spark, root)) == sorted([*before, ("new.md", 0, "more")])


def test_older_schema_versions_are_rebuilt(spark, tmp_path):
    root = str(tmp_path / "notes")
    save_notes(populate(disk(spark, {"a.md": "x"}), spark.createDataFrame([], NOTES_SCHEMA), SETTINGS, T0).notes, root)
    assert load_notes(spark, root).count() == 1
    assert load_notes(spark, root, version=99).count() == 0


def test_a_note_with_most_chunks_is_spread(spark):
    chunks = spark.range(5000).select(
        F.lit("big").alias("path"), F.col("id").cast("int").alias("chunk_index"), F.lit(None).cast("timestamp").alias("last_backlinked_at")
    )
    small = spark.createDataFrame([("small", 0)], "path string, chunk_index int").withColumn(
        "last_backlinked_at", F.lit(None).cast("timestamp")
    )
    notes = chunks.unionByName(small)
    marked = corpus.mark_backlinked(notes, spark.createDataFrame([("big",)], "path string"), T0)
    assert marked.where("last_backlinked_at IS NOT NULL").count() == 5000
    blocks = corpus.note_blocks(spark.createDataFrame([("big", 4999)], "path string, last_chunk int"))
    assert [r.block for r in blocks.orderBy("block").collect()] == [0, 1, 2, 3, 4]
    assert rows_left(corpus.prune(notes, spark.createDataFrame([("small",)], "path string"))) == [("small", 0)]


def rows_left(notes):
    return [(r.path, r.chunk_index) for r in notes.collect()]


def test_embedding_checks(spark):
    notes = spark.createDataFrame([("a", [1.0, 2.0]), ("b", None), ("c", [1.0])], "path string, embedding array<float>")
    assert validate_embeddings(notes, 2).first().asDict() == {"total_rows": 3, "missing": 1, "wrong_length": 1, "valid": 1}
    assert sorted(r.path for r in invalid_embeddings(notes, 2).collect()) == ["b", "c"]


def test_hash_embed(spark):
    chunks = spark.createDataFrame([("a", "One two\nTWO  "), ("b", " \n"), ("c", "")], "path string, raw_content string")
    got = {r.path: np.array(r.embedding) for r in hash_embed(chunks, 16).collect()}
    assert np.isclose(np.linalg.norm(got["a"]), 1) and sorted(got["a"][got["a"] > 0]) == pytest.approx([5**-0.5, 2 * 5**-0.5])
    assert not got["b"].any() and not got["c"].any()


def test_stored_rows_are_not_shuffled_for_a_small_change(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).select(
        F.concat(F.lit("n"), "id").alias("path"), F.lit(0).alias("chunk_index"), F.lit(0).alias("chunk_start"),
        F.lit(1).alias("chunk_end"), F.lit("h").alias("content_hash"), F.lit(T0).alias("modified_at"),
        F.lit(T0).alias("last_embedded_at"), F.lit(None).cast("timestamp").alias("last_backlinked_at"),
        F.lit("x").alias("raw_content"), F.array(F.lit(1.0).cast("float")).alias("embedding"),
    ).write.parquet(path)
    notes = spark.read.parquet(path)
    plan = corpus.note_metadata(notes)._jdf.queryExecution().executedPlan().toString()
    assert "raw_content" not in plan and "embedding:" not in plan
    new = notes.limit(3).withColumn("raw_content", F.lit("new"))
    plan = corpus.upsert_notes(notes, new)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_a_table_can_become_empty_and_full_again(spark, tmp_path):
    root = str(tmp_path / "notes")
    for notes in ({"a.md": "x", "b.md": "y"}, {}, {"c.md": "z"}):
        shown = disk(spark, notes) if notes else disk(spark, {"a.md": "x"}).limit(0)
        populate_table(spark, shown, root, SETTINGS, T0)
        assert [r[0] for r in rows(load_notes(spark, root))] == sorted(notes)


def test_an_unreadable_file_keeps_its_chunks(spark, tmp_path):
    folder, root = tmp_path / "notes", str(tmp_path / "table")
    folder.mkdir()
    (folder / "a.md").write_text("first")
    (folder / "b.md").write_text("second")

    def run(now):
        return populate_table(
            spark, scan_notes(spark, str(folder)), root, SETTINGS, now, listing=list_notes(spark, str(folder)), log_folder=str(tmp_path / "log")
        )

    report = run(T0)
    assert report.unread.count() == 0 and report.check.first().valid == 2 and report.metrics.first().total_rows == 2
    (folder / "b.md").write_bytes(b"\xff\xfe broken")
    report = run(LATER)
    assert [(r.path, r.reason) for r in report.unread.collect()] == [("b.md", UNREADABLE)]
    assert {r.path: r.raw_content for r in load_notes(spark, root).collect()} == {"a.md": "first", "b.md": "second"}
    assert spark.read.parquet(str(tmp_path / "log")).where("action = 'SCAN'").count() == 1
    (folder / "b.md").unlink()
    run(LATER)
    assert {r.path for r in load_notes(spark, root).collect()} == {"a.md"}


def test_a_folder_is_listed_without_being_asked(spark, tmp_path):
    folder, root = tmp_path / "notes", str(tmp_path / "table")
    (folder / "skipped").mkdir(parents=True)
    settings = replace(SETTINGS, ignore_prefixes=("skipped/",))
    for name in ("a.md", "b.md", "c.md", "skipped/d.md"):
        (folder / name).write_text(name)
        os.utime(folder / name, (0, 0))  # older than any embedding
    assert populate_table(spark, str(folder), root, settings, T0).changes.count() == 3
    (folder / "b.md").write_bytes(b"\xff\xfe broken")
    (folder / "c.md").unlink()
    report = populate_table(spark, str(folder), root, settings, LATER)
    assert [r.path for r in report.unread.collect()] == ["b.md"] and report.changes.count() == 0
    assert {r.path: r.raw_content for r in load_notes(spark, root).collect()} == {"a.md": "a.md", "b.md": "b.md"}


def test_texts_are_gone_through_once_to_find_the_work(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        calls.add(1)
        return text

    rows = disk(spark, {f"{i}.md": f"text {i}" for i in range(50)})
    watched = rows.withColumn("content", seen.asNondeterministic()("content")).withColumn("content_hash", F.md5("content"))
    stored = populate(rows, spark.createDataFrame([], NOTES_SCHEMA), SETTINGS, T0).notes.cache()
    calls.value = 0
    assert populate(watched, stored, SETTINGS, T0).changes.count() == 0
    assert calls.value <= 100  # one inventory; the texts of changed notes are asked for once more


def test_superseded_saves_go_and_a_second_writer_is_refused(spark, tmp_path):
    root = str(tmp_path / "table")
    rows = {f"{i}.md": f"text {i}" for i in range(40)}
    populate_table(spark, disk(spark, rows), root, SETTINGS, T0, buckets=4)
    populate_table(spark, disk(spark, rows | {"3.md": "new"}), root, SETTINGS, LATER)
    before = sorted((r.path, r.raw_content) for r in load_notes(spark, root).collect())
    assert remove_superseded(spark, root) == 1  # one changed note rewrote one bucket of four
    assert sorted((r.path, r.raw_content) for r in load_notes(spark, root).collect()) == before

    stale = load_notes(spark, root)

    import notegraph.sources.table as stored

    current, calls = stored._current, []

    def overtaking(*arguments):
        calls.append(1)
        if len(calls) == 2:
            stored._current = current
            save_notes(stale, root)
        return current(*arguments)

    stored._current = overtaking
    try:
        with pytest.raises(RuntimeError, match="another save"):
            save_notes(stale, root)
    finally:
        stored._current = current


def test_hash_embed_parts_and_lowers_like_the_jvm(spark):
    """Only blank, tab, line feed and carriage return part tokens; each token goes by the first 32 bits of its md5."""
    texts = [None, "", " ", "\t\n\r", "A b\vc\fd A", "Ab  ab\n\nAB\r", "\x00 q \x00", "😀 é É", "ΑΒ x y"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, raw_content string")
    got = {r.i: r.embedding for r in hash_embed(rows, 64).collect()}
    for i, text in enumerate(texts):
        counts = np.zeros(64)
        for token in re.split("[ \t\n\r]+", (text or "").lower()):
            if token:
                counts[int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % 64] += 1
        norm = np.linalg.norm(counts)
        assert got[i] == pytest.approx(counts / norm if norm else counts, abs=1e-6)


def test_digests_are_taken_per_batch_not_per_token(spark):
    rows = spark.createDataFrame([(1, "a b")], "i int, raw_content string")
    plan = hash_embed(rows, 64)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "md5" not in plan


def test_the_registered_upsert_embeds_once(spark):
    from notegraph import catalog

    for query in (catalog.upsert_notes, catalog.upsert_notes_keeping_stale):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" not in plan  # the new chunks are read as written


def test_many_gone_notes_go_in_the_join_of_the_upsert(spark, monkeypatch):
    """Stored rows meet the keys of changed and of gone chunks once, and the result is that of two joins."""
    before = {f"n{i}.md": "x" * (5 + i % 40) for i in range(30)}
    empty = spark.createDataFrame([], NOTES_SCHEMA)
    first = populate(disk(spark, before), empty, SETTINGS, T0).notes
    linked = corpus.mark_backlinked(first, spark.createDataFrame([(f"n{i}.md",) for i in range(0, 30, 2)], "path string"), T0).cache()
    after = {p: (t + "y" if i % 3 else t[:3]) for i, (p, t) in enumerate(before.items()) if i % 4}
    shown = lambda done: sorted(map(str, done.drop("embedding").collect()))
    expected = shown(populate(disk(spark, after), linked, SETTINGS, LATER).notes)
    monkeypatch.setattr("notegraph.operators.sized.BROADCAST_ROWS", 0)
    monkeypatch.setattr("notegraph.plans.populate.BROADCAST_ROWS", 0)
    asked = []
    upsert = corpus.upsert_notes
    monkeypatch.setattr("notegraph.plans.populate.upsert_notes", lambda *a, **k: asked.append(k) or upsert(*a, **k))
    assert shown(populate(disk(spark, after), linked, SETTINGS, LATER).notes) == expected
    assert "removed" in asked[0]
