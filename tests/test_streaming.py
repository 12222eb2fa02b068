import datetime as dt
import random
import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from test_events import T0, at, ids, log, random_rows

from notegraph.operators import events as ev
from notegraph.operators.links import similarity_decider
from notegraph.plans.link import suggest_links
from notegraph.schema import Settings
from notegraph.streaming import events as st


def run(stream, folder):
    """Run to the end of the input and return what was emitted."""
    name = f"out_{uuid.uuid4().hex}"
    query = (
        stream.writeStream.format("memory").queryName(name).outputMode("append")
        .option("checkpointLocation", str(folder / name)).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.table(name)


def as_files(events, folder, files=1):
    """Write events as files of increasing time, so that a stream sees them in several batches."""
    rows = events.orderBy("ts", "event_id").collect()
    for n in range(files):
        part = rows[len(rows) * n // files : len(rows) * (n + 1) // files]
        events.sparkSession.createDataFrame(part, events.schema).coalesce(1).write.mode("append").parquet(str(folder))
    return str(folder)


SENTINEL = ("sentinel.md", 100_000.0)


@pytest.mark.parametrize("files", [1, 4])
def test_debounce_stream_equals_batch(spark, tmp_path, files):
    events = log(spark, random_rows(5, 400, 6, 600))
    stream = st.event_stream(spark, as_files(events, tmp_path / "in", files), files_per_trigger=1)
    assert ids(run(st.debounce_stream(stream, 4.0), tmp_path)) == ids(ev.debounce_events(events, 4.0))


def shuffled_files(events, folder, files):
    """Files in which the events lie in no order of time; the end marker comes in one of its own."""
    rows = events.where("path != 'sentinel.md'").collect()
    random.Random(1).shuffle(rows)
    for part in [rows[n::files] for n in range(files)] + [events.where("path = 'sentinel.md'").collect()]:
        events.sparkSession.createDataFrame(part, events.schema).coalesce(1).write.mode("append").parquet(str(folder))
    return str(folder)


def test_ordered_debounce_does_not_depend_on_arrival(spark, tmp_path):
    events = log(spark, random_rows(5, 200, 4, 55) + [SENTINEL])  # all within the lateness
    stream = st.event_stream(spark, shuffled_files(events, tmp_path / "in", 3), files_per_trigger=1)
    got = run(st.debounce_stream(stream, 1.5, ordered=True), tmp_path)
    assert ids(got) == ids(ev.debounce_events(events.where("path != 'sentinel.md'"), 1.5))


@pytest.mark.parametrize("files", [1, 3])
def test_coalesce_stream_equals_batch(spark, tmp_path, files):
    events = log(spark, random_rows(6, 400, 6, 2000) + [SENTINEL])
    stream = st.event_stream(spark, as_files(events, tmp_path / "in", files), files_per_trigger=1)
    got = run(st.coalesce_stream(stream, 3.0), tmp_path).where("path != 'sentinel.md'")
    expected = ev.coalesce_events(events, 3.0).where("path != 'sentinel.md'")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))


def test_suppress_stream_equals_batch(spark, tmp_path):
    events = log(spark, random_rows(7, 300, 6, 2000) + [SENTINEL])
    writes = log(spark, random_rows(8, 100, 6, 2000) + [SENTINEL, ("other.md", 100_000.0)])
    e = st.event_stream(spark, as_files(events, tmp_path / "e"))
    w = st.event_stream(spark, as_files(writes, tmp_path / "w"))
    got = run(st.suppress_stream(e, w, 5.0), tmp_path).where("path != 'sentinel.md'")
    expected = ev.suppress_self_writes(events, writes.select("path", "ts"), 5.0).where("path != 'sentinel.md'")
    assert ids(got) == ids(expected)


def test_suppression_does_not_depend_on_arrival(spark, tmp_path):
    """A third of events and writes on one path; nothing is paired, and state is short rows."""
    events = log(spark, random_rows(7, 300, 6, 55) + [SENTINEL])
    writes = log(spark, random_rows(8, 200, 6, 55) + [SENTINEL, ("other.md", 100_000.0)])
    e = st.event_stream(spark, shuffled_files(events, tmp_path / "e", 3), files_per_trigger=1)
    w = st.event_stream(spark, shuffled_files(writes, tmp_path / "w", 2), files_per_trigger=1)
    stream = st.suppress_stream(e, w, 0.3)
    plan = stream._jdf.queryExecution().analyzed().toString()
    assert "Join" not in plan and "TransformWithState" in plan
    got = run(stream, tmp_path).where("path != 'sentinel.md'")
    expected = ev.suppress_self_writes(events, writes.select("path", "ts"), 0.3).where("path != 'sentinel.md'")
    assert ids(got) == ids(expected) and 0 < len(ids(got)) < 300


@pytest.mark.parametrize("seed, n, span, files", [(1, 200, 2000, 2), (2, 200, 55, 3), (3, 40, 400, 1)])
def test_two_timer_stream_equals_batch(spark, tmp_path, seed, n, span, files):
    events = log(spark, random_rows(seed, n, 6, span) + [SENTINEL])
    write = shuffled_files if span < 60 else as_files  # shuffled: all within the lateness
    stream = st.event_stream(spark, write(events, tmp_path / "in", files), files_per_trigger=1)
    got = run(st.coalesce_two_timer_stream(stream), tmp_path).where("path != 'sentinel.md'")
    expected = ev.coalesce_two_timer(events).where("path != 'sentinel.md'")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))
    assert expected.count() < ev.coalesce_events(events).where("path != 'sentinel.md'").count() or span < 60


def test_clean_stream_with_the_flush_rule(spark, tmp_path):
    events = log(spark, random_rows(9, 300, 6, 2000) + [SENTINEL])
    writes = log(spark, random_rows(8, 60, 6, 2000) + [SENTINEL, ("other.md", 100_000.0)])
    stream = st.event_stream(spark, as_files(events, tmp_path / "e"))
    own = st.event_stream(spark, as_files(writes, tmp_path / "w"))
    got = run(st.clean_stream(stream, 1.5, 3.0, writes=own, idle_seconds=10.0), tmp_path).where("path != 'sentinel.md'")
    expected = ev.clean_events(events, writes.select("path", "ts"), idle_seconds=10.0).where("path != 'sentinel.md'")
    columns = ["event_id", "path", "kind", "ts", "first_ts", "n_events", "handler"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, expected.select(columns).collect()))


def test_clean_stream_equals_batch(spark, tmp_path):
    events = log(spark, random_rows(9, 300, 6, 2000) + [("x.txt", 5.0), ("y.md~", 5.0), ("z.md", 5.0, "opened"), SENTINEL])
    stream = st.event_stream(spark, as_files(events, tmp_path / "in", 2), files_per_trigger=1)
    got = run(st.clean_stream(stream, 1.5, 3.0), tmp_path).where("path != 'sentinel.md'")
    expected = ev.clean_events(events, events.limit(0).select("path", "ts")).where("path != 'sentinel.md'")
    columns = ["event_id", "path", "kind", "ts", "first_ts", "n_events", "handler"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, expected.select(columns).collect()))


def test_clean_stream_leaves_out_own_writes(spark, tmp_path):
    events = log(spark, random_rows(9, 300, 6, 2000) + [SENTINEL])
    writes = log(spark, random_rows(8, 60, 6, 2000) + [SENTINEL, ("other.md", 100_000.0)])
    stream = st.event_stream(spark, as_files(events, tmp_path / "e"))
    own = st.event_stream(spark, as_files(writes, tmp_path / "w"))
    got = run(st.clean_stream(stream, 1.5, 3.0, writes=own), tmp_path).where("path != 'sentinel.md'")
    expected = ev.clean_events(events, writes.select("path", "ts")).where("path != 'sentinel.md'")
    columns = ["event_id", "path", "kind", "ts", "first_ts", "n_events", "handler"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, expected.select(columns).collect()))
    assert expected.count() < ev.clean_events(events, writes.limit(0).select("path", "ts")).count()


def test_state_in_order_of_time_has_a_key_per_group_not_per_path(spark, tmp_path):
    events = log(spark, [(f"p{i}.md", float(i % 50)) for i in range(3000)])
    writes = log(spark, [(f"p{i}.md", 20.0) for i in range(0, 3000, 3)])
    e = st.event_stream(spark, as_files(events, tmp_path / "e"))
    w = st.event_stream(spark, as_files(writes, tmp_path / "w"))
    stream = st.debounce_stream(st.suppress_stream(e, w, 5.0), 1.5, late=None, ordered=True)
    query = (
        stream.writeStream.format("memory").queryName("groups_out").option("checkpointLocation", str(tmp_path / "c"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    held = [s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]]
    assert 0 < max(held) <= 4 * st.GROUPS  # before: a key and a timer for each of 3000 paths


def test_late_events_are_dropped_and_counted(spark, tmp_path):
    schema = log(spark, []).schema
    first, second = [(1, "a.md", "modified", at(1000))], [(4, "c.md", "modified", at(1100))]
    late = [(2, "a.md", "modified", at(1)), (3, "b.md", "modified", at(2000))]
    for rows in (first, second, late):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = st.coalesce_stream(st.event_stream(spark, str(tmp_path / "in"), 1), 3.0)
    name = "late_out"
    query = (
        stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert ids(spark.table(name)) == [1, 4]
    dropped = sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
    assert dropped >= 1


def test_state_of_quiet_paths_is_evicted(spark, tmp_path):
    rows = [(f"p{i}.md", 0.0) for i in range(30)] + [("a.md", 1000.0)]
    events = log(spark, rows)
    folder = as_files(events, tmp_path / "in")
    for n, second in enumerate((2000.0, 3000.0)):
        more = spark.createDataFrame([(100 + n, "a.md", "modified", at(second))], events.schema)
        more.coalesce(1).write.mode("append").parquet(folder)
    stream = st.debounce_stream(st.event_stream(spark, folder, 1), 1.5)
    query = (
        stream.writeStream.format("memory").queryName("evict_out").option("checkpointLocation", str(tmp_path / "c"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert len(ids(spark.table("evict_out"))) == 33
    removed = sum(s["numRowsRemoved"] for p in query.recentProgress for s in p["stateOperators"])
    assert removed >= 30


def test_events_lead_to_links_of_their_notes_only(spark, tmp_path):
    notes = spark.createDataFrame(
        [(p, 0, v, T0, None) for p, v in {"a.md": [1.0, 0.1], "b.md": [1.0, 0.2], "c.md": [1.0, 0.3]}.items()],
        "path string, chunk_index int, embedding array<float>, modified_at timestamp, last_backlinked_at timestamp",
    )
    texts = notes.select("path", F.lit("text").alias("content"))
    events = log(spark, [("a.md", 0.0), ("gone.md", 1.0, "deleted"), ("b.txt", 2.0), SENTINEL])
    target = str(tmp_path / "patches")

    def link(paths):
        patches = suggest_links(notes, texts, similarity_decider(0.9), Settings(dimensions=2), paths)
        patches.write.mode("append").parquet(target)

    stream = st.clean_stream(st.event_stream(spark, as_files(events, tmp_path / "in")))
    query = (
        stream.writeStream.foreachBatch(st.link_on_events(link)).option("checkpointLocation", str(tmp_path / "c"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = spark.read.parquet(target).collect()
    assert [r.path for r in got] == ["a.md"]
    assert "[[b.md]]" in got[0].after and "[[c.md]]" in got[0].after


def test_batch_input_is_refused(spark):
    with pytest.raises(ValueError):
        st.debounce_stream(log(spark, [("a", 0)]))
    assert at(1) - T0 == dt.timedelta(seconds=1)


def test_times_of_a_bucket_are_one_row(spark):
    """Not one row per event time, which all paths would send through a shuffle twice."""
    held = T.StructType.fromDDL("path string, event_id long, kind string, us long")
    names = ["path", "lo", "hi", "event_id", "kind", "n", "follows", "next_lo"]
    rows = pd.DataFrame({"path": [f"p{k % 50}" for k in range(1000)], "event_id": range(1000), "kind": "modified", "us": [k * 7 for k in range(1000)]})
    out, _, _ = st._Runs(3, 10_000, held, names).decide(rows, pd.DataFrame(columns=names), 0)
    times = out[~out["is_run"].astype(bool)]
    assert sorted(times["bucket"]) == [-1, 0]
    assert np.frombuffer(times.set_index("bucket")["times"][0], np.int64).tolist() == rows["us"].tolist()


@pytest.mark.parametrize("seed", range(20))
def test_chains_do_not_depend_on_arrival(seed):
    """Runs of several paths, also of none, come in any order and in any pieces."""
    r = random.Random(seed)
    names = ["path", "lo", "hi", "event_id", "kind", "n", "follows", "next_lo", "bucket", "joins"]
    rows, expected = [], []
    for path in ("a", "b", None):
        lo = [k * 10 for k in range(r.randint(1, 12))]
        near = [r.random() < 0.7 for _ in lo[1:]] + [False]
        joins = [n and r.random() < 0.5 for n in near]
        start = None
        for k, at in enumerate(lo):
            start = at if start is None else start
            rows.append((path, at, at + 4, k, "x", 2, k > 0 and near[k - 1], lo[k + 1] if near[k] else st.NEVER, 0, joins[k]))
            if not joins[k]:
                expected.append((k, path, "x", at + 4, start, 2 * ((at - start) // 10 + 1)))
                start = None
    r.shuffle(rows)
    held, got = pd.DataFrame(columns=names), []
    while rows:
        n = r.randint(1, 6)
        came, rows = pd.DataFrame(rows[:n], columns=names), rows[n:]
        out, rest = st._Chains(names)._chained(pd.concat([held, came], ignore_index=True) if len(held) else came)
        got += list(out.itertuples(index=False, name=None))
        held = st._unpacked([st._packed(rest)], names) if len(rest) else rest
    key = lambda row: (row[1] or "", row[3])
    assert sorted(got, key=key) == sorted(expected, key=key) and not len(held)
