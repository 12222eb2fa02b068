import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from notegraph.operators import events as ev
from notegraph.schema import EVENT_SCHEMA

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(microseconds=round(seconds * 1_000_000))


def log(spark, rows):
    """Events from (path, seconds[, kind])."""
    full = [(i, r[0], r[2] if len(r) > 2 else "modified", at(r[1])) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, EVENT_SCHEMA)


def ids(df):
    return sorted(r.event_id for r in df.collect())


def by_path(rows):
    paths = {}
    for i, row in enumerate(rows):
        paths.setdefault(row[0], []).append((row[1], i))
    return {p: sorted(v) for p, v in paths.items()}


def brute_debounce(rows, window):
    kept = []
    for items in by_path(rows).values():
        last = None
        for t, i in items:
            if last is None or round((t - last) * 1e6) >= round(window * 1e6):
                kept.append(i)
                last = t
    return sorted(kept)


def brute_bursts(rows, joins):
    """Bursts as (last id, count); joins(before, t) says whether an event at t joins the one before it."""
    result = []
    for items in by_path(rows).values():
        burst = []
        for t, i in items:
            if burst and not joins(burst[-1][0], t):
                result.append((burst[-1][1], len(burst)))
                burst = []
            burst.append((t, i))
        result.append((burst[-1][1], len(burst)))
    return sorted(result)


def random_rows(seed, n, paths, span, hot=0.4):
    pick = random.Random(seed)
    return [
        (("hot" if pick.random() < hot else f"p{pick.randrange(paths)}") + ".md", round(pick.random() * span, pick.choice([0, 1, 6])))
        for _ in range(n)
    ]


def test_kinds_and_directories(spark):
    rows = [("a", 0, "created"), ("a", 1, "modified"), ("a", 2, "deleted"), ("a", 3, "moved"), ("a", 4, "opened"), ("a", 5, "closed")]
    got = ev.event_kinds(log(spark, rows)).orderBy("event_id").collect()
    assert [r.kind for r in got] == ["created", "modified", "deleted", "modified"]
    marked = log(spark, rows).selectExpr("*", "event_id = 1 AS is_directory")
    assert ids(ev.event_kinds(marked)) == [0, 2, 3]


def test_ignored_paths(spark):
    rows = [(p, 0) for p in ["a.md", "a.md~", "x.tmp", "n/.s.swp", ".git/a.md", ".DS_Store", "ai_logs/b.md", "n/ai_logs/b.md"]]
    assert ids(ev.filter_ignored(log(spark, rows))) == [0, 7]


def test_first_matching_route_wins(spark):
    rows = [("daily/a.md", 0), ("b.MD", 0), ("c.txt", 0), ("d.md.bak", 0)]
    got = {r.path: r.handler for r in ev.route_events(log(spark, rows)).collect()}
    assert got == {"daily/a.md": "backlinker", "b.MD": "backlinker"}
    rules = [("^daily/", "digest"), *ev.ROUTES, (".*", "rest")]
    got = {r.path: r.handler for r in ev.route_events(log(spark, rows), rules).collect()}
    assert got == {"daily/a.md": "digest", "b.MD": "backlinker", "c.txt": "rest", "d.md.bak": "rest"}


def test_own_writes_inside_and_outside_the_window(spark):
    events = log(spark, [("a", 9.9), ("a", 10), ("a", 15), ("a", 15.000001), ("b", 11), ("a", 22)])
    writes = log(spark, [("a", 10), ("a", 20)]).select("path", "ts")
    assert ids(ev.suppress_self_writes(events, writes, 5)) == [0, 3, 4]


@pytest.mark.parametrize("seed, ttl", [(1, 0.5), (2, 5), (3, 300)])
def test_own_writes_equal_brute_force(spark, seed, ttl):
    rows, written = random_rows(seed, 600, 10, 4000), random_rows(seed + 50, 200, 10, 4000)
    expected = [
        i for i, (p, t) in enumerate(rows) if not any(q == p and 0 <= round((t - w) * 1e6) <= ttl * 1e6 for q, w in written)
    ]
    assert ids(ev.suppress_self_writes(log(spark, rows), log(spark, written).select("path", "ts"), ttl)) == expected


def test_debounce_keeps_the_leading_event(spark):
    rows = [("a", 0), ("a", 1), ("a", 1.499999), ("a", 1.5), ("a", 2.9), ("a", 3.0), ("b", 0.1, "deleted"), ("a", 100)]
    assert ids(ev.debounce_events(log(spark, rows))) == [0, 3, 5, 6, 7]


@pytest.mark.parametrize("steps", [1, 2, 3, 16, 1024])
@pytest.mark.parametrize("seed, window", [(1, 1.5), (2, 7.0), (3, 60.0)])
def test_debounce_equals_brute_force(spark, seed, window, steps):
    rows = random_rows(seed, 900, 12, 700)
    rows += [("burst.md", 100 + i / 1000) for i in range(300)] + [("same.md", 5.0)] * 20
    got = ev.debounce_events(log(spark, rows), window, steps_per_bucket=steps)
    assert ids(got) == brute_debounce(rows, window)
    assert got.columns == ["event_id", "path", "kind", "ts"]


@pytest.mark.parametrize("fan, steps", [(2, 1), (2, 2), (3, 4), (7, 1)])
def test_debounce_tree_equals_the_walk(spark, fan, steps):
    """A third of the log is a path whose heartbeat never pauses for a window, so that nothing is ever settled."""
    pick = random.Random(fan * steps)
    rows = random_rows(steps, 300, 8, 500, hot=0)
    rows += [("beat.md", round(k * 0.7 + pick.random() * 0.3, 6)) for k in range(400)]
    rows += [("sparse.md", t) for t in (0, 0.2, 1.4, 1.5, 2.9, 3.0, 400, 401.2, 401.6, 499.9)]
    assert ids(ev.debounce_events(log(spark, rows), 1.5, steps, fan)) == brute_debounce(rows, 1.5)


def hashed_by(df):
    """The keys of all hash exchanges and windows of a plan, by name."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    names = lambda keys: tuple(re.findall(r"([a-z_]+)#", keys))
    exchanges = [names(k) for k in re.findall(r"hashpartitioning\((.*?), \d+\)", plan)]
    windows = [names(k) for k in re.findall(r"windowspecdefinition\((.*?), [a-z_]+#\d+L? ASC", plan)]
    return exchanges, windows


def test_no_task_gets_a_whole_path(spark):
    beat = [("beat.md", k * 1.0) for k in range(6000)]
    rows = log(spark, beat + random_rows(3, 3000, 40, 6000, hot=0))
    kept = ev.debounce_events(rows, 1.5, steps_per_bucket=16)
    exchanges, windows = hashed_by(kept)
    assert exchanges and not windows and all("bucket" in keys for keys in exchanges)
    assert ids(kept) == brute_debounce(beat + random_rows(3, 3000, 40, 6000, hot=0), 1.5)
    # What a task gets: the rows of (path, bucket), of which none has more than a bucket's length of heartbeats.
    buckets = rows.groupBy("path", F.floor(F.unix_micros("ts") / 24_000_000)).count()
    assert buckets.agg(F.max("count")).first()[0] <= 25
    # Bursts: cells and events are put in order within blocks; windows over a path see one row per block.
    gap = 0.01
    bursts = ev.coalesce_events(rows, gap)
    _, windows = hashed_by(bursts)
    assert set(windows) == {("path", "block"), ("path",)}
    plan = bursts._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"windowspecdefinition\(path#\d+, (?!block#)", plan)
    blocks = rows.groupBy("path", F.floor(F.unix_micros("ts") / (1e4 * ev.STEPS_PER_BLOCK))).count()
    edges = blocks.groupBy("path").count().agg(F.max("count")).first()[0]
    assert edges * 9 < 6000
    assert sum(r.n_events for r in bursts.collect()) == 9000


@pytest.mark.parametrize("steps", [1, 2, 5])
def test_bursts_over_many_blocks(spark, steps, monkeypatch):
    monkeypatch.setattr(ev, "STEPS_PER_BLOCK", steps)
    pick = random.Random(steps)
    rows = [("beat.md", round(k * 2.0 + pick.random() * 1.5, 6)) for k in range(300)] + random_rows(steps, 400, 6, 900)
    got = sorted((r.event_id, r.n_events) for r in ev.coalesce_events(log(spark, rows), 3.0).collect())
    assert got == brute_bursts(rows, lambda a, b: round((b - a) * 1e6) <= 3_000_000)
    times = sorted(round(t * 1e6) for _, t in rows)

    def joins(a, b):
        a, b = round(a * 1e6), round(b * 1e6)
        return b - a <= 3_000_000 or (b - a <= 10_000_000 and not any(a + 3_000_000 < t < b for t in times))

    got = sorted((r.event_id, r.n_events) for r in ev.coalesce_two_timer(log(spark, rows)).collect())
    assert got == brute_bursts(rows, joins)


def test_clean_events_with_the_flush_rule(spark):
    rows = [("a.md", 0.0), ("a.md", 8.0), ("b.md", 20.0), ("a.md", 30.0), ("b.md", 34.0), ("a.md", 38.0)]
    nothing = log(spark, []).select("path", "ts")
    got = ev.clean_events(log(spark, rows), nothing, idle_seconds=10.0).orderBy("ts").collect()
    # Nothing at all came between 0 and 8; b came between 30 and 38, and a had its quiet time before 34.
    assert [(r.event_id, r.n_events) for r in got] == [(1, 2), (2, 1), (3, 1), (4, 1), (5, 1)]


def test_debounce_does_not_depend_on_batches(spark):
    rows = random_rows(9, 500, 4, 300)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert ids(ev.debounce_events(log(spark, rows), 2.0, steps_per_bucket=8)) == brute_debounce(rows, 2.0)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_debounce_of_nothing_and_before_1970(spark):
    assert ids(ev.debounce_events(log(spark, []))) == []
    rows = [("a", -2_000_000_000.0), ("a", -1_999_999_999.0), ("a", -1_999_999_998.0)]
    assert ids(ev.debounce_events(log(spark, rows), 1.5, 2)) == [0, 2]


@pytest.mark.parametrize("seed, gap", [(1, 3.0), (2, 0.5), (3, 60.0)])
def test_coalesce_equals_brute_force(spark, seed, gap):
    rows = random_rows(seed, 900, 15, 2000) + [("e", 0), ("e", gap), ("e", 2 * gap + 0.000001)]
    got = sorted((r.event_id, r.n_events) for r in ev.coalesce_events(log(spark, rows), gap).collect())
    assert got == brute_bursts(rows, lambda a, b: round((b - a) * 1e6) <= round(gap * 1e6))


def test_coalesce_keeps_latest_kind_and_times(spark):
    rows = [("a", 0, "created"), ("a", 2, "modified"), ("a", 2, "deleted"), ("a", 9, "created")]
    got = [tuple(r) for r in ev.coalesce_events(log(spark, rows)).orderBy("ts").collect()]
    assert got == [(2, "a", "deleted", at(2), at(0), 3), (3, "a", "created", at(9), at(9), 1)]


@pytest.mark.parametrize("seed, n, span", [(1, 300, 3000), (2, 300, 900), (3, 40, 400)])
def test_two_timers_equal_brute_force(spark, seed, n, span):
    rows = random_rows(seed, n, 6, span)
    times = sorted(round(t * 1e6) for _, t in rows)

    def joins(a, b):
        a, b = round(a * 1e6), round(b * 1e6)
        return b - a <= 3_000_000 or (b - a <= 10_000_000 and not any(a + 3_000_000 < t < b for t in times))

    got = sorted((r.event_id, r.n_events) for r in ev.coalesce_two_timer(log(spark, rows)).collect())
    assert got == brute_bursts(rows, joins)


def test_rules_in_order(spark):
    rows = [
        ("a.md", 0, "modified"), ("a.md", 1, "modified"), ("a.md", 2, "deleted"), ("a.md", 30, "moved"),
        ("b.txt", 0, "modified"), ("c.md", 0, "opened"), ("d.md~", 0, "modified"), ("e.md", 4, "modified"),
    ]
    writes = log(spark, [("e.md", 0)]).select("path", "ts")
    got = ev.clean_events(log(spark, rows), writes).orderBy("ts").collect()
    assert [(r.event_id, r.path, r.kind, r.n_events, r.handler) for r in got] == [
        (2, "a.md", "deleted", 2, "backlinker"), (3, "a.md", "modified", 1, "backlinker"),
    ]


def test_no_plan_pairs_events(spark):
    rows = log(spark, random_rows(4, 100, 3, 100))
    for df in (
        ev.suppress_self_writes(rows, rows.select("path", "ts")),
        ev.debounce_events(rows),
        ev.coalesce_events(rows),
        ev.coalesce_two_timer(rows),
    ):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_debounce_holds_when_joins_change_at_run_time(spark):
    """Enough rows and partitions for adaptive execution to re-plan; a third of them on one path."""
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        path = F.when(F.rand(1) < 0.34, "hot.md").otherwise(F.concat(F.lit("p"), (F.rand(2) * 1500).cast("int")))
        rows = spark.range(300_000).select(
            F.col("id").alias("event_id"), path.alias("path"), F.lit("modified").alias("kind"),
            F.timestamp_micros((F.rand(3) * 9_000 * 1e6).cast("long")).alias("ts"),
        ).cache()
        rows.count()
        items = [(r.path, r.us) for r in rows.select("path", F.unix_micros("ts").alias("us")).collect()]
        expected, last = 0, {}
        for path, us in sorted(items):
            if path not in last or us - last[path] >= 1_500_000:
                expected, last[path] = expected + 1, us
        for steps in (4, 64, 1024):
            kept = ev.debounce_events(rows, 1.5, steps)
            assert kept.count() == expected
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


@pytest.mark.parametrize("idle", [None, 10.0])
def test_steps_that_are_read_twice_are_written_out(spark, idle):
    """Own writes are looked up once, and a burst step does not debounce again."""
    rows = log(spark, random_rows(4, 100, 3, 100))
    cleaned = ev.clean_events(rows, rows.select("path", "ts"), idle_seconds=idle)
    plan = cleaned._jdf.queryExecution().executedPlan().toString()
    assert "last_write" not in plan and ("MapInArrow" in plan) == (idle is None)
