"""Cleaning a log of change events (event_id, path, kind, ts), batch form.

Work is never keyed by path alone: raw events are first reduced or cut by time within a path, so a
path that holds a large part of the log is spread over many tasks. Windows over a whole path only see
one short row per stretch of time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notegraph.functions.text import path_not_ignored, path_not_temporary
from notegraph.operators.materialise import materialise
from notegraph.schema import EVENT_IGNORE_PREFIXES, EVENT_IGNORE_SUFFIXES

# Which kinds are kept and what they become; all others are dropped.
KINDS = {"created": "created", "modified": "modified", "deleted": "deleted", "moved": "modified"}
# Routing rules in order of priority; the first match wins.
ROUTES = (("(?i)\\.md$", "backlinker"),)

STEPS_PER_BUCKET = 1024  # a debounce bucket is this many windows long
FAN = 1024  # buckets, or nodes, below one node of the debounce tree
STEPS_PER_BLOCK = 1024  # bursts are put together within blocks of this many gaps first

_REPORT = "path string, node long, first_us long, total boolean, entries array<long>, exits array<long>"


def micros(seconds: float) -> int:
    return int(round(seconds * 1_000_000))


def _bucket(width: int, us: str = "us") -> Column:
    return F.floor(F.col(us) / F.lit(width)).cast("long")


def filter_ignored(
    events: DataFrame,
    prefixes: Iterable[str] = EVENT_IGNORE_PREFIXES,
    suffixes: Iterable[str] = EVENT_IGNORE_SUFFIXES,
) -> DataFrame:
    path = F.col("path")
    return events.where(path_not_temporary(path, suffixes) & path_not_ignored(path, prefixes))


def event_kinds(events: DataFrame) -> DataFrame:
    """Map kinds; drops unhandled kinds and, where the log marks them, directories."""
    if "is_directory" in events.columns:
        events = events.where(~F.coalesce("is_directory", F.lit(False)))
    mapped = None
    for kind, becomes in KINDS.items():
        test = F.col("kind") == kind
        mapped = F.when(test, becomes) if mapped is None else mapped.when(test, becomes)
    return events.withColumn("kind", mapped).where(F.col("kind").isNotNull())


def route_events(events: DataFrame, rules: Sequence[tuple[str, str]] = ROUTES) -> DataFrame:
    """Adds the handler of the first rule whose pattern is found in the path; drops the others."""
    handler = F.lit(None).cast("string")
    for pattern, name in reversed(list(rules)):
        handler = F.when(F.col("path").rlike(pattern), name).otherwise(handler)
    return events.withColumn("handler", handler).where(F.col("handler").isNotNull())


def suppress_self_writes(events: DataFrame, writes: DataFrame, seconds: float = 5.0) -> DataFrame:
    """Drop events on a path the agent wrote at most `seconds` before.

    Only the last write before an event counts, so this is one running maximum over events and writes
    of a path and time bucket, linear in both, instead of a range join that pairs every event with
    every write. The last write of a bucket is also entered in the next one.
    """
    ttl = micros(seconds)
    width = max(1, ttl) * 16
    written = writes.select("path", F.unix_micros("ts").alias("us")).withColumn("bucket", _bucket(width))
    carried = written.groupBy("path", "bucket").agg(F.max("us").alias("us"))
    carried = carried.withColumn("bucket", F.col("bucket") + 1).select("path", "us", "bucket")
    marks = written.union(carried).withColumn("written", F.col("us")).withColumn("is_event", F.lit(False))
    timed = events.withColumn("us", F.unix_micros("ts")).withColumn("bucket", _bucket(width))
    timed = timed.withColumn("is_event", F.lit(True))
    so_far = (
        Window.partitionBy("path", "bucket")
        .orderBy("us", "is_event")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    recent = F.col("us") - F.col("last_write") <= ttl
    return (
        timed.unionByName(marks, allowMissingColumns=True)
        .withColumn("last_write", F.max("written").over(so_far))
        .where(F.col("is_event") & ~F.coalesce(recent, F.lit(False)))
        .select(*events.columns)
    )


# ---------------------------------------------------------------- debounce


def _changes_at(path: pa.Array, bucket: pa.Array) -> np.ndarray:
    """For each row but the first: does it start another (path, bucket)?"""
    edges = pc.or_(pc.not_equal(path[1:], path[:-1]), pc.not_equal(bucket[1:], bucket[:-1]))
    return edges.to_numpy(zero_copy_only=False).astype(bool)


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Regroup the batches of a partition sorted by (path, bucket) so that no group is cut."""
    parts: list[pa.RecordBatch] = []

    def key(batch: pa.RecordBatch, row: int) -> tuple:
        return batch["path"][row].as_py(), batch["bucket"][row].as_py()

    for batch in batches:
        if batch.num_rows == 0:
            continue
        edges = np.flatnonzero(_changes_at(batch["path"], batch["bucket"]))
        start = int(edges[-1]) + 1 if len(edges) else 0
        if start:
            yield pa.Table.from_batches([*parts, batch.slice(0, start)]).combine_chunks()
            parts = []
        elif parts and key(parts[-1], 0) != key(batch, 0):
            yield pa.Table.from_batches(parts).combine_chunks()
            parts = []
        parts.append(batch.slice(start))
    if parts:
        yield pa.Table.from_batches(parts).combine_chunks()


class _Steps:
    """For each event of rows sorted by (path, bucket, time): its group and its successor.

    The successor of an accepted event is the first event of its group at least one window later;
    all successors are found by one binary search over (group, time) on a common axis. `count` marks
    "none".
    """

    def __init__(self, rows: pa.Table, window: int):
        path, bucket = (rows[c].combine_chunks() for c in ("path", "bucket"))
        self.us = rows["us"].to_numpy()
        self.count = len(rows)
        first = np.r_[True, _changes_at(path, bucket)]
        self.group = np.cumsum(first) - 1
        self.starts = np.flatnonzero(first)
        self.ends = np.r_[self.starts[1:], self.count]
        offset = self.us - self.us[self.starts][self.group]
        self.span = int(offset.max()) + window + 1
        self.axis = self.group * self.span + offset
        following = np.searchsorted(self.axis, self.axis + window, side="left")
        self.following = np.where(following < self.ends[self.group], following, self.count)

    def last_accepted(self) -> np.ndarray:
        """For each event, the last event accepted in its group if it is accepted (pointer doubling)."""
        pointer = np.where(self.following < self.count, self.following, np.arange(self.count))
        while True:
            further = pointer[pointer]
            if np.array_equal(further, pointer):
                return pointer
            pointer = further

    def accepted_from(self, entries: np.ndarray) -> np.ndarray:
        """Flags of the events accepted when each group starts at its entry."""
        flags = np.zeros(self.count, dtype=bool)
        while len(entries := entries[entries < self.count]):
            flags[entries] = True
            entries = self.following[entries]
        return flags


def _composed(first: dict, later: list[dict], window: int) -> tuple[np.ndarray, np.ndarray]:
    """The reports of neighbouring nodes of a path as one: entries and exits of the first one, carried through the others."""
    entries, exits = np.array(first["entries"]), np.array(first["exits"])
    for number, report in enumerate(later):
        ins, outs = np.array(report["entries"]), np.array(report["exits"])
        place = np.searchsorted(ins, exits + window, side="left")
        exits = np.where(place < len(ins), outs[np.minimum(place, len(ins) - 1)], exits)
        if number == 0 and not first["total"]:
            # Who keeps nothing in the first node starts the second one like somebody without a past: it is a window away.
            entries, exits = np.append(entries, report["first_us"]), np.append(exits, outs[0])
    last = np.r_[exits[1:] != exits[:-1], True]
    return entries[last], exits[last]


def _known_starts(reports: DataFrame, window: int, fan: int) -> DataFrame:
    """path, node, before_us of the nodes for which the last event kept before them makes a difference.

    Reports climb a tree of nodes, `fan` to one, until each path has one node; starts come back down. Only
    the range of nodes goes to the driver, and only reports of several children meet in Python.
    """
    reports = materialise(reports)
    low, high = reports.agg(F.min("node"), F.max("node")).first()
    if low is None:
        return reports.select("path", "node", F.lit(None).cast("long").alias("before_us"))
    levels = [reports.withColumn("node", F.col("node") - low)]
    above = F.floor(F.col("node") / fan).cast("long")
    key = ["path", "bucket"]  # the parent, under the name by which groups are told apart

    def families(rows: DataFrame) -> DataFrame:
        return rows.repartition(*key).sortWithinPartitions(*key, "node")

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, pa.Table]]:
        """The rows of nodes that are alone below their parent, and each larger family."""
        for rows in _whole_groups(batches):
            starts = np.flatnonzero(np.r_[True, _changes_at(rows["path"].combine_chunks(), rows["bucket"].combine_chunks())])
            sizes = np.diff(np.r_[starts, len(rows)])
            yield rows.take(pa.array(starts[sizes == 1])), rows.slice(0, 0)
            for start, size in zip(starts[sizes > 1], sizes[sizes > 1]):
                yield rows.slice(0, 0), rows.slice(start, size)

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "bucket", "first_us", "total", "entries", "exits"]
        for alone, family in several(batches):
            yield from alone.select(names).rename_columns(["path", "node", *names[2:]]).to_batches()
            if len(family):
                first, *later = family.to_pylist()
                entries, exits = _composed(first, later, window)
                row = [first["path"], first["bucket"], first["first_us"], True, entries.tolist(), exits.tolist()]
                yield pa.RecordBatch.from_pydict({n: [v] for n, v in zip(["path", "node", *names[2:]], row)})

    def push(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, family in several(batches):
            found = {"path": [], "node": [], "before_us": []}
            last = None
            for row in family.to_pylist():
                if row["node"] < 0:  # the start of the family
                    last = row["before_us"]
                    continue
                if last is not None and row["first_us"] - last < window:
                    for name, value in zip(found, (row["path"], row["node"], last)):
                        found[name].append(value)
                place = 0 if last is None else int(np.searchsorted(row["entries"], last + window, side="left"))
                last = row["exits"][place] if place < len(row["exits"]) else last
            if found["path"]:
                yield pa.RecordBatch.from_arrays([pa.array(found["path"]), pa.array(found["node"]), pa.array(found["before_us"])], list(found))

    top = (high - low) // fan
    while top > 0:
        parents = families(levels[-1].withColumn("bucket", above)).mapInArrow(compose, _REPORT)
        levels.append(materialise(parents))
        top //= fan
    starts = None
    for level in reversed(levels):
        rows = level.withColumn("bucket", above)
        if starts is not None:
            marks = starts.select("path", F.col("node").alias("bucket"), F.lit(-1).cast("long").alias("node"), "before_us")
            rows = rows.unionByName(marks, allowMissingColumns=True)
        else:
            rows = rows.withColumn("before_us", F.lit(None).cast("long"))
        starts = families(rows).mapInArrow(push, "path string, node long, before_us long")
    return starts.withColumn("node", F.col("node") + low)


def debounce_events(
    events: DataFrame, seconds: float = 1.5, steps_per_bucket: int = STEPS_PER_BUCKET, fan: int = FAN
) -> DataFrame:
    """Leading-edge debounce per path: an event is kept when none was kept in the `seconds` before.

    Dropped events do not extend the window, and the kind does not matter. Which events are kept
    depends on the whole past of a path, so the past is cut into buckets of many windows:

    1. each bucket reports its last kept event as a function of the event it starts with (only
       events in its first window can differ, and starts with equal ends are merged);
    2. the functions of `fan` neighbouring buckets are composed into one, and those again, until the
       whole log lies below one node, which starts with nothing;
    3. from there the last kept event before each node is pushed back down, level by level;
    4. each bucket, now knowing the last event kept before it, picks its own.

    Tasks are keyed by (path, node), so a path with any share of the log is spread. A node is one short row per
    child, and a bucket has at most as many different times as its length in microseconds. Spark sorts
    and spills; Python holds one bucket, or one node's children, at a time.
    """
    window = micros(seconds)
    width = window * steps_per_bucket
    key = ["path", "bucket"]
    timed = events.withColumn("us", F.unix_micros("ts")).drop("ts")
    columns, schema = timed.columns, timed.schema
    timed = timed.withColumn("bucket", _bucket(width))

    def in_order(rows: DataFrame, *order: str) -> DataFrame:
        return rows.repartition(*key).sortWithinPartitions(*key, *order)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches):
            steps = _Steps(rows, window)
            late = steps.us >= rows["bucket"].to_numpy() * width + window
            first_late = late & np.r_[True, ~late[:-1] | (steps.group[1:] != steps.group[:-1])]
            entry = np.flatnonzero(~late | first_late)
            end, group = steps.last_accepted()[entry], steps.group[entry]
            kept = np.r_[(end[1:] != end[:-1]) | (group[1:] != group[:-1]), True]
            ends = np.searchsorted(group[kept], np.arange(len(steps.starts) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_pydict(
                {
                    "path": rows["path"].combine_chunks().take(pa.array(steps.starts)),
                    "node": rows["bucket"].combine_chunks().take(pa.array(steps.starts)),
                    "first_us": steps.us[steps.starts],
                    "total": np.maximum.reduceat(late, steps.starts),
                    "entries": pa.ListArray.from_arrays(ends, steps.us[entry[kept]]),
                    "exits": pa.ListArray.from_arrays(ends, steps.us[end[kept]]),
                }
            )

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches):
            marked = rows["before_us"].combine_chunks().take(pa.array(_Steps(rows, window).starts))
            rows = rows.filter(pc.is_null(rows["before_us"]))
            steps, known = _Steps(rows, window), pc.is_valid(marked).to_numpy(zero_copy_only=False)
            before = pc.fill_null(marked, 0).to_numpy(zero_copy_only=False)
            wait = np.where(known, before + window - steps.us[steps.starts], 0)
            wait = np.clip(wait, 0, steps.span - 1)
            entry = np.searchsorted(steps.axis, np.arange(len(steps.starts)) * steps.span + wait, side="left")
            entry = np.where(entry < steps.ends, entry, steps.count)
            yield from rows.select(columns).filter(pa.array(steps.accepted_from(entry))).to_batches()

    known = _known_starts(in_order(timed.select(*key, "us"), "us").mapInArrow(summarise, _REPORT), window, fan)
    # The last kept event before a bucket travels as a first row of the bucket. (A join on the same
    # keys would let Spark drop the repartitioning below and then read its own shuffle in pieces.)
    marks = known.withColumnRenamed("node", "bucket").withColumn("us", F.col("bucket") * width - 1)
    marked = timed.unionByName(marks, allowMissingColumns=True)
    kept = in_order(marked, "us", "event_id").mapInArrow(pick, schema)
    return kept.withColumn("ts", F.timestamp_micros("us")).select(*events.columns)


# ---------------------------------------------------------------- coalesce


def _in_blocks(rows: DataFrame, gap: int) -> DataFrame:
    """Rows (path, lo, hi, ...) with the `block` of time they start in and `previous`, the hi of the row before in it."""
    rows = rows.withColumn("block", _bucket(gap * STEPS_PER_BLOCK, "lo"))
    return rows.withColumn("previous", F.lag("hi").over(Window.partitionBy("path", "block").orderBy("lo")))


def _merge_runs(rows: DataFrame, gap: int) -> DataFrame:
    """Join neighbouring rows (path, block, lo, hi, latest, n, starts) of a path unless they start a run.

    Runs are numbered within a block. Over a whole path only the edges of blocks are put in order: they hand
    numbers down, and where `starts` is not known (null) of the first row of a block, they see whether it comes
    within `gap` of the block before. A run over many blocks is one row per block before it is shuffled.
    """
    first = F.min(F.struct("lo", "starts"))
    edges = rows.groupBy("path", "block").agg(first.alias("first"), F.max("hi").alias("end"), F.sum(F.col("starts").cast("long")).alias("starting"))
    in_path = Window.partitionBy("path").orderBy("block")
    opens = F.coalesce("first.starts", F.col("first.lo") - F.lag("end").over(in_path) > gap, F.lit(True)).cast("long")
    inner = F.coalesce("starting", F.lit(0)) - F.coalesce(F.col("first.starts").cast("long"), F.lit(0))
    edges = edges.select("path", "block", opens.alias("opens"), inner.alias("inner"))
    earlier = F.sum(F.col("opens") + F.col("inner")).over(in_path.rowsBetween(Window.unboundedPreceding, -1))
    edges = edges.select("path", "block", (F.coalesce(earlier, F.lit(0)) + F.col("opens")).alias("before"))
    in_block = Window.partitionBy("path", "block").orderBy("lo")
    # The first row of a block has the number that was handed down; later ones count on from it.
    rows = rows.withColumn("new", F.when(F.row_number().over(in_block) > 1, F.col("starts").cast("long")).otherwise(0))
    rows = rows.withColumn("run", F.sum("new").over(in_block))
    return (
        rows.join(edges, ["path", "block"])
        .withColumn("run", F.col("run") + F.col("before"))
        .groupBy("path", "run")
        .agg(
            F.min("lo").alias("lo"),
            F.max("hi").alias("hi"),
            F.max("latest").alias("latest"),
            F.sum("n").alias("n"),
        )
        .drop("run")
    )


def _quiet_runs(events: DataFrame, gap: int) -> DataFrame:
    """Runs of events of a path with no gap longer than `gap` microseconds.

    Events in one time cell of that length belong together whatever else happens, so they are
    aggregated per (path, cell), before the shuffle where possible, and only cells are put in order, within
    blocks of time; over a whole path only the edges of blocks are.
    """
    cells = (
        events.withColumn("us", F.unix_micros("ts"))
        .groupBy("path", _bucket(gap).alias("cell"))
        .agg(
            F.min("us").alias("lo"),
            F.max("us").alias("hi"),
            F.max(F.struct("us", "event_id", "kind")).alias("latest"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    return _merge_runs(_in_blocks(cells, gap).withColumn("starts", F.col("lo") - F.col("previous") > gap), gap)


def _latest(runs: DataFrame) -> DataFrame:
    return runs.select(
        F.col("latest.event_id").alias("event_id"),
        "path",
        F.col("latest.kind").alias("kind"),
        F.timestamp_micros("hi").alias("ts"),
        F.timestamp_micros("lo").alias("first_ts"),
        F.col("n").alias("n_events"),
    )


def coalesce_events(events: DataFrame, seconds: float = 3.0) -> DataFrame:
    """The latest event of each burst of a path; a burst ends when nothing comes for longer than `seconds`."""
    return _latest(_quiet_runs(events, micros(seconds)))


def coalesce_two_timer(events: DataFrame, quiet: float = 3.0, idle: float = 10.0) -> DataFrame:
    """Like coalesce_events, but a pending event is only sent off after `quiet` when something arrives.

    While no event of any path comes, it waits until `idle` has passed, and the next event of its
    path still joins it. So two bursts at most `idle` apart are one if nothing happened anywhere
    between the end of the quiet time and the second burst. "The next event anywhere" is looked up
    once per distinct time in a sorted timeline cut into buckets of `idle`.
    """
    quiet_us, idle_us = micros(quiet), micros(idle)
    runs = _quiet_runs(events, quiet_us)
    runs = materialise(_in_blocks(runs, idle_us))
    edges = runs.groupBy("path", "block").agg(F.max("hi").alias("end"))
    edges = edges.withColumn("end", F.lag("end").over(Window.partitionBy("path").orderBy("block")))
    runs = runs.join(edges, ["path", "block"]).withColumn("previous", F.coalesce("previous", "end")).drop("end")
    runs = runs.withColumn("ready", F.when(F.col("lo") - F.col("previous") <= idle_us, F.col("previous") + quiet_us))

    times = events.select(F.unix_micros("ts").alias("us")).distinct().withColumn("bucket", _bucket(idle_us))
    carried = times.groupBy((F.col("bucket") - 1).alias("bucket")).agg(F.min("us").alias("us"))
    probes = runs.where(F.col("ready").isNotNull()).select(F.col("ready").alias("us")).distinct()
    probes = probes.withColumn("bucket", _bucket(idle_us)).select("us", "bucket")
    timeline = (
        times.unionByName(carried)
        .withColumn("event_us", F.col("us"))
        .unionByName(probes, allowMissingColumns=True)
    )
    # Backwards in time; at one instant the probe (NULL) comes first, as it asks for later events.
    later = Window.partitionBy("bucket").orderBy(F.col("us").desc(), F.col("event_us").asc_nulls_first())
    upcoming = (
        timeline.withColumn("next_us", F.last("event_us", ignorenulls=True).over(later))
        .where(F.col("event_us").isNull())
        .select(F.col("us").alias("ready"), "next_us")
    )
    # Almost all runs ask for nothing; they must not meet under one empty key.
    asking = runs.where(F.col("ready").isNotNull()).join(upcoming, "ready", "left")
    quiet_ones = runs.where(F.col("ready").isNull()).withColumn("next_us", F.lit(None).cast("long"))
    joined = asking.unionByName(quiet_ones)
    return _latest(_merge_runs(joined.withColumn("starts", F.coalesce(F.col("next_us") < F.col("lo"), F.lit(True))), idle_us))


def clean_events(
    events: DataFrame,
    writes: DataFrame,
    debounce_seconds: float = 1.5,
    quiet_seconds: float = 3.0,
    self_write_seconds: float = 5.0,
    rules: Sequence[tuple[str, str]] = ROUTES,
    idle_seconds: float | None = None,
) -> DataFrame:
    """All rules in order: own writes, ignored paths, kinds, debounce, bursts, routing.

    With idle_seconds a burst is sent off by the two-timer rule: after `quiet_seconds` when anything arrives,
    else after `idle_seconds`. What a later step reads twice is written out.
    """
    events = filter_ignored(suppress_self_writes(events, writes, self_write_seconds))
    events = debounce_events(materialise(event_kinds(events)), debounce_seconds)
    if idle_seconds is None:
        return route_events(coalesce_events(events, quiet_seconds), rules)
    return route_events(coalesce_two_timer(materialise(events), quiet_seconds, idle_seconds), rules)
