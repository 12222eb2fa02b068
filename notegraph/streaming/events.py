"""The event rules as Structured Streaming queries in event time.

Late rows are dropped by the watermark. State of a path goes when the watermark has passed it. Steps in order of time
work on groups of paths, and hold the rows of a group as a few values, so a call and its state cost a group, not a path.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from notegraph.operators.events import ROUTES, event_kinds, filter_ignored, micros, route_events
from notegraph.operators.materialise import materialise
from notegraph.schema import EVENT_SCHEMA

STATE_STORE = (
    "spark.sql.streaming.stateStore.providerClass",
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
)
NEVER, FOREVER = -(1 << 62), 1 << 62  # times in microseconds that no event has
GROUPS = 256  # fixed value, part of the state's layout: groups of paths that a step in order of time works on
VALUE_ROWS = 1 << 16  # rows of one value of state
_VALUE = T.StructType([T.StructField("rows", T.BinaryType())])
EVICT_AFTER_WINDOWS = 20  # fixed value: how long the time of a kept event is remembered


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Events arriving as parquet files; the limit bounds what one batch holds."""
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def _kept(us: np.ndarray, last: int | None, window: int) -> tuple[list[int], int | None]:
    """Places of the kept ones among sorted times, and the time of the last kept one."""
    position = 0 if last is None else int(np.searchsorted(us, last + window, side="left"))
    kept = []
    while position < len(us):  # one step per kept event, not per event
        kept.append(position)
        last = int(us[position])
        position = int(np.searchsorted(us, last + window, side="left"))
    return kept, last


class _Debounce(StatefulProcessor):
    """Keeps the time of the last kept event of a path, and decides on events as they arrive."""

    def __init__(self, window: int):
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", T.StructType([T.StructField("us", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True).sort_values(["us", "event_id"], kind="stable")
        us = frame["us"].to_numpy()
        last = self.last.get()[0] if self.last.exists() else None
        kept, last = _kept(us, last, self.window)
        if kept:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.last.update((last,))
            self.handle.registerTimer((last + EVICT_AFTER_WINDOWS * self.window) // 1000 + 1)
            yield frame.iloc[kept]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield from ()

    def close(self) -> None:
        pass


def _packed(frame: pd.DataFrame) -> tuple[bytes]:
    """Rows as one value of a state: Arrow's stream format."""
    table = pa.Table.from_pandas(frame, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return (sink.getvalue().to_pybytes(),)


def _unpacked(values: Iterable[tuple[bytes]], names: list[str]) -> pd.DataFrame:
    """The rows of several values; whole numbers that may be missing stay whole."""
    tables = [pa.ipc.open_stream(value[0]).read_all() for value in values]
    if not tables:
        return pd.DataFrame(columns=names)
    whole = {pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype()}
    return pa.concat_tables(tables, promote_options="permissive").to_pandas(types_mapper=whole.get)[names]


class _InOrder(StatefulProcessor):
    """Holds the rows of a group of paths until the watermark has passed them, and then hands them on in order of time.

    A group is one call and a few values of state, however many paths are in it. A subclass says in `decide` what becomes
    of rows that no older row can come before any more, what it remembers of its paths, and when it wants to be called
    again although nothing came.
    """

    def __init__(self, held: T.StructType, order: list[str], remembered: list[str]):
        self.names, self.order, self.remembered = held.names, order, remembered
        # Whole numbers that may be missing, which pandas would turn into floats.
        self.whole = {f.name: "Int64" for f in held if isinstance(f.dataType, (T.IntegerType, T.LongType))}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", _VALUE)
        self.memory = handle.getValueState("memory", _VALUE)

    def decide(self, rows: pd.DataFrame, memory: pd.DataFrame, until: int) -> tuple[pd.DataFrame, pd.DataFrame, int | None]:
        """Output rows with their event time `us`, what to remember, and the time of the next call. until: the watermark
        in microseconds."""
        raise NotImplementedError

    def _wake(self, us: int) -> None:
        """One timer per group, at the first millisecond that is not before `us`."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(-(-us // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            if not len(frame):
                continue
            self.held.appendValue(_packed(frame[self.names].astype(self.whole)))
            least = int(frame["us"].min())
            first = least if first is None else min(first, least)
        timers = list(self.handle.listTimers())
        # A group without held rows has the timer that its subclass asked for, which comes too late for new ones.
        if first is not None and (not timers or -(-first // 1000) < min(timers)):
            self._wake(first)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        held = _unpacked(self.held.get() if self.held.exists() else (), self.names)
        passed = held["us"].to_numpy(np.int64) <= until
        rest = held[~passed]
        memory = _unpacked([self.memory.get()] if self.memory.exists() else [], self.remembered)
        rows = held[passed].sort_values(self.order, kind="stable", ignore_index=True)
        out, memory, again = self.decide(rows, memory, until)
        self.held.clear()
        for at in range(0, len(rest), VALUE_ROWS):
            self.held.appendValue(_packed(rest.iloc[at : at + VALUE_ROWS]))
        if len(memory):
            self.memory.update(_packed(memory))
        else:
            self.memory.clear()
        times = ([int(rest["us"].min())] if len(rest) else []) + ([] if again is None else [again])
        if times:
            self._wake(min(times))
        if len(out):
            yield out.assign(ts=pd.to_datetime(out["us"].astype("int64"), unit="us", utc=True))

    def close(self) -> None:
        pass


def _living(last: dict, names: list[str], length: int, until: int) -> tuple[pd.DataFrame, int | None]:
    """The times that still count for `length`, by key, as rows to remember; and the time to forget the next one."""
    left = [(*key, us) for key, us in last.items() if us + length > until]
    return pd.DataFrame(left, columns=names), min((row[-1] + length for row in left), default=None)


class _OrderedDebounce(_InOrder):
    """Keeps an event of a path when none was kept in the window before. What comes a window later is kept anyway."""

    def __init__(self, window: int, held: T.StructType):
        super().__init__(held, ["us", "event_id"], ["path", "us"])
        self.window = window

    def decide(self, rows, memory, until):
        last = {(path,): us for path, us in zip(memory["path"].tolist(), memory["us"].tolist())}
        kept = []
        for place, (path, us) in enumerate(zip(rows["path"].tolist(), rows["us"].tolist())):
            if us >= last.get((path,), NEVER) + self.window:
                last[(path,)] = us
                kept.append(place)
        return rows.iloc[kept], *_living(last, self.remembered, self.window, until)


class _Suppress(_InOrder):
    """Keeps events of a path and time bucket that come later than `ttl` after the last write before them.

    State: rows that the watermark has not passed, and the one time of the last write, for `ttl`.
    """

    def __init__(self, ttl: int, held: T.StructType):
        # A write comes before an event of the same instant.
        super().__init__(held, ["us", "is_event"], ["path", "bucket", "us"])
        self.ttl = ttl

    def decide(self, rows, memory, until):
        last = {(path, bucket): us for path, bucket, us in memory.itertuples(index=False, name=None)}
        kept = []
        columns = (rows[c].tolist() for c in ("path", "bucket", "us", "is_event"))
        for place, (path, bucket, us, is_event) in enumerate(zip(*columns)):
            if not is_event:
                last[path, bucket] = us
            elif us - last.get((path, bucket), NEVER) > self.ttl:
                kept.append(place)
        return rows.iloc[kept], *_living(last, self.remembered, self.ttl, until)


class _Runs(_InOrder):
    """Cuts the events of each path into quiet runs. Gives the times of each bucket of `idle` as one row (for the bucket
    before, the first of them), and a row for each run as soon as it is known whether another one of the path starts
    within `idle` (next_lo)."""

    def __init__(self, quiet: int, idle: int, held: T.StructType, run: list[str]):
        super().__init__(held, ["us", "event_id"], run)
        self.quiet, self.idle = quiet, idle

    def decide(self, rows, memory, until):
        fresh = {"path": rows["path"], "lo": rows["us"], "hi": rows["us"], "event_id": rows["event_id"], "kind": rows["kind"]}
        fresh = pd.DataFrame(fresh).assign(n=1, follows=False, next_lo=NEVER)
        # The open run of a path comes before its new events.
        items = pd.concat([memory, fresh], ignore_index=True) if len(memory) else fresh
        path = pd.factorize(items["path"], use_na_sentinel=False)[0]
        order = np.argsort(path, kind="stable")
        items, path = items.iloc[order], path[order]
        lo, hi, n = (items[c].to_numpy(np.int64) for c in ("lo", "hi", "n"))
        same, gap = path[1:] == path[:-1], lo[1:] - hi[:-1]
        first = np.flatnonzero(np.r_[np.ones(min(1, len(items)), bool), ~same | (gap > self.quiet)])
        last = np.r_[first[1:], len(items)][: len(first)] - 1
        near = np.r_[np.zeros(min(1, len(items)), bool), same & (gap <= self.idle)][first]
        lo, hi, path = lo[first], hi[last], path[first]
        none = np.full(min(1, len(first)), NEVER)
        runs = pd.DataFrame(
            {
                "path": items["path"].array[first], "lo": lo, "hi": hi, "event_id": items["event_id"].array[last], "kind": items["kind"].array[last],
                "n": np.add.reduceat(n, first) if len(first) else n, "follows": items["follows"].to_numpy(bool)[first] | near,
                "next_lo": np.where(np.r_[near[1:], none > 0], np.r_[lo[1:], none], NEVER),
            },
            columns=self.remembered,
        )
        left = np.r_[path[1:] != path[:-1], none < 0] & (hi + self.idle > until)
        done = runs[~left]
        done = done.assign(us=done["hi"] + self.idle, is_run=True, bucket=(done["hi"] + self.quiet) // self.idle, times=None)
        again = int(hi[left].min()) + self.idle if left.any() else None
        return pd.concat([self._times(np.unique(rows["us"].to_numpy(np.int64))), done], ignore_index=True), runs[left], again

    def _times(self, us: np.ndarray) -> pd.DataFrame:
        bucket = us // self.idle
        first = np.flatnonzero(np.r_[np.ones(min(1, len(us)), bool), bucket[1:] != bucket[:-1]])
        parts = [part.tobytes() for part in np.split(us, first[1:])] if len(us) else []
        none = {"path": "", "lo": 0, "hi": 0, "event_id": 0, "kind": "", "n": 0, "follows": False, "next_lo": NEVER}
        start = us[first]
        return pd.DataFrame(
            {"us": np.r_[start, start], "bucket": np.r_[bucket[first], bucket[first] - 1], "times": parts + [x.tobytes() for x in start]}
        ).assign(is_run=False, **none)


class _Timeline(StatefulProcessor):
    """The times of all paths in one bucket of `idle` (and the first one of the next bucket), for runs that ask whether
    anything came between the end of their quiet time and the next run of their path."""

    def __init__(self, quiet: int, idle: int, run: list[str]):
        self.quiet, self.idle, self.run = quiet, idle, run

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", _VALUE)
        self.asking = handle.getListState("asking", _VALUE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            is_run = frame["is_run"].to_numpy(bool)
            times, frame = frame.loc[~is_run, "times"], frame[is_run].drop(columns="times")
            asks = frame["next_lo"].to_numpy(np.int64) != NEVER
            if not asks.all():
                yield frame[~asks].assign(joins=False)
            if asks.any():
                self.asking.appendValue(_packed(frame.loc[asks, self.run]))
            if len(times):
                us = np.unique(np.frombuffer(b"".join(times), np.int64))
                later = us >= (key[0] + 1) * self.idle
                self.times.appendValue((np.r_[us[~later], us[later][:1]].tobytes(),))
        if not list(self.handle.listTimers()):
            self.handle.registerTimer(-(-(key[0] + 2) * self.idle // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        parts = [np.frombuffer(value[0], np.int64) for value in self.times.get()] if self.times.exists() else []
        times = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
        asked = _unpacked(self.asking.get() if self.asking.exists() else (), self.run)
        self.times.clear()
        self.asking.clear()
        if len(asked):
            upcoming = np.r_[times, FOREVER][np.searchsorted(times, asked["hi"].to_numpy(np.int64) + self.quiet, side="right")]
            at = (key[0] + 2) * self.idle
            joins = upcoming >= asked["next_lo"].to_numpy(np.int64)
            ts = pd.to_datetime(pd.Series(at, index=asked.index), unit="us", utc=True)
            yield asked.assign(joins=joins, us=at, is_run=True, ts=ts)

    def close(self) -> None:
        pass


class _Chains(StatefulProcessor):
    """Puts runs of a path together that join their next one, when all of a chain are there; a group of paths at a time."""

    def __init__(self, run: list[str]):
        self.run = run

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", _VALUE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = [frame[self.run] for frame in rows if len(frame)]
        if not came:
            return
        held = _unpacked(self.held.get() if self.held.exists() else (), self.run)
        out, rest = self._chained(pd.concat([held, *came], ignore_index=True) if len(held) else pd.concat(came, ignore_index=True))
        self.held.clear()
        for at in range(0, len(rest), VALUE_ROWS):
            self.held.appendValue(_packed(rest.iloc[at : at + VALUE_ROWS]))
        if len(out):
            yield out

    def _chained(self, rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        """The whole chains as bursts, and what has to wait: runs, and marks (n = 0) of the starts of chains to come."""
        path = pd.factorize(rows["path"], use_na_sentinel=False)[0]
        lo, is_run = rows["lo"].to_numpy(np.int64), rows["n"].to_numpy(np.int64) > 0
        order = np.lexsort((is_run, lo, path))  # a mark comes before its run
        rows, path, lo, is_run = rows.iloc[order], path[order], lo[order], is_run[order]
        marked = np.r_[False, ~is_run[:-1] & (path[1:] == path[:-1]) & (lo[1:] == lo[:-1])]
        waiting = ~is_run & ~np.r_[marked[1:], False]
        marks, rows, path, lo, marked = rows[waiting], rows[is_run], path[is_run], lo[is_run], marked[is_run]
        if not len(rows):
            return rows[:0], marks
        hi, n, next_lo = (rows[c].to_numpy(np.int64) for c in ("hi", "n", "next_lo"))
        joins = rows["joins"].to_numpy(bool)
        # Runs of a path do not overlap, so the next one is the next row, if it is there.
        beside = np.r_[(path[1:] == path[:-1]) & (next_lo[:-1] == lo[1:]), False]
        behind = np.r_[False, beside[:-1]]
        first = np.flatnonzero(~(behind & np.r_[False, joins[:-1]]))
        last = np.r_[first[1:], len(rows)] - 1
        # A chain begins where the run before does not join it, which that run says itself or left a mark of.
        whole = (~rows["follows"].to_numpy(bool)[first] | marked[first] | behind[first]) & ~joins[last]
        out = pd.DataFrame(
            {
                "event_id": rows["event_id"].array[last], "path": rows["path"].array[last], "kind": rows["kind"].array[last],
                "us": hi[last], "first_us": lo[first], "n_events": np.add.reduceat(n, first),
            }
        )[whole]
        sent = np.repeat(whole, last - first + 1)
        # What does not join leaves a mark for the next run, unless that one has been sent off, or waits with a mark.
        has_mark = marked | (behind & ~np.r_[False, joins[:-1]])
        ends = sent & ~joins & (next_lo != NEVER) & ~beside
        new = rows[ends].assign(lo=next_lo[ends])
        unsent = ~sent & has_mark
        new = pd.concat([marks, new, rows[unsent]], ignore_index=True)
        new = new.assign(hi=0, event_id=0, kind="", n=0, follows=False, next_lo=0, joins=False)
        rest = rows[~sent].assign(next_lo=np.where(beside & ~joins, NEVER, next_lo)[~sent])
        return out, pd.concat([new, rest], ignore_index=True)[self.run]

    def close(self) -> None:
        pass


def _by_group(rows: DataFrame, *keys: str) -> GroupedData:
    """Paths are dealt to groups, each of which is one call of a processor and one key of state."""
    group = F.pmod(F.xxhash64(*keys), F.lit(GROUPS)).cast("int")
    return rows.withColumn("path_group", group).groupBy("path_group")


def _untimed(rows: DataFrame) -> T.StructType:
    """What a step holds of rows: `us` stands for the event time."""
    return T.StructType([field for field in rows.schema if field.name != "ts"])


def debounce_stream(
    events: DataFrame, seconds: float = 1.5, late: str | None = "1 minute", ordered: bool = False
) -> DataFrame:
    """Debounce of a stream. late=None: the events have a watermark already. Its output carries `ts` as event time for further steps.

    ordered=True is the streaming twin of debounce_events, in whatever order events arrive within `late`: an event is
    held until the watermark has passed it. Otherwise it is decided on when it arrives, at once, but an event that comes
    in a later micro-batch than a newer kept one of its path is dropped and may shift later decisions.
    """
    events.sparkSession.conf.set(*STATE_STORE)
    if not events.isStreaming:
        raise ValueError("a batch belongs to operators.events.debounce_events")
    if late is not None:
        events = events.withWatermark("ts", late)
    timed = events.withColumn("us", F.unix_micros("ts"))
    window = micros(seconds)
    processor = _OrderedDebounce(window, _untimed(timed)) if ordered else _Debounce(window)
    grouped = _by_group(timed, "path") if ordered else timed.groupBy("path")
    return (
        grouped.transformWithStateInPandas(processor, timed.schema, "Append", "EventTime", eventTimeColumnName="ts")
        .select(*events.columns)
    )


def coalesce_stream(events: DataFrame, seconds: float = 3.0, late: str | None = "1 minute") -> DataFrame:
    """Streaming twin of coalesce_events: a burst is emitted once the watermark has passed its end."""
    if late is not None:
        events = events.withWatermark("ts", late)
    gap = f"{micros(seconds)} microseconds"
    latest = F.max(F.struct(F.unix_micros("ts").alias("us"), "event_id", "kind")).alias("latest")
    bursts = events.groupBy("path", F.session_window("ts", gap).alias("burst")).agg(
        latest, F.count(F.lit(1)).alias("n_events")
    )
    return bursts.select(
        F.col("latest.event_id").alias("event_id"),
        "path",
        F.col("latest.kind").alias("kind"),
        F.timestamp_micros("latest.us").alias("ts"),
        F.col("burst.start").alias("first_ts"),
        "n_events",
    )


def coalesce_two_timer_stream(
    events: DataFrame, quiet: float = 3.0, idle: float = 10.0, late: str | None = "1 minute"
) -> DataFrame:
    """Streaming twin of coalesce_two_timer: a burst is sent off after `quiet` when anything arrives, else after `idle`.

    Three stateful steps. Per path: quiet runs, and whether another one starts within `idle`. Per time bucket: the times
    of all paths answer, for the runs that ask, whether something came in between. Per path again: runs that
    join are put together. State is what the watermark has not passed, and the open run of each path.
    """
    events.sparkSession.conf.set(*STATE_STORE)
    if late is not None:
        events = events.withWatermark("ts", late)
    quiet_us, idle_us = micros(quiet), micros(idle)
    run = "path string, lo long, hi long, event_id long, kind string, n long, follows boolean, next_lo long"
    marked = f"{run}, us long, is_run boolean, bucket long, times binary, ts timestamp"
    timed = events.select("path", "event_id", "kind", "ts", F.unix_micros("ts").alias("us"))
    names = T.StructType.fromDDL(run).names
    runs = _by_group(timed, "path").transformWithStateInPandas(
        _Runs(quiet_us, idle_us, _untimed(timed), names),
        T.StructType.fromDDL(marked), "Append", "EventTime", eventTimeColumnName="ts",
    )
    answered = f"{run}, us long, is_run boolean, ts timestamp, bucket long, joins boolean"
    known = runs.groupBy("bucket").transformWithStateInPandas(
        _Timeline(quiet_us, idle_us, [*names, "bucket"]), T.StructType.fromDDL(answered), "Append", "EventTime", eventTimeColumnName="ts"
    )
    bursts = _by_group(known, "path").transformWithStateInPandas(
        _Chains([*names, "joins"]),
        "event_id long, path string, kind string, us long, first_us long, n_events long", "Append", "None",
    )
    return bursts.select(
        "event_id", "path", "kind", F.timestamp_micros("us").alias("ts"), F.timestamp_micros("first_us").alias("first_ts"), "n_events"
    )


def suppress_stream(
    events: DataFrame, writes: DataFrame, seconds: float = 5.0, late: str | None = "1 minute"
) -> DataFrame:
    """Streaming twin of suppress_self_writes: a running maximum of write times over both streams, per path and bucket.

    Events and writes come together in one processor, which holds them until the watermark has passed them; nothing is paired.
    late=None: both streams have a watermark already.
    """
    events.sparkSession.conf.set(*STATE_STORE)
    writes = writes.select("path", "ts")
    if late is not None:
        events, writes = events.withWatermark("ts", late), writes.withWatermark("ts", late)
    ttl = micros(seconds)
    bucket = F.floor(F.unix_micros("ts") / (16 * max(1, ttl))).cast("long")
    timed = events.withColumn("bucket", bucket).withColumn("is_event", F.lit(True))
    # A write also counts in the bucket after its own.
    marks = writes.withColumn("bucket", F.explode(F.array(bucket, bucket + 1))).withColumn("is_event", F.lit(False))
    both = timed.unionByName(marks, allowMissingColumns=True).withColumn("us", F.unix_micros("ts"))
    out = T.StructType([T.StructField(f.name, f.dataType) for f in both.schema if f.name != "bucket"])
    kept = _by_group(both, "path", "bucket").transformWithStateInPandas(
        _Suppress(ttl, _untimed(both)), out, "Append", "EventTime", eventTimeColumnName="ts"
    )
    return kept.select(*events.columns)


def clean_stream(
    events: DataFrame,
    debounce_seconds: float = 1.5,
    quiet_seconds: float = 3.0,
    late: str = "1 minute",
    rules: Sequence[tuple[str, str]] = ROUTES,
    writes: DataFrame | None = None,
    self_write_seconds: float = 5.0,
    idle_seconds: float | None = None,
) -> DataFrame:
    """Own writes (a stream of path and ts, if given), ignored paths, kinds, debounce, bursts and routing in one
    streaming plan. Without `writes` a linker would react to its own patches. With idle_seconds bursts follow the
    two-timer rule, as in clean_events."""
    if writes is not None:
        events = suppress_stream(events, writes, self_write_seconds, late)
    # The bursts need the watermark to pass an event anyway, so holding events until then delays nothing much.
    kept = debounce_stream(
        event_kinds(filter_ignored(events)), debounce_seconds, late if writes is None else None, ordered=True
    )
    if idle_seconds is None:
        return route_events(coalesce_stream(kept, quiet_seconds, late=None), rules)
    return route_events(coalesce_two_timer_stream(kept, quiet_seconds, idle_seconds, late=None), rules)


def link_on_events(link: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """For writeStream.foreachBatch: hand the paths of each batch of routed events to `link`.

    A batch may be replayed after a failure; linking the same state again gives the same patches.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        # Written out, so that the micro-batch is evaluated once for both uses.
        paths = materialise(batch.where(F.col("handler") == ROUTES[0][1]).select("path").distinct())
        if not paths.isEmpty():
            link(paths)

    return handle
