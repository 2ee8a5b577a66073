"""Keyed live state: circuit breaker (R4) and stall alarms (R5) with ``transformWithStateInPandas``.

State lives in the RocksDB state store, checkpointed with the query, so a restarted or re-run stream carries every key's
state on. Keys are dealt by hash over ``BUCKETS`` groups: a state call or a frame costs the same for one key as for all keys of
a bucket, so their number goes with the micro-batches and not with the keys. What a bucket keeps (a row a key) and what waits
in it (a chunk a micro-batch) are Arrow tables as bytes. A bucket's rows of a micro-batch are sorted by (key, time, id) and
handled as arrays; they are at most a micro-batch, which the source bounds (``maxBytesPerTrigger``).

Two orders across micro-batches:

* As it comes (the default): micro-batches are expected in time order, as a live source delivers them. What comes late is
  defined: a stall ignores it, the breaker counts it when it comes. An event without a time lies before all others.
* ``reorder="<delay>"``: events wait in a list state until the watermark (the greatest time of earlier micro-batches less the
  delay) has passed them and are handled in order of time, whatever micro-batch brought them. What comes with a time below
  the watermark, or without one, is handed out as late and changes nothing. The result depends on the events and the last
  watermark alone. A bucket's waiting rows are those of about the delay.

Times are epoch microseconds; watermark and timers have milliseconds, and an event is passed when its millisecond is below
the watermark.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from parley.operators import breaker as breaker_module
from parley.operators.breaker import NO_TIME, Slice

# The processors are shipped by value: the driver-side runner of transformWithState starts its own
# Python process, which does not see files added with addPyFile.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(breaker_module)

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

BUCKETS = 256  # groups that keys are dealt over; a checkpoint holds for its number
_KEY, _BUCKET = "keyed_by", "bucket"  # frames have no names that begin with an underscore

BREAKER_OUT = "key string, event_id long, failures long, is_open int, can_execute int, executed int, late int"
STALL_OUT = "key string, event_id long, ts timestamp_ntz, prev_ts timestamp_ntz, gap_seconds double, kind string"


def micros(times: pd.Series) -> np.ndarray:
    """Epoch microseconds, ``NO_TIME`` for none."""
    us = times.to_numpy("datetime64[us]")
    return np.where(np.isnat(us), NO_TIME, us.astype(np.int64))


def stamps(us: np.ndarray) -> pd.Series:
    return pd.Series(np.where(us == NO_TIME, np.iinfo(np.int64).min, us).astype("datetime64[us]"))


def packed(**columns) -> bytes:
    table = pa.table(columns)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(blobs: list[bytes]) -> dict[str, np.ndarray] | None:
    """The columns of packed tables of one shape, one after the other."""
    if not blobs:
        return None
    t = pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in blobs])
    return {c: t[c].to_numpy().copy() for c in t.column_names}


def names(keys: np.ndarray) -> np.ndarray:
    """Keys as they are handed out; see :func:`_keyed`."""
    return np.array([k[1:] if k else "None" for k in keys], object)


class KeyedProcessor(StatefulProcessor):
    """Rows of the keys of a bucket in order of (key, time, id), as they come or reordered by event time; ``steps`` is what is
    done with them. ``FIELDS`` are what is kept of a key: name, type, and value for a new one."""

    FIELDS: tuple = ()

    def __init__(self, reorder: bool, ts_col: str, id_col: str, flag_col: str | None = None):
        self.reorder, self.ts_col, self.id_col, self.flag_col = reorder, ts_col, id_col, flag_col

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "rows binary")
        if self.reorder:
            self.waiting = handle.getListState("waiting", "rows binary")
            self.alarm_at = handle.getValueState("timer", "ms long")

    def _run(self, keys, us, ids, flags, passed) -> tuple[pd.DataFrame, dict]:
        """``steps`` on rows and state of the bucket: (rows to hand out, state)."""
        kept = self.known.get()
        old = unpacked([bytes(kept[0])]) if kept else {"key": np.zeros(0, object), **{c: np.zeros(0, t) for c, t, _ in self.FIELDS}}
        n = len(old["key"])
        codes, every = pd.factorize(np.concatenate([old["key"], keys]))
        state = {c: np.concatenate([old[c], np.full(len(every) - n, new, t)]) for c, t, new in self.FIELDS}
        codes = codes[n:]
        at = np.lexsort((ids, us, codes))
        out = self.steps(every, state, codes[at], us[at], ids[at], flags[at], passed)
        self.known.update((packed(key=pa.array(every, pa.string()), **state),))
        return out, state

    def due(self, state: dict) -> int | None:
        """The first time (ms) at which something is to be done without a new row."""
        return None

    def handleInputRows(self, key, rows, timerValues):
        parts = []
        for pdf in rows:  # each frame as four arrays; nothing else of it is kept
            flags = np.zeros(len(pdf), bool) if self.flag_col is None else pdf[self.flag_col].fillna(False).to_numpy(bool)
            parts.append((pdf[_KEY].to_numpy(object), micros(pdf[self.ts_col]), pdf[self.id_col].to_numpy(np.int64), flags))
        keys, us, ids, flags = (np.concatenate(x) for x in zip(*parts))
        if not self.reorder:
            out, _state = self._run(keys, us, ids, flags, None)
            if len(out):
                yield out
            return
        passed = max(timerValues.getCurrentWatermarkInMs(), 0)
        late = (us // 1000 < passed) | (us == NO_TIME)
        if not late.all():
            self.waiting.appendValue((self._chunk(keys, us, ids, flags, ~late),))
            self._wake(int(us[~late].min()) // 1000)
        if late.any():
            yield self.late_rows(names(keys[late]), us[late], ids[late])

    @staticmethod
    def _chunk(keys, us, ids, flags, keep) -> bytes:
        return packed(key=pa.array(keys[keep], pa.string()), us=us[keep], id=ids[keep], flag=flags[keep])

    def _wake(self, ms: int) -> None:
        """One timer a bucket: at the first time at which something is to be done."""
        now = (self.alarm_at.get() or (None,))[0]
        if now is None or ms < now:
            if now is not None:
                self.handle.deleteTimer(now)
            self.handle.registerTimer(ms)
            self.alarm_at.update((ms,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs()
        self.alarm_at.clear()
        rows = unpacked([bytes(r[0]) for r in self.waiting.get()]) if self.waiting.exists() else None
        if rows is None:
            rows = {"key": np.zeros(0, object), "us": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "flag": np.zeros(0, bool)}
        columns = rows["key"], rows["us"], rows["id"], rows["flag"]
        ready = rows["us"] // 1000 < passed
        wake = []
        if not ready.all():
            self.waiting.put([(self._chunk(*columns, ~ready),)])
            wake.append(int(rows["us"][~ready].min()) // 1000)
        elif len(ready):
            self.waiting.clear()
        out, state = self._run(*(x[ready] for x in columns), passed)
        due = self.due(state)
        if due is not None:
            wake.append(due)
        if wake:
            self._wake(min(wake))
        if len(out):
            yield out

    def close(self) -> None:
        pass


def stretches(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of every key in sorted codes."""
    first = np.flatnonzero(np.diff(codes, prepend=-1))
    return first, np.append(first[1:], len(codes)) - 1


class BreakerProcessor(KeyedProcessor):
    """Per key: failures since the last success, open flag, time of the last failure.

    Before each attempt: allowed iff closed, or open for more than ``reset_timeout_s`` since the
    last failure (half-open). With ``suppress=True`` a disallowed attempt is not made: it is
    reported with ``executed = 0`` and leaves the state as it is (live behaviour). With
    ``suppress=False`` every logged outcome counts (replay of a log where every call happened).
    """

    def __init__(self, max_failures: int = 3, reset_timeout_s: int = 60, suppress: bool = False,
                 ts_col: str = "ts", id_col: str = "event_id", failed_col: str = "failed", reorder: bool = False):
        super().__init__(reorder, ts_col, id_col, failed_col)
        self.max_failures, self.reset_us, self.suppress = max_failures, reset_timeout_s * 1_000_000, suppress

    FIELDS = (("failures", np.int64, 0), ("is_open", bool, False), ("last_us", np.int64, NO_TIME))

    def _suppressed(self, state, codes, us, failed, first, last):
        value, opened, made = np.zeros(len(us), np.int64), np.zeros(len(us), bool), np.zeros(len(us), bool)
        for a, b in zip(first.tolist(), (last + 1).tolist()):
            who = codes[a]
            value[a:b], opened[a:b], made[a:b] = Slice(us[a:b], failed[a:b], self.max_failures, self.reset_us).replay(
                bool(state["is_open"][who]), int(state["failures"][who]), int(state["last_us"][who]))
        return value, opened, made, made

    def _counted(self, state, codes, us, failed, first, last):
        place = np.arange(len(us))
        start = np.repeat(first, last - first + 1)
        success = np.maximum.accumulate(np.where(failed, -1, place))
        none = success < start  # no success of the key so far in these rows
        value = place - np.where(none, start - 1, success) + np.where(none, state["failures"][codes], 0)
        opened = value >= self.max_failures
        before, since = np.roll(opened, 1), np.roll(us, 1)  # an open breaker's last event is its last failure
        before[first], since[first] = state["is_open"][codes[first]], state["last_us"][codes[first]]
        return value, opened, ~before | (us > since + self.reset_us), np.ones(len(us), bool)

    def steps(self, keys, state, codes, us, ids, failed, passed) -> pd.DataFrame:
        first, last = stretches(codes)
        how = self._suppressed if self.suppress else self._counted
        value, opened, allowed, made = how(state, codes, us, failed, first, last)
        bad = np.flatnonzero(made & failed)
        state["last_us"][codes[bad]] = us[bad]  # the last one of a key stays
        state["failures"][codes[last]], state["is_open"][codes[last]] = value[last], opened[last]
        return self._frame(names(keys)[codes], ids, value, *(x.astype(np.int32) for x in (opened, allowed, made)),
                           np.zeros(len(us), np.int32))

    def late_rows(self, keys: np.ndarray, us, ids) -> pd.DataFrame:
        none = pd.array([None] * len(ids), "Int64")
        return self._frame(keys, ids, none, none, none, none, np.ones(len(ids), np.int32))

    @staticmethod
    def _frame(key, ids, failures, is_open, can_execute, executed, late) -> pd.DataFrame:
        return pd.DataFrame({"key": key, "event_id": ids, "failures": failures, "is_open": is_open, "can_execute": can_execute,
                             "executed": executed, "late": late})


class StallProcessor(KeyedProcessor):
    """Per key: the time of the latest update. A new update more than ``timeout_s`` after it is a ``gap`` row (the streaming
    form of W4). An update that comes late, with a time not after the latest one, changes nothing: the latest time never goes
    back, so rows out of order give no false gap. With ``alarm=True`` (reordered by event time) a ``silent`` row says that no
    update came within ``timeout_s`` of one: as soon as the watermark has passed that time, or with the update after it."""

    def __init__(self, timeout_s: int = 300, alarm: bool = False, ts_col: str = "ts", id_col: str = "event_id",
                 reorder: bool = False):
        super().__init__(reorder or alarm, ts_col, id_col)
        self.timeout_us, self.alarm = timeout_s * 1_000_000, alarm

    FIELDS = (("seen", bool, False), ("last_us", np.int64, NO_TIME), ("last_id", np.int64, 0), ("silent", bool, False))

    def _passed(self, state, passed) -> np.ndarray:
        """Which keys are silent for longer than the timeout, and it has not been told."""
        open_ = state["seen"] & ~state["silent"] & (state["last_us"] != NO_TIME)
        return open_ & ((state["last_us"] + self.timeout_us) // 1000 < passed)

    def due(self, state) -> int | None:
        open_ = state["seen"] & ~state["silent"]
        return int((state["last_us"][open_] + self.timeout_us).min()) // 1000 if self.alarm and open_.any() else None

    def steps(self, keys, state, codes, us, ids, flags, passed) -> pd.DataFrame:
        first, last = stretches(codes)
        out, shown = [], names(keys)
        for a, b in zip(first.tolist(), (last + 1).tolist()):
            out += self._key_steps(int(codes[a]), shown, state, us[a:b], ids[a:b], passed)
        if self.alarm:  # keys without new rows; those above have been told already
            quiet = np.flatnonzero(self._passed(state, passed))
            out.append((shown[quiet], state["last_id"][quiet], state["last_us"][quiet], state["last_us"][quiet],
                        np.full(len(quiet), np.nan), "silent"))
            state["silent"][quiet] = True
        return self._frame(out)

    def _key_steps(self, who: int, shown, state, us, ids, passed) -> list[tuple]:
        told = False
        if state["seen"][who]:
            told = bool(state["silent"][who])
            us, ids = np.append(state["last_us"][who], us), np.append(state["last_id"][who], ids)
        top = np.maximum.accumulate(us)
        new = np.concatenate([[True], us[1:] > top[:-1]])  # an update that moves the latest time on
        if self.alarm:  # of updates at one time, the last one stands for it
            new = np.concatenate([[True], us[1:] >= top[:-1]])
        us, ids = us[new], ids[new]
        gap = np.diff(us)
        wide = np.flatnonzero((gap > self.timeout_us) & (us[:-1] != NO_TIME))
        key = shown[who]
        out = [(key, ids[wide + 1], us[wide + 1], us[wide], gap[wide] / 1e6, "gap")]
        if self.alarm:
            quiet = wide[1:] if told and len(wide) and wide[0] == 0 else wide  # the first one has been told
            told = told and len(us) == 1
            out.append((key, ids[quiet], us[quiet], us[quiet], np.full(len(quiet), np.nan), "silent"))
        state["seen"][who], state["last_us"][who], state["last_id"][who], state["silent"][who] = True, us[-1], ids[-1], told
        return out

    def late_rows(self, keys: np.ndarray, us, ids) -> pd.DataFrame:
        return self._frame([(keys, ids, us, np.full(len(us), NO_TIME), np.full(len(us), np.nan), "late")])

    @staticmethod
    def _frame(parts) -> pd.DataFrame:
        parts = [p for p in parts if len(p[1])]
        if not parts:
            return pd.DataFrame()
        key, kind = (np.concatenate([np.full(len(p[1]), p[k], object) if isinstance(p[k], str) else p[k] for p in parts]) for k in (0, 5))
        ids, us, prev, gap = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3, 4))
        return pd.DataFrame({"key": key, "event_id": ids, "ts": stamps(us), "prev_ts": stamps(prev), "gap_seconds": gap, "kind": kind})


def use_rocksdb(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _keyed(events: DataFrame, key_col: str, processor: KeyedProcessor, out: str, delay: str | None) -> DataFrame:
    use_rocksdb(events.sparkSession)
    if delay is not None:
        # the watermark is on a copy that the processor does not get, or Spark would drop late rows before it sees them
        ts = F.col(processor.ts_col).cast("timestamp")  # watermarks need TIMESTAMP; naive times are UTC (session time zone)
        events = events.withColumn("_event_time", ts).withWatermark("_event_time", delay).drop("_event_time")
    # a null key is a key of its own, apart from any text
    text = F.coalesce(F.concat(F.lit("="), F.col(key_col).cast("string")), F.lit(""))
    flag = [] if processor.flag_col is None else [processor.flag_col]
    events = events.select(text.alias(_KEY), processor.ts_col, processor.id_col, *flag)
    dealt = events.withColumn(_BUCKET, F.pmod(F.xxhash64(_KEY), F.lit(BUCKETS)))
    return dealt.groupBy(_BUCKET).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=out, outputMode="Append", timeMode="EventTime" if delay else "None")


def breaker_stream(events: DataFrame, key_col: str, *, reorder: str | None = None, **kw) -> DataFrame:
    """R4 on a streaming frame with ``ts``, ``event_id`` and boolean ``failed`` columns; ``reorder`` is the watermark's delay
    within which events may come in any order (``late = 1`` marks those that came later still)."""
    return _keyed(events, key_col, BreakerProcessor(reorder=reorder is not None, **kw), BREAKER_OUT, reorder)


def stall_stream(events: DataFrame, key_col: str, *, alarm: bool = False, watermark: str = "10 minutes",
                 reorder: str | None = None, **kw) -> DataFrame:
    """R5. ``alarm=True`` reorders by event time with the delay ``watermark`` and raises ``silent`` rows."""
    delay = watermark if alarm else reorder
    return _keyed(events, key_col, StallProcessor(alarm=alarm, reorder=delay is not None, **kw), STALL_OUT, delay)
