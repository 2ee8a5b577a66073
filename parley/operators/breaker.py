"""Circuit breaker with suppression over an event log, as a batch scan (W5, W6 with the live rule of R4).

An attempt that the breaker does not allow is not made and leaves the state as it is, so what an event does depends on all
before it, and neither sums nor lags say it. The rows are cut into slices by key and time (as in ``ordered_scan``), and:

1. What a slice does to its first and its last key, the only ones that can go on in other slices, is summarised as a function
   of the state on entry: closed with 0 .. max-1 failures, or open since a time.
   An open breaker matters only by the first event that it lets through, so the function is a short list of pieces of that
   time. From an event on, the way through the slice is fixed: "closed before event i" and "event j is the probe" each have one
   successor further on, and the ends of all ways follow by pointer doubling on arrays.
2. The functions of about sqrt(slices) neighbouring slices are composed to one, those of a key applied one after the other,
   and the entry state of every slice follows from that of its block: a parallel prefix of two levels over summaries, not rows.
3. Each slice is replayed key by key, its first and last key from their entry states, on arrays again.

No task holds more than a slice's rows or a block's summaries, whatever share of the rows a key has. Defined cases: an
event without a time lies before all others; a null outcome is a success; ties go by id, then by a hash of the row; null
keys form one key. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.operators.ordered import _S, _TIE, sliced
from parley.operators.progress import MAX_FAILURES, RESET_TIMEOUT_S
from parley.session import cut_lineage

NO_TIME = -(1 << 62)  # microseconds; an event without a time
_STATE = [("open", pa.bool_()), ("failures", pa.int64()), ("since", pa.int64()), ("added", pa.bool_())]


@dataclass
class States:
    """Breaker states, one an entry: open or not, failures, time of the last failure; ``added``: ``failures`` is to be added
    to those on entry (the breaker has not been closed since)."""
    open: np.ndarray
    failures: np.ndarray
    since: np.ndarray
    added: np.ndarray

    def at(self, rows) -> "States":
        return States(self.open[rows], self.failures[rows], self.since[rows], self.added[rows])

    def put(self, rows, other: "States") -> None:
        for name in ("open", "failures", "since", "added"):
            getattr(self, name)[rows] = getattr(other, name)

    def on_entry(self, failures: np.ndarray) -> "States":
        return States(self.open, self.failures + np.where(self.added, failures, 0), self.since, np.zeros_like(self.added))

    @classmethod
    def closed(cls, n: int) -> "States":
        zero = np.zeros(n, np.int64)
        return cls(zero.astype(bool), zero.copy(), np.full(n, NO_TIME), zero.astype(bool))


@dataclass
class Transition:
    """What rows do to a state: ``exits`` has the exits of closed entries by failures, then one for each piece of entries
    that are open until a time below ``upto``; an entry that is open beyond the last piece stays as it is."""
    upto: np.ndarray
    exits: States
    max_failures: int

    def apply(self, entry: States, reset_us: int) -> States:
        piece = np.searchsorted(self.upto, entry.since + reset_us, side="right")
        stays = entry.open & (piece == len(self.upto))
        row = np.where(entry.open, self.max_failures + piece, np.minimum(entry.failures, self.max_failures - 1))
        got = self.exits.at(np.where(stays, 0, row))
        # a closed entry has no earlier failures to add to; an open one hands its own relation on
        out = States(got.open, got.failures + np.where(got.added, entry.failures, 0), got.since, got.added & entry.added)
        out.put(stays, entry.at(stays))
        return out


    def then(self, later: "Transition", reset_us: int) -> "Transition":
        """This one and, on what it leaves, a later one. An entry that is open beyond this one's pieces meets the later
        one's as it came."""
        exits, more = later.apply(self.exits, reset_us), later.upto > self.upto[-1]
        other = later.exits.at(self.max_failures + np.flatnonzero(more))
        both = States(*(np.concatenate([getattr(exits, k), getattr(other, k)]) for k, _ in _STATE))
        return Transition(np.concatenate([self.upto, later.upto[more]]), both, self.max_failures)


class Slice:
    """The events of a slice in order, after ``max_failures - 1`` made-up failures that stand for those on entry.

    Node i means "closed without a failure before event i", node n + 1 + j "event j is let through by the open breaker".
    """

    def __init__(self, ts: np.ndarray, failed: np.ndarray, max_failures: int, reset_us: int):
        self.m, self.reset_us, self.lead = max_failures, reset_us, max_failures - 1
        self.ts = np.concatenate([np.full(self.lead, NO_TIME), ts])
        self.failed = np.concatenate([np.ones(self.lead, bool), failed])
        n = self.n = len(self.ts)
        place = np.arange(n)
        self.run = place - np.maximum.accumulate(np.where(self.failed, -1, place)) if n else place  # failures up to here
        trips = np.where(self.run >= max_failures, place, n)
        self.opens = np.append(np.minimum.accumulate(trips[::-1])[::-1], np.full(max_failures, n))[self.lead:][:n + 1]
        self.probe = np.append(np.searchsorted(self.ts, self.ts + reset_us, side="right"), n)  # first event let through after
        self.probe = np.maximum(self.probe, np.arange(1, n + 2)).clip(max=n)
        # successor of every node; `end` has none
        self.end = 2 * n + 1
        jump = self.probe[self.opens]
        after_closed = np.where((self.opens < n) & (jump < n), n + 1 + jump, self.end)
        again = np.where(self.probe[:n] < n, n + 1 + self.probe[:n], self.end)
        after_probe = np.where(self.failed, again, place + 1)
        self.next = np.concatenate([after_closed, after_probe, [self.end]])

    def last_nodes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(last node, failed probes since the breaker was last closed or the way's start, closed once) of each node's way."""
        n, end = self.n, self.end
        last, jump = np.arange(end + 1), self.next.copy()
        probe = np.concatenate([np.zeros(n + 1, bool), self.failed, [False]])
        shut = np.concatenate([np.ones(n + 1, bool), ~self.failed, [False]])  # from here on, counts begin anew
        count, closed = probe.astype(np.int64), shut.copy()
        live = jump != end
        while live.any():
            to = jump[live]
            # what the second half of the way says wins; its count goes on with the first half's if it never closed
            count[live] = np.where(closed[to], count[to], count[live] + count[to])
            closed[live] |= closed[to]
            last[live], jump[live] = last[to], jump[to]
            live = jump != end
        return last, count, closed

    def exits(self, nodes: np.ndarray) -> States:
        """The states after the slice of the ways that begin at ``nodes``."""
        last, count, closed = (x[nodes] for x in self._ends)
        n, m = self.n, self.m
        out = States.closed(len(nodes))
        at_closed = last <= n
        i = np.where(at_closed, last, 0)
        opened = at_closed & (self.opens[i] < n)
        trailing = np.minimum(self.run[-1] if n else 0, n - i)
        out.failures = np.where(opened, m, np.where(at_closed, trailing, 0))
        out.open = opened.copy()
        j = np.where(at_closed, 0, last - n - 1).clip(max=max(n - 1, 0))
        broken = ~at_closed & self.failed[j] if n else opened
        out.open |= broken
        out.failures = np.where(broken, count + np.where(closed, m, 0), out.failures)
        out.added = broken & ~closed
        when = np.where(opened, self.opens[i].clip(max=max(n - 1, 0)), j)
        out.since = np.where(out.open, self.ts[when] if n else NO_TIME, NO_TIME)
        return out

    def summary(self) -> Transition:
        self._ends = self.last_nodes()
        n, lead = self.n, self.lead
        first = self.ts[lead]
        most = int(np.searchsorted(self.ts, first + self.reset_us, side="right"))  # no entry is open for longer
        probes = np.arange(lead, min(most, n - 1) + 1)
        exits = self.exits(np.concatenate([lead - np.arange(self.m), n + 1 + probes]))
        same = np.ones(max(len(probes) - 1, 0), bool)
        for x in (exits.open, exits.failures, exits.since, exits.added):
            same &= x[self.m:-1] == x[self.m + 1:]
        keep = np.append(~same, True)  # of equal neighbours, the last has the piece's end
        rows = np.concatenate([np.arange(self.m), self.m + np.flatnonzero(keep)])
        return Transition(self.ts[probes[keep]], exits.at(rows), self.m)

    def replay(self, is_open: bool, failures: int, since: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(failures, open, executed) after every event of the slice, from the state on entry."""
        n, m, lead = self.n, self.m, self.lead
        begin = int(np.searchsorted(self.ts[lead:], since + self.reset_us, side="right")) + lead if is_open else n
        start = (n + 1 + begin if begin < n else self.end) if is_open else lead - failures
        on = np.zeros(self.end + 1, bool)
        on[start] = True
        jump = self.next
        for _ in range(max(1, int(self.n).bit_length() + 1)):  # nodes of the way: doubling the steps taken
            on[jump[np.flatnonzero(on)]] = True
            jump = jump[jump]
        closed_at, probe_at = np.flatnonzero(on[:n + 1]), np.flatnonzero(on[n + 1:self.end])
        kind = np.full(n, -1)  # per event: 0 a closed stretch begins here, 1 a probe
        kind[closed_at[closed_at < n]] = 0
        kind[probe_at] = 1
        place = np.arange(n)
        mark = np.maximum.accumulate(np.where(kind >= 0, place, -1))  # the node in whose stretch an event lies
        inside, m0 = mark >= 0, np.maximum(mark, 0)
        in_closed = inside & (kind[m0] == 0)
        trip = np.where(in_closed, self.opens[m0], -1)
        counting = in_closed & (place <= trip)
        executed = counting | (inside & (place == mark))
        # failed probes since the last closed stretch, or since entry
        steps = np.cumsum((kind == 1) & self.failed)
        base = np.maximum.accumulate(np.where(kind == 0, place, -1))
        before = np.where(base >= 0, steps[np.maximum(base, 0)], 0)
        probes = steps - before + np.where(base >= 0, m, failures)
        value = np.where(counting, np.minimum(self.run, place - m0 + 1), np.where(in_closed, m, probes))
        value = np.where(inside & ~in_closed & ~self.failed[m0], 0, value)  # a probe that succeeded
        value = np.where(inside, value, failures)
        return value[lead:], (value >= m)[lead:], executed[lead:]


def _times(col: pa.ChunkedArray) -> np.ndarray:
    us = pc.cast(pc.cast(col, pa.timestamp("us", getattr(col.type, "tz", None))), pa.int64())
    return pc.fill_null(us, NO_TIME).to_numpy()


def _in_order(rows: pa.Table, *names: str) -> pa.Table:
    return rows.take(pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in names], null_placement="at_start"))


def _key_bounds(keys: pa.ChunkedArray) -> np.ndarray:
    """Where the keys of sorted rows begin, and their end."""
    code = pc.fill_null(keys.combine_chunks().dictionary_encode().indices, -1).to_numpy()
    return np.concatenate([[0], np.flatnonzero(np.diff(code)) + 1, [len(code)]])


_SUMMARY = "upto array<bigint>, open array<boolean>, failures array<bigint>, since array<bigint>, added array<boolean>"


def _summary_columns(t: Transition) -> dict[str, pa.Array]:
    cols = {"upto": (t.upto, pa.int64()), **{k: (getattr(t.exits, k), kind) for k, kind in _STATE}}
    return {k: pa.array([v], pa.list_(kind)) for k, (v, kind) in cols.items()}


def _transition(rows: pa.Table, k: int, max_failures: int) -> Transition:
    value = {c: rows[c][k].values.to_numpy(zero_copy_only=False) for c in ("upto", *(c for c, _ in _STATE))}
    return Transition(value["upto"], States(*(value[c].copy() for c, _ in _STATE)), max_failures)


def breaker_suppress(df: DataFrame, *, key_col: str, ts_col: str = "ts", id_col: str = "id", failed: Column,
                     max_failures: int = MAX_FAILURES, reset_timeout_s: int = RESET_TIMEOUT_S,
                     slices: int | None = None) -> DataFrame:
    """``df`` with failures, is_open (after the event), can_execute and executed (whether the attempt was made)."""
    if max_failures < 1:
        raise ValueError("max_failures must be at least 1")
    reset_us = int(reset_timeout_s) * 1_000_000
    parts = sliced(df.withColumn("_failed", F.coalesce(failed, F.lit(False))), [key_col], [F.col(ts_col), F.col(id_col)], slices)
    n = slices or int(df.sparkSession.conf.get("parley.ordered.slices", df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    block = max(2, int(n ** 0.5))
    key_type = df.schema[key_col].dataType.simpleString()

    order = ("_k", ts_col, id_col, _TIE)

    def events(rows: pa.Table) -> list[tuple[int, int, Slice]]:
        """(from, to, events) of the keys of sorted rows."""
        ts, bad, at = _times(rows[ts_col]), rows["_failed"].to_numpy(), _key_bounds(rows["_k"]).tolist()
        return [(a, b, Slice(ts[a:b], bad[a:b], max_failures, reset_us)) for a, b in zip(at, at[1:])]

    def summarise(rows: pa.Table) -> pa.Table:
        rows = _in_order(rows, *order)
        at = _key_bounds(rows["_k"]).tolist()
        borders = sorted({(at[0], at[1]), (at[-2], at[-1])})
        out = []
        for a, b in borders:
            part = rows.slice(a, b - a)
            got = events(part)[0][2].summary()
            out.append(pa.table({"_k": part["_k"][:1], _S: part[_S][:1], **_summary_columns(got)}))
        return pa.concat_tables(out)

    narrow = parts.select(F.col(key_col).alias("_k"), _S, ts_col, id_col, _TIE, "_failed")
    steps = cut_lineage(narrow.groupBy(_S).applyInArrow(summarise, f"_k {key_type}, {_S} int, {_SUMMARY}")
                        .withColumn("_b", F.floor(F.col(_S) / block).cast("int")))

    def ordered(rows: pa.Table, by: str) -> list[Transition]:
        rows = rows.take(pc.sort_indices(rows, sort_keys=[(by, "ascending")])).combine_chunks()
        return [_transition(rows, k, max_failures) for k in range(rows.num_rows)]

    def compose(rows: pa.Table) -> pa.Table:
        *earlier, got = ordered(rows, _S)
        for t in reversed(earlier):
            got = t.then(got, reset_us)
        return pa.table({"_k": rows["_k"][:1], "_b": rows["_b"][:1], **_summary_columns(got)})

    def walk(steps: list[Transition], state: States) -> list[States]:
        """The state before each step."""
        out = []
        for t in steps:
            out.append(state)
            state = t.apply(state, reset_us)
        return out

    def entries(rows: pa.Table, number: str, states: list[States]) -> pa.Table:
        at = pc.sort_indices(rows, sort_keys=[(number, "ascending")])
        cols = {k: pa.array([getattr(s, k)[0].item() for s in states], kind) for k, kind in _STATE[:3]}
        return pa.table({"_k": rows["_k"].take(at), number: rows[number].take(at), **cols})

    def blocks(rows: pa.Table) -> pa.Table:
        return entries(rows, "_b", walk(ordered(rows, "_b"), States.closed(1)))

    def inside(rows: pa.Table, entry: pa.Table) -> pa.Table:
        state = States(*(entry[k].to_numpy() for k in ("open", "failures", "since")), np.zeros(1, bool))
        return entries(rows, _S, walk(ordered(rows, _S), state))

    state_type = "open boolean, failures bigint, since bigint"
    tops = steps.groupBy("_k", "_b").applyInArrow(compose, f"_k {key_type}, _b int, {_SUMMARY}").groupBy("_k").applyInArrow(
        blocks, f"_k {key_type}, _b int, {state_type}")
    starts = steps.groupBy("_k", "_b").cogroup(tops.groupBy("_k", "_b")).applyInArrow(
        inside, f"_k {key_type}, {_S} int, {state_type}")

    names = list(df.columns)
    out_type = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def replay(rows: pa.Table, entry: pa.Table) -> pa.Table:
        rows = _in_order(rows, *order)
        known = {r["_k"]: (r["open"], r["failures"], r["since"]) for r in entry.to_pylist()}  # of at most two keys
        parts = events(rows)
        states = [known.get(rows["_k"][a].as_py()) if k in (0, len(parts) - 1) else None for k, (a, _, _) in enumerate(parts)]
        done = [part.replay(*(state or (False, 0, NO_TIME))) for (_, _, part), state in zip(parts, states)]
        failures, is_open, executed = (np.concatenate(x) for x in zip(*done))
        out = rows.select(names)
        for name, value, kind in (("failures", failures, pa.int64()), ("is_open", is_open, pa.int32()),
                                  ("can_execute", executed, pa.int32()), ("executed", executed, pa.int32())):
            out = out.append_column(name, pa.array(value.astype(np.int64), pa.int64()).cast(kind))
        return out

    return parts.withColumn("_k", F.col(key_col)).groupBy(_S).cogroup(starts.groupBy(_S)).applyInArrow(
        replay, f"{out_type}, failures bigint, is_open int, can_execute int, executed int")
