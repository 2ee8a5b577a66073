"""The batch breaker with suppression against the rule applied event by event."""

import datetime as dt
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parley.operators.breaker import NO_TIME, Slice, States, breaker_suppress


def one_by_one(ts, failed, max_failures, reset, state=(False, 0, NO_TIME)):
    is_open, failures, last = state
    out = []
    for t, bad in zip(ts, failed):
        allowed = not is_open or t > last + reset
        if allowed:
            failures, last = (failures + 1, t) if bad else (0, NO_TIME)
            is_open = failures >= max_failures
        out.append((failures, is_open, allowed))
    return out, (is_open, failures, last if is_open else NO_TIME)


EVENTS = st.lists(st.tuples(st.sampled_from([0, 0, 1, 2, 7]), st.booleans()), min_size=1, max_size=30)


@settings(max_examples=400, deadline=None)
@given(st.lists(EVENTS, min_size=1, max_size=5), st.integers(1, 4), st.sampled_from([0, 3, 10]), st.integers(0, 2))
def test_slices_replay_and_compose(slices, max_failures, reset, untimed):
    now, state, transitions, states = 0, (False, 0, NO_TIME), [], []
    for k, events in enumerate(slices):
        times = []
        for step, _ in events:
            now += step
            times.append(now)
        if k == 0:
            times[:untimed] = [NO_TIME] * len(times[:untimed])
        failed = [bad for _, bad in events]
        part = Slice(np.array(times), np.array(failed), max_failures, reset)
        want, after = one_by_one(times, failed, max_failures, reset, state)
        assert list(zip(*(x.tolist() for x in part.replay(*state)))) == want
        transitions.append(part.summary())
        states.append(state)
        entry = States(*(np.array([x]) for x in state), np.zeros(1, bool))
        got = transitions[-1].apply(entry, reset)
        assert (got.open[0], got.failures[0], got.since[0]) == after
        state = after
    for k in range(len(transitions)):  # all that follows slice k as one, from the state before it
        *earlier, whole = transitions[k:]
        for t in reversed(earlier):
            whole = t.then(whole, reset)
        entry = States(*(np.array([x]) for x in states[k]), np.zeros(1, bool))
        got = whole.apply(entry, reset)
        assert (got.open[0], got.failures[0], got.since[0]) == state


def log(spark, rows):
    return spark.createDataFrame(rows, "user string, id long, ts timestamp_ntz, bad boolean")


def expected(rows, max_failures, reset):
    out = []
    for user in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == user), key=lambda r: (r[2] is not None, r[2] or 0, r[1]))
        times = [NO_TIME if r[2] is None else int((r[2] - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1)) for r in mine]
        got, _ = one_by_one(times, [bool(r[3]) for r in mine], max_failures, reset * 1_000_000)
        out += [(user, r[1], f, int(o), int(a), int(a)) for r, (f, o, a) in zip(mine, got)]
    return sorted(out, key=str)


@pytest.mark.parametrize("slices, max_failures, reset", [(1, 3, 60), (7, 3, 60), (40, 1, 5), (40, 4, 200)])
def test_a_hot_key_over_many_slices(spark, slices, max_failures, reset):
    rng, t0 = random.Random(slices), dt.datetime(2025, 1, 1)
    rows = [("hot" if rng.random() < 0.7 else rng.choice("abc"), i, t0 + dt.timedelta(seconds=rng.randrange(3000)),
             rng.choice([True, True, False, None])) for i in range(600)]
    rows += [(None, 1000 + i, t0 + dt.timedelta(seconds=i), True) for i in range(5)] + [("hot", 2000 + i, None, True) for i in range(3)]
    df = log(spark, rows).withColumn("failures_before", F.lit("kept"))
    got = breaker_suppress(df, key_col="user", failed=F.col("bad"), max_failures=max_failures, reset_timeout_s=reset, slices=slices)
    assert got.columns == [*df.columns, "failures", "is_open", "can_execute", "executed"]
    found = [(r.user, r.id, r.failures, r.is_open, r.can_execute, r.executed) for r in got.collect()]
    assert sorted(found, key=str) == expected(rows, max_failures, reset)


def test_no_task_holds_the_hot_key(spark):
    """Of 3,000 events of one key, no group that is replayed holds more than a few slices' share."""
    t0 = dt.datetime(2025, 1, 1)
    df = log(spark, [("hot", i, t0 + dt.timedelta(seconds=i), i % 3 > 0) for i in range(3000)])
    from parley.operators.ordered import _S, sliced
    sizes = [r["count"] for r in sliced(df, ["user"], ["ts", "id"], 20).groupBy(_S).count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 3000 / 20 * 3
    out = breaker_suppress(df, key_col="user", failed=F.col("bad"), slices=20)
    assert out.count() == 3000


def test_suppression_and_half_open(spark):
    t0 = dt.datetime(2025, 1, 1)
    rows = [("u", i, t0 + dt.timedelta(seconds=s), bad) for i, (s, bad) in enumerate(
        [(0, True), (1, True), (2, True), (3, False), (70, False)])]
    got = breaker_suppress(log(spark, rows), key_col="user", failed=F.col("bad")).orderBy("id").collect()
    assert [(r.failures, r.is_open, r.can_execute, r.executed) for r in got] == [
        (1, 0, 1, 1), (2, 0, 1, 1), (3, 1, 1, 1), (3, 1, 0, 0), (0, 0, 1, 1)]


def test_empty_log_and_bad_limit(spark):
    assert breaker_suppress(log(spark, []), key_col="user", failed=F.col("bad")).count() == 0
    with pytest.raises(ValueError):
        breaker_suppress(log(spark, []), key_col="user", failed=F.col("bad"), max_failures=0)
