"""Progress percentage, stalls and the circuit breaker replay."""

import datetime as dt

from pyspark.sql import functions as F

from parley.operators import progress as P


def test_progress_pct(spark):
    df = spark.createDataFrame([(50, 100), (0, 0), (20, 10), (0, 100)], "p long, t long")
    got = [r[0] for r in df.select(P.progress_pct("p", "t")).collect()]
    assert got == [50.0, 0.0, 100.0, 0.0]


def test_stall_is_strictly_greater(spark):
    t0 = dt.datetime(2025, 1, 1)
    rows = [("k", 1, t0), ("k", 2, t0 + dt.timedelta(seconds=300)), ("k", 3, t0 + dt.timedelta(seconds=601)),
            ("j", 4, t0)]
    df = spark.createDataFrame(rows, "key string, id long, ts timestamp")
    got = [(r.id, r.gap_seconds) for r in P.stalls(df, key_col="key").collect()]
    assert got == [(3, 301.0)]


def _replay(spark, outcomes, max_failures=3, reset=60):
    t0 = dt.datetime(2025, 1, 1)
    rows = [("u", i, t0 + dt.timedelta(seconds=s), ok) for i, (s, ok) in enumerate(outcomes)]
    df = spark.createDataFrame(rows, "user string, id long, ts timestamp, ok boolean")
    out = P.breaker_replay(df, key_col="user", failed=~F.col("ok"), max_failures=max_failures,
                           reset_timeout_s=reset)
    return [(r.failures, r.is_open, r.can_execute) for r in out.orderBy("id").collect()]


def test_three_failures_open(spark):
    got = _replay(spark, [(0, False), (1, False), (2, False), (3, False)])
    assert got == [(1, 0, 1), (2, 0, 1), (3, 1, 1), (4, 1, 0)]


def test_success_resets(spark):
    got = _replay(spark, [(0, False), (1, False), (2, True), (3, False)])
    assert [g[0] for g in got] == [1, 2, 0, 1]


def test_half_open_after_timeout(spark):
    got = _replay(spark, [(0, False), (11, False), (12, True)], max_failures=1, reset=10)
    # open after the first failure; 11 s later the call is allowed again (half-open); the success closes it
    assert got == [(1, 1, 1), (2, 1, 1), (0, 0, 0)]


def test_breaker_with_skewed_key_slices(spark, tiny_groups):
    from conftest import SF_SMALL
    from parley.plans.catalog import QUERIES
    a = sorted(tuple(r) for r in QUERIES["breaker_gate"](spark, SF_SMALL).collect())
    spark.conf.set("parley.ordered.slices", "1")
    b = sorted(tuple(r) for r in QUERIES["breaker_gate"](spark, SF_SMALL).collect())
    assert a == b


def test_breaker_sliced_users_equal_unsliced(spark):
    """Users with more than 3 events are cut into slices (carry across slices, first rows' lags)."""
    from conftest import SF_MID
    from parley.plans.tables import table
    e = table(spark, SF_MID, "events").filter("user_id < 40")  # a test fixture: 40 users, ~67 events each
    kw = dict(key_col="user_id", ts_col="ts", id_col="event_id", failed=F.col("event_type") == "error",
              max_failures=2, reset_timeout_s=3600)
    cols = ["user_id", "event_id", "failures", "is_open", "can_execute"]
    sliced = sorted(tuple(r) for r in P.breaker_replay(e, slices=40, **kw).select(*cols).collect())
    whole = sorted(tuple(r) for r in P.breaker_replay(e, slices=1, **kw).select(*cols).collect())
    assert sliced == whole and len(whole) == e.count()
