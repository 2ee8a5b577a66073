"""Keyed-state breaker and stall processors."""

import datetime as dt


from parley.streaming.stateful import breaker_stream, stall_stream


def _events(spark, spec):
    t0 = dt.datetime(2025, 1, 1)
    rows = [("u", i, t0 + dt.timedelta(seconds=s), failed) for i, (s, failed) in enumerate(spec)]
    return spark.createDataFrame(rows, "user string, event_id long, ts timestamp_ntz, failed boolean")


def _stream_of(spark, df, tmp_path, name):
    src = str(tmp_path / f"{name}_src")
    df.coalesce(1).write.parquet(src)
    return spark.readStream.schema(df.schema).parquet(src)


def _drain(spark, df, tmp_path, name):
    out, ckpt = str(tmp_path / f"{name}_out"), str(tmp_path / f"{name}_ckpt")
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt) \
        .trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out).orderBy("event_id").collect()


def test_breaker_suppresses_while_open(spark, tmp_path):
    ev = _events(spark, [(0, True), (1, True), (2, True), (3, False), (70, False)])
    s = _stream_of(spark, ev, tmp_path, "b")
    rows = _drain(spark, breaker_stream(s, "user", suppress=True), tmp_path, "b")
    got = [(r.failures, r.is_open, r.can_execute, r.executed) for r in rows]
    # open after 3 failures; the call at 3 s is suppressed (state unchanged); at 70 s it is half-open and succeeds
    assert got == [(1, 0, 1, 1), (2, 0, 1, 1), (3, 1, 1, 1), (3, 1, 0, 0), (0, 0, 1, 1)]


def test_stall_gaps(spark, tmp_path):
    ev = _events(spark, [(0, False), (100, False), (500, False), (801, False)])
    s = _stream_of(spark, ev, tmp_path, "s")
    rows = _drain(spark, stall_stream(s, "user"), tmp_path, "s")
    assert [(r.event_id, r.gap_seconds, r.kind) for r in rows] == [(2, 400.0, "gap"), (3, 301.0, "gap")]


def test_stall_alarm_timer_fires_on_silence(spark, tmp_path):
    t0 = dt.datetime(2025, 1, 1)
    src = str(tmp_path / "a_src")
    # three files, one per micro-batch: 'u' goes silent after 100 s; 'v' moves event time far ahead
    batches = [[("u", 0, t0), ("u", 1, t0 + dt.timedelta(seconds=100))],
               [("v", 2, t0 + dt.timedelta(seconds=2000))],
               [("v", 3, t0 + dt.timedelta(seconds=4000))]]
    schema = "user string, event_id long, ts timestamp_ntz, failed boolean"
    for b in batches:
        spark.createDataFrame([(k, i, ts, False) for k, i, ts in b], schema).coalesce(1) \
            .write.mode("append").parquet(src)
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    rows = _drain(spark, stall_stream(s, "user", alarm=True, watermark="1 second"), tmp_path, "a")
    silent = [(r.key, r.event_id) for r in rows if r.kind == "silent"]
    assert ("u", 1) in silent


def test_late_updates_give_no_false_gap(spark, tmp_path):
    src = str(tmp_path / "late_src")
    for seconds in ([(0, 1000)], [(1, 0)], [(2, 1100)]):
        t0 = dt.datetime(2025, 1, 1)
        spark.createDataFrame([("u", i, t0 + dt.timedelta(seconds=s), False) for i, s in seconds],
                              "user string, event_id long, ts timestamp_ntz, failed boolean").coalesce(1).write.mode("append").parquet(src)
    s = spark.readStream.schema("user string, event_id long, ts timestamp_ntz, failed boolean").option(
        "maxFilesPerTrigger", 1).parquet(src)
    assert _drain(spark, stall_stream(s, "user"), tmp_path, "late") == []


SCHEMA = "user string, event_id long, ts timestamp_ntz, failed boolean"
T0 = dt.datetime(2025, 1, 1)


def _files(spark, tmp_path, name, batches):
    """One file, and so one micro-batch, for each list of (user, id, seconds or None, failed)."""
    import os
    src = str(tmp_path / f"{name}_src")
    for k, batch in enumerate(batches):
        rows = [(u, i, None if s is None else T0 + dt.timedelta(seconds=s), f) for u, i, s, f in batch]
        before = set(os.listdir(src)) if k else set()
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        for f in set(os.listdir(src)) - before:
            os.utime(f"{src}/{f}", (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)


def test_events_out_of_order_give_the_rows_of_ordered_input(spark, tmp_path):
    import random

    from parley.operators.breaker import breaker_suppress
    from pyspark.sql import functions as F
    rng = random.Random(4)
    events = [(rng.choice("aab"), i, 10 * i + rng.randrange(9), rng.random() < 0.7) for i in range(120)]
    came = sorted(events, key=lambda e: e[2] + rng.randrange(300))  # up to 300 s late
    batches = [came[k:k + 24] for k in range(0, 120, 24)] + [[("end", 999, 100_000, False)], [("end", 1000, 200_000, False)]]
    df = spark.createDataFrame([(u, i, T0 + dt.timedelta(seconds=s), f) for u, i, s, f in events], SCHEMA)
    for suppress in (True, False):
        s = breaker_stream(_files(spark, tmp_path, f"r{suppress}", batches), "user", reorder="300 seconds", suppress=suppress)
        rows = [r for r in _drain(spark, s, tmp_path, f"r{suppress}") if r.key != "end"]
        assert len(rows) == 120 and not any(r.late for r in rows)
        got = [(r.key, r.event_id, r.failures, r.is_open, r.can_execute) for r in rows]
        if suppress:
            want = breaker_suppress(df, key_col="user", id_col="event_id", failed=F.col("failed"))
        else:
            from parley.operators.progress import breaker_replay
            want = breaker_replay(df, key_col="user", id_col="event_id", failed=F.col("failed"))
        assert sorted(got) == sorted((r.user, r.event_id, r.failures, r.is_open, r.can_execute) for r in want.collect())


def test_what_comes_after_the_watermark_is_handed_out_as_late(spark, tmp_path):
    batches = [[("u", 1, 1000, True)], [("u", 2, 1005, True)], [("u", 3, 10, True), ("u", 4, None, True), ("u", 5, 1010, True)],
               [("v", 6, 9000, False)], [("v", 7, 19000, False)]]
    rows = _drain(spark, breaker_stream(_files(spark, tmp_path, "l", batches), "user", reorder="60 seconds"), tmp_path, "l")
    assert [(r.event_id, r.failures, r.late) for r in rows if r.key == "u"] == [(1, 1, 0), (2, 2, 0), (3, None, 1), (4, None, 1), (5, 3, 0)]


def test_events_without_a_time_are_kept_and_come_first(spark, tmp_path):
    batches = [[("u", 1, 5, True), ("u", 2, None, True), ("u", 3, None, False), ("v", 9, None, True)], [("u", 4, 6, True)]]
    for suppress in (False, True):
        s = breaker_stream(_files(spark, tmp_path, f"n{suppress}", batches), "user", suppress=suppress)
        rows = _drain(spark, s, tmp_path, f"n{suppress}")
        assert [(r.event_id, r.failures) for r in rows] == [(1, 1), (2, 1), (3, 0), (4, 2), (9, 1)]
    rows = _drain(spark, stall_stream(_files(spark, tmp_path, "ns", batches), "user"), tmp_path, "ns")
    assert rows == []  # nothing is known of the time before an update without one


def test_alarms_depend_on_event_time_and_watermark_only(spark, tmp_path):
    events = [("u", 1, 0, False), ("u", 2, 200, False), ("u", 3, 900, False), ("u", 4, 900, False), ("v", 5, 100, False),
              ("u", 6, 1300, False), ("v", 7, 100_000, False)]
    orders = [[[e] for e in events], [events], [[events[1], events[0]], [events[4], events[2], events[3]], [events[5]], [events[6]]]]
    seen = []
    for k, batches in enumerate(orders):
        s = stall_stream(_files(spark, tmp_path, f"al{k}", batches), "user", alarm=True, watermark="1000 seconds")
        seen.append([(r.key, r.event_id, r.kind) for r in _drain(spark, s, tmp_path, f"al{k}") if r.kind == "silent"])
    # 200 s until 900 s, the later of the two at 900 s until 1300 s, 1300 s and v's 100 s until the watermark at 99,000 s
    assert seen[0] == seen[1] == seen[2] == [("u", 2, "silent"), ("u", 4, "silent"), ("v", 5, "silent"), ("u", 6, "silent")]
