"""Queries: keyed stateful streams over the events log.

The events are written in one job, range partitioned by time (events without a time first), in files of about ``FILE_BYTES``
of the table, and the files get ascending times, so that the stream takes them in order, as a live feed would deliver them.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.plans.q_history import _BREAKER_SQL, _SUPPRESS_SQL
from parley.plans.registry import register
from parley.plans.tables import EVENTS_SQL, table
from parley.session import shared_dir
from parley.sources.manifest import Files
from parley.streaming.stateful import breaker_stream, stall_stream

FILE_BYTES, MIN_FILES = 32 << 20, 2
DELAY_S = 3600  # within which events may come in any order


def _stream(spark, sf, order: Column | None = None):
    """The events as a stream, in order of ``order`` (of their time): one file a micro-batch."""
    path, files = shared_dir(spark, "event_files"), Files(spark)
    e = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type",
                                          (F.col("event_type") == "error").alias("failed"))
    n = max(MIN_FILES, files.size(f"{sf.rstrip('/')}/events.parquet") // FILE_BYTES)
    e.repartitionByRange(n, F.col("ts") if order is None else order, "event_id").write.parquet(path)
    day = int(dt.datetime(2025, 1, 1).timestamp() * 1000)
    for k, name in enumerate(sorted(x for x in files.names(path) if x.startswith("part-"))):
        files.set_time(f"{path}/{name}", day + 1000 * k)
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _drain(spark, df, name):
    out, ckpt = shared_dir(spark, f"{name}_out"), shared_dir(spark, f"{name}_ckpt")
    q = (df.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return spark.read.parquet(out)


@register("breaker_stream", _BREAKER_SQL + """
select user_id, event_id, failures, cast(is_open as integer) is_open,
       cast(coalesce(not prev_open, true) or ts > prev_ts + interval 60 seconds as integer) can_execute from o""")
def q_breaker_stream(spark, sf):
    """Live breaker per user in keyed state; every logged outcome counts (equals W5 + W6)."""
    out = _drain(spark, breaker_stream(_stream(spark, sf), "user_id"), "breaker")
    return out.select(F.col("key").cast("bigint").alias("user_id"), "event_id", "failures", "is_open", "can_execute")


@register("stall_stream", f"""
with l as (select channel_id, id, "timestamp",
                  lag("timestamp") over (partition by channel_id order by "timestamp", id) prev_ts from {EVENTS_SQL})
select channel_id, id, "timestamp", prev_ts, (epoch_us("timestamp") - epoch_us(prev_ts)) / 1e6 gap_seconds
from l where prev_ts is not null and "timestamp" > prev_ts + interval 300 seconds""")
def q_stall_stream(spark, sf):
    """Per-channel gaps over 300 s found by keyed state as the updates stream in (equals W4)."""
    out = _drain(spark, stall_stream(_stream(spark, sf), "event_type"), "stall")
    return out.filter(F.col("kind") == "gap").select(
        F.col("key").alias("channel_id"), F.col("event_id").alias("id"), F.col("ts").alias("timestamp"), "prev_ts",
        "gap_seconds")


@register("breaker_stream_suppress", _SUPPRESS_SQL)
def q_breaker_stream_suppress(spark, sf):
    """R4 live: an attempt that the breaker does not allow is not made and leaves the state as it is."""
    out = _drain(spark, breaker_stream(_stream(spark, sf), "user_id", suppress=True), "breaker_live")
    return out.select(F.col("key").cast("bigint").alias("user_id"), "event_id", "failures", "is_open", "can_execute",
                      "executed")


_PASSED = f"(select (epoch_ms(max(ts)) - {DELAY_S * 1000}) ms from events)"


@register("breaker_stream_reordered", _BREAKER_SQL + f"""
select user_id, event_id, failures, cast(is_open as integer) is_open,
       cast(coalesce(not prev_open, true) or ts > prev_ts + interval 60 seconds as integer) can_execute, 0 late
from o, {_PASSED} p where epoch_ms(ts) < p.ms""")
def q_breaker_stream_reordered(spark, sf):
    """R4 with events that come up to an hour out of order: the breaker sees them in order of time once the watermark has
    passed them, so the rows are those of ordered input (but for the last hour, which still waits)."""
    jitter = F.pmod(F.xxhash64("event_id"), F.lit(DELAY_S * 1_000_000))
    came = F.unix_micros(F.col("ts").cast("timestamp")) + jitter
    out = _drain(spark, breaker_stream(_stream(spark, sf, came), "user_id", reorder=f"{DELAY_S} seconds"), "breaker_reordered")
    return out.select(F.col("key").cast("bigint").alias("user_id"), "event_id", "failures", "is_open", "can_execute", "late")


@register("stall_alarm_stream", f"""
with l as (select channel_id, id, "timestamp", lead("timestamp") over (partition by channel_id order by "timestamp", id) next_ts
           from {EVENTS_SQL})
select channel_id, id, "timestamp" from l, {_PASSED} p
where epoch_ms("timestamp") + 300000 < p.ms and (next_ts is null or next_ts > "timestamp" + interval 300 seconds)""")
def q_stall_alarm_stream(spark, sf):
    """R5 with alarms: a ``silent`` row for every update that no other follows within 300 s, once the watermark (the last event
    less an hour) has passed that time. Events come up to an hour out of order."""
    jitter = F.pmod(F.xxhash64("event_id"), F.lit(DELAY_S * 1_000_000))
    events = _stream(spark, sf, F.unix_micros(F.col("ts").cast("timestamp")) + jitter)
    out = _drain(spark, stall_stream(events, "event_type", alarm=True, watermark=f"{DELAY_S} seconds"), "alarm")
    return out.filter(F.col("kind") == "silent").select(F.col("key").alias("channel_id"), F.col("event_id").alias("id"),
                                                        F.col("ts").alias("timestamp"))
