"""Running counters and state of several streaming queries over one output."""

from parley.sources.registry import load_ingest_state
from parley.streaming.ingest import (compact_progress, file_table_stream, ingest_state_stream, latest_progress,
                                     progress_stream)

SCHEMA = "id string, channel_id string, opens boolean"


def feed(spark, path, ranges):
    for a, b in ranges:
        rows = [(str(i), ["a", "b", None][i % 3], i == a) for i in range(a, b)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return file_table_stream(spark, path, SCHEMA)


def counters(df):
    return {r.channel_id: r.messages for r in df.collect()}


def test_a_second_query_keeps_counters_of_its_own(spark, tmp_path):
    out = str(tmp_path / "progress")
    first = feed(spark, str(tmp_path / "in1"), [(0, 9), (9, 18), (18, 30)])
    progress_stream(first, out, str(tmp_path / "ckpt1"))
    assert counters(latest_progress(spark, out)) == {"a": 10, "b": 10, None: 10}
    progress_stream(feed(spark, str(tmp_path / "in2"), [(0, 60)]), out, str(tmp_path / "ckpt2"))
    assert counters(latest_progress(spark, out)) == {"a": 30, "b": 30, None: 30}
    # the first query goes on where it was
    progress_stream(feed(spark, str(tmp_path / "in1"), [(30, 33)]), out, str(tmp_path / "ckpt1"))
    assert counters(latest_progress(spark, out)) == {"a": 31, "b": 31, None: 31}

    compact_progress(spark, out, str(tmp_path / "compact"))
    assert counters(latest_progress(spark, str(tmp_path / "compact"))) == {"a": 31, "b": 31, None: 31}
    progress_stream(feed(spark, str(tmp_path / "in1"), [(33, 36)]), str(tmp_path / "compact"), str(tmp_path / "ckpt1"))
    assert counters(latest_progress(spark, str(tmp_path / "compact"))) == {"a": 32, "b": 32, None: 32}


def test_state_of_two_queries_is_the_latest_record(spark, tmp_path):
    state = str(tmp_path / "state")
    ingest_state_stream(feed(spark, str(tmp_path / "in1"), [(0, 9), (9, 18)]), state, str(tmp_path / "ckpt1"))
    got = {r.channel_id: (r.batch_count, r.total_messages, r.oldest_message_id) for r in load_ingest_state(spark, state).collect()}
    assert got == {"a": (2, 6, "0"), "b": (0, 6, "1"), None: (0, 6, "2")}
    ingest_state_stream(feed(spark, str(tmp_path / "in2"), [(300, 303)]), state, str(tmp_path / "ckpt2"))
    got = {r.channel_id: r.total_messages for r in load_ingest_state(spark, state).collect()}
    assert got == {"a": 1, "b": 1, None: 1}  # the later query's record; the former one's folder is still there
    assert len(list((tmp_path / "state").glob("query=*"))) == 2


def test_redelivered_messages_are_one_row(spark, tmp_path):
    from parley.streaming.ingest import dedup_stream
    schema = "id string, channel_id string, content string, at timestamp"
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    for rows in ([("1", "a", "x", 0), ("1", "a", "x", 0), ("2", "a", "y", 5), (None, "a", "n", 6)],
                 [("1", "a", "x", 0), ("1", "b", "other channel", 8), (None, "a", "n", 6), (None, "a", "m", 9)],
                 [("2", "a", "again", 7)]):
        spark.createDataFrame([(i, c, t, s) for i, c, t, s in rows], "id string, channel_id string, content string, s long") \
            .selectExpr("id", "channel_id", "content", "timestamp_seconds(s) at").coalesce(1).write.mode("append").parquet(src)
    once = dedup_stream(file_table_stream(spark, src, schema))
    q = (once.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ckpt"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = sorted(((r.id or "", r.channel_id, r.content) for r in spark.read.parquet(out).collect()))
    assert got == [("", "a", "m"), ("", "a", "n"), ("1", "a", "x"), ("1", "b", "other channel"), ("2", "a", "y")]
    assert spark.read.parquet(out).columns == ["id", "channel_id", "content", "at"]


def test_the_state_of_deduplication_is_bounded_by_the_watermark(spark, tmp_path):
    from parley.streaming.ingest import dedup_stream
    schema, src = "id string, channel_id string, at timestamp", str(tmp_path / "src")
    for k in range(5):  # a thousand seconds and 50 ids a file
        spark.range(50).selectExpr(f"concat('{k}-', id) id", "'a' channel_id", f"timestamp_seconds(100000 + {k} * 1000 + id) at") \
            .coalesce(1).write.mode("append").parquet(src)
    once = dedup_stream(file_table_stream(spark, src, schema), delay="100 seconds", time_col="at")
    q = (once.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ckpt"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 250 and max(held) <= 100 and held[-1] <= 50
