"""Counters that ride along with a write."""

import time

from pyspark.sql import functions as F

from parley.operators import history as H
from parley.streaming.ingest import file_table_stream
from parley.streaming.metrics import LiveProgress, channel_counters, write_with_totals


def messages(spark):
    return spark.range(250).selectExpr("id", "element_at(array('a', 'b', null, 'x'), cast(id % 4 as int) + 1) channel_id")


def test_observed_totals_are_those_of_the_operator(spark, tmp_path):
    paged = H.history_pages(messages(spark), size=20)
    got = write_with_totals(paged, str(tmp_path / "out"), ["a", "b", None, "x", "never"])
    key = lambda df: sorted(map(tuple, df.select("channel_id", "total_messages", "batch_count").collect()), key=str)
    assert key(got) == key(H.ingest_totals(paged)) and spark.read.parquet(str(tmp_path / "out")).count() == 250


def test_one_scan(spark, tmp_path):
    messages(spark).write.parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in")).observe("m", *channel_counters(["a"], page_col=None))
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert "CollectMetrics" in df._jdf.queryExecution().executedPlan().toString()


def test_a_stream_is_followed_while_it_runs(spark, tmp_path):
    src, schema = str(tmp_path / "src"), "id long, channel_id string"
    messages(spark).repartition(5).write.parquet(src)
    live = LiveProgress("load", ["a", None], expected=500)
    spark.streams.addListener(live)
    try:
        s = file_table_stream(spark, src, schema).observe("load", *channel_counters(["a", None], page_col=None))
        q = (s.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
             .trigger(availableNow=True).start())
        q.awaitTermination()
        for _ in range(100):
            if live.percent_complete() == 50.0:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(live)
    want = {r.channel_id: r["count"] for r in messages(spark).groupBy("channel_id").count().collect()}
    assert live.messages() == {c: want[c] for c in ("a", None)} and live.percent_complete() == 50.0
    assert LiveProgress("x", []).percent_complete() is None and len(live._batches) >= 5
    assert sum(b["other"] for b in live._batches.values()) == spark.read.parquet(src).where(F.col("channel_id").isin("b", "x")).count()
