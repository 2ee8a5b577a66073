"""Composed jobs end to end: load a collection, search it by text; ingest history and resume."""

from pyspark.sql import functions as F

from parley.plans.jobs import build_collection, ingest_history, search_text
from parley.plans.tables import documents_as_messages, events_as_messages
from parley.sources.collection import open_collection
from parley.sources.registry import load_ingest_state
from conftest import SF_SMALL


def test_load_then_search_by_text(spark, tmp_path):
    root = str(tmp_path / "coll")
    msgs = documents_as_messages(spark, SF_SMALL).withColumn("id", F.col("id").cast("string")) \
        .withColumn("timestamp", F.lit(None).cast("timestamp"))
    optout = spark.createDataFrame([("src3",)], "user_id string")
    n = build_collection(msgs, root, "docs", load_id=1, optout=optout)
    kept = msgs.filter("author <> 'src3'").count()
    assert n == kept
    assert build_collection(msgs, root, "docs", load_id=2, optout=optout) == kept  # nothing new the second time
    coll = open_collection(spark, root, "docs")
    assert coll.filter(F.col("document").rlike("@[a-z0-9.-]+\\.[a-z]{2,}")).count() == 0  # redacted before embedding
    probe = coll.filter("metadata.author = 'src5'").orderBy("id").limit(3)
    texts = probe.select(F.col("id").cast("long").alias("qid"), F.col("document").alias("text"))
    res = search_text(coll, texts, k=1).collect()
    own = {int(r.id): r.document for r in probe.collect()}
    assert sorted(r.qid for r in res) == sorted(own)
    # a text finds itself (or an exact copy with a smaller id) at distance 0
    assert all(r.distance == 0.0 and own[int(r.qid)] == r.document for r in res)
    assert all(r.metadata is not None and r.document is not None for r in res)


def test_ingest_history_then_state(spark, tmp_path):
    ev = events_as_messages(spark, SF_SMALL)
    state = ingest_history(ev, str(tmp_path / "pages"), str(tmp_path / "state"), start="2024-01-05", end="2024-01-25")
    st = {r.channel_id: r for r in load_ingest_state(spark, str(tmp_path / "state")).collect()}
    inside = ev.filter("timestamp >= '2024-01-05' and timestamp <= '2024-01-25'")
    want = {r.channel_id: r["count"] for r in inside.groupBy("channel_id").count().collect()}
    assert {c: r.total_messages for c, r in st.items()} == want
    assert all(r.batch_count == -(-r.total_messages // 100) for r in st.values())
    pages = spark.read.parquet(str(tmp_path / "pages"))
    assert pages.count() == sum(want.values()) and state.count() == len(want)


def test_ingest_in_two_runs_adds_up(spark, tmp_path):
    ev = events_as_messages(spark, SF_SMALL)
    whole, parts = str(tmp_path / "whole"), str(tmp_path / "parts")
    ingest_history(ev, whole, str(tmp_path / "s1"))
    for pages in (1, 2, None):
        ingest_history(ev, parts, str(tmp_path / "s2"), max_pages=pages)
    ingest_history(ev, parts, str(tmp_path / "lost state"))  # nothing is stored again
    pages = [sorted((r.channel_id, r.id, r.page) for r in spark.read.parquet(p).collect()) for p in (whole, parts)]
    assert pages[0] == pages[1]
    states = [sorted((r.channel_id, r.oldest_message_id, r.batch_count, r.total_messages)
                     for r in load_ingest_state(spark, str(tmp_path / s)).collect()) for s in ("s1", "s2", "lost state")]
    assert states[0] == states[1] == states[2]


def test_opt_out_by_user_id_in_the_load(spark, tmp_path):
    rows = spark.createDataFrame([("1", "hello", "ann", "10"), ("2", "there", "bob", "11")],
                                 "id string, content string, author string, author_id string").withColumn("channel_id", F.lit("c"))
    out = spark.createDataFrame([("10",)], "user_id string")
    assert build_collection(rows, str(tmp_path), "c", 1, optout=out) == 1
    assert [r.id for r in open_collection(spark, str(tmp_path), "c").collect()] == ["2"]
