"""Date range, keyset pages, page walk with the stop rule, resume, totals."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from parley.operators import history as H


@pytest.fixture()
def dated(spark):
    rows = [("1", "x", "2025-01-01T12:00:00Z"), ("2", "y", "2024-12-17T12:00:00Z"), ("3", "z", "2024-12-01T12:00:00Z"),
            ("4", "w", None)]
    df = spark.createDataFrame(rows, "id string, content string, ts string")
    return df.withColumn("timestamp", F.col("ts").try_cast("timestamp"))


def _ids(df):
    return sorted(r.id for r in df.collect())


@pytest.mark.parametrize("start,end,expected", [
    ("2024-12-10T00:00:00Z", None, ["1", "2"]),
    (None, "2024-12-20T00:00:00Z", ["2", "3"]),
    ("2024-12-10T00:00:00Z", "2024-12-20T00:00:00Z", ["2"]),
    (None, None, ["1", "2", "3", "4"]),
    ("2024-12-17T12:00:00", "2024-12-17T12:00:00+00:00", ["2"]),  # inclusive; naive bound = UTC
])
def test_date_range(dated, start, end, expected):
    assert _ids(H.filter_date_range(dated, start, end)) == expected


def test_date_filter_reaches_scan(spark):
    from conftest import SF_SMALL
    from parley.plans.tables import events_as_messages
    plan = H.filter_date_range(events_as_messages(spark, SF_SMALL), "2024-01-10", "2024-01-12")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in text


def _history(spark, n=25, channel="c1"):
    base = dt.datetime(2025, 1, 2, 12, 0, 0)
    rows = [(str(1000 - 10 * i), channel, base - dt.timedelta(hours=i)) for i in range(n)]
    return spark.createDataFrame(rows, "id string, channel_id string, timestamp timestamp")


def test_history_page_cursor(spark):
    h = _history(spark)
    page = H.history_page(h, "c1", before=950, limit=5).collect()
    assert [r.id for r in page] == ["940", "930", "920", "910", "900"]
    assert [r.id for r in H.history_page(h, "c1", limit=2).collect()] == ["1000", "990"]


def test_pages_two_pages_of_five(spark):
    h = _history(spark, n=10)
    p = H.history_pages(h, size=5).collect()
    pages = {}
    for r in p:
        pages.setdefault(r.page, []).append(int(r.id))
    assert sorted(pages) == [1, 2] and len(pages[1]) == 5 and min(pages[1]) > max(pages[2])
    tot = H.ingest_totals(H.history_pages(h, size=5)).first()
    assert (tot.total_messages, tot.batch_count) == (10, 2)


def test_union_of_cursor_steps_is_whole_channel(spark):
    h = _history(spark, n=23)
    seen, cursor = [], None
    while True:
        page = [r.id for r in H.history_page(h, "c1", before=cursor, limit=5).collect()]
        if not page:
            break
        seen += page
        cursor = page[-1]
    paged = [r.id for r in H.history_pages(h, size=5).orderBy(F.col("id").cast("int").desc()).collect()]
    assert seen == paged


def test_resume_five_plus_five(spark):
    h = _history(spark, n=10)
    first = H.history_pages(h, size=5).filter("page = 1")
    state = H.resume_cursor(first)
    rest = H.resume_filter(h, state)
    assert rest.count() == 5 and first.count() + rest.count() == 10
    other = spark.createDataFrame([("c9", "1")], "channel_id string, oldest_message_id string")
    assert H.resume_filter(h, other).count() == 10  # state of another channel is ignored


def test_reference_walk_stops_at_empty_page(spark):
    h = _history(spark, n=20)
    # pages of 5, hourly, newest first: page 1 = hours 0-4, page 2 = 5-9, ...; keep only hours 12-16
    end = dt.datetime(2025, 1, 2, 0, 0, 0)
    start = end - dt.timedelta(hours=4)
    ref = H.history_pages_reference(h, start, end, size=5)
    assert ref.count() == 0  # the first page is emptied by the filter, so the walk ends there
    full = H.history_pages(H.filter_date_range(h, start, end), size=5)
    assert full.count() == 5


def test_running_totals(spark):
    h = _history(spark, n=12)
    rt = H.running_totals(H.history_pages(h, size=5)).orderBy("page").collect()
    assert [(r.page, r.messages, r.total_messages) for r in rt] == [(1, 5, 5), (2, 5, 10), (3, 2, 12)]


def test_no_channel_is_a_channel(spark):
    """Reference walk, resume and saved state treat messages without a channel like those of any other."""
    base = dt.datetime(2025, 1, 2)
    rows = [(i, ch, base - dt.timedelta(days=100 * (10 <= i < 20)) + dt.timedelta(seconds=i))
            for ch in ("a", None) for i in range(30)]
    h = spark.createDataFrame(rows, "id long, channel_id string, timestamp timestamp")
    # pages of 10 from the newest: ids 20-29, then 10-19 (emptied by the date filter), then 0-9 (never reached)
    ref = H.history_pages_reference(h, start="2025-01-01", size=10)
    got = {(r.channel_id, r.page): r.n for r in ref.groupBy("channel_id", "page").agg(F.count("*").alias("n")).collect()}
    assert got == {("a", 1): 10, (None, 1): 10}
    state = spark.createDataFrame([("a", "5"), (None, "7")], "channel_id string, oldest_message_id string")
    left = H.resume_filter(h, state).groupBy("channel_id").count().collect()
    assert {r.channel_id: r["count"] for r in left} == {"a": 5, None: 7}


def test_state_of_no_channel_is_saved_and_loaded(spark, tmp_path):
    from parley.sources.registry import compact_ingest_state, load_ingest_state, save_ingest_state, state_from_totals
    rows = [(i, ch) for ch in ("a", None) for i in range(7)]
    paged = H.history_pages(spark.createDataFrame(rows, "id long, channel_id string"), size=3)
    for hour in (1, 2):
        state = state_from_totals(H.ingest_totals(paged), H.resume_cursor(paged), dt.datetime(2025, 1, 1, hour))
        save_ingest_state(state, str(tmp_path / "state"))
    (tmp_path / "state" / "stray.json").write_text('{"oldest_message_id": "1"}')  # names no channel: no state
    want = {("a", "0", 3, 7, 2), (None, "0", 3, 7, 2)}

    def rows_of(df):
        return {(r.channel_id, r.oldest_message_id, r.batch_count, r.total_messages, r.last_updated.hour) for r in df.collect()}
    assert rows_of(load_ingest_state(spark, str(tmp_path / "state"))) == want
    assert rows_of(compact_ingest_state(spark, str(tmp_path / "state"), str(tmp_path / "compact"))) == want
    lines = [x for f in (tmp_path / "compact").glob("part-*") for x in f.read_text().splitlines()]
    assert len(lines) == 2


def test_state_is_read_once(spark, tmp_path):
    from parley.sources.registry import load_ingest_state
    (tmp_path / "a.json").write_text('{"channel_id": "c",\n "oldest_message_id": "5"}')
    (tmp_path / "b.json").write_text('{"channel_id": "d", "oldest_message_id": "6"}\n{"channel_id": "e"}\n{broken\n')
    st = load_ingest_state(spark, str(tmp_path))
    assert sorted((r.channel_id, r.oldest_message_id, r.batch_count) for r in st.collect()) == [
        ("c", "5", 0), ("d", "6", 0), ("e", None, 0)]
    plan = st._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1
