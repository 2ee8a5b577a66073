"""Queries: history, pages, resume, totals, progress, stalls and breaker on ``events``
(F1, F4, F5, F6, S5, S6, W1-W6, A2-A5, T4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import history as H
from parley.operators import progress as P
from parley.plans.registry import register
from parley.plans.tables import CONV_SQL, EVENTS_SQL, conversations_as_messages, events_as_messages

# Parameters (what a user passes to a fetch run)
START = "2024-01-10T00:00:00Z"
END = "2024-01-20T12:00:00Z"
REF_END = "2024-01-29T12:00:00Z"
PAGE_CHANNEL = "click"
PAGE_BEFORE = 5000
NO_STATE_CHANNEL = "signup"
LOAD_BATCH_SIZE = 5
CHUNK = 100

_S = "timestamp '2024-01-10 00:00:00'"
_E = "timestamp '2024-01-20 12:00:00'"
_RE = "timestamp '2024-01-29 12:00:00'"
_IN_RANGE = f'"timestamp" >= {_S} and "timestamp" <= {_E}'
_PAGES_SQL = f"""(select *, cast(floor((row_number() over (partition by channel_id order by id desc) - 1) / 100) + 1 as bigint) page
  from {EVENTS_SQL})"""
_FILTERED_PAGES_SQL = f"""(select *, cast(floor((row_number() over (partition by channel_id order by id desc) - 1) / 100) + 1 as bigint) page
  from {EVENTS_SQL} where {_IN_RANGE})"""


def _ev(spark, sf):
    return events_as_messages(spark, sf)


@register("filter_date_range", f'select id, channel_id, "timestamp" from {EVENTS_SQL} where {_IN_RANGE}')
def q_filter_date_range(spark, sf):
    """inclusive on both ends; the bounds reach the parquet scan as pushed filters."""
    return H.filter_date_range(_ev(spark, sf), START, END).select("id", "channel_id", "timestamp")


@register("history_page", f"""
select id, channel_id, "timestamp" from {EVENTS_SQL}
where channel_id = '{PAGE_CHANNEL}' and id < {PAGE_BEFORE} order by id desc limit 100""")
def q_history_page(spark, sf):
    """One keyset page (the limit is the feature: a page is 100 rows)."""
    return H.history_page(_ev(spark, sf), PAGE_CHANNEL, PAGE_BEFORE).select("id", "channel_id", "timestamp")


@register("history_pages", f"select channel_id, id, page from {_PAGES_SQL}")
def q_history_pages(spark, sf):
    """Every message with its page number."""
    return H.history_pages(_ev(spark, sf)).select("channel_id", "id", "page")


PAGE_BLOCK = 20_000  # ids a folder of the stored history


@register("paged_source", f"""
select channel_id, id, "timestamp", page, 1 attempts from {_PAGES_SQL}""")
def q_paged_source(spark, sf):
    """The events stored as a history that can only be had page by page, read through the data source over a page
    function, one channel a task."""
    from parley.session import shared_dir
    from parley.sources.paged import Pages, read_paged, stored_pages
    folder = shared_dir(spark, "paged_history")
    ev = _ev(spark, sf).select("id", "timestamp", "channel_id").withColumn("block", F.expr(f"id div {PAGE_BLOCK}"))
    ev.repartition("channel_id", "block").write.partitionBy("channel_id", "block").parquet(folder)
    channels = tuple(r[0] for r in ev.select("channel_id").distinct().collect())  # what a user asks for
    uri = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    return read_paged(spark, "stored_history", Pages(stored_pages(uri, PAGE_BLOCK), channels), "id bigint, timestamp timestamp_ntz")


@register("history_pages_reference", f"""
with p as (select *, "timestamp" >= {_S} and "timestamp" <= {_RE} keep from {_PAGES_SQL}),
k as (select channel_id, page, sum(case when keep then 1 else 0 end) kept from p group by all),
st as (select channel_id, min(page) stop from k where kept = 0 group by all)
select p.channel_id, p.page, count(*) n from p left join st on p.channel_id = st.channel_id
where p.keep and (st.stop is null or p.page < st.stop) group by all""")
def q_history_pages_reference(spark, sf):
    """the reference walk, ending at the first page the date filter empties."""
    p = H.history_pages_reference(_ev(spark, sf), START, REF_END)
    return p.groupBy("channel_id", "page").agg(F.count(F.lit(1)).alias("n"))


_STATE_SQL = f"""(select channel_id, min(id) oldest_message_id from {_PAGES_SQL}
  where page = 1 and channel_id <> '{NO_STATE_CHANNEL}' group by all)"""


@register("resume_filter", f"""
select e.channel_id, e.id from {EVENTS_SQL} e left join {_STATE_SQL} s on e.channel_id = s.channel_id
where s.oldest_message_id is null or e.id < s.oldest_message_id""")
def q_resume_filter(spark, sf):
    """state = the cursor after one page per channel (one channel has no state)."""
    ev = _ev(spark, sf)
    first = H.history_pages(ev).filter((F.col("page") == 1) & (F.col("channel_id") != NO_STATE_CHANNEL))
    state = H.resume_cursor(first)
    return H.resume_filter(ev, state).select("channel_id", "id")


@register("resume_cursor", f"""
select channel_id, cast(min(id) as varchar) oldest_message_id from {EVENTS_SQL} where {_IN_RANGE} group by all""")
def q_resume_cursor(spark, sf):
    """A5."""
    return H.resume_cursor(H.filter_date_range(_ev(spark, sf), START, END))


@register("ingest_totals", f"""
select channel_id, count(*) total_messages, max(page) batch_count from {_FILTERED_PAGES_SQL} group by all""")
def q_ingest_totals(spark, sf):
    """A2: filter, then page (Q4 decision)."""
    return H.ingest_totals(H.history_pages(H.filter_date_range(_ev(spark, sf), START, END)))


@register("observed_totals", f"""
select channel_id, count(*) total_messages, max(page) batch_count from {_FILTERED_PAGES_SQL} group by all""")
def q_observed_totals(spark, sf):
    """A2 without a second pass: the counters ride along with the write of the pages."""
    from parley.session import shared_dir
    from parley.streaming.metrics import write_with_totals
    ev = H.filter_date_range(_ev(spark, sf), START, END)
    channels = sorted(r[0] for r in ev.select("channel_id").distinct().collect())  # what a user asks for
    return write_with_totals(H.history_pages(ev), shared_dir(spark, "observed"), channels)


@register("running_totals", f"""
with c as (select channel_id, page, count(*) messages from {_FILTERED_PAGES_SQL} group by all)
select channel_id, page, messages,
       cast(sum(messages) over (partition by channel_id order by page rows between unbounded preceding and current row) as bigint) total_messages
from c""")
def q_running_totals(spark, sf):
    """W3."""
    return H.running_totals(H.history_pages(H.filter_date_range(_ev(spark, sf), START, END)))


@register("progress_pct", f"""
select channel_id, processed, total,
       round(case when total = 0 then 0.0 else least(100.0, processed::double / total::double * 100.0) end, 6) percent_complete
from (select channel_id, count(*) total, count(*) filter (where {_IN_RANGE}) processed from {EVENTS_SQL} group by all)""")
def q_progress_pct(spark, sf):
    """A3 per channel: messages inside the date window over all messages."""
    ev = _ev(spark, sf)
    inside = F.col("timestamp").between(H._bound(START, ev.schema["timestamp"].dataType),
                                        H._bound(END, ev.schema["timestamp"].dataType))
    agg = ev.groupBy("channel_id").agg(F.count(F.lit(1)).alias("total"),
                                       F.count(F.when(inside, 1)).alias("processed"))
    return agg.select("channel_id", "processed", "total",
                      F.round(P.progress_pct("processed", "total"), 6).alias("percent_complete"))


@register("load_progress", f"""
select author role, count(*) processed_items, count(distinct conv_id) * {LOAD_BATCH_SIZE} total_items,
       round(least(100.0, count(*)::double / (count(distinct conv_id) * {LOAD_BATCH_SIZE})::double * 100.0), 6) percent_complete
from {CONV_SQL} group by all""")
def q_load_progress(spark, sf):
    """A4: each conversation is one batch file; estimated total = files x batch size."""
    c = conversations_as_messages(spark, sf).withColumnRenamed("author", "role")
    out = P.load_progress(c, LOAD_BATCH_SIZE, file_col="conv_id", group_col="role")
    return out.withColumn("percent_complete", F.round("percent_complete", 6))


@register("stalls", f"""
with l as (select channel_id, id, "timestamp",
                  lag("timestamp") over (partition by channel_id order by "timestamp", id) prev_ts from {EVENTS_SQL})
select channel_id, id, "timestamp", prev_ts, (epoch_us("timestamp") - epoch_us(prev_ts)) / 1e6 gap_seconds
from l where prev_ts is not null and "timestamp" > prev_ts + interval 300 seconds""")
def q_stalls(spark, sf):
    """W4 per channel, 300 s."""
    s = P.stalls(_ev(spark, sf), key_col="channel_id", ts_col="timestamp")
    return s.select("channel_id", "id", "timestamp", "prev_ts", "gap_seconds")


_BREAKER_SQL = """
with f as (select user_id, event_id, ts, case when event_type = 'error' then 1 else 0 end fail from events),
g as (select *, sum(1 - fail) over (partition by user_id order by ts, event_id
        rows between unbounded preceding and current row) grp from f),
h as (select user_id, event_id, ts, cast(sum(fail) over (partition by user_id, grp order by ts, event_id
        rows between unbounded preceding and current row) as bigint) failures from g),
o as (select *, failures >= 3 is_open,
        lag(failures >= 3) over (partition by user_id order by ts, event_id) prev_open,
        lag(ts) over (partition by user_id order by ts, event_id) prev_ts from h)"""


def _breaker(spark, sf):
    from parley.plans.tables import table
    e = table(spark, sf, "events")
    return P.breaker_replay(e, key_col="user_id", ts_col="ts", id_col="event_id",
                            failed=F.col("event_type") == "error")


@register("breaker_replay", _BREAKER_SQL + """
select user_id, event_id, failures, cast(is_open as integer) is_open from o""")
def q_breaker_replay(spark, sf):
    """Per user, failures since the last success and the open flag (3 failures)."""
    return _breaker(spark, sf).select("user_id", "event_id", "failures", "is_open")


@register("breaker_gate", _BREAKER_SQL + """
select user_id, event_id,
       cast(coalesce(not prev_open, true) or ts > prev_ts + interval 60 seconds as integer) can_execute from o""")
def q_breaker_gate(spark, sf):
    """Was a call allowed before each event (half-open after 60 s)."""
    return _breaker(spark, sf).select("user_id", "event_id", "can_execute")


_SUPPRESS_SQL = """
with recursive e as (select user_id, event_id, ts, event_type = 'error' failed,
                            row_number() over (partition by user_id order by ts, event_id) rn from events),
s as (select user_id, rn, event_id, cast(failed as bigint) failures, case when failed then ts end last_fail, 1 executed,
             1 can_execute from e where rn = 1
      union all
      select e.user_id, e.rn, e.event_id, case when not a.ok then s.failures when e.failed then s.failures + 1 else 0 end,
             case when not a.ok then s.last_fail when e.failed then e.ts end, cast(a.ok as integer), cast(a.ok as integer)
      from s join e on e.user_id = s.user_id and e.rn = s.rn + 1,
      lateral (select s.failures < 3 or e.ts > s.last_fail + interval 60 seconds ok) a)
select user_id, event_id, failures, cast(failures >= 3 as integer) is_open, can_execute, executed from s"""


@register("breaker_suppress", _SUPPRESS_SQL)
def q_breaker_suppress(spark, sf):
    """W5 + W6 with the live rule: an attempt that the open breaker does not allow is not made and changes nothing."""
    from parley.operators.breaker import breaker_suppress
    from parley.plans.tables import table
    e = table(spark, sf, "events")
    out = breaker_suppress(e, key_col="user_id", ts_col="ts", id_col="event_id", failed=F.col("event_type") == "error")
    return out.select("user_id", "event_id", "failures", "is_open", "can_execute", "executed")


@register("chunk_rows", f"""
select channel_id, id, cast(floor((row_number() over (partition by channel_id order by id) - 1) / {CHUNK}) + 1 as bigint) chunk
from (select doc_id id, lang channel_id from documents)""")
def q_chunk_rows(spark, sf):
    """Documents of each language cut into sub-batches of 100 by id."""
    from parley.plans.tables import documents_as_messages
    d = documents_as_messages(spark, sf).select("id", "channel_id")
    return H.chunk_rows(d, CHUNK, key_col="channel_id", order=[F.col("id")])
