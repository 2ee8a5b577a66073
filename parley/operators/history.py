"""Message history: date range, keyset pages, page numbering, stop rule, resume, totals.

Model: a message table with a channel key, a numeric id (newer = larger) and a timestamp.
Pages are numbered from 1 in fetch order (newest first), ``size`` rows each.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.operators.ordered import ordered_scan

PAGE_SIZE = 100
_INTEGRAL = (T.LongType, T.IntegerType, T.ShortType, T.ByteType)


def _numeric_id(df: DataFrame, id_col: str) -> Column:
    """Ids compare numerically: integral columns as they are, text ids (64-bit snowflakes) as decimal."""
    if isinstance(df.schema[id_col].dataType, _INTEGRAL):
        return F.col(id_col)
    return F.col(id_col).cast("decimal(20,0)")


def _numeric_literal(df: DataFrame, id_col: str, value) -> Column:
    if isinstance(df.schema[id_col].dataType, _INTEGRAL):
        return F.lit(int(value))
    return F.lit(str(value)).cast("decimal(20,0)")


def _bound(value, dtype: T.DataType) -> Column:
    """A date bound as a literal of the column's own type. Aware values go to UTC; naive = UTC."""
    if isinstance(value, str):
        value = dt.datetime.fromisoformat(value.replace("Z", "+00:00"))
    if isinstance(value, dt.date) and not isinstance(value, dt.datetime):
        value = dt.datetime(value.year, value.month, value.day)
    if value.tzinfo is not None:
        value = value.astimezone(dt.timezone.utc).replace(tzinfo=None)
    target = "timestamp_ntz" if isinstance(dtype, T.TimestampNTZType) else "timestamp"
    return F.lit(value.isoformat(sep=" ")).cast(target)


def filter_date_range(df: DataFrame, start=None, end=None, ts_col: str = "timestamp") -> DataFrame:
    """both ends inclusive, each optional. No bound: every row (null timestamps too).

    A plain comparison on the column, so Catalyst pushes it into the parquet scan.
    """
    if start is None and end is None:
        return df
    dtype = df.schema[ts_col].dataType
    cond = F.col(ts_col).isNotNull()
    if start is not None:
        cond = cond & (F.col(ts_col) >= _bound(start, dtype))
    if end is not None:
        cond = cond & (F.col(ts_col) <= _bound(end, dtype))
    return df.filter(cond)


def history_page(df: DataFrame, channel=None, before=None, limit: int = PAGE_SIZE, *,
                 channel_col: str = "channel_id", id_col: str = "id") -> DataFrame:
    """The ``limit`` newest messages with ``id < before`` (numeric); no cursor = newest.

    Planned as TakeOrderedAndProject: each task keeps ``limit`` rows, the driver merges them.
    """
    out = df
    if channel is not None:
        out = out.filter(F.col(channel_col) == F.lit(channel))
    if before is not None:
        out = out.filter(_numeric_id(df, id_col) < _numeric_literal(df, id_col, before))
    return out.orderBy(_numeric_id(df, id_col).desc()).limit(limit)


def history_pages(df: DataFrame, size: int = PAGE_SIZE, *, channel_col: str = "channel_id",
                  id_col: str = "id", page_col: str = "page", rn_col: str | None = None) -> DataFrame:
    """Page number of every message, ``1 + floor((rn - 1) / size)`` over id descending.

    The row number comes from :func:`ordered_scan`, so a channel holding most rows is still spread
    over many tasks.
    """
    ranked = ordered_scan(df, [channel_col], [_numeric_id(df, id_col)], descending=True, row_number="_rn")
    out = ranked.withColumn(page_col, (F.floor((F.col("_rn") - 1) / F.lit(size)) + 1).cast("bigint"))
    return out.withColumnRenamed("_rn", rn_col) if rn_col else out.drop("_rn")


def history_pages_reference(df: DataFrame, start=None, end=None, size: int = PAGE_SIZE, *,
                            channel_col: str = "channel_id", id_col: str = "id",
                            ts_col: str = "timestamp", page_col: str = "page") -> DataFrame:
    """reference walk. Pages are cut before the date filter; the first page with no survivor ends
    the walk for its channel, and no later page is returned. Messages without a channel are one channel.
    """
    paged = history_pages(df, size, channel_col=channel_col, id_col=id_col, page_col=page_col)
    keep = F.lit(True)
    if start is not None or end is not None:
        dtype = df.schema[ts_col].dataType
        keep = F.col(ts_col).isNotNull()
        if start is not None:
            keep = keep & (F.col(ts_col) >= _bound(start, dtype))
        if end is not None:
            keep = keep & (F.col(ts_col) <= _bound(end, dtype))
    paged = paged.withColumn("_keep", keep)
    kept = paged.groupBy(channel_col, page_col).agg(F.sum(F.col("_keep").cast("long")).alias("_kept"))
    stops = kept.filter(F.col("_kept") == 0).groupBy(F.col(channel_col).alias("_ch")).agg(F.min(page_col).alias("_stop"))
    out = paged.join(stops, F.col(channel_col).eqNullSafe(F.col("_ch")), "left")
    out = out.filter(F.col("_keep") & (F.col("_stop").isNull() | (F.col(page_col) < F.col("_stop"))))
    return out.drop("_keep", "_stop", "_ch")


def resume_filter(df: DataFrame, state: DataFrame, *, channel_col: str = "channel_id", id_col: str = "id",
                  cursor_col: str = "oldest_message_id") -> DataFrame:
    """Per channel, only messages older than the saved cursor; channels without state start fresh. Messages without a
    channel are one channel, with a state of its own."""
    st = state.select(F.col(channel_col).alias("_ch"), F.col(cursor_col).cast("decimal(20,0)").alias("_cur"))
    out = df.join(st, F.col(channel_col).eqNullSafe(F.col("_ch")), "left")
    out = out.filter(F.col("_cur").isNull() | (F.col(id_col).cast("decimal(20,0)") < F.col("_cur")))  # cursor is text
    return out.drop("_ch", "_cur")


def resume_cursor(df: DataFrame, *, channel_col: str = "channel_id", id_col: str = "id") -> DataFrame:
    """A5: oldest surviving id per channel, the cursor to resume from. Partial aggregation only."""
    return df.groupBy(channel_col).agg(
        F.min(F.col(id_col).cast("decimal(20,0)")).cast("string").alias("oldest_message_id"))


def ingest_totals(paged: DataFrame, *, channel_col: str = "channel_id", page_col: str = "page") -> DataFrame:
    """A2: messages and batches per channel (pages are contiguous from 1, so batches = max page)."""
    return paged.groupBy(channel_col).agg(F.count(F.lit(1)).alias("total_messages"),
                                          F.max(page_col).cast("bigint").alias("batch_count"))


def running_totals(paged: DataFrame, *, channel_col: str = "channel_id", page_col: str = "page") -> DataFrame:
    """Messages per page and the running total after each page, per channel."""
    per_page = paged.groupBy(channel_col, page_col).agg(F.count(F.lit(1)).alias("messages"))
    out = ordered_scan(per_page, [channel_col], [F.col(page_col)],
                       running_sums={"total_messages": F.col("messages")})
    return out.select(channel_col, page_col, "messages", F.col("total_messages").cast("bigint"))


def chunk_rows(df: DataFrame, n: int, *, key_col: str, order: list) -> DataFrame:
    """Sub-batch number (from 1) of ``n`` rows within each key, in ``order``."""
    ranked = ordered_scan(df, [key_col], order, row_number="_rn")
    return ranked.withColumn("chunk", (F.floor((F.col("_rn") - 1) / F.lit(n)) + 1).cast("bigint")).drop("_rn")
