"""Progress, stall and failure analytics over an event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql import Window

from parley.operators.ordered import _S, _TIE, ordered_scan, sliced

STALL_TIMEOUT_S = 300
MAX_FAILURES = 3
RESET_TIMEOUT_S = 60


def progress_pct(processed: Column | str, total: Column | str) -> Column:
    """A3: ``min(100, processed / total * 100)`` in double; 0 when total is 0."""
    p = (F.col(processed) if isinstance(processed, str) else processed).cast("double")
    t = (F.col(total) if isinstance(total, str) else total).cast("double")
    return F.when(t == 0, F.lit(0.0)).otherwise(F.least(F.lit(100.0), p / t * F.lit(100.0)))


def load_progress(df: DataFrame, batch_size: int, *, file_col: str, group_col: str | None = None) -> DataFrame:
    """A4: estimated total = files x batch size, processed = rows, and the percentage."""
    keys = [group_col] if group_col else []
    agg = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("processed_items"),
                                F.countDistinct(file_col).alias("_files"))
    return agg.select(*keys, "processed_items", (F.col("_files") * F.lit(batch_size)).cast("bigint").alias("total_items"),
                      progress_pct("processed_items", F.col("_files") * F.lit(batch_size)).alias("percent_complete"))


def stalls(df: DataFrame, *, key_col: str, ts_col: str = "ts", id_col: str = "id",
           timeout_s: int = STALL_TIMEOUT_S) -> DataFrame:
    """Updates that came strictly more than ``timeout_s`` seconds after the previous one of their key."""
    order = [F.col(ts_col), F.col(id_col)]
    lagged = ordered_scan(df, [key_col], order, lags={"prev_ts": F.col(ts_col)})
    late = F.col(ts_col) > F.col("prev_ts") + F.expr(f"INTERVAL {int(timeout_s)} SECONDS")
    gap_s = (F.unix_micros(F.col(ts_col).cast("timestamp")) - F.unix_micros(F.col("prev_ts").cast("timestamp"))) / 1e6
    return lagged.filter(F.col("prev_ts").isNotNull() & late).withColumn("gap_seconds", gap_s)


def breaker_replay(df: DataFrame, *, key_col: str, ts_col: str = "ts", id_col: str = "id",
                   failed: Column, max_failures: int = MAX_FAILURES,
                   reset_timeout_s: int = RESET_TIMEOUT_S, slices: int | None = None) -> DataFrame:
    """W5 + W6: circuit-breaker state after each outcome, and whether the call was allowed before it.

    A failure adds one, a success resets to zero; the breaker is open once failures >= max_failures.
    Before an event, a call is allowed iff the breaker was not open, or more than ``reset_timeout_s``
    passed since the previous event (which, when open, is by construction the last failure). An event without a time lies
    before all others.

    One windowed pass per (key, slice) (slices as in :func:`ordered_scan`, so a hot key is split):
    failures since the last success are counted inside the slice; what a slice inherits is the
    failure count at the end of the slices before it, a segmented prefix over the small per-slice
    table (reset at every slice that contains a success). No join on island ids, no per-key task.
    """
    order = [F.col(ts_col), F.col(id_col)]
    parts = sliced(df.withColumn("_succ", ~F.coalesce(failed, F.lit(False))), [key_col], order, slices)
    local = Window.partitionBy(key_col, _S).orderBy(*[c.asc_nulls_first() for c in order], _TIE)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = (parts.withColumn("_lrn", F.row_number().over(local))
         .withColumn("_ls", F.max(F.when(F.col("_succ"), F.col("_lrn"))).over(upto))
         .withColumn("_lsp", F.lag("_ls").over(local))
         .withColumn("_pts", F.lag(ts_col).over(local)))

    # per slice: trailing failures, whether it holds a success, time of its last event
    st = r.groupBy(key_col, _S).agg(F.count(F.lit(1)).alias("_cnt"), F.max("_ls").alias("_last_succ"),
                                    F.max_by(F.col(ts_col), F.struct(F.col(ts_col), F.col(id_col), F.col(_TIE))).alias("_last_ts"))
    st = st.withColumn("_trail", F.col("_cnt") - F.coalesce(F.col("_last_succ"), F.lit(0))) \
        .withColumn("_has", F.col("_last_succ").isNotNull().cast("long"))
    by_key = Window.partitionBy(key_col).orderBy(_S)
    st = st.withColumn("_seg", F.sum("_has").over(by_key.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    seg = Window.partitionBy(key_col, "_seg").orderBy(_S).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    st = st.withColumn("_end_failures", F.sum("_trail").over(seg))
    offsets = st.select(F.col(key_col).alias("_ok"), F.col(_S).alias("_os"),
                        F.lag("_end_failures").over(by_key).alias("_carry"),
                        F.lag("_last_ts").over(by_key).alias("_prev_last_ts"))

    out = r.join(offsets, F.col(key_col).eqNullSafe(F.col("_ok")) & (F.col(_S) == F.col("_os")), "inner")
    return _breaker_columns(out, ts_col, max_failures, reset_timeout_s)


def _breaker_columns(out: DataFrame, ts_col: str, max_failures: int, reset_timeout_s: int) -> DataFrame:
    carry = F.coalesce(F.col("_carry"), F.lit(0))
    failures = F.when(F.col("_ls").isNotNull(), F.col("_lrn") - F.col("_ls")).otherwise(carry + F.col("_lrn"))
    prev_failures = (F.when(F.col("_lrn") == 1, F.col("_carry"))
                     .when(F.col("_lsp").isNotNull(), F.col("_lrn") - 1 - F.col("_lsp"))
                     .otherwise(carry + F.col("_lrn") - 1))
    prev_ts = F.when(F.col("_lrn") == 1, F.col("_prev_last_ts")).otherwise(F.col("_pts"))
    prev_open = prev_failures >= F.lit(max_failures)
    allowed = F.coalesce(~prev_open, F.lit(True)) | \
        F.coalesce(F.col(ts_col) > prev_ts + F.expr(f"INTERVAL {int(reset_timeout_s)} SECONDS"), F.col(ts_col).isNotNull())
    out = out.withColumn("failures", failures.cast("bigint")) \
        .withColumn("is_open", (F.col("failures") >= F.lit(max_failures)).cast("int")) \
        .withColumn("can_execute", allowed.cast("int"))
    return out.drop("_succ", _S, _TIE, "_lrn", "_ls", "_lsp", "_pts", "_ok", "_os", "_carry", "_prev_last_ts")
