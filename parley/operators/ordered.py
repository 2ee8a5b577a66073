"""Row numbers, running sums and lags within a key, without putting a whole key into one task.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task. Chat channels and users are heavily skewed (one
key can hold a third of all rows), so every ordered computation in this library goes through :func:`ordered_scan`:

1. All rows are range partitioned by (key, order columns, a hash of the row for ties) into ``slices`` ranges. The bounds
   are sampled quantiles of the whole tuple, so ranges are about equal whatever the values are: an outlier, two distinct
   values, nulls or one huge key do not matter. The result is written once with the number of its range
   (reliable checkpoint), so every branch of the plan and every retried task sees the same slices.
2. The window runs per ``(key, slice)``: one hash shuffle, each group at most a slice.
3. Per (key, slice) totals (at most keys + slices rows) give, by a prefix over slices, the offset to add to the row number and
   running sums, and the last value for the first row's lag. They are joined back on (key, slice).

Every key is treated alike at every size. Exact: equals the single-window result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.session import cut_lineage

_S = "_slice"
_TIE = "_tie"
SLICES_CONF = "parley.ordered.slices"


def _as_cols(xs):
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def row_hash(df: DataFrame) -> Column:
    """A hash of the whole row: rows equal in their order columns get a fixed order by it."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))])


def sliced(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], slices: int | None = None) -> DataFrame:
    """``df`` with ``_slice``, increasing with (keys, order), and ``_tie``; written once."""
    spark = df.sparkSession
    n = slices or int(spark.conf.get(SLICES_CONF, spark.conf.get("spark.sql.shuffle.partitions")))
    tied = df.withColumn(_TIE, row_hash(df))
    dealt = tied.repartitionByRange(n, *[F.col(k) for k in keys], *_as_cols(order), F.col(_TIE))
    return cut_lineage(dealt.withColumn(_S, F.spark_partition_id()))


def ordered_scan(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], *, descending: bool = False,
                 row_number: str | None = None,
                 running_sums: dict[str, Column] | None = None,
                 lags: dict[str, Column] | None = None,
                 slices: int | None = None) -> DataFrame:
    """Add ``row_number`` (1-based), inclusive running sums and one-row lags within ``keys``, ordered
    by ``order`` (all ascending with nulls first, or all descending with nulls last; ties by a hash of the row)."""
    running_sums = dict(running_sums or {})
    lags = dict(lags or {})
    keys = list(keys)
    if not keys:
        raise ValueError("ordered_scan needs at least one key (a global order would be one window partition)")
    order_cols = [*_as_cols(order), F.col(_TIE)]
    parts = sliced(df, keys, order, slices)
    if descending:
        parts = parts.withColumn(_S, -F.col(_S))
    sort = [c.desc_nulls_last() if descending else c.asc_nulls_first() for c in order_cols]
    key_cols = [F.col(k) for k in keys]
    local = Window.partitionBy(*key_cols, F.col(_S)).orderBy(*sort)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    r = parts.withColumn("_lrn", F.row_number().over(local))
    for name, c in running_sums.items():
        r = r.withColumn(f"_ls_{name}", F.sum(c).over(upto))
    for name, c in lags.items():
        r = r.withColumn(f"_lg_{name}", F.lag(c).over(local))

    # per-slice totals straight from the slices (partial aggregation, no second window sort);
    # the last row of a slice in window order is the max of the order tuple (min when descending:
    # struct ordering puts nulls first, matching nulls first / nulls last)
    last_of = F.min_by if descending else F.max_by
    order_key = F.struct(*order_cols)
    aggs = [F.count(F.lit(1)).alias("_cnt")]
    aggs += [F.sum(c).alias(f"_ts_{name}") for name, c in running_sums.items()]
    aggs += [last_of(c, order_key).alias(f"_last_{name}") for name, c in lags.items()]
    stats = parts.groupBy(*key_cols, F.col(_S)).agg(*aggs)
    sw = Window.partitionBy(*key_cols).orderBy(F.col(_S))
    before = sw.rowsBetween(Window.unboundedPreceding, -1)
    sel = [*[F.col(k).alias(f"_ok_{k}") for k in keys], F.col(_S).alias("_os"),
           F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off")]
    sel += [F.coalesce(F.sum(f"_ts_{name}").over(before), F.lit(0)).alias(f"_soff_{name}")
            for name in running_sums]
    sel += [F.lag(f"_last_{name}").over(sw).alias(f"_plast_{name}") for name in lags]
    offsets = stats.select(*sel)

    # null-safe on the keys: rows with a null key form one group, as in a plain window
    cond = F.col(_S) == F.col("_os")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_ok_{k}"))
    out = r.join(offsets, cond, "inner")
    if row_number:
        out = out.withColumn(row_number, (F.col("_off") + F.col("_lrn")).cast("bigint"))
    for name in running_sums:
        out = out.withColumn(name, F.col(f"_soff_{name}") + F.col(f"_ls_{name}"))
    for name in lags:
        out = out.withColumn(name, F.when(F.col("_lrn") == 1, F.col(f"_plast_{name}"))
                             .otherwise(F.col(f"_lg_{name}")))
    helper = [_S, _TIE, "_os", "_lrn", "_off", *[f"_ok_{k}" for k in keys]]
    helper += [f"_ls_{n_}" for n_ in running_sums] + [f"_soff_{n_}" for n_ in running_sums]
    helper += [f"_lg_{n_}" for n_ in lags] + [f"_plast_{n_}" for n_ in lags]
    return out.drop(*helper)
