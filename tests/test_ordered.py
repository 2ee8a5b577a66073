"""ordered_scan equals a plain per-key window, with and without slicing of heavy keys."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from parley.operators.ordered import ordered_scan
from parley.plans.tables import table
from conftest import SF_SMALL


def _plain(df, keys, order, desc):
    srt = [F.col(c).desc_nulls_last() if desc else F.col(c).asc_nulls_first() for c in order]
    w = Window.partitionBy(*keys).orderBy(*srt)
    return (df.withColumn("rn", F.row_number().over(w).cast("bigint"))
            .withColumn("run", F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("prev", F.lag("ts").over(w)))


@pytest.mark.parametrize("desc", [False, True])
@pytest.mark.parametrize("slices", [1, 60])
def test_matches_plain_window(spark, desc, slices):
    ev = table(spark, SF_SMALL, "events").select("event_id", "ts", "event_type", "value")
    got = ordered_scan(ev, ["event_type"], ["ts", "event_id"], descending=desc, row_number="rn",
                       running_sums={"run": F.col("value")}, lags={"prev": F.col("ts")}, slices=slices)
    want = _plain(ev, ["event_type"], ["ts", "event_id"], desc)
    cols = ["event_id", "rn", "run", "prev"]
    a = sorted((r[0], r[1], round(r[2], 6), r[3]) for r in got.select(*cols).collect())
    b = sorted((r[0], r[1], round(r[2], 6), r[3]) for r in want.select(*cols).collect())
    assert a == b


def test_null_keys_and_order_values(spark):
    rows = [(None, 1, 1.0), (None, 2, 2.0), ("a", None, 3.0), ("a", 5, 4.0), ("a", 7, 5.0), ("a", 6, 6.0)]
    df = spark.createDataFrame(rows, "k string, o long, value double")
    got = ordered_scan(df, ["k"], ["o"], row_number="rn", running_sums={"s": F.col("value")}, slices=6)
    res = {(r["k"], r["o"]): (r["rn"], r["s"]) for r in got.collect()}
    assert res[(None, 1)] == (1, 1.0) and res[(None, 2)] == (2, 3.0)
    assert res[("a", None)] == (1, 3.0)  # nulls first when ascending
    assert res[("a", 5)] == (2, 7.0) and res[("a", 6)] == (3, 13.0) and res[("a", 7)] == (4, 18.0)


@pytest.mark.parametrize("values", [
    lambda i: 0 if i == 0 else 10 ** 12 + i,            # one outlier
    lambda i: i % 2,                                     # two distinct values
    lambda i: None if i % 3 else i,                      # nulls
    lambda i: 7,                                         # one value
    lambda i: i if i < 900 else 10 * i,                  # clustered
])
def test_slices_are_bounded_whatever_the_values(spark, values):
    from parley.operators.ordered import sliced
    rows = [("hot" if i % 5 else "cold", values(i), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, o long, id long")
    sizes = [r["count"] for r in sliced(df, ["k"], ["o"], 10).groupBy("_slice").count().collect()]
    assert sum(sizes) == 2000 and max(sizes) <= 2 * 200
    got = ordered_scan(df, ["k"], ["o", "id"], row_number="rn", slices=10)
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("o", "id")).cast("bigint"))
    assert got.select("k", "id", "rn").exceptAll(want.select("k", "id", "rn")).count() == 0


def test_numbers_are_complete_where_the_order_has_ties(spark):
    df = spark.createDataFrame([("k", 1, i) for i in range(300)], "k string, o long, id long")
    got = ordered_scan(df, ["k"], ["o"], row_number="rn", running_sums={"s": F.lit(1)}, slices=7).collect()
    assert sorted(r.rn for r in got) == list(range(1, 301)) and all(r.rn == r.s for r in got)
