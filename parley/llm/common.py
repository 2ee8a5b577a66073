"""Helpers shared by the operators: reading tables, Arrow text columns, bounded batches, checkpoints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from parley.session import prepare, shared_dir

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def kept(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder (reliable checkpoint), so several readers do not compute it again
    and a lost executor costs a reread only."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table_path(spark: SparkSession) -> str:
    """A fresh place for a table in the shared folder."""
    return shared_dir(spark, "parley-tables")


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` as a parquet table in the shared folder: like ``kept``, but compressed and column by column. The shuffle files
    of the job that writes it go with the job, unless the session says otherwise: nothing reads them again, and else they
    stay until the driver happens to collect its garbage."""
    spark = df.sparkSession
    path = path or table_path(spark)
    unsaid = spark.conf.get(SHUFFLE_CLEANUP, None) is None
    if unsaid:
        spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if unsaid:
            spark.conf.unset(SHUFFLE_CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Remove a table that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, lengthened until no column of ``df`` has them (column names know no case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def texts(col: pa.Array) -> list[str]:
    """A string column as Python strings, null as the empty text."""
    return [x or "" for x in col.to_pylist()]


def raw_texts(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n+1 offsets; a null row is empty."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset:col.offset + n + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, offsets


def row_slices(offsets: np.ndarray, max_bytes: int) -> Iterator[tuple[int, int]]:
    """Runs of rows [i, j) with at most ``max_bytes`` of text each (one row alone may be longer)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + max_bytes, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def record_batch(schema: pa.Schema, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(cols, schema)], schema=schema)
