"""Message batch files: read (S1, U3, T3) and write (K1).

Reference layout: ``messages_batch_NNNN.json``, each one JSON array of message objects. A file that
is not valid UTF-8, not valid JSON, or whose root is not an array contributes zero rows; the other
files are read normally. Row order is (numeric batch number, position in the array).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.schemas import RAW_MESSAGE

# the reference's names, and the files of our own writers
BATCH_GLOB = "{messages_batch_*.json,part-*}"


def parse_batch_files(files: DataFrame, schema: T.StructType = RAW_MESSAGE) -> DataFrame:
    """``binaryFile`` rows (path, content) -> one row per message with ``batch`` and ``pos``.

    Works on a batch or a streaming frame alike (no aggregation, no ordering).
    """
    text = F.col("content").cast("string")
    good = F.is_valid_utf8(text) & F.ltrim(text).startswith("[")
    arr = F.when(good, F.from_json(text, T.ArrayType(schema)))
    named = F.regexp_extract(F.col("path"), r"messages_batch_(\d+)\.json$", 1)
    batch = F.when(named != "", named).otherwise(F.regexp_extract(F.col("path"), r"/batch=(\d+)/", 1))
    parsed = files.select(F.col("path").alias("file"),
                          F.when(batch != "", batch.cast("bigint")).alias("batch"),
                          arr.alias("_msgs"))
    # a file is a page, so looking up each row's channel among the page's is bounded work
    channels = F.transform("_msgs", lambda m: F.coalesce(m["channel_id"], F.lit(""))) if "channel_id" in schema.names \
        else F.transform("_msgs", lambda m: F.lit(""))
    rows = parsed.select("file", "batch", channels.alias("_ch"), F.posexplode("_msgs").alias("pos", "_m"))
    opens = F.array_position("_ch", F.element_at("_ch", F.col("pos") + 1)) == F.col("pos") + 1
    return rows.select("file", "batch", "pos", opens.alias("opens"), "_m.*")


def read_message_batches(spark: SparkSession, path: str, glob: str = BATCH_GLOB,
                         schema: T.StructType = RAW_MESSAGE) -> DataFrame:
    """Every batch file under ``path`` as raw message rows (one multi-file scan)."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
             .option("recursiveFileLookup", "true").load(path))
    return parse_batch_files(files, schema)


def write_batch_files(df: DataFrame, path: str, batch_col: str, order_col: str, max_rows: int = 100) -> None:
    """K1, reference file shape: one JSON array per batch (``batch=N/part=M/part-*``), messages in
    ``order_col`` order. A batch larger than ``max_rows`` (a page) is cut into parts of ``max_rows``
    by a skew-safe row number, so no array (and no task building it) grows with the data."""
    from parley.operators.ordered import ordered_scan

    ranked = ordered_scan(df, [batch_col], [F.col(order_col)], row_number="_rn")
    ranked = ranked.withColumn("part", F.floor((F.col("_rn") - 1) / F.lit(max_rows)).cast("bigint"))
    msg = F.struct(*[F.col(c) for c in df.columns if c != batch_col])
    arrays = ranked.groupBy(batch_col, "part").agg(
        F.sort_array(F.collect_list(F.struct(F.col("_rn").alias("_o"), msg.alias("_m")))).alias("_a"))
    out = arrays.select(batch_col, "part", F.to_json(F.transform("_a", lambda x: x["_m"])).alias("value"))
    out.write.mode("overwrite").partitionBy(batch_col, "part").text(path)


def write_message_batches(df: DataFrame, path: str, *, channel_col: str = "channel_id", batch_col: str = "page",
                          fmt: str = "parquet", per_batch_files: bool = False, mode: str = "overwrite") -> None:
    """K1: write pages of messages.

    Default: columnar files partitioned by channel, the page number kept as a column (no small-files
    explosion at scale). ``per_batch_files=True`` gives the reference's one-file-per-page layout as
    ``channel_id=../page=../`` JSON parts, for small exports.
    """
    if per_batch_files:
        (df.repartition(channel_col, batch_col).write.mode(mode)
         .partitionBy(channel_col, batch_col).format("json").save(path))
    else:
        df.write.mode(mode).partitionBy(channel_col).format(fmt).save(path)
