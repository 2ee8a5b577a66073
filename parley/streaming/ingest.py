"""Structured Streaming forms of ingest, privacy, collection load and progress.

All streams are file-sourced with a checkpoint location on shared storage: exactly-once file
tracking across restarts (S7), ``availableNow`` to drain what is there and stop, or a processing-time
trigger for a live feed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from parley.operators.normalize import normalize_saved
from parley.operators.privacy import apply_privacy, drop_empty_content
from parley.sources.batches import BATCH_GLOB, parse_batch_files
from parley.sources.collection import collection_add
from parley.sources.registry import RECORDS_A_FILE, state_records

BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
#: Batch files are small (a page of messages), and a micro-batch costs a task or two for every partition of its state,
#: however few rows it has: micro-batches are bounded by bytes, so that their number does not go with that of the files.
TRIGGER_BYTES = 64 << 20


def message_file_stream(spark: SparkSession, in_dir: str, glob: str = BATCH_GLOB,
                        max_files_per_trigger: int | None = None,
                        max_bytes_per_trigger: int = TRIGGER_BYTES) -> DataFrame:
    """R1 source: new batch files as canonical messages, with ``file``, ``batch``, ``pos`` and ``opens`` (whether the row
    is the first of its channel in its file). A micro-batch has files of ``max_bytes_per_trigger``, or
    ``max_files_per_trigger`` files if given."""
    bound = {"maxBytesPerTrigger": max_bytes_per_trigger} if max_files_per_trigger is None else \
        {"maxFilesPerTrigger": max_files_per_trigger}
    files = (spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA).option("pathGlobFilter", glob)
             .option("recursiveFileLookup", "true").options(**bound).load(in_dir))
    raw = parse_batch_files(files)
    return normalize_saved(raw, keep=("file", "batch", "pos", "opens"))


def _run(writer, available_now: bool) -> StreamingQuery:
    q = writer.trigger(availableNow=True).start() if available_now else writer.start()
    if available_now:
        q.awaitTermination()
        if q.exception() is not None:
            raise q.exception()
    return q


def ingest_stream(spark: SparkSession, in_dir: str, out: str, checkpoint: str, *, glob: str = BATCH_GLOB,
                  max_files_per_trigger: int | None = None, max_bytes_per_trigger: int = TRIGGER_BYTES,
                  available_now: bool = True, partition_by: tuple[str, ...] = ()) -> StreamingQuery:
    """Incremental, restartable ingest of batch files into a parquet table (optionally
    partitioned, e.g. by channel, so later date or channel filters prune files)."""
    msgs = message_file_stream(spark, in_dir, glob, max_files_per_trigger, max_bytes_per_trigger)
    w = msgs.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    if partition_by:
        w = w.partitionBy(*partition_by)
    return _run(w, available_now)


def dedup_stream(msgs: DataFrame, *, id_cols: tuple[str, ...] = ("channel_id", "id"), delay: str = "1 hour",
                 time_col: str | None = None) -> DataFrame:
    """A message that is delivered again within ``delay`` is one row; the state holds the ids of about that time.

    Time is that of arrival (the micro-batch's), so no first delivery is ever late, however old the message; ``time_col`` takes
    a column instead, and then rows below the watermark are dropped. Rows without an id are the same only if all their
    columns are.
    """
    from parley.operators.ordered import row_hash

    own = F.when(F.col(id_cols[-1]).isNull(), F.concat(F.lit("row:"), row_hash(msgs).cast("string"))).otherwise(
        F.concat(F.lit("id:"), F.col(id_cols[-1]).cast("string")))
    timed = msgs.withColumn("_time", F.current_timestamp() if time_col is None else F.col(time_col).cast("timestamp"))
    keyed = timed.withColumn("_own", own).withWatermark("_time", delay)
    return keyed.dropDuplicatesWithinWatermark([*id_cols[:-1], "_own"]).drop("_time", "_own")


def privacy_stream(msgs: DataFrame, optout: DataFrame | None = None, **kw) -> DataFrame:
    """R2: stateless drop-empty, opt-out (stream-static anti join) and redaction."""
    return apply_privacy(drop_empty_content(msgs), optout, **kw)


def query_id(batch: DataFrame) -> str:
    """The id of the query that a micro-batch belongs to: kept in its checkpoint, new with a new one."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")


def collection_stream(stream: DataFrame, root: str, name: str, checkpoint: str, *,
                      available_now: bool = True) -> StreamingQuery:
    """Each micro-batch is one insert-if-absent load, named by the query's id (kept in its checkpoint) and the batch
    id: a retried micro-batch rewrites its own load, and a new checkpoint starts names of its own."""

    def load(batch: DataFrame, batch_id: int) -> None:
        collection_add(batch, root, name, int(batch_id), source=f"stream-{query_id(batch)}", retry=True,
                       order_cols=tuple(c for c in ("file", "pos") if c in batch.columns))

    w = stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    return _run(w, available_now)


def progress_stream(msgs: DataFrame, out: str, checkpoint: str, *, channel_col: str = "channel_id",
                    available_now: bool = True) -> StreamingQuery:
    """Running message count per channel (update mode). Each micro-batch writes the changed counters to a folder of its
    query and batch id; readers take the latest (:func:`latest_progress`)."""
    counts = msgs.groupBy(channel_col).agg(F.count(F.lit(1)).alias("messages"))

    def sink(batch: DataFrame, batch_id: int) -> None:
        # a retried micro-batch overwrites its own folder: idempotent
        batch.write.mode("overwrite").parquet(f"{out}/query={query_id(batch)}/batch_id={int(batch_id)}")

    w = counts.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint)
    return _run(w, available_now)


def _latest_counters(spark: SparkSession, out: str, channel_col: str) -> DataFrame:
    """(query, channel, messages, batch_id): the last counters of every query."""
    t = spark.read.parquet(out)
    return t.groupBy("query", channel_col).agg(F.max_by("messages", "batch_id").alias("messages"),
                                               F.max("batch_id").alias("batch_id"))


def latest_progress(spark: SparkSession, out: str, channel_col: str = "channel_id") -> DataFrame:
    """Messages per channel so far: the last counters of each query, summed over the queries that wrote to ``out``. A query
    with a new checkpoint counts what it reads itself, so input that two queries read counts twice."""
    return _latest_counters(spark, out, channel_col).groupBy(channel_col).agg(F.sum("messages").alias("messages"))


def compact_progress(spark: SparkSession, out: str, into: str, channel_col: str = "channel_id") -> None:
    """The last counters of every query in the folder ``into``, one file a query: what :func:`latest_progress` says of it is
    what it says of ``out``. A query goes on in the new folder if its ``out`` is changed between two runs."""
    last = _latest_counters(spark, out, channel_col)
    last.repartition("query", "batch_id").write.mode("overwrite").partitionBy("query", "batch_id").parquet(into)


def file_table_stream(spark: SparkSession, path: str, schema: StructType | str,
                      max_files_per_trigger: int = 1) -> DataFrame:
    """A parquet folder as a stream, a few files per micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(path)


def ingest_state_stream(msgs: DataFrame, state_path: str, checkpoint: str, *, channel_col: str = "channel_id",
                        id_col: str = "id", available_now: bool = True) -> StreamingQuery:
    """K3 on a stream: after every micro-batch, the state of each channel it touched (messages and
    batches so far, oldest id) is appended as a record; :func:`load_ingest_state` reads the latest by time, whichever query
    wrote it.

    A streaming aggregation in update mode keeps the running values in the state store. A file counts as a batch of
    every channel in it: by the rows that are the first of their channel in their file (``opens``, see
    :func:`message_file_stream`), so no distinct count is needed.
    """
    num = F.col(id_col).cast("decimal(20,0)")
    agg = msgs.groupBy(channel_col).agg(
        F.min(num).cast("string").alias("oldest_message_id"),
        F.sum(F.col("opens").cast("long")).alias("batch_count"),
        F.count(F.lit(1)).alias("total_messages"))

    def sink(batch: DataFrame, batch_id: int) -> None:
        rec = state_records(batch.select(F.col(channel_col).alias("channel_id"), "oldest_message_id", "batch_count",
                                         "total_messages", F.current_timestamp().alias("last_updated")))
        # one folder per query and micro-batch, overwritten on retry: idempotent, and no query writes to another's
        rec.write.mode("overwrite").option("maxRecordsPerFile", RECORDS_A_FILE).json(
            f"{state_path}/query={query_id(batch)}/batch_id={int(batch_id)}")

    w = agg.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint)
    return _run(w, available_now)
