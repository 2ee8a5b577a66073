"""Small registries: opt-out list (S3) and per-channel ingest state."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from parley.schemas import INGEST_STATE


def is_missing(error: AnalysisException) -> bool:
    """Only a path that does not exist is an absent registry, state or collection; anything else is an error."""
    return error.getCondition() in ("PATH_NOT_FOUND", "PATH_DOES_NOT_EXIST")


def read_opt_out(spark: SparkSession, path: str, user_col: str = "user_id") -> DataFrame:
    """S3: one id per line, trimmed, blank lines skipped; a missing file is an empty registry."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as e:
        if not is_missing(e):
            raise
        return spark.createDataFrame([], f"{user_col} string")
    v = F.trim(F.col("value"))
    return lines.select(v.alias(user_col)).filter(F.length(user_col) > 0).distinct()


#: A state file is read as one text.
RECORDS_A_FILE = 50_000
_STATE_READ = ("channel_id string, oldest_message_id string, batch_count bigint, total_messages bigint, "
               "last_updated string, unnamed boolean")


def load_ingest_state(spark: SparkSession, path: str, channel: str | None = None) -> DataFrame:
    """Latest state record per channel (of one channel if given).

    The files are read once, as text: lines that are JSON objects are a record each; a file without any is one record,
    however it is laid out. Missing path, unreadable or malformed records = no state; ``oldest_message_id`` is read as text
    even when written as a JSON number; counters default to 0. A record without a channel counts only if our writer
    marked it as that of the messages that have none.
    """
    try:
        files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    except AnalysisException as e:
        if not is_missing(e):
            raise
        return spark.createDataFrame([], INGEST_STATE)

    def record(text):
        return F.from_json(text, _STATE_READ, {"mode": "PERMISSIVE"})

    def parses(text):  # an object of its own; the inner lines of one that is laid out are indented
        return text.startswith("{") & F.try_parse_json(text).isNotNull()

    whole = F.col("value")
    own = F.filter(F.split(whole, "\n"), parses)
    lines = F.explode(F.when(F.size(own) > 0, own).otherwise(F.array(whole)))
    raw = files.select(lines.alias("value")).filter(F.try_parse_json("value").isNotNull())
    raw = raw.select(record(F.col("value")).alias("r")).select("r.*")
    ok = raw.filter(F.col("channel_id").isNotNull() | F.col("unnamed")).drop("unnamed")
    if channel is not None:
        ok = ok.filter(F.col("channel_id") == F.lit(str(channel)))
    at = F.col("last_updated").try_cast("timestamp")
    rec = F.struct(F.col("oldest_message_id"), F.coalesce("batch_count", F.lit(0).cast("bigint")).alias("batch_count"),
                   F.coalesce("total_messages", F.lit(0).cast("bigint")).alias("total_messages"), at.alias("last_updated"))
    # a record without a time is older than any with one; of equal times the one with more messages counts
    age = F.struct(at.alias("at"), F.coalesce("total_messages", F.lit(0)).alias("n"), F.coalesce("batch_count", F.lit(0)).alias("b"),
                   F.col("oldest_message_id").alias("id"))
    latest = ok.groupBy("channel_id").agg(F.max_by(rec, age).alias("s"))
    return latest.select("channel_id", "s.*")


def state_from_totals(totals: DataFrame, cursors: DataFrame, when: dt.datetime | None = None) -> DataFrame:
    """K3 input: join per-channel totals (A2) with cursors (A5) into state records. No channel is a channel, too."""
    ts = F.lit(when).cast("timestamp") if when else F.current_timestamp()
    cursors = cursors.select(F.col("channel_id").alias("_ch"), "oldest_message_id")
    return totals.join(cursors, F.col("channel_id").eqNullSafe(F.col("_ch")), "left").select(
        "channel_id", "oldest_message_id", F.col("batch_count").cast("bigint"),
        F.col("total_messages").cast("bigint"), ts.alias("last_updated"))


def state_records(state: DataFrame) -> DataFrame:
    """State rows as they are written: times as text, and a mark where the record is that of no channel."""
    return state.select("channel_id", "oldest_message_id", "batch_count", "total_messages",
                        F.date_format("last_updated", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("last_updated"),
                        F.when(F.col("channel_id").isNull(), F.lit(True)).alias("unnamed"))


def save_ingest_state(state: DataFrame, path: str) -> None:
    """K3: one JSON record per channel (append; the loader keeps the latest per channel), in files of bounded size."""
    state_records(state).write.mode("append").option("maxRecordsPerFile", RECORDS_A_FILE).json(path)


def compact_ingest_state(spark: SparkSession, path: str, into: str) -> DataFrame:
    """The latest record of every channel of the state at ``path``, as a fresh state at ``into`` (another folder, so that
    readers of the old one are not disturbed)."""
    save_ingest_state(load_ingest_state(spark, path), into)
    return load_ingest_state(spark, into)
