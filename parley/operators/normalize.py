"""Raw and saved messages to the canonical schema, and back to JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions.messages import (author_id, author_name, flatten_reactions, iso_ts, mention_ids,
                                       message_metadata, parse_ts, valid_source)
from parley.schemas import ATTACHMENT_ARRAY

def _empty_att():
    return F.array().cast(ATTACHMENT_ARRAY)


def _str(df: DataFrame, name: str):
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")


def normalize_api(df: DataFrame, keep: tuple[str, ...] = (), _saved: bool = False,
                  default_ts=None) -> DataFrame:
    """API message -> canonical. ``author`` and ``mentions`` are JSON text or plain strings.
    ``keep`` columns (file, position...) are carried through unchanged. A missing or unparseable
    timestamp is null, or ``default_ts`` when given (Q8: never the wall clock)."""
    cols = df.columns
    return df.select(
        *keep,
        _str(df, "id").alias("id"),
        _str(df, "content").alias("content"),
        (author_name("author") if "author" in cols else F.lit("unknown")).alias("author"),
        (author_id("author") if "author" in cols else F.lit(None).cast("string")).alias("author_id"),
        F.coalesce(parse_ts("timestamp") if "timestamp" in cols else F.lit(None).cast("timestamp"),
                   F.lit(default_ts).cast("timestamp")).alias("timestamp"),
        _str(df, "channel_id").alias("channel_id"),
        (F.coalesce(F.col("attachments"), _empty_att()) if "attachments" in cols else _empty_att()).alias("attachments"),
        (flatten_reactions("reactions") if "reactions" in cols else flatten_reactions(F.lit(None)
                                                                                      .cast("array<struct<emoji:string,count:bigint>>"))).alias("reactions"),
        (mention_ids("mentions") if "mentions" in cols else mention_ids(F.lit(None).cast("string"))).alias("mentions"),
        (F.coalesce(F.col("source"), F.lit("discord")) if _saved and "source" in cols
         else F.lit("discord")).alias("source"),
    )


def normalize_saved(df: DataFrame, keep: tuple[str, ...] = (), default_ts=None) -> DataFrame:
    """Saved message -> canonical. Author resolved to the user name in both shapes (Q2);
    source defaults to 'discord'; unknown sources are kept here and split off by :func:`validate_source`."""
    return normalize_api(df, keep, _saved=True, default_ts=default_ts)


def validate_source(df: DataFrame, source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows) instead of aborting the whole run."""
    ok = valid_source(source_col)
    return df.filter(ok), df.filter(~ok | F.col(source_col).isNull())


def serialize_messages(df: DataFrame, out_col: str = "json") -> DataFrame:
    """Canonical -> JSON document with the 9 keys, ISO timestamp, null fields written out."""
    doc = F.struct(F.col("id"), F.col("content"), F.col("author"), iso_ts("timestamp").alias("timestamp"),
                   F.col("channel_id"), F.col("attachments"), F.col("reactions"), F.col("mentions"), F.col("source"))
    return df.select(F.col("id"), F.to_json(doc, {"ignoreNullFields": "false"}).alias(out_col))


def with_metadata(df: DataFrame, out_col: str = "metadata") -> DataFrame:
    """N7 as a DataFrame step."""
    return df.withColumn(out_col, message_metadata("author", "timestamp", "channel_id", "attachments",
                                                   "reactions", "mentions"))


def normalize_with_rejects(raw: DataFrame, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Q9: saved messages -> (canonical rows, rejected raw rows with a ``reason``). A row is rejected
    for an unknown source or a timestamp that is present but does not parse; the others go on."""
    cols = raw.columns
    bad_ts = (F.col("timestamp").isNotNull() & (F.trim(F.col("timestamp")) != "") & parse_ts("timestamp").isNull()) \
        if "timestamp" in cols else F.lit(False)
    bad_src = (F.col("source").isNotNull() & ~valid_source("source")) if "source" in cols else F.lit(False)
    reason = F.when(bad_src, F.lit("source")).when(bad_ts, F.lit("timestamp"))
    tagged = raw.withColumn("_reason", reason)
    good = normalize_saved(tagged.filter(F.col("_reason").isNull()).drop("_reason"), keep)
    rejected = tagged.filter(F.col("_reason").isNotNull()).withColumnRenamed("_reason", "reason")
    return good, rejected
