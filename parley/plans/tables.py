"""The driver's test tables seen through the message data model.

| table         | as                                                                                   |
|---------------|--------------------------------------------------------------------------------------|
| documents     | messages to redact: ``doc_id -> id, text -> content, source -> author, lang -> channel_id`` |
| events        | history: ``event_id -> id, ts -> timestamp, user_id -> author, event_type -> channel_id`` |
| conversations | channel logs: ``conv_id -> channel_id, conv_id*1000+turn -> id, role -> author, text -> content`` |
| embeddings    | the collection: ``vec_id -> id``, 64 floats, ``label`` as metadata                      |
| benchmark     | query texts: ``item_id -> qid``                                                       |
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents_as_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("source").alias("author"),
                    F.col("lang").alias("channel_id"))


def events_as_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("ts").alias("timestamp"),
                    F.col("user_id").cast("string").alias("author"), F.col("event_type").alias("channel_id"),
                    F.col("value"))


def conversations_as_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id"), F.col("turn"),
                    F.col("text").alias("content"), F.col("role").alias("author"),
                    F.col("conv_id").cast("string").alias("channel_id"))


EVENTS_SQL = ("(select event_id id, ts \"timestamp\", cast(user_id as varchar) author, event_type channel_id, value "
              "from events)")
DOCS_SQL = "(select doc_id id, text content, source author, lang channel_id from documents)"
CONV_SQL = ("(select conv_id*1000+turn id, conv_id, turn, text content, role author, "
            "cast(conv_id as varchar) channel_id from conversations)")
