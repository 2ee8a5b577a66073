"""Spark schemas of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

ATTACHMENT = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("filename", T.StringType()),
    T.StructField("size", T.LongType()), T.StructField("url", T.StringType()),
    T.StructField("proxy_url", T.StringType()), T.StructField("width", T.IntegerType()),
    T.StructField("height", T.IntegerType()), T.StructField("content_type", T.StringType()),
])
ATTACHMENT_ARRAY = T.ArrayType(ATTACHMENT)
RAW_REACTION = T.StructType([
    T.StructField("emoji", T.StringType()), T.StructField("count", T.LongType()),
])
REACTION = T.StructType([T.StructField("emoji", T.StringType()), T.StructField("count", T.LongType())])

# author, mentions and a reaction's emoji are read as text: an object stays JSON text, a plain string stays itself
RAW_MESSAGE = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("content", T.StringType()),
    T.StructField("author", T.StringType()), T.StructField("timestamp", T.StringType()),
    T.StructField("channel_id", T.StringType()), T.StructField("attachments", ATTACHMENT_ARRAY),
    T.StructField("reactions", T.ArrayType(RAW_REACTION)), T.StructField("mentions", T.StringType()),
    T.StructField("source", T.StringType()),
])

MESSAGE = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("content", T.StringType()),
    T.StructField("author", T.StringType()), T.StructField("author_id", T.StringType()),
    T.StructField("timestamp", T.TimestampType()), T.StructField("channel_id", T.StringType()),
    T.StructField("attachments", ATTACHMENT_ARRAY), T.StructField("reactions", T.ArrayType(REACTION)),
    T.StructField("mentions", T.ArrayType(T.StringType())), T.StructField("source", T.StringType()),
])

METADATA = T.StructType([
    T.StructField("author", T.StringType()), T.StructField("timestamp", T.StringType()),
    T.StructField("channel_id", T.StringType()), T.StructField("has_attachments", T.BooleanType()),
    T.StructField("has_reactions", T.BooleanType()), T.StructField("has_mentions", T.BooleanType()),
])

COLLECTION = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("document", T.StringType()), T.StructField("metadata", METADATA),
])

INGEST_STATE = T.StructType([
    T.StructField("channel_id", T.StringType()), T.StructField("oldest_message_id", T.StringType()),
    T.StructField("batch_count", T.LongType()), T.StructField("total_messages", T.LongType()),
    T.StructField("last_updated", T.TimestampType()),
])
