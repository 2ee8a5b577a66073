"""Queries: sources, sinks, composed jobs and streams over files Spark writes from the tables
(S1, S3, S4, S7, S9, K1, K2, K3, A1, M1, M2, M4, R1, R2, R3, R6).

Each query writes its inputs under the session's shared checkpoint folder (``spark.checkpoint.dir``),
then reads them back through the operator under test.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from parley.operators.normalize import normalize_saved
from parley.plans.jobs import build_collection, ingest_history, prepare_collection_rows
from parley.plans.oracle_sql import default_chain_sql
from parley.plans.q_history import END, START, _FILTERED_PAGES_SQL
from parley.plans.q_privacy import OPT_OUT, _users, _values_sql
from parley.plans.registry import register
from parley.plans.tables import CONV_SQL, DOCS_SQL, conversations_as_messages, documents_as_messages, events_as_messages, table
from parley.session import shared_dir
from parley.sources.batches import read_message_batches, write_batch_files
from parley.sources.collection import collection_add, collection_compact, collection_opt_in, collection_opt_out, open_collection
from parley.sources.manifest import Files
from parley.sources.registry import load_ingest_state, read_opt_out
from parley.streaming.ingest import (TRIGGER_BYTES, collection_stream, dedup_stream, file_table_stream, ingest_state_stream,
                                     ingest_stream, latest_progress, message_file_stream, privacy_stream, progress_stream)

_STATE_TIME = dt.datetime(2025, 1, 1, 0, 0, 0)


CONVERSATIONS = 20


def _conversation_batches(spark, sf) -> str:
    """Conversation turns saved as batch files: ``CONVERSATIONS`` conversations a batch, in pages of 100 messages, one
    JSON array a page; author as a plain string, naive timestamps (the saved-message shape)."""
    out = shared_dir(spark, "batches")
    c = conversations_as_messages(spark, sf)
    saved = c.select(F.floor(F.col("conv_id") / CONVERSATIONS).alias("batch"), F.col("turn"), F.col("id").alias("place"), F.col("id").cast("string").alias("id"),
                     "content", "author",
                     F.concat(F.lit("2025-01-01T12:00:"), F.lpad(F.col("turn").cast("string"), 2, "0")).alias("timestamp"),
                     "channel_id")
    write_batch_files(saved, out, "batch", "place")
    return out


MICRO_BATCHES = 3


def _trigger_bytes(spark, path: str) -> int:
    """Bytes a micro-batch: at most ``TRIGGER_BYTES``; a small input still comes in about ``MICRO_BATCHES`` of them."""
    return max(1, min(TRIGGER_BYTES, Files(spark).size(path) // MICRO_BATCHES))


def _batch_stream(spark, path: str):
    return message_file_stream(spark, path, max_bytes_per_trigger=_trigger_bytes(spark, path))


_PLACED = f"""(select *, conv_id // {CONVERSATIONS} batch,
       row_number() over (partition by conv_id // {CONVERSATIONS} order by id) - 1 place from {CONV_SQL})"""
_BATCH_ORACLE = f"""
select cast(id as varchar) id, author, content, channel_id, batch, cast(place % 100 as integer) pos from {_PLACED}"""
_BATCH_COLS = ("id", "author", "content", "channel_id", "batch", "pos")


@register("read_message_batches", _BATCH_ORACLE)
def q_read_message_batches(spark, sf):
    """The batch files read back in one multi-file scan and normalised."""
    path = _conversation_batches(spark, sf)
    raw = read_message_batches(spark, path)  # the default reader finds what the default writer wrote
    return normalize_saved(raw, keep=("batch", "pos")).select(*_BATCH_COLS)


@register("ingest_stream", _BATCH_ORACLE)
def q_ingest_stream(spark, sf):
    """The same files through a restartable file stream (micro-batches bounded by bytes) into parquet."""
    path = _conversation_batches(spark, sf)
    out, ckpt = shared_dir(spark, "ingest_out"), shared_dir(spark, "ingest_ckpt")
    ingest_stream(spark, path, out, ckpt, max_bytes_per_trigger=_trigger_bytes(spark, path))
    return spark.read.parquet(out).select(*_BATCH_COLS)


@register("privacy_stream", f"""
select cast(id as varchar) id, author, {default_chain_sql('content')} content from {CONV_SQL}
where content is not null and content <> '' and author not in ('system')""")
def q_privacy_stream(spark, sf):
    """R2: the batch-file stream through drop-empty, opt-out (stream-static anti join) and redaction."""
    path = _conversation_batches(spark, sf)
    out, ckpt = shared_dir(spark, "privacy_out"), shared_dir(spark, "privacy_ckpt")
    s = privacy_stream(_batch_stream(spark, path), _users(spark, ("system",)))
    q = (s.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out).select("id", "author", "content")


@register("progress_stream", f"select channel_id, count(*) messages from {CONV_SQL} group by all")
def q_progress_stream(spark, sf):
    """Running per-channel counters maintained by a streaming aggregation."""
    path = _conversation_batches(spark, sf)
    out, ckpt = shared_dir(spark, "progress_out"), shared_dir(spark, "progress_ckpt")
    progress_stream(_batch_stream(spark, path), out, ckpt)
    return latest_progress(spark, out)


def _embedding_rows(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("id"), "embedding", F.lit(None).cast("string").alias("document"),
                    F.struct(F.col("label").cast("string").alias("author"), F.lit(None).cast("string").alias("timestamp"),
                             F.lit(None).cast("string").alias("channel_id"), F.lit(False).alias("has_attachments"),
                             F.lit(False).alias("has_reactions"), F.lit(False).alias("has_mentions")).alias("metadata"),
                    "label")


@register("collection_add", """
select cast(vec_id as varchar) id, case when label = 0 then 1 else 2 end load_id from embeddings""")
def q_collection_add(spark, sf):
    """Load 1 adds the label-0 vectors, load 2 adds every vector; stored ids are left alone."""
    root = shared_dir(spark, "collections")
    rows = _embedding_rows(spark, sf)
    collection_add(rows.filter(F.col("label") == 0).drop("label"), root, "vectors", 1)
    collection_add(rows.drop("label"), root, "vectors", 2)
    return open_collection(spark, root, "vectors").select("id", F.col("load_id").cast("integer").alias("load_id"))


@register("collection_stream", "select cast(vec_id as varchar) id, cast(label as varchar) author from embeddings")
def q_collection_stream(spark, sf):
    """The vectors arrive as files (one folder per label, then all of them again); every
    micro-batch is an insert-if-absent load, so each id is stored once."""
    src = shared_dir(spark, "vector_files")
    rows = _embedding_rows(spark, sf)
    rows.repartition(4, "label").drop("label").write.mode("overwrite").parquet(src)
    rows.drop("label").write.mode("append").parquet(src)  # every id arrives a second time
    root, ckpt = shared_dir(spark, "collections"), shared_dir(spark, "collection_ckpt")
    stream = file_table_stream(spark, src, rows.drop("label").schema, max_files_per_trigger=2)
    collection_stream(stream, root, "vectors", ckpt)
    return open_collection(spark, root, "vectors").select("id", F.col("metadata.author").alias("author"))


@register("collection_stream_after_load", """
select cast(vec_id as varchar) id, case when label = 0 then 'batch' else 'stream' end origin from embeddings""")
def q_collection_stream_after_load(spark, sf):
    """K2 + R3: a batch load of the label-0 vectors, then a stream of all of them, then the same stream from a new
    checkpoint: every id is stored once, by whoever came first."""
    rows = _embedding_rows(spark, sf)
    src, root = shared_dir(spark, "vector_files"), shared_dir(spark, "collections")
    rows.drop("label").write.mode("overwrite").parquet(src)
    collection_add(rows.filter(F.col("label") == 0).drop("label"), root, "vectors", 0)
    for name in ("first", "second"):
        stream = file_table_stream(spark, src, rows.drop("label").schema, max_files_per_trigger=2)
        collection_stream(stream, root, "vectors", shared_dir(spark, f"collection_ckpt_{name}"))
    return open_collection(spark, root, "vectors").select("id", F.split("source", "-")[0].alias("origin"))


@register("collection_backfill", """
select cast(vec_id as varchar) id, cast(case when label <= 4 then 2 else 1 end as bigint) load_id from embeddings""")
def q_collection_backfill(spark, sf):
    """Load 2 (labels up to 4) comes before load 1 (all vectors): the later load 1 adds only what is missing."""
    root = shared_dir(spark, "collections")
    rows = _embedding_rows(spark, sf)
    collection_add(rows.filter(F.col("label") <= 4).drop("label"), root, "vectors", 2)
    collection_add(rows.drop("label"), root, "vectors", 1)
    return open_collection(spark, root, "vectors").select("id", "load_id")


@register("optout_after_load", """
with d as (select cast(doc_id as varchar) id, source author from documents where text is not null and text <> '')
select 'out' phase, id, author from d where author is null or author not in ('src3', 'src7') union all
select 'in again', id, author from d where author is null or author <> 'src3' union all
select 'compacted', id, author from d where author is null or author <> 'src3' union all
select 'in too late', id, author from d where author is null or author <> 'src3'""")
def q_optout_after_load(spark, sf):
    """U1 + U2 + F3 on what is stored: two authors opt out after the load, one opts in again, the other's rows are removed
    for good, so that they are not back when the author opts in too."""
    root, phases = shared_dir(spark, "collections"), []

    def phase(name):
        rows = open_collection(spark, root, "documents")
        phases.append(rows.select(F.lit(name).alias("phase"), "id", F.col("metadata.author").alias("author")))

    msgs = documents_as_messages(spark, sf).withColumn("id", F.col("id").cast("string"))
    rows = prepare_collection_rows(msgs, redact=False, embedder=lambda d: d.withColumn(
        "embedding", F.array(F.lit(0.0)).cast("array<float>")))
    collection_add(rows, root, "documents", 1)
    collection_opt_out(_users(spark, OPT_OUT), root, "documents")
    phase("out")
    collection_opt_in(_users(spark, OPT_OUT[1:]), root, "documents")
    phase("in again")
    collection_compact(spark, root, "documents")
    phase("compacted")
    collection_opt_in(_users(spark, OPT_OUT[:1]), root, "documents")
    phase("in too late")
    out = phases[0]
    for p in phases[1:]:
        out = out.unionByName(p)
    return out


@register("build_collection", f"""
select cast(id as varchar) id, {default_chain_sql('content')} document, author
from {DOCS_SQL} where content is not null and content <> ''
  and (author is null or author not in (select user_id from {_values_sql(OPT_OUT)}))""")
def q_build_collection(spark, sf):
    """M1 + M4: documents -> drop empty -> opt-out + redaction -> embed -> insert-if-absent -> count."""
    root = shared_dir(spark, "collections")
    msgs = documents_as_messages(spark, sf).withColumn("id", F.col("id").cast("string")) \
        .withColumn("timestamp", F.lit(None).cast("timestamp"))
    build_collection(msgs, root, "documents", load_id=1, optout=_users(spark, OPT_OUT))
    return open_collection(spark, root, "documents").select("id", "document", F.col("metadata.author").alias("author"))


@register("ingest_history", f"""
select channel_id, cast(min(id) as varchar) oldest_message_id, max(page) batch_count, count(*) total_messages
from {_FILTERED_PAGES_SQL} group by all""")
def q_ingest_history(spark, sf):
    """M2 + K1 + K3 + S4: date filter -> pages -> page files -> per-channel state -> state read back."""
    out, state = shared_dir(spark, "history"), shared_dir(spark, "state")
    ingest_history(events_as_messages(spark, sf), out, state, start=START, end=END, when=_STATE_TIME)
    st = load_ingest_state(spark, state)
    return st.select("channel_id", "oldest_message_id", "batch_count", "total_messages")


@register("ingest_resume", f"""
select channel_id, id, page, cast(min(id) over (partition by channel_id) as varchar) oldest_message_id,
       max(page) over (partition by channel_id) batch_count, count(*) over (partition by channel_id) total_messages
from {_FILTERED_PAGES_SQL}""")
def q_ingest_resume(spark, sf):
    """M2 + S4 + F6: a run that ends after two pages a channel, then one that goes on from its state: pages and counters
    are those of one whole run."""
    out, state = shared_dir(spark, "history"), shared_dir(spark, "state")
    for pages in (2, None):
        ingest_history(events_as_messages(spark, sf), out, state, start=START, end=END, when=_STATE_TIME, max_pages=pages)
    stored = spark.read.parquet(out).select("channel_id", "id", "page")
    return stored.join(load_ingest_state(spark, state).drop("last_updated"), "channel_id")


@register("read_opt_out", "select distinct source user_id from documents")
def q_read_opt_out(spark, sf):
    """S3: the authors written as a text registry (padded, with blank lines), read back."""
    path = shared_dir(spark, "optout")
    d = table(spark, sf, "documents").select("source").distinct()
    lines = d.select(F.concat(F.lit("  "), F.col("source"), F.lit(" \n")).alias("value"))
    lines.write.mode("overwrite").text(path)
    return read_opt_out(spark, path)



@register("encrypt_files", _BATCH_ORACLE)
def q_encrypt_files(spark, sf):
    """K5 + S8: the batch files encrypted under their own names into a table, decrypted and parsed back."""
    from parley.sources.batches import parse_batch_files
    from parley.sources.secure import decrypt_files, encrypt_files
    key = b"fedcba9876543210fedcba9876543210"
    path = _conversation_batches(spark, sf)
    enc_path = shared_dir(spark, "encrypted")
    enc = encrypt_files(spark, path, enc_path, key, glob="part-*", keep_path=True)
    files = decrypt_files(spark, enc_path, key).select(F.col("source_path").alias("path"), "content")
    raw = parse_batch_files(files)
    return normalize_saved(raw, keep=("batch", "pos")).select(*_BATCH_COLS)


@register("envelope_rotation", _BATCH_ORACLE)
def q_envelope_rotation(spark, sf):
    """X1 + K5 + S8: the batch files with a key each, wrapped by one master key, rewrapped by another, read with that alone."""
    from parley.sources.batches import parse_batch_files
    from parley.sources.secure import decrypt_envelopes, encrypt_envelopes, rotate_envelopes
    keys = {"first": b"fedcba9876543210fedcba9876543210", "second": b"0123456789abcdef0123456789abcdef"}
    out = shared_dir(spark, "envelopes")
    encrypt_envelopes(spark, _conversation_batches(spark, sf), out, keys, "first", glob="part-*")
    rotate_envelopes(spark, out, keys, "second")
    files = decrypt_envelopes(spark, out, {"second": keys["second"]}).select(F.col("source_path").alias("path"), "content")
    return normalize_saved(parse_batch_files(files), keep=("batch", "pos")).select(*_BATCH_COLS)


@register("dedup_stream", f"select cast(id as varchar) id, author, content, channel_id from {CONV_SQL}")
def q_dedup_stream(spark, sf):
    """R1 + S7: every batch file is delivered twice; a message that comes again within an hour is one row."""
    path = _conversation_batches(spark, sf)
    again = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    again.write.option("maxRecordsPerFile", 1).text(f"{path}/batch=again")  # a file holds one array
    out, ckpt = shared_dir(spark, "dedup_out"), shared_dir(spark, "dedup_ckpt")
    once = dedup_stream(_batch_stream(spark, path))
    q = (once.select("id", "author", "content", "channel_id").writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out)


@register("ingest_state_stream", f"""
select channel_id, cast(min(id) as varchar) oldest_message_id, count(distinct (batch, place // 100)) batch_count,
       count(*) total_messages
from {_PLACED} group by all""")
def q_ingest_state_stream(spark, sf):
    """K3 + S4 on a stream: per-channel state saved after every micro-batch, latest record read back."""
    path = _conversation_batches(spark, sf)
    state, ckpt = shared_dir(spark, "state_stream"), shared_dir(spark, "state_stream_ckpt")
    ingest_state_stream(_batch_stream(spark, path), state, ckpt)
    st = load_ingest_state(spark, state)
    return st.select("channel_id", "oldest_message_id", "batch_count", "total_messages")
