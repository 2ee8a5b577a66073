"""Composed jobs: load a collection (M1, M4), ingest history (M2), search by text."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from parley.functions.messages import message_metadata
from parley.operators import history as H
from parley.operators.embed import embed_hashing
from parley.operators.privacy import apply_privacy, drop_empty_content
from parley.operators.search import hydrate, search_batch
from parley.operators.normalize import normalize_with_rejects
from parley.session import cut_lineage
from parley.sources.batches import BATCH_GLOB, read_message_batches, write_message_batches
from parley.sources.collection import collection_add, collection_count
from parley.sources.registry import is_missing, load_ingest_state, save_ingest_state, state_from_totals


def prepare_collection_rows(messages: DataFrame, *, optout: DataFrame | None = None, redact: bool = True,
                            patterns=None, added=(), embedder=None) -> DataFrame:
    """M1 + M4 up to the sink: drop empty -> privacy (before embedding, so vectors carry no PII) ->
    metadata -> embedding. ``embedder(df) -> df`` adds ``embedding``; default: feature hashing."""
    msgs = drop_empty_content(messages)
    msgs = apply_privacy(msgs, optout, redact=redact, patterns=patterns, added=added)
    for c, t in (("attachments", "array<string>"), ("reactions", "array<string>"), ("mentions", "array<string>")):
        if c not in msgs.columns:
            msgs = msgs.withColumn(c, F.array().cast(t))
    if "timestamp" not in msgs.columns:
        msgs = msgs.withColumn("timestamp", F.lit(None).cast("timestamp"))
    md = message_metadata("author", "timestamp", "channel_id", "attachments", "reactions", "mentions")
    rows = msgs.select(F.col("id").cast("string").alias("id"), F.col("content").alias("document"), md.alias("metadata"))
    embedded = (embedder or (lambda d: embed_hashing(d, "document")))(rows)
    return embedded.select("id", "embedding", "document", "metadata")


def build_collection(messages: DataFrame, root: str, name: str, load_id: int, *, retry: bool = False, **kw) -> int:
    """M1: ... -> insert-if-absent into the collection; returns the collection size (A1). Of messages with one id the
    first by document text is taken; ``retry`` allows a load of this number to be made again."""
    rows = prepare_collection_rows(messages, **kw)
    collection_add(rows, root, name, load_id, retry=retry)
    return collection_count(messages.sparkSession, root, name)


def ingest_history(messages: DataFrame, out: str, state_path: str, *, start=None, end=None, size: int = H.PAGE_SIZE,
                   when: dt.datetime | None = None, max_pages: int | None = None) -> DataFrame:
    """M2: date filter -> resume -> pages (newest first) -> page files -> per-channel state.

    A run goes on where the saved state ends: only messages older than a channel's cursor, pages numbered on, files
    added. ``max_pages`` ends a run after so many pages a channel. What an earlier run has stored (its ids) is not
    stored again even if its state was lost, and the state is that of all that is stored.
    """
    spark = messages.sparkSession
    todo = H.resume_filter(H.filter_date_range(messages, start, end), load_ingest_state(spark, state_path))
    stored = _stored_pages(spark, out)
    if stored is not None:
        done = stored.select(F.col("channel_id").alias("_ch"), F.col("id").cast("string").alias("_id"))
        todo = todo.join(done, F.col("channel_id").eqNullSafe(F.col("_ch")) & (F.col("id").cast("string") == F.col("_id")),
                         "left_anti")
    paged = H.history_pages(todo, size)
    if max_pages is not None:
        paged = paged.filter(F.col("page") <= max_pages)
    if stored is not None:
        last = stored.groupBy(F.col("channel_id").alias("_ch")).agg(F.max("page").alias("_last"))
        paged = paged.join(last, F.col("channel_id").eqNullSafe(F.col("_ch")), "left").withColumn(
            "page", F.col("page") + F.coalesce("_last", F.lit(0))).drop("_ch", "_last")
        paged = cut_lineage(paged)  # the write below adds to the files this plan reads
    write_message_batches(paged, out, mode="append")
    everything = _stored_pages(spark, out)
    state = state_from_totals(H.ingest_totals(everything), H.resume_cursor(everything), when)
    save_ingest_state(state, state_path)
    return state


def _stored_pages(spark, out: str) -> DataFrame | None:
    try:
        return spark.read.option("partitionColumnTypeInference", "false").parquet(out)
    except AnalysisException as e:
        if not is_missing(e):
            raise
        return None


def search_text(collection: DataFrame, texts: DataFrame, k: int = 5, *, metric: str = "l2", embedder=None,
                qid_col: str = "qid", text_col: str = "text", include=("documents", "metadatas", "distances")) -> DataFrame:
    """Embed query texts the same way as the collection, search, hydrate (N8 shape). Ids stay as they are."""
    q = (embedder or (lambda d: embed_hashing(d, text_col)))(texts.select(F.col(qid_col).alias("qid"), text_col))
    res = search_batch(collection.select("id", "embedding"), q.select("qid", "embedding"), k, metric)
    return hydrate(res, collection.select("id", "document", "metadata"), doc_id_col="id", metadata_cols=("metadata",),
                   include=include)


def compact_message_batches(spark, in_dir: str, out: str, rejects: str | None = None, *,
                            glob: str = BATCH_GLOB) -> DataFrame:
    """SURVEY §4 small files: read the many small batch files once, normalise, and write one columnar
    table partitioned by channel (rejected rows to ``rejects``); later jobs work from the table."""
    raw = read_message_batches(spark, in_dir, glob)
    good, bad = normalize_with_rejects(raw, keep=("file", "batch", "pos"))
    good.write.mode("overwrite").partitionBy("channel_id").parquet(out)
    if rejects:
        bad.write.mode("overwrite").parquet(rejects)
    return spark.read.parquet(out)
