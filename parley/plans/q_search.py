"""Queries: vector search."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators.embed import embed_hashing
from parley.operators.privacy import apply_privacy, drop_empty_content
from parley.operators.search import display_results, format_results, hydrate, search_batch, search_topk
from parley.plans.jobs import build_collection, search_text
from parley.plans.oracle_sql import default_chain_sql
from parley.plans.registry import register
from parley.plans.tables import documents_as_messages, table
from parley.session import shared_dir
from parley.sources.collection import open_collection

K = 5
QUERY_VEC_ID = 0

_DIST_SQL = {
    "l2": "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: pow(p[1]::double - p[2]::double, 2)))",
    "cosine": ("1 - list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: p[1]::double * p[2]::double))"
               " / (sqrt(list_sum(list_transform(e.embedding, lambda x: x::double * x::double)))"
               " * sqrt(list_sum(list_transform(q.embedding, lambda x: x::double * x::double))))"),
    "ip": "1 - list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: p[1]::double * p[2]::double))",
}


def _topk_sql(metric: str, query_filter: str = "") -> str:
    return f"""
with d as (select q.vec_id qid, e.vec_id id, {_DIST_SQL[metric]} d
           from embeddings e, (select * from embeddings {query_filter}) q),
r as (select *, row_number() over (partition by qid order by round(d, 6), id) rk from d)
select qid, cast(rk as integer) rank, id, round(d, 6) + 0.0 distance, round(1 - d, 6) + 0.0 similarity
from r where rk <= {K}"""


def _collection(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def _queries_one(spark, sf):
    return table(spark, sf, "embeddings").filter(F.col("vec_id") == QUERY_VEC_ID) \
        .select(F.col("vec_id").alias("qid"), "embedding")


def _query_set(spark, sf):
    """The stated query set of the batch searches: every vector whose id is divisible by 20, against all vectors."""
    return table(spark, sf, "embeddings").filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("qid"), "embedding")


_QUERY_SET_SQL = "where vec_id % 20 = 0"


for _m in ("l2", "cosine", "ip"):
    def _mk(metric):
        def q(spark, sf):
            return search_topk(_collection(spark, sf), _queries_one(spark, sf), K, metric)
        return q

    register(f"search_topk_{_m}", _topk_sql(_m, f"where vec_id = {QUERY_VEC_ID}"))(_mk(_m))


@register("search_batch", _topk_sql("l2", _QUERY_SET_SQL))
def q_search_batch(spark, sf):
    """The query set against every collection vector; top-5 neighbours each."""
    return search_batch(_collection(spark, sf), _query_set(spark, sf), K, "l2")


_HYDRATE_SQL = f"""
with t as ({_topk_sql('l2', _QUERY_SET_SQL)})
select t.qid, t.rank, t.id, d.text document, t.distance, t.similarity
from t left join documents d on d.doc_id = t.id"""


@register("search_documents", _HYDRATE_SQL)
def q_search_documents(spark, sf):
    """J5 + N10: top-k rows hydrated with their document text."""
    res = search_batch(_collection(spark, sf), _query_set(spark, sf), K, "l2")
    docs = table(spark, sf, "documents")
    out = hydrate(res, docs, doc_id_col="doc_id", document_col="text", include=("documents", "distances"))
    return out.select("qid", "rank", "id", "document", "distance", "similarity")


@register("display_results", f"""
with h as ({_HYDRATE_SQL})
select h.qid, h.rank, h.id,
       case when length(document) > 100 then substring(document, 1, 97) || '...' else document end content,
       printf('%.2f', round(similarity, 2)) similarity, coalesce(d.source, 'unknown') author, 'unknown' as "timestamp"
from h left join documents d on d.doc_id = h.id""")
def q_display_results(spark, sf):
    """The CLI table projection of search results, with author and time."""
    res = search_batch(_collection(spark, sf), _query_set(spark, sf), K, "l2")
    docs = table(spark, sf, "documents").withColumn("metadata", F.struct(
        F.col("source").alias("author"), F.lit(None).cast("string").alias("timestamp")))
    h = hydrate(res, docs, doc_id_col="doc_id", document_col="text", metadata_cols=("metadata",))
    return display_results(h.select("qid", "rank", "id", F.col("document").alias("content"), "metadata", "similarity"))


def _hash_vectors_sql(src: str, key: str, text: str) -> str:
    """DuckDB feature hashing into 64 MD5 buckets, L2-normalised, as a dense float list."""
    return f"""
(with tok as (select {key} key, unnest(regexp_split_to_array(lower({text}), '[^a-z]+')) w from {src}),
 cnt as (select key, (('0x' || substring(md5(w), 1, 6))::bigint % 64)::int k, count(*) n
         from tok where w <> '' group by all),
 nrm as (select key, sqrt(sum(n::double * n)) nr from cnt group by key),
 keys as (select distinct {key} key from {src}),
 grid as (select keys.key, g.k from keys, (select range::int k from range(64)) g)
 select grid.key, list(coalesce((c.n / nrm.nr)::float, 0::float) order by grid.k) embedding
 from grid left join cnt c on c.key = grid.key and c.k = grid.k left join nrm on nrm.key = grid.key
 group by grid.key)"""


_SEARCH_TEXT_SQL = f"""
with red as (select doc_id, {default_chain_sql('text')} t from documents where text is not null and text <> ''),
e as {_hash_vectors_sql('red', 'doc_id', 't')},
q as {_hash_vectors_sql('benchmark', 'item_id', 'text')},
d as (select q.key qid, e.key id, {_DIST_SQL['l2']} d from e, q),
r as (select *, row_number() over (partition by qid order by round(d, 6), id) rk from d)
select qid, cast(rk as integer) rank, id, round(d, 6) + 0.0 distance, round(1 - d, 6) + 0.0 similarity
from r where rk <= {K}"""


def search_text_plan(spark, sf):
    """M1 + M3 without the write: documents -> drop empty -> redact -> embed -> search with the
    benchmark texts embedded the same way."""
    msgs = drop_empty_content(documents_as_messages(spark, sf))
    coll = embed_hashing(apply_privacy(msgs), "content").select("id", "embedding")
    qs = embed_hashing(table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text"), "text")
    return search_batch(coll, qs.select("qid", "embedding"), K, "l2")


register("search_text", _SEARCH_TEXT_SQL)(search_text_plan)


@register("search_text_stored", f"""
with red as (select doc_id, source, {default_chain_sql('text')} t from documents where text is not null and text <> ''),
e as {_hash_vectors_sql('red', 'doc_id', 't')},
q as {_hash_vectors_sql('benchmark', 'item_id', 'text')},
d as (select q.key qid, e.key::varchar id, {_DIST_SQL['l2']} d from e, q),
r as (select *, row_number() over (partition by qid order by round(d, 6), id) rk from d)
select qid, cast(rk as integer) rank, id, red.t document, red.source author, round(d, 6) + 0.0 distance
from r join red on red.doc_id::varchar = id where rk <= {K}""")
def q_search_text_stored(spark, sf):
    """M1 then M3: documents loaded into a stored collection (ids are text), searched by the benchmark texts."""
    root = shared_dir(spark, "collections")
    msgs = documents_as_messages(spark, sf).withColumn("id", F.col("id").cast("string"))
    build_collection(msgs, root, "documents", load_id=1)
    texts = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")
    out = search_text(open_collection(spark, root, "documents"), texts, K)
    return out.select("qid", "rank", "id", "document", F.col("metadata.author").alias("author"), "distance")


@register("collection_count", "select count(*) n from documents where text is not null and text <> ''")
def q_collection_count(spark, sf):
    """A1: the number of stored vectors after a load."""
    root = shared_dir(spark, "collections")
    msgs = documents_as_messages(spark, sf).withColumn("id", F.col("id").cast("string"))
    n = build_collection(msgs, root, "documents", load_id=1)
    return spark.createDataFrame([(n,)], "n bigint")


@register("format_results", f"""
with t as ({_topk_sql('l2', _QUERY_SET_SQL)})
select t.qid, t.rank, d.text content, e.label metadata_label, t.similarity
from t left join (documents d join embeddings e on e.vec_id = d.doc_id) on d.doc_id = t.id""")
def q_format_results(spark, sf):
    """``content, metadata, similarity`` per result, metadata carried from the collection."""
    res = search_batch(_collection(spark, sf), _query_set(spark, sf), K, "l2")
    docs = table(spark, sf, "documents").join(
        table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "label"), "doc_id")
    h = hydrate(res, docs, doc_id_col="doc_id", document_col="text", metadata_cols=("label",))
    out = format_results(h, metadata_cols=("label",))
    return out.select("qid", "rank", "content", F.col("metadata.label").alias("metadata_label"), "similarity")
