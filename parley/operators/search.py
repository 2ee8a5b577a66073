"""Exact top-k similarity search over a vector collection.

Plan, for queries Q and a collection C:

* The queries' bytes are counted. Up to ``max_query_bytes`` they go to the executors as one broadcast matrix and every
  collection partition runs ``mapInArrow``. Beyond that nothing is fetched to the driver: queries and collection are
  dealt over a grid of tiles (query block x collection chunk, both of bounded rows), cogrouped, and each tile is one call
  of the same kernel. Results do not depend on which way is taken.
* The kernel reads an Arrow batch's vectors as one flat float buffer; distances to the whole block come from one BLAS
  product, then a per-query partial top-k whose survivors' distances are computed anew from the differences, so large
  norms do not cancel. Only about ``k`` candidates a query and task leave it: no query x row pairs are
  ever materialised as rows, and there is no cross join.
* One shuffle on the query id merges the partial lists; ``row_number() <= k`` is planned with a
  WindowGroupLimit, so each query keeps ``k`` rows per reducer before the final rank.

Ordering is ``(round(distance, 6), id)`` so that ties resolve the same way on every engine. Ids are numbers or texts.
A null or empty vector cannot be compared: such a query has no results, such a collection row is never one
(:func:`vector_rejects` lists them). The cosine distance to a zero vector is 1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions.messages import truncate_display
from parley.session import cut_lineage

METRICS = ("l2", "cosine", "ip")
# half of one unit in the 6th decimal, plus slack for float error: partial lists keep every row that
# could tie with the k-th after rounding, so the final rank is exact.
_TIE_MARGIN = 1.5e-6
# float error of the expanded square, relative to the squared norms it is made of
_NORM_ERROR = 1e-12
DEFAULT_MAX_QUERY_BYTES = 64 << 20
TILE_ROWS = 20_000


def _distances(q: np.ndarray, c: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray | float]:
    """(nq x n) distances in float64 and a bound of their float error (per query)."""
    dots = q @ c.T
    if metric == "l2":  # squared Euclidean, the vector store's default
        qn, cn = np.einsum("ij,ij->i", q, q), np.einsum("ij,ij->i", c, c)
        return np.maximum(qn[:, None] + cn[None, :] - 2.0 * dots, 0.0), _NORM_ERROR * (qn + cn.max(initial=0.0))
    if metric == "cosine":
        norms = np.sqrt(np.einsum("ij,ij->i", q, q))[:, None] * np.sqrt(np.einsum("ij,ij->i", c, c))[None, :]
        return 1.0 - np.divide(dots, norms, out=np.zeros_like(dots), where=norms > 0), 0.0
    return 1.0 - dots, _NORM_ERROR * np.abs(dots).max(axis=1, initial=0.0)


def _exact(q: np.ndarray, c: np.ndarray, metric: str, d: np.ndarray) -> np.ndarray:
    """Distances of matching rows of ``q`` and ``c``; for l2 from the differences themselves."""
    if metric != "l2":
        return d
    diff = q - c
    return np.einsum("ij,ij->i", diff, diff)


def _prune(qi: np.ndarray, ids: np.ndarray, d: np.ndarray, k: int):
    """Per query, a superset of its top-k under the final order ``(round(distance, 6), id)``, of bounded size.

    Rows clearly below the k-th distance stay (fewer than k). Rows near it (within the rounding margin) are classed by
    their rounded distance; a class keeps only its k smallest ids, since any further row of the class is preceded by k
    others. A row whose rounding is ambiguous (within a hair of a .5 boundary) is kept as it is. So ties never grow the
    output past about 4k rows per query.
    """
    if len(qi) == 0:
        return qi, ids, d
    rank = np.unique(ids, return_inverse=True)[1]  # ids may be texts: compare their places
    o = np.lexsort((rank, d, qi))
    qi, ids, d, rank = qi[o], ids[o], d[o], rank[o]
    starts = np.r_[0, np.flatnonzero(np.diff(qi)) + 1]
    counts = np.diff(np.r_[starts, len(qi)])
    kth = np.full(len(starts), np.inf)
    full = counts >= k
    kth[full] = d[starts[full] + k - 1]
    kth_rows = np.repeat(kth, counts)
    keep = d <= kth_rows + _TIE_MARGIN
    band = keep & np.isfinite(kth_rows) & (d >= kth_rows - _TIE_MARGIN)
    if band.any():
        scaled = d * 1e6 + 0.5
        lo, hi = np.floor(scaled - 1e-6), np.floor(scaled + 1e-6)
        sure = np.flatnonzero(band & (lo == hi))
        if len(sure):
            o2 = sure[np.lexsort((rank[sure], lo[sure], qi[sure]))]
            new = np.r_[True, (qi[o2][1:] != qi[o2][:-1]) | (lo[o2][1:] != lo[o2][:-1])]
            first = np.maximum.accumulate(np.where(new, np.arange(len(o2)), 0))
            keep[o2[(np.arange(len(o2)) - first) >= k]] = False
    inf = np.flatnonzero(keep & np.isinf(d))  # undefined distances (NaN in a vector): one class, in id order
    if len(inf):
        new = np.r_[True, qi[inf][1:] != qi[inf][:-1]]
        first = np.maximum.accumulate(np.where(new, np.arange(len(inf)), 0))
        keep[inf[(np.arange(len(inf)) - first) >= k]] = False
    return qi[keep], ids[keep], d[keep]


def _matrix(ids: pa.Array, vecs: pa.Array):
    """(ids, n x dim float64 matrix) of Arrow columns, straight from the list buffer (no per-row Python objects).
    Rows with a null or empty vector or a null id are skipped; all vectors must share one length."""
    lens = pc.list_value_length(vecs)
    ok = pc.and_(pc.and_(pc.is_valid(vecs), pc.is_valid(ids)), pc.greater(pc.fill_null(lens, 0), 0))
    if not pc.all(ok).as_py():
        vecs, ids, lens = vecs.filter(ok), ids.filter(ok), lens.filter(ok)
    n = len(vecs)
    if n == 0:
        return None, None
    dim = lens[0].as_py()
    if pc.any(pc.not_equal(lens, dim)).as_py():
        raise ValueError("vectors of one collection must have one length")
    flat = pc.list_flatten(vecs).to_numpy(zero_copy_only=False).astype(np.float64)
    return ids.to_numpy(zero_copy_only=False), flat.reshape(n, dim)


class _TopK:
    """Candidate lists of one task for every query of a block."""

    def __init__(self, qids: np.ndarray, q: np.ndarray, k: int, metric: str, chunk: int = 512):
        self.qids, self.q, self.k, self.metric, self.chunk = qids, q, k, metric, chunk
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.pending = 0

    def add(self, ids: np.ndarray, c: np.ndarray) -> None:
        for s in range(0, len(self.q), self.chunk):
            q = self.q[s:s + self.chunk]
            d, error = _distances(q, c, self.metric)
            d = np.where(np.isnan(d), np.inf, d)
            if d.shape[1] > self.k:
                kth = np.partition(d, self.k - 1, axis=1)[:, self.k - 1]
                rows, cols = np.nonzero(d <= (kth + 2 * error + _TIE_MARGIN)[:, None])
            else:
                rows, cols = np.nonzero(np.ones_like(d, dtype=bool))
            exact = _exact(q[rows], c[cols], self.metric, d[rows, cols])
            exact = np.where(np.isnan(exact), np.inf, exact)
            part = _prune(rows.astype(np.int64) + s, ids[cols], exact, self.k)
            self.found.append(part)
            self.pending += len(part[0])
        if self.pending > 8 * self.k * len(self.q):
            self.found = [self.merged()]
            self.pending = len(self.found[0][0])

    def merged(self):
        return _prune(*(np.concatenate(x) for x in zip(*self.found)), self.k)

    def table(self, qid_type: pa.DataType, id_type: pa.DataType) -> pa.Table:
        schema = pa.schema([("qid", qid_type), ("id", id_type), ("distance", pa.float64())])
        if not self.found:
            return schema.empty_table()
        qi, ids, d = self.merged()
        return pa.table([pa.array(self.qids[qi], qid_type), pa.array(ids, id_type), pa.array(d)], schema=schema)


def vector_rejects(df: DataFrame, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """The rows a search leaves out: no id, or a null or empty vector."""
    return df.filter(F.col(id_col).isNull() | F.col(vec_col).isNull() | (F.size(vec_col) <= 0))


def _broadcast_candidates(coll: DataFrame, q: DataFrame, k: int, metric: str, schema: str) -> DataFrame:
    rows = q.toArrow()  # counted before: within the byte bound
    qids, matrix = _matrix(rows.column("qid").combine_chunks(), rows.column("v").combine_chunks())
    qid_type = rows.schema.field("qid").type
    block = coll.sparkSession.sparkContext.broadcast((qids, matrix))

    def run(batches):
        top, id_type = None, None
        for b in batches:
            ids, c = _matrix(b.column(0), b.column(1))
            if ids is not None and block.value[0] is not None:
                top, id_type = top or _TopK(*block.value, k, metric), b.schema.field(0).type
                top.add(ids, c)
        if top:
            yield from top.table(qid_type, id_type).to_batches()

    return coll.mapInArrow(run, schema)


def _tiled_candidates(coll: DataFrame, q: DataFrame, k: int, metric: str, schema: str, tile_rows: int) -> DataFrame:
    """Every query block meets every collection chunk once, in a tile of its own."""
    blocks, chunks = 1 + q.count() // tile_rows, 1 + coll.count() // tile_rows
    left = q.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks))).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    right = coll.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks))).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        qids, matrix = _matrix(a["qid"].combine_chunks(), a["v"].combine_chunks())
        ids, c = _matrix(b["id"].combine_chunks(), b["v"].combine_chunks())
        top = _TopK(qids, matrix, k, metric)
        if qids is not None and ids is not None:
            top.add(ids, c)
        return top.table(a.schema.field("qid").type, b.schema.field("id").type)

    return left.groupBy("block", F.col("chunk").cast("int").alias("chunk")).cogroup(
        right.groupBy(F.col("block").cast("bigint").alias("block"), F.col("chunk").cast("int").alias("chunk"))).applyInArrow(run, schema)


def search_batch(collection: DataFrame, queries: DataFrame, k: int = 5, metric: str = "l2", *,
                 id_col: str = "id", vec_col: str = "embedding", qid_col: str = "qid",
                 qvec_col: str = "embedding", max_query_bytes: int = DEFAULT_MAX_QUERY_BYTES,
                 tile_rows: int = TILE_ROWS) -> DataFrame:
    """Top-k nearest collection rows for every query: ``qid, rank, id, distance, similarity``.

    ``similarity = 1 - distance`` whatever the metric (reference behaviour). Two queries with one id are one query
    whose results are merged.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    if k <= 0:
        raise ValueError("k must be positive")
    coll = collection.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    q = queries.select(F.col(qid_col).alias("qid"), F.col(qvec_col).alias("v"))
    schema = (f"qid {q.schema['qid'].dataType.simpleString()}, id {coll.schema['id'].dataType.simpleString()}, "
              "distance double")
    # computed once (queries are often embedded on the fly): their bytes are counted, then they are used
    q = cut_lineage(q.filter(F.col("qid").isNotNull() & (F.size("v") > 0)))
    size = q.agg(F.sum(F.size("v").cast("bigint") * 8 + 16)).first()[0] or 0
    if size <= max_query_bytes:
        cand = _broadcast_candidates(coll, q, k, metric, schema)
    else:
        cand = _tiled_candidates(coll, q, k, metric, schema, tile_rows)
    d6 = F.round("distance", 6)
    w = Window.partitionBy("qid").orderBy(d6, F.col("id"))
    ranked = cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select("qid", "rank", "id", (d6 + F.lit(0.0)).alias("distance"),
                         (F.round(1 - F.col("distance"), 6) + F.lit(0.0)).alias("similarity"))


def search_topk(collection: DataFrame, query, k: int = 5, metric: str = "l2", *, documents: DataFrame | None = None,
                include: tuple[str, ...] = ("documents", "metadatas", "distances"), doc_id_col: str = "id",
                document_col: str = "document", metadata_cols: tuple[str, ...] = (), **kw) -> DataFrame:
    """Single-query form (T1). ``query`` is a list of floats or a one-row DataFrame with ``qid, embedding``. With
    ``documents`` the results carry what ``include`` names (N10)."""
    spark = collection.sparkSession
    if not isinstance(query, DataFrame):
        query = spark.createDataFrame([(0, [float(x) for x in query])], "qid long, embedding array<double>")
    res = search_batch(collection, query, k, metric, **kw)
    if documents is None:
        return res if "distances" in include else res.drop("distance", "similarity")
    return hydrate(res, documents, include=include, doc_id_col=doc_id_col, document_col=document_col,
                   metadata_cols=metadata_cols)


def hydrate(results: DataFrame, documents: DataFrame, *, id_col: str = "id", doc_id_col: str = "id",
            include: tuple[str, ...] = ("documents", "metadatas", "distances"),
            document_col: str = "document", metadata_cols: tuple[str, ...] = ()) -> DataFrame:
    """J5 + N10: attach document text / metadata to the top-k rows; ``include`` prunes columns.

    A hit without a document stays, with nulls; of several documents with one id the first in the order of the wanted columns
    is taken, so a query never gets more than its k rows. The top-k side (``queries x k`` rows) is written once through a reliable
    checkpoint; adaptive execution reduces the documents to the hits by a semi join of its measured size first.
    """
    keep = [F.col(c) for c in ("qid", "rank", id_col)]
    if "distances" in include:
        keep += [F.col("distance"), F.col("similarity")]
    r = cut_lineage(results.select(*keep))
    cols = [F.col(doc_id_col).alias("_doc_key")]
    if "documents" in include:
        cols.append(F.col(document_col).alias("document"))
    if "metadatas" in include:
        cols += [F.col(c) for c in metadata_cols]
    hits = r.select(F.col(id_col).alias("_doc_key")).distinct()
    docs = documents.select(*cols).join(hits, "_doc_key", "left_semi")
    if any(isinstance(f.dataType, (T.MapType, T.VariantType)) for f in docs.schema):
        docs = docs.dropDuplicates(["_doc_key"])  # no order among maps
    else:
        rest = [c for c in docs.columns if c != "_doc_key"]
        docs = docs.groupBy("_doc_key").agg(F.min(F.struct(*rest)).alias("_d")).select("_doc_key", "_d.*") if rest else docs.distinct()
    return r.join(docs, r[id_col] == docs["_doc_key"], "left").drop("_doc_key")


def format_results(df: DataFrame, metadata_cols: tuple[str, ...] = ()) -> DataFrame:
    """``content, metadata, similarity`` per result row."""
    meta = F.struct(*[F.col(c) for c in metadata_cols]) if metadata_cols else F.lit(None)
    return df.select("qid", "rank", F.col("document").alias("content"), meta.alias("metadata"), "similarity")


def display_results(df: DataFrame, content_col: str = "content") -> DataFrame:
    """Content longer than 100 characters -> first 97 + '...'; similarity with 2 decimals; author and time of the
    metadata, 'unknown' where there is none."""
    out = df.withColumn(content_col, truncate_display(content_col)).withColumn(
        "similarity", F.format_string("%.2f", F.round("similarity", 2)))
    if "metadata" in df.columns:
        fields = df.schema["metadata"].dataType.names if isinstance(df.schema["metadata"].dataType, T.StructType) else []
        for name in ("author", "timestamp"):
            value = F.col(f"metadata.{name}").cast("string") if name in fields else F.lit(None).cast("string")
            out = out.withColumn(name, F.coalesce(value, F.lit("unknown")))
        out = out.drop("metadata")
    return out


def vector_distance(a: Column, b: Column, metric: str = "l2") -> Column:
    """V2 as a native column expression, for row-level use on small inputs (e.g. checks)."""
    da = F.transform(a, lambda x: x.cast("double"))
    db = F.transform(b, lambda x: x.cast("double"))
    dot = F.aggregate(F.zip_with(da, db, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    if metric == "l2":
        return F.aggregate(F.zip_with(da, db, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    if metric == "cosine":
        na = F.sqrt(F.aggregate(da, F.lit(0.0), lambda s, x: s + x * x))
        nb = F.sqrt(F.aggregate(db, F.lit(0.0), lambda s, x: s + x * x))
        return F.when(na * nb > 0, 1 - F.try_divide(dot, na * nb)).otherwise(F.lit(1.0))
    return 1 - dot
