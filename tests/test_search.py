"""Top-k search against numpy brute force; blocks, ties, small collections, hydration."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.operators.search import hydrate, search_batch, search_topk, vector_distance, vector_rejects
from parley.plans.tables import table
from conftest import SF_SMALL


def _brute(coll, qs, k, metric):
    out = []
    for qid, q in qs:
        d = []
        for i, c in coll:
            q64, c64 = np.asarray(q, float), np.asarray(c, float)
            if metric == "l2":
                v = float(((c64 - q64) ** 2).sum())
            elif metric == "cosine":
                v = 1 - float(q64 @ c64) / (np.linalg.norm(q64) * np.linalg.norm(c64))
            else:
                v = 1 - float(q64 @ c64)
            d.append((round(v, 6), i))
        d.sort()
        out += [(qid, r + 1, i) for r, (_, i) in enumerate(d[:k])]
    return sorted(out)


@pytest.mark.parametrize("metric", ["l2", "cosine", "ip"])
def test_matches_brute_force(spark, metric):
    e = table(spark, SF_SMALL, "embeddings")
    rows = [(r.vec_id, list(r.embedding)) for r in e.collect()]
    qs = rows[:7]
    got = search_batch(e.select(F.col("vec_id").alias("id"), "embedding"),
                       e.filter("vec_id < 7").select(F.col("vec_id").alias("qid"), "embedding"), 4, metric)
    assert sorted((r.qid, r.rank, r.id) for r in got.collect()) == _brute(rows, qs, 4, metric)


def test_multi_block_path(spark):
    e = table(spark, SF_SMALL, "embeddings")
    coll = e.select(F.col("vec_id").alias("id"), "embedding")
    qs = e.select(F.col("vec_id").alias("qid"), "embedding")
    one = sorted(tuple(r) for r in search_batch(coll, qs, 3).collect())
    many = sorted(tuple(r) for r in search_batch(coll, qs, 3, max_query_bytes=272 * 40).collect())
    assert one == many


def test_k_larger_than_collection_and_similarity(spark):
    coll = spark.createDataFrame([(1, [2.0, -1.0, 0.0]), (2, [2.5, -1.0, 0.5]), (3, [0.0, 3.0, 1.0])],
                                 "id long, embedding array<float>")
    res = search_topk(coll, [2.0, -1.0, 0.25], k=10).orderBy("rank").collect()
    assert [r.id for r in res] == [1, 2, 3]
    assert all(abs(r.similarity - (1 - r.distance)) < 1e-6 for r in res)


def test_ties_resolved_by_id(spark):
    v = [1.0, 0.0]
    coll = spark.createDataFrame([(i, v) for i in (5, 3, 9, 1)], "id long, embedding array<float>")
    res = search_topk(coll, v, k=2).orderBy("rank").collect()
    assert [r.id for r in res] == [1, 3]


def test_hydrate_include(spark):
    coll = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, embedding array<float>")
    docs = spark.createDataFrame([(1, "one", "a"), (2, "two", "b")], "id long, document string, author string")
    res = search_topk(coll, [1.0, 0.0], k=1)
    full = hydrate(res, docs, metadata_cols=("author",)).first()
    assert (full.document, full.author, full.similarity) == ("one", "a", 1.0)
    slim = hydrate(res, docs, include=("documents",))
    assert "distance" not in slim.columns and "author" not in slim.columns


def test_many_exact_ties_stay_bounded_and_exact(spark):
    import numpy as np
    from parley.operators.search import _prune
    rng = np.random.default_rng(7)
    rows = [(i, [1.0, 0.0]) for i in range(3000)]  # 3,000 identical vectors
    rows += [(3000 + i, [float(x), float(y)]) for i, (x, y) in enumerate(rng.normal(size=(500, 2)))]
    coll = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(4)
    res = search_topk(coll, [1.0, 0.0], k=5).orderBy("rank").collect()
    assert [r.id for r in res] == [0, 1, 2, 3, 4]
    qi = np.zeros(3000, dtype=np.int64)
    kept = _prune(qi, np.arange(3000, dtype=np.int64)[::-1].copy(), np.zeros(3000), 5)
    assert sorted(kept[1].tolist()) == [0, 1, 2, 3, 4]


def test_zero_vectors_under_cosine_stay_bounded(spark):
    import numpy as np
    from parley.operators.search import _prune
    d = np.r_[np.full(1000, np.inf), [0.5, 0.25]]
    kept = _prune(np.zeros(1002, dtype=np.int64), np.arange(1002, dtype=np.int64), d, 3)
    assert len(kept[0]) <= 5 and {1000, 1001} <= set(kept[1].tolist())


def test_multi_block_with_embedded_collection(spark):
    from parley.operators.embed import embed_hashing
    from parley.plans.tables import documents_as_messages
    d = documents_as_messages(spark, SF_SMALL).filter("id < 60")  # a small test fixture
    coll = embed_hashing(d, "content").select("id", "embedding")
    qs = embed_hashing(d.select(F.col("id").alias("qid"), "content"), "content").select("qid", "embedding")
    one = sorted(tuple(r) for r in search_batch(coll, qs, 2).collect())
    many = sorted(tuple(r) for r in search_batch(coll, qs, 2, max_query_bytes=272 * 10).collect())
    assert one == many


def _nearest(coll, queries, k):
    out = []
    for q, v in queries:
        d = sorted((round(sum((a - b) ** 2 for a, b in zip(v, w)), 6), i) for i, w in coll)[:k]
        out += [(q, r + 1, i, x) for r, (x, i) in enumerate(d)]
    return sorted(out)


def test_large_norms_text_ids_and_tiles(spark):
    import random
    rng = random.Random(3)
    coll = [(f"id{i}", [8e5 + rng.randint(0, 40) / 1024 for _ in range(3)]) for i in range(300)]
    queries = [(f"q{i}", [8e5 + rng.randint(0, 40) / 1024 for _ in range(3)]) for i in range(40)]
    c = spark.createDataFrame(coll, "id string, embedding array<double>")
    q = spark.createDataFrame(queries, "qid string, embedding array<double>")
    want = _nearest(coll, queries, 4)
    for how in ({}, {"max_query_bytes": 10, "tile_rows": 70}):
        got = sorted((r.qid, r["rank"], r.id, round(r.distance, 6)) for r in search_batch(c, q, 4, **how).collect())
        assert got == want


def test_null_vectors_and_zero_vectors(spark):
    coll = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, []), (None, [1.0, 0.0]), (5, [0.0, 0.0])],
                                 "id long, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "qid long, embedding array<float>")
    got = search_batch(coll, q, 9, "cosine").collect()
    assert sorted((r.qid, r.id, r.distance) for r in got) == [(1, 1, 0.0), (1, 5, 1.0)]
    assert vector_rejects(coll).count() == 3
    pair = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0])], "a array<float>, b array<float>")
    assert pair.select(vector_distance(F.col("a"), F.col("b"), "cosine")).first()[0] == 1.0


def test_a_document_id_that_occurs_twice_does_not_multiply_hits(spark):
    from parley.operators.search import hydrate
    res = spark.createDataFrame([(0, 1, "a", 0.1, 0.9), (0, 2, "b", 0.2, 0.8), (0, 3, "c", 0.3, 0.7)],
                                "qid int, rank int, id string, distance double, similarity double")
    docs = spark.createDataFrame([("a", "z"), ("a", "y"), ("b", "x"), ("b", "x")], "id string, document string")
    got = hydrate(res, docs).orderBy("rank").collect()
    assert [(r.id, r.document) for r in got] == [("a", "y"), ("b", "x"), ("c", None)]
    assert hydrate(res, docs, include=("distances",)).count() == 3


def test_a_null_text_has_no_vector_in_either_encoder(spark):
    from parley.operators.embed import FirstCharsEncoder, embed, embed_hashing
    df = spark.createDataFrame([(1, None), (2, "ab"), (3, ""), (4, None)], "i int, content string")
    for out in (embed(df, FirstCharsEncoder, batch=1), embed_hashing(df)):
        assert {r.i: r.embedding is None for r in out.collect()} == {1: True, 2: False, 3: False, 4: True}
