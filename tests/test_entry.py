"""Driver contract: entry runs; every query has an oracle; oracles agree on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

FAST = ["search_topk_l2", "search_batch", "redact_pii", "apply_privacy", "history_pages", "history_pages_reference",
        "running_totals", "stalls", "breaker_gate", "embed_hashing", "parse_chat_log", "normalize_api",
        "audit_pii", "search_text", "load_progress", "chunk_rows"]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["qid", "rank", "id", "distance", "similarity"]
    assert df.count() > 0


def test_every_query_has_an_oracle():
    assert set(E.catalog.QUERIES) == set(E.catalog.ORACLES)
    assert set(E.oracle_sql()) <= set(E.queries())


SKEW_PATH = ["history_pages", "history_pages_reference", "running_totals", "resume_filter", "stalls",
             "breaker_replay", "breaker_gate", "breaker_suppress", "chunk_rows", "ingest_totals"]


@pytest.mark.parametrize("name", FAST)
def test_oracle_agrees(spark, name):
    _check(spark, name)


@pytest.mark.parametrize("name", SKEW_PATH)
def test_oracle_agrees_with_keys_split(spark, tiny_groups, name):
    """Every key above 37 rows is cut into slices: the result must not change."""
    _check(spark, name)


def _check(spark, name):
    con = duckdb.connect()
    for t in ("events", "documents", "embeddings", "conversations", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF_SMALL}/{t}.parquet'")
    df = E.queries()[name](spark, SF_SMALL)
    cols = sorted(df.columns)
    rel = con.sql(E.oracle_sql()[name])
    assert sorted(rel.columns) == cols

    def canon(rows, names):
        idx = [names.index(c) for c in cols]
        return sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in idx) for r in rows),
                      key=repr)

    assert canon([tuple(r) for r in df.collect()], df.columns) == canon(rel.fetchall(), rel.columns)
