import random

import duckdb
import pyarrow as pa
import pytest

from helpers import SCHEMA, empty, messy, messy_rows, prose
from parley.llm.mixing import MIX, Mix, mix_sources, mixed_documents
from parley.llm.queries import _mixing_sql


def corpus():
    rng = random.Random(4)
    return [(i, prose(i, rng.randint(0, 60)), rng.choice(["en", "de", "fr"]), f"src{rng.randint(0, 9)}", 1) for i in range(300)] + messy_rows()


@pytest.mark.parametrize("mix", [MIX, Mix(budget_percent=100, max_epochs=1), Mix(budget_tokens=10 ** 9, max_epochs=3),
                                 Mix({"lang": {"en": 50, "de": 1, "fr": 0}}, budget_percent=90, slice_rows=3), Mix(budget_tokens=0)])
def test_equals_sql(spark, mix):
    rows = corpus()
    con = duckdb.connect()
    con.register("documents", pa.table(list(map(list, zip(*rows))), names=["doc_id", "text", "lang", "source", "n_chars"]))
    want = con.execute(_mixing_sql(mix)).fetchall()
    got = [tuple(r) for r in mix_sources(spark.createDataFrame(rows, SCHEMA), mix=mix).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    if mix.budget_tokens == 10 ** 9:
        assert len(got) == 3 * sum(bool((r[1] or "").strip()) for r in rows)


def test_shortage_goes_to_siblings_first(spark):
    text = " ".join(["w"] * 10)
    rows = [(i, text, "en", "short" if i < 2 else "long", 1) for i in range(40)] + [(100 + i, text, "de", "other", 1) for i in range(40)]
    from pyspark.sql import functions as F
    mix = Mix({"source": {"short": 1, "long": 1}}, budget_tokens=200, max_epochs=1)
    got = mix_sources(spark.createDataFrame(rows, SCHEMA), domain=F.lit("d"), mix=mix)
    sums = {(r.lang, r.source): r.n for r in got.groupBy("lang", "source").agg(F.sum("n_tokens").alias("n")).collect()}
    # each language gets 100; "short" has 20 of its 50, its sibling takes the other 30
    assert sums == {("en", "short"): 20, ("en", "long"): 80, ("de", "other"): 100}


def test_stage_keeps_columns_and_epochs(spark):
    df = messy(spark)
    once = mixed_documents(df, mix=Mix(budget_tokens=10 ** 9, max_epochs=1))
    assert once.columns == df.columns
    assert once.count() == sum(bool((r[1] or "").strip()) for r in messy_rows())
    assert mixed_documents(df, mix=Mix(budget_tokens=10 ** 9, max_epochs=2)).count() == 2 * once.count()
    assert mix_sources(empty(spark)).count() == 0 and mixed_documents(empty(spark)).count() == 0
