"""Spelling variants against all edits of every word, with one filter a round and with many shards and rounds."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import empty, messy
from parley.llm import spelling
from parley.llm.common import written

LETTERS = [chr(c) for c in [*range(97, 123), *range(0xC0, 0x100)]]
LOWER = {c: c + 32 for c in range(65, 91)}


def brute_force(rows, min_count=3):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= min_count}
    near = {}
    for w in n:
        made = {w[:i] + w[i + 1:] for i in range(len(w))}
        made |= {w[:i] + c + w[i + 1:] for i in range(len(w)) for c in LETTERS}
        made |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in LETTERS}
        near[w] = [x for x in made if x in n and x != w]
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        if best and n[best] >= 2 * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, n[w], len(near[w]), form.get(w), n[form[w]] if w in form else None, root(w)) for w in n)


def varied(n_docs=60, seed=5):
    rng = random.Random(seed)
    words = ["straße", "Über", "zürich", "banana", "bananas", "cabbage", "naïvely", "ÿÀ×÷ñó", "ççççççç", "aaaaaa", "aaaaaaa"]

    def typo(w):
        i = rng.randrange(len(w))
        return rng.choice([w, w, w[:i] + w[i + 1:], w[:i] + rng.choice("aüz") + w[i + 1:], w[:i] + rng.choice("éb") + w[i:]])

    return [(k, " ".join(typo(typo(rng.choice(words))) for _ in range(120)) + f"\n{'w' * 90} {'w' * 89}v {'w' * 70}, x")
            for k in range(n_docs)]


def result(df):
    return sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect())


@pytest.mark.parametrize("how", [{}, {"shard_bytes": 48, "round_bytes": 200}])
def test_equals_all_edits_of_every_word(spark, how):
    rows = varied()
    got = result(spelling.spelling_variants(spark.createDataFrame(rows, "doc_id bigint, text string"), **how))
    assert got == brute_force(rows)
    assert any(r[3] for r in got) and any(r[5] not in (r[0], r[3]) for r in got)


def test_awkward_rows(spark):
    docs = messy(spark)
    docs = docs.unionByName(docs).unionByName(docs)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert result(spelling.spelling_variants(docs)) == brute_force(rows)
    none = spelling.spelling_variants(empty(spark))
    assert none.collect() == [] and none.columns == ["word", "n", "n_near", "form", "form_n", "root"]


def test_text_ids_and_extra_columns(spark):
    docs = spark.createDataFrame([(str(k), t) for k, t in varied(9)], "key string, body string").withColumn("word", F.lit(1))
    rows = [(r.key, r.body) for r in docs.collect()]
    assert result(spelling.spelling_variants(docs, "key", "body")) == brute_force(rows)


def test_long_texts_are_read_run_by_run(monkeypatch):
    text = "Ab ÀB ab straße".encode()
    whole = spelling.text_runs(text)
    monkeypatch.setattr(spelling, "LISTED_BYTES", 3)
    assert spelling.text_runs(text) == whole == Counter({"ab": 2, "Àb": 1, "straße": 1})


def test_edit_hashes_are_those_of_the_spelled_edits():
    words = ["banana", "aabbcc", "ÿÿÿÿÿÿ"]
    points = spelling.spelled(words)
    for a, b in ((0, 6), (2, 5)):
        gone, first, swapped = spelling.edits(points, a, b)
        for w, word in enumerate(words):
            for k in range(a, b):
                rest = word[:k] + word[k + 1:]
                assert gone[w, k - a] == spelling.mixed(spelling.raw_hashes(spelling.spelled([rest])))[0]
                assert first[w, k - a] == (k == 0 or word[k] != word[k - 1])
                other = word[:k] + chr(int(spelling.LETTERS[40])) + word[k + 1:]
                assert swapped[w, k - a, 40] == spelling.mixed(spelling.raw_hashes(spelling.spelled([other])))[0]


def test_filters_have_no_false_negatives_and_few_false_positives(spark):
    rng = np.random.default_rng(3)
    words = ["".join(map(chr, 97 + rng.integers(0, 26, 8))) for _ in range(4000)]
    vocab = written(spark.createDataFrame([(w, 3) for w in words[:2000]], "word string, n bigint"))
    n = vocab.count()
    parts, blocks = {8: 3}, {8: 1 + n * spelling.BITS_A_WORD // (64 * 3)}
    shards = {(r.length, r.part): np.frombuffer(r.content, np.uint64)
              for r in spelling.filter_shards(vocab, parts, blocks).collect()}
    filters = spelling.Filters(parts, blocks, shards)
    hit = filters.may_hold(spelling.mixed(spelling.raw_hashes(spelling.spelled(words))), 8)
    assert hit[:2000].all() and hit[2000:].mean() < 0.03


def test_rounds_keep_the_broadcast_below_its_limit():
    sizes = {(n, p): 30 for n in range(5, 12) for p in range(2)}
    got = spelling.rounds_of(sizes, 100)
    assert [k for g in got for k in g] == sorted(sizes) and all(sum(sizes[k] for k in g) <= 100 for g in got)
