"""Token files against the tokenizer itself, and the wavelet matrix against plain arrays."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from helpers import SCHEMA, empty, messy, messy_rows, prose
from parley.llm import token_store
from parley.llm.token_store import Encoder, classes, default_tokenizer_path, parts_of, token_files
from parley.llm.wavelet import BLOCK, WaveletMatrix
from parley.session import shared_dir

AWKWARD = ["a", "b", "Z", "1", "2", " ", "  ", "\n", "\t", "'", "'s", "'re", "'ll", " 's", "''", "!", "?!", "é", "²", "½", "ß", "\xa0", "　",
           "漢字", "😀", "\x85", "\x1c", "\0", "Ā", "٣", "ⅷ", "<|endoftext|>", "<|", "̀", "﻿", "​", " "]


@pytest.fixture(scope="module")
def encoder():
    return Encoder(default_tokenizer_path(), 0)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(default_tokenizer_path())


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def coded(encoder, texts):
    ids, counts = encoder.encode(texts)
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def stored(spark, docs, **how):
    path = shared_dir(spark, "parley-tokens")
    token_store.write_tokens(docs, path, **how)
    return token_files(spark, path)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(AWKWARD), max_size=30).map("".join) | st.text(max_size=40), min_size=1, max_size=6))
def test_ids_are_those_of_the_tokenizer(texts):
    encoder = token_store.worker_encoder(default_tokenizer_path(), 0)
    assert coded(encoder, texts) == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_every_sure_character_has_the_class_that_the_tokenizer_sees(encoder):
    points = [p for p in range(0x30000) if classes()[p] != token_store.UNSURE]
    texts = [f"a{chr(p)}1 {chr(p)}{chr(p)}b" for p in points[::7]]
    assert coded(encoder, texts) == [x.ids for x in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_parts_of_long_texts_have_the_ids_of_the_whole(encoder):
    rng = random.Random(2)
    text = "".join(rng.choice(AWKWARD) for _ in range(3000))
    parts = list(parts_of(text, 40))
    assert len(parts) > 5 and "".join(parts) == text
    got = np.concatenate([encoder.encode([p])[0] for p in parts])
    assert got.tolist() == encoder.whole(text).tolist()


def test_the_cache_may_overflow(encoder, tokenizer, monkeypatch):
    monkeypatch.setattr(token_store, "CACHE_BYTES", 300)
    for _ in range(3):
        texts = [prose(k, 40) for k in range(4)]
        assert coded(encoder, texts) == [ids_of(tokenizer, t)[:-1] for t in texts]


@pytest.mark.parametrize("shard_tokens, partitions", [(1 << 20, 3), (50, 5), (1, 1)])
def test_digests_of_messy_documents(spark, tokenizer, shard_tokens, partitions):
    rows = sorted(messy_rows(), key=lambda r: (r[0] is not None, r[0] or 0))
    files = stored(spark, messy(spark), shard_tokens=shard_tokens, partitions=partitions)
    got = token_store.token_digests(files).orderBy("start").collect()
    assert [r.doc_id for r in got] == [r[0] for r in rows]
    tokens = {(r[0], r[1]): ids_of(tokenizer, r[1]) for r in rows}

    def digest(ids):
        return len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted(
        (str(k), *digest(tokens[k, t])) for k, t, *_ in rows)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens


def test_an_empty_table(spark):
    out = token_store.stored_token_digests(empty(spark))
    assert out.collect() == [] and sorted(out.columns) == ["doc_id", "ids_crc32", "n_tokens", "start"]


def test_text_ids(spark, tokenizer):
    docs = spark.createDataFrame([("b", "one two"), ("a", "three"), (None, None)], "key string, body string")
    got = token_store.stored_token_digests(docs, id_col="key", text_col="body").orderBy("start").collect()
    assert [(r.doc_id, r.n_tokens) for r in got] == [(None, 1), ("a", len(ids_of(tokenizer, "three"))),
                                                     ("b", len(ids_of(tokenizer, "one two")))]


def test_access_counts_and_occurrences_from_the_files(spark, tokenizer):
    rows = [(k, prose(k, 30) + "!", "en", "a", 1) for k in range(40)]
    files = stored(spark, spark.createDataFrame(rows, SCHEMA), shard_tokens=200, partitions=4)
    assert files.count() > 4
    want = {k: ids_of(tokenizer, t) for k, t, *_ in rows}
    assert {r.doc_id: list(r.tokens) for r in token_store.documents_of(files).collect()} == want
    frequent = want[3][1]
    counts = {r.token: r.n for r in token_store.count_tokens(files, [0, frequent, 50256]).collect()}
    assert counts == {t: sum(v.count(t) for v in want.values()) for t in (0, frequent, 50256)}
    assert counts[0] == 80  # the end id is also the id of "!"
    starts = dict(zip(want, np.cumsum([0, *map(len, want.values())])))
    assert sorted(map(tuple, token_store.find_tokens(files, frequent).select("doc_id", "start", "position").collect())) == [
        (k, starts[k], i) for k, v in want.items() for i, t in enumerate(v) if t == frequent]
    assert {r.doc_id: r.token for r in token_store.tokens_at(files, 33).collect()} == {
        k: v[33] for k, v in want.items() if len(v) > 33}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=1500), st.integers(1, 3), st.integers(0, 10))
def test_wavelet_matrix(ids, repeat, seed):
    x = np.array(ids * repeat, np.uint32)
    matrix = WaveletMatrix.from_bytes(WaveletMatrix.of(x, 9).to_bytes())
    assert matrix.decode().tolist() == x.tolist()
    rng = np.random.default_rng(seed)
    at = rng.integers(0, len(x), 20) if len(x) else np.zeros(0, np.int64)
    assert matrix.access(at).tolist() == x[at].tolist()
    for token in {*x[at][:3].tolist(), 0, 511, 100_000}:
        where = np.flatnonzero(x == token)
        a, b = sorted(rng.integers(0, len(x) + 1, 2).tolist())
        assert matrix.count(token) == len(where) and matrix.count(token, a, b) == ((where >= a) & (where < b)).sum()
        assert matrix.rank(token, b) == (where < b).sum()
        assert matrix.occurrences(token).tolist() == where.tolist()
        assert matrix.occurrences(token, a, b).tolist() == where[(where >= a) & (where < b)].tolist()
        for k in {0, len(where) - 1} & set(range(len(where))):
            assert matrix.select(token, k) == where[k]
        with pytest.raises(IndexError):
            matrix.select(token, len(where))


@pytest.mark.parametrize("n", [BLOCK - 1, BLOCK, BLOCK + 1, 40 * BLOCK])
def test_block_borders_and_wide_ids(n):
    x = np.random.default_rng(n).integers(0, 1 << 20, n).astype(np.uint32)
    matrix = WaveletMatrix.from_bytes(WaveletMatrix.of(x, 20).to_bytes())
    assert (matrix.decode() == x).all() and (matrix.access(np.arange(n)) == x).all()
    bits = (x >> 19).astype(bool)
    top = matrix.planes[0]
    assert top.rank(np.arange(n + 1)).tolist() == [0, *np.cumsum(bits).tolist()]
    assert top.select(True, np.arange(top.ones)).tolist() == np.flatnonzero(bits).tolist()
    assert top.select(False, np.arange(top.zeros)).tolist() == np.flatnonzero(~bits).tolist()


def test_ids_that_do_not_fit_and_damaged_bytes():
    with pytest.raises(ValueError):
        WaveletMatrix.of(np.array([8]), 3)
    data = WaveletMatrix.of(np.arange(100), 7).to_bytes()
    with pytest.raises(ValueError):
        WaveletMatrix.from_bytes(b"XXXX" + data[4:])
