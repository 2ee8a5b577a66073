import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helpers import empty, messy, messy_rows, prose
from parley.llm import packing
from parley.llm.packing import CachedTokenizer, cut_pieces, default_tokenizer_path, pack_documents, sum_of_squares


@pytest.fixture(scope="module")
def tokenizers():
    from tokenizers import Tokenizer
    return CachedTokenizer(default_tokenizer_path()), Tokenizer.from_file(default_tokenizer_path())


TEXTS = ["", " ", "It's we're I'd 'tis ''s", "a<|endoftext|>b <|startoftext|>", "ÀÉ straße Łódź ſ İstanbul ı ĸ ŉ", "x1 22 ³ ½ Ⅷ ٣",
         "á é̂ Å", "漢字 かな \U0001f600\U0001f468‍\U0001f469", "tab\tline\nfeed\r\x0b\x0c\x1c\x85  end",
         "&&&'s***'ll%%% don't!!!", "Σίσυφος ΟΔΟΣ", "__init__ a_b", "w" * 3000, "##$$" * 800, "ŸŽź Ů"]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_are_the_tokenizers_own(tokenizers, text):
    ours, plain = tokenizers
    for t in (text, text + " " + prose(1, 30), prose(2, 5) + text):
        assert np.frombuffer(b"".join(ours.chunks(t)), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n'stlevm0aÀéß<|>"), st.characters(codec="utf-8")), max_size=60))
def test_ids_of_any_text(tokenizers, text):
    ours, plain = tokenizers
    assert np.frombuffer(b"".join(ours.chunks(text)), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_long_texts_are_cut_at_white_space_and_the_cache_is_bounded(tokenizers, monkeypatch):
    monkeypatch.setattr(packing, "TEXT_CHUNK", 50)
    monkeypatch.setattr(packing, "CACHE_WORDS", 20)
    ours, plain = CachedTokenizer(default_tokenizer_path()), tokenizers[1]
    text = prose(5, 400) + " é́ " + prose(6, 400)
    assert np.frombuffer(b"".join(ours.chunks(text)), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    assert len(ours.words) <= 20


def check_packing(rows, want, capacity):
    """Every piece once; sequences are gapless from 0 and at most full."""
    assert sorted((r[:5] for r in rows), key=repr) == sorted(want, key=repr)
    by = {}
    for r in rows:
        by.setdefault(r[5], []).append((r[6], r[3]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def pieces_of(rows, plain, capacity):
    out = []
    for r in rows:
        ids = np.array([*plain.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), capacity):
            p = ids[k:k + capacity]
            out.append((r[0], k // capacity, k, len(p), zlib.crc32(p.tobytes())))
    return out


@pytest.mark.parametrize("capacity,shard_rows", [(4096, 50_000), (64, 20)])
def test_messy_documents(spark, tokenizers, capacity, shard_rows):
    df = messy(spark)
    want = pieces_of(messy_rows(), tokenizers[1], capacity)
    got = [tuple(r) for r in pack_documents(df, capacity=capacity, shard_rows=shard_rows).collect()]
    n = check_packing(got, want, capacity)
    assert n <= -(-sum(w[3] for w in want) // capacity) + 2


def test_empty_table(spark):
    assert pack_documents(empty(spark)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_rule_places_where_squares_are_least(lengths):
    capacity = 40
    lengths = np.array(lengths, np.int64)
    seq, at = sum_of_squares(lengths, capacity)
    gaps = {}
    for k in np.argsort(-lengths, kind="stable"):
        s, q = int(lengths[k]), int(seq[k])
        open_gaps = [g for g in gaps.values() if g > 0]
        fits = sorted({g for g in open_gaps if g >= s})

        def squares(before, after):
            rest = list(open_gaps)
            if before:
                rest.remove(before)
            return sum(v * v for g, v in zip(*np.unique(rest + [after] if after else rest, return_counts=True)) if g)
        if fits:
            assert q in gaps
            assert squares(gaps[q], gaps[q] - s) == min(squares(g, g - s) for g in fits)
            assert at[k] == capacity - gaps[q]
            gaps[q] -= s
        else:
            assert q not in gaps and at[k] == 0
            gaps[q] = capacity - s


def test_cut_pieces_of_exact_lengths():
    ids = np.arange(7, dtype="<u4").tobytes()
    assert [x[:3] for x in cut_pieces(iter([ids[:12], ids[12:]]), 4, 1)] == [(0, 0, 4), (1, 4, 4)]
    assert [x[:3] for x in cut_pieces(iter([]), 4, 1)] == [(0, 0, 1)]


def test_full_pieces_are_not_gathered(spark, monkeypatch):
    plain, gathered = packing._packed, []

    def packed(rows, *args):
        gathered.append(rows.where("length >= 16").count())
        return plain(rows, *args)

    monkeypatch.setattr(packing, "_packed", packed)
    docs = spark.createDataFrame([(i, prose(i, 200)) for i in range(20)], "doc_id bigint, text string").repartition(3)
    got = pack_documents(docs, capacity=16, shard_rows=5).collect()
    assert gathered == [0, 0]
    full = [r for r in got if r.length == 16]
    others = {r.sequence_id for r in got if r.length < 16}
    assert len(full) > 100 and all(r.offset == 0 for r in full)
    assert len({r.sequence_id for r in full}) == len(full) and not others & {r.sequence_id for r in full}
