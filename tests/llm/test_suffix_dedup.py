import hashlib
import os
import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from helpers import SCHEMA, empty, messy, messy_rows, prose
from parley.llm import suffix_dedup
from parley.llm.common import SHUFFLE_CLEANUP, written
from parley.llm.queries import op3_suffix_dedup
from parley.llm.suffix_dedup import RunLengthIndex, contexts, deduplicated, merged, repeat_digests


def brute_runs(texts, length):
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    return [merged([(i, length) for i in range(len(t) - length + 1) if seen[t[i:i + length]] > 1]) for t in texts]


def brute_digest(rows, length=400, report=280):
    texts = [(r[1] or "").encode() for r in rows]
    out = []
    for r, t, runs, passages in zip(rows, texts, brute_runs(texts, length), brute_runs(texts, report)):
        left = b"".join(t[b:a] for (_, b), (a, _) in zip([(0, 0), *runs], [*runs, (len(t), 0)]))
        words = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)]
        held = [sum(a <= x and y <= b for x, y in words) for a, b in passages]
        held = [n for n in held if n > 50]
        out.append((r[0], len(t), sum(b - a for a, b in runs), len(runs), hashlib.sha256(left).hexdigest(), len(held), sum(held)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(5))
def test_index_marks_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(40):
        letters = rng.choice([b"ab", b"abc", b"\x00\xff"])
        base = bytes(rng.choice(letters) for _ in range(60))
        texts = []
        for _ in range(rng.randint(1, 6)):
            t = bytearray()
            for _ in range(rng.randint(0, 4)):
                i = rng.randint(0, 55)
                t += base[i:i + rng.randint(1, 30)] + bytes(rng.choice(letters) for _ in range(rng.randint(0, 4)))
            texts.append(bytes(t) or b"a")
        length = rng.choice([5, 9, 14, 20])
        marks = list(RunLengthIndex(texts).marks(length))
        got = [merged([(s, n) for k, s, n in marks if k == i]) for i in range(len(texts))]
        assert got == brute_runs(texts, length)


def test_statistics_are_longest_other_matches():
    texts = [b"banana", b"ananas", b"n"]
    index = RunLengthIndex(texts)
    stat = index.statistics()
    places = [(k, i) for k, t in enumerate(texts) for i in range(len(t))]
    for k, i in places:
        want = max(next((n for n in range(10, -1, -1) if texts[k][i:i + n] == texts[j][x:x + n]
                         and len(texts[k]) >= i + n and len(texts[j]) >= x + n)) for j, x in places if (j, x) != (k, i))
        assert stat[index.starts[k] + i] == want
    assert index.runs < sum(map(len, texts)) + len(texts)


def test_every_window_lies_in_one_context():
    rng = np.random.default_rng(1)
    for n in (10, 39, 40, 41, 500):
        text = rng.integers(97, 100, n).astype(np.uint8)
        starts = [s + i for _, start, size, _ in contexts(text, 40, 16) for s, z in zip(start, size) for i in range(z - 39)]
        assert sorted(starts) == list(range(max(0, n - 39)))


def edited_family(seed):
    """Documents that share passages of many lengths, periodic texts, and copies of edited copies."""
    rng = random.Random(seed)

    def words(n):
        return " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 7))) for _ in range(n))
    passage, other = words(200), words(120)
    rows = [(i, words(rng.randint(5, 40)) + passage[:rng.randint(300, 900)] + words(rng.randint(5, 40)), "en", "a", 1) for i in range(25)]
    rows += [(100 + i, passage + words(2) + other if i % 2 else other + words(3) + passage, "en", "a", 1) for i in range(6)]
    rows += [(200, "ab" * 900, "en", "a", 1), (201, "x" * 401, "en", "a", 1), (202, "y" * 400, "en", "a", 1),
             (203, "é" * 300 + "z" + "é" * 300, "en", "a", 1), (204, other, "en", "a", 1), (204, other, "en", "a", 1)]
    return rows


def test_contexts_reach_further_within_the_text():
    text = np.random.default_rng(2).integers(97, 100, 300).astype(np.uint8)
    seen = set()
    for (_, start, size, _), (_, same, longer, _) in zip(contexts(text, 40, 16), contexts(text, 40, 16, 25)):
        assert (start == same).all() and (longer == np.minimum(size + 25, 300 - start)).all()
        seen |= {s + i for s, z in zip(same, longer) for i in range(z - 64)}
    assert seen == set(range(300 - 64))  # every window of 65 bytes lies in the context in which it starts


@pytest.mark.parametrize("limits", [{}, {"max_contexts": 3}, {"shard_bytes": 4000}])
def test_digests_equal_brute_force(spark, monkeypatch, limits):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 500)
    rows = edited_family(3) + messy_rows()
    rows += [(300 + i, prose(i, 30) + " " + prose(77, 52 + 3 * i) + "\n" + prose(90 + i, 20), "en", "a", 1) for i in range(6)]
    df, want = spark.createDataFrame(rows, SCHEMA), brute_digest(rows)
    assert sorted((tuple(r) for r in repeat_digests(df, **limits).collect()), key=repr) == sorted((r[:5] for r in want), key=repr)
    reported = {"report": suffix_dedup.PASSAGE_BYTES, "gram": suffix_dedup.PASSAGE_GRAM}
    got = [tuple(r) for r in repeat_digests(df, **reported, **limits).collect()]
    assert sorted(got, key=repr) == want and sum(r[5] and not r[2] for r in want) > 2


def brute_passages(rows):
    texts = [re.findall(rb"[^\x20\x09-\x0D]+", (r[1] or "").encode()) for r in rows]
    seen = Counter(w for t in texts for w in {tuple(t[i:i + 51]) for i in range(len(t) - 50)})
    out = []
    for r, t in zip(rows, texts):
        runs = merged([(i, 51) for i in range(len(t) - 50) if seen[tuple(t[i:i + 51])] > 1])
        out.append((r[0], len(runs), sum(b - a for a, b in runs)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [suffix_dedup.BLOCK, 300])
def test_passages_equal_brute_force(spark, monkeypatch, block):
    """Passages of 51 words and more are reported, also where they have fewer than 400 bytes; of 50 words none is."""
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    rows = edited_family(3) + messy_rows()
    rows += [(300 + i, prose(i, 30) + " " + prose(77, 49 + i) + "\n" + prose(90 + i, 20), "en", "a", 1) for i in range(6)]
    short = " ".join("abcdefghijklmnopqrstuvwxy") + " " + " ".join("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    rows += [(400 + i, f"{prose(200 + i, 9)} {short} {prose(300 + i, 70)}", "en", "a", 1) for i in range(3)]
    rows += [(410, short.rsplit(" ", 1)[0] + " %", "en", "a", 1), (411, short.replace(" ", "\n\t"), "en", "a", 1),
             (412, "q" * 400 + " " + prose(500, 60), "en", "a", 1), (413, "q" * 400 + " " + prose(500, 60), "en", "a", 1),
             (414, prose(501, 52) + " and " + prose(501, 52), "en", "a", 1), (415, prose(502, 50) + " z", "en", "a", 1),
             (416, prose(502, 50), "en", "a", 1), (417, "x " * 53, "en", "a", 1), (418, prose(503, 55) + " and " + prose(503, 55), "en", "a", 1),
             (419, "but " + prose(503, 55), "en", "a", 1)]
    got = [tuple(r) for r in repeat_digests(spark.createDataFrame(rows, SCHEMA), passages=True).collect()]
    assert sorted(((r[0], *r[5:]) for r in got), key=repr) == brute_passages(rows)
    assert sorted((r[:5] for r in got), key=repr) == sorted((r[:5] for r in brute_digest(rows)), key=repr)
    assert {r[0]: r[5] for r in got if r[0] and 400 <= r[0]} | {0: sum(r[5] and not r[2] for r in got) > 5} == {
        400: 1, 401: 1, 402: 1, 410: 0, 411: 1, 412: 1, 413: 1, 414: 0, 415: 0, 416: 0, 417: 0, 418: 2, 419: 1, 0: True}


def test_query_reports_passages_of_few_bytes(spark, tmp_path):
    passage = " ".join(f"w{i}" for i in range(51))
    rows = [(i, f"{prose(i, 30)} {passage} {prose(50 + i, 30)}", "en", "a", 1) for i in range(2)]
    spark.createDataFrame([*rows, (7, prose(9, 90), "en", "a", 1)], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_removed, r.n_repeated_passages, r.n_repeated_words) for r in op3_suffix_dedup(spark, str(tmp_path)).collect()}
    assert got == {0: (0, 1, 51), 1: (0, 1, 51), 7: (0, 0, 0)}


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_only_what_is_still_read_stays_on_disk(spark, monkeypatch):
    """The shuffle files of a table's job go with the job, the tables of all contexts and anchors once they are joined."""
    tables, left = [], set()

    def watched(df, *where):
        before = shuffle_files(spark)
        out = written(df, *where)
        tables.append(out)
        ends = time.time() + 20
        while (new := shuffle_files(spark) - before) and time.time() < ends:  # executors remove them a little later
            time.sleep(0.1)
        left.update(new)
        return out

    monkeypatch.setattr(suffix_dedup, "written", watched)
    rows = edited_family(3) + messy_rows()
    out = repeat_digests(spark.createDataFrame(rows, SCHEMA), passages=True)
    assert not left
    assert spark.conf.get(SHUFFLE_CLEANUP, None) is None
    there = {os.path.join(spark.conf.get("spark.checkpoint.dir"), "parley-tables", name) for name in os.listdir(
        os.path.join(spark.conf.get("spark.checkpoint.dir"), "parley-tables"))}
    gone = [t.columns for t in tables if not {os.path.dirname(f.removeprefix("file://")) for f in t.inputFiles()} & there]
    context = ["anchor", "context", "doc", "place"]
    assert gone == [context, ["anchor", "contested"], [*context, "new"], ["anchor", "contested"]]
    for _ in range(2):  # the result can be computed again
        assert sorted((tuple(r)[:5] for r in out.collect()), key=repr) == sorted((r[:5] for r in brute_digest(rows)), key=repr)


def test_stage_removes_the_bytes(spark):
    df = messy(spark)
    out = deduplicated(df)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    rows = messy_rows()
    texts = [(r[1] or "").encode() for r in rows]
    want = []
    for r, t, runs in zip(rows, texts, brute_runs(texts, 400)):
        left = b"".join(t[b:a] for (_, b), (a, _) in zip([(0, 0), *runs], [*runs, (len(t), 0)])).decode("utf-8", "ignore")
        want.append((r[0], None if r[1] is None else left, r[4] if r[1] is None else len(left)))
    assert sorted(((r.doc_id, r.text, r.n_chars) for r in out.collect()), key=repr) == sorted(want, key=repr)


def test_empty_table(spark):
    assert repeat_digests(empty(spark)).count() == 0
    assert deduplicated(empty(spark)).count() == 0
