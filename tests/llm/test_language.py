import math
import random
import zlib
from itertools import groupby

import numpy as np
from pyspark.sql import functions as F

from helpers import SCHEMA, empty, messy
from parley.llm import language
from parley.llm.language import Mixture, predicted_languages, trigrams

SYLLABLES = {"aa": "ba da ga ka ma na".split(), "ee": "pe te le se re fe".split(), "oo": "zo vo jo ho wo yo".split()}


def words(lang, n, rng):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus():
    rng = random.Random(1)
    rows = [(i, words(lang, rng.randint(1, 80), rng), lang, "s", 1) for i, lang in enumerate(rng.choices(list(SYLLABLES), k=200))]
    return rows


def folds():
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return ~held, held


def test_held_out_accuracy(spark):
    rows = corpus()
    got = {r.doc_id: r for r in predicted_languages(spark.createDataFrame(rows, SCHEMA), *folds()).collect()}
    assert len(got) == len(rows)
    assert all(got[r[0]].held_out == (zlib.crc32(str(r[0]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if got[r[0]].held_out]
    assert sum(got[r[0]].lang_pred == r[2] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def counted(rows):
    sums = {}
    for _, text, lang, *_ in rows:
        sums.setdefault(lang, np.zeros(language.BINS, np.int64))
        np.add.at(sums[lang], trigrams([text])[0], 1)
    return sums


def plain_bins(word):
    """Bins of a word's trigrams, a space before and after it."""
    f = [int(x) for x in language.FACTORS]
    points = [0, *map(ord, word), 0]
    out = []
    for x, y, z in zip(points, points[1:], points[2:]):
        h = (x * f[0] + y * f[1] + z * f[2]) & 0xFFFFFFFF
        h ^= h >> 15
        out.append(((h * f[1]) & 0xFFFFFFFF) >> 16)
    return out


def plain_inference(text, langs, counts, penalty=1.0):
    """Proportions of the chosen languages, word by word and set by set."""
    total = {k: float(counts[k].sum()) + language.SMOOTH * language.BINS for k in langs}
    words_ = ["".join(g) for alpha, g in groupby(text.lower(), str.isalpha) if alpha]
    if not words_:
        return [0.0] * len(langs)
    score = [[sum(math.log((counts[k][b] + language.SMOOTH) / total[k]) for b in plain_bins(w)) for k in langs] for w in words_]
    like = [[math.exp(s - max(row)) for s in row] for row in score]

    def em(share, rounds):
        for _ in range(rounds):
            new = [0.0] * len(langs)
            for row in like:
                joint = [a * b for a, b in zip(row, share)]
                for k, x in enumerate(joint):
                    new[k] += x / sum(joint)
            share = [x / len(like) for x in new]
        return share, sum(math.log(max(sum(a * b for a, b in zip(row, share)), 1e-300)) for row in like)

    single = [sum(row[k] - max(row) for row in score) for k in range(len(langs))]
    best = max(single)
    chosen = [float(k == single.index(best)) for k in range(len(langs))]
    full, _ = em([1 / len(langs)] * len(langs), language.ROUNDS)
    price = penalty * math.log(len(like) + 1)
    order = sorted(range(len(langs)), key=lambda k: -full[k])
    for n in range(2, len(langs) + 1):
        start = [max(full[k], 1e-6) if k in order[:n] else 0.0 for k in range(len(langs))]
        share, value = em([x / sum(start) for x in start], language.REFITS)
        if value - (n - 1) * price > best:
            best, chosen = value - (n - 1) * price, share
    return chosen


def test_inference_equals_plain_loops():
    rng, counts = random.Random(8), counted(corpus())
    langs, model = sorted(counts), Mixture.of(counts)
    texts = [" ".join(words(rng.choice(list(SYLLABLES)), rng.randint(0, 25), rng) for _ in range(rng.randint(1, 4))) for _ in range(150)]
    texts += ["", "12 !", "Xyz Über QQQ", "pa", "ba ze le", "漢字 ba"]
    got = model.infer(texts)
    several = 0
    for text, share in zip(texts, got):
        want = plain_inference(text, langs, counts)
        assert np.allclose(share, want, atol=1e-9), (text, share, want)
        several += sum(x > 0 for x in want) > 1
    assert several > 20


def test_counts_come_as_one_array_a_language(spark):
    rows = corpus()[:60]
    df = spark.createDataFrame(rows, SCHEMA)
    got = language.packed(language.trained_counts(df, F.lit(True), "text", "lang")).collect()
    want = counted(rows)
    assert {r.lang for r in got} == set(want)
    assert all((np.frombuffer(r.counts, np.int64) == want[r.lang]).all() for r in got)


def test_mixtures_are_found_in_proportion():
    rng, model = random.Random(3), Mixture.of(counted(corpus()))
    text = words("aa", 300, rng) + " " + words("oo", 100, rng)
    share = model.infer([text, words("ee", 100, rng), "", "123 !?"])
    assert abs(share[0][0] - 0.75) < 0.05 and abs(share[0][2] - 0.25) < 0.05 and share[0][1] == 0
    assert share[1].tolist() == [0, 1, 0] and not share[2:].any()


def test_rows_of_a_batch_do_not_touch_each_other():
    rng, model = random.Random(4), Mixture.of(counted(corpus()))
    texts = [words(rng.choice(list(SYLLABLES)), rng.randint(0, 30), rng) + words("ee", rng.randint(0, 9), rng) for _ in range(60)]
    whole = model.infer(texts)
    assert all(abs(model.infer([t])[0] - w).max() < 1e-9 for t, w in zip(texts, whole))


def test_messy_unlearned_and_empty(spark):
    got = predicted_languages(messy(spark), *folds()).collect()
    assert len(got) == 14
    for r in got:
        if r.doc_id in (3, 4, 5):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    nothing = predicted_languages(messy(spark), F.lit(False), F.lit(True)).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    assert predicted_languages(empty(spark), *folds()).count() == 0
