import math
import random

from pyspark.sql import functions as F

from helpers import SCHEMA, empty, messy
from parley.llm.toxicity import SETTINGS, BlockMaxIndex, Settings, fitted, isotonic, toxicity_scores

BAD = ["scumm", "vilez", "rotte"]


def corpus():
    rng = random.Random(1)
    plain = ["".join(rng.choice("aeioubcd") for _ in range(5)) for _ in range(200)]
    docs, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        w = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(BAD)
            w[rng.randrange(len(w))] = rng.choice(BAD)
        docs.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, int(toxic)))
    return docs, labels


def folds():
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    return ~held, held


def test_held_out_accuracy_and_evidence(spark):
    docs, labels = corpus()
    got = {r.doc_id: r for r in toxicity_scores(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(
        labels, "doc_id bigint, toxic int"), *folds()).collect()}
    truth = dict(labels)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert all(not got[i].held_out for r in got.values() for i in r.evidence)


def test_held_out_labels_do_not_matter(spark):
    docs, labels = corpus()
    train, held = folds()
    d = spark.createDataFrame(docs, SCHEMA)
    lab = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    changed = lab.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    first, second = ({r.doc_id: r.score for r in toxicity_scores(d, x, train, held).collect()} for x in (lab, changed))
    assert first == second


def test_bounded_sample(spark):
    docs, labels = corpus()
    got = toxicity_scores(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, toxic int"),
                          *folds(), settings=Settings(max_examples=20, min_df=2)).collect()
    assert len({i for r in got for i in r.evidence}) <= 40


def test_examples_beyond_a_thousand_of_a_label_are_used(spark):
    rng = random.Random(5)
    docs = [(i, f"{rng.choice(BAD) if i % 2 else 'plain'} w{'abcdefghij'[i % 10]} " + "".join(rng.choice("abcdef") for _ in range(12)),
             "en", "s", 1) for i in range(2600)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(2600)], "doc_id bigint, toxic int")
    model = fitted(spark.createDataFrame(docs, SCHEMA), labels, F.lit(True), "doc_id", "text", "toxic", SETTINGS)
    assert (model.labels.count(0), model.labels.count(1)) == (1300, 1300)


def test_messy_without_labels_and_empty(spark):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    got = toxicity_scores(messy(spark), none, *folds()).collect()
    assert len(got) == 14 and {r.score for r in got} == {0.0}
    docs, labels = corpus()
    labels += [(None, 1), (5, None), (7, 0), (7, 0)]
    lab = spark.createDataFrame(labels, "doc_id bigint, toxic int").withColumn("text", F.lit("x"))
    df = messy(spark, False).unionByName(spark.createDataFrame(docs, SCHEMA).withColumn("doc_id", F.col("doc_id") + 100))
    assert toxicity_scores(df, lab.withColumn("doc_id", F.col("doc_id") + 100), *folds()).count() == 414
    assert toxicity_scores(empty(spark), lab, *folds()).count() == 0


def test_index_is_exact():
    rng = random.Random(3)

    def vector():
        v = {t: rng.choice([1.0, 2.0, rng.random()]) for t in rng.sample(range(20), rng.randint(0, 6))}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}
    vectors = [vector() for _ in range(300)]
    index = BlockMaxIndex(vectors, 20, 16)
    for _ in range(200):
        q, k = vector(), rng.choice([1, 5, 15])
        every = sorted((-round(sum(w * v.get(t, 0) for t, w in q.items()), 9), i) for i, v in enumerate(vectors) if set(q) & set(v))
        got = index.nearest(q, k)
        assert [s for s, _ in got] == [-s for s, _ in every[:k]]
        cut = -every[min(k, len(every)) - 1][0] if every else 0
        assert {i for s, i in got if s > cut} == {i for s, i in every if -s > cut}


def test_isotonic_is_monotone_and_pools():
    knots = isotonic([0.1, 0.2, 0.3, 0.4, 0.4], [0, 1, 0, 1, 1], [1, 1, 1, 1, 1])
    assert knots == [(0.1, 0.0), (0.2, 0.5), (0.3, 0.5), (0.4, 1.0)]
