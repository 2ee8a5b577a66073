"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, voted and calibrated.

Examples are a bounded sample of the labelled training rows, up to ``max_examples`` of each label in a fixed pseudo-random
order. Their vocabulary is the words whose presence goes with the toxic label beyond chance (chi-squared over the examples,
corrected for the number of words tried; at most ``max_terms``, the most telling first); a word's document frequency is counted over all documents. Vectors are (1 + log tf) * idf over these words, normalised.

The index keeps the examples in blocks, with each word's postings and greatest weight a block. A text's bound on a block is
the sum of its weights times those maxima; blocks are scored from the highest bound down until no bound reaches the
k-th similarity, so the k nearest are exact (ties by the example's place). Neighbours vote with weight
``class weight / (0.05 + 1 - cosine)``; a prior vote pulls weak evidence to the base rate. Votes are calibrated by
isotonic regression on the examples themselves, each scored without itself. Labels are used for the examples only; language, source
and id are never read by a score.

Defined cases: a null or empty text, or one without a vocabulary word, has no neighbours and gets the calibrated score of
no evidence; without examples of both labels every score is the base rate (0 if there are no labels at all); a label
given twice counts as toxic if any is; null ids and null labels teach nothing; repeated rows are scored each. An empty table
gives an empty result; other columns are not read. The index is bounded by ``max_examples`` and ``max_terms``, so is its broadcast.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import kept, record_batch, texts, written

WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Settings:
    max_examples: int = 4000   # of each label
    max_terms: int = 2048
    min_df: int = 3            # examples that must have a vocabulary word
    neighbours: int = 15
    block: int = 64
    prior_votes: float = 1.0
    flag_at: float = 0.7


SETTINGS = Settings()


def words(text: str) -> list[str]:
    """Runs of letters, lower case."""
    return WORD.findall(text.lower())


def sampled_labels(labels: DataFrame, train: Column, n: int, id_col: str, label_col: str) -> DataFrame:
    """(doc_id, toxic): at most ``n`` training rows of each label, the first by the md5 of their id."""
    one = labels.where(train & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(
        F.col(id_col).alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    order = F.md5(F.col("doc_id").cast("string"))
    return one.where("toxic = 1").orderBy(order, "doc_id").limit(n).unionByName(
        one.where("toxic = 0").orderBy(order, "doc_id").limit(n))


def example_terms(docs: DataFrame, sample: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, toxic, term, tf) of the sampled documents; copies of a text are one example, toxic if any is."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "doc_id")
    src = src.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
    src = src.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("doc_id", "toxic", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for b in batches:
            schema = schema or pa.schema([("doc_id", b.schema.field(0).type), ("toxic", pa.int32()), ("term", pa.string()),
                                          ("tf", pa.int64())])
            for i, t in enumerate(texts(b.column(2))):
                found = Counter(words(t))
                n = len(found) + 1  # the empty term keeps documents without words
                yield record_batch(schema, pa.array([b.column(0)[i].as_py()] * n, b.schema.field(0).type),
                                   [b.column(1)[i].as_py()] * n, ["", *found], [1, *found.values()])

    return written(src.mapInArrow(count, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, toxic int, term string, "
                                  "tf bigint"))


def telling_terms(terms: DataFrame, n_toxic: int, n_clean: int, settings: Settings) -> list[str]:
    """The words whose presence goes with the toxic label most, by chi-squared (at most ``max_terms``)."""
    a, b = F.col("a"), F.col("b")
    c, d, n = F.lit(n_toxic) - a, F.lit(n_clean) - b, float(n_toxic + n_clean)
    counts = terms.where("term <> ''").groupBy("term").agg(
        F.sum("toxic").cast("double").alias("a"), F.sum(1 - F.col("toxic")).cast("double").alias("b"))
    counts = counts.where((a + b >= settings.min_df) & (a * n_clean > b * n_toxic))
    chi = n * (a * d - b * c) ** 2 / ((a + b) * (c + d + 1e-9) * n_toxic * n_clean)
    scored = kept(counts.select("term", chi.alias("chi")))
    tried = max(1, scored.count())
    # so many words are tried that some look telling by chance: the chance of any is held at one in a thousand
    least = NormalDist().inv_cdf(1 - 0.001 / (2 * tried)) ** 2
    rows = scored.where(F.col("chi") > least).orderBy(F.desc("chi"), "term").limit(settings.max_terms)
    return [r["term"] for r in rows.collect()]


def document_frequency(docs: DataFrame, text_col: str, vocabulary: list[str]) -> tuple[dict[str, int], int]:
    """Over all documents: how many have each word of the bounded vocabulary, and how many there are."""
    known = frozenset(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, sums, n = pa.schema([("term", pa.string()), ("n", pa.int64())]), Counter(), 0
        for b in batches:
            for t in texts(b.column(0)):
                sums.update(known.intersection(words(t)))
                n += 1
        yield record_batch(schema, [*sums, ""], [*sums.values(), n])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "term string, n bigint").groupBy("term").agg(
        F.sum("n").alias("n")).collect()  # at most max_terms + 1 rows
    found = {r["term"]: r["n"] for r in rows}
    return found, found.pop("", 0)


class BlockMaxIndex:
    """Postings of normalised example vectors in blocks, with each term's greatest weight a block."""

    def __init__(self, vectors: list[dict[int, float]], n_terms: int, block: int):
        self.block, self.n = block, len(vectors)
        n_blocks = max(1, -(-self.n // block))
        self.most = np.zeros((n_terms, n_blocks))
        lists: dict[tuple[int, int], tuple[list[int], list[float]]] = {}
        for i, v in enumerate(vectors):
            for t, w in v.items():
                ids, weights = lists.setdefault((t, i // block), ([], []))
                ids.append(i % block)
                weights.append(w)
                self.most[t, i // block] = max(self.most[t, i // block], w)
        self.lists = {k: (np.array(a), np.array(w)) for k, (a, w) in lists.items()}

    def nearest(self, query: dict[int, float], k: int, without: int = -1) -> list[tuple[float, int]]:
        """The ``k`` examples of greatest cosine above 0, exactly; ties go to the earlier example."""
        terms = sorted(query)
        weights = np.array([query[t] for t in terms])
        bounds = weights @ self.most[terms] if terms else np.zeros(0)
        places, values = np.zeros(0, np.int64), np.zeros(0)
        least = 0.0  # the k-th similarity so far
        for b in np.argsort(-bounds, kind="stable").tolist():
            # rounding may lift a similarity over its bound by parts of a billion
            if bounds[b] <= 0 or bounds[b] + 1e-9 < least:
                break
            sums = np.zeros(self.block)
            for t, w in zip(terms, weights):
                if (found := self.lists.get((t, b))) is not None:
                    sums[found[0]] += w * found[1]
            sums = np.round(sums, 9)
            near = np.flatnonzero((sums > 0) & (sums >= least))
            near = near[near + b * self.block != without]
            if len(near):
                places, values = np.concatenate([places, near + b * self.block]), np.concatenate([values, sums[near]])
                if len(places) > k:
                    order = np.lexsort((places, -values))[:k]
                    places, values = places[order], values[order]
                    least = values[-1]
        order = np.lexsort((places, -values))
        return list(zip(values[order].tolist(), places[order].tolist()))


class ToxicityModel:
    def __init__(self, ids: list, labels: list[int], counts: list[dict[str, int]], idf: dict[str, float],
                 class_totals: tuple[int, int], settings: Settings):
        self.settings = settings
        self.term = {w: k for k, w in enumerate(sorted(idf))}
        self.idf = [idf[w] for w in sorted(idf)]
        vectors = [self.vector(c) for c in counts]
        # like examples side by side, so that block maxima are tight
        order = sorted(range(len(ids)), key=lambda i: (sorted(vectors[i].items(), key=lambda x: (-x[1], x[0])), str(ids[i])))
        self.ids, self.labels = [ids[i] for i in order], [labels[i] for i in order]
        vectors = [vectors[i] for i in order]
        clean, toxic = class_totals
        self.base = toxic / (toxic + clean) if toxic + clean else 0.0
        seen = Counter(labels)
        self.weight = {y: n / seen[y] if seen[y] else 0.0 for y, n in ((0, clean), (1, toxic))}
        top = max(self.weight.values(), default=0) or 1.0
        self.weight = {y: w / top for y, w in self.weight.items()}
        self.index = BlockMaxIndex(vectors, len(self.idf), settings.block)
        self.knots: list[tuple[float, float]] = []
        if seen[0] and seen[1]:
            raw = [self.vote(self.index.nearest(v, settings.neighbours, i)) for i, v in enumerate(vectors)]
            self.knots = isotonic(raw, self.labels, [self.weight[y] for y in self.labels])

    def vector(self, counts: dict[str, int]) -> dict[int, float]:
        v = {self.term[w]: (1 + math.log(n)) * self.idf[self.term[w]] for w, n in counts.items() if w in self.term}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()} if norm else {}

    def vote(self, near: list[tuple[float, int]]) -> float:
        votes = [self.weight[self.labels[i]] / (1.05 - s) for s, i in near]
        prior = self.settings.prior_votes
        return (sum(v for v, (_, i) in zip(votes, near) if self.labels[i]) + prior * self.base) / (sum(votes) + prior)

    def calibrated(self, vote: float) -> float:
        if not self.knots:
            return self.base
        x, y = zip(*self.knots)
        return float(np.interp(vote, x, y))

    def score(self, counts: dict[str, int]) -> tuple[float, list]:
        """Calibrated score, and the ids of the nearest examples as evidence."""
        near = self.index.nearest(self.vector(counts), self.settings.neighbours)
        return self.calibrated(self.vote(near)), [self.ids[i] for _, i in near]


def isotonic(x: list[float], y: list[int], w: list[float]) -> list[tuple[float, float]]:
    """Weighted isotonic regression (pool adjacent violators) as knots of a non-decreasing piecewise line."""
    pools: list[list[float]] = []  # weight, weighted label, lowest x, highest x
    for a, b, c in sorted(zip(x, y, w)):
        if pools and pools[-1][3] == a:
            pools[-1][0] += c
            pools[-1][1] += c * b
        else:
            pools.append([c, c * b, a, a])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1][0] += last[0]
            pools[-1][1] += last[1]
            pools[-1][3] = last[3]
    knots = []
    for weight, toxic, low, high in pools:
        knots += [(low, toxic / weight), (high, toxic / weight)] if high > low else [(low, toxic / weight)]
    return knots


def fitted(docs: DataFrame, labels: DataFrame, train: Column, id_col: str, text_col: str, label_col: str,
           settings: Settings) -> ToxicityModel:
    known = labels.where(train & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    totals = {r[0]: r[1] for r in known.groupBy(F.col(label_col).cast("int")).agg(F.countDistinct(id_col)).collect()}
    sample = sampled_labels(labels, train, settings.max_examples, id_col, label_col)
    terms = example_terms(docs, sample, id_col, text_col)
    sizes = {r[0]: r[1] for r in terms.where("term = ''").groupBy("toxic").agg(F.count(F.lit(1))).collect()}
    vocabulary: list[str] = []
    if sizes.get(0) and sizes.get(1):
        vocabulary = telling_terms(terms, sizes[1], sizes[0], settings)
    df, n_docs = document_frequency(docs, text_col, vocabulary)
    idf = {w: 1 + math.log((1 + n_docs) / (1 + df.get(w, 0))) for w in vocabulary}
    kept_terms = docs.sparkSession.createDataFrame([(w,) for w in [*vocabulary, ""]], "term string")
    rows = terms.join(F.broadcast(kept_terms), "term").groupBy("doc_id", "toxic").agg(
        F.collect_list(F.struct("term", "tf")).alias("terms")).orderBy("doc_id").collect()  # 2 * max_examples at most
    counts = [{t["term"]: t["tf"] for t in r["terms"] if t["term"]} for r in rows]
    return ToxicityModel([r["doc_id"] for r in rows], [r["toxic"] for r in rows], counts, idf,
                         (totals.get(0, 0), totals.get(1, 0)), settings)


def toxicity_scores(docs: DataFrame, labels: DataFrame, train: Column, held_out: Column, id_col: str = "doc_id",
                    text_col: str = "text", label_col: str = "toxic", settings: Settings = SETTINGS) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) of every row; ``evidence`` are the nearest examples' ids."""
    model = docs.sparkSession.sparkContext.broadcast(
        fitted(docs, labels, train, id_col, text_col, label_col, settings))
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"),
                      F.col(text_col).alias("text"))
    id_type = src.schema["doc_id"].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, schema = model.value, None
        known = m.term
        for b in batches:
            kind = b.schema.field(0).type
            schema = schema or pa.schema([("doc_id", kind), ("held_out", pa.bool_()), ("score", pa.float64()),
                                          ("predicted", pa.int32()), ("evidence", pa.list_(kind))])
            scores, evidence = [], []
            for t in texts(b.column(2)):
                s, e = m.score(Counter(w for w in words(t) if w in known))
                scores.append(s)
                evidence.append(e)
            yield record_batch(schema, b.column(0), b.column(1), scores,
                               [int(s >= m.settings.flag_at) for s in scores], pa.array(evidence, pa.list_(kind)))

    return src.mapInArrow(judge, f"doc_id {id_type}, held_out boolean, score double, predicted int, "
                          f"evidence array<{id_type}>")
