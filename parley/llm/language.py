"""Language ID by mixture inference: each document is a mix of languages, found by expectation maximisation.

A language is a distribution over letter trigrams (a letter with its neighbours, lower case, hashed to 2^16 bins),
counted over all training texts. Every word (run of letters) has a likelihood under each language. EM estimates a
document's language proportions from its words; the language set is the one of greatest penalised likelihood among the
most probable 1, 2, ... languages, refitted for each set. The largest proportion of the chosen set is the prediction.

Counting is one map pass whose partial sums are pre-aggregated per batch and summed by (language, bin): the model has
(learned languages x 65,536) numbers whatever the size of the corpus. Prediction is a map pass; EM runs over all
documents of a slice of a batch at once.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; without any learned language every
document is; ties go to the first language by name; rows with a null language are predicted, not learned from; repeated
rows are predicted each. An empty table gives an empty result; other columns are not read. A very long text is scored
in blocks; what is held is one row of numbers a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import record_batch, texts

BINS = 1 << 16
SMOOTH = 0.5
ROUNDS, REFITS = 12, 6
SLICE_CHARS, BLOCK_CHARS = 1 << 20, 1 << 20
FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_LETTERS: list[np.ndarray] = []  # one table a worker


def letter_table() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def trigrams(rows: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each letter of ``rows``: its trigram's bin, its word's number; and the row of each word."""
    points = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in rows]
    gap = np.zeros(1, np.uint32)
    p = np.concatenate([x for t in points for x in (gap, t)] + [gap])
    letter = letter_table()[p]
    p = np.where(letter, p, 0)
    at = np.flatnonzero(letter)
    h = p[at - 1] * FACTORS[0] + p[at] * FACTORS[1] + p[at + 1] * FACTORS[2]
    h ^= h >> np.uint32(15)
    bins = ((h * FACTORS[1]) >> np.uint32(16)).astype(np.int64)
    first = ~letter[at - 1]
    word = np.cumsum(first) - 1
    begins = np.cumsum([0, *(len(t) + 1 for t in points)])
    return bins, word, np.searchsorted(begins, at[first], side="right") - 1


def slices(rows: list[str]) -> Iterator[list[int]]:
    held, size = [], 0
    for i, t in enumerate(rows):
        if held and size + len(t) > SLICE_CHARS:
            yield held
            held, size = [], 0
        held.append(i)
        size += len(t)
    if held:
        yield held


def trained_counts(docs: DataFrame, train: Column, text_col: str, lang_col: str) -> DataFrame:
    """(lang, bin, n): trigram counts over all texts for which ``train`` holds and the language is known."""
    src = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("bin", pa.int32()), ("n", pa.int64())])
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            rows, langs = texts(b.column(1)), np.array(b.column(0).to_pylist(), object)
            for part in slices(rows):
                bins, word, row = trigrams([rows[i] for i in part])
                own = langs[part]
                for lang in set(own):
                    pick = (own == lang)[row[word]] if len(row) else np.zeros(0, bool)
                    found = np.bincount(bins[pick], minlength=BINS)
                    sums[lang] = sums[lang] + found if lang in sums else found
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield record_batch(schema, [lang] * len(at), at.astype(np.int32), n[at])

    return src.mapInArrow(count, "lang string, bin int, n bigint").groupBy("lang", "bin").agg(F.sum("n").alias("n"))


def packed(counts: DataFrame) -> DataFrame:
    """(lang, counts): the counts of a language's trigrams as one array of ``BINS`` 64-bit integers."""
    def pack(rows: pa.Table) -> pa.Table:
        full = np.zeros(BINS, np.int64)
        full[rows["bin"].to_numpy()] = rows["n"].to_numpy()
        return pa.table({"lang": rows["lang"][:1], "counts": pa.array([full.tobytes()], pa.binary())})

    return counts.groupBy("lang").applyInArrow(pack, "lang string, counts binary")


class Mixture:
    """Log-likelihoods of trigrams by language, and the inference of a document's languages."""

    def __init__(self, langs: list[str], table: np.ndarray, penalty: float = 1.0):
        self.langs, self.table, self.penalty = langs, table, penalty

    @classmethod
    def of(cls, counts_of: dict[str, np.ndarray], penalty: float = 1.0) -> "Mixture":
        langs = sorted(counts_of)
        counts = np.full((len(langs), BINS), SMOOTH)
        for k, lang in enumerate(langs):
            counts[k] += counts_of[lang]
        return cls(langs, np.log(counts / counts.sum(axis=1, keepdims=True)), penalty)

    def word_scores(self, bins: np.ndarray, word: np.ndarray, n_words: int) -> np.ndarray:
        """Log-likelihood of each word under each language."""
        out = np.zeros((n_words, len(self.langs)))
        for b in range(0, len(bins), BLOCK_CHARS):
            w = word[b:b + BLOCK_CHARS]
            lo, hi = int(w[0]), int(w[-1]) + 1
            for k, logs in enumerate(self.table):
                out[lo:hi, k] += np.bincount(w - lo, weights=logs[bins[b:b + BLOCK_CHARS]], minlength=hi - lo)
        return out

    @staticmethod
    def _em(like: np.ndarray, row: np.ndarray, starts: np.ndarray, size: np.ndarray, share: np.ndarray,
            rounds: int) -> tuple[np.ndarray, np.ndarray]:
        """Proportions and log-likelihood (less each word's own maximum) of every row after ``rounds`` of EM."""
        for _ in range(rounds):
            joint = like * share[row]
            joint /= joint.sum(axis=1, keepdims=True)
            share = np.add.reduceat(joint, starts, axis=0) / size[:, None]
        mixed = np.log(np.maximum((like * share[row]).sum(axis=1), 1e-300))
        return share, np.add.reduceat(mixed, starts)

    def infer(self, rows: list[str]) -> np.ndarray:
        """Proportions of the chosen languages of each row (all 0 without a letter)."""
        n_langs = len(self.langs)
        out = np.zeros((len(rows), n_langs))
        bins, word, owner = trigrams(rows)
        if not len(owner) or not n_langs:
            return out
        score = self.word_scores(bins, word, len(owner))
        top = score.max(axis=1, keepdims=True)
        like = np.exp(score - top)
        texts_at, starts, row, size = np.unique(owner, return_index=True, return_inverse=True, return_counts=True)
        single = np.add.reduceat(score - top, starts, axis=0)
        chosen = np.zeros((len(texts_at), n_langs))
        chosen[np.arange(len(texts_at)), single.argmax(axis=1)] = 1
        best = single.max(axis=1)
        full, full_like = self._em(like, row, starts, size, np.full((len(texts_at), n_langs), 1 / n_langs), ROUNDS)
        price = self.penalty * np.log(size + 1.0)  # of one language more
        # no set of several languages can be better than the full one without its price
        open_rows = np.flatnonzero(full_like - price > best)
        if len(open_rows) and n_langs > 1:
            keep = np.isin(row, open_rows)
            like, row = like[keep], np.searchsorted(open_rows, row[keep])
            size, price, best = size[open_rows], price[open_rows], best[open_rows]
            starts = np.cumsum(size) - size
            order = np.argsort(-full[open_rows], axis=1, kind="stable")
            rank = np.argsort(order, axis=1)
            for n in range(2, n_langs + 1):
                share = np.where(rank < n, np.maximum(full[open_rows], 1e-6), 0)
                share, total = self._em(like, row, starts, size, share / share.sum(axis=1, keepdims=True), REFITS)
                better = total - (n - 1) * price > best
                best = np.where(better, total - (n - 1) * price, best)
                chosen[open_rows[better]] = share[better]
        out[texts_at] = chosen
        return out


def predicted_languages(docs: DataFrame, train: Column, held_out: Column, id_col: str = "doc_id", text_col: str = "text",
                        lang_col: str = "lang", penalty: float = 1.0) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, languages) of every row, learned from the rows where ``train`` holds.

    ``score`` is the predicted language's proportion; ``languages`` lists the chosen set, largest first.
    """
    rows = packed(trained_counts(docs, train, text_col, lang_col)).collect()  # an array of 512 KB a language
    counts = {r["lang"]: np.frombuffer(r["counts"], np.int64) for r in rows}
    model = docs.sparkSession.sparkContext.broadcast(Mixture.of(counts, penalty))
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"),
                      F.col(text_col).alias("text"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixture, schema = model.value, None
        for b in batches:
            schema = schema or pa.schema([("doc_id", b.schema.field(0).type), ("held_out", pa.bool_()),
                                          ("lang_pred", pa.string()), ("score", pa.float64()), ("languages", pa.string())])
            rows = texts(b.column(2))
            for part in slices(rows):
                share = mixture.infer([rows[i] for i in part])
                best = share.argmax(axis=1) if share.shape[1] else np.zeros(len(part), np.int64)
                names, scores, sets = [], [], []
                for s, k in zip(share, best):
                    some = len(s) and s[k] > 0
                    names.append(mixture.langs[k] if some else "und")
                    scores.append(min(1.0, float(s[k])) if some else 0.0)
                    sets.append(",".join(f"{mixture.langs[i]}:{s[i]:.3f}" for i in np.argsort(-s, kind="stable") if s[i] > 0))
                yield record_batch(schema, b.column(0).slice(part[0], len(part)), b.column(1).slice(part[0], len(part)),
                                   names, scores, sets)

    return src.mapInArrow(predict, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, held_out boolean, "
                          "lang_pred string, score double, languages string")
