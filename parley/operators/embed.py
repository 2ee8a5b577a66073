"""Text embedding.

* :func:`embed` is the model plug-in point: an iterator ``pandas_udf``; the encoder is created once
  per Python worker (module cache keyed by the factory) and fed Arrow batches in chunks of
  ``batch`` texts. Filter first: Catalyst does not move filters below a Python UDF.
* :func:`hash_unit` is the default offline encoder (feature hashing of lower-case ASCII word tokens into ``dim`` buckets
  by MD5), one Python pass per Arrow batch, with a per-worker word -> bucket table (each word is hashed once per
  worker); counting is one ``bincount`` and normalising one division.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions.messages import embed_test  # noqa: F401  (E2 lives with the column functions)

DEFAULT_DIM = 64
_TOKEN = re.compile(r"[a-z]+")
_ENCODERS: dict = {}
_VOCAB: dict[int, dict[str, int]] = {}  # per worker: dim -> word -> bucket
_VOCAB_MAX = 100_000  # words: about 15 MB a worker
_TEXTS_AT_ONCE = 512  # texts whose tokens are held together


def _bucket(word: str, dim: int) -> int:
    return int(hashlib.md5(word.encode("utf-8")).hexdigest()[:6], 16) % dim


def _vocab(words: list[str], dim: int) -> dict[str, int]:
    """The worker's word -> bucket table, extended with the words it has not seen (hashed once)."""
    table = _VOCAB.setdefault(dim, {})
    if len(table) > _VOCAB_MAX:
        table.clear()
    for w in set(words).difference(table):
        table[w] = _bucket(w, dim)
    return table


def _unit_rows(texts: pd.Series, dim: int) -> np.ndarray:
    """Unit vectors of token counts a text, one row each; all-zero stays all-zero. The tokens of ``_TEXTS_AT_ONCE`` texts
    are held at a time, not those of the whole Arrow batch."""
    out = np.zeros((len(texts), dim))
    for k in range(0, len(texts), _TEXTS_AT_ONCE):
        out[k:k + _TEXTS_AT_ONCE] = _unit_chunk(texts.iloc[k:k + _TEXTS_AT_ONCE], dim)
    return out


def _unit_chunk(texts: pd.Series, dim: int) -> np.ndarray:
    # tokenise every text, hash each distinct token once, count with one bincount over (row, bucket)
    n = len(texts)
    toks = [_TOKEN.findall(t.lower()) if isinstance(t, str) else [] for t in texts]
    lens = np.fromiter((len(x) for x in toks), dtype=np.int64, count=n)
    flat = [w for x in toks for w in x]
    if not flat:
        return np.zeros((n, dim))
    table = _vocab(flat, dim)
    buckets = np.fromiter(map(table.__getitem__, flat), dtype=np.int64, count=len(flat))
    rows = np.repeat(np.arange(n, dtype=np.int64), lens)
    counts = np.bincount(rows * dim + buckets, minlength=n * dim).reshape(n, dim).astype(np.float64)
    norms = np.sqrt(np.einsum("ij,ij->i", counts, counts))[:, None]
    return np.divide(counts, norms, out=counts, where=norms > 0)


def hash_unit(col: Column | str, dim: int = DEFAULT_DIM, single: bool = True) -> Column:
    """Unit vector of token counts per MD5 bucket (``array<float>`` or ``array<double>``); null text -> null."""
    kind = T.FloatType() if single else T.DoubleType()

    @F.pandas_udf(T.ArrayType(kind))
    def _units(texts: pd.Series) -> pd.Series:
        rows = _unit_rows(texts, dim).astype(np.float32 if single else np.float64)
        return pd.Series([r if p else None for r, p in zip(rows, texts.notna())], dtype=object)

    return _units(F.col(col) if isinstance(col, str) else col)


def embed_hashing(df: DataFrame, text_col: str = "content", out_col: str = "embedding",
                  dim: int = DEFAULT_DIM) -> DataFrame:
    """E3 as an encoder: dense, L2-normalised feature-hash vectors."""
    return df.withColumn(out_col, hash_unit(text_col, dim))


def embed_hashing_long(df: DataFrame, key_cols: list[str], text_col: str, dim: int = DEFAULT_DIM) -> DataFrame:
    """E3 in long form: ``key_cols, k, v`` for every non-zero bucket, ``v = round(n / ||n||, 6)``."""
    units = df.select(*key_cols, hash_unit(text_col, dim, single=False).alias("_unit"))
    return units.select(*key_cols, F.posexplode("_unit").alias("k", "v")).filter(F.col("v") > 0) \
        .select(*key_cols, F.col("k").cast("bigint").alias("k"), F.round("v", 6).alias("v"))


def worker_encoder(name: str, factory: Callable[[], object]):
    """The worker's encoder of that name, made once. A function of the module, so every task of a worker sees one cache."""
    if name not in _ENCODERS:
        _ENCODERS[name] = factory()
    return _ENCODERS[name]


def embed(df: DataFrame, encoder_factory: Callable[[], object], text_col: str = "content",
          out_col: str = "embedding", batch: int = 100, name: str | None = None) -> DataFrame:
    """``encoder_factory()`` must return an object with ``encode(list[str]) -> array-like``. ``name`` tells
    encoders of one factory (say, of several models) apart in a worker's cache. A null text has no vector, as in
    :func:`hash_unit`."""
    name = name or f"{encoder_factory.__module__}.{encoder_factory.__qualname__}"

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def _encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = worker_encoder(name, encoder_factory)
        for texts in batches:
            there = texts.notna()
            vals = texts[there].tolist()
            vecs = []
            for s in range(0, len(vals), batch):
                vecs.extend(np.asarray(enc.encode(vals[s:s + batch]), dtype=np.float32))
            out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
            out[there] = pd.Series(vecs, index=texts.index[there], dtype=object)
            yield out

    return df.withColumn(out_col, _encode(F.col(text_col)))


class FirstCharsEncoder:
    """E2 as an E1 plug-in: code points of the first four characters (blank-padded), mod 10, in tenths."""

    width = 4

    def encode(self, texts):
        heads = [t[:self.width].ljust(self.width, " ") for t in texts]
        codes = np.array([list(map(ord, h)) for h in heads], dtype=np.int64).reshape(len(heads), self.width)
        return (codes % 10).astype(np.float64) * 0.1
