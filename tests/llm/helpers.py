"""Awkward documents that every operator must take: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

WORDS = "the quick brown fox jumps over lazy dogs while seven wizards mix strong potions near old stone walls".split()
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(seed: int, n_words: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "ed", "s"]) for _ in range(n_words))


def messy_rows() -> list[tuple]:
    long_text = prose(1, 6000)
    rows = [
        (1, prose(2, 120), "en", "a", 1), (2, prose(2, 120), "en", "b", 1), (2, prose(2, 120), "en", "b", 1),
        (3, None, "en", "a", None), (4, "", None, "a", 0), (5, "   \n\t ", "de", None, 5), (None, prose(3, 90), None, None, 7),
        (None, None, None, None, None), (6, long_text, "en", "a", 1), (7, "x" * 5000, "fr", "a", 5000),
        (8, "naïve Über — 漢字 \U0001f600 <|endoftext|> it's", "de", "c", 1), (9, "a\x00b", "de", "c", 3),
        (10, prose(2, 120) + "\n" + prose(4, 80), "fr", "c", 1), (-5, "word", "fr", "d", 4),
    ]
    return rows


def messy(spark, extra: bool = True):
    """The rows, with extra columns whose names operators use inside themselves."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(messy_rows(), SCHEMA)
    if extra:
        for name in ("fp", "doc", "anchor", "range", "id", "row", "host", "line", "domain", "tokens", "shard", "label",
                     "__id", "__key", "__host", "__removed", "__times", "__lang", "text_key", "n", "part"):
            df = df.withColumn(name, F.lit(name))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
