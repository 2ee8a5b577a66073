"""The corpus pipeline: documents through quality rules, near-dedup, suffix dedup, mixing and packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns
of documents; the last returns where each piece of each document is packed.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from parley.llm import mixing, packing, quality, simhash, suffix_dedup
from parley.llm.common import table, written
from parley.session import prepare

#: The share of a host alone would let a line stand in any number of a large host's documents.
QUALITY = replace(quality.RULES, max_docs=1000)

#: One epoch, and no source left out.
MIX = replace(mixing.MIX, max_epochs=1, weights={
    level: {name: w for name, w in given.items() if w} for level, given in mixing.MIX.weights.items()})


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the lines that are frequent in their host are gone from the rest."""
    prepare(spark)
    return quality.good_documents(docs, rules=QUALITY)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    prepare(spark)
    return simhash.one_of_each_group(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes in repeated strings of 280 bytes and more are gone: passages of over 50 words, 99% of which are that long."""
    prepare(spark)
    return suffix_dedup.deduplicated(docs, length=suffix_dedup.PASSAGE_BYTES, gram=suffix_dedup.PASSAGE_GRAM)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; one epoch, so that no document comes twice after the near-dedup."""
    prepare(spark)
    return mixing.mixed_documents(docs, mix=MIX)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document in a sequence of at most 4,096 tokens."""
    prepare(spark)
    return packing.pack_documents(docs)


STAGES = [("quality_rules", quality_rules), ("simhash_near_dedup", near_dedup), ("suffix_dedup", repeats),
          ("mixing", mix), ("best_fit_packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
