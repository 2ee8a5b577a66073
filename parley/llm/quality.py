"""Quality rules: base counts of each text, and line frequency across the documents of a host.

Lines are normalised (lower case, white space runs to one space) and hashed. A line that stands in more than
``max(min_docs, host_share * documents of the host)`` distinct documents of a host, or in more than ``max_docs`` if that is
given (the share alone grows with the host), is boilerplate there and is removed;
a document that loses more than ``1 - min_kept_share`` of its words this way is depleted and rejected. Equal texts of a
host count as one document, so exact copies alone (the near-dedup's business) do not turn their lines into boilerplate.

Counts start as one row per (host, line) and task and are summed before and after the shuffle, so a line in a third of all documents is
never gathered. Everything derived from a text is joined by (host, md5 of the text), with one row a text on one side.

Defined cases: a null or empty text has zero words and fails the base rules; a null host is the host ``""``; repeated
rows get equal results; lines without a word are neither counted nor removed. An empty table gives an empty result;
other columns are not read, and ``good_documents`` returns them untouched (but for ``text`` and ``n_chars``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import kept, record_batch, texts, unused

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 50
    max_repeat_percent: int = 50
    min_docs: int = 5            # a line in fewer documents of a host is never boilerplate
    host_share: float = 0.05     # nor one in a smaller share of the host's documents
    min_kept_share: float = 0.5  # of a document's words
    max_docs: int | None = None  # a line in more documents of a host is boilerplate whatever the host's size


RULES = QualityRules()


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text."""
    raw = text.encode()
    words = raw.split()  # bytes: exactly the six ASCII white space characters
    n_spaces = len(raw) - len(raw.translate(None, SPACES))
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    windows = list(zip(words, words[1:], words[2:]))
    distinct = set(windows)
    n_repeat = 0
    if len(distinct) < len(windows):
        once, twice = set(), set()
        for w in windows:
            (twice if w in once else once).add(w)
        covered = bytearray(len(words))
        for i, w in enumerate(windows):
            if w in twice:
                covered[i] = covered[i + 1] = covered[i + 2] = 1
        n_repeat = sum(covered)
    return len(words), len(text) - n_spaces, n_symbols, len(lines) - len(set(lines)), n_repeat


def line_hash(words: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b" ".join(words)) - (1 << 63)


def hashed_lines(text: str) -> dict[int, int]:
    """Words of the text by hash of their normalised line."""
    found: dict[int, int] = {}
    for line in text.lower().encode().split(b"\n"):
        words = line.split()
        if words:
            h = line_hash(words)
            found[h] = found.get(h, 0) + len(words)
    return found


def without_lines(text: str, hashes: set[int]) -> str:
    """The text's lines, but for those whose normalised form hashes to one of ``hashes``."""
    return "\n".join(x for x in text.split("\n")
                     if not (words := x.lower().encode().split()) or line_hash(words) not in hashes)


def identity(text: F.Column) -> F.Column:
    return F.coalesce(F.md5(text), F.lit(""))


def text_stats(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """(doc_id, host, text_key, base counts, lines) of every row, written once."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(host_col), F.lit("")).alias("host"),
                      identity(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for b in batches:
            schema = schema or pa.schema(
                [("doc_id", b.schema.field(0).type), ("host", pa.string()), ("text_key", pa.string())]
                + [(c, pa.int64()) for c in counts]
                + [("lines", pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int64())])))])
            rows = texts(b.column(3))
            stats = [base_counts(t) for t in rows] or [()] * 5
            found = [hashed_lines(t) for t in rows]
            ends = np.cumsum([0, *map(len, found)])
            line, words = (np.fromiter(chain.from_iterable(x), np.int64, ends[-1])
                           for x in (found, (f.values() for f in found)))
            lines = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
                [pa.array(line), pa.array(words)], ["line", "words"]))
            yield record_batch(schema, b.column(0), b.column(1), b.column(2),
                               *(zip(*stats) if rows else [[]] * 5), lines)

    return kept(src.mapInArrow(make, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, host string, "
                               f"text_key string, {', '.join(f'{c} bigint' for c in counts)}, "
                               "lines array<struct<line: bigint, words: bigint>>"))


def removed_lines(stats: DataFrame, rules: QualityRules = RULES) -> DataFrame:
    """(host, text_key, removed_words, removed): what line frequency takes from each distinct text of a host."""
    each = stats.groupBy("host", "text_key").agg(F.first("lines").alias("lines"))
    lines = each.select("host", "text_key", F.inline("lines"))
    sizes = each.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    frequent = F.col("docs") > F.lit(rules.host_share) * F.col("host_docs")
    if rules.max_docs is not None:
        frequent = frequent | (F.col("docs") > rules.max_docs)
    often = (lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") > rules.min_docs)
             .join(sizes, "host").where(frequent).select("host", "line"))
    return lines.join(often, ["host", "line"]).groupBy("host", "text_key").agg(
        F.sum("words").alias("removed_words"), F.collect_set("line").alias("removed"))


def verdicts(stats: DataFrame, rules: QualityRules = RULES) -> DataFrame:
    """``stats`` with base_failed, kept, removed_words and the hashes of the lines to remove."""
    out = stats.drop("lines").join(removed_lines(stats, rules), ["host", "text_key"], "left")
    words, gone = F.col("n_words"), F.coalesce("removed_words", F.lit(0))
    failed = (words < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * words)
    return (out.withColumn("removed_words", gone).withColumn("base_failed", failed)
            .withColumn("kept", ~failed & (words - F.col("removed_words") >= rules.min_kept_share * words)))


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                     rules: QualityRules = RULES) -> DataFrame:
    """One row a document: its base counts, whether the base rules fail it, words lost to frequent lines, the verdict."""
    return verdicts(text_stats(docs, id_col, text_col, host_col), rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words", "base_failed",
        "kept")


def strip_lines(text: pd.Series, removed: pd.Series) -> pd.Series:
    return pd.Series([t if r is None or t is None else without_lines(t, set(r)) for t, r in zip(text, removed)],
                     dtype=object)


def good_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                   rules: QualityRules = RULES) -> DataFrame:
    """The documents that are kept, all columns, without their frequent lines (``n_chars``, if there, follows)."""
    host, key, gone = unused(docs, "__host", "__key", "__removed")
    judged = verdicts(text_stats(docs, id_col, text_col, host_col), rules).where("kept").groupBy("host", "text_key").agg(
        F.first("removed").alias(gone)).withColumnsRenamed({"host": host, "text_key": key})
    rows = docs.select("*", F.coalesce(F.col(host_col), F.lit("")).alias(host), identity(F.col(text_col)).alias(key))
    rows = rows.join(judged, [host, key])
    rows = rows.withColumn(text_col, F.pandas_udf(strip_lines, "string")(F.col(text_col), F.col(gone)))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        rows = rows.withColumn("n_chars", F.when(F.col(gone).isNull(), F.col("n_chars"))
                               .otherwise(F.length(text_col)).cast(kind))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
