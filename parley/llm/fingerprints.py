"""Document fingerprints: order MinHash, signatures sensitive to edit distance.

Every k-mer of a text is numbered by its occurrence. For each of ``size`` hash functions the two least numbered
k-mers are selected, put in the order in which they stand in the text, and hashed as a tuple to one entry of the
signature. Two texts' likeness is the share of equal entries; moving text changes the order, so it lowers the likeness,
which a plain MinHash would not see.

The neighbour query puts documents in descending id order (ids are taken to be about unique): ids are cut into ranges at
quantiles, every range goes to one task, sorted, and the first document of each range is also sent to the range before it. So each text is shuffled once,
and a task holds two texts at a time. The edited text shares its first two thirds with the original, so the selection
runs over the common part, the two ends, and merges.

Defined cases: a null or empty text has the signature of zeros; a text shorter than k is one k-mer, and a lone k-mer
fills its tuple by itself; equal texts have equal signatures; rows with equal ids are ordered by a hash of their text,
a null id comes last; one row alone is its own next document. An empty table gives an empty result; other columns are
not read. Very long texts are hashed in blocks of k-mers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from parley.llm.common import record_batch

KMER, SIZE, SEED = 8, 64, 11
BLOCK = 1 << 13
RANGES_A_TASK = 8
SAMPLED = 100  # text ids a range, to cut ranges by
BASE = np.uint64(0x100000001B3)
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def kmers(points: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k code points; of a shorter text as a whole."""
    if not len(points):
        return np.zeros(0, np.uint64)
    k = min(k, len(points))
    n = len(points) - k + 1
    p = points.astype(np.uint64) + np.uint64(1)
    h = p[:n].copy()
    for i in range(1, k):
        h *= BASE
        h += p[i:i + n]
    return mixed(h)


def numbered(common: np.ndarray, ends: list[np.ndarray]) -> list[np.ndarray]:
    """32-bit codes of (k-mer, occurrence) for ``common`` and for each of ``ends`` as it goes on from ``common``."""
    every = np.concatenate([common, *ends])
    cuts = np.cumsum([len(common), *map(len, ends)])[:-1]
    # only k-mers that share a bin with another can occur twice
    bins = (every & np.uint64((1 << max(10, (4 * len(every)).bit_length())) - 1)).astype(np.int64)
    again = np.flatnonzero((np.bincount(bins) > 1)[bins])
    if len(again):
        order = again[np.argsort(every[again], kind="stable")]
        h = every[order]
        first = np.concatenate([[True], h[1:] != h[:-1]])
        run = np.cumsum(first) - 1
        rank = np.arange(len(h)) - np.flatnonzero(first)[run]
        if rank.any():
            part = np.searchsorted(cuts, order, side="right")
            for e in range(2, len(ends) + 1):  # an end goes on from the common part, not from the ends before it
                others = np.bincount(run, weights=(part > 0) & (part < e), minlength=run[-1] + 1).astype(np.int64)
                rank -= np.where(part == e, others[run], 0)
            later = rank > 0
            every[order[later]] = mixed(h[later] + rank[later].astype(np.uint64) * M2)
    return np.split((every >> np.uint64(32)).astype(np.uint32), cuts)


class Selection:
    """The two least codes of a stretch of k-mers under each hash function, packed as value << 32 | place."""

    NONE = np.uint64((1 << 64) - 1)

    def __init__(self, factors: np.ndarray, least: np.ndarray | None = None, second: np.ndarray | None = None):
        self.factors = factors
        self.least = np.full(len(factors), self.NONE) if least is None else least
        self.second = np.full(len(factors), self.NONE) if second is None else second

    def joined(self, other: "Selection") -> "Selection":
        return Selection(self.factors, np.minimum(self.least, other.least), np.minimum(
            np.maximum(self.least, other.least), np.minimum(self.second, other.second)))

    @classmethod
    def of(cls, factors: np.ndarray, codes: np.ndarray, at: int) -> "Selection":
        out, rows = cls(factors), np.arange(len(factors))
        for b in range(0, len(codes), BLOCK):
            v = codes[None, b:b + BLOCK] * factors[:, None]
            found = []
            for _ in range(min(2, v.shape[1])):
                i = v.argmin(axis=1)
                found.append(v[rows, i].astype(np.uint64) << np.uint64(32) | (i + (at + b)).astype(np.uint64))
                v[rows, i] = np.iinfo(np.uint32).max
            out = out.joined(cls(factors, *found))
        return out

    def signature(self, h: np.ndarray) -> np.ndarray:
        """One 32-bit entry a hash function: its k-mers in text order, hashed as a tuple."""
        if not len(h):
            return np.zeros(len(self.factors), np.uint32)
        low = np.uint64((1 << 32) - 1)
        one, two = self.least & low, np.where(self.second == self.NONE, self.least, self.second) & low
        first, last = np.minimum(one, two).astype(np.int64), np.maximum(one, two).astype(np.int64)
        return (mixed(h[first] * M1 + mixed(h[last])) >> np.uint64(32)).astype(np.uint32)


class OrderMinHash:
    def __init__(self, k: int = KMER, size: int = SIZE, seed: int = SEED):
        self.k = k
        self.factors = np.random.default_rng(seed).integers(0, 1 << 32, size, np.uint32) | np.uint32(1)

    def signatures(self, common: np.ndarray, ends: list[np.ndarray]) -> list[np.ndarray]:
        """The signatures of the texts ``common + end``, given as code points."""
        if len(common) >= self.k:
            shared, overlap = kmers(common, self.k), common[len(common) - self.k + 1:]
        else:
            shared, overlap = kmers(common[:0], self.k), common
        tails = [kmers(np.concatenate([overlap, e]), self.k) if len(e) or not len(shared) else shared[:0] for e in ends]
        codes = numbered(shared, tails)
        base = Selection.of(self.factors, codes[0], 0)
        return [base.joined(Selection.of(self.factors, c, len(shared))).signature(np.concatenate([shared, t]))
                for c, t in zip(codes[1:], tails)]

    def signature(self, text: str) -> np.ndarray:
        points = code_points(text)
        return self.signatures(points, [points[:0]])[0]


def hexed(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.mean(a == b))


def range_cuts(rows: DataFrame, ranges: int) -> np.ndarray:
    """Ascending ids that part the rows in about equal ranges: quantiles of integers; of text, those of the ids with the least
    hashes (``SAMPLED`` a range)."""
    if not isinstance(rows.schema["id"].dataType, StringType):
        cuts = rows.agg(F.percentile_approx("id", [i / ranges for i in range(1, ranges)], 10_000)).first()[0] if ranges > 1 else None
        return np.unique(np.array(cuts or [], np.int64))
    some = rows.where("id is not null").select("id").orderBy(F.xxhash64("id")).limit(SAMPLED * ranges).collect()
    ids = sorted({r["id"] for r in some})  # Python compares text by code points, as Spark does
    return np.array([ids[len(ids) * i // ranges] for i in range(1, ranges)] if ids else [], object)


def with_neighbours(rows: DataFrame, ranges: int) -> DataFrame:
    """``rows`` (id, text) in ranges of descending id, one task each; every range ends with a copy of the next's first.

    Ids are integers or text. Ranges are cut at approximate quantiles of the id (any cuts give the same result). The heads of the ranges, one row
    each, are all that the driver and the broadcast see.
    """
    cuts, named = range_cuts(rows, ranges), F.col("id")
    if cuts.dtype != object:
        named = F.coalesce(named.cast("bigint"), F.lit(0))

    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(len(cuts) - np.searchsorted(cuts, ids.fillna("").to_numpy(cuts.dtype), side="left"))

    rows = rows.withColumn("range", F.when(F.col("id").isNull(), F.lit(len(cuts) + 1)).otherwise(
        F.pandas_udf(place, "int")(named)))
    rows = rows.withColumn("key", F.xxhash64("text"))
    top = F.max(F.struct(F.col("id").isNotNull().alias("named"), "id", "key")).alias("top")
    heads = rows.groupBy("range").agg(top).orderBy("range").collect()  # at most ranges + 1 rows
    before = [(heads[i - 1]["range"], h["range"], h["top"]["key"]) for i, h in enumerate(heads)]
    if not before:
        return rows.withColumn("copy", F.lit(False))
    tops = rows.sparkSession.createDataFrame(
        [(to, own, key, h["top"]["id"]) for (to, own, key), h in zip(before, heads)],
        f"to int, range int, key bigint, top_id {rows.schema['id'].dataType.simpleString()}")
    copies = rows.join(F.broadcast(tops), ["range", "key"]).where(F.col("id").eqNullSafe(F.col("top_id")))
    copies = copies.select("id", "text", F.col("to").alias("range"), "key", F.lit(True).alias("copy"))
    return rows.select("id", "text", "range", "key", F.lit(False).alias("copy")).unionByName(copies)


def neighbour_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = KMER,
                           size: int = SIZE, ranges: int | None = None) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and its likeness to the edited and to the next document.

    The edited text has the last third (rounded down) of the code points replaced by the first as many of the next
    document in descending id order, whose last is followed by the first.
    """
    spark = docs.sparkSession
    ranges = ranges or RANGES_A_TASK * 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    tasks = -(-ranges // RANGES_A_TASK)  # ranges fall into tasks by hash: several a task make tasks about equal
    placed = with_neighbours(rows, ranges).repartition(tasks, "range").sortWithinPartitions(
        "range", "copy", F.desc_nulls_last("id"), F.desc("key"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, omh = None, OrderMinHash(k, size)
        last = waiting = None  # the row before; the one before that, until its next document's signature is known
        for b in batches:
            schema = schema or pa.schema([
                ("doc_id", b.schema.field(0).type), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()),
                ("near_next", pa.float64())])
            out = []
            for key, text, place, copy in zip(*(b.column(c).to_pylist() for c in ("id", "text", "range", "copy"))):
                points = code_points(text or "")
                if last and last[2] == place:
                    n = len(last[1])
                    stays, end, new_end = last[1][:n - n // 3], last[1][n - n // 3:], points[:n // 3]
                    own, edited = omh.signatures(stays, [end, new_end])
                    if waiting:
                        out.append((*waiting[0], likeness(waiting[1], own)))
                    digest = hashlib.sha256(np.concatenate([stays, new_end]).tobytes().decode(
                        "utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest()
                    waiting = ((last[0], n, digest, hexed(own), hexed(edited), likeness(own, edited)), own)
                if copy:  # the range ends here
                    if waiting:
                        out.append((*waiting[0], likeness(waiting[1], omh.signature(text or ""))))
                    last = waiting = None
                else:
                    last = (key, points, place)
            yield record_batch(schema, *(zip(*out) if out else [[]] * 7))

    return placed.mapInArrow(make, f"doc_id {id_type}, n_chars bigint, edited_sha256 string, fingerprint string, "
                             "edited_fingerprint string, near_edited double, near_next double")
