"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked at a small Hamming distance, joined to groups.

Fingerprints are made per document in Arrow batches. Only distinct fingerprints are compared (copies collapse first).
Two fingerprints within ``radius`` bits agree on at least ``blocks - radius`` of ``blocks`` equal blocks, so each goes
to one tile group per choice of agreeing blocks; inside a group, tiles sorted by population count are compared exactly
with numpy exclusive-or and bit counts, and tile pairs whose population counts differ beyond the radius are skipped.
With 8 blocks and radius 2 a group fixes 48 of 64 bits, so no group holds more than 65,536 fingerprints, at any size of
the corpus. Each task hands on a spanning forest of its links; groups over all tasks follow from alternating star
contraction (only joins and minima, checkpointed each round).

Defined cases: null and empty texts have fingerprint zero and link like any other; repeated rows share a group; rows
with a null id get the smallest other id of their group (null if it has none). An empty table gives an empty result;
other columns are not read, and ``one_of_each_group`` returns them untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import kept, raw_texts, record_batch, unused

SHINGLE_WORDS, RADIUS, SEED, BLOCKS = 3, 2, 42, 8
TILE = 1024
HASH_CHUNK = 1 << 15


def fingerprint(text: bytes, shingle: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """SimHash of a text: bit b is 1 if it is set in over half of the shingles' XXH64."""
    words = text.lower().split()  # bytes: A-Z only, and the ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    spans = list(zip(starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist()))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(spans), HASH_CHUNK):
        h = np.array([digest(joined[a:e], seed) for a, e in spans[at:at + HASH_CHUNK]], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(spans), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS,
                 seed: int = SEED) -> DataFrame:
    """(doc_id, text_key, fp) of every row; ``fp`` is the fingerprint as a signed integer, ``text_key`` a text hash."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"),
                      F.col(text_col).alias("text"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for b in batches:
            schema = schema or pa.schema([("doc_id", b.schema.field(0).type), ("text_key", pa.int64()),
                                          ("fp", pa.int64())])
            buf, off = raw_texts(b.column(2))
            fp = np.fromiter((fingerprint(buf[off[i]:off[i + 1]].tobytes(), shingle, seed) for i in range(len(off) - 1)),
                             np.uint64, len(off) - 1)
            yield record_batch(schema, b.column(0), b.column(1), pa.array(fp.view(np.int64)))

    return src.mapInArrow(make, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, text_key bigint, fp bigint")


def block_masks(radius: int, blocks: int) -> list[int]:
    """For each choice of ``radius`` free blocks, the mask of the bits that must agree."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    full = (1 << 64) - 1
    return [full ^ sum(block[i] for i in free) for free in combinations(range(blocks), radius)]


def tile_links(fp: np.ndarray, radius: int, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of ``fp`` within ``radius`` bits: tiles in order of population count, far tiles skipped."""
    ones = np.bitwise_count(fp)
    order = np.argsort(ones, kind="stable")
    fp, ones = fp[order], ones[order].astype(np.int64)
    left, right = [], []
    for i in range(0, len(fp), tile):
        a, top = fp[i:i + tile], ones[min(i + tile, len(fp)) - 1]
        for j in range(i, len(fp), tile):
            if ones[j] - top > radius:
                break
            near = np.bitwise_count(a[:, None] ^ fp[None, j:j + tile]) <= radius
            x, y = np.nonzero(np.triu(near, 1) if i == j else near)
            left.append(a[x])
            right.append(fp[j + y])
    return (np.concatenate(left), np.concatenate(right)) if left else (fp[:0], fp[:0])


class Forest:
    """Union-find over the links of one task; the smaller value is the root."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up, root = self.up, x
        while up.get(root, root) != root:
            root = up[root]
        while up.get(x, x) != root:
            up[x], x = root, up[x]
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            a, b = min(a, b), max(a, b)
            self.up.setdefault(a, a)
            self.up[b] = a

    def edges(self) -> tuple[list[int], list[int]]:
        nodes = [x for x in self.up if self.find(x) != x]
        return nodes, [self.find(x) for x in nodes]


def links(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, forest_nodes: int = 500_000) -> DataFrame:
    """(u, v): a spanning forest of the links of the distinct fingerprints in column ``fp``."""
    signed = [m - (1 << 64) if m >> 63 else m for m in block_masks(radius, blocks)]
    keys = F.explode(F.array(*[F.struct(F.lit(i).cast("tinyint").alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("agree"))
                               for i, m in enumerate(signed)]))
    rows = fps.select("fp", keys.alias("k")).select("k.choice", "k.agree", "fp")
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "choice", "agree").sortWithinPartitions("choice", "agree")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
        forest, rest = Forest(), None

        def group(fp: np.ndarray) -> None:
            a, b = tile_links(fp.view(np.uint64), radius)
            for x, y in zip(a.view(np.int64).tolist(), b.view(np.int64).tolist()):
                forest.join(x, y)

        for b in batches:
            if not b.num_rows:
                continue
            c = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            c = [np.concatenate([r, x]) for r, x in zip(rest, c)] if rest else c
            cut = np.flatnonzero((c[0][1:] != c[0][:-1]) | (c[1][1:] != c[1][:-1])) + 1
            last = int(cut[-1]) if len(cut) else 0
            bounds = np.concatenate([[0], cut])
            for k in np.flatnonzero(np.diff(bounds) > 1):
                group(c[2][bounds[k]:bounds[k + 1]])
            rest = [x[last:] for x in c]  # the last group may go on in the next batch
            if len(forest.up) > forest_nodes:
                yield record_batch(schema, *forest.edges())
                forest = Forest()
        if rest and len(rest[2]) > 1:
            group(rest[2])
        yield record_batch(schema, *forest.edges())

    return rows.mapInArrow(compare, "u bigint, v bigint")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each connected component, by alternating large and small stars.

    A node without edges is not in the result. Rounds needed grow with the logarithm of a component's diameter.
    """
    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = kept(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = mark(e)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = kept(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        now = mark(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS,
            radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, text_key, fp, first) of every row; ``first`` is the (id, text hash) of its group's first document."""
    fp = kept(fingerprints(docs, id_col, text_col, shingle))
    own = fp.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")).alias("own"))
    roots = components(links(own.select("fp"), radius, blocks))
    own = own.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = own.groupBy("root").agg(F.min("own").alias("first"))
    groups = kept(own.select("fp", "root").join(least, "root").select("fp", "first"))
    return fp.join(groups, "fp")


def near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row: hex fingerprint and the smallest id reachable by links."""
    return grouped(docs, **how).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                                       F.col("first.doc_id").alias("component_id"))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs``, all columns, with one document of each group of near duplicates: its smallest id
    (rows without id last; of rows that share an id, the one with the smallest text hash; of equal rows any one)."""
    name, key = unused(docs, "__id", "__key")
    stay = grouped(docs, id_col, text_col, **how).select(
        F.coalesce(F.col("first.doc_id").cast("string"), F.lit("")).alias(name),
        F.col("first.text_key").alias(key)).distinct()
    rows = docs.select("*", F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias(name), F.xxhash64(text_col).alias(key))
    return rows.join(stay, [name, key]).dropDuplicates([name, key]).drop(name, key)
