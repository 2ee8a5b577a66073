"""Spelling variant grouping: words that differ by one edit, found by probing edits against broadcast Bloom filters.

1. Words are counted per task and summed after the shuffle; those of at least ``min_length`` code points and ``min_count``
   occurrences are the vocabulary.
2. A blocked Bloom filter (one 64-bit block a word) is built per shard of the vocabulary: the words of one length, or a
   hash part of them, so that no shard passes ``shard_bytes``. Lengths beyond ``LONG`` share shards. Shards are built in
   tasks and broadcast in rounds of at most ``round_bytes``, whatever the vocabulary's size.
3. Each word's edits are probed in Arrow batches: every deletion, and every replacement by a greater code point. A pair of
   words that are one edit apart is so generated from exactly one side: an insertion is the other word's deletion. Hashes
   are polynomials, so an edit's hash follows from the word's without spelling the edit.
4. Only positives are spelled and shuffled to an exact join with the vocabulary, which removes the false ones.
5. The most frequent near word is a word's form if it is ``ratio`` times as frequent. Counts rise along forms, so chains
   have no cycles and end after log(count) steps; roots follow by pointer doubling.

The words of a pair are never expanded beyond their edits (at most about 180 a code point of the word), so no group of
words is gathered. Defined cases: a null or empty text has no words; a null id is the empty text in the checked hash;
repeated rows count again; ties of the most frequent near word go to the smallest in code-point order; words of any length
are probed in blocks of positions. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import raw_texts, record_batch, written

MODULUS, MIN_LENGTH, MIN_COUNT, RATIO = 97, 5, 3, 2
#: The code points of words after lower-casing A-Z.
LETTERS = np.array([*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)], np.uint64)
RUN = re.compile("[a-zÀ-ÿ]+")
LONG = 64
BITS_A_WORD, PROBES = 24, 4
SHARD_BYTES, ROUND_BYTES = 4 << 20, 32 << 20
HELD_WORDS, LISTED_BYTES, PROBED = 200_000, 4 << 20, 1 << 14
BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2 ** 64
UNBASE = pow(BASE, -1, 1 << 64)


def text_runs(text: bytes) -> Counter:
    """The letter runs of a UTF-8 text with A-Z lower-cased, and how often each occurs."""
    lower = text.lower().decode()  # bytes.lower: A-Z only
    if len(text) <= LISTED_BYTES:
        return Counter(RUN.findall(lower))
    return Counter(m.group() for m in RUN.finditer(lower))  # one run at a time


def observed(run: str, prefix_crc: int, modulus: int) -> str:
    """The run, without one code point where ``modulus`` divides the crc32 of document and run."""
    h = zlib.crc32(run.encode(), prefix_crc)
    if h % modulus:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = MODULUS,
               min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    src = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("word", pa.string()), ("n", pa.int64())])
        held: dict[str, int] = {}
        for b in batches:
            buf, off = raw_texts(b.column(1))
            ids = b.column(0).to_pylist()
            for i in range(len(ids)):
                prefix = zlib.crc32(f"{ids[i]}:".encode())
                for run, n in text_runs(buf[off[i]:off[i + 1]].tobytes()).items():
                    if len(run) >= min_length:
                        word = observed(run, prefix, modulus)
                        held[word] = held.get(word, 0) + n
                if len(held) > HELD_WORDS:
                    yield record_batch(schema, list(held), list(held.values()))
                    held = {}
        yield record_batch(schema, list(held), list(held.values()))

    counted = src.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where((F.col("n") >= min_count) & (F.length("word") >= min_length))


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every bit of the result hangs on every bit of ``h``."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(33))


def powers(n: int) -> np.ndarray:
    """BASE ** 0 .. BASE ** (n - 1) modulo 2 ** 64."""
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n - 1, 0), BASE, np.uint64))])[:max(n, 1)]


def spelled(words: list[str]) -> np.ndarray:
    """The code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1).astype(np.uint64)


def raw_hashes(points: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the rows of ``points``, to be mixed before use."""
    return (points * powers(points.shape[1])).sum(axis=1, dtype=np.uint64)


def length_class(n: int) -> int:
    return min(n, LONG + 1)


def mask_of(h: np.ndarray) -> np.ndarray:
    """The bits of its block that a word with the mixed hash ``h`` sets; the block's number comes from other bits."""
    out = np.zeros_like(h)
    for k in range(PROBES):
        out |= np.uint64(1) << ((h >> np.uint64(6 * k)) & np.uint64(63))
    return out


def block_of(h: np.ndarray, blocks: int) -> np.ndarray:
    """A block for each hash, from its 32 high bits."""
    return (((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)).astype(np.int64)


class Filters:
    """The Bloom filters of one round, by (length class, part), and the number of parts of every length class."""

    def __init__(self, parts: dict[int, int], blocks: dict[int, int], shards: dict[tuple[int, int], np.ndarray]):
        self.parts, self.blocks, self.shards = parts, blocks, shards
        self.lengths = {length for length, _ in shards}

    def may_hold(self, h: np.ndarray, length: int) -> np.ndarray:
        """Whether words of ``length`` with the mixed hashes ``h`` may be in one of this round's shards."""
        kind = length_class(length)
        found = np.zeros(h.shape, bool)
        parts, block, mask = self.parts[kind], block_of(h, self.blocks[kind]), mask_of(h)
        part = part_of(h, parts) if parts > 1 else None
        for p in range(parts):
            shard = self.shards.get((kind, p))
            if shard is None:
                continue
            hit = (shard[block] & mask) == mask
            found |= hit if part is None else hit & (part == p)
        return found


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    return (h * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(40)) % np.uint64(parts)


def by_length(words: list[str]) -> Iterator[tuple[int, list[str], np.ndarray]]:
    """(length, words, their places) of the words of each length."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == n)
        yield n, [words[i] for i in at.tolist()], at


def filter_shards(vocab: DataFrame, parts: dict[int, int], blocks: dict[int, int]) -> DataFrame:
    """(length, part, content): the Bloom filter of every shard, built in tasks from partial filters of words."""
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("length", pa.int32()), ("part", pa.int32()), ("block", pa.int32()), ("bits", pa.int64())])
        for b in batches:
            for n, words, _ in by_length(b.column(0).to_pylist()):
                kind = length_class(n)
                step = max(1, (1 << 20) // n)
                for i in range(0, len(words), step):
                    h = mixed(raw_hashes(spelled(words[i:i + step])))
                    part = part_of(h, parts[kind]) if parts[kind] > 1 else np.zeros(len(h))
                    yield record_batch(schema, np.full(len(h), kind, np.int32), part.astype(np.int32),
                                       block_of(h, blocks[kind]).astype(np.int32), mask_of(h).view(np.int64))

    def build(shard: pa.Table) -> pa.Table:
        kind = shard["length"][0].as_py()
        content = np.zeros(blocks[kind], np.uint64)
        np.bitwise_or.at(content, shard["block"].to_numpy(), shard["bits"].to_numpy().view(np.uint64))
        return pa.table({"length": shard["length"][:1], "part": shard["part"][:1],
                         "content": pa.array([content.tobytes()], pa.binary())})

    placed = vocab.select("word").mapInArrow(place, "length int, part int, block int, bits bigint")
    # at most `blocks` rows of a shard are left, a bounded number
    merged = placed.groupBy("length", "part", "block").agg(F.bit_or("bits").alias("bits"))
    return merged.groupBy("length", "part").applyInArrow(build, "length int, part int, content binary")


def edits(points: np.ndarray, from_: int, to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mixed hashes of the edits at positions ``from_`` to ``to`` of words of one length.

    Gives deletions [word, position], whether each is the first that leads to its result, and replacements [word,
    position, letter]; those by a letter that is not greater are not meant.
    """
    power = powers(points.shape[1])
    terms = points * power
    total = terms.sum(axis=1, dtype=np.uint64)[:, None]
    upto = np.cumsum(terms, axis=1, dtype=np.uint64)[:, from_:to]
    own, p = points[:, from_:to], power[from_:to]
    gone = mixed(upto - own * p + (total - upto) * np.uint64(UNBASE))
    first = np.ones(own.shape, bool)
    before = points[:, from_ - 1:to - 1] if from_ else points[:, :to - 1]
    first[:, 0 if from_ else 1:] = own[:, 0 if from_ else 1:] != before
    swapped = mixed((total - own * p)[:, :, None] + LETTERS * p[:, None])
    return gone, first, swapped


def probed(words: list[str], filters: Filters) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(places of words, edits that may be in the vocabulary), in blocks of bounded size."""
    for n, same, place in by_length(words):
        deletes, swaps = length_class(n - 1) in filters.lengths, length_class(n) in filters.lengths
        if not (deletes or swaps):
            continue
        width = min(n, PROBED)
        for i in range(0, len(same), max(1, PROBED // width)):
            some = same[i:i + max(1, PROBED // width)]
            points = spelled(some)
            for a in range(0, n, width):
                gone, first, swapped = edits(points, a, min(n, a + width))
                owner, made = [], []
                if deletes:
                    for w, k in np.argwhere(filters.may_hold(gone, n - 1) & first).tolist():
                        owner.append(w)
                        made.append(some[w][:a + k] + some[w][a + k + 1:])
                if swaps:
                    own = points[:, a:a + width]
                    for w, k, c in np.argwhere(filters.may_hold(swapped, n) & (LETTERS > own[:, :, None])).tolist():
                        owner.append(w)
                        made.append(some[w][:a + k] + chr(int(LETTERS[c])) + some[w][a + k + 1:])
                if owner:
                    yield place[i + np.array(owner)], made


def rounds_of(sizes: dict[tuple[int, int], int], limit: int) -> list[list[tuple[int, int]]]:
    """Shards in order, grouped so that no group has more than ``limit`` bytes (one shard alone may)."""
    out, held = [], 0
    for key in sorted(sizes):
        if not out or held + sizes[key] > limit:
            out.append([])
            held = 0
        out[-1].append(key)
        held += sizes[key]
    return out


def near_pairs(vocab: DataFrame, bits_a_word: int = BITS_A_WORD, shard_bytes: int = SHARD_BYTES,
               round_bytes: int = ROUND_BYTES) -> DataFrame:
    """(word, n, near, near_n): every pair of words of ``vocab`` (word, n; a written table) one edit apart, both ways."""
    spark = vocab.sparkSession
    kind = F.least(F.length("word"), F.lit(LONG + 1)).alias("length")
    counts = {r["length"]: r["count"] for r in vocab.groupBy(kind).count().collect()}  # at most LONG + 1 rows
    parts = {k: 1 + n * bits_a_word // (8 * shard_bytes) for k, n in counts.items()}
    blocks = {k: 1 + n * bits_a_word // (64 * parts[k]) for k, n in counts.items()}
    stored = written(filter_shards(vocab, parts, blocks))
    sizes = {(k, p): 8 * blocks[k] for k in counts for p in range(parts[k])}
    found = None
    for keys in rounds_of(sizes, round_bytes):
        a, b = keys[0], keys[-1]
        at = F.struct(F.col("length"), F.col("part"))
        rows = stored.where((at >= F.struct(F.lit(a[0]), F.lit(a[1]))) & (at <= F.struct(F.lit(b[0]), F.lit(b[1])))).collect()
        shards = {(r["length"], r["part"]): np.frombuffer(r["content"], np.uint64) for r in rows}
        filters = spark.sparkContext.broadcast(Filters(parts, blocks, shards))

        def probe(batches: Iterator[pa.RecordBatch], filters=filters) -> Iterator[pa.RecordBatch]:
            schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("near", pa.string())])
            for b in batches:
                for owner, made in probed(b.column(0).to_pylist(), filters.value):
                    owner = pa.array(owner)
                    yield record_batch(schema, b.column(0).take(owner), b.column(1).take(owner), made)

        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        positives = vocab.repartition(tasks, "word").mapInArrow(probe, "word string, n bigint, near string")
        positives = written(positives)
        found = positives if found is None else found.unionByName(positives)
    if found is None:
        found = spark.createDataFrame([], "word string, n bigint, near string")
    known = vocab.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    pairs = written(found.join(known, "near").select("word", "n", "near", "near_n"))
    return pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"),
                                          F.col("word").alias("near"), F.col("n").alias("near_n")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form), a written table without cycles: pointer doubling until nothing moves."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = written(now.join(ahead, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        moved = new.where("moved").limit(1).count()
        now = new.select("word", "root")
        if not moved:
            return now


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = MODULUS,
                      min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: float = RATIO, **filters) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of the vocabulary."""
    vocab = written(vocabulary(docs, id_col, text_col, modulus, min_length, min_count))
    best = near_pairs(vocab, **filters).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    fits = -F.col("best.less") >= F.lit(ratio) * F.col("n")
    judged = written(vocab.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")))
    ends = roots(judged.where("form is not null").select("word", "form"))
    return judged.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
