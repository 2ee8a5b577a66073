"""Suffix-array dedup: every byte inside a repeated string of ``length`` bytes, found with run-length BWT indexes.

1. Anchors. Of the 160-byte grams in a window of ``length`` bytes the one with the least hash is the window's anchor,
   so equal windows have equal anchors. The windows of one anchor lie together; the text they span is a *context* of
   at most 640 bytes. A window can only repeat in a context with the same anchor.
2. Run compression. Equal contexts of an anchor become one text with a multiplicity (a copy adds no run to a BWT). A
   multiplicity of two or more repeats every window of the context. Contexts alone with their anchor cannot repeat.
3. Index. Anchors with several different contexts are dealt over shards of about ``shard_bytes``. A shard sorts its
   suffixes, takes the BWT's runs, and samples at each run's first and last row the match with the neighbouring row.
   Matching statistics stream over each context in text order from these samples alone: inside a run the match gets
   shorter by one a byte, so a sample's match holds until the next sample reaches further. Matches of ``length`` bytes
   and more are marked.
4. An anchor with more than ``max_contexts`` different contexts (a passage in a great part of the corpus) would not fit
   a shard; its windows are counted by hash instead, pre-aggregated, so no group is gathered.
5. Marks go back to their documents by a join, and each document's remaining bytes are hashed or returned.
6. With ``report``, a smaller length, shorter repeats are found in the same pass and reported, not removed: anchors are those
   of ``report`` bytes, and a context reaches ``length - report`` bytes further, so that it holds every window of
   ``length`` bytes that starts in it. Windows of ``report`` bytes are compared only where they start in a context's own
   part, as the rest of it is another context's too.
7. With ``passages``, runs of over 50 words that stand in another row too are reported besides, whatever their bytes; nothing is
   removed for them. The 51-word windows are cut into contexts by anchors of 20 words as above. Equal contexts of two rows
   repeat as a whole; the windows of anchors with several different contexts are compared by hash, one row for each context.

Defined cases: a null or empty text has no bytes; texts shorter than ``length`` lose nothing; matches never cross
documents; equal rows are copies of each other and lose all they share, also where their ids are equal; rows are keyed
by a 64-bit hash of id and text. Very long texts are hashed in blocks. ``deduplicated`` cuts bytes, and drops a
character of which only a part is left. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import dropped, raw_texts, record_batch, row_slices, table_path, written

LENGTH, GRAM = 400, 160
#: Passages of over 50 words: 99% have 280 bytes or more (measured on the test tables).
PASSAGE_WORDS, PASSAGE_BYTES, PASSAGE_GRAM = 50, 280, 112
PASSAGE_WORD_GRAM = 20
BLOCK = 1 << 20
SHARD_BYTES, MAX_CONTEXTS = 1 << 20, 2048
BASE = 0x100000001B3
MIX = np.uint64(0x9E3779B97F4A7C15)
FIRST = 7  # symbols of 9 bits in the first sort key
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
LETTER = (np.arange(1, 257, dtype=np.uint64) * MIX) ^ (np.arange(1, 257, dtype=np.uint64) * MIX >> np.uint64(31))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * MIX
    return h ^ (h >> np.uint64(32))


def gram_hashes(b: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit polynomial hash of every ``k`` bytes, put together from hashes of powers of two."""
    part, size, out, done = b.astype(np.uint64) + np.uint64(1), 1, None, 0
    while True:
        if k & size:
            if out is None:
                out, done = part, size
            else:
                n = len(b) - done - size + 1
                out = out[:n] * np.uint64(pow(BASE, size, 1 << 64)) + part[done:done + n]
                done += size
        if done == k:
            break
        part = part[:-size] * np.uint64(pow(BASE, size, 1 << 64)) + part[size:]
        size *= 2
    return mixed(out)


def least_places(h: np.ndarray, width: int) -> np.ndarray:
    """The place of the least (hash, place) of every ``width`` hashes, by running minima from both ends of blocks."""
    n, mask = len(h), np.uint64((1 << 24) - 1)
    key = np.full(-(-n // width) * width, ~np.uint64(0))
    key[:n] = (h & ~mask) | np.arange(n, dtype=np.uint64)
    grid = key.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:n - width + 1], ahead[width - 1:n]) & mask).astype(np.int64)


def contexts(b: np.ndarray, length: int = LENGTH, gram: int = GRAM, further: int = 0) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor hash, start, bytes, windows) of the contexts of a text, block by block; each reaches ``further`` bytes beyond
    its windows, if the text does."""
    for at in range(0, len(b) - length + 1, BLOCK):
        x = b[at:at + BLOCK + length - 1]
        h = gram_hashes(x, gram)
        place = least_places(h, length - gram + 1)
        start = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        stop = np.concatenate([start[1:], [len(place)]])
        size = np.minimum(stop - start + length - 1 + further, len(b) - at - start)
        yield h[place[start]], at + start, size, stop - start


def occurrences(docs: DataFrame, length: int, gram: int, further: int = 0) -> DataFrame:
    """(anchor, context, doc, place) of every context; ``place`` packs start, bytes and windows."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, pa.int64()) for c in ("anchor", "context", "doc", "place")])
        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            buf, off = raw_texts(b.column(1))
            doc = b.column(0).to_numpy()
            out: list[list[np.ndarray]] = [[], [], [], []]
            held = 0
            for i in range(len(off) - 1):
                text = buf[off[i]:off[i + 1]]
                view = memoryview(text)
                for anchor, start, n, windows in contexts(text, length, gram, further):
                    seen = [digest(view[s:e]) for s, e in zip(start.tolist(), (start + n).tolist())]
                    out[0].append(anchor.view(np.int64))
                    out[1].append(np.array(seen, np.uint64).view(np.int64))
                    out[2].append(np.full(len(start), doc[i]))
                    out[3].append(start << 18 | n << 8 | windows)
                    held += len(start)
                if held > 100_000:
                    yield record_batch(schema, *map(np.concatenate, out))
                    out, held = [[], [], [], []], 0
            if held:
                yield record_batch(schema, *map(np.concatenate, out))

    return docs.select("doc", "text").mapInArrow(make, "anchor bigint, context bigint, doc bigint, place bigint")


def word_hashes(b: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the words of texts that lie end to end and begin at ``starts``."""
    blank, begins = SPACE[b], np.zeros(len(b) + 1, bool)
    begins[starts] = True
    first, last = ~blank, ~blank
    first[1:] &= blank[:-1] | begins[1:-1]
    last[:-1] &= blank[1:] | begins[1:-1]
    first = np.flatnonzero(first)
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    size = np.flatnonzero(last) + 1 - first
    at = np.cumsum(size) - size
    power = np.multiply.accumulate(np.full(int(size.max()), BASE, np.uint64))
    h = np.add.reduceat(LETTER[b[~blank]] * power[np.arange(int(size.sum())) - np.repeat(at, size)], at)
    return np.searchsorted(starts, first, side="right") - 1, mixed(h)


def words_of(buf: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, hash) of the words of runs of whole rows. A long text is hashed in blocks of whole words, a word longer than a
    block by itself."""
    for i, j in row_slices(off, BLOCK):
        b, parts = buf[off[i]:off[j]], []
        if len(b) <= BLOCK:
            parts.append(word_hashes(b, off[i:j] - off[i]))
        else:
            at = 0
            while at < len(b):
                stop = min(at + BLOCK, len(b))
                if stop < len(b):
                    blanks = np.flatnonzero(SPACE[b[at:stop + 1]])
                    while not len(blanks) and stop < len(b):
                        blanks = np.flatnonzero(SPACE[b[stop:stop + BLOCK]])[:1] + stop - at
                        stop = min(stop + BLOCK, len(b))
                    stop = at + int(blanks[-1]) if len(blanks) else len(b)
                if stop - at > BLOCK:
                    parts.append((np.zeros(1, np.int64), np.array([xxhash.xxh3_64_intdigest(memoryview(b[at:stop]))], np.uint64)))
                else:
                    parts.append(word_hashes(b[at:stop], np.zeros(1, np.int64)))
                at = stop + 1  # the blank after it
        row, h = map(np.concatenate, zip(*parts))
        yield row + i, h


def passage_contexts(row: np.ndarray, h: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, anchor, context, first word, windows) of the contexts of the 51-word windows that lie in one row. The first and
    the last window of a context cover all its words, so their hashes tell contexts apart."""
    words = PASSAGE_WORDS + 1
    for at in range(0, len(h) - words + 1, BLOCK):
        x, r = h[at:at + BLOCK + words - 1], row[at:at + BLOCK + words - 1]
        whole = np.flatnonzero(r[words - 1:] == r[:len(r) - words + 1])
        if not len(whole):
            continue
        grams, window = gram_hashes(x, PASSAGE_WORD_GRAM), gram_hashes(x, words)
        place = least_places(grams, words - PASSAGE_WORD_GRAM + 1)[whole]
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        start, windows = whole[first], np.diff(np.append(first, len(place)))
        context = mixed(window[start] * np.uint64(BASE) + window[start + windows - 1]) + windows.astype(np.uint64)
        yield r[start], grams[place[first]], context, at + start, windows


def passage_occurrences(docs: DataFrame) -> DataFrame:
    """(anchor, context, doc, place, new) of the contexts of 51-word windows, in words from the text's first; ``new`` is 1 for the
    first of a row's equal contexts, else 0."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, pa.int64()) for c in ("anchor", "context", "doc", "place", "new")])
        for b in batches:
            doc = b.column(0).to_numpy()
            for row, h in words_of(*raw_texts(b.column(1))):
                if not (found := list(passage_contexts(row, h))):
                    continue
                r, anchor, context, start, windows = map(np.concatenate, zip(*found))
                place = (start - np.searchsorted(row, r)) << 18 | (windows + PASSAGE_WORDS) << 8 | windows
                order = np.lexsort((context, anchor, r))
                same = [x[order][1:] == x[order][:-1] for x in (r, anchor, context)]
                new = np.ones(len(r), np.int64)
                new[order[1:][same[0] & same[1] & same[2]]] = 0
                yield record_batch(schema, anchor.view(np.int64), context.view(np.int64), doc[r], place, new)

    return docs.select("doc", "text").mapInArrow(make, "anchor bigint, context bigint, doc bigint, place bigint, new bigint")


def sought_windows(text: pa.Array, sought: pa.Array) -> pa.Array:
    """The windows (start, copies, window) of the contexts ``sought`` (start, windows, several) of each row."""
    entries = sought.flatten()
    rows = np.repeat(np.arange(len(sought)), pa.compute.fill_null(pa.compute.list_value_length(sought), 0).to_numpy())
    start, size = (entries.field(c).to_numpy().astype(np.int64) for c in ("start", "windows"))
    copies = 1 + entries.field("several").to_numpy(zero_copy_only=False).astype(np.int64)
    hashes = np.zeros(int(size.sum()), np.uint64)
    ends = np.cumsum(size)
    within = np.arange(len(hashes)) - np.repeat(ends - size, size)
    some = np.unique(rows)
    for row, h in words_of(*raw_texts(text.take(pa.array(some)))) if len(some) else ():
        low, high = np.searchsorted(rows, some[row[[0, -1]]] + np.array([0, 1])) if len(row) else (0, 0)
        if low == high:
            continue
        each = slice(ends[low] - size[low], ends[high - 1])
        base = np.searchsorted(row, np.searchsorted(some, rows[low:high])) + start[low:high]
        hashes[each] = gram_hashes(h, PASSAGE_WORDS + 1)[np.repeat(base, size[low:high]) + within[each]]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, size, len(sought)))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(
        [pa.array(np.repeat(start, size) + within), pa.array(np.repeat(copies, size)), pa.array(hashes.view(np.int64))],
        ["start", "copies", "window"]))


class RunLengthIndex:
    """The run-compressed BWT of several short texts, with the matches of each run's first and last row."""

    def __init__(self, texts: list[bytes]):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes + 1)  # a text and its end mark, which no byte equals
        self.starts = ends - sizes - 1
        n = int(ends[-1])
        symbol = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int64) + 1
        symbol[ends - 1] = 0
        left = np.repeat(ends - 1, sizes + 1) - np.arange(n)  # bytes to the text's end
        self.symbol, self.left, self.n = symbol, left, n
        self._sort(int(sizes.max()))
        self._runs()

    def _after(self, rank: np.ndarray, step: int) -> np.ndarray:
        """``rank`` of the suffix ``step`` bytes on, 0 beyond the text's end."""
        out = np.zeros_like(rank)
        out[:max(0, self.n - step)] = rank[step:]
        out[self.left <= step] = 0
        return out

    def _sort(self, longest: int) -> None:
        key = np.zeros(self.n, np.int64)
        for t in range(FIRST):
            key = key << 9 | (self.symbol if t == 0 else self._after(self.symbol, t))
        self.ranks, step = [], FIRST
        while True:  # prefix doubling: ranks by the first `step` bytes
            order = np.argsort(key)
            ordered = key[order]
            dense = np.cumsum(np.concatenate([[1], ordered[1:] != ordered[:-1]]))
            rank = np.empty(self.n, np.int64)
            rank[order] = dense
            self.ranks.append((step, rank.astype(np.int32)))
            if step >= longest or dense[-1] == self.n + 1 - len(self.starts):  # only end marks are equal
                break
            key = rank * (self.n + 1) + self._after(rank, step)
            step *= 2
        # suffixes that are equal to their texts' ends stand in the order of the texts
        self.order = np.argsort(rank * (self.n + 1) + np.arange(self.n))

    def match(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes at ``x`` and ``y`` have in common."""
        most = np.minimum(self.left[x], self.left[y])
        common = np.zeros(len(x), np.int64)
        for step, rank in reversed(self.ranks):
            a, b = np.minimum(x + common, self.n - 1), np.minimum(y + common, self.n - 1)
            common += step * ((common < most) & (rank[a] == rank[b]))
        for _ in range(FIRST - 1):
            a, b = np.minimum(x + common, self.n - 1), np.minimum(y + common, self.n - 1)
            common += (common < most) & (self.symbol[a] == self.symbol[b])
        return np.minimum(common, most)

    def _runs(self) -> None:
        before = np.empty(self.n, np.int64)
        before[1:] = self.symbol[:-1]
        before[self.starts] = -1 - np.arange(len(self.starts))  # every text has its own mark before it
        bwt = before[self.order]
        first = np.flatnonzero(bwt[1:] != bwt[:-1]) + 1  # rows that begin a run (row 0 has no row above it)
        self.runs = len(first) + 1
        low, high = self.order[first], self.order[first - 1]
        common = self.match(low, high)
        # a run's first row samples the match with the row above it, the run above its last row's with the one below
        self.sample_at = np.concatenate([low, high])
        self.sample_end = self.sample_at + np.concatenate([common, common])

    def statistics(self) -> np.ndarray:
        """For each byte, the longest match of the text from there on with any other place of the index."""
        reach = np.zeros(self.n, np.int64)
        np.maximum.at(reach, self.sample_at, self.sample_end)
        reach = np.maximum.accumulate(reach)  # a match never passes its text's end, so texts do not mix
        return np.maximum(reach - np.arange(self.n), 0)

    def window_marks(self, length: int, windows: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, start, bytes) of the repeated ``length`` bytes among those that start in the first ``windows`` places of each
        text: neighbours in the order of the suffixes that have so much in common."""
        text = np.repeat(np.arange(len(self.starts)), np.diff(np.append(self.starts, self.n)))
        rows = self.order[(np.arange(self.n) - self.starts[text] < windows[text])[self.order]]
        same = self.match(rows[1:], rows[:-1]) >= length
        hit = np.unique(np.concatenate([rows[1:][same], rows[:-1][same]]))
        for a, b in runs_in(hit, text[hit]):
            yield int(text[hit[a]]), int(hit[a] - self.starts[text[hit[a]]]), int(hit[b] - hit[a]) + length

    def marks(self, length: int) -> Iterator[tuple[int, int, int]]:
        """(text, start, bytes) of the runs of bytes in matches of ``length`` and more."""
        stat = self.statistics()
        hit = np.flatnonzero(stat >= length)
        text = np.searchsorted(self.starts, hit, side="right") - 1
        for a, b in runs_in(hit, text):
            yield int(text[a]), int(hit[a] - self.starts[text[a]]), int(hit[b] + stat[hit[b]] - hit[a])


def runs_in(hit: np.ndarray, text: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, last) entry of each run of consecutive places in the same text."""
    if len(hit):
        cut = np.flatnonzero((np.diff(hit) > 1) | (np.diff(text) > 0)) + 1
        yield from zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(hit)]]) - 1)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs [start, end) of bytes covered by (start, bytes) spans."""
    out: list[list[int]] = []
    for s, n in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s + n)
        else:
            out.append([s, s + n])
    return [(a, b) for a, b in out]


def remaining(text: memoryview, runs: list[tuple[int, int]]) -> Iterator[memoryview]:
    at = 0
    for a, b in runs:
        if a > at:
            yield text[at:a]
        at = b
    if at < len(text):
        yield text[at:]


def indexed_marks(rows: DataFrame, shards: int, length: int, report: int | None) -> DataFrame:
    """(doc, start, n, least): repeated bytes of the contexts ``rows`` (anchor, doc, start, several, windows, body), shard by
    shard, in matches of at least ``length`` and of at least ``report`` bytes."""
    def search(shard: pa.Table) -> pa.Table:
        body = shard["body"].to_pylist()
        doc, start = shard["doc"].to_numpy(), shard["start"].to_numpy()
        several = shard["several"].to_numpy(zero_copy_only=False)
        index = RunLengthIndex(body)
        found = [(doc[k], start[k] + at, n, length) for k, at, n in index.marks(length) if not several[k]]
        if report is not None:
            found += [(doc[k], start[k] + at, n, report) for k, at, n in index.window_marks(report, shard["windows"].to_numpy())
                      if not several[k]]
        cols = list(zip(*found)) if found else [[], [], [], []]
        return pa.table({k: pa.array(v, pa.int64()) for k, v in zip(("doc", "start", "n", "least"), cols)})

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(search, "doc bigint, start bigint, n bigint, least bigint")


def counted_marks(rows: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many contexts: a window that stands in two contexts is repeated."""
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, pa.int64()) for c in ("anchor", "window", "doc", "start", "copies")])
        for b in batches:
            anchor, doc, start = (b.column(i).to_numpy() for i in range(3))
            copies = 1 + b.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
            most = b.column(4).to_numpy()
            for k, body in enumerate(b.column(5)):
                if len(body.as_buffer()) < length:
                    continue
                h = gram_hashes(np.frombuffer(body.as_buffer(), np.uint8), length).view(np.int64)[:most[k]]
                n = len(h)
                yield record_batch(schema, np.full(n, anchor[k]), h, np.full(n, doc[k]), start[k] + np.arange(n),
                                   np.full(n, copies[k]))

    each = written(rows.select("anchor", "doc", "start", "several", "windows", "body").mapInArrow(
        windows, "anchor bigint, window bigint, doc bigint, start bigint, copies bigint"))
    twice = each.groupBy("anchor", "window").agg(F.sum("copies").alias("all")).where("all > 1").select("anchor", "window")
    return each.where("copies = 1").join(twice, ["anchor", "window"]).select(
        "doc", "start", *[F.lit(length).cast("bigint").alias(c) for c in ("n", "least")])


def contested_and_covered(occurring: DataFrame, max_contexts: int | None) -> DataFrame:
    """(doc, mark, sought): the spans known from copies, and the contexts to look up in an index; with ``max_contexts`` it is
    told which are crowded. Where the occurrences tell which are ``new`` in their row, copies are those of other rows only."""
    spark = occurring.sparkSession
    passing = table_path(spark), table_path(spark)  # read until ``again`` is written
    every = written(occurring, passing[0])
    by_row = "new" in every.columns
    times = F.sum("new") if by_row else F.count(F.lit(1))
    anchors = every.groupBy("anchor").agg(times.alias("rows"), F.min("context").alias("low"),
                                          F.max("context").alias("high")).where("rows > 1")
    # a table of its own, so that the join has an exchange on either side and a very frequent anchor can be split
    anchors = written(anchors.select("anchor", (F.col("low") != F.col("high")).alias("contested")), passing[1])
    again = written(every.join(anchors, "anchor"))
    for path in passing:
        dropped(spark, path)
    distinct = again.groupBy("anchor", "context").agg(
        times.alias("copies"), F.first("contested").alias("contested"),
        F.min(F.struct("doc", "place")).alias("at"))
    distinct = written(distinct.where("contested or copies > 1"))
    start, size = F.expr("shiftright(place, 18)"), F.expr("shiftright(place, 8) & 1023")
    covered = again.join(distinct.where("copies > 1").select("anchor", "context"), ["anchor", "context"]).select(
        "doc", F.struct(start.alias("start"), size.alias("n")).alias("mark"))
    contested = distinct.where("contested").select("anchor", "copies", "at.doc", "at.place")
    if by_row:  # all places of a context that stands in one row only
        contested = contested.unionByName(again.where("new = 0").join(
            distinct.where("contested and copies = 1").select("anchor", "context", "copies"), ["anchor", "context"]).select(
            "anchor", "copies", "doc", "place"))
    fields = [start.alias("start"), F.expr("place & 255").alias("windows"), (F.col("copies") > 1).alias("several")]
    if max_contexts is not None:
        crowded = written(contested.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(
            F.col("n") > max_contexts).select("anchor", F.lit(True).alias("crowded")))
        contested = contested.join(crowded, "anchor", "left")
        fields += ["anchor", size.alias("n"), F.coalesce("crowded", F.lit(False)).alias("crowded")]
    return covered.unionByName(contested.select("doc", F.struct(*fields).alias("sought")), allowMissingColumns=True)


def with_passages(rows: DataFrame, half: DataFrame) -> DataFrame:
    """``rows`` (doc, passage_marks, ...) with n_repeated_passages and n_repeated_words instead of the marks: the maximal runs of
    words in marks or in windows of ``half`` that stand in two rows."""
    each = half.select("doc", F.inline("passage_windows"))
    # a table of its own, so that the join has an exchange on either side and a very frequent window can be split
    twice = written(each.groupBy("window").agg(F.max("copies").alias("copies"), F.min("doc").alias("low"), F.max("doc").alias(
        "high")).where("copies > 1 or low != high").select("window"))
    found = each.where("copies = 1").join(twice, "window").groupBy("doc").agg(F.collect_set("start").alias("found"))
    joined = rows.join(found, "doc", "left")
    kept = [c for c in joined.columns if c not in ("doc", "found", "passage_marks")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs = [merged([(x["start"], x["n"]) for x in marks or ()] + [(s, PASSAGE_WORDS + 1) for s in starts or ()])
                    for marks, starts in zip(b.column("passage_marks").to_pylist(), b.column("found").to_pylist())]
            n = pa.array(map(len, runs), pa.int64()), pa.array([sum(e - s for s, e in r) for r in runs], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *n], [*kept, "n_repeated_passages", "n_repeated_words"])

    schema = ", ".join(f"{c} {joined.schema[c].dataType.simpleString()}" for c in kept)
    return joined.mapInArrow(count, f"{schema}, n_repeated_passages bigint, n_repeated_words bigint")


def indexed_spans(waiting: DataFrame, length: int, report: int | None, shard_bytes: int) -> DataFrame:
    """(doc, found): the repeated spans of the contexts that wait for an index."""
    rows = written(waiting.select("doc", "pending", F.inline("sought")).select(
        "anchor", "doc", "start", "several", "crowded", "windows",
        F.substring("pending", F.col("start").cast("int") + 1, F.col("n").cast("int")).alias("body")))
    size = rows.where("not crowded").agg(F.sum(F.octet_length("body"))).first()[0] or 0
    found = indexed_marks(rows.where("not crowded"), 1 + size // shard_bytes, length, report)
    for least in {length, report or length}:
        found = found.unionByName(counted_marks(rows.where("crowded"), least))
    return found.groupBy("doc").agg(F.collect_set(F.struct("start", "n", "least")).alias("found"))


def spans_of(column: pa.Array) -> list[list[tuple[int, int, int]]]:
    """(start, bytes, least) of every span of a row: its bytes lie in matches of at least ``least`` bytes. A span that a copy
    repeats as a whole is one match."""
    return [[(x["start"], x["n"], x.get("least", x["n"])) for x in row or ()] for row in column.to_pylist()]


def runs_of(spans: list[tuple[int, int, int]], length: int) -> list[tuple[int, int]]:
    """The bytes in matches of at least ``length``."""
    return merged([(a, n) for a, n, least in spans if least >= length])


def with_repeats_removed(rows: DataFrame, finish: Callable, outputs: dict[str, str], length: int = LENGTH,
                         gram: int = GRAM, shard_bytes: int = SHARD_BYTES, max_contexts: int = MAX_CONTEXTS,
                         report: int | None = None, passages: bool = False) -> DataFrame:
    """``rows`` (row, doc, text) as (row, *outputs): ``finish(text, runs)`` of each text and its repeated byte runs, and with
    ``report`` ``finish(text, runs, reported runs)``. With ``passages`` also n_repeated_passages and n_repeated_words.

    The text is shuffled once, to meet what is known of its document. Texts with contexts to look up are handed on and
    finished when the indexes have answered, all others at once.
    """
    least = min(length, report or length)
    known = contested_and_covered(occurrences(rows, least, gram, length - least), max_contexts)
    # sets, not lists: equal rows say the same, and what is left is bounded by the length of the text
    sets = [F.collect_set("mark").alias("marks"), F.collect_set("sought").alias("sought")]
    if passages:
        known = known.unionByName(contested_and_covered(passage_occurrences(rows), None).withColumnsRenamed(
            {"mark": "passage_mark", "sought": "passage_sought"}), allowMissingColumns=True)
        sets += [F.collect_set("passage_mark").alias("passage_marks"), F.collect_set("passage_sought").alias("passage_sought")]
    known = known.groupBy("doc").agg(*sets)
    more = ["passage_marks"] if passages else []
    row_type = rows.schema["row"].dataType.simpleString()
    out_type = ", ".join(f"{k} {v}" for k, v in outputs.items())

    def finished(text: memoryview, spans: list[tuple[int, int, int]]) -> tuple:
        runs = runs_of(spans, length)
        return finish(text, runs) if report is None else finish(text, runs, runs_of(spans, least))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = raw_texts(b.column("text"))
            waits = [bool(x) for x in pa.compute.fill_null(pa.compute.list_value_length(b.column("sought")), 0).to_pylist()]
            done = [None if w else finished(memoryview(buf[off[i]:off[i + 1]]), m)
                    for i, (w, m) in enumerate(zip(waits, spans_of(b.column("marks"))))]
            pending = pa.array([buf[off[i]:off[i + 1]].tobytes() if w else None for i, w in enumerate(waits)], pa.binary())
            cols = [pa.array([d and d[k] for d in done], arrow_type(v)) for k, v in enumerate(outputs.values())]
            windows = [sought_windows(b.column("text"), b.column("passage_sought"))] if passages else []
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), b.column("doc"), *cols, pending, *(b.column(c) for c in ["marks", "sought", *more]), *windows],
                ["row", "doc", *outputs, "pending", "marks", "sought", *more, *["passage_windows"] * passages])

    joined = rows.join(known, "doc", "left")
    lists = ", ".join(f"{c} {joined.schema[c].dataType.simpleString()}" for c in ["marks", "sought", *more])
    if passages:
        lists += ", passage_windows array<struct<start:bigint,copies:bigint,window:bigint>>"
    half = written(joined.mapInArrow(first, f"row {row_type}, doc bigint, {out_type}, pending binary, {lists}"))
    waiting = half.where("pending is not null")
    carried = ["doc", *more] if passages else []
    answered = waiting.select("row", "doc", "pending", "marks", *more).join(
        indexed_spans(waiting, length, report, shard_bytes), "doc", "left")

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("pending").to_pylist()
            marks = zip(spans_of(b.column("marks")), spans_of(b.column("found")))
            done = [finished(memoryview(t), m + f) for t, (m, f) in zip(texts, marks)]
            cols = [pa.array([d[k] for d in done], arrow_type(v)) for k, v in enumerate(outputs.values())]
            yield pa.RecordBatch.from_arrays([b.column("row"), *cols, *(b.column(c) for c in carried)], ["row", *outputs, *carried])

    also = "".join(f", {c} {half.schema[c].dataType.simpleString()}" for c in carried)
    late = answered.mapInArrow(second, f"row {row_type}, {out_type}{also}")
    out = half.where("pending is null").select("row", *outputs, *carried).unionByName(late)
    return with_passages(out, half) if passages else out


def arrow_type(name: str) -> pa.DataType:
    return {"bigint": pa.int64(), "string": pa.string()}[name]


def whole_words(text: memoryview, a: int, b: int) -> int:
    """Words of the text (parted by ASCII white space) that lie in [a, b) as a whole."""
    words = bytes(text[a:b]).split()
    inner = bytes(text[max(a - 1, 0):a] if a else b" ").isspace(), bytes(text[b:b + 1] or b" ").isspace()
    cut = sum(not free and not bytes([text[k]]).isspace() for free, k in zip(inner, (a, b - 1)))
    return max(len(words) - cut, 0)


def digest_of(text: memoryview, runs: list[tuple[int, int]], reported: list[tuple[int, int]] | None = None) -> tuple:
    h = hashlib.sha256()
    for part in remaining(text, runs):
        h.update(part)
    out = len(text), sum(b - a for a, b in runs), len(runs), h.hexdigest()
    if reported is None:
        return out
    passages = [n for n in (whole_words(text, a, b) for a, b in reported) if n > PASSAGE_WORDS]
    return *out, len(passages), sum(passages)


def text_of(text: memoryview, runs: list[tuple[int, int]]) -> tuple[str]:
    return (b"".join(remaining(text, runs)).decode("utf-8", "ignore"),)


def repeat_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row. With ``report`` also n_passages and n_passage_words: runs
    of bytes in repeated strings of ``report`` bytes and more (``PASSAGE_BYTES``) that hold over ``PASSAGE_WORDS`` whole words;
    nothing is removed for them. With ``passages`` also n_repeated_passages and n_repeated_words: maximal runs of words, and
    their words, covered by sequences of over ``PASSAGE_WORDS`` words that also stand in another row; nothing is removed for
    these either."""
    rows = docs.select(F.struct(F.col(id_col).alias("doc_id")).alias("row"), F.xxhash64(id_col, text_col).alias("doc"),
                       F.col(text_col).alias("text"))
    outputs = {"n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"}
    if how.get("report"):
        outputs |= {"n_passages": "bigint", "n_passage_words": "bigint"}
    passages = ["n_repeated_passages", "n_repeated_words"] if how.get("passages") else []
    return with_repeats_removed(rows, digest_of, outputs, **how).select("row.doc_id", *outputs, *passages)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with the repeated bytes gone from its texts (``n_chars``, if there, follows); a null text stays null."""
    others = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others], F.col(text_col).isNull().alias("__null")).alias("row"),
                       F.xxhash64(id_col, text_col).alias("doc"), F.col(text_col).alias("text"))
    out = with_repeats_removed(rows, text_of, {"__text": "string"}, **how)
    text = F.when(~F.col("row.__null"), F.col("__text"))

    def column(c: str) -> F.Column:
        if c == text_col:
            return text.alias(c)
        if c == "n_chars":
            return F.coalesce(F.length(text), F.col("row.n_chars")).cast(docs.schema[c].dataType).alias(c)
        return F.col(f"row.`{c}`").alias(c)

    return out.select(*[column(c) for c in docs.columns])
