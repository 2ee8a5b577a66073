"""Token-ID output: documents as token ids in compressed files, a wavelet matrix a shard, and everything read back from them.

Documents are range partitioned by id (text hash for equal ids), sorted and tokenised; each partition writes one file. A row
of a file is a shard: its documents (ids, lengths), the number of ids before it in the partition, and a wavelet matrix of all
its ids. Spark writes the files, so a lost task leaves none behind and any store that Spark reaches will do. Global places
follow from the totals of the partitions, one row each.

From the files alone: ``documents_of`` (ids of every document), ``token_digests`` (places and checksums), ``count_tokens``
(rank), ``find_tokens`` (select) and ``tokens_at`` (access). The last three read single blocks of the planes and never
decode a shard.

Tokenising: the byte-level vocabulary treats the pieces of its pattern independently. Pieces are cut for many texts at
once by character classes, equal pieces are merged, and only pieces not seen before go through the tokenizer's model.
Texts with characters whose class is not the same in every Unicode version, or with ``<|``, go through the whole tokenizer.

Defined cases: a null or empty text is the end id alone; rows with equal ids lie in the order of their texts' hashes, null
ids first; texts of any length are tokenised in parts cut at single spaces; a document is never split over shards. An empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.llm.common import raw_texts, record_batch, row_slices
from parley.llm.packing import BYTE_LETTERS
from parley.llm.wavelet import WaveletMatrix
from parley.session import shared_dir

END_ID = 0
SHARD_TOKENS = 1 << 20
SLICE_BYTES, PART_CHARS = 4 << 20, 1 << 21
CACHE_BYTES = 48 << 20

LETTER, NUMBER, SPACE, OTHER, UNSURE = range(5)
#: What the vocabulary's pattern sees as white space.
SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: What follows an apostrophe in the pattern's contractions.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
SINGLE_SPACE = re.compile(r"(?<=[!-~]) (?=[!-~])")


@cache
def classes() -> np.ndarray:
    """The class of every code point; UNSURE where it has changed since Unicode 3.2, or is not assigned there."""
    def kind(name: str, point: int) -> int:
        if point in spaces:
            return SPACE
        return {"L": LETTER, "N": NUMBER}.get(name[0], UNSURE if name in ("Cn", "Cs") else OTHER)

    spaces, out = set(SPACES), np.full(0x110000, UNSURE, np.uint8)
    for point in range(0x30000):
        c = chr(point)
        now, then = kind(unicodedata.category(c), point), kind(unicodedata.ucd_3_2_0.category(c), point)
        out[point] = now if now == then else UNSURE
    return out


class Pieces:
    """The ids of pieces seen before; forgotten when they pass ``CACHE_BYTES``."""

    def __init__(self):
        self.keys, self.flat = pa.array([], pa.binary()), np.zeros(0, np.uint32)
        self.first, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def of(self, keys: pa.Array, make) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where those of each key begin, how many it has); ``make`` gives the ids of a key not seen before."""
        if self.keys.nbytes + self.flat.nbytes > CACHE_BYTES:
            self.__init__()
        at = pc.index_in(keys, value_set=self.keys)
        if at.null_count:
            new = keys.filter(at.is_null())
            found = [make(key) for key in new.to_pylist()]
            lengths = np.fromiter(map(len, found), np.int32, len(found)) >> 2
            self.first = np.append(self.first, len(self.flat) + np.cumsum(lengths, dtype=np.int32) - lengths)
            self.lengths = np.append(self.lengths, lengths)
            self.flat = np.append(self.flat, np.frombuffer(b"".join(found), "<u4"))
            places = at.is_null().to_numpy(zero_copy_only=False)
            at = at.fill_null(0).to_numpy().copy()
            at[places] = len(self.keys) + np.arange(len(new))
            self.keys = pa.concat_arrays([self.keys, new])
        else:
            at = at.to_numpy()
        return self.flat, self.first[at], self.lengths[at]


class Encoder:
    """Ids of many texts at once, equal to the tokenizer's."""

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.classes, self.end_id = self.tokenizer.model, classes(), end_id
        self.known = {"latin-1": Pieces(), "utf-32-le": Pieces()}

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def piece(self, key: bytes, code: str) -> bytes:
        """The ids of a piece, given by the bytes of its characters in ``code``, as bytes."""
        spelled = key.decode(code).encode().decode("latin-1").translate(BYTE_LETTERS)
        return np.array([t.id for t in self.model.tokenize(spelled)], "<u4").tobytes()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has)."""
        text = "".join(texts)
        if not text:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        try:
            code, points = "latin-1", np.frombuffer(text.encode("latin-1"), np.uint8)
        except UnicodeEncodeError:
            code, points = "utf-32-le", np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kind = self.classes[points]
        odd = np.flatnonzero(kind == UNSURE)
        if "<|" in text:
            odd = np.concatenate([odd, np.flatnonzero((points[:-1] == ord("<")) & (points[1:] == ord("|")))])
        if len(odd):
            slow = set(np.unique(np.searchsorted(ends, odd, side="right")).tolist())
            ids, counts = self.encode(["" if i in slow else t for i, t in enumerate(texts)])
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for i in slow:
                parts[i] = self.whole(texts[i])
                counts[i] = len(parts[i])
            return np.concatenate(parts), counts
        start = np.flatnonzero(self.starts(points, kind, ends))
        offsets = np.append(start, len(points)).astype(np.int32) * np.int32(points.itemsize)
        pieces = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(points)])
        coded = pieces.dictionary_encode()
        flat, first, lengths = self.known[code].of(coded.dictionary, lambda key: self.piece(key, code))
        at = coded.indices.to_numpy()
        n = lengths[at]
        upto = np.cumsum(n, dtype=np.int32)
        places = np.repeat(first[at] - (upto - n).astype(np.int32), n)
        places += np.arange(len(places), dtype=np.int32)
        last = np.concatenate([[0], upto])[np.searchsorted(start, ends)]
        return flat[places], np.diff(last, prepend=0).astype(np.int64)

    @staticmethod
    def starts(points: np.ndarray, kind: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where the pattern's pieces begin: runs of letters, numbers or other signs with the space before them, the rest of
        white space, and contractions where an apostrophe begins a piece."""
        border = np.concatenate([[0], ends[:-1]])
        border = border[border < len(points)]  # where texts begin
        blank, space = kind == SPACE, points == 0x20
        out = np.empty(len(points), bool)
        out[0] = True
        np.not_equal(kind[1:], kind[:-1], out=out[1:])
        # what follows a space belongs to its piece, unless it is white space itself
        out[1:] &= ~space[:-1] | blank[1:]
        # of a run of white space, the last character stands apart unless the text ends there
        last = np.flatnonzero(blank[:-1] & ~blank[1:])
        out[np.setdiff1d(last, border - 1, assume_unique=True)] = True
        out[border] = True
        mark = np.flatnonzero(points == ord("'"))
        if len(mark):
            opens = np.isin(mark, border) | (mark > 0) & (kind[mark - 1] != OTHER) & ~space[mark - 1]
            mark = mark[opens]
            stop = ends[np.searchsorted(ends, mark, side="right")]
            for tail in CONTRACTIONS:
                n = len(tail)
                hit, end = mark[mark + n < stop], stop[mark + n < stop]
                for k, c in enumerate(tail, 1):
                    fits = points[hit + k] == ord(c)
                    hit, end = hit[fits], end[fits]
                out[hit + 1] = False
                out[hit[hit + n + 1 < end] + n + 1] = True
        return out


@cache
def worker_encoder(path: str, end_id: int) -> Encoder:
    """One encoder and its cache for all tasks of a Python worker."""
    return Encoder(path, end_id)


def default_tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def parts_of(text: str, limit: int = PART_CHARS) -> Iterator[str]:
    """A text in parts whose ids, one after the other, are the text's: cut before a single space between other signs."""
    at = 0
    while len(text) - at > limit:
        m = SINGLE_SPACE.search(text, at + limit)
        if m is None:
            break
        yield text[at:m.start()]
        at = m.start()
    yield text[at:]


def encoded(encoder: Encoder, buf: np.ndarray, off: np.ndarray) -> Iterator[np.ndarray]:
    """The ids of every text of a column, with the end id."""
    for i, j in row_slices(off, SLICE_BYTES):
        texts = [buf[off[k]:off[k + 1]].tobytes().decode() for k in range(i, j)]
        if j == i + 1 and len(texts[0]) > PART_CHARS:
            parts = [encoder.encode([p])[0] for p in parts_of(texts[0])]
            yield np.append(np.concatenate(parts), np.uint32(encoder.end_id))
        else:
            ids, counts = encoder.encode(texts)
            ends = np.cumsum(counts)
            ids = np.insert(ids, ends, np.uint32(encoder.end_id))
            yield from np.split(ids, (ends + np.arange(1, len(ends) + 1))[:-1])


def vocabulary_bits(path: str) -> int:
    from tokenizers import Tokenizer
    return max(1, (Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) - 1).bit_length())


def shards_of(docs: DataFrame, tokenizer_path: str, end_id: int, shard_tokens: int) -> DataFrame:
    """``docs`` (id, text), in order within its partitions, as rows of the files."""
    bits, kind = vocabulary_bits(tokenizer_path), docs.schema["id"].dataType.simpleString()
    numbered = docs.withColumn("part", F.spark_partition_id())

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer_path, end_id)
        names = ("part", "shard", "before", "n_tokens", "ids", "lengths", "matrix")
        part, shard, before = None, 0, 0
        ids: list[pa.Array] = []
        held: list[np.ndarray] = []
        size = 0

        def row() -> pa.RecordBatch:
            nonlocal shard, before, ids, held, size
            tokens, docs = np.concatenate(held), pa.concat_arrays(ids)
            cols = [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([before], pa.int64()),
                    pa.array([size], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs),
                    pa.array([[len(h) for h in held]], pa.list_(pa.int64())),
                    pa.array([WaveletMatrix.of(tokens, bits).to_bytes()], pa.binary())]
            shard, before, ids, held, size = shard + 1, before + size, [], [], 0
            return pa.RecordBatch.from_arrays(cols, names)

        for b in batches:
            part = b.column(2)[0].as_py() if b.num_rows else part
            first = 0
            for k, tokens in enumerate(encoded(encoder, *raw_texts(b.column(1)))):
                held.append(tokens)
                size += len(tokens)
                if size >= shard_tokens:
                    ids.append(b.column(0).slice(first, k + 1 - first))
                    first = k + 1
                    yield row()
            if first < b.num_rows:
                ids.append(b.column(0).slice(first))
        if held:
            yield row()

    return numbered.mapInArrow(make, f"part int, shard int, before bigint, n_tokens bigint, ids array<{kind}>, "
                               "lengths array<bigint>, matrix binary")


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None,
                 end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, partitions: int | None = None) -> None:
    """Write the token files of ``docs`` to the folder ``path``, one file a partition."""
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    shards_of(rows, tokenizer_path or default_tokenizer_path(), end_id, shard_tokens).write.parquet(path)


def token_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def with_base(files: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` (part, start, ...) with ``start`` counted from the first id of all files instead of the partition's."""
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row a partition
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = totals.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    return rows.join(F.broadcast(base), "part").withColumn("start", F.col("start") + F.col("base")).drop("part", "base")


def read_shards(files: DataFrame, each, outputs: str) -> DataFrame:
    """``each(matrix, starts, lengths)`` for every shard, a dict of arrays with one entry a row and ``doc``, the document's
    number in the shard; as (part, doc_id, start, *outputs)."""
    kind = files.schema["ids"].dataType.elementType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                lengths = b.column("lengths")[k].values.to_numpy()
                starts = np.cumsum(lengths) - lengths
                got = each(WaveletMatrix.from_bytes(b.column("matrix")[k].as_py()), starts, lengths)
                doc = got.pop("doc")
                part, before = b.column("part")[k].as_py(), b.column("before")[k].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(doc), part, np.int32)), b.column("ids")[k].values.take(pa.array(doc)),
                     pa.array(before + starts[doc]), *[v if isinstance(v, pa.Array) else pa.array(v) for v in got.values()]],
                    ["part", "doc_id", "start", *got])

    shards = files.select("part", "before", "ids", "lengths", "matrix")
    return shards.mapInArrow(work, f"part int, doc_id {kind}, start bigint, {outputs}")


def token_digests(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from its decoded ids."""
    def each(matrix: WaveletMatrix, starts: np.ndarray, lengths: np.ndarray) -> dict:
        view = memoryview(matrix.decode().astype("<u4")).cast("B")
        crc = [zlib.crc32(view[4 * a:4 * (a + n)]) for a, n in zip(starts.tolist(), lengths.tolist())]
        return {"doc": np.arange(len(starts)), "n_tokens": lengths, "ids_crc32": np.array(crc, np.int64)}

    return with_base(files, read_shards(files, each, "n_tokens bigint, ids_crc32 bigint"))


def documents_of(files: DataFrame) -> DataFrame:
    """(doc_id, start, tokens) of every document, the end id included."""
    def each(matrix: WaveletMatrix, starts: np.ndarray, lengths: np.ndarray) -> dict:
        offsets = pa.array(np.append(starts, matrix.n).astype(np.int32))
        return {"doc": np.arange(len(starts)), "tokens": pa.ListArray.from_arrays(offsets, pa.array(matrix.decode().astype(np.int32)))}

    return with_base(files, read_shards(files, each, "tokens array<int>"))


def count_tokens(files: DataFrame, tokens: list[int]) -> DataFrame:
    """(token, n): how often each of ``tokens`` occurs, counted by rank and summed over the shards."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("token", pa.int32()), ("n", pa.int64())])
        total = [0] * len(tokens)
        for b in batches:
            for data in b.column(0):
                matrix = WaveletMatrix.from_bytes(data.as_py())
                total = [n + matrix.count(t) for n, t in zip(total, tokens)]
        yield record_batch(schema, tokens, total)

    return files.select("matrix").mapInArrow(work, "token int, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def find_tokens(files: DataFrame, token: int) -> DataFrame:
    """(doc_id, start, position) of every occurrence of ``token``, by select; ``position`` counts from the document's start."""
    def each(matrix: WaveletMatrix, starts: np.ndarray, lengths: np.ndarray) -> dict:
        at = matrix.occurrences(token)
        doc = np.searchsorted(starts, at, side="right") - 1
        return {"doc": doc, "position": at - starts[doc]}

    return with_base(files, read_shards(files, each, "position bigint"))


def tokens_at(files: DataFrame, position: int) -> DataFrame:
    """(doc_id, start, token) at ``position`` of every document that is long enough, by access."""
    def each(matrix: WaveletMatrix, starts: np.ndarray, lengths: np.ndarray) -> dict:
        doc = np.flatnonzero(lengths > position)
        return {"doc": doc, "token": matrix.access(starts[doc] + position).astype(np.int32)}

    return with_base(files, read_shards(files, each, "token int"))


def stored_token_digests(docs: DataFrame, **how) -> DataFrame:
    """Write the token files of ``docs`` to the shared folder and describe every document from them."""
    path = shared_dir(docs.sparkSession, "parley-tokens")
    write_tokens(docs, path, **how)
    return token_digests(token_files(docs.sparkSession, path))
