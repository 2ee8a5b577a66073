"""Best-fit packing: documents cut into pieces of at most ``capacity`` tokens, packed into as few sequences as possible.

Sum-of-squares rule: with N(g) the number of open sequences whose residual gap is g, a piece goes where the sum of
N(g)^2 becomes smallest; a new sequence is opened only if no open one has room. Pieces come longest first.

Texts are tokenised in Arrow batches; what is shuffled afterwards is a row of numbers a piece. Pieces of full
length are numbered where they are; shorter ones are dealt over
shards of about ``shard_rows`` by a hash, so all shards see the same mix of lengths and each packs by itself; the last
sequences of the shards that are not full are then packed once more together, again in bounded shards.

Ids of words are cached, as the vocabulary treats words independently; words with characters beyond plain Latin letters,
digits and ASCII signs go through the whole tokenizer, so ids are always the tokenizer's own.

Defined cases: a null or empty text is the end token alone; repeated rows are packed each; ties go to the smallest
remaining gap, then the newest such sequence; a piece of full length is a sequence by itself. An empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import kept, record_batch, texts

CAPACITY, END_ID = 4096, 1
SHARD_ROWS = 50_000
CACHE_WORDS, CACHED_LENGTH = 400_000, 64
TEXT_CHUNK = 1 << 20

#: Characters whose normal form, lower case and class are the same in every Unicode version.
PLAIN = " \t\n\r!-~À-ÖØ-öø-įı-ňŊ-ž"
NOT_PLAIN = re.compile(f"[^{PLAIN}]|<\\|")
LETTERS = "a-zß-öø-ž"
#: The pieces that the vocabulary's own pattern finds in lower-case plain text.
PIECES = re.compile(f"[{LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^ \t\n\r0-9{LETTERS}]+")
BREAK = re.compile("[ \t\n\r]")


def byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable Latin-1 bytes are themselves, the others follow from 256 on."""
    others = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
    return {b: 256 + k for k, b in enumerate(others)}


BYTE_LETTERS = byte_letters()


@cache
def worker_tokenizer(path: str) -> "CachedTokenizer":
    """One tokenizer and its cache for all tasks of a Python worker."""
    return CachedTokenizer(path)


def default_tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class WordIds(dict):
    """Ids of words as little-endian 32-bit bytes, found by the vocabulary's model when first asked for; bounded."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.model = tokenizer, tokenizer.model

    def __missing__(self, word: str) -> bytes:
        if NOT_PLAIN.search(word):
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        else:  # a plain piece is one word of the model, spelled in its alphabet of bytes
            spelled = word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_LETTERS)
            ids = [t.id for t in self.model.tokenize(spelled)]
        out = np.array(ids, "<u4").tobytes()
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = out
        return out


class CachedTokenizer:
    """Token ids of texts, equal to the tokenizer's, with a bounded cache of words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.words = WordIds(Tokenizer.from_file(path))

    def pieces(self, text: str) -> list[str]:
        if not NOT_PLAIN.search(text):
            return PIECES.findall(text.lower())
        out: list[str] = []
        for word in BREAK.split(text):  # white space always parts tokens, so words stand alone
            if NOT_PLAIN.search(word):
                out.append(word)
            else:
                out += PIECES.findall(word.lower())
        return out

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.pieces(text)))

    def chunks(self, text: str) -> Iterator[bytes]:
        """The ids of a text of any length, in parts cut at white space."""
        at = 0
        while at < len(text):
            cut = len(text)
            if cut - at > TEXT_CHUNK:
                m = BREAK.search(text, at + TEXT_CHUNK)
                cut = m.start() if m else cut
            yield self.ids(text[at:cut])
            at = cut


def cut_pieces(parts: Iterator[bytes], capacity: int, end_id: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32 of the ids) of one document, whose ids come in parts; the end token closes them."""
    size, rest, piece = 4 * capacity, b"", 0
    for part in chain(parts, [np.array([end_id], "<u4").tobytes()]):
        rest += part
        while len(rest) >= size:
            yield piece, piece * capacity, capacity, zlib.crc32(rest[:size])
            rest, piece = rest[size:], piece + 1
    if rest:
        yield piece, piece * capacity, len(rest) // 4, zlib.crc32(rest)


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None,
                 capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's tokens and the end token, cut at ``capacity``."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    path = tokenizer_path or default_tokenizer_path()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, schema = worker_tokenizer(path), None
        for b in batches:
            schema = schema or pa.schema([("doc_id", b.schema.field(0).type), ("piece", pa.int32()), ("start", pa.int64()),
                                          ("length", pa.int64()), ("ids_crc32", pa.int64())])
            owner, rows = [], []
            for k, t in enumerate(texts(b.column(1))):
                got = list(cut_pieces(tokenizer.chunks(t), capacity, end_id))
                owner += [k] * len(got)
                rows += got
            yield record_batch(schema, b.column(0).take(pa.array(owner, pa.int64())), *(zip(*rows) if rows else [[]] * 4))

    return src.mapInArrow(make, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, piece int, start bigint, "
                          "length bigint, ids_crc32 bigint")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece, placed longest first by the sum-of-squares rule."""
    open_count = np.zeros(capacity + 1, np.int64)  # by residual gap
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    never = np.iinfo(np.int64).max
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    made = 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        s = int(lengths[k])
        counts = open_count[s:capacity]  # sequences whose gap holds the piece
        if len(counts) and counts.any():
            # N(g) falls by one and N(g - s) rises by one; a gap of 0 is no longer open
            change = 2 * (open_count[:capacity - s] - counts) + 2
            change[0] = 1 - 2 * counts[0]
            change[counts == 0] = never
            gap = s + int(change.argmin())
            seq = open_at[gap].pop()
            open_count[gap] -= 1
        else:
            gap, seq = capacity, made
            made += 1
        sequence[k], offset[k] = seq, capacity - gap
        if gap > s:
            open_at[gap - s].append(seq)
            open_count[gap - s] += 1
    return sequence, offset


def _packed(rows: DataFrame, shards: int, base: int, capacity: int) -> DataFrame:
    """``rows`` (a written table) with sequence_id, offset and the tokens used in the sequence, packed shard by shard;
    ``base`` keeps the numbers of different rounds apart."""
    names = rows.columns
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))

    def pack(shard: pa.Table) -> pa.Table:
        length = shard["length"].to_numpy()
        order = np.lexsort((shard["piece"].to_numpy(), shard["ids_crc32"].to_numpy(), -length))
        seq, at = sum_of_squares(length[order], capacity)
        used = np.bincount(seq, weights=length[order]).astype(np.int64)
        first_id = (base + shard["shard"][0].as_py()) << 32
        out = shard.select(names).take(pa.array(order))
        return out.append_column("sequence_id", pa.array(first_id + seq)).append_column(
            "offset", pa.array(at)).append_column("used", pa.array(used[seq]))

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return dealt.groupBy("shard").applyInArrow(pack, f"{kind}, sequence_id bigint, offset bigint, used bigint")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None,
                   capacity: int = CAPACITY, end_id: int = END_ID, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): where every piece of every document lies."""
    pieces = kept(token_pieces(docs, id_col, text_col, tokenizer_path, capacity, end_id))
    short = pieces.where(F.col("length") < capacity)
    shards = 1 + short.count() // shard_rows
    first = kept(_packed(short, shards, 0, capacity))
    loose = kept(first.where(F.col("used") < capacity).select(*pieces.columns))
    again = 1 + loose.count() // shard_rows
    second = _packed(loose, again, shards, capacity)
    # a full piece is a sequence by itself, numbered after those of the shards without being gathered
    full = pieces.where(F.col("length") >= capacity).withColumns({
        "sequence_id": F.lit((shards + again) << 32) + F.monotonically_increasing_id(), "offset": F.lit(0).cast("bigint")})
    return first.where(F.col("used") >= capacity).unionByName(second).drop("used").unionByName(full)
