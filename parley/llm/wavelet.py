"""A wavelet matrix over token ids: bit planes with rank directories, as one string of bytes.

Plane by plane, from the highest bit on, the ids are parted stably into those with bit 0 and those with bit 1. A plane is
kept as packed bits (zstandard) and the number of ones before every block of ``BLOCK`` bits. Access, rank, counting and
occurrence lookup then read one block a plane and position; the ids themselves are not stored.
"""

from __future__ import annotations

import struct
from functools import cached_property

import numpy as np
import zstandard

MAGIC = b"WVM1"
BLOCK = 512
HEAD = struct.Struct("<4sBQ")    # magic, planes, ids
PLANE = struct.Struct("<QII")    # zeros, bytes of the packed bits, bytes of the rank directory
ENTRY = np.dtype("<u4")          # of a rank directory


class Plane:
    """One bit plane with rank and select."""

    def __init__(self, n: int, packed: bytes, ranks: np.ndarray):
        self.n, self.packed, self.ranks = n, packed, ranks
        self.zeros = n - self.ones

    @classmethod
    def of(cls, bits: np.ndarray) -> "Plane":
        n = len(bits)
        blocks = -(-n // BLOCK)
        packed = np.zeros(blocks * BLOCK // 8, np.uint8)
        packed[:-(-n // 8)] = np.packbits(bits, bitorder="little")
        ones = np.bitwise_count(packed.view(np.uint64)).reshape(blocks, BLOCK // 64).sum(axis=1, dtype=np.int64)
        return cls(n, packed.tobytes(), np.concatenate([[0], np.cumsum(ones)]).astype(ENTRY))

    @cached_property
    def words(self) -> np.ndarray:
        return np.frombuffer(self.packed, np.uint64).reshape(-1, BLOCK // 64)

    @property
    def ones(self) -> int:
        return int(self.ranks[-1])

    def bits(self) -> np.ndarray:
        return np.unpackbits(np.frombuffer(self.packed, np.uint8), count=self.n, bitorder="little").view(bool)

    def bit(self, at: np.ndarray) -> np.ndarray:
        word = self.words.ravel()[at >> 6]
        return (word >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position (0 to n)."""
        at = np.asarray(at, np.int64)
        block, rest = at // BLOCK, at % BLOCK
        if not self.n:
            return np.zeros(at.shape, np.int64)
        inside = np.minimum(block, len(self.words) - 1)  # the end of the last block is its directory's last entry
        kept = np.clip(rest[..., None] - 64 * np.arange(BLOCK // 64), 0, 64).astype(np.uint64)  # bits that count, of each word
        mask = np.where(kept == 64, ~np.uint64(0), (np.uint64(1) << (kept & np.uint64(63))) - np.uint64(1))
        return self.ranks[block] + np.bitwise_count(self.words[inside] & mask).sum(axis=-1, dtype=np.int64)

    def select(self, value: bool, k: np.ndarray) -> np.ndarray:
        """The positions of the k-th (from 0) ones or zeros."""
        k = np.asarray(k, np.int64)
        if not len(k):
            return k
        before = self.ranks.astype(np.int64)
        if not value:
            before = np.minimum(np.arange(len(before)) * BLOCK, self.n) - before
        block = np.searchsorted(before, k, side="right") - 1
        out = np.empty(len(k), np.int64)
        step = 4096
        for i in range(0, len(k), step):  # the bits of so many blocks at a time
            some = block[i:i + step]
            bits = np.unpackbits(self.words[some].view(np.uint8), axis=1, bitorder="little")
            seen = np.cumsum(bits if value else 1 - bits, axis=1, dtype=np.int32)
            out[i:i + step] = some * BLOCK + (seen > (k[i:i + step] - before[some])[:, None]).argmax(axis=1)
        return out


class WaveletMatrix:
    def __init__(self, n: int, planes: list[Plane]):
        self.n, self.planes = n, planes

    @classmethod
    def of(cls, ids: np.ndarray, bits: int) -> "WaveletMatrix":
        """Of ids below ``2 ** bits``."""
        if len(ids) and int(ids.max()) >> bits:
            raise ValueError(f"an id does not fit {bits} bits")
        if len(ids) >> 32:
            raise ValueError("a matrix holds fewer than 2 ** 32 ids")
        x = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes = []
        for b in range(bits - 1, -1, -1):
            ones = (x & x.dtype.type(1 << b)) != 0
            planes.append(Plane.of(ones))
            x = np.concatenate([x[np.flatnonzero(~ones)], x[np.flatnonzero(ones)]])
        return cls(len(ids), planes)

    def to_bytes(self, level: int = 1) -> bytes:
        packer = zstandard.ZstdCompressor(level=level)
        out = [HEAD.pack(MAGIC, len(self.planes), self.n)]
        for p in self.planes:
            packed, ranks = packer.compress(p.packed), packer.compress(p.ranks.tobytes())
            out += [PLANE.pack(p.zeros, len(packed), len(ranks)), packed, ranks]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, data: bytes) -> "WaveletMatrix":
        magic, bits, n = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a wavelet matrix")
        at, planes, unpacker = HEAD.size, [], zstandard.ZstdDecompressor()
        for _ in range(bits):
            zeros, a, b = PLANE.unpack_from(data, at)
            at += PLANE.size
            packed, ranks = unpacker.decompress(data[at:at + a]), unpacker.decompress(data[at + a:at + a + b])
            planes.append(Plane(n, packed, np.frombuffer(ranks, ENTRY)))
            if planes[-1].zeros != zeros:
                raise ValueError("a damaged wavelet matrix")
            at += a + b
        return cls(n, planes)

    def decode(self) -> np.ndarray:
        """All ids in order: the partings undone from the lowest plane up."""
        x = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for b, p in enumerate(reversed(self.planes)):
            ones = p.bits()
            up = np.empty_like(x)
            up[np.flatnonzero(~ones)] = x[:p.zeros]
            up[np.flatnonzero(ones)] = x[p.zeros:] | x.dtype.type(1 << b)
            x = up
        return x

    def access(self, at: np.ndarray) -> np.ndarray:
        """The ids at the given positions."""
        at = np.asarray(at, np.int64)
        out = np.zeros(len(at), np.int64)
        for p in self.planes:
            one, rank = p.bit(at), p.rank(at)
            out = out << 1 | one
            at = np.where(one, p.zeros + rank, at - rank)
        return out

    def _places(self, token: int, start: int, stop: int) -> tuple[int, int]:
        """Where the occurrences of ``token`` in [start, stop) lie below the last plane."""
        ends = np.array([start, stop], np.int64)
        if token >> len(self.planes):
            return 0, 0
        for b, p in zip(range(len(self.planes) - 1, -1, -1), self.planes):
            rank = p.rank(ends)
            ends = p.zeros + rank if token >> b & 1 else ends - rank
        return int(ends[0]), int(ends[1])

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        """Occurrences of ``token`` in [start, stop)."""
        a, b = self._places(token, start, self.n if stop is None else stop)
        return b - a

    def rank(self, token: int, at: int) -> int:
        return self.count(token, 0, at)

    def occurrences(self, token: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """The positions of ``token`` in [start, stop), ascending."""
        a, b = self._places(token, start, self.n if stop is None else stop)
        at = np.arange(a, b)
        for shift, p in enumerate(reversed(self.planes)):
            one = bool(token >> shift & 1)
            at = p.select(one, at - p.zeros if one else at)
        return at

    def select(self, token: int, k: int) -> int:
        """The position of the k-th (from 0) occurrence of ``token``."""
        a, b = self._places(token, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        at = np.array([a + k])
        for shift, p in enumerate(reversed(self.planes)):
            one = bool(token >> shift & 1)
            at = p.select(one, at - p.zeros if one else at)
        return int(at[0])
