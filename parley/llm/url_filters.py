"""URL filters: glob rules simulated together by a bit-parallel automaton (multiword Shift-And).

Every rule becomes a glob over the canonical URL ``"." host SEP path``, where SEP is a byte that UTF-8 never uses; a
rule (host, path) is the glob ``*.host SEP path*``, so it fits the host, its subdomains and every longer path. All globs
lie side by side in one bit vector of as many 64-bit words as they need. One step per character moves all patterns of
all URLs of a batch: ``D = ((D << 1) & B[c]) | (D & S)``, with ``B`` the literal masks and ``S`` the self-loops of ``*``.

Defined cases: a null URL or one without ``://`` has an empty host and path (no rule with a path fits, so the default
verdict holds); repeated rows are judged each; of the rules that fit the longest wins, on a tie a block, then text order.
An empty table gives an empty result; other columns of the input are not read. The state is a fixed number of words
a URL, a map stage without any shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import raw_texts, record_batch, row_slices

SEP = 0xFF
ANY_RUN, ANY_ONE = ord("*"), ord("?")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    """``verdict`` for a host (and its subdomains) and the paths that start with ``path``; ``*`` and ``?`` are wildcards."""

    verdict: str
    host: str
    path: str = ""

    @property
    def text(self) -> str:
        return self.host + self.path

    def glob(self) -> bytes:
        return b"*." + self.host.encode() + bytes([SEP]) + self.path.encode() + b"*"


#: The rules of the registered query (fixed by its contract).
RULES = (UrlRule("allow", "org", "/"), UrlRule("block", "example.org", "/es/"), UrlRule("block", "example.org", "/en/1"),
         UrlRule("allow", "com", "/fr/"), UrlRule("block", "com", "/de/"))


class ShiftAnd:
    """Globs over bytes (``*`` any run, ``?`` any byte), packed into the bits of ``words`` 64-bit words."""

    def __init__(self, globs: list[bytes]):
        literals: list[int | None] = []  # the byte each bit stands for; None at a pattern's start bit
        loops, self.starts, self.ends = [], [], []
        for g in globs:
            self.starts.append(len(literals))
            literals.append(None)
            loops.append(False)
            for c in g:
                if c == ANY_RUN:
                    loops[-1] = True
                else:
                    literals.append(c)
                    loops.append(False)
            self.ends.append(len(literals) - 1)
        self.words = max(1, -(-len(literals) // 64))
        bit = [(np.uint64(1) << np.uint64(i % 64)) for i in range(len(literals))]
        self.masks = np.zeros((256, self.words), np.uint64)
        self.loops = np.zeros(self.words, np.uint64)
        self.first = np.zeros(self.words, np.uint64)
        for i, c in enumerate(literals):
            if c == ANY_ONE:
                self.masks[:, i // 64] |= bit[i]
            elif c is not None:
                self.masks[c, i // 64] |= bit[i]
            if loops[i]:
                self.loops[i // 64] |= bit[i]
        for i in self.starts:
            self.first[i // 64] |= bit[i]

    def matches(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A row for each text, a column for each glob: does the whole text fit the glob?"""
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")
        begin, lengths = offsets[:-1][order], lengths[order]
        state = np.repeat(self.first[None, :], len(order), axis=0)
        active = len(order)
        for step in range(int(lengths[0]) if len(lengths) else 0):
            while active and lengths[active - 1] <= step:  # shorter texts have ended; their state stands
                active -= 1
            d = state[:active]
            moved = d << np.uint64(1)
            moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
            moved &= self.masks[buf[begin[:active] + step]]
            d &= self.loops
            d |= moved
        out = np.zeros((len(order), len(self.ends)), bool)
        for k, e in enumerate(self.ends):
            out[order, k] = (state[:, e // 64] >> np.uint64(e % 64)) & np.uint64(1) != 0
        return out


def split_url(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path of a URL, both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def url_verdicts(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Iterable[UrlRule] = RULES,
                 default: str = "allow", batch_bytes: int = 4 << 20) -> DataFrame:
    """(id, host, path, rule, verdict) of every row; ``rule`` is null where none fits and ``default`` holds."""
    rules = sorted(rules, key=lambda r: (-len(r.text), r.verdict != "block", r.text))
    host, path = split_url(F.col(url_col))
    parts = df.select(id_col, host.alias("host"), path.alias("path"))
    id_type = parts.schema[id_col].dataType.simpleString()
    globs, names, verdicts = [r.glob() for r in rules], [r.text for r in rules], [r.verdict for r in rules]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ShiftAnd(globs)
        schema = None
        for b in batches:
            schema = schema or pa.schema([(id_col, b.schema.field(0).type), ("host", pa.string()), ("path", pa.string()),
                                          ("rule", pa.string()), ("verdict", pa.string())])
            hosts, h_off = raw_texts(b.column(1))
            paths, p_off = raw_texts(b.column(2))
            # canonical bytes: "." host SEP path, copied by position
            lengths = np.diff(h_off) + np.diff(p_off) + 2
            off = np.zeros(len(lengths) + 1, np.int64)
            np.cumsum(lengths, out=off[1:])
            for i, j in row_slices(off, batch_bytes):
                own = off[i:j + 1] - off[i]
                buf = np.empty(int(own[-1]), np.uint8)
                hl, pl = np.diff(h_off[i:j + 1]), np.diff(p_off[i:j + 1])
                at = own[:-1]
                buf[at] = ord(".")
                buf[at + 1 + hl] = SEP
                for start, n, src, src_off in ((at + 1, hl, hosts, h_off), (at + 2 + hl, pl, paths, p_off)):
                    total = int(n.sum())
                    if total:
                        within = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
                        lo = int(src_off[i])
                        buf[np.repeat(start, n) + within] = src[lo:lo + total]
                hit = automaton.matches(buf, own)
                first = np.where(hit.any(axis=1), hit.argmax(axis=1), -1) if globs else np.full(j - i, -1)
                yield record_batch(schema, b.column(0).slice(i, j - i), b.column(1).slice(i, j - i),
                                   b.column(2).slice(i, j - i), [names[k] if k >= 0 else None for k in first],
                                   [verdicts[k] if k >= 0 else default for k in first])

    return parts.mapInArrow(judge, f"`{id_col}` {id_type}, host string, path string, rule string, verdict string")
