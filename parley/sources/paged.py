"""Paged history as a data source (S5, S7, R1, F4): a remote history behind a page function, read by keyset pages.

The page function is injected: ``fetch(channel, before, limit)`` gives up to ``limit`` messages of a channel with an id below
``before`` (none: the newest), newest first, as dicts. It runs in the tasks, one channel a partition, and is tried again with
growing pauses when it raises :class:`Unavailable`; any other error ends the job. Nothing is served or opened here.

* As a batch: every channel from its newest message, or from a saved cursor, down to its first; ``page`` counts from 1.
* As a stream: the offset of a channel is the newest id seen (one probe a channel and trigger); a micro-batch reads the pages
  between two offsets. A restarted query goes on from the offset in its checkpoint; a micro-batch that is run again reads
  the same ids.

Every row carries the ``page`` it came with and the ``attempts`` that page took. Ids compare as numbers. Defined cases: an
empty channel has no rows; a page function that gives ids at or above ``before``, or not falling, is an error (it would
never end); a null channel is a channel like any other to the function.
"""

from __future__ import annotations

import sys
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

# Readers are planned in a Python process of the driver that does not see files added with addPyFile.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PAGE_SIZE, RETRIES, FIRST_PAUSE_S = 100, 5, 1.0
Fetch = Callable[[str | None, int | None, int], Sequence[dict]]


class Unavailable(Exception):
    """The page could not be had this time."""


@dataclass(frozen=True)
class Pages:
    """How a history is read: the page function, what it is asked for, and how often."""
    fetch: Fetch
    channels: tuple
    size: int = PAGE_SIZE
    retries: int = RETRIES
    first_pause_s: float = FIRST_PAUSE_S
    between_s: float = 0.0  # pause between two pages of a channel

    def page(self, channel, before: int | None, limit: int) -> tuple[Sequence[dict], int]:
        """(rows, attempts): pauses of 1, 2, 4... times ``first_pause_s`` between the attempts."""
        for attempt in range(self.retries + 1):
            try:
                return self.fetch(channel, before, limit), attempt + 1
            except Unavailable:
                if attempt == self.retries:
                    raise
                time.sleep(self.first_pause_s * 2 ** attempt)
        raise AssertionError

    def walk(self, channel, before: int | None, after: int | None = None) -> Iterator[tuple[dict, int, int]]:
        """(message, page, attempts) of the messages with ``after`` < id < ``before``, newest first."""
        page = 0
        while True:
            rows, attempts = self.page(channel, before, self.size)
            page += 1
            for row in rows:
                at = int(row["id"])
                if before is not None and at >= before:
                    raise ValueError(f"page {page} of {channel}: id {at} is not below {before}")
                if after is not None and at <= after:
                    return
                before = at
                yield row, page, attempts
            if len(rows) < self.size:
                return
            if self.between_s:
                time.sleep(self.between_s)


@dataclass
class Walk(InputPartition):
    channel: str | None
    before: int | None
    after: int | None


def _rows(pages: Pages, columns: tuple[str, ...], part: Walk) -> Iterator[tuple]:
    for row, page, attempts in pages.walk(part.channel, part.before, part.after):
        yield (*(row.get(c) for c in columns), part.channel, page, attempts)


class PagedReader(DataSourceReader):
    def __init__(self, pages: Pages, columns: tuple[str, ...], cursors: dict):
        self.pages, self.columns, self.cursors = pages, columns, cursors

    def partitions(self):
        return [Walk(c, self.cursors.get(c), None) for c in self.pages.channels]

    def read(self, partition: Walk):
        return _rows(self.pages, self.columns, partition)


class PagedStreamReader(DataSourceStreamReader):
    """Offsets are {"newest": [[channel, id or null], ...]}."""

    def __init__(self, pages: Pages, columns: tuple[str, ...]):
        self.pages, self.columns = pages, columns

    def initialOffset(self) -> dict:
        return {"newest": [[c, None] for c in self.pages.channels]}

    def latestOffset(self, *_) -> dict:
        newest = []
        for c in self.pages.channels:
            rows, _attempts = self.pages.page(c, None, 1)
            newest.append([c, int(rows[0]["id"]) if rows else None])
        return {"newest": newest}

    def partitions(self, start: dict, end: dict):
        seen = {c: n for c, n in start["newest"]}
        return [Walk(c, n + 1, seen.get(c)) for c, n in end["newest"] if n is not None and n != seen.get(c)] or [Walk(None, 0, 0)]

    def read(self, partition: Walk):
        if partition.before == 0:  # no channel has anything new
            return iter(())
        return _rows(self.pages, self.columns, partition)

    def commit(self, end: dict) -> None:
        pass


def register_paged(spark: SparkSession, name: str, pages: Pages, schema: str, cursors: dict | None = None) -> str:
    """Make the history readable as the format ``name``; ``schema`` (DDL) names the fields of a message that are wanted."""
    columns = tuple(f.name for f in spark.createDataFrame([], schema).schema)
    full, fixed = f"{schema}, channel_id string, page bigint, attempts int", dict(cursors or {})

    class Paged(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return full

        def reader(self, schema):
            return PagedReader(pages, columns, fixed)

        def streamReader(self, schema):
            return PagedStreamReader(pages, columns)

    spark.dataSource.register(Paged)
    return name


def read_paged(spark: SparkSession, name: str, pages: Pages, schema: str, cursors: dict | None = None) -> DataFrame:
    """The history as a batch; ``cursors`` (channel -> oldest id that is there) says where channels go on."""
    return spark.read.format(register_paged(spark, name, pages, schema, cursors)).load()


def stream_paged(spark: SparkSession, name: str, pages: Pages, schema: str) -> DataFrame:
    """The history as a stream: what is there at first, then what is new."""
    return spark.readStream.format(register_paged(spark, name, pages, schema)).load()


class StoredPages:
    """See :func:`stored_pages`."""

    def __init__(self, folder: str, block: int):
        self.folder, self.block = folder, block
        self._listed: dict = {}  # channel -> (file system, root, numbers of its blocks, falling)
        self._held: tuple = (None, None, None)  # (channel, block) of the one block that is kept, its rows and negated ids

    def __reduce__(self):  # a task looks for itself
        return type(self), (self.folder, self.block)

    def _blocks(self, channel, anew: bool) -> tuple:
        if anew or channel not in self._listed:
            import pyarrow.fs as fs
            from urllib.parse import quote
            place = "__HIVE_DEFAULT_PARTITION__" if channel is None else quote(channel, safe="")
            store, root = fs.FileSystem.from_uri(f"{self.folder}/channel_id={place}")
            found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
            numbers = (int(f.base_name.split("=")[1]) for f in found if f.base_name.startswith("block="))
            self._listed[channel], self._held = (store, root, sorted(numbers, reverse=True)), (None, None, None)
        return self._listed[channel]

    def _open(self, channel, number: int) -> tuple:
        if self._held[0] != (channel, number):
            import numpy as np
            import pyarrow.dataset as ds
            store, root, _numbers = self._listed[channel]
            rows = ds.dataset(f"{root}/block={number}", filesystem=store, format="parquet").to_table()
            rows = rows.sort_by([("id", "descending")]).combine_chunks()
            self._held = (channel, number), rows, -rows["id"].to_numpy().astype(np.int64)
        return self._held[1:]

    def __call__(self, channel, before, limit) -> list[dict]:
        from bisect import bisect_left
        numbers = self._blocks(channel, before is None)[2]
        # the first block with an id below ``before`` at its start
        first = 0 if before is None else bisect_left(numbers, 1 - before, key=lambda b: -b * self.block)
        rows: list = []
        for k in range(first, len(numbers)):
            part, falling = self._open(channel, numbers[k])
            start = 0 if before is None else int(falling.searchsorted(-before, side="right"))
            rows += part.slice(start, limit - len(rows)).to_pylist()
            if len(rows) == limit:
                break
        return rows


def stored_pages(folder: str, block: int) -> Fetch:
    """A page function over a history that Spark has stored under ``folder`` (any store that Arrow reads), partitioned by
    channel and by blocks of ``block`` ids; a call opens the blocks that its page lies in.

    The blocks of a channel are listed once a walk (anew whenever the newest page is asked for), and the block that a page
    ended in is kept, sorted, for the next one: a walk lists once and opens every block once, however many pages it has.
    """
    return StoredPages(folder, block)
