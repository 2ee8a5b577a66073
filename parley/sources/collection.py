"""The vector collection as a versioned parquet table (S9, K2, A1, J2, U1, U2 on what is stored).

Layout under ``<root>/<name>``: ``data/<uuid>`` rows of a load, ``keys/<uuid>`` a key index of ids, ``hidden/<uuid>`` the
opted-out authors, ``_log`` the manifests (:mod:`parley.sources.manifest`) that say which of them count.

* A load is named by its source (``batch`` for jobs, the query's id for a stream) and its number. Adding is
  insert-if-absent against every committed load, whatever their order: the first commit of an id wins. A load that is named
  again is refused, or, as a retry, found done and left alone. Two loads at once: the one that commits second looks its ids
  up again in what the first has added. A load that dies midway is invisible.
* The key index has the ids of one or more loads in hash buckets of about ``keys_a_bucket``; a load opens only the buckets
  that its ids fall into, so what it reads depends on its own size and not on the collection's. Indexes of similar size are
  merged, so there are about log(collection) of them.
* Authors who opt out after a load are hidden from every later read by an anti join, and are back if they opt in again;
  ``collection_compact`` removes their rows for good and puts all rows in one folder.
"""

from __future__ import annotations

import math
import os
import time
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.operators.privacy import optout_add, optout_remove
from parley.schemas import COLLECTION
from parley.session import cut_lineage
from parley.sources.manifest import CommitLog, Files

BATCH_SOURCE = "batch"
STORED = T.StructType([*COLLECTION.fields, T.StructField("source", T.StringType()), T.StructField("load_id", T.LongType())])
KEYS_A_BUCKET = 250_000
MERGED_RUNS = 4          # so many indexes of similar size become one
PRUNED_BUCKETS = 10_000  # a load that falls into more buckets reads them all
_EMPTY = {"loads": [], "data": [], "keys": [], "hidden": None}
_KEY = "id string, bucket long"


def collection_path(root: str, name: str) -> str:
    return os.path.join(root, name)


def commit_log(spark: SparkSession, root: str, name: str) -> CommitLog:
    return CommitLog(spark, f"{collection_path(root, name)}/_log", _EMPTY)


def _folder(root: str, name: str, kind: str) -> str:
    return f"{kind}/{uuid.uuid4().hex}"


def _rows_of(spark: SparkSession, root: str, name: str, manifest: dict) -> DataFrame:
    """All stored rows of a manifest, hidden ones included."""
    if not manifest["data"]:
        return spark.createDataFrame([], STORED)
    return spark.read.schema(STORED).parquet(*[f"{collection_path(root, name)}/{d['folder']}" for d in manifest["data"]])


def _hidden_of(spark: SparkSession, root: str, name: str, manifest: dict) -> DataFrame | None:
    if manifest["hidden"] is None:
        return None
    return spark.read.schema("user_id string").parquet(f"{collection_path(root, name)}/{manifest['hidden']}")


def _visible(rows: DataFrame, hidden: DataFrame | None) -> DataFrame:
    if hidden is None:
        return rows
    return rows.join(hidden, F.col("metadata.author") == F.col("user_id"), "left_anti")


def open_collection(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Get-or-create: the stored rows of the last commit, without those of opted-out authors, or an empty frame with the
    COLLECTION schema."""
    manifest = commit_log(spark, root, name).latest()
    return _visible(_rows_of(spark, root, name, manifest), _hidden_of(spark, root, name, manifest))


def dedup_first(df: DataFrame, id_col: str = "id", order_cols: tuple[str, ...] = ()) -> DataFrame:
    """One row per id: the first in ``order_cols`` (file, position...), then in the order of its other columns, so that
    the same rows always give the same one."""
    rest = [c for c in df.columns if c != id_col and c not in order_cols]
    first = df.groupBy(id_col).agg(F.min(F.struct(*order_cols, *rest)).alias("_r"))
    return first.select(*[id_col if c == id_col else F.col(f"_r.{c}") for c in df.columns])


def _bucket(id_col: Column | str, bits: int) -> Column:
    """The bucket of an id: the high bits of its hash."""
    h = F.xxhash64(F.col(id_col) if isinstance(id_col, str) else id_col)
    return F.shiftrightunsigned(h, 64 - bits) if bits else F.lit(0).cast("bigint")


def _buckets_bits(rows: int, keys_a_bucket: int) -> int:
    return max(0, math.ceil(math.log2(max(rows, 1) / keys_a_bucket)))


def stored_ids(ids: DataFrame, root: str, name: str, runs: list[dict]) -> DataFrame:
    """Those of ``ids`` (column ``id``, distinct) that one of the key indexes ``runs`` has. Of an index, only the buckets
    that an id falls into are opened; the driver sees their numbers."""
    spark, known = ids.sparkSession, None
    for run in runs:
        keys = spark.read.schema(_KEY).parquet(f"{collection_path(root, name)}/{run['folder']}")
        if run["bits"]:
            own = [r[0] for r in ids.select(_bucket("id", run["bits"])).distinct().limit(PRUNED_BUCKETS + 1).collect()]
            if len(own) <= PRUNED_BUCKETS:
                keys = keys.where(F.col("bucket").isin(own))
        found = keys.select("id").join(ids, "id", "left_semi")
        known = found if known is None else known.unionByName(found)
    return known if known is not None else ids.limit(0)


def new_rows(incoming: DataFrame, root: str, name: str, runs: list[dict], id_col: str = "id") -> DataFrame:
    """Rows of ``incoming`` whose id is in none of the key indexes (J2). Rows without an id cannot be told apart and are left
    out."""
    named = incoming.filter(F.col(id_col).isNotNull())
    if not runs:
        return named
    known = stored_ids(named.select(F.col(id_col).alias("id")).distinct(), root, name, runs)
    return named.join(known.select(F.col("id").alias("_nid")), F.col(id_col) == F.col("_nid"), "left_anti")


def _write_keys(ids: DataFrame, root: str, name: str, rows: int, keys_a_bucket: int) -> dict:
    """A key index of ``ids``: sorted ids, a folder a bucket."""
    bits, folder = _buckets_bits(rows, keys_a_bucket), _folder(root, name, "keys")
    dealt = ids.select("id", _bucket("id", bits).alias("bucket"))
    tasks = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (dealt.repartition(max(1, min(1 << bits, tasks)), "bucket").sortWithinPartitions("bucket", "id")
     .write.partitionBy("bucket").parquet(f"{collection_path(root, name)}/{folder}"))
    return {"folder": folder, "bits": bits, "rows": rows}


def _write_load(fresh: DataFrame, root: str, name: str, source: str, load_id: int, keys_a_bucket: int) -> tuple[dict, dict] | None:
    """Write rows and their keys; None if there are none. The count comes from the write itself."""
    rows, folder = Observation(), _folder(root, name, "data")
    named = fresh.withColumn("source", F.lit(source)).withColumn("load_id", F.lit(load_id).cast("bigint"))
    path = f"{collection_path(root, name)}/{folder}"
    named.observe(rows, F.count(F.lit(1)).alias("n")).write.parquet(path)
    n = int(rows.get["n"])
    if not n:
        return None
    stored = fresh.sparkSession.read.schema(STORED).parquet(path)
    return {"folder": folder, "rows": n}, _write_keys(stored.select("id"), root, name, n, keys_a_bucket)


def collection_add(incoming: DataFrame, root: str, name: str, load_id: int, *, id_col: str = "id",
                   order_cols: tuple[str, ...] = (), source: str = BATCH_SOURCE, retry: bool = False,
                   keys_a_bucket: int = KEYS_A_BUCKET) -> int:
    """K2: append the rows whose id is new; returns the number of rows written by this load (of a retry of a load that is
    committed: by that).

    ``order_cols`` (columns of ``incoming``) say which row of an id comes first within the load.
    """
    spark, load_id = incoming.sparkSession, int(load_id)
    log = commit_log(spark, root, name)

    def done(manifest: dict) -> int | None:
        rows = next((n for s, i, n in manifest["loads"] if (s, i) == (source, load_id)), None)
        if rows is not None and not retry:
            raise ValueError(f"load {source}/{load_id} of {name} is stored already")
        return rows

    start = log.latest()
    if (rows := done(start)) is not None:
        return rows
    columns = [c.name for c in COLLECTION.fields]
    extra = [c for c in order_cols if c not in columns]
    # the load (embeddings included) is computed once: the lookup of its ids and the write both read this
    rows = cut_lineage(dedup_first(incoming.select(*columns, *extra), id_col, order_cols).select(*columns))
    checked: set[str] = set()  # key indexes that the written rows have been held against
    written: list[tuple[dict, dict]] | None = None

    def add(manifest: dict) -> dict | None:
        nonlocal rows, written
        if done(manifest) is not None:
            return None
        runs = [k for k in manifest["keys"] if k["folder"] not in checked]
        checked.update(k["folder"] for k in runs)
        # at first, and where another load has come before this one with some of its ids
        if written is None or (written and runs and stored_ids(rows.select(F.col(id_col).alias("id")), root, name, runs).limit(1).count()):
            load = _write_load(new_rows(rows, root, name, runs, id_col), root, name, source, load_id, keys_a_bucket)
            written = [load] if load else []
            if load:
                rows = spark.read.schema(STORED).parquet(f"{collection_path(root, name)}/{load[0]['folder']}").select(*columns)
        return {**manifest, "loads": [*manifest["loads"], [source, load_id, sum(d["rows"] for d, _ in written)]],
                "data": [*manifest["data"], *(d for d, _ in written)], "keys": [*manifest["keys"], *(k for _, k in written)]}

    now = log.commit(add, start)
    _merge_keys(spark, root, name, log, now, keys_a_bucket)
    return done_rows(now, source, load_id)


def done_rows(manifest: dict, source: str, load_id: int) -> int:
    return next(n for s, i, n in manifest["loads"] if (s, i) == (source, load_id))


def _merge_keys(spark: SparkSession, root: str, name: str, log: CommitLog, manifest: dict, keys_a_bucket: int) -> None:
    """Merge the youngest key indexes of similar size once there are ``MERGED_RUNS`` of them."""
    runs = manifest["keys"]
    first, total = len(runs) - 1, runs[-1]["rows"] if runs else 0
    while first > 0 and runs[first - 1]["rows"] <= 2 * total:
        first -= 1
        total += runs[first]["rows"]
    if len(runs) - first < MERGED_RUNS:
        return
    old = [k["folder"] for k in runs[first:]]
    parts = [spark.read.schema(_KEY).parquet(f"{collection_path(root, name)}/{f}").select("id") for f in old]
    new = _write_keys(reduce(DataFrame.unionByName, parts), root, name, total, keys_a_bucket)

    def replace(manifest: dict) -> dict | None:
        if not set(old) <= {k["folder"] for k in manifest["keys"]}:
            return None  # another writer has merged them
        kept = [k for k in manifest["keys"] if k["folder"] not in old]
        return {**manifest, "keys": [*kept, new]}

    log.commit(replace)


def collection_count(spark: SparkSession, root: str, name: str) -> int:
    """A1: from the manifest; with opted-out authors, by reading."""
    manifest = commit_log(spark, root, name).latest()
    if manifest["hidden"] is None:
        return sum(d["rows"] for d in manifest["data"])
    return _visible(_rows_of(spark, root, name, manifest), _hidden_of(spark, root, name, manifest)).count()


def _change_hidden(spark: SparkSession, root: str, name: str, change) -> None:
    def hide(manifest: dict) -> dict:
        now = _hidden_of(spark, root, name, manifest)
        users = change(now if now is not None else spark.createDataFrame([], "user_id string"))
        rows, folder = Observation(), _folder(root, name, "hidden")
        users.observe(rows, F.count(F.lit(1)).alias("n")).write.parquet(f"{collection_path(root, name)}/{folder}")
        return {**manifest, "hidden": folder if rows.get["n"] else None}

    commit_log(spark, root, name).commit(hide)


def collection_opt_out(users: DataFrame, root: str, name: str, user_col: str = "user_id") -> None:
    """U1 on what is stored: rows of these authors are in no later read, count or search, whenever they were loaded."""
    wanted = users.select(F.col(user_col).cast("string").alias("user_id")).filter(F.col("user_id").isNotNull())
    _change_hidden(users.sparkSession, root, name, lambda now: optout_add(now, wanted))


def collection_opt_in(users: DataFrame, root: str, name: str, user_col: str = "user_id") -> None:
    """U2 on what is stored: rows of these authors are back, unless they were compacted away."""
    wanted = users.select(F.col(user_col).cast("string").alias("user_id"))
    _change_hidden(users.sparkSession, root, name, lambda now: optout_remove(now, wanted))


def collection_compact(spark: SparkSession, root: str, name: str, keys_a_bucket: int = KEYS_A_BUCKET) -> None:
    """All rows in one folder with one key index; rows of opted-out authors are gone, and their ids may be loaded again."""
    path, log = collection_path(root, name), commit_log(spark, root, name)
    while True:
        seen = log.latest()
        if not seen["data"]:
            return
        rows, folder = Observation(), _folder(root, name, "data")
        kept = _visible(_rows_of(spark, root, name, seen), _hidden_of(spark, root, name, seen))
        kept.observe(rows, F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/{folder}")
        n = int(rows.get["n"])
        ids = spark.read.schema(STORED).parquet(f"{path}/{folder}").select("id")
        data = [{"folder": folder, "rows": n}] if n else []
        keys = [_write_keys(ids, root, name, n, keys_a_bucket)] if n else []
        old = {d["folder"] for d in seen["data"]}, {k["folder"] for k in seen["keys"]}
        lost = False

        def replace(manifest: dict) -> dict | None:
            nonlocal lost
            same = manifest["hidden"] == seen["hidden"] and old[0] <= {d["folder"] for d in manifest["data"]} and old[1] <= {
                k["folder"] for k in manifest["keys"]}
            if not same:
                lost = True
                return None
            return {**manifest, "data": [*data, *[d for d in manifest["data"] if d["folder"] not in old[0]]],
                    "keys": [*keys, *[k for k in manifest["keys"] if k["folder"] not in old[1]]]}

        log.commit(replace, seen)
        if not lost:
            return


def collection_vacuum(spark: SparkSession, root: str, name: str, older_than_s: float = 86_400.0) -> list[str]:
    """Delete folders that the last manifest does not name (of dead loads, merged indexes, former versions) and that are older
    than ``older_than_s``, which must be longer than any load or read takes; returns them."""
    path, files = collection_path(root, name), Files(spark)
    manifest, now = commit_log(spark, root, name).latest(), int(time.time() * 1000)
    live = {manifest["hidden"], *(x["folder"] for kind in ("data", "keys") for x in manifest[kind])}
    gone = [f"{kind}/{n}" for kind in ("data", "keys", "hidden") for n in files.names(f"{path}/{kind}") if f"{kind}/{n}" not in live]
    gone = [f for f in gone if files.age_s(f"{path}/{f}", now) >= older_than_s]
    for folder in gone:
        files.delete(f"{path}/{folder}")
    return gone
