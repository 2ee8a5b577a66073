"""Column and file encryption (X1, K4, K5, S8): AES-GCM with a 256-bit key, native ``aes_encrypt``.

Keys are arguments (16/24/32 bytes); key files and permissions are out of scope. Two forms for files: ``encrypt_files``
with one key for all, and envelopes: every file has a random key of its own, which is stored wrapped by a named master key.
Changing the master key rewraps those small keys and leaves the payloads as they are. Name and use of a file are bound to
both ciphertexts as associated data, so a blob or key under another name does not decrypt.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.sources.manifest import CommitLog


def _key(spark: SparkSession, key: bytes | str) -> Column:
    """The key as a scalar subquery over a one-row table: plans, logs and events name its column, not its bytes."""
    k = key.encode() if isinstance(key, str) else bytes(key)
    if len(k) not in (16, 24, 32):
        raise ValueError("AES key must be 16, 24 or 32 bytes")
    return spark.createDataFrame(spark.sparkContext.parallelize([(bytearray(k),)], 1), "aes_key binary").scalar()


def encrypt_rows(df: DataFrame, cols: Sequence[str], key: bytes | str | None, *, keep: Sequence[str] = (),
                 out_col: str = "blob") -> DataFrame:
    """K4: JSON of the chosen columns (non-ASCII kept as is), encrypted, base64 text. Without a key (encryption off)
    the JSON itself."""
    payload = F.to_json(F.struct(*[F.col(c) for c in cols]), {"ignoreNullFields": "false"})
    if key is None:
        return df.select(*keep, payload.alias(out_col))
    blob = F.base64(F.aes_encrypt(F.encode(payload, "UTF-8"), _key(df.sparkSession, key), F.lit("GCM")))
    return df.select(*keep, blob.alias(out_col))


def decrypt_rows(df: DataFrame, key: bytes | str | None, schema: T.StructType | str, *, keep: Sequence[str] = (),
                 blob_col: str = "blob", on_error: str = "raise") -> DataFrame:
    """Decrypt and parse. ``on_error='raise'`` fails the job on a bad blob (reference behaviour);
    ``'null'`` yields null columns instead. Without a key the column holds plain JSON."""
    if key is None:
        plain = F.col(blob_col)
    else:
        decrypt = F.aes_decrypt if on_error == "raise" else F.try_aes_decrypt
        plain = decrypt(F.unbase64(F.col(blob_col)), _key(df.sparkSession, key), F.lit("GCM"))
    parsed = F.from_json(plain.cast("string"), schema)
    return df.select(*keep, parsed.alias("_d")).select(*keep, "_d.*")


def encrypt_files(spark: SparkSession, in_dir: str, out: str, key: bytes | str, glob: str = "*", *,
                  keep_path: bool = False) -> DataFrame:
    """K5: every file under ``in_dir`` encrypted under its own name into a parquet table
    ``(name, blob)`` (plus ``source_path`` if asked). One file per row: files are message batches."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
             .option("recursiveFileLookup", "true").load(in_dir))
    cols = [F.element_at(F.split("path", "/"), -1).alias("name"),
            F.aes_encrypt(F.col("content"), _key(spark, key), F.lit("GCM")).alias("blob")]
    if keep_path:
        cols.append(F.col("path").alias("source_path"))
    files.select(*cols).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def decrypt_files(spark: SparkSession, path: str, key: bytes | str) -> DataFrame:
    """Inverse of :func:`encrypt_files`: ``(name, content)`` and any carried columns."""
    t = spark.read.parquet(path)
    return t.withColumn("content", F.aes_decrypt(F.col("blob"), _key(spark, key), F.lit("GCM"))).drop("blob")


def _master_keys(spark: SparkSession, keys: dict[str, bytes]) -> DataFrame:
    """(key_id, master) from an RDD, so that plans do not show the keys."""
    for k in keys.values():
        if len(k) not in (16, 24, 32):
            raise ValueError("AES key must be 16, 24 or 32 bytes")
    rows = [(name, bytearray(k)) for name, k in keys.items()]
    return F.broadcast(spark.createDataFrame(spark.sparkContext.parallelize(rows, 1), "key_id string, master binary"))


def _envelope_log(spark: SparkSession, path: str) -> CommitLog:
    return CommitLog(spark, f"{path}/_log", {"blobs": None, "keys": None})


def _bound(name: Column | str, use: str) -> Column:
    """Associated data: what the ciphertext is of."""
    return F.encode(F.concat(F.lit(f"{use}:"), F.col("file_id"), F.lit(":"), F.col(name) if isinstance(name, str) else name), "UTF-8")


def _seal(value: Column, key: Column, aad: Column) -> Column:
    return F.aes_encrypt(value, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), aad)


def _unseal(value: Column, key: Column, aad: Column, on_error: str = "raise") -> Column:
    decrypt = F.aes_decrypt if on_error == "raise" else F.try_aes_decrypt
    return decrypt(value, key, F.lit("GCM"), F.lit("DEFAULT"), aad)


def with_data_keys(files: DataFrame) -> DataFrame:
    """``files`` with a random ``file_id`` and ``data_key`` (32 bytes from the operating system) for every row."""
    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = pa.array([uuid.uuid4().hex for _ in range(b.num_rows)], pa.string())
            keys = pa.array([os.urandom(32) for _ in range(b.num_rows)], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, ids, keys], [*b.schema.names, "file_id", "data_key"])

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInArrow(draw, f"{kind}, file_id string, data_key binary")


def encrypt_envelopes(spark: SparkSession, in_dir: str, out: str, keys: dict[str, bytes], key_id: str, glob: str = "*") -> None:
    """K5 with envelopes: every file under ``in_dir`` into ``out``, its key wrapped by the master key ``key_id``.
    Spark lists no files without content, so those are left out."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(in_dir)
             .select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("path").alias("source_path"), "content"))
    names = {"blobs": f"blobs/{uuid.uuid4().hex}", "keys": f"keys/{uuid.uuid4().hex}"}
    sealed = with_data_keys(files).withColumn("key_id", F.lit(key_id)).join(_master_keys(spark, {key_id: keys[key_id]}), "key_id")
    # key and payload of a file are written together, so that they come from one draw whatever is run again
    sealed.select("file_id", "name", "source_path", "key_id", _seal(F.col("content"), F.col("data_key"), _bound("name", "file")).alias("blob"),
                  _seal(F.col("data_key"), F.col("master"), _bound("name", "key")).alias("wrapped")).write.parquet(f"{out}/{names['blobs']}")
    stored = spark.read.parquet(f"{out}/{names['blobs']}")
    stored.select("file_id", "name", "key_id", "wrapped").write.parquet(f"{out}/{names['keys']}")
    _envelope_log(spark, out).commit(lambda manifest: {**manifest, **names})


def rotate_envelopes(spark: SparkSession, path: str, keys: dict[str, bytes], key_id: str) -> None:
    """Wrap every file's key by the master key ``key_id`` instead of the one it has; ``keys`` must have both. Payloads are
    not touched; readers see the old keys or the new ones."""
    log = _envelope_log(spark, path)

    def rewrap(manifest: dict) -> dict:
        folder = f"keys/{uuid.uuid4().hex}"
        old = spark.read.parquet(f"{path}/{manifest['keys']}").join(_master_keys(spark, keys), "key_id", "left")
        plain = F.when(F.col("master").isNull(), F.raise_error(F.concat(F.lit("no master key "), F.col("key_id")))).otherwise(
            _unseal(F.col("wrapped"), F.col("master"), _bound("name", "key")))
        new = old.select("file_id", "name", F.lit(key_id).alias("key_id"), plain.alias("data_key")).join(
            _master_keys(spark, {key_id: keys[key_id]}), "key_id")
        new.select("file_id", "name", "key_id", _seal(F.col("data_key"), F.col("master"), _bound("name", "key")).alias("wrapped")) \
            .write.parquet(f"{path}/{folder}")
        return {**manifest, "keys": folder}

    log.commit(rewrap)


def decrypt_envelopes(spark: SparkSession, path: str, keys: dict[str, bytes], on_error: str = "raise") -> DataFrame:
    """(name, source_path, content) of every file. A blob or key that does not decrypt, or whose master key is not given, is an
    error, or null content with ``on_error='null'``."""
    manifest = _envelope_log(spark, path).latest()
    wrapped = spark.read.parquet(f"{path}/{manifest['keys']}").select("file_id", "key_id", "wrapped")
    blobs = spark.read.parquet(f"{path}/{manifest['blobs']}").select("file_id", "name", "source_path", "blob")
    known = blobs.join(wrapped, "file_id", "left").join(_master_keys(spark, keys), "key_id", "left")
    data_key = _unseal(F.col("wrapped"), F.col("master"), _bound("name", "key"), on_error)
    content = _unseal(F.col("blob"), data_key, _bound("name", "file"), on_error)
    if on_error == "raise":
        content = F.when(F.col("master").isNull(), F.raise_error(F.concat(F.lit("no master key for "), F.col("name"))).cast("binary")
                         ).otherwise(content)
    return known.select("name", "source_path", content.alias("content"))
