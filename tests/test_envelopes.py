"""Files with a key each, wrapped by master keys."""

import pytest
from pyspark.sql import functions as F

from parley.sources import secure as S

KEYS = {"one": b"1" * 32, "two": b"2" * 32}


@pytest.fixture()
def stored(spark, tmp_path):
    (tmp_path / "in").mkdir()
    files = {f"f{i}.json": f"payload {i} ünï".encode() * (i + 1) for i in range(4)}
    for name, data in files.items():
        (tmp_path / "in" / name).write_bytes(data)
    S.encrypt_envelopes(spark, str(tmp_path / "in"), str(tmp_path / "out"), KEYS, "one", glob="*.json")
    return str(tmp_path / "out"), files


def contents(df):
    return {r.name: None if r.content is None else bytes(r.content) for r in df.collect()}


def tables(spark, path):
    m = S._envelope_log(spark, path).latest()
    return spark.read.parquet(f"{path}/{m['blobs']}"), spark.read.parquet(f"{path}/{m['keys']}")


def test_round_trip_and_a_key_a_file(spark, stored):
    path, files = stored
    assert contents(S.decrypt_envelopes(spark, path, KEYS)) == files
    blobs, keys = tables(spark, path)
    assert keys.select("wrapped").distinct().count() == len(files) and {r.key_id for r in keys.collect()} == {"one"}
    assert not any(b"payload" in bytes(r.blob) for r in blobs.collect())


def test_rotation_rewraps_keys_only(spark, stored):
    path, files = stored
    before = {r.file_id: bytes(r.blob) for r in tables(spark, path)[0].collect()}
    S.rotate_envelopes(spark, path, KEYS, "two")
    blobs, keys = tables(spark, path)
    assert {r.file_id: bytes(r.blob) for r in blobs.collect()} == before and {r.key_id for r in keys.collect()} == {"two"}
    assert contents(S.decrypt_envelopes(spark, path, {"two": KEYS["two"]})) == files
    with pytest.raises(Exception, match="no master key"):
        S.decrypt_envelopes(spark, path, {"one": KEYS["one"]}).collect()
    assert set(contents(S.decrypt_envelopes(spark, path, {"one": KEYS["one"]}, on_error="null")).values()) == {None}
    with pytest.raises(Exception, match="no master key"):
        S.rotate_envelopes(spark, path, {"one": KEYS["one"]}, "one")


def test_a_swapped_blob_fails(spark, stored, tmp_path):
    path, files = stored
    m = S._envelope_log(spark, path).latest()
    blobs = tables(spark, path)[0]
    swap = {"f1.json": "f2.json", "f2.json": "f1.json"}
    name = F.col("name")
    for a, b in swap.items():
        name = F.when(F.col("name") == a, F.lit(b)).otherwise(name)
    blobs.withColumn("name", name).write.parquet(f"{path}/blobs/swapped")
    S._envelope_log(spark, path).commit(lambda x: {**m, "blobs": "blobs/swapped"})
    with pytest.raises(Exception):
        S.decrypt_envelopes(spark, path, KEYS).collect()
    got = contents(S.decrypt_envelopes(spark, path, KEYS, on_error="null"))
    assert got == {k: None if k in swap else v for k, v in files.items()}


def test_keys_are_not_in_plans(spark, stored):
    path, _ = stored
    plan = S.decrypt_envelopes(spark, path, KEYS)._jdf.queryExecution().toString()
    assert "1" * 32 not in plan and ("31" * 32) not in plan
    with pytest.raises(ValueError):
        S.decrypt_envelopes(spark, path, {"short": b"x"})
