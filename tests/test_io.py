"""Batch files (good and bad), opt-out file, ingest state, collection, encryption, streams."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from parley.operators.normalize import normalize_saved
from parley.sources.batches import read_message_batches
from parley.sources.collection import collection_add, collection_count, open_collection
from parley.sources.registry import load_ingest_state, read_opt_out
from parley.sources.secure import decrypt_rows, encrypt_rows
from parley.streaming.ingest import ingest_stream


def _msgs(n, start=0):
    return [{"id": str(start + i), "content": f"m{start + i}", "author": "tester",
             "timestamp": "2025-01-01T12:00:00", "channel_id": "c"} for i in range(n)]


@pytest.fixture()
def batch_dir():
    d = tempfile.mkdtemp(prefix="batches-")
    for b in (1, 2, 3):
        with open(os.path.join(d, f"messages_batch_{b:04d}.json"), "w") as f:
            json.dump(_msgs(5, 10 * b), f, indent=2)
    bad = {"messages_batch_0004.json": b"this is not json", "messages_batch_0005.json": b"",
           "messages_batch_0006.json": b'[{"id": "1", "content": "x"', "messages_batch_0007.json": b"[\xff\xfe]",
           "messages_batch_0008.json": b'{"id": "9", "content": "root object"}'}
    for name, data in bad.items():
        with open(os.path.join(d, name), "wb") as f:
            f.write(data)
    with open(os.path.join(d, "other.json"), "w") as f:
        json.dump(_msgs(2), f)
    return d


def test_read_batches_skips_bad_files(spark, batch_dir):
    raw = read_message_batches(spark, batch_dir)
    rows = normalize_saved(raw, keep=("batch", "pos")).orderBy("batch", "pos").collect()
    assert len(rows) == 15 and [r.batch for r in rows[::5]] == [1, 2, 3]
    assert [r.id for r in rows[:5]] == ["10", "11", "12", "13", "14"] and rows[0].author == "tester"


def test_opt_out_file(spark, tmp_path):
    p = tmp_path / "optout.txt"
    p.write_text("  u1 \n\nu2\n u1\n")
    assert sorted(r.user_id for r in read_opt_out(spark, str(p)).collect()) == ["u1", "u2"]
    assert read_opt_out(spark, str(tmp_path / "missing.txt")).count() == 0


def test_ingest_state(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"channel_id": "55501", "oldest_message_id": 900719925474099301,
                                                 "batch_count": 3, "total_messages": 271,
                                                 "last_updated": "2024-05-04T03:02:01"}, indent=2))
    (tmp_path / "c.json").write_text(json.dumps({"channel_id": "no time", "oldest_message_id": "8", "batch_count": 1,
                                                 "total_messages": 9}))
    (tmp_path / "b.json").write_text("{not json")
    st = load_ingest_state(spark, str(tmp_path), "55501").collect()
    assert [(r.oldest_message_id, r.batch_count, r.total_messages) for r in st] == [("900719925474099301", 3, 271)]
    st = load_ingest_state(spark, str(tmp_path), "no time").collect()
    assert [(r.oldest_message_id, r.batch_count, r.total_messages) for r in st] == [("8", 1, 9)]
    assert load_ingest_state(spark, str(tmp_path), "other").count() == 0
    assert load_ingest_state(spark, str(tmp_path / "nope")).count() == 0


def _coll_rows(spark, ids, doc):
    return spark.createDataFrame([(str(i), [float(i), 1.0], f"{doc}{i}", None) for i in ids],
                                 "id string, embedding array<float>, document string, "
                                 "metadata struct<author:string,timestamp:string,channel_id:string,"
                                 "has_attachments:boolean,has_reactions:boolean,has_mentions:boolean>")


def test_collection_insert_if_absent_and_idempotent(spark, tmp_path):
    root = str(tmp_path)
    assert open_collection(spark, root, "c").count() == 0
    collection_add(_coll_rows(spark, [1, 2, 3], "first"), root, "c", 1)
    collection_add(_coll_rows(spark, [3, 4], "second"), root, "c", 2)
    collection_add(_coll_rows(spark, [3, 4], "second"), root, "c", 2, retry=True)  # retried load: same result
    with pytest.raises(ValueError):
        collection_add(_coll_rows(spark, [5], "third"), root, "c", 2)
    docs = dict((r.id, r.document) for r in open_collection(spark, root, "c").collect())
    assert docs == {"1": "first1", "2": "first2", "3": "first3", "4": "second4"}
    assert collection_count(spark, root, "c") == 4


def test_encryption_round_trip_and_wrong_key(spark):
    df = spark.createDataFrame([(1, "ünïcode ✓", "a")], "k int, text string, role string")
    key = b"k" * 32
    enc = encrypt_rows(df, ["text", "role"], key, keep=["k"])
    back = decrypt_rows(enc, key, "text string, role string", keep=["k"]).first()
    assert (back.text, back.role) == ("ünïcode ✓", "a")
    bad = decrypt_rows(enc, b"x" * 32, "text string, role string", on_error="null").first()
    assert bad.text is None
    with pytest.raises(Exception):
        decrypt_rows(enc, b"x" * 32, "text string, role string").collect()


def test_ingest_stream_resumes(spark, batch_dir, tmp_path):
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    ingest_stream(spark, batch_dir, out, ckpt, max_files_per_trigger=2)
    assert spark.read.parquet(out).count() == 15
    with open(os.path.join(batch_dir, "messages_batch_0009.json"), "w") as f:
        json.dump(_msgs(5, 90), f)
    ingest_stream(spark, batch_dir, out, ckpt)  # restart: only the new file is read
    assert spark.read.parquet(out).count() == 20


def test_encrypt_files_round_trip(spark, batch_dir, tmp_path):
    from parley.sources.secure import decrypt_files, encrypt_files
    key = b"0123456789abcdef0123456789abcdef"
    enc = encrypt_files(spark, batch_dir, str(tmp_path / "enc"), key, glob="messages_batch_000[1-3].json")
    assert enc.count() == 3
    back = {r.name: bytes(r.content) for r in decrypt_files(spark, str(tmp_path / "enc"), key).collect()}
    with open(os.path.join(batch_dir, "messages_batch_0001.json"), "rb") as f:
        assert back["messages_batch_0001.json"] == f.read()


def test_embed_plugin_equals_native_test_encoder(spark):
    from parley.functions.messages import embed_test
    from parley.operators.embed import FirstCharsEncoder, embed
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["hello", "ab", "", "ünï", "12345"])], "i int, t string")
    got = embed(df, FirstCharsEncoder, "t", batch=2).select("i", "embedding", embed_test("t").alias("native"))
    for r in got.collect():
        assert [round(x, 6) for x in r.embedding] == [round(x, 6) for x in r.native]


def test_privacy_stream(spark, batch_dir, tmp_path):
    from parley.streaming.ingest import message_file_stream, privacy_stream
    reg = spark.createDataFrame([("nobody",)], "user_id string")
    s = privacy_stream(message_file_stream(spark, batch_dir), reg)
    out, ckpt = str(tmp_path / "p_out"), str(tmp_path / "p_ckpt")
    q = s.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt) \
        .trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(out).count() == 15


def test_write_batch_files_splits_large_batches(spark, tmp_path):
    from parley.sources.batches import write_batch_files
    rows = [(1 if i < 250 else 2, i, str(i), f"m{i}", "a", "2025-01-01T12:00:00", "c") for i in range(260)]
    df = spark.createDataFrame(rows, "batch long, turn long, id string, content string, author string, "
                                     "timestamp string, channel_id string")
    out = str(tmp_path / "b")
    write_batch_files(df, out, "batch", "turn", max_rows=100)
    back = read_message_batches(spark, out, glob="part-*")
    assert back.count() == 260 and back.select("file").distinct().count() == 4  # 100 + 100 + 50, and 10
    assert back.groupBy("file").count().agg(F.max("count")).first()[0] == 100


def test_compact_message_batches(spark, batch_dir, tmp_path):
    from parley.plans.jobs import compact_message_batches
    t = compact_message_batches(spark, batch_dir, str(tmp_path / "t"), str(tmp_path / "rej"))
    assert t.count() == 15 and t.select("channel_id").distinct().count() == 1
    assert spark.read.parquet(str(tmp_path / "rej")).count() == 0


def test_ingest_stream_partitioned(spark, batch_dir, tmp_path):
    out, ckpt = str(tmp_path / "pout"), str(tmp_path / "pckpt")
    ingest_stream(spark, batch_dir, out, ckpt, partition_by=("channel_id",))
    assert os.path.isdir(os.path.join(out, "channel_id=c")) and spark.read.parquet(out).count() == 15


def test_first_write_wins_in_order_and_null_ids_stay_out(spark, tmp_path):
    rows = _coll_rows(spark, [1, 1, 2], "z").unionByName(_coll_rows(spark, [1], "a"))
    rows = rows.unionByName(rows.limit(1).selectExpr("cast(null as string) id", "embedding", "document", "metadata"))
    collection_add(rows, str(tmp_path), "c", 5)
    collection_add(_coll_rows(spark, [1, 2, 3], "later"), str(tmp_path), "c", 4)  # an older number does not matter
    assert {r.id: r.document for r in open_collection(spark, str(tmp_path), "c").collect()} == {
        "1": "a1", "2": "z2", "3": "later3"}


def test_unreadable_registry_is_an_error(spark, tmp_path):
    assert read_opt_out(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception):
        read_opt_out(spark, "nosuchfs://x/y")


def test_key_is_not_in_plans_and_encryption_can_be_off(spark, capsys):
    key = b"SECRETSECRETSECRETSECRETSECRETSE"
    df = spark.createDataFrame([(1, "a")], "k int, text string")
    enc = encrypt_rows(df, ["text"], key, keep=["k"])
    enc.explain("extended")
    dec = decrypt_rows(enc, key, "text string", keep=["k"])
    dec.collect()
    dec.explain("formatted")
    shown = capsys.readouterr().out + dec._jdf.queryExecution().toString()
    assert "SECRET" not in shown and key.hex().upper() not in shown.upper()
    plain = encrypt_rows(df, ["text"], None, keep=["k"])
    assert plain.first().blob == '{"text":"a"}'
    assert decrypt_rows(plain, None, "text string", keep=["k"]).first().text == "a"


def test_written_batches_are_found_by_the_default_reader(spark, tmp_path):
    from parley.sources.batches import write_batch_files
    df = spark.createDataFrame([(1, i, str(i), "x") for i in range(250)], "batch int, place int, id string, content string")
    write_batch_files(df, str(tmp_path / "b"), "batch", "place")
    back = normalize_saved(read_message_batches(spark, str(tmp_path / "b")), keep=("pos",))
    assert sorted((int(r.id) % 100) == r.pos for r in back.collect()) == [True] * 250
