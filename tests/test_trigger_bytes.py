"""Micro-batches of the message streams are bounded by bytes: their number does not go with that of the files."""

import os

import pytest

from parley.plans import q_io
from parley.sources.batches import read_message_batches
from parley.streaming.ingest import message_file_stream

TURNS = 110


@pytest.fixture()
def small_files(spark, tmp_path, monkeypatch):
    """(folder of the tables, scratch folder): 110 conversations of a turn, each in a batch file of its own."""
    rows = [(i, 0, ["user", "system"][i % 5 == 0], f"message {i}") for i in range(TURNS)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(
        str(tmp_path / "sf" / "conversations.parquet"))
    monkeypatch.setattr(q_io, "CONVERSATIONS", 1)
    monkeypatch.setattr(q_io, "shared_dir", lambda _spark, name: str(tmp_path / "run" / name))
    return str(tmp_path / "sf"), str(tmp_path / "run")


def micro_batches(folder):
    return sum(not f.startswith(".") for f in os.listdir(f"{folder}/commits"))


def test_small_files_share_a_micro_batch(spark, small_files, tmp_path):
    path = q_io._conversation_batches(spark, small_files[0])
    q = (message_file_stream(spark, path).writeStream.format("parquet").option("path", str(tmp_path / "out"))
         .option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == TURNS and micro_batches(str(tmp_path / "ckpt")) == 1


def test_progress_stream(spark, small_files):
    got = {r.channel_id: r.messages for r in q_io.q_progress_stream(spark, small_files[0]).collect()}
    assert got == {str(i): 1 for i in range(TURNS)}
    assert 1 < micro_batches(f"{small_files[1]}/progress_ckpt") <= q_io.MICRO_BATCHES + 1


def test_ingest_state_stream(spark, small_files):
    got = {r.channel_id: tuple(r)[1:] for r in q_io.q_ingest_state_stream(spark, small_files[0]).collect()}
    assert got == {str(i): (str(1000 * i), 1, 1) for i in range(TURNS)}
    assert 1 < micro_batches(f"{small_files[1]}/state_stream_ckpt") <= q_io.MICRO_BATCHES + 1


def test_privacy_and_ingest_stream(spark, small_files):
    got = sorted(r.id for r in q_io.q_privacy_stream(spark, small_files[0]).collect())
    assert got == sorted(str(1000 * i) for i in range(TURNS) if i % 5)
    assert q_io.q_ingest_stream(spark, small_files[0]).count() == TURNS
    for name in ("privacy", "ingest"):
        assert 1 < micro_batches(f"{small_files[1]}/{name}_ckpt") <= q_io.MICRO_BATCHES + 1


def test_dedup_stream(spark, small_files):
    assert sorted(int(r.id) for r in q_io.q_dedup_stream(spark, small_files[0]).collect()) == [1000 * i for i in range(TURNS)]
    # one more without data, for the watermark
    assert 1 < micro_batches(f"{small_files[1]}/dedup_ckpt") <= q_io.MICRO_BATCHES + 2
    # every message is delivered twice
    assert read_message_batches(spark, f"{small_files[1]}/batches").count() == 2 * TURNS
