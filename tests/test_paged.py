"""The paged history source: pages, retries, resume, and a stream that goes on from its offsets."""

import json

import pytest

from parley.operators import history as H
from parley.sources.paged import Pages, Unavailable, read_paged, stored_pages, stream_paged

SCHEMA = "id bigint, content string"


def folder_fetch(folder, fail=0):
    """Pages from JSON files named by channel; every page fails ``fail`` times first (counted in files, as tasks are
    processes of their own)."""
    def fetch(channel, before, limit):
        import os
        if fail:
            mark = f"{folder}/tries-{channel}-{before}"
            n = int(open(mark).read()) if os.path.exists(mark) else 0
            open(mark, "w").write(str(n + 1))
            if n < fail:
                raise Unavailable("not now")
        path = f"{folder}/{channel}.json"
        rows = json.load(open(path)) if os.path.exists(path) else []
        rows = sorted((r for r in rows if before is None or int(r["id"]) < before), key=lambda r: -int(r["id"]))
        return rows[:limit]
    return fetch


def put(folder, channel, ids):
    (folder / f"{channel}.json").write_text(json.dumps([{"id": i, "content": f"m{i}", "extra": 1} for i in ids]))


def test_two_pages_give_ten_rows(spark, tmp_path):
    put(tmp_path, "a", range(100, 110))
    rows = read_paged(spark, "t1", Pages(folder_fetch(str(tmp_path)), ("a", "none"), size=5), SCHEMA).collect()
    assert sorted((r.id, r.page) for r in rows) == [(i, 2 if i < 105 else 1) for i in range(100, 110)]
    assert {(r.channel_id, r.attempts, r.content[0]) for r in rows} == {("a", 1, "m")}


def test_pages_are_those_of_the_operator(spark, tmp_path):
    put(tmp_path, "a", range(0, 46, 2))
    put(tmp_path, "b", range(1, 8))
    got = read_paged(spark, "t2", Pages(folder_fetch(str(tmp_path)), ("a", "b"), size=7), SCHEMA)
    want = H.history_pages(got.select("channel_id", "id"), size=7)
    key = lambda df: sorted(map(tuple, df.select("channel_id", "id", "page").collect()))
    assert key(got) == key(want)


def test_retries_count_and_end(spark, tmp_path):
    put(tmp_path, "a", range(6))
    pages = Pages(folder_fetch(str(tmp_path), fail=2), ("a",), size=4, first_pause_s=0.01)
    assert {r.attempts for r in read_paged(spark, "t3", pages, SCHEMA).collect()} == {3}
    with pytest.raises(Exception, match="not now"):
        broken = Pages(folder_fetch(str(tmp_path), fail=99), ("a",), retries=1, first_pause_s=0.01)
        read_paged(spark, "t4", broken, SCHEMA).collect()


def test_other_errors_and_endless_pages_end_the_read(spark):
    with pytest.raises(Exception, match="no such field"):
        read_paged(spark, "t5", Pages(lambda c, b, n: (_ for _ in ()).throw(KeyError("no such field")), ("a",)), SCHEMA).collect()
    with pytest.raises(Exception, match="not below"):
        read_paged(spark, "t6", Pages(lambda c, b, n: [{"id": 7}] * n, ("a",), size=3), SCHEMA).collect()


def test_a_saved_cursor_goes_on(spark, tmp_path):
    put(tmp_path, "a", range(20))
    put(tmp_path, "b", range(3))
    pages = Pages(folder_fetch(str(tmp_path)), ("a", "b"), size=5)
    rows = read_paged(spark, "t7", pages, SCHEMA, cursors={"a": 8}).collect()
    assert sorted(r.id for r in rows if r.channel_id == "a") == list(range(8)) and sum(r.channel_id == "b" for r in rows) == 3


def test_a_stream_reads_only_what_is_new(spark, tmp_path):
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")

    def run():
        pages = Pages(folder_fetch(str(tmp_path)), ("a", "b", "later"), size=4)
        q = (stream_paged(spark, "t8", pages, SCHEMA).writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
        q.awaitTermination()
        return sorted((r.channel_id, r.id) for r in spark.read.parquet(out).collect())

    put(tmp_path, "a", range(10))
    put(tmp_path, "b", range(3))
    first = [("a", i) for i in range(10)] + [("b", i) for i in range(3)]
    assert run() == first
    assert run() == first  # nothing new
    put(tmp_path, "a", range(4, 17))  # older ones are gone from the remote, new ones have come
    put(tmp_path, "later", [5])
    assert run() == sorted(first + [("a", i) for i in range(10, 17)] + [("later", 5)])


def test_stored_pages_open_blocks_only(spark, tmp_path):
    df = spark.createDataFrame([(i, f"m{i}", ["x", "y z", None][i % 3]) for i in range(90)], "id bigint, content string, channel_id string")
    df.selectExpr("*", "id div 20 as block").write.partitionBy("channel_id", "block").parquet(str(tmp_path / "h"))
    fetch = stored_pages(f"file://{tmp_path}/h", 20)
    assert [r["id"] for r in fetch("x", None, 4)] == [87, 84, 81, 78]
    assert [r["id"] for r in fetch("y z", 43, 5)] == [40, 37, 34, 31, 28]
    assert [r["id"] for r in fetch(None, 6, 5)] == [5, 2] and fetch("nobody", None, 5) == []


def test_a_walk_lists_once_and_opens_a_block_once(spark, tmp_path, monkeypatch):
    import pyarrow.dataset as ds
    import pyarrow.fs as fs
    df = spark.createDataFrame([(i, f"m{i}", "x") for i in range(0, 300, 3)], "id bigint, content string, channel_id string")
    df.selectExpr("*", "id div 50 as block").write.partitionBy("channel_id", "block").parquet(str(tmp_path / "h"))
    opened, listed = [], []
    dataset, selector = ds.dataset, fs.FileSelector
    monkeypatch.setattr(ds, "dataset", lambda path, **kw: opened.append(path) or dataset(path, **kw))
    monkeypatch.setattr(fs, "FileSelector", lambda *at, **kw: listed.extend(kw.get("allow_not_found", False) * [at]) or selector(*at, **kw))
    walk = [(m["id"], page) for m, page, _ in Pages(stored_pages(f"file://{tmp_path}/h", 50), ("x",), size=4).walk("x", None)]
    assert walk == [(i, k // 4 + 1) for k, i in enumerate(range(297, -1, -3))]
    assert len(opened) == len(set(opened)) == 6 and len(listed) == 1


def test_new_blocks_are_seen_by_the_next_walk(spark, tmp_path):
    def put_block(lo, hi):
        df = spark.range(lo, hi).selectExpr("id", "'x' channel_id", "id div 10 as block")
        df.write.mode("append").partitionBy("channel_id", "block").parquet(str(tmp_path / "h"))

    put_block(0, 15)
    fetch = stored_pages(f"file://{tmp_path}/h", 10)
    assert [r["id"] for r in fetch("x", None, 2)] == [14, 13]
    put_block(15, 25)
    assert [r["id"] for r in fetch("x", None, 7)] == [24, 23, 22, 21, 20, 19, 18]
