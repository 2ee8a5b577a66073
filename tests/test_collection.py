"""The versioned collection: key index, commits of concurrent and dead loads, opt-out of what is stored."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from parley.operators.search import search_topk
from parley.sources import collection as C
from parley.sources.manifest import CommitLog, Files

META = ("metadata struct<author:string,timestamp:string,channel_id:string,has_attachments:boolean,"
        "has_reactions:boolean,has_mentions:boolean>")


def rows_of(spark, ids, doc="d", author=lambda i: None):
    data = [(str(i), [float(i % 7), 1.0], f"{doc}{i}", (author(i), None, None, False, False, False)) for i in ids]
    return spark.createDataFrame(data, f"id string, embedding array<float>, document string, {META}")


def stored(spark, root):
    return {r.id: r.document for r in C.open_collection(spark, root, "c").collect()}


def manifest(spark, root):
    return C.commit_log(spark, root, "c").latest()


def test_a_load_opens_only_the_buckets_of_its_ids(spark, tmp_path):
    """Bytes opened by a load of 50 ids grow by less than 2x when the collection is ten times as large."""
    opened = []
    for n in (1_000, 10_000):
        root = str(tmp_path / str(n))
        C.collection_add(rows_of(spark, range(n)), root, "c", 1, keys_a_bucket=10)
        (run,) = manifest(spark, root)["keys"]
        assert run["rows"] == n and 1 << run["bits"] >= n / 10
        ids = spark.createDataFrame([(f"new{i}",) for i in range(49)] + [("7",)], "id string")
        found = C.stored_ids(ids, root, "c", [run])
        assert [r.id for r in found.collect()] == ["7"]
        assert "PartitionFilters: [bucket" in found._jdf.queryExecution().executedPlan().toString()
        buckets = [r[0] for r in ids.select(C._bucket("id", run["bits"])).distinct().collect()]
        files = Files(spark)
        opened.append(sum(files.size(f"{root}/c/{run['folder']}/bucket={b}") for b in buckets))
        total = files.size(f"{root}/c/{run['folder']}")
    assert opened[1] < 2 * opened[0] and opened[1] < total / 10


def test_key_indexes_of_similar_size_are_merged(spark, tmp_path):
    root = str(tmp_path)
    for load in range(10):
        assert C.collection_add(rows_of(spark, range(load * 5, load * 5 + 10), f"l{load}-"), root, "c", load,
                                keys_a_bucket=4) == (10 if load == 0 else 5)
    m = manifest(spark, root)
    assert len(m["keys"]) <= C.MERGED_RUNS + 1 and sum(k["rows"] for k in m["keys"]) == 55 == C.collection_count(spark, root, "c")
    assert {r.id for k in m["keys"] for r in spark.read.parquet(f"{root}/c/{k['folder']}").collect()} == {str(i) for i in range(55)}
    assert stored(spark, root) == {str(i): f"l{max(0, (i - 5) // 5)}-{i}" for i in range(55)}


def test_two_loads_of_the_same_ids_store_each_once(spark, tmp_path):
    """Both look their ids up before either commits; the one that commits second looks again."""
    root, gate, errors = str(tmp_path), threading.Barrier(2, timeout=120), []
    plain = CommitLog.commit

    def commit(self, change, seen=None):
        first = True

        def together(manifest):
            nonlocal first
            out = change(manifest)
            if first and seen is not None:
                first = False
                gate.wait()  # both have written their rows, neither has committed
            return out
        return plain(self, together, seen)

    def load(number, ids):
        try:
            C.collection_add(rows_of(spark, ids, f"l{number}-"), root, "c", number)
        except Exception as e:
            errors.append(e)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(CommitLog, "commit", commit)
        threads = [threading.Thread(target=load, args=(k, ids)) for k, ids in ((1, range(0, 30)), (2, range(20, 50)))]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
    assert not errors
    rows = C.open_collection(spark, root, "c").collect()
    assert sorted(int(r.id) for r in rows) == list(range(50)) and C.collection_count(spark, root, "c") == 50
    sizes = {(s, i): n for s, i, n in manifest(spark, root)["loads"]}
    assert sorted(sizes.values()) == [20, 30]


def test_a_load_that_dies_is_invisible(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    C.collection_add(rows_of(spark, [1, 2], "first"), root, "c", 1)
    with monkeypatch.context() as patch:
        patch.setattr(Files, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            C.collection_add(rows_of(spark, [2, 3], "dead"), root, "c", 2)
    assert stored(spark, root) == {"1": "first1", "2": "first2"}
    assert C.collection_vacuum(spark, root, "c") == []  # too young
    assert len(C.collection_vacuum(spark, root, "c", older_than_s=0)) == 2
    C.collection_add(rows_of(spark, [2, 3], "again"), root, "c", 2)
    assert stored(spark, root) == {"1": "first1", "2": "first2", "3": "again3"}


def test_a_number_is_published_once(spark, tmp_path):
    files = Files(spark)
    for k in "ab":
        files.write(f"{tmp_path}/{k}", k)
    assert files.publish(f"{tmp_path}/a", f"{tmp_path}/log") and not files.publish(f"{tmp_path}/b", f"{tmp_path}/log")
    assert files.read(f"{tmp_path}/log") == "a"


def test_old_manifests_are_forgotten(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("parley.sources.manifest.KEPT_VERSIONS", 5)
    log = CommitLog(spark, str(tmp_path / "log"), {"n": 0})
    for _ in range(12):
        log.commit(lambda m: {**m, "n": m["n"] + 1})
    assert log.latest() == {"n": 12, "version": 12} and log.versions()[0] > 5
    assert log.commit(lambda m: None)["n"] == 12
    assert not [f for f in os.listdir(tmp_path / "log") if "draft" in f and not f.endswith(".crc")]


def test_opt_out_after_the_load(spark, tmp_path):
    root = str(tmp_path)
    author = lambda i: ["ann", "bob", None][i % 3]
    C.collection_add(rows_of(spark, range(9), author=author), root, "c", 1)
    users = spark.createDataFrame([("ann",), ("eve",), (None,)], "user_id string")
    C.collection_opt_out(users, root, "c")
    assert sorted(stored(spark, root)) == ["1", "2", "4", "5", "7", "8"] and C.collection_count(spark, root, "c") == 6
    C.collection_add(rows_of(spark, range(9, 12), author=author), root, "c", 2)  # hidden at once
    assert sorted(map(int, stored(spark, root))) == [1, 2, 4, 5, 7, 8, 10, 11]
    found = search_topk(C.open_collection(spark, root, "c").select("id", "embedding"), [0.0, 1.0], 20)
    assert "0" not in {r.id for r in found.collect()}
    C.collection_opt_in(users.limit(1), root, "c")
    assert len(stored(spark, root)) == 12
    C.collection_opt_in(spark.createDataFrame([("eve",)], "user_id string"), root, "c")
    assert manifest(spark, root)["hidden"] is None


def test_compaction_removes_hidden_rows_and_their_ids(spark, tmp_path):
    root = str(tmp_path)
    for load in range(3):
        C.collection_add(rows_of(spark, range(load * 4, load * 4 + 4), author=lambda i: "ab"[i % 2]), root, "c", load)
    C.collection_opt_out(spark.createDataFrame([("a",)], "user_id string"), root, "c")
    C.collection_compact(spark, root, "c")
    m = manifest(spark, root)
    assert len(m["data"]) == len(m["keys"]) == 1 and m["data"][0]["rows"] == 6
    C.collection_opt_in(spark.createDataFrame([("a",)], "user_id string"), root, "c")
    assert sorted(map(int, stored(spark, root))) == [1, 3, 5, 7, 9, 11]
    assert C.collection_add(rows_of(spark, range(4), "back"), root, "c", 9) == 2
    assert stored(spark, root)["0"] == "back0" and stored(spark, root)["1"] == "d1"
    C.collection_vacuum(spark, root, "c", older_than_s=0)
    assert len(stored(spark, root)) == 8


def test_empty_loads(spark, tmp_path):
    root = str(tmp_path)
    assert C.collection_add(rows_of(spark, []), root, "c", 1) == 0 and C.collection_count(spark, root, "c") == 0
    assert C.collection_add(rows_of(spark, [1]), root, "c", 2) == 1 and C.collection_add(rows_of(spark, [1]), root, "c", 3) == 0
    assert C.collection_add(rows_of(spark, [2]), root, "c", 1, retry=True) == 0  # found done
    C.collection_compact(spark, root, "c")
    assert C.open_collection(spark, root, "c").select(F.col("id")).collect()[0].id == "1"
