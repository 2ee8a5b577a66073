"""The stages in their order over awkward and planted documents, and the package without the optional parts."""

import os
import shutil
import subprocess
import sys
from collections import Counter

import corpus_pipeline
from helpers import SCHEMA, messy_rows, prose


ROOT = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))


def test_stages_are_the_operators_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "suffix_dedup", "mixing",
                                                      "best_fit_packing"]


def test_each_stage_works_on_what_its_predecessor_kept(spark, tmp_path):
    passage = prose(50, 90)  # over 400 bytes, in several documents
    rows = [(1000 + i, prose(200 + i, 120), "en", f"s{i % 4}", 1) for i in range(30)]
    rows += [(2000 + i, prose(300 + i, 70) + "\n" + passage + "\n" + prose(400 + i, 70), "en", "s1", 1) for i in range(4)]
    rows += [(3000 + i, prose(500, 100), "de", "s2", 1) for i in range(5)]  # exact copies
    docs = spark.createDataFrame(rows + messy_rows(), SCHEMA)
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, seen[-1], "").write.parquet(str(tmp_path / name))
        seen.append(spark.read.parquet(str(tmp_path / name)))
    good, single, clean, mixed, packed = seen[1:]
    for df in seen[1:-1]:
        assert df.columns == docs.columns and df.dtypes == docs.dtypes
    ids = [{r.doc_id for r in df.select("doc_id").collect()} for df in seen]
    assert {r[0] for r in rows} <= ids[1] and not {3, 4, 5, 7, 9, -5} & ids[1]
    assert ids[2] & set(range(3000, 3005)) == {3000}
    assert ids[3] == ids[2]
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert all(passage not in texts[i] and len(texts[i]) > 400 for i in range(2000, 2004) if i in texts)
    assert all(texts[i] == t for i, t, *_ in rows if i < 2000 and i in texts)
    assert ids[4] <= ids[3] and ids[4]
    assert {r.doc_id for r in packed.collect()} == ids[4]
    # the whole run equals the stages one by one
    whole = str(tmp_path / "sf")
    docs.write.parquet(whole + "/documents.parquet")
    got = corpus_pipeline.run(spark, whole)
    assert Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in got.collect()) == Counter(
        (r.doc_id, r.piece, r.length, r.ids_crc32) for r in packed.collect())


def test_the_mix_leaves_no_source_out(spark):
    docs = spark.createDataFrame([(i, prose(600 + i, 60), "en", f"src{i % 10}", 1) for i in range(200)], SCHEMA)
    taken = corpus_pipeline.mix(spark, docs, "")
    assert {r.source for r in taken.select("source").collect()} == {f"src{i}" for i in range(10)}


def test_each_stage_reads_what_its_predecessor_wrote(spark, tmp_path, monkeypatch):
    spark.createDataFrame(messy_rows(), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    read = []

    def stage(spark, docs, sf_dir):
        read.append(set(docs.inputFiles()))
        return docs.where("doc_id > 1")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("a", stage), ("b", stage), ("c", stage)])
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {2, 3, 4, 5, 6, 7, 8, 9, 10}
    assert all(read) and not read[0] & read[1] and not read[1] & read[2] and not read[0] & read[2]


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_the_rest_works_without_the_optional_parts(tmp_path):
    copy = tmp_path / "repo"
    copy.mkdir()
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), copy)
    shutil.copytree(os.path.join(ROOT, "parley"), copy / "parley", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'search_text' in q and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, check=True, env={**os.environ, "PYTHONPATH": str(copy)})
