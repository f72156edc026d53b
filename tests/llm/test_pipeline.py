import os
import sys

import pytest

from vellum.llm import common, jaccard, linededup, mixing, packing, quality

from .data import prose

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    passage = prose(7, 70)
    rows = [(i, prose(1000 + i, 60), "en", f"s{i % 3}", 0) for i in range(300)]
    rows += [(400 + i, f"{prose(2000 + i, 30)}\n{passage}\n{prose(3000 + i, 30)}", "en", "s0", 0) for i in range(6)]
    rows += [(500 + i, prose(1000, 60), "en", "s1", 0) for i in range(5)]  # copies of document 0
    rows += [(600 + i, "".join(f"{w.upper()}!!§ " for w in prose(i, 40).split()), "en", "s2", 0) for i in range(10)]
    rows += [(700, None, None, None, None), (701, "", "en", "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, 0) for i in range(0, 250)] + [(600 + i, 0, 0) for i in range(5)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages_take_effect_in_order(spark, tables):
    import corpus_pipeline

    docs = common.read(spark, tables, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "near-duplicates", "mixing", "packing"] and corpus_pipeline.ORACLE_SQL is None
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, tables)
        if name != "packing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        docs = common.table(out, "test-stage")
        kept[name] = docs.collect()
    good = {r.doc_id for r in kept["quality classifier"]}
    assert not good & {*range(600, 610), 700, 701} and len(good & {*range(300)}) >= 280 and {*range(400, 406)} <= good
    lines = {r.doc_id: r.text for r in kept["line dedup"]}
    assert lines.keys() == good and prose(7, 70) in lines[400] and not any(prose(7, 70) in lines[i] for i in range(401, 406)) and {lines[500 + i] for i in range(5)} == {""}
    once = [r.doc_id for r in kept["near-duplicates"]]
    assert len(once) == len(set(once)) and set(once) <= good
    taken = [r.doc_id for r in kept["mixing"]]
    assert set(taken) <= set(once) and max(taken.count(i) for i in set(taken)) <= 2
    assert sum(r.piece == 0 for r in kept["packing"]) == len(taken) and len({(r.sequence_id, r.offset) for r in kept["packing"]}) == len(kept["packing"])


def test_run_gives_what_the_stages_give(spark, tables):
    import corpus_pipeline

    docs, labels = common.read(spark, tables, "documents"), common.read(spark, tables, "labels")
    want = packing.pack_documents(mixing.mix(jaccard.keep_one(linededup.dedup(quality.keep_good(docs, labels)))))
    rows = lambda df: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in df.collect())
    assert rows(corpus_pipeline.run(spark, tables)) == rows(want)


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    class Cluster:
        master = "spark://somewhere:7077"

    class Session:
        sparkContext = Cluster

        class conf:
            get = staticmethod(lambda *a: None)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)


def test_broadcasts_are_bounded_by_bytes_and_rows(spark, monkeypatch):
    small = common.table(spark.range(100), "test-small")
    assert common.is_small(small) and not common.is_small(small, rows=99) and not common.is_small(small, size=10)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    from pyspark.sql import functions as F

    big = spark.range(1000).withColumnRenamed("id", "b")
    assert "broadcast" in plan(common.join_small(big, small, F.col("id") == F.col("b")))
    monkeypatch.setattr(common, "BROADCAST_BYTES", 10)
    joined = common.join_small(big, small, F.col("id") == F.col("b"))
    assert "strategy=broadcast" not in plan(joined) and joined.count() == 100
