import corpus_pipeline
import __spark_entry__
from tallyforge.llm import mixing, near_dup, packing, quality, secrets
from tests.llm.test_near_dup import brute
from tests.llm.test_packing import check

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).toArrow())
        assert docs.columns == columns
        rows[name] = docs.collect()
    source = spark.read.parquet(f"{SF}/documents.parquet")
    report = {r.doc_id: r.kept for r in quality.quality_report(source, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert {r.doc_id for r in rows["quality_rules"]} == {i for i, k in report.items() if k}
    parts = brute([(r.doc_id, r.text) for r in rows["quality_rules"]], 5)
    assert {r.doc_id for r in rows["near_dedup"]} == {i for i, (_, c) in parts.items() if c == i}
    assert len(rows["secret_scan"]) == len(rows["near_dedup"])
    assert all(not secrets.base_spans(r.text) for r in rows["secret_scan"])
    assert all(r.n_chars == len(r.text) for r in rows["secret_scan"])
    scanned = spark.createDataFrame(rows["secret_scan"], source.schema)
    want = sorted(r.doc_id for r in mixing.mix_sources(scanned).collect())
    assert sorted(r.doc_id for r in rows["source_mixing"]) == want
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert check(pieces, [tuple(r) for r in rows["source_mixing"]]) <= 1


def test_run_and_registration(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_dedup", "secret_scan", "source_mixing", "retrieval_packing"]
    got = __spark_entry__.queries()["pipeline"](spark, SF)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and got.count() > 0
    assert {f"op{n}" for n in range(1, 11)} <= {q.split("_")[0] for q in __spark_entry__.queries()}
    assert near_dup.PERCENT == 80 and near_dup.SHINGLE == 5 and packing.WINDOW == 1024


def test_edges_of_every_stage(spark, tmp_path):
    """Null ids, texts and sources, empty and blank texts, repeated rows, a column of a name that stages use themselves, and an empty table."""
    from pyspark.sql import functions as F

    source = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, "no id " * 30, None, "a", None), (900001, None, "en", None, None), (900002, "", "en", "a", 0), (900003, " \n ", "en", "a", 3), (900004, "short", None, "b", 5)], source.schema)
    docs = source.unionByName(odd).unionByName(source.limit(5)).withColumn("kept", F.lit("x")).withColumn("shingles", F.lit("y"))
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, docs.limit(0), SF)
        assert none.count() == 0, name
        got = stage(spark, docs, SF)
        if name == "retrieval_packing":
            assert {r.doc_id for r in got.collect()} >= {900001, 900002}
            continue
        assert got.columns == docs.columns and none.columns == docs.columns
        rows = got.collect()
        ids = [r.doc_id for r in rows]
        if name == "quality_rules":
            assert not {900001, 900002, 900003, 900004} & set(ids)
        if name == "near_dedup":
            assert None in ids and {900001, 900002, 900003, 900004} <= set(ids) and len([i for i in ids if i is not None]) == len({i for i in ids if i is not None})
        if name == "secret_scan":
            assert len(rows) == docs.count() and {r.doc_id: r.text for r in rows}[900001] is None
