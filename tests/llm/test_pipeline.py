"""The whole pipeline, stage by stage."""

import re

import corpus_pipeline as C
from tests.llm.conftest import prose

FOLDER = "/root/testdata/sf0.001"


def test_stages_filter_and_keep_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, count = docs.columns, docs.count()
    for k, (name, stage) in enumerate(C.STAGES):
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert k == len(C.STAGES) - 1 or docs.columns == columns
        assert docs.count() <= count
        count = docs.count()
    assert count > 100 and {"doc_id", "n_tokens", "ids"} <= set(docs.columns)
    assert [name for name, _ in C.STAGES] == ["toxicity", "near_dedup", "decontamination", "secrets", "tokens"]


def test_decisions_take_effect(spark):
    base = prose(4, 100)
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").first()["text"]
    rows = [
        (1, base), (2, base), (3, base + " tail"), (4, prose(5, 60) + " " + item + " " + prose(6, 60)),
        (5, prose(7, 80) + " token = 'abcdef123456'"), (6, prose(8, 80)), (7, None), (None, prose(9, 70)), (8, ""),
    ]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, goes string, component_id string")
    stages = dict(C.STAGES)
    docs = stages["near_dedup"](spark, docs, FOLDER)
    assert {r["doc_id"] for r in docs.collect()} == {1, 4, 5, 6, 7, None, 8}
    docs = stages["decontamination"](spark, docs, FOLDER)
    assert {r["doc_id"] for r in docs.collect()} == {1, 5, 6, 7, None, 8}
    docs = stages["secrets"](spark, docs, FOLDER)
    assert re.search(r" \[assign\]'$", docs.where("doc_id = 5").first()["text"])
    assert docs.columns == ["doc_id", "text", "goes", "component_id"]
    tokens = stages["tokens"](spark, docs, FOLDER)
    assert tokens.count() == 6 and tokens.where("n_tokens = 0").count() == 2


def test_awkward_and_empty_tables(spark, awkward, no_docs, tmp_path):
    for k, docs in enumerate((awkward, no_docs)):
        for name, stage in C.STAGES:
            path = str(tmp_path / f"{k}-{name}")
            stage(spark, docs, FOLDER).write.parquet(path)
            docs = spark.read.parquet(path)
        assert docs.count() == (0 if k else len({r["doc_id"] for r in awkward.collect()}) + 1 - 2) or k == 0
