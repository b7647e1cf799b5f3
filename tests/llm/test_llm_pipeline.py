import os

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from tidemark.llm import ngram_join

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def test_every_query_is_registered():
    q = contract.queries()
    assert {f"op{n}_" for n in range(1, 11)} <= {k.split("_")[0] + "_" for k in q} and "pipeline" in q
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "decontamination", "mixing", "sharding"]


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "sharding":
            assert sorted(out.columns) == sorted(docs.columns)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        ids = [r["doc_id"] for r in out.select("doc_id").collect()]
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert set(ids) <= before
        if name == "toxicity":
            gone = before - set(ids)
            assert sum(labels.get(d) == 1 for d in gone) > 0 and sum(labels.get(d) == 0 for d in gone) <= 1  # 75 labels are all there is
        if name == "ngram_jaccard":
            groups = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(docs, n=5, num=80, den=100).collect()}
            assert sorted(ids) == sorted(d for d in before if groups[d] == d)
        if name == "sharding":
            assert sorted(ids) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
        docs = out
        sizes.append(len(ids))
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3]


def test_stages_take_odd_rows(spark, edge_docs, tmp_path):
    plain = edge_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for df in (edge_docs, plain, plain.where("false")):
        docs = df
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert name == "sharding" or out.columns == df.columns
            path = str(tmp_path / f"{name}-{len(df.columns)}-{df.count()}")
            out.write.parquet(path)
            docs = spark.read.parquet(path)
        assert docs.count() == (0 if df.isEmpty() else docs.count())


def test_near_copies_go_row_by_row(spark):
    """Ids that repeat with different texts lose only the copies; copies under one id or a null id leave one."""
    text = lambda k: " ".join(f"t{k}w{i}" for i in range(40))
    rows = [(1, text(1)), (2, text(1) + " end"), (2, text(2)), (2, text(3)), (3, text(4)), (3, text(4)), (3, text(4) + " end"), (None, text(5)), (None, text(5)), (None, text(1)), (None, text(6)), (4, ""), (4, None), (None, " ")]
    out = corpus_pipeline.one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), SF)
    got = [(r["doc_id"], (r["text"] or "").replace(" end", "")) for r in out.collect()]
    want = [(1, text(1)), (2, text(2)), (2, text(3)), (3, text(4)), (None, text(5)), (None, text(6)), (4, ""), (4, ""), (None, " ")]
    assert sorted(got, key=str) == sorted(want, key=str)
