"""Rows keep their keys if a scan is split otherwise in a later job, as it is when executors come or go."""

import pytest

from lakesift.llm import mixing, ngram_join

SPLITS = "spark.sql.files.minPartitionNum"


@pytest.fixture
def table(spark, sf_dir, tmp_path, request):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.unionByName(docs.limit(50)) if request.param == "equal ids" else docs
    docs.repartition(6, "doc_id").write.parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    spark.conf.set(SPLITS, "1")
    yield spark.read.parquet(str(tmp_path / "t"))
    for c in (SPLITS, "spark.sql.files.openCostInBytes"):
        spark.conf.unset(c)


def splits_after(monkeypatch, spark, module, name):
    real = module.cut

    def cut(df, folder):
        out = real(df, folder)
        if folder == name:
            spark.conf.set(SPLITS, "12")
        return out

    monkeypatch.setattr(module, "cut", cut)


@pytest.mark.parametrize("table", ["unique ids", "equal ids"], indirect=True)
def test_mixing(spark, table, monkeypatch):
    rows = lambda: sorted((r.doc_id, r.epoch, r.text or "", r.n_tokens, r.position) for r in mixing.mix(table).collect())
    want = rows()
    before = table.rdd.getNumPartitions()
    splits_after(monkeypatch, spark, mixing, "mix-tokens")
    assert rows() == want and spark.read.parquet(*table.inputFiles()).rdd.getNumPartitions() > before


@pytest.mark.parametrize("table", ["unique ids", "equal ids"], indirect=True)
def test_drop_copies(spark, table, monkeypatch):
    rows = lambda: sorted((r.doc_id, r.text or "") for r in ngram_join.drop_copies(table).collect())
    want = rows()
    splits_after(monkeypatch, spark, ngram_join, "ngram-gone")
    assert rows() == want and len(want) < table.count()


def test_sweep(spark):
    import os

    from lakesift.llm.common import _own_dir, cut, sweep

    before = cut(spark.range(3), "one")
    assert before.count() == 3 and os.path.isdir(_own_dir(spark))
    sweep(spark)
    assert not os.path.exists(_own_dir(spark))
    assert cut(spark.range(3), "two").count() == 3
