"""Samples without a global limit, ranks without one task for a group."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lakesift.operators import mix


def order(ids, seed=42):
    return sorted(ids, key=lambda k: (hashlib.md5(f"{seed}:{k}".encode()).hexdigest(), k))


@pytest.mark.parametrize("few", [0, 10_000])
@pytest.mark.parametrize("n", [0, 1, 333, 1000, 5000])
def test_sample_of_exact_size(spark, monkeypatch, few, n):
    monkeypatch.setattr(mix, "FEW", few)
    got = {r.id for r in mix.sample(spark.range(1000), n).collect()}
    assert got == set(order(range(1000))[:n])


@pytest.mark.parametrize("few", [0, 10_000])
def test_strata_with_a_hot_one(spark, monkeypatch, few):
    monkeypatch.setattr(mix, "FEW", few)
    df = spark.range(1000).withColumn("accent", F.when(F.col("id") < 900, "hot").when(F.col("id") < 990, "warm").when(F.col("id") < 995, "cold"))
    for n in (2, 40, 500):
        rows = mix.stratified(df, n).collect()
        assert len(rows) == n == len({r.id for r in rows})
        if n == 500:
            assert {r.accent for r in rows} == {"hot", "warm", "cold", None}
    hot = sorted(r.id for r in mix.stratified(df, 500).filter("accent = 'hot'").collect())
    assert hot == sorted(order(range(900))[: len(hot)])


def test_ranks(spark):
    df = spark.range(2000).withColumn("g", F.when(F.col("id") % 10 > 0, "hot")).withColumn("_o", F.md5(F.concat(F.lit("42:"), F.col("id").cast("string"))))
    got = {r.id: r._r for r in mix.ranked(df, ["g"]).collect()}
    for group in ([k for k in range(2000) if k % 10], list(range(0, 2000, 10))):
        assert [got[k] for k in order(group)] == list(range(1, len(group) + 1))
