import pytest

from lakesift.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, same):
    same(QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", ["f11_mfcc", "a19_curation_report"])
def test_runs(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() >= 0


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
