import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["gene_dim_distinct", "filtered_network", "first_source_wins", "bh_global", "configuration_model", "random_walks"])
def test_runs_on_the_small_tables(spark, name):
    assert entry.queries()[name](spark, SMALL).count() >= 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
