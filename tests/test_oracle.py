"""Every registered query on the small tables: equal to its SQL, or at least runs."""

import compare
import pytest

from ablaspark import workload

QUERIES, ORACLE = workload.queries(), workload.oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    return compare.connect(folder)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, con, folder, name):
    assert compare.differences(spark, con, QUERIES[name], ORACLE[name], folder) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, folder, name):
    assert QUERIES[name](spark, folder).count() > 0
    spark.catalog.clearCache()


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0 and "bonferroni_significant" in df.columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
