import pytest

import __spark_entry__ as entry
from kvtable.plans import registry
from tests.sqlcheck import assert_same


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, small, name):
    assert_same(registry.QUERIES[name](spark, small), registry.ORACLES[name], small)


def test_every_query_has_sql_and_is_exposed():
    assert set(registry.QUERIES) == set(registry.ORACLES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows_and_a_stable_schema(spark):
    df = entry.entry(spark)
    assert df.columns == ["key_hex", "value_hex"] and df.count() > 0


def test_range_reaches_the_scan(spark, tmp_path):
    """The key range is pushed below the merge, the tombstone filter is not."""
    from kvtable.operators.merge import scan
    from kvtable.schema import OPS

    path = str(tmp_path / "run")
    spark.createDataFrame([(b"a", b"1", False, 1)], OPS).write.parquet(path)
    plan = scan(spark.read.parquet(path), b"a", b"b")._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "GreaterThanOrEqual(key" in pushed and "LessThanOrEqual(key" in pushed and "tombstone" not in pushed.split("ReadSchema")[0]
