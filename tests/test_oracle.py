import pytest
from helpers import compare

from lacuna.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_agrees_with_duckdb(spark, sf_dir, name):
    compare(spark, sf_dir, name, registry.QUERIES[name], registry.ORACLE_SQL[name])


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) <= set(entry.queries())
    assert entry.entry(spark).columns == ["entity_id", "feature_value", "rule_id", "confidence", "gap_id", "short_id"]
