import __spark_entry__ as entry
from lintlake import queries as core


def test_every_core_query_has_sql():
    assert set(core.QUERIES) == set(core.ORACLE)
    assert set(core.QUERIES) <= set(entry.queries()) and set(core.ORACLE) <= set(entry.oracle_sql())


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["rule", "severity", "file", "line", "snippet"]
