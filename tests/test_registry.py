"""Every registered query has a callable, and SQL only for what is registered."""

import __spark_entry__ as entry


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(callable(f) for f in entry.queries().values())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
