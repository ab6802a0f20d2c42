"""Every query with SQL against DuckDB, and the others for rows."""

from __future__ import annotations

import pytest
from oracle import check

from tramline.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_matches_sql(spark, sf_dir, name):
    check(catalogue.QUERIES[name](spark, sf_dir), catalogue.SQL[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["id", "name", "metres", "services"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
