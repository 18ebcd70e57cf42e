"""Every registered query against its SQL on the smallest scale."""

import pytest
from oracle import compare, duck

from lectern.queries import AREAS, all_oracles, all_queries


@pytest.mark.parametrize("area", AREAS)
def test_queries_match_sql(spark, sf_dir, area):
    oracles, con, bad = all_oracles(), duck(sf_dir), {}
    for name, fn in all_queries().items():
        if fn.__module__ != f"lectern.queries.{area}":
            continue
        text, ok = compare(spark, con, name, fn, oracles.get(name), sf_dir)
        if not ok:
            bad[name] = text
    assert not bad


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.FLAGSHIP in e.queries()
