"""Every query of the library against its DuckDB query."""

import os

import duckdb
import pytest

from placeflow import plans


def shown(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    cell = lambda v: None if v is None else round(v, 6) + 0.0 if isinstance(v, float) else v
    return sorted(repr(tuple(cell(r[k]) for k in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_same_rows(spark, small, name):
    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{small}/{f}'")
    found = plans.QUERIES[name](spark, small)
    want = con.execute(plans.ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(found.columns) == sorted(names)
    assert shown(found.collect(), found.columns) == shown(want.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE)))
def test_runs(spark, small, name):
    assert plans.QUERIES[name](spark, small).count() > 0
