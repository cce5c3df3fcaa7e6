"""Every query against its SQL twin, and the driver's contract."""

import pytest

import __spark_entry__ as entry_point
from plotweave.plans import catalog
from tests.conftest import DATA, as_rows

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_sql_twin(spark, duck, name):
    found = catalog.QUERIES[name](spark, f"{DATA}/sf0.001")
    want = duck(f"{DATA}/sf0.001", catalog.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    kinds = {d[0]: str(d[1]) for d in want.description}
    assert as_rows(found.columns, found.collect()) == as_rows(names, want.fetchall())
    assert {c: KINDS.get(k, k) for c, k in found.dtypes} == kinds


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL) - {"forward_selection", "full_workflow_tiles"}))
def test_runs_twice_alike(spark, name):
    run = lambda: as_rows((df := catalog.QUERIES[name](spark, f"{DATA}/sf0.001")).columns, df.collect())
    rows, columns = run()
    assert rows
    assert (rows, columns) == run()


def test_entry(spark):
    assert entry_point.entry(spark).count() == 10
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
