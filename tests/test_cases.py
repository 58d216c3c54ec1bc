"""The literal cases of plans.cases: the query's rows are those its SQL spells out."""

import duckdb
import pytest

from marginalia.plans import cases, catalog, work

NAMES = sorted(n for n, f in catalog.QUERIES.items() if f.__module__ == cases.__name__ or (f.__module__ == work.__name__ and "(values" in catalog.SQL.get(n, "")))


@pytest.mark.parametrize("name", NAMES)
def test_case(spark, name):
    df = catalog.QUERIES[name](spark, "")
    cols = sorted(df.columns)
    quoted = ", ".join(f'"{c}"' for c in cols)
    want = duckdb.sql(f"select {quoted} from ({catalog.SQL[name]})").fetchall()
    assert sorted(map(str, (tuple(r[c] for c in cols) for r in df.collect()))) == sorted(map(str, want)) and want
