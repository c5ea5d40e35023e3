"""Every registered query against its DuckDB SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from conftest import SF
from fluxtone import plans

FEW_ROWS_ONLY = sorted(set(plans.QUERIES) - set(plans.ORACLE))


@pytest.fixture(scope="module")
def duck():
    found = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        found.sql(f"create view {p.stem} as select * from '{p}'")
    return found


def _plain(v):
    return None if isinstance(v, float) and math.isnan(v) else float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_query_equals_oracle(spark, duck, name):
    df, want = plans.QUERIES[name](spark, SF), duck.sql(plans.ORACLE[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    rows = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=str)
    place = [want.columns.index(c) for c in columns]
    assert rows and rows == sorted((tuple(_plain(r[i]) for i in place) for r in want.fetchall()), key=str)


@pytest.mark.parametrize("name", FEW_ROWS_ONLY)
def test_query_has_rows(spark, name):
    assert plans.QUERIES[name](spark, SF).limit(5).collect()
