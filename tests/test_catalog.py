"""Every query with SQL is compared with DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from quillon.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


#: Queries whose warm-up is longer than the smallest tables.
LONGER = {"profile_store", "single_asset_rows"}


def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def digits(values):
    """Decimals that a column of rounded floats keeps."""
    some = [v for v in values if isinstance(v, float) and math.isfinite(v)]
    return next((d for d in range(9) if all(round(v, d) == v for v in some)), 9)


def same(x, y, kept):
    """Sums in another order may differ in the last digit kept of a fraction; whole numbers and NaN may not."""
    if isinstance(x, float) and isinstance(y, float):
        return math.isclose(x, y, rel_tol=1e-9, abs_tol=1.01 * 10**-kept if kept >= 4 else 0)
    return str(x) == str(y)


SAMPLE = sorted(catalog.oracle_sql())


@pytest.mark.parametrize("name", SAMPLE)
def test_same_rows(spark, name):
    sf = SF.replace("0.001", "0.01") if name in LONGER else SF
    df = catalog.queries()[name](spark, sf)
    tables = duck(sf)
    ref = tables.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(ref.columns)
    cols = sorted(df.columns)
    at = [ref.columns.index(c) for c in cols]
    key = lambda row: [(v is None, f"{round(v, 2) + 0.0:.2f}" if isinstance(v, float) else str(v)) for v in row]
    a = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key)
    b = sorted((tuple(r[i] for i in at) for r in ref.fetchall()), key=key)
    assert a and len(a) == len(b)
    kept = [digits([row[i] for row in b]) for i in range(len(cols))]
    wrong = [(x, y) for x, y in zip(a, b, strict=True) if not all(map(same, x, y, kept))]
    assert not wrong, wrong[:3]


def test_queries_without_sql_have_rows(spark):
    for name in set(catalog.queries()) - set(catalog.oracle_sql()):
        assert catalog.queries()[name](spark, SF).count() > 0, name
