"""Every registered query of the main package against its SQL, on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest

from numera.plans import queries as own

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _sorted(p):
    p = p[sorted(p.columns)]
    for k in p.columns:
        if p[k].dtype.kind == "f":
            p[k] = p[k].round(5)
    return p.sort_values(list(p.columns), ignore_index=True)


@pytest.mark.parametrize("name", sorted(own.oracle_sql()))
def test_matches_sql(spark, db, name):
    a, b = _sorted(own.queries()[name](spark, SF).toPandas()), _sorted(db.sql(own.oracle_sql()[name]).df())
    assert list(a.columns) == list(b.columns) and len(a) == len(b)
    for k in a.columns:
        if a[k].dtype.kind in "fiu":
            assert np.allclose(a[k].astype(float), b[k].astype(float), rtol=1e-6, atol=1e-5, equal_nan=True), k
        else:
            assert a[k].tolist() == b[k].tolist(), k
