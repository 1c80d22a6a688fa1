"""Every query of the catalog that has SQL, against DuckDB on the small tables."""

import duckdb
import numpy as np
import pytest
from vistrack import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: How DuckDB calls what Spark returns.
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def ordered(rows, names):
    """Rows by name, numbers rounded, in one order."""
    def cell(v):
        if v is None or v != v:
            return (0, "")
        return (1, f"{round(float(v), 4) + 0.0:.4f}") if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else (2, str(v))

    return sorted([tuple(cell(r[n]) for n in names) for r in rows])


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, db, name):
    df = catalog.queries()[name](spark, SF)
    rel = db.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    kinds = dict(zip(rel.columns, map(str, rel.types)))
    for c, t in df.dtypes:
        assert TYPES.get(t, t) == kinds[c] or {t, kinds[c]} <= {"bigint", "int", "BIGINT", "INTEGER", "HUGEINT"}, (c, t, kinds[c])
    names = sorted(df.columns)
    got, want = ordered((r.asDict() for r in df.collect()), names), ordered((dict(zip(rel.columns, r)) for r in rel.fetchall()), names)
    assert want, "an empty table shows nothing"
    assert len(got) == len(want)
    off = sum(a != b for a, b in zip(got, want))
    if off:  # a last digit may round differently
        num = lambda rows: np.array([[float(v) if k == 1 else 0.0 for k, v in r] for r in rows])
        assert np.allclose(num(got), num(want), atol=2e-4), name


def test_those_without_sql_give_rows(spark):
    rest = sorted(set(catalog.queries()) - set(catalog.oracle_sql()))
    assert rest and all(not catalog.queries()[n](spark, SF).isEmpty() for n in rest)
