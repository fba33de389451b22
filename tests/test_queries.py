"""Every query with SQL gives DuckDB's rows, names and kinds on the smallest tables; the others run with the columns they name."""

import math
from pathlib import Path

import duckdb
import pytest

from flockline.plans import registry

DATA = Path("/root/testdata/sf0.001")
KINDS = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def ordered(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_agrees_with_sql(spark, duck, name):
    df = registry.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    found = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    kinds = {d[0]: str(d[1]) for d in found.description}
    assert sorted(names) == columns
    assert {c: KINDS[k] for c, k in df.dtypes} == kinds
    expected = [[r[names.index(c)] for c in columns] for r in found.fetchall()]
    assert ordered(df.select(*columns).collect()) == ordered(expected)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    df = registry.queries()[name](spark, str(DATA))
    assert len(set(df.columns)) == len(df.columns)
    assert df.count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
