"""Every registered query against its SQL equivalent in DuckDB on the same tables."""

import duckdb
import pandas as pd
import pytest

from tracewell.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame: pd.DataFrame) -> list[tuple]:
    """Rows as sorted tuples, columns by name; floats to nine digits."""
    clean = lambda v: None if v is None or v is pd.NA or (isinstance(v, float) and v != v) else (float(f"{v:.9g}") if isinstance(v, float) else v)
    names = sorted(frame.columns)
    return sorted((tuple(clean(v) for v in r) for r in frame[names].astype(object).itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, DATA).toArrow(), duck.sql(catalog.ORACLE_SQL[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows(pd.DataFrame(got.to_pylist(), columns=got.column_names)) == rows(pd.DataFrame(want.to_pylist(), columns=want.column_names))
    assert got.num_rows or name == "topic_fighting"
