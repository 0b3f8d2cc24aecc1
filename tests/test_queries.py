"""Every registered query of the engine against its SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from psephos.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no tables here")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if v is None or str(v) in ("<NA>", "nan"):
        return None
    return round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) or hasattr(v, "dtype") and v.dtype.kind in "if" else str(v)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_its_sql(spark, oracle, name):
    got = registry.queries()[name](spark, DATA)
    if name not in registry.oracle_sql():
        assert got.columns
        return
    want = oracle.execute(registry.oracle_sql()[name]).fetchdf()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda rows: sorted((tuple(map(plain, r)) for r in rows), key=repr)
    assert key(got.select(*columns).toPandas().itertuples(index=False)) == key(want[columns].itertuples(index=False))


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
