"""Every registered query against its DuckDB equivalent on the smallest tables."""

import math
import os

import duckdb
import numpy as np
import pytest

from dossier.plans import registry

registry.load()
SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    return v if v is None or isinstance(v, (bool, int)) else str(v)


def rows(found):
    return sorted((tuple(plain(x) for x in r) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    ours = rows(df.select(*[f"`{c}`" for c in columns]).collect())
    assert ours
    if name in registry.ORACLE_SQL:
        named = ", ".join(f'"{c}"' for c in columns)
        assert sorted(duck.sql(registry.ORACLE_SQL[name]).columns) == columns
        assert ours == rows(duck.sql(f"select {named} from ({registry.ORACLE_SQL[name]})").fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
