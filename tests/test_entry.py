import duckdb
import pytest

import __spark_entry__ as entry
from loomspark.plans import queries as core

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = core.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(r) for r in df.select(*cols).collect())
    rel = con.execute(core.ORACLES[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(r[names.index(c)] for c in cols) for r in rel.fetchall())


def test_contract(spark):
    assert entry.entry(spark).count() == 1000
    assert set(entry.oracle_sql()) <= set(entry.queries())
