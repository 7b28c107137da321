"""Every query that has SQL gives what DuckDB gives."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from fieldloom import catalogue

SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def canonical(df: pd.DataFrame) -> list:
    def value(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
            return "none"
        return f"{float(v):.6f}" if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "fiu" else str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(map(value, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, data, duck, name):
    got, want = catalogue.queries()[name](spark, data).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_every_query_is_described():
    assert len(catalogue.queries()) > 80
    assert set(SQL) <= set(catalogue.queries())


def test_dark_passages_among_retellings(spark, data, duck, tmp_path):
    """Dark members are found from their own lists, and from those that name them where these are full of retellings."""
    duck.execute(f"copy (select * replace (chunk_id + 100000 * k as chunk_id, doc_id + 100000 * k as doc_id, case when chunk_id % 3 < 2 then 'the ledger' else heading end as heading) from chunks, range(6) t(k) where k = 0 or chunk_id % 7 < 2) to '{tmp_path}/chunks.parquet' (format parquet)")
    con = duckdb.connect()
    con.execute(f"create view chunks as from '{tmp_path}/chunks.parquet'; create view memberships as from '{data}/memberships.parquet'")
    got, want = catalogue.queries()["dossier_dark"](spark, str(tmp_path)).toPandas(), con.execute(SQL["dossier_dark"]).df()
    assert len(want) and canonical(got) == canonical(want)
