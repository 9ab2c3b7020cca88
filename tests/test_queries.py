"""Every query of the catalog against its SQL on small tables, and the entry point."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from tickloom.plans import catalog

SF = "/root/testdata/sf0.001"
ENTRIES = catalog.entries()
#: Queries that fit many models; the driver runs them, here they would take most of the time.
SLOW = {"feat_imp_mdi", "feat_imp_mda", "feat_imp_sfi", "feat_imp_clustered", "hyper_fit", "bagging"}


@pytest.fixture(scope="module")
def duck():
    def over(sf_dir: str):
        con = duckdb.connect()
        for path in glob.glob(f"{sf_dir}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
        return con

    return {d: over(d) for d in {SF, *LARGER.values()}}


#: Queries that need more rows than the smallest tables have.
LARGER = {"backtest_overfitting": "/root/testdata/sf0.01"}


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]").astype(str)
        elif df[c].dtype != object:
            df[c] = df[c].astype("Float64").astype(float).round(5)
    return sorted(map(str, df.where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", [n for n, (_, sql) in ENTRIES.items() if sql])
def test_same_rows_as_sql(spark, duck, name):
    f, sql = ENTRIES[name]
    sf_dir = LARGER.get(name, SF)
    got, want = f(spark, sf_dir).toPandas(), duck[sf_dir].execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", [n for n, (_, sql) in ENTRIES.items() if not sql and n not in SLOW])
def test_runs(spark, name):
    assert ENTRIES[name][0](spark, SF).count() >= 0


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and {"k", "ts", "t1", "ret", "label", "uniqueness"} == set(df.columns)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
