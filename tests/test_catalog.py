"""Every catalogued query runs; those with SQL equal it."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from chronopanel.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Long fits; the other files test what they call.
SLOW = {"cv_grid", "permutation_importance", "leakage_shuffle", "meta_model", "gbt_train_eval", "model_choice", "label_primary", "shap_ranking"}


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    value = lambda v: "null" if v is None or isinstance(v, float) and math.isnan(v) else repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)
    return sorted(tuple(value(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in catalog.queries() if n not in SLOW])
def test_query(spark, sf, oracle, name):
    df = catalog.queries()[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    sql = catalog.oracle_sql().get(name)
    if sql:
        cursor = oracle.execute(sql)
        columns = [c[0] for c in cursor.description]
        assert sorted(columns) == sorted(df.columns)
        assert canonical(df.columns, rows) == canonical(columns, cursor.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 2
    assert set(catalog.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
