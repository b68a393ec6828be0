"""Every registered query agrees with its DuckDB oracle (row count, column
names, values to 6 decimals, order-insensitive) on sf0.001."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from arbor.functions import rules as RU
from arbor.plans import listings as L
from arbor.plans import registry
from arbor.sources.tables import TABLES
from conftest import SF_SMALL

QUERIES = dict(registry.QUERIES)
ORACLE = dict(registry.ORACLE)


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    res = duck.execute(ORACLE[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(srows) == len(orows)
    assert _rows(srows, df.columns) == _rows(orows, ocols)


def _differs(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    res = duck.execute(ORACLE[name])
    ocols = [d[0] for d in res.description]
    return _rows([tuple(r) for r in df.collect()], df.columns) != _rows(res.fetchall(), ocols)


@pytest.mark.parametrize("table, at, wrong, name", [
    (RU.KEYWORD_FLAGS, 4, ("lift", "without lift", False), "re_features"),
    (RU.EXTRACTS, 4, RU.Extract("year_built", r"(built in \d{3})", ("built in ",), dtype="double"), "re_features"),
    (RU.LONG_FLOOR_REPLACES, 6, ("th", "1"), "re_features"),
    (RU.SHORT_ORDINALS, 2, "h", "re_info_features"),
    (L.PRICE_BINS, "price", 99, "re_price_distribution"),
])
def test_a_wrong_rule_is_seen(spark, duck, table, at, wrong, name):
    """The oracle shares no rule with the library (values that occur in the table)."""
    right, table[at] = table[at], wrong
    try:
        assert _differs(spark, duck, name)
    finally:
        table[at] = right


def test_entry_registers_all():
    assert set(QUERIES) <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["TrainingOpportunitiesTaken", "AttritionCount", "NoAttritionCount",
                          "TotalEmployees", "AttritionRate"]
    assert df.count() > 0
