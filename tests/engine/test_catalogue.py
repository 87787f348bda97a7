"""Every query of the catalogue against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from mensura.plans import catalogue


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalogue.QUERIES[name](spark, sf)
    got = df.collect()
    if name not in catalogue.ORACLES:
        assert got
        return
    rel = duck.sql(catalogue.ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    a, b = rows_of(df.columns, got), rows_of(rel.columns, rel.fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(p == q or (isinstance(p, float) and p == pytest.approx(q, abs=2e-6)) for p, q in zip(x, y)), (x, y)


#: Joins without keys whose small side doesn't grow with the tables: prompts, whose number is checked; bins and ranks of a single group.
FIXED = {"softmax_class_probs", "best_class_per_image", "depth_scale_loo"}


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_no_cartesian_product(spark, sf, name):
    plan = catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert name in FIXED or ("CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan), plan


def test_scan_reads_only_what_is_used(spark, sf):
    plan = catalogue.QUERIES["conformal_factor"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "l_shipdate" not in plan and "o_orderstatus" not in plan
