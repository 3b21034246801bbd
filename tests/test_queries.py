"""Every registered query of the engine against its SQL on DuckDB, at the smallest scale."""

import os

import duckdb
import pytest

from cartolith.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{p}/*.parquet'" if os.path.isdir(p) else f"create view {t} as select * from '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, list):
        return tuple(plain(x) for x in v)
    return v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, name):
    got = QUERIES[name](spark, SF)
    want = con.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    key = lambda r: repr(r)
    assert sorted([tuple(plain(r[c]) for c in columns) for r in got.collect()], key=key) == sorted([tuple(plain(r[i]) for i in at) for r in want.fetchall()], key=key)


def test_one_to_one_is_greedy(spark):
    from cartolith.operators.joins import one_to_one

    pairs = [(a, b, (a * 7 + b * 11) % 13) for a in range(8) for b in range(6) if (a + b) % 3]
    got = {(r.a, r.b) for r in one_to_one(spark.createDataFrame(pairs, "a long, b long, score long"), "a", "b", "score").collect()}
    used_a, used_b, want = set(), set(), set()
    for a, b, s in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if a not in used_a and b not in used_b:
            used_a.add(a)
            used_b.add(b)
            want.add((a, b))
    assert got == want


def test_projection_round_trip(spark):
    assert QUERIES["project"](spark, SF).agg({"residual": "max"}).first()[0] < 1e-9


def test_typo_finds_customers(spark):
    assert QUERIES["search_typo"](spark, SF).count() == 20
