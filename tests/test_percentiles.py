"""Exact selection by histograms against numpy, with few bins and small leaves so that all rounds run."""

import numpy as np
import pytest

from cartolith.operators import audit


def data():
    rng = np.random.default_rng(4)
    groups = {"even": rng.uniform(-5, 5, 3000), "skew": np.exp(rng.normal(0, 12, 2000)), "ties": rng.integers(0, 3, 2500).astype(float), "one": np.array([7.5]), "two": np.array([1.0, 2.0]), "inf": np.array([-np.inf, *rng.normal(0, 1, 400), np.inf]), "wide": np.array([-1.7e308, *rng.normal(0, 1e-300, 300), 1.7e308])}
    return groups


@pytest.mark.parametrize("bins, leaf", [(4096, 1 << 14), (8, 20), (2, 1)])
def test_selection(spark, monkeypatch, bins, leaf):
    monkeypatch.setattr(audit, "BINS", bins)
    monkeypatch.setattr(audit, "LEAF", leaf)
    groups = data() if bins > 2 else {k: v[:60] for k, v in data().items() if k in ("even", "ties", "two")}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("even", None), ("none", None)]
    d = spark.createDataFrame(rows, "g string, v double").repartition(5)
    quantiles = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r.g: r for r in audit.floor_percentiles(d, "g", "v", quantiles).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        order = np.sort(values)
        assert [got[g][name] for name in quantiles] == [order[int(np.floor((len(order) - 1) * q))] for q in quantiles.values()], g
    smooth = {r.g: r for r in audit.linear_percentiles(d, ["g"], "v", quantiles).collect()}
    for g in groups:
        if g not in ("inf", "wide"):
            assert [smooth[g][name] for name in quantiles] == pytest.approx(list(np.quantile(groups[g], list(quantiles.values()))), rel=1e-9), g


def test_whole_table_and_bins(spark):
    d = spark.range(1, 1001).selectExpr("cast(id as double) v")
    assert audit.linear_percentiles(d, [], "v", {"m": 0.5}).first().m == 500.5
    assert [r["count"] for r in audit.bins(d, "v").groupBy("bin").count().orderBy("bin").collect()] == [200] * 5
    assert audit.bins(d.where("false"), "v").count() == 0
    unnamed = spark.createDataFrame([(None, 1.0), (None, 3.0), (None, 9.0), ("a", 2.0)], "g string, v double")
    assert {tuple(r) for r in audit.floor_percentiles(unnamed, "g", "v", {"m": 0.5}).collect()} == {(None, 3.0), ("a", 2.0)}
    many = spark.range(30).selectExpr("id % 3 g", "id v")
    assert {tuple(r) for r in audit.floor_percentiles(many, "g", "v", {"m": 0.5}).collect()} == {(0, 12), (1, 13), (2, 14)}
