"""Targets, rates and copies of the mix."""

import random

import pytest
from pyspark.sql import functions as F

from cartolith.llm.mixing import mix, mixed_documents, newton, targets

SF = "/root/testdata/sf0.001"


def shares(sizes, weights=(5, 2, 1), budget=1.5, cap=2.0):
    """Water-filling by turns: sources above their cap keep it, the rest share what is left."""
    w = {s: weights[i % len(weights)] for i, s in enumerate(sizes)}
    total, out, free = budget * sum(sizes.values()), {}, set(sizes)
    while free:
        level = (total - sum(out.values())) / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > cap * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in free}
        out |= {s: cap * sizes[s] for s in over}
        free -= over
    return out


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {i + 1: rng.choice([0, 3, 10, 500, 10_000, 100_000]) for i in range(9)}
    got = {r["rank"]: r for r in newton(targets(spark.createDataFrame(list(sizes.items()), "rank int, source_size long"))).collect()}
    for k, want in shares(sizes).items():
        assert got[k].target == pytest.approx(want, rel=1e-9)
        assert got[k].rate * sizes[k] == pytest.approx(want, rel=1e-6)


def test_mix(spark):
    extra = spark.createDataFrame([(9001, None, "src1"), (9002, "", None), (9003, "a b c", None), (9003, "a b c", None), (None, "d e", "é"), (9004, "w " * 30000, "zz")], "doc_id long, text string, source string")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").unionByName(extra).withColumn("size", F.lit("clash"))
    rows = mix(docs).collect()
    assert len(rows) == docs.count()
    assert all(0 <= r.taken <= 2 * r["size"] for r in rows)
    by = {}
    for r in rows:
        t = by.setdefault(r.target, [0, 0, r.source_size])
        t[0] += r.taken
        t[1] = max(t[1], r["size"])
    for target, (taken, largest, _) in by.items():
        assert abs(taken - target) <= largest
    assert sorted(map(str, mix(docs.repartition(7)).collect())) == sorted(map(str, rows))
    again = mixed_documents(docs)
    assert again.columns == [*docs.columns, "copy"]
    assert again.count() == sum(r.copies for r in rows)


def test_empty(spark):
    assert mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
