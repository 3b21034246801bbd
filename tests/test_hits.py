"""Hit suppression where many of the best hits are one chain at one place."""

from cartolith.operators.search import distinct_hits


def test_more_repeats_than_are_looked_at(spark):
    rows = [(i, "Chaîne" if i % 2 else "CHAINE", float(i % 10), 0.0, 1000.0 - i) for i in range(300)] + [(300, "Chaine", 900.0, 0.0, 5.0)]
    rows += [(301 + i, f"shop {i}", 0.0, 0.0, 4.0 - i) for i in range(3)] + [(400, None, None, 0.0, 0.5), (401, None, None, 0.0, 0.25)]
    hits = spark.createDataFrame(rows, "record_id long, name string, x double, z double, score double")
    assert [r.record_id for r in distinct_hits(hits, 5).collect()] == [0, 300, 301, 302, 303]
    assert [r.record_id for r in distinct_hits(hits, 9).collect()] == [0, 300, 301, 302, 303, 400, 401]
    assert distinct_hits(hits.where("false"), 5).count() == 0
