"""SQL functions against the Column functions, the table functions against each other, and the errors of the polymorphic one."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from cartolith.functions import geometry, polygons, sql, text

TEXTS = ["St. Martin's Œuvre", "RN 124 et D 930", "rd12 av. de l’Église", "de la", "", None, "12BIS", "Chemin d'Auch (32000", "HLM zac SARL Dupont & fils", "École—Été ", "a b"]


def test_text_functions(spark):
    sql.register(spark)
    pairs = {
        "normalize_text(t)": text.normalize_text(F.col("t")), "fold_text(t)": text.fold_text(F.col("t")), "text_tokens(t)": text.tokens(F.col("t")), "search_tokens(t)": text.search_tokens(F.col("t")),
        "house_number(t)": text.house_number(F.col("t")), "name_quality(t)": text.name_quality(F.col("t")), "name_tokens(t)": text.name_tokens(F.col("t")), "postcode_of(t)": text.postcode(F.col("t")),
        "token_variants(fold_text(t))": text.token_variants(text.fold_text(F.col("t"))), "fnv1a_32(fold_text(t))": text.fnv1a(text.fold_text(F.col("t"))), "allowed_edits(length(t))": text.allowed_edits(F.length("t")),
        "edits_within(t, 'ecole', 2)": text.bounded_edits(F.col("t"), F.lit("ecole"), 2), "name_similarity(t, 'Dupont et fils')": text.similarity(text.name_tokens(F.col("t")), text.name_tokens(F.lit("Dupont et fils"))),
    }
    d = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "k int, t string")
    got = d.select("k", *[F.expr(e).alias(f"s{i}") for i, e in enumerate(pairs)], *[c.alias(f"c{i}") for i, c in enumerate(pairs.values())]).collect()
    for row in got:
        for i, e in enumerate(pairs):
            assert row[f"s{i}"] == row[f"c{i}"], (e, TEXTS[row.k])


def test_geometry_functions(spark):
    sql.register(spark)
    rings = [[(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (1.0, 5.0), (0.0, 0.0)], [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.0, 0.0)], [(1.0, 1.0)], []]
    d = spark.createDataFrame([(k, r) for k, r in enumerate(rings)], "k int, ring array<struct<x:double,y:double>>")
    got = d.select("k", F.expr("signed_area(ring)").alias("a"), geometry.signed_area(F.col("ring")).alias("b"), F.expr("line_length(ring)").alias("c"), geometry.length(F.col("ring")).alias("e"), F.expr("in_ring(1.5, 2.5, ring)").alias("f"), geometry.in_ring(F.lit(1.5), F.lit(2.5), F.col("ring")).alias("g"), F.expr("box_of(ring)").alias("h")).collect()
    for r in got:
        assert r.a == pytest.approx(r.b) and r.c == pytest.approx(r.e) and r.f == r.g
    assert tuple(got[0].h) == (0.0, 0.0, 4.0, 5.0)
    boxes = spark.sql("SELECT named_struct('x0', 0D, 'y0', 0D, 'x1', 2D, 'y1', 2D) a, named_struct('x0', 1D, 'y0', 1D, 'x1', 3D, 'y1', 3D) b")
    assert boxes.selectExpr("box_iou(a, b)").first()[0] == pytest.approx(1 / 7)


def test_inlined_and_pushed_down(spark):
    """A SQL function leaves no call behind: only the column it reads is scanned, and no Python runs."""
    sql.register(spark)
    plan = spark.sql("SELECT fold_text(c_name) n FROM parquet.`/root/testdata/sf0.001/customer.parquet` WHERE c_custkey > 5")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<c_custkey" in plan and "GreaterThan(c_custkey,5)" in plan and "Python" not in plan


def test_table_functions(spark):
    sql.register(spark)
    rows = [(1, -3000.0, 10.0, 100.0, 2048.0), (2, 0.0, 0.0, 0.0, 0.0), (3, None, 0.0, 1.0, 1.0)]
    spark.createDataFrame(rows, "id int, x0 double, z0 double, x1 double, z1 double").createOrReplaceTempView("some_boxes")
    python = spark.sql("SELECT id, x0, col, row, tile_id FROM tile_cover(TABLE(some_boxes), lod => 0)")
    native = spark.sql("SELECT id, x0, t.* FROM some_boxes b, LATERAL box_tiles(b.x0, b.z0, b.x1, b.z1, 0) t")
    assert sorted(map(tuple, python.collect())) == sorted(map(tuple, native.collect())) and python.count() == 7
    for bad in ("tile_cover(TABLE(SELECT 1 a), 0)", "tile_cover(TABLE(some_boxes), 7)", "tile_cover(TABLE(SELECT *, 1 col FROM some_boxes), 0)"):
        with pytest.raises(AnalysisException):
            spark.sql(f"SELECT * FROM {bad}").collect()
    assert set(sql.register(spark)) >= {"fold_text", "box_tiles", "tile_cover"} and polygons.EPSILON == 1e-10
