"""Readers and writers of files."""

import gzip
import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from cartolith.sources import package, readers, sinks


def test_json(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"license": "open", "acquiredAt": "today", "items": [{"k": 1}, {"k": 2}]}))
    assert [r.k for r in readers.json_array(spark, f"{tmp_path}/a.json", "items", "struct<k:int>").collect()] == [1, 2]
    head = readers.json_header(spark, f"{tmp_path}/a.json", "license string, acquiredAt string").first()
    assert (head.license, head.acquiredAt) == ("open", "today") and head.path.endswith("a.json")
    (tmp_path / "b.json").write_text('{"id": 1}\n{"id": 2}{"id": 3\n')
    with pytest.raises(Exception):
        readers.canonical_records(spark, f"{tmp_path}/b.json", "id:int").collect()
    (tmp_path / "c.json").write_text('{"id": 1}\n\n{"id": 2}\n')
    assert [r.id for r in readers.canonical_records(spark, f"{tmp_path}/c.json", "id:int").collect()] == [1, 2]
    assert readers.first_existing(spark, [f"{tmp_path}/none", f"{tmp_path}/b.json"]).endswith("b.json")
    with gzip.open(tmp_path / "m.json.gz", "wt") as f:
        f.write('{"id": 1, "n": 2}\n{"id": 2}\nbroken\n')
    rows = readers.sidecars(spark, f"{tmp_path}/m.json.gz", "id int, n int", F.col("n") > 0).collect()
    assert [r.ok for r in rows] == [True, False, False]


def test_recount(spark, tmp_path):
    with gzip.open(tmp_path / "t.csv.gz", "wt") as f:
        f.write("id;lon;lat;commune\n1;0.5;43.5;Auch\n2;x;43;Auch\n\n3;0.1;43;Condom\n")
    got = {r.commune: tuple(r)[1:] for r in readers.recount(spark, f"{tmp_path}/t.csv.gz", 1, 2, 3).collect()}
    assert got == {None: (2, 1, 1, 0), "Auch": (2, 0, 0, 1), "Condom": (1, 0, 0, 0)}


def test_package(spark, tmp_path):
    path = f"{tmp_path}/p.gpkg"
    with sqlite3.connect(path) as db:
        db.execute("create table gpkg_geometry_columns (table_name text, column_name text)")
        db.execute("insert into gpkg_geometry_columns values ('roads', 'geom')")
        db.execute("create table roads (fid integer primary key, geom blob, nature text(40), width real)")
        db.executemany("insert into roads values (?, ?, ?, ?)", [(k, bytes([k % 250]), f"n{k % 3}", k / 2) for k in range(1, 301)])
        db.execute("create table void (fid integer primary key, name text)")
    assert package.columns(path, "roads") == [("fid", "long"), ("geom", "binary"), ("nature", "string"), ("width", "double")]
    d = package.layer(spark, path, "roads", rows=64)
    assert d.count() == 300 and d.agg(F.sum("width")).first()[0] == sum(k / 2 for k in range(1, 301))
    assert readers.survey_layer(spark, path, "roads", "nature = 'n0' and width > 10").count() == sum(k % 3 == 0 and k / 2 > 10 for k in range(1, 301))
    assert package.layer(spark, path, "void").count() == 0


def test_manifests(spark, tmp_path):
    a = spark.createDataFrame([("osm", "u", "7")], "source string, url string, recordCount string")
    b = spark.createDataFrame([("ban", "open", 3)], "name string, licence string, count long")
    assert sorted(tuple(r)[:3] + (r.records,) for r in sinks.source_manifest([a, b]).collect()) == [("ban", None, "open", 3), ("osm", "u", None, 7)]
    f = spark.createDataFrame([("road",), ("road",), ("poi",)], "kind string")
    t = spark.createDataFrame([(0, 5), (0, 6), (1, 2)], "lod int, bytes long")
    m = sorted(tuple(r) for r in sinks.dataset_manifest(f, t, f).collect())
    assert m == [("features", "poi", 1, None), ("features", "road", 2, None), ("records", "poi", 1, None), ("records", "road", 2, None), ("tiles", "0", 2, 11), ("tiles", "1", 1, 2)]
    cells = spark.createDataFrame([(True, 1, 9), (True, 0, 0), (False, 5, 99)], "territory boolean, tiles int, bytes long")
    assert tuple(sinks.coverage_manifest(cells, 8).first()) == (2, 1, 9, "over")
    sinks.sidecar(spark.createDataFrame([(1, "x")], "id int, geometry string"), f"{tmp_path}/s", "geometry")
    assert spark.read.json(f"{tmp_path}/s").columns == ["id"]
    sinks.report(f, f"{tmp_path}/r", "coverage")
    assert {r.report for r in spark.read.json(f"{tmp_path}/r").collect()} == {"coverage"}
    roads = spark.createDataFrame([("t", 1, 1, "a"), ("t", 5, 2, "b"), ("t", 5, 3, "c")], "tile string, rank int, seq int, id string")
    assert [x.id for x in sinks.minor_first(roads, "tile", "rank", "seq").first().roads] == ["b", "c", "a"]


def test_toponyms(spark):
    d = spark.createDataFrame([("Lieu-dit Les Pins", 1.0, 1.0), (None, 1.0, 1.0), ("Far", 99.0, 1.0)], "name string, x double, z double")
    boxes = spark.createDataFrame([(7, 0.0, 0.0, 10.0, 10.0)], "box_id long, x0 double, z0 double, x1 double, z1 double")
    got = sorted((r.layer, r.key, r.commune_id) for r in readers.toponyms({"a": (d, "name"), "b": (d, "name")}, boxes, 10).collect())
    assert got == [("a", "LES PINS", 7), ("a", "PINS", 7), ("b", "LES PINS", 7), ("b", "PINS", 7)]
