"""Strict schemas: every kind, every fault by its path, and the parting of rows."""

import json

import pytest
from pyspark.sql import functions as F

from cartolith.operators import schemas

SQUARE = [[0, 0], [4, 0], [4, 4.5], [0, 4], [0, 0]]
HOLE = [[1, 1], [1, 2], [2, 2], [1, 1]]
OWN = {"boundary": {"territoryCode": "32"}, "landuse": {"landuseType": "forest"}, "poi": {"poiType": "cafe"}, "business": {"businessName": "B"}, "address": {"street": "Rue A"}, "transport": {"transportType": "bus"}, "structure": {"structureType": "mast"}, "place": {"placeType": "town"}}
AREA = {"type": "Polygon", "coordinates": [SQUARE, HOLE]}


def feature(kind="poi", **more):
    out = {"stableId": "a", "kind": kind, "geometry": AREA} | OWN.get(kind, {}) | more
    return {k: v for k, v in out.items() if v is not ...}


def geo(kind, coordinates, **more):
    return feature(geometry={"type": kind, "coordinates": coordinates} | more)


REF = {"source": "s", "timestamp": "t"}
PROOF = {"featureId": "f", "property": "p", "winner": "w", "contenders": ["w"], "priority": 1, "timestamp": "t"}
G = "geometry.coordinates"
CASES = [
    *[(feature(k), []) for k in schemas.KINDS],
    (feature(stableId=...), [("stableId", "missing")]),
    (feature(stableId=""), [("stableId", "empty")]),
    (feature(stableId=7), [("stableId", "type")]),
    (feature(name=None), [("name", "type")]),
    (feature(extra=1, poiTypes="x"), [("extra", "unknown"), ("poiTypes", "unknown")]),
    (feature("road", poiType="x"), [("poiType", "unknown")]),
    (feature("shop"), [("kind", "choice")]),
    (feature(kind=3), [("kind", "choice")]),
    (feature("building", height=-1, levels=1.5, heightInferred="no", heightSource="guess"), [("height", "low"), ("heightInferred", "type"), ("heightSource", "choice"), ("levels", "whole")]),
    (feature("building", height=3.25, levels=2.0, yearConstructed=-50, heightInferred=True), []),
    (feature("building", height="12"), [("height", "type")]),
    (feature("place", importance=7), [("importance", "high")]),
    (feature("place", importance=0, population=1e6), [("importance", "low")]),
    (feature("road", lanes=0, stratum="air", surface="anything"), [("lanes", "low"), ("stratum", "choice")]),
    (feature("water", salt="maybe"), [("salt", "choice")]),
    (feature("landuse", landuseType=..., area=0), [("landuseType", "missing")]),
    (feature(names=["a", 1, None]), [("names.1", "type"), ("names.2", "type")]),
    (feature(names="a"), [("names", "type")]),
    (feature(sourceMetadata={"a": [1]}), []),
    (feature(sourceMetadata=[1]), [("sourceMetadata", "type")]),
    (feature(sourceMetadata={}), []),
    (feature(sourceRefs=[REF, REF | {"sha256": "A" * 64, "recordCount": 3}]), []),
    (feature(sourceRefs=[REF | {"sha256": "z"}, {"source": "s", "why": 1}]), [("sourceRefs.0.sha256", "pattern"), ("sourceRefs.1.timestamp", "missing"), ("sourceRefs.1.why", "unknown")]),
    (feature(provenance=[PROOF, PROOF | {"contenders": [], "priority": 0}, 5]), [("provenance.1.contenders", "few"), ("provenance.1.priority", "low"), ("provenance.2", "type")]),
    (geo("Point", [1, 2.5]), []),
    (geo("Point", [1, 2, 3]), [(G, "pair")]),
    (geo("Point", ["1", 2]), [(G, "type")]),
    (geo("Point", []), [(G, "pair")]),
    (geo("Point", [1, None]), [(G, "pair")]),
    (geo("LineString", [[0, 0]]), [(G, "few")]),
    (geo("LineString", []), [(G, "few")]),
    (geo("LineString", [[0, 0], [1, 1]], bbox=[1]), [("geometry.bbox", "unknown")]),
    (geo("MultiLineString", [[[0, 0], [1, 1]], [[0, 0]]]), [(G + ".1", "few")]),
    (geo("MultiLineString", []), [(G, "few")]),
    (geo("Circle", []), [("geometry.type", "choice")]),
    (geo("Polygon", []), [(G, "few")]),
    (geo("Polygon", [[]]), [(G + ".0", "few")]),
    (geo("Polygon", [SQUARE[:4]]), [(G + ".0", "open")]),
    (geo("Polygon", [SQUARE[:3]]), [(G + ".0", "few")]),
    (geo("Polygon", [[[0, 0], [1, 1], [1, 1], [0, 0]]]), [(G + ".0", "no area"), (G + ".0", "repeats a point")]),
    (geo("Polygon", [HOLE, SQUARE]), [(G + ".1", "not smaller"), (G + ".1", "outside")]),
    (geo("Polygon", SQUARE), [(G, "type")]),
    (geo("MultiPolygon", [[SQUARE], [SQUARE, [[9, 9], [9, 10], [10, 10], [9, 9]]]]), [(G + ".1.1", "outside")]),
    (feature("boundary", geometry={"type": "Point", "coordinates": [0, 0]}), [("geometry.type", "choice")]),
    (feature(geometry={"type": "Point"}), [(G, "missing")]),
    (feature(geometry=[1]), [("geometry", "type")]),
    (feature(geometry=..., localGeometry={"type": "Point", "coordinates": [0, 0]}), [("geometry", "missing")]),
    ([1], [("", "type")]),
    ({}, [("kind", "choice")]),
]


@pytest.fixture(scope="module")
def judged(spark):
    rows = [(k, json.dumps(v)) for k, (v, _) in enumerate(CASES)] + [(9000, "{"), (9001, None), (9002, ""), (9003, "null")]
    d = spark.createDataFrame(rows, "no int, json string")
    return d, {r.no: [(f.path, f.problem) for f in r.faults] for r in d.select("no", schemas.feature_faults(F.col("json")).alias("faults")).collect()}


def test_faults(judged):
    wrong = [(CASES[k][0], want, judged[1][k]) for k, (_, want) in enumerate(CASES) if sorted(judged[1][k]) != sorted(want)]
    assert not wrong
    assert judged[1][9000] == judged[1][9001] == judged[1][9002] == [("", "no JSON")] and judged[1][9003] == [("", "type")]


def test_parted(judged):
    sound, held = schemas.parted(judged[0].withColumn("path", F.lit("x")))
    assert sound.columns == ["no", "json", "path"]
    good, bad = {r.no for r in sound.collect()}, {r.no for r in held.collect()}
    assert good == {k for k, (_, want) in enumerate(CASES) if not want} and not good & bad and len(good | bad) == judged[0].count()
