"""Golden values of display names, opening hours, relations and addresses."""

import pytest
from pyspark.sql import functions as F

from cartolith.functions import hours, text
from cartolith.operators.osm import join_ends, relation_polygons


@pytest.mark.parametrize(
    "value, want",
    [("PLACE DE L'ÉTANG", "Place de l'Étang"), ("impasse du tilleul", "Impasse du Tilleul"), ("Jean-paul", "Jean-paul"), ("MONT-LAUR", "Mont-Laur"), ("7", "7"), ("  la  NOUE ", "la NOUE")],
)
def test_display_case(spark, value, want):
    assert spark.createDataFrame([(value,)], "v string").select(text.display_case(F.col("v"))).first()[0] == want


@pytest.mark.parametrize(
    "value, want",
    [
        ("3 RUE HAUTE 65400 ARGELES", ("3", "RUE HAUTE", "65400", "ARGELES")),
        ("8 ter quai Neuf, 31000 Toulouse", ("8 ter", "quai Neuf", "31000", "Toulouse")),
        ("Cours des Halles", (None, "Cours des Halles", None, None)),
    ],
)
def test_postal_address(spark, value, want):
    assert tuple(spark.createDataFrame([(value,)], "v string").select(text.postal_address(F.col("v")).alias("a")).select("a.*").first()) == want


def test_hours():
    week = hours.parse("Mo-Th 08:30-12:30,13:00-17:00; Su 10:00-11:00; PH off")
    assert week[0] == week[3] == [{"start": 510, "stop": 750}, {"start": 780, "stop": 1020}] and week[6] == [{"start": 600, "stop": 660}] and week[5] == []
    assert hours.parse("Sa-Tu 21:00-01:30")[0] == [{"start": 1260, "stop": 1530}] and hours.parse("Sa-Tu 21:00-01:30")[2] == []
    assert hours.parse("on demand") is None and hours.parse(None) is None and hours.parse("Tu 8-11") is None
    assert hours.parse("We 10:00-18:00+")[2] == [{"start": 600, "stop": 1080}]
    assert hours.parse("25:70-26:00") is None and hours.parse("Mo") is None
    assert all(d == [{"start": 0, "stop": 1440}] for d in hours.parse("24/7"))


def test_relations(spark):
    square = [(0.0, 0.0), (0.0, 10.0), (10.0, 10.0), (10.0, 0.0)]
    ways = {i: [square[i], square[(i + 1) % 4]] for i in range(4)}
    ways[2] = ways[2][::-1]
    ways[9] = [(2.0, 2.0), (4.0, 2.0), (4.0, 4.0), (2.0, 2.0)]
    lines = spark.createDataFrame([(k, [{"x": x, "y": y} for x, y in v]) for k, v in ways.items()], "way_id long, line array<struct<x:double,y:double>>")
    members = [(1, i, "outer", i) for i in range(4)] + [(1, 4, "inner", 9), (1, 5, "label", 77), (1, 6, "outer", 2)] + [(2, 0, "outer", 0)] + [(3, 0, "outer", 55)] + [(4, 0, "inner", 9)]
    got = sorted(relation_polygons(spark.createDataFrame(members, "relation_id long, pos int, role string, way_id long"), lines).collect(), key=lambda r: (r.relation_id, r.ring or 0))
    assert [(r.relation_id, r.ring, r.problem) for r in got] == [(1, 0, None), (1, 1, None), (2, None, "open outer ring"), (3, None, "missing way"), (4, None, "no outer ring")]
    assert len(got[0].line) == 5 and len(got[1].line) == 4
    assert join_ends([[1, 2], [3, 2], [3, 1]]) == [[1, 2, 3, 1]]


def test_distinct_hits(spark):
    import math
    import random

    from cartolith.operators.search import distinct_hits

    rng = random.Random(1)
    rows = [(i, rng.choice(["A b", "a-B", "c"]), rng.random() * 500, rng.random() * 500, float(rng.randrange(100))) for i in range(60)]
    want = []
    for r in sorted(rows, key=lambda r: (-r[4], r[1], r[0])):
        if len(want) < 10 and not any(w[1].lower().replace("-", " ") == r[1].lower().replace("-", " ") and math.hypot(w[2] - r[2], w[3] - r[3]) < 150 for w in want):
            want.append(r)
    got = distinct_hits(spark.createDataFrame(rows, "record_id long, name string, x double, z double, score double"), 10).collect()
    assert [r.record_id for r in got] == [w[0] for w in want]


def test_category_bonus(spark):
    from cartolith.operators.search import with_category

    d = spark.createDataFrame([(1, "hotel", 10.0), (2, "bus_stop", 500.0), (3, None, 20.0)], "record_id long, category string, score double")
    assert {r.record_id: r.score for r in with_category(d, ("hotel",)).collect()} == {1: 250.0, 2: 100.0, 3: 20.0}


def test_next_opening(spark):
    week = [[(540, 720)], [], [(600, 660)], [], [], [], []]
    d = spark.createDataFrame([(week, 0, 500), (week, 0, 600), (week, 2, 600), (week, 3, 0), ([[]] * 7, 0, 0)], "w array<array<struct<start:int,stop:int>>>, day int, minute int")
    got = [r[0] and tuple(r[0]) for r in d.select(hours.next_opening(F.col("w"), F.col("day"), F.col("minute"))).collect()]
    assert got == [(0, 540), (2, 600), (5, 540), (4, 540), None]


def test_categories_of_rarer_tags(spark):
    """Tags beyond the common ones, key order and presence: examples of our own."""
    from cartolith.functions import osm_tags

    rows = [
        ({"shop": "pastry"}, "bakery"), ({"amenity": "college"}, "university"), ({"tourism": "hostel", "name": "x"}, "hotel"), ({"shop": "variety_store"}, "gift_shop"), ({"healthcare": "midwife"}, "nurse"),
        ({"historic": "city_gate", "shop": "kiosk"}, "castle"), ({"shop": "kiosk"}, "shop"), ({"craft": "distillery"}, "winery"), ({"craft": "roofer"}, "contractor"), ({"amenity": "spa", "shop": "bakery"}, "fitness"), ({"natural": "tree"}, None),
    ]
    d = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "k int, t map<string,string>")
    assert [r.c for r in d.select("k", osm_tags.category(d.t).alias("c")).orderBy("k").collect()] == [c for _, c in rows]
    assert len(osm_tags.TAG_CATEGORY) == 199
