"""Lines that run along each other, against all pairs."""

import math
import random

from pyspark.sql import functions as F

from cartolith.operators import conflate, lines

PARTS = "array<array<struct<x:double,y:double>>>"


def far(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    n = dx * dx + dy * dy
    u = max(0, min(1, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / n)) if n else 0
    return math.hypot(p[0] - (a[0] + u * dx), p[1] - (a[1] + u * dy))


def apart(one, two):
    sides = []
    for p, q in ((one, two), (two, one)):
        spots = [s for part in p for s in part] + [((a[0] + b[0]) / 2, (a[1] + b[1]) / 2) for part in p for a, b in zip(part, part[1:])]
        sides.append(max((min((far(s, a, b) for part in q for a, b in zip(part, part[1:])), default=math.inf) for s in spots), default=math.inf))
    return max(sides)


def some(seed, n):
    rng, out = random.Random(seed), []
    for _ in range(n):
        x, y, line = rng.uniform(-60, 60), rng.uniform(-60, 60), []
        turn = rng.uniform(0, 6.3)
        for _ in range(rng.randrange(2, 7)):
            line.append((x, y))
            step = rng.choice([0.0, 3.0, 40.0, 300.0])
            x, y = x + step * math.cos(turn), y + step * math.sin(turn)
            turn += rng.uniform(-0.4, 0.4)
        out.append([line])
        for _ in range(rng.randrange(0, 3)):  # copies, shifted, turned round, cut in two, or with more points
            s = rng.choice([0.0, 1.0, 2.9, 3.5])
            copy = [(a + s, b) for a, b in line][:: rng.choice([1, -1])]
            kind = rng.randrange(3)
            if kind == 1 and len(copy) > 2:
                out.append([copy[:2], copy[1:]])
            elif kind == 2:
                out.append([[q for a, b in zip(copy, copy[1:]) for q in (a, (a[0] + (b[0] - a[0]) * 0.3, a[1] + (b[1] - a[1]) * 0.3))] + copy[-1:]])
            else:
                out.append([copy])
    return out + [[[(0.0, 0.0)]], [], [[]], [[(5.0, -50.0), (5.0, 50.0)]], [[(6.0, -50.0), (6.0, 50.0)]], [[(5.0, 0.0), (5.0, 0.0)]]]


def frame(spark, items, extra=()):
    rows = [(k, None if v is None else [[{"x": x, "y": y} for x, y in part] for part in v], *(e[k] for e in extra)) for k, v in enumerate(items)]
    return spark.createDataFrame(rows, f"id long, parts {PARTS}" + "".join(f", e{i} string" for i in range(len(extra))))


def test_against_all_pairs(spark):
    items = [*some(1, 60), None]
    want = {(i, j): apart(a, b) for i, a in enumerate(items) if a for j, b in enumerate(items) if b and i < j}
    for most, width in ((3.0, None), (3.0, 5.0), (0.5, 400.0)):
        got = {(r.a, r.b): r.d for r in lines.close_lines(frame(spark, items), most, width=width).collect()}
        hits = {k: d for k, d in want.items() if d <= most}
        assert got.keys() == hits.keys() and all(abs(got[k] - d) < 1e-9 for k, d in hits.items()) and len(hits) > 10


def test_rule_and_clashing_columns(spark):
    items = some(2, 30)
    tags = ["ab"[k % 2] for k in range(len(items))]
    d = frame(spark, items, [tags]).withColumn("no", F.lit(1)).withColumn("other", F.lit(2)).withColumn("cx", F.lit(3)).withColumn("d", F.lit(4)).withColumn("n", F.lit(5))
    got = {(r.a, r.b) for r in lines.close_lines(d, 3.0, lambda l, r: l("e0") != r("e0")).collect()}
    assert got == {(i, j) for i, a in enumerate(items) for j, b in enumerate(items) if i < j and a and b and apart(a, b) <= 3.0 and tags[i] != tags[j]}


def test_conflated_roads_need_boxes_that_overlap(spark):
    flat = lambda z, x=0.0: [[(x, z), (x + 50.0, z)]]
    tilted = [[(0.0, 0.0), (50.0, 4.0)]]
    rows = [(0, "road", "osm", "Rue A", None, flat(0.0)), (1, "road", "communal", "rue a", None, flat(3.0)), (2, "road", "communal", "Rue A", None, tilted), (3, "road", "IGN BD TOPO", None, None, tilted), (4, "road", "communal", "Rue B", "track", tilted), (5, "river", "osm", "Rue A", None, tilted)]
    d = spark.createDataFrame([(i, k, s, n, c, 0.0, 0.0, [[{"x": x, "y": y} for x, y in part] for part in p]) for i, k, s, n, c, p in rows], f"id long, kind string, source string, name string, road_class string, x double, z double, parts {PARTS}")
    got = {(r.a, r.b) for r in conflate.conflated_lines(d, {"road": (4.0, conflate.same_road)}).collect()}
    assert got == {(0, 2), (0, 3), (1, 3), (2, 3), (3, 4)}


def test_empty(spark):
    assert lines.close_lines(frame(spark, []), 4.0).count() == 0
    d = spark.createDataFrame([(1, [[{"x": 0.0, "y": 0.0}, {"x": 3.0, "y": 0.0}]], 1.0, 2.0)], f"id long, parts {PARTS}, px double, py double")
    assert d.select(lines.nearest_edge(F.col("px"), F.col("py"), F.col("parts"))).first()[0] == 2.0


def test_lines_of_one_start_are_no_candidates(spark, monkeypatch):
    """A fan of lines from one point, each with a copy: only the copies have boxes alike."""
    fan = [[[(0.0, 0.0), (60.0 + 9 * k, 900.0 - 9 * k)]] for k in range(60)]
    kept, seen = lines.materialise, []
    monkeypatch.setattr(lines, "materialise", lambda df, name="step": seen.append(df.count() if name == "line-pairs" else 0) or kept(df, name))
    got = {(r.a, r.b) for r in lines.close_lines(frame(spark, [line for line in fan for _ in (0, 1)]), 3.0).collect()}
    assert got == {(2 * k, 2 * k + 1) for k in range(60)} and max(seen) == 60
