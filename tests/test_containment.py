"""Points in polygons with holes, on edges and vertices, against a scan of all edges."""

import random

from cartolith.operators import containment as m

POLYGONS = "polygon_id long, rings array<array<struct<x:double,y:double>>>"


def brute(x, y, rings):
    """(odd, on an exterior edge, on a hole's edge)"""
    odd, on, hole = False, False, False
    for k, ring in enumerate(rings or []):
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if (ax, ay) == (bx, by):
                continue
            cross = (y - ay) * (bx - ax) - (x - ax) * (by - ay)
            if abs(cross) <= 1e-10 and min(ax, bx) - 1e-10 <= x <= max(ax, bx) + 1e-10 and min(ay, by) - 1e-10 <= y <= max(ay, by) + 1e-10:
                on, hole = on or k == 0, hole or k > 0
            if (ay > y) != (by > y) and x < ax + (y - ay) / (by - ay) * (bx - ax):
                odd = not odd
    return odd, on, hole


def shapes():
    rng = random.Random(1)
    out = []
    for k in range(12):  # concave rings on a coarse grid, so that points meet edges and vertices; some overlap
        import math

        cx, cy, n = rng.randrange(-30, 30), rng.randrange(-30, 30), rng.choice([3, 5, 40, 300])
        ring = [(float(round(cx + rng.uniform(4, 20) * math.cos(2 * math.pi * i / n))), float(round(cy + rng.uniform(4, 20) * math.sin(2 * math.pi * i / n)))) for i in range(n)]
        out.append((k, [ring + ring[:1] if k % 2 else ring]))
    square = lambda a, b: [(a, a), (b, a), (b, b), (a, b), (a, a)]
    out += [(50, [square(0.0, 40.0), square(10.0, 20.0), square(25.0, 30.0)]), (51, []), (52, None), (53, [[(0.0, 5.0), (10.0, 5.0), (0.0, 5.0)]])]
    return out


def test_against_all_edges(spark):
    polygons = shapes()
    points = [(i, float(x), float(z)) for i, (x, z) in enumerate((x, z) for x in range(-45, 46, 3) for z in range(-45, 46, 3))] + [(90_000, None, 1.0), (90_001, 10.0, 15.0), (90_002, 15.0, 15.0), (90_003, 0.5, 40.0), (90_004, 2e6, 3.0)]
    p, d = spark.createDataFrame(points, "id long, x double, z double"), spark.createDataFrame(polygons, POLYGONS)
    every = {(i, k): brute(x, z, rings) for i, x, z in points if x is not None for k, rings in polygons}
    for size in (7.0, 1000.0):
        got = {(r.id, r.polygon_id) for r in m.held(p, d, size).collect()}
        assert got == {key for key, (odd, on, hole) in every.items() if (odd or on) and not hole}
    parity = {(r.id, r.polygon_id) for r in m.held(p, d, 7.0, inclusive=False).collect()}
    assert parity == {key for key, (odd, _, _) in every.items() if odd}
    assert (90_001, 50) not in got and (90_002, 50) not in got and (90_003, 50) in got


def test_first_or_nearest(spark):
    polygons = shapes()[:6]
    anchors = [(k, rings[0][0][0], rings[0][0][1]) for k, rings in polygons]
    points = [(i, float(i * 37 % 91 - 45), float(i * 53 % 89 - 44)) for i in range(300)]
    got = {r.id: (r.polygon_id, r.inside) for r in m.first_or_nearest(spark.createDataFrame(points, "id long, x double, z double"), spark.createDataFrame(polygons, POLYGONS), spark.createDataFrame(anchors, "polygon_id long, x double, z double"), 10.0, 12.0).collect()}
    for i, x, z in points:
        inside = [k for k, rings in polygons if brute(x, z, rings)[0]]
        near = sorted(((ax - x) ** 2 + (az - z) ** 2, k) for k, ax, az in anchors)
        want = (min(inside), True) if inside else (near[0][1], False) if near[0][0] < 144 else (None, None)
        assert got[i] == want


def test_many_long_edges(spark, monkeypatch):
    """A star of long edges, a ring that crosses itself and small ones; edges are dealt to a few bins each, where points meet them by bisection."""
    import math

    rng = random.Random(3)
    turn = lambda n, r: [(r() * math.cos(2 * math.pi * i / n), r() * math.sin(2 * math.pi * i / n)) for i in range(n)]
    star = []
    for i in range(900):
        r = rng.uniform(20, 40)
        star.append((r * math.cos(2 * math.pi * i / 900), r * math.sin(2 * math.pi * i / 900)))
    tangle = [(float(rng.randrange(-30, 31)), float(rng.randrange(-30, 31))) for _ in range(150)]
    polygons = [(1, [star, [(-5.0, -5.0), (5.0, -5.0), (5.0, 5.0), (-5.0, 5.0)]]), (2, [tangle]), (3, [turn(30, lambda: 10.0)])]
    points = [(i, float(x), float(z)) for i, (x, z) in enumerate((x, z) for x in range(-42, 43, 3) for z in range(-42, 43, 3))]
    points += [(10_000 + i, *star[i]) for i in range(0, 900, 45)] + [(20_000 + i, *tangle[i]) for i in range(0, 150, 10)]
    points += [(30_000 + i, (tangle[i][0] + tangle[i + 1][0]) / 2, (tangle[i][1] + tangle[i + 1][1]) / 2) for i in range(0, 140, 5)]
    d, p = spark.createDataFrame(polygons, POLYGONS), spark.createDataFrame(points, "id long, x double, z double")
    edges = m.polygon_edges(d)
    bins = {r.polygon_id: (r.bins, r.crowded) for r in m.binned_boxes(edges).collect()}
    assert bins[1][0] < 904 // 8 and not bins[3][1]
    monkeypatch.setattr(m, "CROWDED", 11)
    monkeypatch.setattr(m, "PART", 50)
    assert {r.polygon_id: r.crowded for r in m.binned_boxes(edges).collect()} == {1: True, 2: True, 3: False}
    every = {(i, k): brute(x, z, rings) for i, x, z in points for k, rings in polygons}
    for polygons_or_edges in (d, edges):
        assert {(r.id, r.polygon_id) for r in m.held(p, polygons_or_edges, 25.0).collect()} == {key for key, (odd, on, hole) in every.items() if (odd or on) and not hole}
    assert {(r.id, r.polygon_id) for r in m.held(p, d, 25.0, inclusive=False).collect()} == {key for key, (odd, _, _) in every.items() if odd}


def test_empty(spark):
    p, d = spark.createDataFrame([], "id long, x double, z double"), spark.createDataFrame(shapes(), POLYGONS)
    assert m.held(p, d, 10.0).count() == 0 and m.held(spark.createDataFrame([(1, 0.0, 0.0)], "id long, x double, z double"), d.where("false"), 10.0).count() == 0
