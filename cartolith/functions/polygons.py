"""Polygons and lines as Column expressions: containment, repair, validity, anchors, and cuts. Rings are arrays of struct<x, y>; a
polygon is an array of closed rings, the exterior first. Only the exact intersection area loops in numpy."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import geometry as G

EPSILON, BOUND = 1e-10, 1e7
_POINTS = "array<struct<x:double,y:double>>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def rest(items: Column, first: int = 2) -> Column:
    """The items from the first-th on."""
    return F.slice(items, F.lit(first), F.greatest(F.size(items) - (first - 1), F.lit(0)))


def on_edge(x: Column, y: Column, a: Column, b: Column) -> Column:
    cross = (y - a["y"]) * (b["x"] - a["x"]) - (x - a["x"]) * (b["y"] - a["y"])
    within = lambda v, k: (v >= F.least(a[k], b[k]) - EPSILON) & (v <= F.greatest(a[k], b[k]) + EPSILON)
    return (F.abs(cross) <= EPSILON) & within(x, "x") & within(y, "y")


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a closed ring holds a point; its edges count as inside."""
    return F.exists(G.edges(ring), lambda e: on_edge(x, y, e["a"], e["b"])) | G.in_ring(x, y, ring)


def in_polygon(x: Column, y: Column, rings: Column) -> Column:
    """In the exterior and in no hole; a point on a hole's edge is in the hole."""
    return in_ring(x, y, F.get(rings, F.lit(0))) & ~F.exists(rest(rings), lambda hole: in_ring(x, y, hole))


def in_polygons(x: Column, y: Column, polygons: Column) -> Column:
    return F.exists(polygons, lambda rings: in_polygon(x, y, rings))


def area(rings: Column) -> Column:
    """The exterior's area less that of the holes."""
    size = lambda ring: F.abs(G.signed_area(ring))
    return F.aggregate(rest(rings), size(F.get(rings, F.lit(0))), lambda s, hole: s - size(hole))


def same(a: Column, b: Column) -> Column:
    return (F.abs(a["x"] - b["x"]) <= EPSILON) & (F.abs(a["y"] - b["y"]) <= EPSILON)


def clean_ring(ring: Column) -> Column:
    """Closed, without points that repeat their neighbour."""
    none = F.array().cast(_POINTS)
    bare = F.aggregate(ring, none, lambda s, p: F.when((F.size(s) > 0) & same(F.element_at(F.when(F.size(s) > 0, s).otherwise(F.array(p)), -1), p), s).otherwise(F.concat(s, F.array(p))))

    def close(s: Column) -> Column:
        twice = (F.size(s) > 1) & same(F.get(s, F.lit(0)), F.get(s, F.size(s) - 1))
        open_ = F.when(twice, F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(s)
        return F.when(F.size(open_) > 0, F.concat(open_, F.slice(open_, 1, 1))).otherwise(none)

    return let(bare, close)


def repaired(rings: Column) -> Column:
    """Rings cleaned, the exterior counter-clockwise and holes clockwise; holes without area or outside are dropped. Null without an exterior."""

    def whole(clean: Column) -> Column:
        sound = lambda ring: (F.size(ring) >= 4) & (F.abs(G.signed_area(ring)) > EPSILON)
        turned = lambda ring, sign: F.when(G.signed_area(ring) * sign < 0, F.reverse(ring)).otherwise(ring)
        exterior = F.get(clean, F.lit(0))
        holes = F.filter(rest(clean), lambda h: sound(h))
        inside = F.filter(F.transform(holes, lambda h: turned(h, -1)), lambda h: in_ring(h[0]["x"], h[0]["y"], exterior))
        return F.when(sound(exterior), F.concat(F.array(turned(exterior, 1)), inside))

    return let(F.transform(rings, clean_ring), whole)


def problems(rings: Column) -> Column:
    """What keeps a polygon from being drawn, as an array of texts; empty for a sound one."""
    whole_ring = lambda ring: F.concat(ring, F.slice(ring, 1, 1))
    size = lambda ring: G.signed_area(whole_ring(ring))
    exterior = F.get(rings, F.lit(0))

    def of_ring(ring: Column, label: Column) -> Column:
        say = lambda bad, what: F.when(bad, F.concat(label, F.lit(what)))
        finite = F.forall(ring, lambda p: ~F.isnan(p["x"]) & ~F.isnan(p["y"]) & (F.abs(p["x"]) < float("inf")) & (F.abs(p["y"]) < float("inf")))
        return F.array(
            say(F.size(ring) < 4, " has fewer than 4 points"), say(~same(F.get(ring, F.lit(0)), F.get(ring, F.size(ring) - 1)), " is not closed"), say(~finite, " is not finite"),
            say(F.exists(ring, lambda p: (F.abs(p["x"]) > BOUND) | (F.abs(p["y"]) > BOUND)), " is out of bounds"), say(F.exists(G.edges(ring), lambda e: same(e["a"], e["b"])), " repeats a point"),
            say(F.abs(size(ring)) <= EPSILON, " has no area"),
        )

    def of_hole(hole: Column, i: Column) -> Column:
        label = F.concat(F.lit("hole "), (i + 1).cast("string"))
        say = lambda bad, what: F.when(bad, F.concat(label, F.lit(what)))
        mine, whole = size(hole), size(exterior)
        return F.concat(of_ring(hole, label), F.array(say(F.abs(mine) >= F.abs(whole), " is not smaller"), say(~in_ring(hole[0]["x"], hole[0]["y"], whole_ring(exterior)), " is outside"), say(F.signum(mine) == F.signum(whole), " winds like the exterior")))

    few = F.array(F.lit("exterior has fewer than 4 points"))
    found = F.array_compact(F.concat(of_ring(exterior, F.lit("exterior")), F.flatten(F.transform(rest(rings), of_hole))))
    return F.when(F.coalesce(F.size(rings), F.lit(0)) == 0, F.array(F.lit("no rings"))).when(F.size(exterior) < 4, few).otherwise(found)


def _moments(ring: Column) -> Column:
    """struct<area, x, y>: absolute area and centroid; the mean of the points where there is no area."""
    s = F.aggregate(
        G.edges(ring), F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")),
        lambda s, e: let(e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"], lambda c: F.struct((s["a"] + c / 2).alias("a"), (s["x"] + (e["a"]["x"] + e["b"]["x"]) * c).alias("x"), (s["y"] + (e["a"]["y"] + e["b"]["y"]) * c).alias("y"))),
    )
    mean = lambda k: G.total(F.transform(ring, lambda p: p[k])) / F.size(ring)
    flat = F.struct(F.lit(0.0).alias("area"), mean("x").alias("x"), mean("y").alias("y"))
    return let(s, lambda v: F.when(F.abs(v["a"]) <= 1e-9, flat).otherwise(F.struct(F.abs(v["a"]).alias("area"), (v["x"] / (v["a"] * 6)).alias("x"), (v["y"] / (v["a"] * 6)).alias("y"))))


def centroid(rings: Column) -> Column:
    """Centroid of a polygon by area, holes taken out; the exterior's where the holes leave nothing."""

    def whole(m: Column) -> Column:
        outer = F.get(m, F.lit(0))
        zero = F.struct(outer["area"].alias("w"), (outer["x"] * outer["area"]).alias("x"), (outer["y"] * outer["area"]).alias("y"))
        s = F.aggregate(rest(m), zero, lambda s, h: F.struct((s["w"] - h["area"]).alias("w"), (s["x"] - h["x"] * h["area"]).alias("x"), (s["y"] - h["y"] * h["area"]).alias("y")))
        return let(s, lambda v: F.when(v["w"] <= 1e-9, point(outer["x"], outer["y"])).otherwise(point(v["x"] / v["w"], v["y"] / v["w"])))

    return let(F.transform(rings, _moments), whole)


def label_anchor(rings: Column) -> Column:
    """Centroid of the largest ring of a polygon, to the centimetre; a different point from centroid()."""
    m = F.transform(rings, _moments)
    largest = F.reduce(rest(m), F.get(m, F.lit(0)), lambda a, b: F.when(b["area"] > a["area"], b).otherwise(a))
    cm = lambda c: F.floor(c * 100 + 0.5) / 100
    return let(largest, lambda v: point(cm(v["x"]), cm(v["y"])))


def at_distance(line: Column, distance: Column) -> Column:
    """The point so far along a line; its ends before and beyond."""

    def step(s: Column, e: Column) -> Column:
        long = F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"])
        share = F.when(long > 0, s["left"] / long).otherwise(0.0)
        here = point(e["a"]["x"] + (e["b"]["x"] - e["a"]["x"]) * share, e["a"]["y"] + (e["b"]["y"] - e["a"]["y"]) * share)
        return F.struct((s["left"] - long).alias("left"), F.when(s["p"].isNull() & (s["left"] <= long), here).otherwise(s["p"]).alias("p"))

    zero = F.struct(F.greatest(F.lit(0.0), distance).alias("left"), F.lit(None).cast("struct<x:double,y:double>").alias("p"))
    return F.aggregate(G.edges(line), zero, step, lambda s: F.coalesce(s["p"], F.get(line, F.size(line) - 1)))


def midpoint(line: Column) -> Column:
    """Half-way along a line; the mean of its points where it has no length."""
    mean = lambda k: G.total(F.transform(line, lambda p: p[k])) / F.size(line)
    return let(G.length(line), lambda n: F.when(n == 0, point(mean("x"), mean("y"))).otherwise(at_distance(line, n / 2)))


def running(line: Column) -> Column:
    """Distance of each point from the first, along the line."""
    steps = F.transform(G.edges(line), lambda e: F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]))
    return F.aggregate(steps, F.array(F.lit(0.0)), lambda s, d: F.concat(s, F.array(F.element_at(s, -1) + d)))


def inside_anchor(anchor: Column, line: Column, rings: Column) -> Column:
    """The anchor if a polygon holds it, else the first of the points that it holds, else the anchor."""
    held = F.filter(line, lambda p: in_polygon(p["x"], p["y"], rings))
    return F.when(in_polygon(anchor["x"], anchor["y"], rings), anchor).otherwise(F.coalesce(F.get(held, F.lit(0)), anchor))


def clip_ring(ring: Column, box: Column) -> Column:
    """A closed ring cut to a box (x0, y0, x1, y1), one side after the other; empty if nothing is left."""
    none = F.array().cast(_POINTS)

    def side(points: Column, key: str, sign: int, bound: Column) -> Column:
        depth = lambda p: (p[key] - bound) * sign

        def cut(p: Column, q: Column) -> Column:
            d, e = depth(p), depth(q)
            share = d / (d - e)
            crossing = point(p["x"] + (q["x"] - p["x"]) * share, p["y"] + (q["y"] - p["y"]) * share)
            stays = d >= 0
            return F.when(stays & (e >= 0), F.array(p)).when(stays, F.array(p, crossing)).when(e >= 0, F.array(crossing)).otherwise(none)

        after = F.concat(rest(points), F.slice(points, 1, 1))
        return F.when(F.forall(points, lambda p: depth(p) >= 0), points).otherwise(F.flatten(F.zip_with(points, after, cut)))

    open_ = F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0)))
    sides = [partial(side, key=key, sign=sign, bound=box[bound]) for key, sign, bound in (("x", 1, "x0"), ("x", -1, "x1"), ("y", 1, "y0"), ("y", -1, "y1"))]
    for one in sides:
        open_ = let(open_, lambda pts: one(pts))  # noqa: B023
    return let(open_, lambda pts: F.when(F.size(pts) >= 3, F.concat(pts, F.slice(pts, 1, 1))).otherwise(none))


def _runs(pieces: Column) -> Column:
    """Lines of two points or more from pieces (array<struct<a, b>>, null where the line is cut): a piece goes on the last run if it begins where that ends."""
    none = F.array().cast(f"array<{_POINTS}>")

    def step(s: Column, e: Column) -> Column:
        last = F.element_at(F.when(F.size(s["runs"]) > 0, s["runs"]).otherwise(F.array(F.array(e["a"]))), -1)
        grown = F.concat(F.slice(s["runs"], F.lit(1), F.greatest(F.size(s["runs"]) - 1, F.lit(0))), F.array(F.when(same(F.element_at(last, -1), e["b"]), last).otherwise(F.concat(last, F.array(e["b"])))))
        fresh = F.concat(s["runs"], F.array(F.array(e["a"], e["b"])))
        return F.struct(F.when(e.isNull(), s["runs"]).when(s["open"], grown).otherwise(fresh).alias("runs"), e.isNotNull().alias("open"))

    return F.aggregate(pieces, F.struct(none.alias("runs"), F.lit(False).alias("open")), step, lambda s: s["runs"])


def clip_line(line: Column, box: Column, bleed: Column) -> Column:
    """The parts of a line in a box widened by bleed, each as a line."""
    empty = F.lit(None).cast("struct<a:struct<x:double,y:double>,b:struct<x:double,y:double>>")

    def part(e: Column) -> Column:
        dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        reach = lambda lo, hi, at, d: F.struct(F.when(d == 0, F.lit(0.0)).otherwise(F.least((lo - at) / d, (hi - at) / d)).alias("lo"), F.when(d == 0, F.lit(1.0)).otherwise(F.greatest((lo - at) / d, (hi - at) / d)).alias("hi"))
        spans = F.struct(reach(box["x0"] - bleed, box["x1"] + bleed, e["a"]["x"], dx).alias("x"), reach(box["y0"] - bleed, box["y1"] + bleed, e["a"]["y"], dy).alias("y"))
        # a segment that runs along an axis is judged by where it lies
        beside = (dx == 0) & ((e["a"]["x"] < box["x0"] - bleed) | (e["a"]["x"] > box["x1"] + bleed)) | (dy == 0) & ((e["a"]["y"] < box["y0"] - bleed) | (e["a"]["y"] > box["y1"] + bleed))

        def cut(s: Column) -> Column:
            lo, hi = F.greatest(F.lit(0.0), s["x"]["lo"], s["y"]["lo"]), F.least(F.lit(1.0), s["x"]["hi"], s["y"]["hi"])
            at = lambda t: point(e["a"]["x"] + dx * t, e["a"]["y"] + dy * t)
            piece = F.struct(F.when(lo > 0, at(lo)).otherwise(e["a"]).alias("a"), F.when(hi < 1, at(hi)).otherwise(e["b"]).alias("b"))
            # what is cut off before or behind ends a run
            return F.when(beside | (hi - lo <= 1e-10), F.array(empty)).otherwise(F.concat(F.when(lo > 0, F.array(empty)).otherwise(F.array().cast("array<struct<a:struct<x:double,y:double>,b:struct<x:double,y:double>>>")), F.array(piece), F.when(hi < 1, F.array(empty)).otherwise(F.array().cast("array<struct<a:struct<x:double,y:double>,b:struct<x:double,y:double>>>"))))

        return let(spans, cut)

    return _runs(F.flatten(F.transform(G.edges(line), part)))


def clip_line_to_polygon(line: Column, rings: Column) -> Column:
    """The parts of a line in a polygon: each segment is cut where it crosses an edge, and the pieces whose middle is inside stay."""
    all_edges = F.flatten(F.transform(rings, G.edges))

    def pieces(e: Column) -> Column:
        dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]

        def crossing(f: Column) -> Column:
            fx, fy = f["b"]["x"] - f["a"]["x"], f["b"]["y"] - f["a"]["y"]
            by = dx * fy - dy * fx
            ox, oy = f["a"]["x"] - e["a"]["x"], f["a"]["y"] - e["a"]["y"]
            s, t = (ox * fy - oy * fx) / by, (ox * dy - oy * dx) / by
            return F.when((F.abs(by) > EPSILON) & (s > EPSILON) & (s < 1 - EPSILON) & (t > EPSILON) & (t < 1 - EPSILON), s)

        stops = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.array_compact(F.transform(all_edges, crossing)))))
        at = lambda t: point(e["a"]["x"] + dx * t, e["a"]["y"] + dy * t)

        def piece(lo: Column, hi: Column) -> Column:
            middle = at((lo + hi) / 2)
            return F.when(in_polygon(middle["x"], middle["y"], rings), F.struct(at(lo).alias("a"), at(hi).alias("b")))

        def spans(s: Column) -> Column:
            kept = F.filter(F.zip_with(s, rest(s), lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))), lambda v: v["hi"].isNotNull() & (v["hi"] - v["lo"] > EPSILON))
            return F.transform(kept, lambda v: piece(v["lo"], v["hi"]))

        return let(stops, spans)

    return _runs(F.flatten(F.transform(G.edges(line), pieces)))


def crosses(line: Column, rings: Column) -> Column:
    """Whether a segment of a line properly crosses an edge of a polygon."""
    side = lambda a, b, p: F.signum((b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"]))
    apart = lambda e, f: (side(e["a"], e["b"], f["a"]) * side(e["a"], e["b"], f["b"]) < 0) & (side(f["a"], f["b"], e["a"]) * side(f["a"], f["b"], e["b"]) < 0)
    return F.exists(G.edges(line), lambda e: F.exists(rings, lambda r: F.exists(G.edges(r), lambda f: apart(e, f))))


def placed(line: Column, rings: Column) -> Column:
    """inside or outside where a line lies wholly so, which spares the exact cut; else cut."""
    held = F.transform(line, lambda p: in_polygon(p["x"], p["y"], rings))
    free = ~crosses(line, rings)
    return F.when(F.forall(held, lambda h: h) & free, "inside").when(~F.exists(held, lambda h: h) & free, "outside").otherwise("cut")


def paired(a: Column, b: Column) -> Column:
    """Vertices of two lines of one shape, side by side; null where their numbers differ."""
    return F.when(F.size(a) == F.size(b), F.arrays_zip(a.alias("a"), b.alias("b")))


def flat_distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres between two positions in degrees, on a plane scaled at their mean latitude."""
    mean = F.radians((lat1 + lat2) / 2)
    return F.hypot((lon1 - lon2) * 111320 * F.cos(mean), (lat1 - lat2) * 111320)


def fixed_distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres between two positions with 80 km a degree of longitude and 111 km one of latitude."""
    return F.hypot((lon1 - lon2) * 80000, (lat1 - lat2) * 111000)


def on_tile_edge(p: Column, tile: Column, tolerance: float = 0.01) -> Column:
    """Whether a point lies on the edge of a tile's box."""
    near = lambda v, k: (F.abs(v - tile[f"{k}0"]) <= tolerance) | (F.abs(v - tile[f"{k}1"]) <= tolerance)
    return near(p["x"], "x") | near(p["y"], "y")


def tile_box(tile_id: Column, sizes: dict[int, int]) -> Column:
    """struct<x0, y0, x1, y1> of a tile id l<lod>_<col>_<row>."""
    number = lambda k: F.regexp_extract(tile_id, r"^l([0-9]+)_(-?[0-9]+)_(-?[0-9]+)", k).cast("long")
    size = F.create_map(*[x for k, v in sizes.items() for x in (F.lit(k).cast("long"), F.lit(float(v)))])[number(1)]
    return F.struct((number(2) * size).alias("x0"), (number(3) * size).alias("y0"), ((number(2) + 1) * size).alias("x1"), ((number(3) + 1) * size).alias("y1"))


# the numpy kernel


def _ring_edges(rings) -> np.ndarray:
    """(n, 4) edges that are not level, from low to high y."""
    parts = [np.hstack([p[:-1], p[1:]]) for p in (G.points(r) for r in rings) if len(p) > 1]
    e = np.vstack(parts) if parts else np.zeros((0, 4))
    e = e[e[:, 1] != e[:, 3]]
    return np.where((e[:, 1] > e[:, 3])[:, None], e[:, [2, 3, 0, 1]], e)


def _crossings(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """y of the points where an edge of a crosses one of b."""
    d, f = a[:, None, 2:] - a[:, None, :2], b[None, :, 2:] - b[None, :, :2]
    o = b[None, :, :2] - a[:, None, :2]
    by = d[..., 0] * f[..., 1] - d[..., 1] * f[..., 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        s, t = (o[..., 0] * f[..., 1] - o[..., 1] * f[..., 0]) / by, (o[..., 0] * d[..., 1] - o[..., 1] * d[..., 0]) / by
        y = a[:, None, 1] + d[..., 1] * s
    return y[(by != 0) & (s >= 0) & (s <= 1) & (t >= 0) & (t <= 1)]


def intersection_area(first, second) -> float:
    """Area that two polygons (lists of rings, even-odd) share. Between neighbouring heights of vertices and crossings all edges keep
    their order, so the shared width is linear there and its middle gives each strip exactly."""
    a, b = _ring_edges(first), _ring_edges(second)
    if not len(a) or not len(b):
        return 0.0
    heights = np.unique(np.concatenate([a[:, 1], a[:, 3], b[:, 1], b[:, 3], _crossings(a, b), _crossings(a, a), _crossings(b, b)]))
    total = 0.0
    for low, high in zip(heights[:-1], heights[1:]):
        y = (low + high) / 2
        at = [np.sort((e[:, 0] + (e[:, 2] - e[:, 0]) * (y - e[:, 1]) / (e[:, 3] - e[:, 1]))[(e[:, 1] < y) & (e[:, 3] > y)]) for e in (a, b)]
        if not len(at[0]) or not len(at[1]):
            continue
        p, q = (x[: len(x) // 2 * 2].reshape(-1, 2) for x in at)
        wide = np.minimum(p[:, None, 1], q[None, :, 1]) - np.maximum(p[:, None, 0], q[None, :, 0])
        total += np.clip(wide, 0, None).sum() * (high - low)
    return float(total)


@F.arrow_udf(T.DoubleType())
def shared_area(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([None if x is None or y is None else intersection_area(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())


def iou(a: Column, b: Column) -> Column:
    """Exact intersection over union of two polygons; 0 where they have no area."""
    both = shared_area(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)
