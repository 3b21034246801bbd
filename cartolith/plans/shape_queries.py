"""Queries over polygons and lines around the points of customers and orders, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartolith.functions import geometry, polygons
from cartolith.operators import tiles
from cartolith.plans.tables import spread

from .queries import A_SQL, points_a, query, table


def ring(x0, y0, x1, y1, reverse=False):
    corner = lambda x, y: polygons.point(x.cast("double"), y.cast("double"))
    points = [corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1), corner(x0, y0)]
    return F.array(*(reversed(points) if reverse else points))


def frames(spark, d):
    """A box of each customer with a hole in it: id, x, z, w, h, rings; the hole leaves a margin of 10."""
    x, z, w, h = F.col("x"), F.col("z"), F.col("w"), F.col("h")
    p = points_a(spark, d).select("id", "x", "z", (F.col("id") % 7 * 50 + 100).alias("w"), (F.col("id") % 5 * 40 + 60).alias("h"))
    return spread(p).withColumn("rings", F.array(ring(x, z, x + w, z + h), ring(x + 10, z + 10, x + w - 10, z + h - 10, True)))


FRAME = f"(select id, x, z, id % 7 * 50 + 100 w, id % 5 * 40 + 60 h from {A_SQL})"


@query(f"""
select id, px, pz, px between 0 and w and pz between 0 and h and not (px between 10 and w - 10 and pz between 10 and h - 10) inside from {FRAME}, (values (0, 0), (5, 5), (10, 30), (50, 55), (100, 60), (40, 40), (401, 9)) v(px, pz)""")
def polygon_contains(spark, d):
    probes = F.array(*[F.struct(F.lit(a).alias("px"), F.lit(b).alias("pz")) for a, b in ((0, 0), (5, 5), (10, 30), (50, 55), (100, 60), (40, 40), (401, 9))])
    f = frames(spark, d).select("id", "x", "z", "rings", F.explode(probes).alias("p")).select("id", "x", "z", "rings", "p.*")
    return f.select("id", "px", "pz", polygons.in_polygon((F.col("x") + F.col("px")).cast("double"), (F.col("z") + F.col("pz")).cast("double"), F.col("rings")).alias("inside"))


@query(f"select id, (w * h - (w - 20) * (h - 20))::double area, (x + w / 2)::double cx, (z + h / 2)::double cz, (x + w / 2)::double ax, (z + h / 2)::double az, (x + case when id % 2 = 0 then 0 else 5 end)::double rx from {FRAME}")
def polygon_anchors(spark, d):
    f = frames(spark, d)
    c, a = polygons.centroid(F.col("rings")), polygons.label_anchor(F.col("rings"))
    # an anchor in the hole moves to the first point of the line that the polygon holds
    at = lambda dx, dz: polygons.point((F.col("x") + dx).cast("double"), (F.col("z") + dz).cast("double"))
    repaired = polygons.inside_anchor(at(50, 30), F.when(F.col("id") % 2 == 0, F.array(at(45, 28), at(0, 0))).otherwise(F.array(at(5, 5), at(0, 0))), F.col("rings"))
    return f.select("id", F.round(polygons.area(F.col("rings")), 6).alias("area"), F.round(c["x"], 4).alias("cx"), F.round(c["y"], 4).alias("cz"), F.round(a["x"], 4).alias("ax"), F.round(a["y"], 4).alias("az"), repaired["x"].alias("rx"))


@query(f"""
select id, case when id % 11 = 0 then null else case when id % 3 = 0 then 1 else 2 end end rings, case when id % 11 > 0 then (w * h)::double end exterior, case when id % 11 > 0 and id % 3 > 0 then -((w - 20) * (h - 20))::double end hole, case when id % 11 > 0 then 5 end points from {FRAME}""")
def polygon_repair(spark, d):
    x, z, w, h, k = F.col("x"), F.col("z"), F.col("w"), F.col("h"), F.col("id")
    f = frames(spark, d)
    outer = F.when(k % 2 == 0, ring(x, z, x + w, z + h)).otherwise(ring(x, z, x + w, z + h, True))
    twice = F.flatten(F.transform(outer, lambda p: F.array(p, p)))
    flat = F.transform(outer, lambda p: polygons.point(p["x"], F.lit(0.0)))
    shift = F.when(k % 3 == 0, 10000).otherwise(0)
    hole = ring(x + 10 + shift, z + 10, x + w - 10 + shift, z + h - 10)
    fixed = polygons.repaired(F.array(F.when(k % 11 == 0, flat).otherwise(twice), hole, F.slice(hole, 1, 2)))
    f = f.select("id", fixed.alias("r"))
    side = lambda i: geometry.signed_area(F.get("r", F.lit(i)))
    return f.select("id", F.when(F.col("r").isNotNull(), F.size("r")).alias("rings"), side(0).alias("exterior"), F.when(F.size("r") > 1, side(1)).alias("hole"), F.when(F.col("r").isNotNull(), F.size(F.col("r")[0])).alias("points"))


@query(f"""
select id, case id % 6 when 0 then [] when 1 then ['exterior is not closed', 'hole 1 is not closed'] when 2 then ['exterior repeats a point', 'hole 1 repeats a point'] when 3 then ['hole 1 winds like the exterior'] when 4 then ['hole 1 is outside'] else ['no rings'] end problems from {FRAME}""")
def polygon_problems(spark, d):
    x, z, w, h, k = F.col("x"), F.col("z"), F.col("w"), F.col("h"), F.col("id")
    f = frames(spark, d)
    good = F.col("rings")
    same_way = F.array(good[0], F.reverse(good[1]))
    away = F.array(good[0], ring(x + 10000, z + 10, x + 10000 + w - 20, z + h - 10, True))
    rings = F.when(k % 6 == 0, good).when(k % 6 == 1, F.transform(good, lambda r: F.slice(r, 1, 4))).when(k % 6 == 2, F.transform(good, lambda r: F.concat(F.slice(r, 1, 1), r))).when(k % 6 == 3, same_way).when(k % 6 == 4, away)
    return f.select("id", polygons.problems(rings).alias("problems"))


@query(f"select id, case when w >= h then (x + (w + h) / 2)::double else (x + w)::double end mx, case when w >= h then z::double else (z + (h - w) / 2)::double end mz, (w + h)::double total, (x + w)::double end_x from {FRAME}")
def line_midpoints(spark, d):
    at = lambda dx, dz: polygons.point((F.col("x") + dx).cast("double"), (F.col("z") + dz).cast("double"))
    f = frames(spark, d).withColumn("line", F.array(at(0, 0), at(F.col("w"), 0), at(F.col("w"), F.col("h"))))
    m = polygons.midpoint(F.col("line"))
    return f.select("id", m["x"].alias("mx"), m["y"].alias("mz"), F.element_at(polygons.running(F.col("line")), -1).alias("total"), polygons.at_distance(F.col("line"), F.lit(1e9))["x"].alias("end_x"))


@query(f"""
with f as (select id, floor(x / 2048) * 2048 - 32 x0, floor(x / 2048) * 2048 + 2080 x1, floor(z / 2048) * 2048 - 32 z0, floor(z / 2048) * 2048 + 2080 z1, x, z, id % 7 * 700 - 2000 dx, id % 5 * 900 - 1800 dz from {A_SQL}),
t as (select id, dx, dz, greatest(0.0, case when dx = 0 then 0 else least((x0 - x) / dx, (x1 - x) / dx) end, case when dz = 0 then 0 else least((z0 - z) / dz, (z1 - z) / dz) end) lo, least(1.0, case when dx = 0 then 1 else greatest((x0 - x) / dx, (x1 - x) / dx) end, case when dz = 0 then 1 else greatest((z0 - z) / dz, (z1 - z) / dz) end) hi from f)
select id, case when hi - lo > 1e-10 then 1 else 0 end runs, round(case when hi - lo > 1e-10 then (hi - lo) * sqrt(dx * dx + dz * dz) else 0 end, 4) length from t""")
def line_clips(spark, d):
    k = F.col("id")
    cell = lambda c: F.floor(F.col(c) / 2048) * 2048.0
    p = points_a(spark, d).select("id", "x", "z", F.struct(cell("x").alias("x0"), cell("z").alias("y0"), (cell("x") + 2048).alias("x1"), (cell("z") + 2048).alias("y1")).alias("box"))
    at = lambda dx, dz: polygons.point((F.col("x") + dx).cast("double"), (F.col("z") + dz).cast("double"))
    runs = polygons.clip_line(F.array(at(0, 0), at(k % 7 * 700 - 2000, k % 5 * 900 - 1800)), F.col("box"), F.lit(32.0))
    return p.select("id", runs.alias("r")).select("id", F.size("r").alias("runs"), F.round(geometry.total(F.transform("r", geometry.length)), 4).alias("length"))


@query(f"""
select id, case when id % 3 = 0 then 2 when id % 3 = 1 then 1 else 0 end runs, case when id % 3 = 0 then 20.0 when id % 3 = 1 then w else 0 end::double length, case id % 3 when 2 then 'outside' else 'cut' end placed, case when id % 3 = 2 then 'outside' else 'inside' end short from {FRAME}""")
def line_in_polygon(spark, d):
    k = F.col("id")
    at = lambda dx, dz: polygons.point((F.col("x") + dx).cast("double"), (F.col("z") + dz).cast("double"))
    level = F.when(k % 3 == 0, 30).when(k % 3 == 1, 5).otherwise(-40)
    f = frames(spark, d).withColumn("line", F.array(at(-30, level), at(F.col("w") + 30, level))).withColumn("bit", F.array(at(3, F.when(k % 3 == 2, -40).otherwise(4)), at(6, F.when(k % 3 == 2, -30).otherwise(6))))
    runs = polygons.clip_line_to_polygon(F.col("line"), F.col("rings"))
    return f.select("id", runs.alias("r"), polygons.placed(F.col("line"), F.col("rings")).alias("placed"), polygons.placed(F.col("bit"), F.col("rings")).alias("short")).select(
        "id", F.size("r").alias("runs"), F.round(geometry.total(F.transform("r", geometry.length)), 6).alias("length"), "placed", "short"
    )


@query(f"""
with b as (select id, w, h, id % 9 * 20 sx, id % 4 * 15 sz from {FRAME}),
o as (select *, greatest(0, w - sx) * greatest(0, h - sz) whole, greatest(0, w - 10 - greatest(10, sx)) * greatest(0, h - 10 - greatest(10, sz)) hole from b)
select id, round((whole - hole) / (w * h - (w - 20) * (h - 20) + w * h - (whole - hole)), 6) iou from o""")
def polygon_overlap(spark, d):
    k, x, z = F.col("id"), F.col("x"), F.col("z")
    f = frames(spark, d).withColumn("other", F.array(ring(x + k % 9 * 20, z + k % 4 * 15, x + k % 9 * 20 + F.col("w"), z + k % 4 * 15 + F.col("h"))))
    return f.select("id", F.round(polygons.iou(F.col("rings"), F.col("other")), 6).alias("iou"))


@query(f"""
with p as (select id, x / 80000 + 0.5 lon, z / 111000 + 43.7 lat from {A_SQL})
select id, round(sqrt(pow((lon - 0.5) * 80000, 2) + pow((lat - 43.7) * 111000, 2)), 4) fixed, round(sqrt(pow((lon - 0.5) * 111320 * cos(radians((lat + 43.7) / 2)), 2) + pow((lat - 43.7) * 111320, 2)), 4) flat from p""")
def flat_distances(spark, d):
    p = points_a(spark, d).select("id", (F.col("x") / 80000 + 0.5).alias("lon"), (F.col("z") / 111000 + 43.7).alias("lat"))
    at = (F.col("lon"), F.col("lat"), F.lit(0.5), F.lit(43.7))
    return p.select("id", F.round(polygons.fixed_distance(*at), 4).alias("fixed"), F.round(polygons.flat_distance(*at), 4).alias("flat"))


@query(f"""
select id, floor(x / 2048) * 2048.0 x0, floor(z / 2048) * 2048.0 + 2048 z1, id % 2 = 0 on_edge from {A_SQL}""")
def tile_edges(spark, d):
    cell = lambda c: F.floor(F.col(c) / 2048).cast("string")
    p = points_a(spark, d).select("id", "x", "z", polygons.tile_box(F.concat_ws("_", F.lit("l0"), cell("x"), cell("z")), tiles.SIZES).alias("box"))
    probe = polygons.point(F.when(F.col("id") % 2 == 0, F.col("box.x0")).otherwise(F.col("box.x0") + 7.5), F.col("box.y0") + 9.5)
    return p.select("id", F.col("box.x0").alias("x0"), F.col("box.y1").alias("z1"), polygons.on_tile_edge(probe, F.col("box")).alias("on_edge"))


@query(f"""
select id, lod, case when id % 60 > tol then 3 else 2 end points from {A_SQL}, (values (1, 2), (2, 25)) v(lod, tol)""")
def simplified_lines(spark, d):
    lods = F.array(*[F.struct(F.lit(l).alias("lod"), F.lit(float(t)).alias("tol")) for l, t in ((1, 2), (2, 25))])
    p = spread(points_a(spark, d).select("id")).select("id", F.explode(lods).alias("l"))
    line = F.array(polygons.point(F.lit(0.0), F.lit(0.0)), polygons.point(F.lit(500.0), (F.col("id") % 60).cast("double")), polygons.point(F.lit(1000.0), F.lit(0.0)))
    return p.select("id", F.col("l.lod").alias("lod"), geometry.simplified(line, F.col("l.tol")).alias("line")).select("id", "lod", F.size("line").alias("points"))


@query(f"select id, case when id % 3 = 0 then null else 5.0::double end farthest from {A_SQL}")
def paired_vertices(spark, d):
    at = lambda dx, dz: polygons.point((F.col("x") + dx).cast("double"), (F.col("z") + dz).cast("double"))
    other = F.when(F.col("id") % 3 == 0, F.array(at(0, 0))).otherwise(F.array(at(0, 0), at(13, 24)))
    p = points_a(spark, d).select("id", polygons.paired(F.array(at(0, 0), at(10, 20)), other).alias("v"))
    return p.select("id", F.array_max(F.transform("v", lambda q: F.hypot(q["a"]["x"] - q["b"]["x"], q["a"]["y"] - q["b"]["y"]))).alias("farthest"))


@query(f"""
with b as (select id, x x0, z y0, x + 3000 + (id % 7) * 500 x1, z + 2500 + (id % 5) * 400 y1, id % 2 s from {A_SQL}),
p as (select b.id a, c.id b, greatest(0, least(b.x1, c.x1) - greatest(b.x0, c.x0)) * greatest(0, least(b.y1, c.y1) - greatest(b.y0, c.y0)) i, (b.x1 - b.x0) * (b.y1 - b.y0) + (c.x1 - c.x0) * (c.y1 - c.y0) u from b join b c on b.s = 0 and c.s = 1
 and pow(b.x0 + b.x1 - c.x0 - c.x1, 2) + pow(b.y0 + b.y1 - c.y0 - c.y1, 2) <= 16000000),
r as (select a, b, i / (u - i) iou, row_number() over (partition by a order by i / (u - i) desc, b) n from p where i / (u - i) >= 0.2)
select x.id a, r.b, round(r.iou, 6) iou from b x left join r on r.a = x.id and n = 1 where x.s = 0""")
def parity_matches(spark, d):
    """Each box of one side with the box of the other that it overlaps best, by centres within 2,000; null without one."""
    from cartolith.operators import joins

    k = F.col("id")
    p = points_a(spark, d).select("id", F.struct(F.col("x").cast("double").alias("x0"), F.col("z").cast("double").alias("y0"), (F.col("x") + 3000 + k % 7 * 500).cast("double").alias("x1"), (F.col("z") + 2500 + k % 5 * 400).cast("double").alias("y1")).alias("box"))
    return joins.best_overlap(p.where("id % 2 = 0"), p.where("id % 2 = 1"), 2000, 0.2).select(F.col("l_id").alias("a"), F.col("r_id").alias("b"), F.round("iou", 6).alias("iou"))
