"""Roads of several sources matched by their lines, and the SQL, which compares all samples with all segments of pairs whose boxes overlap.

Customers are roads of seven to ten points; another source has each of them again, with points that are off by up to a few metres, some from end to start."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartolith.functions import geometry
from cartolith.operators import conflate, lines

from .queries import query, table
from .tables import spread

_ROADS = """i as (select c_custkey i, (c_custkey * 7919 % 5003 * 4)::double x0, (c_custkey * 104729 % 4001 * 4)::double z0 from customer),
f as (select i * 2 id, case when i % 4 = 0 then 'IGN BD TOPO' else 'communal' end source, 'Rue ' || i % 50 as name, ['track', 'path', 'street'][i % 3 + 1] road_class, * from i
 union all select i * 2 + 1, 'osm', case when i % 2 = 0 then 'RUE ' || i % 50 end, ['track', 'path', 'street'][(i + i // 3) % 3 + 1], * from i),
p as (select id, i, j, x0 + j * 30 + case id % 2 when 1 then ((i * 7 + j * 5) % 9 - 4) * 0.6::double else 0 end x,
 z0 + (i * 31 + j * 17) % 23 + case id % 2 when 1 then ((i * 11 + j * 3) % 7 - 3) * (i % 5) * 0.45::double else 0 end z from f, range(0, 10) r(j) where j < 7 + i % 4),
g as (select a.id, a.j, a.x ax, a.z az, b.x bx, b.z bz from p a join p b on a.id = b.id and b.j = a.j + 1),
s as (select id, j * 2 no, x, z from p union all select id, j * 2 + 1, (ax + bx) / 2, (az + bz) / 2 from g)"""
_FAR = "sqrt(pow(s.x - (ax + u * (bx - ax)), 2) + pow(s.z - (az + u * (bz - az)), 2))"


def roads(spark, d):
    """id, kind, source, name, road_class, x, z, parts."""
    i = F.col("c_custkey")
    c = table(spark, d, "customer").select(i.alias("i"), (i * 7919 % 5003 * 4).cast("double").alias("x"), (i * 104729 % 4001 * 4).cast("double").alias("z"), F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"))
    i, off = F.col("i"), F.col("copy") == 1

    def vertex(j):
        x = F.col("x") + j * 30 + F.when(off, ((i * 7 + j * 5) % 9 - 4) * 0.6).otherwise(0.0)
        return F.struct(x.alias("x"), (F.col("z") + (i * 31 + j * 17) % 23 + F.when(off, ((i * 11 + j * 3) % 7 - 3) * (i % 5) * 0.45).otherwise(0.0)).alias("y"))

    line = F.transform(F.sequence(F.lit(0), (i % 4 + 6).cast("int")), vertex)
    classes = F.array(F.lit("track"), F.lit("path"), F.lit("street"))
    name = F.when(~off, F.concat(F.lit("Rue "), i % 50)).when(i % 2 == 0, F.concat(F.lit("RUE "), i % 50))
    road_class = F.get(classes, (F.when(off, i + F.floor(i / 3)).otherwise(i) % 3).cast("int"))
    source = F.when(off, "osm").when(i % 4 == 0, "IGN BD TOPO").otherwise("communal")
    return c.select((i * 2 + F.col("copy")).alias("id"), F.lit("road").alias("kind"), source.alias("source"), name.alias("name"), road_class.alias("road_class"), "x", "z", F.array(F.when(off & (i % 3 == 0), F.reverse(line)).otherwise(line)).alias("parts"))


@query(f"""
with {_ROADS},
b as (select id, min(x) x1, max(x) x2, min(z) z1, max(z) z2 from p group by id),
k as (select f.*, x1, x2, z1, z2 from f join b using (id)),
c as (select a.id a, b.id b from k a join k b on a.id < b.id and a.source <> b.source and a.x1 <= b.x2 and a.x2 >= b.x1 and a.z1 <= b.z2 and a.z2 >= b.z1
 and abs(floor(a.x0 / 100) - floor(b.x0 / 100)) <= 2 and abs(floor(a.z0 / 100) - floor(b.z0 / 100)) <= 2
 where lower(a.name) = lower(b.name) or a.road_class = b.road_class or a.road_class in ('track', 'path') and b.road_class in ('track', 'path') or 'IGN BD TOPO' in (a.source, b.source)),
o as (select a, b, a p, b q from c union all select a, b, b, a from c),
m as (select a, b, p, no, min({_FAR}) far from (select o.*, s.no, s.x, s.z, g.ax, g.az, g.bx, g.bz, greatest(0, least(1, ((s.x - ax) * (bx - ax) + (s.z - az) * (bz - az)) / (pow(bx - ax, 2) + pow(bz - az, 2)))) u
 from o join s on s.id = o.p join g on g.id = o.q) s group by a, b, p, no)
select a, b, round(max(far), 6) far from m group by a, b having max(far) <= 4""")
def road_lines(spark, d):
    """Pairs of roads that are one by their sources, names or classes, and lines at most 4 m apart."""
    found = conflate.conflated_lines(spread(roads(spark, d)), {"road": (4.0, conflate.same_road)})
    return found.select("a", "b", F.round("d", 6).alias("far"))


@query(f"""
with {_ROADS}, q as (select o_orderkey id, (o_orderkey * 6151 % 5003 * 4)::double x, (o_orderkey * 3079 % 4001 * 4)::double z, o_custkey from orders),
d as (select s.id, min({_FAR}) far from (select q.*, g.ax, g.az, g.bx, g.bz, greatest(0, least(1, ((q.x - ax) * (bx - ax) + (q.z - az) * (bz - az)) / (pow(bx - ax, 2) + pow(bz - az, 2)))) u
 from q join g on g.id = q.o_custkey * 2) s group by s.id)
select id, round(far, 6) far from d""")
def order_to_road(spark, d):
    """Each order's distance to the line of its own customer's road."""
    road = roads(spark, d).where("id % 2 = 0").select((F.col("id") / 2).cast("long").alias("o_custkey"), "parts")
    o = F.col("o_orderkey")
    q = table(spark, d, "orders").select(o.alias("id"), "o_custkey", (o * 6151 % 5003 * 4).cast("double").alias("x"), (o * 3079 % 4001 * 4).cast("double").alias("z"))
    return q.join(road, "o_custkey").select("id", F.round(lines.nearest_edge(F.col("x"), F.col("z"), F.col("parts")), 6).alias("far"))


@query(f"""with {_ROADS} select id, round(sum(sqrt(pow(bx - ax, 2) + pow(bz - az, 2))), 6) metres from g group by id""")
def road_lengths(spark, d):
    r = roads(spark, d)
    return r.select("id", F.round(geometry.total(F.transform("parts", geometry.length)), 6).alias("metres"))
