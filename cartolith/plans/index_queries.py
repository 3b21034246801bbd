"""Queries of the search index: routes, streets, distinct records, tiles and establishments, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartolith.functions import survey
from cartolith.operators import index

from .queries import A_SQL, FOLD, points_a, query, table

_CLASSES = ("primary", "secondary", "residential", "path", "ferry")
_SEGMENTS = f"""(select o_orderkey segment_id, case o_orderkey % 5 when 0 then null when 1 then 'D' || (o_custkey % 60) || '; n ' || (o_custkey % 9) when 2 then 'D1124/X9' when 3 then 'e' || (o_custkey % 4) || ',D' || (o_custkey % 60) else 'A62' end ref,
 case o_orderkey % 4 when 0 then null when 1 then 'Rue ' || (o_custkey % 50) when 2 then 'RUE ' || (o_custkey % 50) else 'rue  ' || (o_custkey % 50) end as name, {list(_CLASSES)!r}[(o_orderkey % 5 + 1)::int] road_class,
 o_custkey % 7 commune, (o_orderkey % 400) * 1.0 length, ((o_orderkey * 7919) % 10007)::double x, ((o_orderkey * 104729) % 10009)::double z from orders)"""
_RANK = " ".join(f"when '{k}' then {v}" for k, v in survey.ROAD_RANK.items())
_BOOST = " ".join(f"when '{k}' then {v}" for k, v in survey.ROAD_BOOST.items())


def segments(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda v: v.cast("string")
    ref = F.when(k % 5 == 1, F.concat(F.lit("D"), text(c % 60), F.lit("; n "), text(c % 9))).when(k % 5 == 2, "D1124/X9").when(k % 5 == 3, F.concat(F.lit("e"), text(c % 4), F.lit(",D"), text(c % 60))).when(k % 5 == 4, "A62")
    name = F.when(k % 4 == 1, F.concat(F.lit("Rue "), text(c % 50))).when(k % 4 == 2, F.concat(F.lit("RUE "), text(c % 50))).when(k % 4 == 3, F.concat(F.lit("rue  "), text(c % 50)))
    road = F.get(F.array(*[F.lit(v) for v in _CLASSES]), (k % 5).cast("int"))
    return table(spark, d, "orders").select(k.alias("segment_id"), ref.alias("ref"), name.alias("name"), road.alias("road_class"), (c % 7).alias("commune"), (k % 400).cast("double").alias("length"), ((k * 7919) % 10007).cast("double").alias("x"), ((k * 104729) % 10009).cast("double").alias("z"))


@query(f"""
with s as (select *, unnest(list_distinct(list_filter(list_transform(string_split(regexp_replace(ref, '[;,/]', '|', 'g'), '|'), lambda r: upper(replace(r, ' ', ''))), lambda r: regexp_matches(r, '^(A|N|D|E)[0-9]{{1,4}}[A-Z]?$')))) num from {_SEGMENTS}),
g as (select num, arg_min(road_class, [case road_class {_RANK} else 10 end::varchar || road_class]) rc, sum(length) length, count(distinct commune) communes from (select *, lpad((case road_class {_RANK} else 10 end)::varchar, 2, '0') || road_class k from s) group by num having sum(length) >= 300),
h as (select num, arg_min(road_class, k) rc from (select num, road_class, lpad((case road_class {_RANK} else 10 end)::varchar, 2, '0') || road_class k from s) group by num),
v as (select num, name, row_number() over (partition by num order by count(*) desc, name) r from s where name is not null group by num, name),
l as (select num, list(case when regexp_matches(name, '[a-z]') and regexp_matches(name, '[A-Z]') then regexp_replace(name, '\\s+', ' ', 'g') else 'Rue ' || regexp_extract(name, '[0-9]+') end order by r) names from v where r <= 4 group by num)
select g.num ref, h.rc road_class, g.length::double length, communes, coalesce(names, []) names, case g.num when 'D1124' then ['N124'] else [] end former,
 case when g.num like 'A%' then 220 when g.num like 'N%' or g.num = 'D1124' then 200 when g.num like 'E%' then 180 else 130 end + case h.rc {_BOOST} else 0 end boost from g join h using (num) left join l using (num)""")
def route_merge(spark, d):
    return index.routes(segments(spark, d))


@query(f"""
with s as (select *, {FOLD.format('name')} key, lpad((case road_class {_RANK} else 10 end)::varchar, 2, '0') || road_class k from {_SEGMENTS} where name is not null),
g as (select key, commune, arg_min(road_class, k) road_class, sum(length)::double length, (min(x) + max(x)) / 2 mx, (min(z) + max(z)) / 2 mz from s group by 1, 2),
n as (select key, commune, name, row_number() over (partition by key, commune order by count(*) + case when regexp_matches(name, '[a-z]') then 0.5 else 0 end desc, name) r from s group by 1, 2, 3),
m as (select s.key, s.commune, segment_id, row_number() over (partition by s.key, s.commune order by sqrt(pow(x - mx, 2) + pow(z - mz, 2)) - least(s.length, 200) * 0.05, segment_id) r from s join g using (key, commune))
select g.key, g.commune, 'Rue ' || regexp_extract(n.name, '[0-9]+') as name, road_class, g.length, segment_id, (30 + case road_class {_BOOST} else 0 end + least(20, floor(log2(greatest(1.0, g.length / 50)) * 3 + 0.5)))::bigint boost
from g join n on n.r = 1 and n.key = g.key and n.commune = g.commune join m on m.r = 1 and m.key = g.key and m.commune = g.commune""")
def street_records(spark, d):
    return index.streets(segments(spark, d))


_RECORDS = """(select c_custkey record_id, case c_custkey % 4 when 0 then 'Le Café ' when 1 then 'CAFE ' when 2 then 'Café ' else 'cafe-' end || (c_custkey % 40) as name, ['poi', 'business', 'place', 'address'][(c_custkey // 40 % 4 + 1)::int] kind,
 case when c_custkey % 3 = 0 then 'village' else 'park' end category, ((c_custkey * 7919) % 6007)::double x, ((c_custkey * 104729) % 6011)::double z, case when c_custkey % 5 = 0 then (c_custkey % 4000)::double end reach, c_custkey % 50 boost, c_custkey % 6 richness from customer)"""
_RADIUS = "case when a.kind = 'place' and b.kind = 'place' then 1500.0 else greatest(150.0, least(3000.0, coalesce(a.reach, 0)), least(3000.0, coalesce(b.reach, 0))) end"


@query(f"""
with recursive d as (select *, 'cafe ' || (record_id % 40) key, row_number() over (partition by record_id % 40 order by richness desc, boost desc, record_id) turn from {_RECORDS} where kind <> 'address'),
p as (select a.key, a.turn e, b.turn l from d a join d b on a.key = b.key and a.turn < b.turn and ((a.kind = 'place') = (b.kind = 'place') or not (a.kind = 'place' and a.category = 'village' or b.kind = 'place' and b.category = 'village')) and sqrt(pow(a.x - b.x, 2) + pow(a.z - b.z, 2)) <= {_RADIUS}),
n as materialized (select d.key, d.turn, coalesce((select list(e order by e) from p where p.key = d.key and p.l = d.turn), []) es from d),
r(key, turn, kept, twin) as (select key, 0::bigint, []::bigint[], null::bigint from (select distinct key from d)
 union all select r.key, r.turn + 1, case when len(list_filter(n.es, lambda q: list_contains(r.kept, q))) = 0 then list_append(r.kept, n.turn) else r.kept end, list_filter(n.es, lambda q: list_contains(r.kept, q))[1] from r join n on n.key = r.key and n.turn = r.turn + 1),
h as (select d.*, coalesce(r.twin, d.turn) home from d join r on r.key = d.key and r.turn = d.turn),
q as (select *, case when name like '%é%' then 2 else 0 end + case when regexp_matches(name, '[a-z]') and regexp_matches(name, '[A-Z]') then 1 else 0 end + case when contains(name, '-') then 1 else 0 end - case when regexp_matches(name, '[a-z]') then 0 else 2 end g from h),
m as (select key, home, arg_min(record_id, turn) record_id, arg_min(kind, turn) kind, arg_min(category, turn) category, arg_min(x, turn) x, arg_min(z, turn) z, arg_min(name, (10 - g) * 100000 + turn) as name, max(boost) boost, list_sort(list(distinct name)) s from q group by 1, 2)
select record_id, kind, category, x, z, name, boost, list_filter(s, lambda v: v <> name) aliases from m union all select record_id, kind, category, x, z, name, boost, [] from {_RECORDS} where kind = 'address'""")
def distinct_records(spark, d):
    k = F.col("c_custkey")
    text = lambda v: v.cast("string")
    prefix = F.when(k % 4 == 0, "Le Café ").when(k % 4 == 1, "CAFE ").when(k % 4 == 2, "Café ").otherwise("cafe-")
    kind = F.get(F.array(*[F.lit(v) for v in ("poi", "business", "place", "address")]), F.expr("cast(c_custkey div 40 % 4 as int)"))
    r = table(spark, d, "customer").select(
        k.alias("record_id"), F.concat(prefix, text(k % 40)).alias("name"), kind.alias("kind"), F.when(k % 3 == 0, "village").otherwise("park").alias("category"), ((k * 7919) % 6007).cast("double").alias("x"),
        ((k * 104729) % 6011).cast("double").alias("z"), F.when(k % 5 == 0, (k % 4000).cast("double")).alias("reach"), (k % 50).alias("boost"), (k % 6).alias("richness"),
    )
    return index.distinct_records(r)


_TILES = "(select distinct 'l0_' || (c_custkey % 41) || '_' || (c_custkey % 43) tile_id, (c_custkey % 41) * 2048.0 x0, (c_custkey % 43) * 2048.0 z0, (c_custkey % 41) * 2048.0 + 2048 x1, (c_custkey % 43) * 2048.0 + 2048 z1 from customer)"


def lod0(spark, d):
    a, b = F.col("c_custkey") % 41, F.col("c_custkey") % 43
    t = table(spark, d, "customer").select(F.concat_ws("_", F.lit("l0"), a.cast("string"), b.cast("string")).alias("tile_id"), (a * F.lit(2048.0)).alias("x0"), (b * F.lit(2048.0)).alias("z0")).distinct()
    return t.withColumn("x1", F.col("x0") + 2048).withColumn("z1", F.col("z0") + 2048)


@query(f"""
with t as (select * from {_TILES}), f as (select o_orderkey feature_id, ((o_orderkey * 7919) % 83968)::double x, ((o_orderkey * 104729) % 88064)::double z from orders),
l as (select distinct 'l0_' || (o_custkey % 41) || '_' || (o_custkey % 43) tile_id, o_orderkey feature_id from orders where o_orderkey % 3 = 0 union select distinct 'l0_' || floor(((o_orderkey * 7919) % 83968) / 2048)::bigint || '_' || floor(((o_orderkey * 104729) % 88064) / 2048)::bigint, o_orderkey from orders where o_orderkey % 6 = 0),
k as (select feature_id, tile_id, row_number() over (partition by feature_id order by case when x between x0 and x1 and z between z0 and z1 then 0 else 1 end, tile_id) r from f join l using (feature_id) join t using (tile_id))
select feature_id, tile_id from k where r = 1 union all select feature_id, min(tile_id) from f join t on x between x0 and x1 and z between z0 and z1 where feature_id not in (select feature_id from k) group by 1""")
def feature_tiles(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    name = lambda a, b: F.concat_ws("_", F.lit("l0"), a.cast("string"), b.cast("string"))
    o = table(spark, d, "orders")
    f = o.select(k.alias("feature_id"), ((k * 7919) % 83968).cast("double").alias("x"), ((k * 104729) % 88064).cast("double").alias("z"))
    listed = o.where("o_orderkey % 3 = 0").select(name(c % 41, c % 43).alias("tile_id"), k.alias("feature_id"))
    own = f.where("feature_id % 6 = 0").select(name(F.floor(F.col("x") / 2048), F.floor(F.col("z") / 2048)).alias("tile_id"), "feature_id")
    return index.tile_of(f, listed.union(own).distinct(), lod0(spark, d))


@query(f"""
with t as (select * from {_TILES}), c as (select s_suppkey commune_id, ((s_suppkey * 7919) % 83968)::double x, ((s_suppkey * 104729) % 88064)::double z, s_nationkey % 5 s from supplier),
h as (select commune_id, s, min(tile_id) tile_id from c join t on x between x0 and x1 and z between z0 and z1 group by 1, 2)
select tile_id, arg_max(commune_id, s * 1000000 - commune_id) commune_id from h group by 1""")
def commune_tiles(spark, d):
    k = F.col("s_suppkey")
    c = table(spark, d, "supplier").select(k.alias("commune_id"), ((k * 7919) % 83968).cast("double").alias("x"), ((k * 104729) % 88064).cast("double").alias("z"), (F.col("s_nationkey") % 5).alias("s"))
    return index.host_tiles(c, lod0(spark, d), 2048, F.col("s"))


@query("""
select n_nationkey commune_id, coalesce(x, n_nationkey * 10)::double x, coalesce(z, n_nationkey * 20)::double z from nation left join (select s_nationkey k, min(s_suppkey) x, max(s_suppkey) z from supplier where s_nationkey % 3 > 0 group by 1) on k = n_nationkey""")
def commune_anchors(spark, d):
    n = F.col("n_nationkey")
    communes = table(spark, d, "nation").select(n.alias("commune_id"), (n * 10).cast("double").alias("x"), (n * 20).cast("double").alias("z"))
    chief = table(spark, d, "supplier").where("s_nationkey % 3 > 0").groupBy(F.col("s_nationkey").alias("commune_id")).agg(F.min("s_suppkey").cast("double").alias("x"), F.max("s_suppkey").cast("double").alias("z"))
    return index.anchored(communes, chief)


@query(f"""
with p as (select o_orderkey point_id, (o_orderkey * 6151) % 100003 - 50000 x, (o_orderkey * 3079) % 85009 - 42500 z from orders),
j as (select point_id, id address_id, pow(p.x - a.x, 2) + pow(p.z - a.z, 2) d2 from p join {A_SQL} a on abs(p.x - a.x) <= 900 and abs(p.z - a.z) <= 900)
select point_id, address_id, sqrt(d2) d from (select *, row_number() over (partition by point_id order by d2, address_id) r from j where d2 <= 810000) where r = 1""")
def nearest_address(spark, d):
    k = F.col("o_orderkey")
    p = table(spark, d, "orders").select(k.alias("point_id"), ((k * 6151) % 100003 - 50000).alias("x"), ((k * 3079) % 85009 - 42500).alias("z"))
    return index.nearest(p, points_a(spark, d).select(F.col("id").alias("address_id"), "x", "z"), 900)


@query("""
select c_custkey, not (c_custkey % 6 = 0) and not (c_custkey % 5 = 0 and c_custkey % 2 = 0) keep, floor(c_acctbal * 10 + 0.5) / 10 score, floor(c_acctbal * 3.3337 * 100 + 0.5) / 100 metres from customer""")
def worthwhile_records(spark, d):
    k = F.col("c_custkey")
    source = F.when(k % 6 == 0, "ign-bdtopo:point_de_repere/1").otherwise("ign-bdtopo:x/2")
    commune = F.when(k % 2 == 0, "Saint-Clar").otherwise("Auch")
    keep = index.worth_a_record(source, F.when(k % 5 == 0, "settlement").otherwise("hamlet"), F.lit("SAINT CLAR"), commune)
    return index.shown_results(table(spark, d, "customer").select("c_custkey", keep.alias("keep"), F.col("c_acctbal").cast("double").alias("score"), (F.col("c_acctbal").cast("double") * 3.3337).alias("metres")))


@query("""
with s as (select c_custkey k, case c_custkey % 4 when 0 then null when 1 then 'F' else 'A' end st, case when c_custkey % 5 = 0 then 'P' end di, case when c_custkey % 3 = 0 then 'Sign' else ' ' end sg, case when c_custkey % 7 = 0 then 'O' else 'N' end em, case when c_custkey % 2 = 0 then '1000' else '5710' end lf from customer)
select k c_custkey, coalesce(st = 'A', true) and di is null and (lf <> '1000' or sg = 'Sign' or em = 'O') publishable,
 case when k % 9 > 0 then 'sirene:' || k end source_id, case when k % 9 > 0 then case when k % 3 = 0 then 'Sign' else 'Bar ' || k end end trading_name, case when k % 9 > 0 and k % 4 > 0 then k / 100.0 end::double lon from s""")
def establishment_fields(spark, d):
    k = F.col("c_custkey")
    sign = F.when(k % 3 == 0, "Sign").otherwise(" ")
    local = F.struct(F.when(k % 4 == 1, "F").when(k % 4 > 1, "A").alias("status"), F.lit(None).cast("string").alias("diffusion"), sign.alias("sign"), F.lit(None).cast("string").alias("trade_name"), F.when(k % 7 == 0, "O").otherwise("N").alias("employer"))
    company = F.struct(F.when(k % 5 == 0, "P").alias("diffusion"), F.when(k % 2 == 0, "1000").otherwise("5710").alias("legal_form"))
    none = F.lit(None).cast("string")
    site = F.struct(F.when(k % 9 > 0, k.cast("string")).alias("siret"), none.alias("naf"), sign.alias("sign"), none.alias("trade_name"), F.when(k % 4 > 0, (k / 100).cast("string")).otherwise("?").alias("lon"), F.lit("43.6").alias("lat"))
    seat = F.struct(F.lit("0").alias("siret"), none.alias("naf"), none.alias("sign"), none.alias("trade_name"), none.alias("lon"), none.alias("lat"))
    api = F.struct(none.alias("siret"), none.alias("siren"), F.concat(F.lit("SARL BAR "), k.cast("string")).alias("name"), none.alias("naf"), seat.alias("seat"), F.array(site).alias("matching"))
    c = table(spark, d, "customer").select("c_custkey", local.alias("l"), company.alias("c"), index.establishment(api).alias("e"))
    return c.select("c_custkey", index.publishable(F.col("l"), F.col("c")).alias("publishable"), "e.source_id", "e.trading_name", "e.lon")


@query("""
select o_orderkey, case when o_orderkey % 7 = 0 then null when o_orderkey % 5 = 0 then null else trim((o_orderkey % 90) || case when o_orderkey % 3 = 0 then 'bis' else '' end || ' ' || case when o_orderkey % 4 = 0 then 'unknown street' else 'Avenue du ' || o_custkey end) end as label,
 case when o_orderkey % 7 = 0 then 'missing_id' when o_orderkey % 5 = 0 then 'outside_boundary' end reason, o_orderkey % 3 > 0 and o_orderkey % 2 = 0 elevation from orders""")
def address_records(spark, d):
    k = F.col("o_orderkey")
    r = index.address_record(F.when(k % 7 > 0, "id"), (k % 90).cast("string"), F.when(k % 3 == 0, "bis"), F.when(k % 4 == 0, " ").otherwise(F.concat(F.lit("av. du "), F.col("o_custkey").cast("string"))), k % 5 > 0)
    box = F.when(k % 2 == 0, F.when(k % 4 == 0, F.lit(None).cast("struct<x0:double,z0:double,x1:double,z1:double>")).otherwise(F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("z0"), F.lit(1.0).alias("x1"), F.lit(1.0).alias("z1")))).otherwise(F.struct(F.lit(9.0).alias("x0"), F.lit(9.0).alias("z0"), F.lit(9.5).alias("x1"), F.lit(9.5).alias("z1")))
    layer = F.when(k % 3 == 0, "buildings").otherwise("ELEVATION.grid")
    return table(spark, d, "orders").select("o_orderkey", r.alias("r"), index.applicable(layer, F.lit(None).cast("string"), box, (0.5, 0.5, 2.0, 2.0)).alias("elevation")).select("o_orderkey", "r.label", "r.reason", "elevation")


@query("""
with n as (select distinct p_name ph, 'n' || (p_size % 3) c from part), t as (select distinct lower(p_type) ph, 'm' || (p_size % 4) c from part),
m as (select p_partkey id, c from part join n on ph = p_name union select p_partkey, c from part join t on ph = lower(p_type))
select id query_id, list_sort(list(distinct c)) categories, true pure from m group by 1""")
def category_intents(spark, d):
    """Names and types of parts are the phrases, numbers of their sizes the categories; each query is a name and a type."""
    from cartolith.operators import intents

    p = table(spark, d, "part")
    number = lambda letter, n: F.concat(F.lit(letter), (F.col("p_size") % n).cast("string")).alias("category")
    phrases = p.select(F.col("p_name").alias("phrase"), number("n", 3)).unionByName(p.select(F.lower("p_type").alias("phrase"), number("m", 4)))
    tokens = F.concat(F.split("p_name", " "), F.array(F.lower("p_type")))
    found = intents.intents(p.select(F.col("p_partkey").alias("query_id"), tokens.alias("tokens")), phrases, prefix=False)
    return found.select("query_id", F.array_sort(F.transform("found", lambda f: f["category"])).alias("categories"), intents.pure(F.col("found"), F.col("tokens")).alias("pure"))
