"""Queries of conflation and merges over customers, suppliers, parts and orders, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartolith.functions import osm_tags, survey, text
from cartolith.operators import conflate

from .queries import query, table

# four copies of each customer's place, a few metres apart, in the feeds of four sources and as five kinds
_SOURCES = ("osm", "sirene", "ban", "IGN BD TOPO")
_FEATURE_KINDS = ("business", "address", "building", "road", "water")
FEATURES_SQL = f"""(select c_custkey * 4 + s id, {list(_FEATURE_KINDS)!r}[(c_custkey % 5 + 1)::int] kind, {list(_SOURCES)!r}[(s + 1)::int] source,
 ((c_custkey // 2 * 7919) % 20011 + s * (c_custkey % 7) * 3)::double x, ((c_custkey // 2 * 104729) % 20021 + s * (c_custkey % 3) * 4)::double z,
 case when c_custkey % 4 = 0 then (c_custkey // 3)::varchar end siret, case when c_custkey % 8 < 5 then c_custkey::varchar end register_id, case when c_custkey % 9 = 0 then '' else 'Café ' || (c_custkey // 2) end as name,
 case c_custkey % 3 when 0 then '12 rue ' || c_mktsegment when 1 then 'Rue ' || c_mktsegment end address, case c_custkey % 4 when 0 then 'track' when 1 then 'path' when 2 then 'primary' end road_class,
 case c_custkey // 5 % 4 when 0 then 'river' when 1 then 'river bank' when 2 then 'lake' end water_type, c_custkey // 3 % 2 = 0 area, 10.0 + c_custkey % 4 side from customer, range(0, 4) t(s))"""


def features(spark, d):
    k, s = F.col("c_custkey"), F.col("s")
    pick = lambda values, i: F.get(F.array(*[F.lit(v) for v in values]), i.cast("int"))
    half = F.expr("c_custkey div 2")
    c = table(spark, d, "customer").withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return c.select(
        (k * 4 + s).alias("id"), pick(_FEATURE_KINDS, k % 5).alias("kind"), pick(_SOURCES, s).alias("source"),
        ((half * 7919) % 20011 + s * (k % 7) * 3).cast("double").alias("x"), ((half * 104729) % 20021 + s * (k % 3) * 4).cast("double").alias("z"),
        F.when(k % 4 == 0, F.expr("c_custkey div 3").cast("string")).alias("siret"), F.when(k % 8 < 5, k.cast("string")).alias("register_id"),
        F.when(k % 9 == 0, "").otherwise(F.concat(F.lit("Café "), half.cast("string"))).alias("name"),
        F.when(k % 3 == 0, F.concat(F.lit("12 rue "), "c_mktsegment")).when(k % 3 == 1, F.concat(F.lit("Rue "), "c_mktsegment")).alias("address"),
        F.when(k % 4 == 0, "track").when(k % 4 == 1, "path").when(k % 4 == 2, "primary").alias("road_class"),
        F.when(F.expr("c_custkey div 5 % 4 = 0"), "river").when(F.expr("c_custkey div 5 % 4 = 1"), "river bank").when(F.expr("c_custkey div 5 % 4 = 2"), "lake").alias("water_type"),
        F.expr("c_custkey div 3 % 2 = 0").alias("area"), (F.lit(10.0) + k % 4).alias("side"),
    )


def _square_iou(l, r):
    """Overlap of two upright squares around the anchors."""
    half = lambda f, c, sign: f(c) + F.lit(sign) * f("side") / 2
    along = lambda c: F.greatest(F.lit(0.0), F.least(half(l, c, 1), half(r, c, 1)) - F.greatest(half(l, c, -1), half(r, c, -1)))
    both = along("x") * along("z")
    return both / (l("side") * l("side") + r("side") * r("side") - both)


RULES = {
    "business": conflate.same_business, "address": conflate.same_address, "building": lambda l, r, d: conflate.same_building(l, r, d, _square_iou(l, r)),
    "road": lambda l, r, d: conflate.same_road(l, r, d), "water": lambda l, r, d: conflate.same_water(l, r, d, _square_iou(l, r), d),
}

_ALONG = lambda c: f"greatest(0, least(a.{c} + a.side / 2, b.{c} + b.side / 2) - greatest(a.{c} - a.side / 2, b.{c} - b.side / 2))"
_BOTH = f"({_ALONG('x')} * {_ALONG('z')})"
_IOU = f"({_BOTH} / (a.side * a.side + b.side * b.side - {_BOTH}))"
PAIRS_SQL = f"""f as materialized (select *, strip_accents(lower(name)) n, regexp_replace(lower(coalesce(address, '')), '[^a-z0-9]+', ' ', 'g') ad from {FEATURES_SQL}),
p as materialized (select a.id a, b.id b from f a join f b on a.kind = b.kind and a.id < b.id and a.source <> b.source and abs(floor(a.x / 100) - floor(b.x / 100)) <= 2 and abs(floor(a.z / 100) - floor(b.z / 100)) <= 2
 where case a.kind
 when 'business' then case when a.siret is not null and b.siret is not null then a.siret = b.siret else a.siret is null and b.siret is null and a.n <> '' and a.n = b.n and a.ad <> '' and b.ad <> ''
  and (contains(a.ad, b.ad) or contains(b.ad, a.ad) or len(list_filter(string_split(a.ad, ' '), lambda w: len(w) > 2 and list_contains(string_split(b.ad, ' '), w))) > 0) and sqrt(pow(a.x - b.x, 2) + pow(a.z - b.z, 2)) <= 150 end
 when 'address' then case when a.register_id is not null and b.register_id is not null then a.register_id = b.register_id else a.n = b.n and sqrt(pow(a.x - b.x, 2) + pow(a.z - b.z, 2)) <= 15 end
 when 'building' then {_IOU} >= 0.35 and sqrt(pow(a.x - b.x, 2) + pow(a.z - b.z, 2)) <= 20
 when 'road' then (a.n <> '' and a.n = b.n or a.road_class = b.road_class or a.road_class in ('track', 'path') and b.road_class in ('track', 'path') or 'IGN BD TOPO' in (a.source, b.source)) and sqrt(pow(a.x - b.x, 2) + pow(a.z - b.z, 2)) <= 4
 else a.area = b.area and (a.water_type is null or b.water_type is null or a.water_type = b.water_type or a.water_type like 'river%' and b.water_type like 'river%')
  and case when a.area then {_IOU} >= 0.25 and sqrt(pow(a.x - b.x, 2) + pow(a.z - b.z, 2)) <= 50 else sqrt(pow(a.x - b.x, 2) + pow(a.z - b.z, 2)) <= 10 end end)"""


@query(f"with {PAIRS_SQL} select a, b from p")
def conflation_pairs(spark, d):
    return conflate.conflated(features(spark, d), RULES, blocks=conflate.BLOCKS)


@query(f"""
with recursive {PAIRS_SQL}, e as (select a x, b y from p union select b, a from p), r(x, y) as (select x, y from e union select r.x, e.y from r join e on r.y = e.x),
g as (select f.id, any_value(f.source) source, any_value(f.siret) siret, least(f.id, coalesce(min(r.y), f.id)) g from f left join r on r.x = f.id group by f.id),
w as (select *, case source when 'IGN BD TOPO' then 100 when 'sirene' then 80 when 'ban' then 70 else 60 end::bigint p from g)
select g group_id, arg_max(id, p * 1000000000 - id) winner, count(*) members, list_sort(list(distinct source || '|' || coalesce(siret, ''))) sources from w group by g""")
def conflation_groups(spark, d):
    f = features(spark, d)
    return conflate.merged(f, conflate.conflated(f, RULES, blocks=conflate.BLOCKS), survey.mapped(F.col("source"), survey.SOURCE_WEIGHT, 0), F.concat_ws("|", "source", F.coalesce("siret", F.lit(""))))


_PLACES = "(select s_suppkey place_id, 'Bar ' || ['du Gers', 'Gers', 'Auch', 'du Gers Auch'][(s_suppkey % 4 + 1)::int] as name, ((s_suppkey * 7919) % 2003)::double x, ((s_suppkey * 104729) % 2011)::double z from supplier)"
_SHOPS = "(select c_custkey business_id, 'SARL Bar ' || ['Gers', 'Auch', 'Gers Auch Sud'][(c_custkey % 3 + 1)::int] as name, case when c_custkey % 2 = 0 then 'Bar du Gers' end brand, ((c_custkey * 6151) % 2003)::double x, ((c_custkey * 3079) % 2011)::double z from customer where c_nationkey < 13)"


@query(f"""
with recursive w as (select *, list_filter(string_split(lower(name), ' '), lambda t: t not in ('du', 'sarl')) t, case when brand is not null then ['bar', 'gers'] else [] end bt from (select business_id, name, brand, x, z from {_SHOPS})),
v as (select *, list_filter(string_split(lower(name), ' '), lambda t: t not in ('du', 'sarl')) t from {_PLACES}),
sim as (select business_id, place_id, sqrt(pow(w.x - v.x, 2) + pow(w.z - v.z, 2)) d, lower(w.name) = lower(v.name) same,
 greatest(case when len(v.t) <= len(w.t) then len(list_filter(v.t, lambda q: list_contains(w.t, q))) / len(v.t) else len(list_filter(w.t, lambda q: list_contains(v.t, q))) / len(w.t) end,
 case when len(w.bt) = 0 then 0 when len(v.t) <= len(w.bt) then len(list_filter(v.t, lambda q: list_contains(w.bt, q))) / len(v.t) else len(list_filter(w.bt, lambda q: list_contains(v.t, q))) / len(w.bt) end) score from w, v),
c as materialized (select *, row_number() over (order by business_id, score desc, d, place_id) n from sim where score >= 0.8 and d <= case when same then 300 else 150 end),
r(n, bs, ps, b, p, s, d) as (select 0::bigint, []::bigint[], []::bigint[], null::bigint, null::bigint, null::double, null::double
 union all select c.n, case when list_contains(r.bs, c.business_id) or list_contains(r.ps, c.place_id) then r.bs else list_append(r.bs, c.business_id) end, case when list_contains(r.bs, c.business_id) or list_contains(r.ps, c.place_id) then r.ps else list_append(r.ps, c.place_id) end,
 case when not (list_contains(r.bs, c.business_id) or list_contains(r.ps, c.place_id)) then c.business_id end, c.place_id, c.score, c.d from r join c on c.n = r.n + 1)
select b business_id, p place_id, s score, d from r where b is not null""")
def establishment_places(spark, d):
    pick = lambda values, i: F.get(F.array(*[F.lit(v) for v in values]), i.cast("int"))
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    places = table(spark, d, "supplier").select(s.alias("place_id"), F.concat(F.lit("Bar "), pick(("du Gers", "Gers", "Auch", "du Gers Auch"), s % 4)).alias("name"), ((s * 7919) % 2003).cast("double").alias("x"), ((s * 104729) % 2011).cast("double").alias("z"))
    shops = table(spark, d, "customer").where("c_nationkey < 13").select(c.alias("business_id"), F.concat(F.lit("SARL Bar "), pick(("Gers", "Auch", "Gers Auch Sud"), c % 3)).alias("name"), F.when(c % 2 == 0, "Bar du Gers").alias("brand"), ((c * 6151) % 2003).cast("double").alias("x"), ((c * 3079) % 2011).cast("double").alias("z"))
    return conflate.establishments(places, shops)


_KNOWN = "(select c_custkey known_id, case when c_custkey % 3 > 0 then 'S' || (c_custkey % 400) end siret, 'Café ' || (c_custkey % 40) as name, '12 Rue ' || c_mktsegment address, ((c_custkey * 7919) % 401)::double x, ((c_custkey * 104729) % 409)::double z from customer)"
_ROWS = "(select o_orderkey row_id, case when o_orderkey % 2 = 0 then 'S' || (o_custkey % 900) end siret, 'cafe ' || (o_custkey % 50) as name, case o_orderkey % 3 when 0 then 'rue building' when 1 then 'BUILDING' end address, ((o_orderkey * 6151) % 401)::double x, ((o_orderkey * 3079) % 409)::double z from orders)"


def known_places(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("known_id"), F.when(k % 3 > 0, F.concat(F.lit("S"), (k % 400).cast("string"))).alias("siret"), F.concat(F.lit("Café "), (k % 40).cast("string")).alias("name"), F.concat(F.lit("12 Rue "), "c_mktsegment").alias("address"), ((k * 7919) % 401).cast("double").alias("x"), ((k * 104729) % 409).cast("double").alias("z"))


def feed_rows(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, d, "orders").select(k.alias("row_id"), F.when(k % 2 == 0, F.concat(F.lit("S"), (c % 900).cast("string"))).alias("siret"), F.concat(F.lit("cafe "), (c % 50).cast("string")).alias("name"), F.when(k % 3 == 0, "rue building").when(k % 3 == 1, "BUILDING").alias("address"), ((k * 6151) % 401).cast("double").alias("x"), ((k * 3079) % 409).cast("double").alias("z"))


@query(f"""
with k as (select * from {_KNOWN}), r as (select * from {_ROWS}), n as (select row_id, min(known_id) known_id from r join k on r.siret = k.siret group by 1)
select row_id, known_id from n union all
select row_id, min(known_id) from r join k on r.siret is null and k.siret is null and r.name = strip_accents(lower(k.name)) and r.address is not null
 and (lower(k.address) like '%' || lower(r.address) || '%' or r.address = 'rue building') and sqrt(pow(r.x - k.x, 2) + pow(r.z - k.z, 2)) <= 150 group by 1""")
def establishment_match(spark, d):
    return conflate.registered_or_near(feed_rows(spark, d), known_places(spark, d))


@query(f"select row_id page_id, min(known_id) known_id from {_ROWS} r join {_KNOWN} k on r.name = strip_accents(lower(k.name)) and (row_id % 5 = 0 or sqrt(pow(r.x - k.x, 2) + pow(r.z - k.z, 2)) <= 150) group by 1")
def web_enrichment(spark, d):
    r = feed_rows(spark, d)
    placed = F.col("row_id") % 5 > 0
    return conflate.enriched(r.select(F.col("row_id").alias("page_id"), "name", F.when(placed, F.col("x")).alias("x"), F.when(placed, F.col("z")).alias("z")), known_places(spark, d))


@query("""
with r as (select o_custkey, o_orderkey, ['official-website', 'sirene', 'annuaire-entreprises', 'osm', 'pagesjaunes'][(o_orderkey % 5 + 1)::int] source, case when o_orderkey % 3 > 0 then 'p' || o_orderkey end phone, case when o_orderkey % 4 > 0 then 'w' || o_orderkey else '' end website from orders),
p as (select *, case source when 'official-website' then 90 when 'sirene' then 80 when 'annuaire-entreprises' then 75 when 'osm' then 60 else 40 end::bigint * 1000000000 - o_orderkey p from r)
select o_custkey, arg_max(phone, p) filter (where phone is not null) phone, arg_max(source, p) filter (where phone is not null) phone_source, arg_max(website, p) filter (where website <> '') website,
 arg_max(source, p) filter (where website <> '') website_source, list_sort(list(distinct source)) sources from p group by 1""")
def establishment_merge(spark, d):
    k = F.col("o_orderkey")
    source = F.get(F.array(*[F.lit(v) for v in ("official-website", "sirene", "annuaire-entreprises", "osm", "pagesjaunes")]), (k % 5).cast("int"))
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", source.alias("source"), F.when(k % 3 > 0, F.concat(F.lit("p"), k.cast("string"))).alias("phone"), F.when(k % 4 > 0, F.concat(F.lit("w"), k.cast("string"))).otherwise("").alias("website"))
    rank = F.when(F.col("source") == "official-website", 90).when(F.col("source") == "sirene", 80).when(F.col("source") == "annuaire-entreprises", 75).when(F.col("source") == "osm", 60).otherwise(40)
    return conflate.field_merge(rows, "o_custkey", ["phone", "website"], rank, F.col("o_orderkey"), "source")


@query("""
with s as (select s_nationkey postcode, 'rue ' || (s_suppkey % 30) f, arg_max('Rue ' || (s_suppkey % 30) || case when s_suppkey % 2 = 0 then ' ' else '' end, s_suppkey) sp from supplier group by 1, 2)
select c_custkey, coalesce(sp, 'RUE ' || (c_custkey % 60)) shown from customer left join s on postcode = c_nationkey and f = 'rue ' || (c_custkey % 60)""")
def street_spelling(spark, d):
    k = F.col("s_suppkey")
    spellings = table(spark, d, "supplier").select(F.col("s_nationkey").alias("postcode"), F.concat(F.lit("Rue "), (k % 30).cast("string"), F.when(k % 2 == 0, " ").otherwise("")).alias("street"), k.alias("row_no"))
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("postcode"), F.concat(F.lit("RUE "), (F.col("c_custkey") % 60).cast("string")).alias("street"))
    return conflate.repaired_streets(rows, spellings).select("c_custkey", "shown")


@query("""
with t as (select l_partkey id, l_orderkey * 10 + l_linenumber seq, unnest([{'k': 'flag', 'v': l_returnflag}, {'k': 'mode' || (l_linenumber % 3), 'v': l_linestatus}]) t from lineitem),
o as (select id, t.k k, (list(t.v order by seq desc, t.v desc))[1] v from t group by 1, 2)
select id, list_sort(list(k || '=' || v)) tags from o group by 1""")
def overlaid_elements(spark, d):
    tags = F.create_map(F.lit("flag"), F.col("l_returnflag"), F.concat(F.lit("mode"), (F.col("l_linenumber") % 3).cast("string")), F.col("l_linestatus"))
    e = table(spark, d, "lineitem").select(F.lit("node").alias("type"), F.col("l_partkey").alias("id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), tags.alias("tags"))
    pairs = F.transform(F.map_entries("tags"), lambda t: F.concat_ws("=", t["key"], t["value"]))
    return conflate.overlaid_tags(e).select("id", F.array_sort(pairs).alias("tags"))


@query("""
with e as (select 'way/' || o_orderkey id from orders where o_orderkey % 3 = 0 union select 'relation/' || o_orderkey from orders where o_orderkey % 7 = 0)
select ['n', 'w', 'a'][(c_custkey % 3 + 1)::int] || c_custkey source_id from customer where not (c_custkey % 3 = 1 and 'way/' || c_custkey in (select id from e) or c_custkey % 3 = 2 and ('way/' || c_custkey in (select id from e) or 'relation/' || c_custkey in (select id from e)))""")
def unseen_objects(spark, d):
    c = F.col("c_custkey")
    objects = table(spark, d, "customer").select(F.concat(F.get(F.array(F.lit("n"), F.lit("w"), F.lit("a")), (c % 3).cast("int")), c.cast("string")).alias("source_id"))
    o = table(spark, d, "orders")
    ids = o.where("o_orderkey % 3 = 0").select(F.concat(F.lit("way/"), F.col("o_orderkey").cast("string")).alias("element_id")).unionByName(o.where("o_orderkey % 7 = 0").select(F.concat(F.lit("relation/"), F.col("o_orderkey").cast("string")).alias("element_id")))
    return conflate.unseen(objects, ids.distinct(), osm_tags.element_ids(F.col("source_id")))
