"""Queries over names, tags and survey features, derived from the keys and words of parts, customers and orders, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartolith.functions import coerce, levels, names, osm_tags, survey, taxonomy
from cartolith.plans.tables import spread

from .queries import query, table

# values that the derived tags take in turn; some are no values that the rules know
TAGS = {
    "building": ("yes", "church"), "place": ("village", "hamlet", "sea"), "boundary": ("administrative",), "highway": ("bus_stop", "crossing", "residential", "track", "mini_roundabout", "speed_camera", "ford"),
    "railway": ("rail", "halt", "switch", "razed", "vacant"), "public_transport": ("platform", "disused", "pole"), "aeroway": ("taxiway", "gate", "hangar", "kite"),
    "waterway": ("river", "weir", "fairway"), "landuse": ("basin", "cemetery", "farmland"), "natural": ("wetland", "wood", "tree", "cliff"), "leisure": ("pitch", "slipway", "park"),
    "man_made": ("tower", "pier"), "barrier": ("gate", "wall"), "power": ("line",), "shop": ("bakery", "kiosk", "no"), "amenity": ("bank", "bench"), "name": ("Auch",),
}


def _has(i: int) -> str:
    return f"(p_partkey * {2 * i + 3} + {i}) % {5 + i % 4} = 0"


def _value_sql(i: int, values: tuple[str, ...]) -> str:
    return f"case when {_has(i)} then {list(values)!r}[((p_partkey // {i + 2}) % {len(values)} + 1)::int] end"


TAG_SQL = "(select p_partkey, " + ", ".join(f"{_value_sql(i, v)} as \"{k}\"" for i, (k, v) in enumerate(TAGS.items())) + " from part)"


def tagged(spark, d):
    value = lambda i, v: F.when(F.expr(_has(i)), F.get(F.array(*[F.lit(x) for x in v]), F.expr(f"cast((p_partkey div {i + 2}) % {len(v)} as int)")))
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), value(i, v).alias("value")) for i, (k, v) in enumerate(TAGS.items())])
    return table(spark, d, "part").select("p_partkey", F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("tags"))


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _case(key: str, known: dict[str, str]) -> str:
    return f"case {key} " + " ".join("when '{}' then '{}'".format(k.replace("'", "''"), v) for k, v in known.items()) + " end"


O = osm_tags
_POI = "coalesce(nullif(shop, 'no'), nullif(amenity, 'no'))"


@query(f"""
with t as (select *, case
 when building is not null then case when {_POI} is not null and name is not null then ['poi', {_POI}, 'any', null] else ['building', building, 'areal', null] end
 when place is not null then case when place in {_in(O.PLACE_IMPORTANCE)} then ['place', place, 'any', null] else [null, null, null, 'excluded_tag'] end
 when boundary is not null then [null, null, null, 'excluded_tag']
 when highway in {_in(O.BUS_STOPS)} then ['transport', 'bus_stop', 'point', null] when highway in {_in(O.NO_ROADS)} then [null, null, null, 'excluded_tag']
 when railway is not null then case when railway in {_in(O.RAILS)} then ['transport', 'rail', 'linear', null] when {_case('railway', O.RAIL_STOPS)} is not null then ['transport', {_case('railway', O.RAIL_STOPS)}, 'point', null]
  when railway in {_in(O.RAIL_POINTS)} then ['poi', railway, 'point', null] when railway in {_in(O.NO_RAILS)} then [null, null, null, 'excluded_tag'] else [null, null, null, 'unclassified_tags'] end
 when public_transport is not null then case when {_case('public_transport', O.STOPS)} is not null then ['transport', {_case('public_transport', O.STOPS)}, 'any', null]
  when public_transport in {_in(O.NO_STOPS)} then [null, null, null, 'excluded_tag'] else [null, null, null, 'unclassified_tags'] end
 when aeroway is not null then case when {_case('aeroway', O.AIRFIELDS)} is not null then ['transport', {_case('aeroway', O.AIRFIELDS)}, 'any', null] when aeroway = 'gate' then ['poi', 'gate', 'point', null]
  when aeroway in {_in(O.NO_AIRFIELDS)} then [null, null, null, 'excluded_tag'] else [null, null, null, 'unclassified_tags'] end
 when waterway is not null then case when waterway in {_in(O.WATERWAYS)} then ['water', waterway, 'any', null] when waterway in {_in(O.WATER_POINTS)} then ['poi', waterway, 'point', null] else [null, null, null, 'excluded_tag'] end
 when landuse is not null then [case when landuse in ('reservoir', 'basin') then 'water' else 'landuse' end, landuse, 'areal', null]
 when "natural" is not null then case when "natural" in ('water', 'wetland') then ['water', "natural", 'areal', null] when {_case('"natural"', O.NATURAL_AREAS)} is not null then ['landuse', {_case('"natural"', O.NATURAL_AREAS)}, 'areal', null]
  when "natural" in {_in(O.NATURAL_POINTS)} then ['poi', "natural", 'point', null] else [null, null, null, 'excluded_tag'] end
 when leisure is not null then case when {_case('leisure', O.LEISURE_AREAS)} is not null then ['landuse', {_case('leisure', O.LEISURE_AREAS)}, 'areal', null] when leisure in {_in(O.LEISURE_POINTS)} then ['poi', leisure, 'point', null] else ['landuse', leisure, 'any', null] end
 when man_made is not null then case when man_made in {_in(O.BUILT)} then ['poi', man_made, 'any', null] else [null, null, null, 'excluded_tag'] end
 when highway is not null then case when highway in {_in(O.ROADS)} then ['road', highway, 'linear', null] when highway in {_in(O.ROAD_POINTS)} then ['road', highway, 'point', null] when highway in {_in(O.POLES)} then ['poi', highway, 'point', null] else [null, null, null, 'unclassified_tags'] end
 when barrier is not null then case when barrier in {_in(O.GATES)} then ['poi', barrier, 'point', null] else [null, null, null, 'excluded_tag'] end
 when power is not null then [null, null, null, 'excluded_tag'] when coalesce(shop, amenity) is not null then ['poi', coalesce(shop, amenity), 'point', null] else [null, null, null, 'unclassified_tags'] end f from {TAG_SQL}),
g as (select p_partkey, f[1] kind, f[2] subtype, f[3] mode, f[4] reason, ['Point', 'LineString', 'Polygon', 'MultiLineString'][(p_partkey % 4 + 1)::int] geo, p_partkey % 3 = 0 closed from t)
select p_partkey, kind, subtype, mode, case when reason is not null then reason when kind = 'road' and subtype in {_in(O.SURVEYED_ROADS)} then 'excluded_tag'
 when mode = 'linear' and geo not in ('LineString', 'MultiLineString') or mode = 'areal' and not (geo in ('Polygon', 'MultiPolygon') or geo = 'LineString' and closed) then 'geometry_kind_mismatch'
 when p_partkey % 13 = 0 then 'missing_source_id' when p_partkey % 11 = 0 then 'outside_boundary' end reason from g""")
def tag_kinds(spark, d):
    k = F.col("p_partkey")
    geometry = F.get(F.array(*[F.lit(g) for g in ("Point", "LineString", "Polygon", "MultiLineString")]), (k % 4).cast("int"))
    fate = tagged(spark, d).select("p_partkey", osm_tags.classify(F.col("tags")).alias("f"))
    reason = osm_tags.drop_reason(F.col("f"), geometry, k % 3 == 0, F.when(k % 13 != 0, k.cast("string")), k % 11 != 0)
    return fate.select("p_partkey", "f.kind", "f.subtype", "f.mode", reason.alias("reason"))


_TAGGED = " ".join(f"when '{k}' then '{v}'" for k, v in O.TAG_CATEGORY.items())
_CATEGORY = ", ".join(f"case '{k}=' || \"{k}\" {_TAGGED} end" for k in O.CATEGORY_KEYS if k in TAGS)
_BARE = ", ".join(f"case '{k}=' || v {_TAGGED} end" for k in O.VALUE_KEYS)


@query(f"""
select p_partkey, coalesce({_CATEGORY}, case when shop is not null then 'shop' end) category, coalesce({_BARE}) bare, shop is not null or amenity is not null as poi
from (select *, coalesce(amenity, shop, leisure, "natural") v from {TAG_SQL})""")
def tag_category(spark, d):
    t = F.col("tags")
    bare = F.coalesce(t["amenity"], t["shop"], t["leisure"], t["natural"])
    return tagged(spark, d).select("p_partkey", osm_tags.category(t).alias("category"), osm_tags.value_category(bare).alias("bare"), osm_tags.has_any(t, "shop", "amenity").alias("poi"))


@query("""
with a as (select c_custkey k, case when c_custkey % 5 > 0 then c_custkey % 90 || case c_custkey % 4 when 0 then ' ' else '' end end n, case c_custkey % 7 when 0 then null when 1 then '' else 'Rue ' || c_mktsegment end s,
 case when c_custkey % 3 > 0 then '32' || lpad((c_custkey % 1000)::varchar, 3, '0') end p, case when c_custkey % 2 = 0 then 'Auch' end c, ['n', 'W', 'r', 'a', 'x'][(c_custkey % 5 + 1)::int] || c_custkey id from customer)
select k c_custkey, case when nullif(trim(s), '') is not null then concat_ws(', ', concat_ws(' ', nullif(trim(n), ''), s), nullif(concat_ws(' ', p, c), '')) end address,
 'https://www.openstreetmap.org/' || case lower(left(id, 1)) when 'n' then 'node/' || k when 'w' then 'way/' || k when 'r' then 'relation/' || k end url,
 case lower(left(id, 1)) when 'a' then ['way/' || k, 'relation/' || k] when 'n' then ['node/' || k] when 'w' then ['way/' || k] when 'r' then ['relation/' || k] else [id] end ids,
 list_sort(list_filter([case when n is not null then 'addr:housenumber' end, case when s <> '' then 'addr:street' end, case when p is not null then 'addr:postcode' end, case when c is not null then 'addr:city' end], lambda x: x is not null)) keys from a""")
def element_texts(spark, d):
    k = F.col("c_custkey")
    number = F.when(k % 5 > 0, F.concat((k % 90).cast("string"), F.when(k % 4 == 0, " ").otherwise("")))
    street = F.when(k % 7 == 0, F.lit(None)).when(k % 7 == 1, "").otherwise(F.concat(F.lit("Rue "), "c_mktsegment"))
    postcode, city = F.when(k % 3 > 0, F.concat(F.lit("32"), F.lpad((k % 1000).cast("string"), 3, "0"))), F.when(k % 2 == 0, "Auch")
    tags = F.create_map(F.lit("addr:housenumber"), number, F.lit("addr:street"), street, F.lit("addr:postcode"), postcode, F.lit("addr:city"), city)
    source = F.concat(F.get(F.array(*[F.lit(x) for x in "nWrax"]), (k % 5).cast("int")), k.cast("string"))
    t = table(spark, d, "customer").select("c_custkey", tags.alias("t"), source.alias("id"))
    keys = F.array_sort(F.map_keys(osm_tags.metadata(F.col("t"))))
    return t.select("c_custkey", osm_tags.address(F.col("t")).alias("address"), osm_tags.object_url(F.col("id")).alias("url"), osm_tags.element_ids(F.col("id")).alias("ids"), keys.alias("keys"))


@query("""
with w as (select p_partkey k, string_split(p_name, ' ') w from part), u as (select k, w, list_transform(w, lambda x: upper(x[1]) || x[2:]) t from w)
select k p_partkey, 'Chemin du ' || t[1] || '-' || t[2] street, t[1] || '-de-' || t[2] || '-' || t[3] place, case when k % 3 = 0 then null else array_to_string(t, ' ') end business,
 case k % 3 when 0 then 'Chemin du ' || t[1] || '-' || t[2] when 1 then t[1] || '-de-' || t[2] || '-' || t[3] else t[1] || ' de ' || t[2] end as label from u""")
def shown_names(spark, d):
    k, w = F.col("p_partkey"), F.split("p_name", " ")
    raised = F.transform(w, lambda x: F.initcap(x))
    p = spread(table(spark, d, "part").select("p_partkey", "p_name")).select(
        "p_partkey",
        F.concat(F.lit("CHE. DU "), F.upper(F.get(w, F.lit(0))), F.lit("-"), F.upper(F.get(w, F.lit(1)))).alias("street"),
        F.concat(F.get(raised, F.lit(0)), F.lit("-de-"), F.get(raised, F.lit(1)), F.lit("-"), F.get(w, F.lit(2))).alias("place"),
        F.when(k % 3 == 0, "SARL (X)").otherwise(F.concat(F.lit("S.A.S. "), F.upper("p_name"), F.lit(" (PLACE DU"))).alias("business"),
        F.concat(F.upper(F.get(w, F.lit(0))), F.lit(" DE "), F.upper(F.get(w, F.lit(1))), F.lit(" (cut")).alias("shouted"),
    )
    kind = F.when(k % 3 == 0, "road").when(k % 3 == 1, "place").otherwise("poi")
    label = names.canonical_label(kind, F.when(k % 3 == 0, F.col("street")).when(k % 3 == 1, F.col("place")).otherwise(F.col("shouted")))
    return p.select("p_partkey", names.street_name(F.col("street")).alias("street"), names.capitalise_compounds(F.col("place")).alias("place"), names.business_name(F.col("business")).alias("business"), label.alias("label"))


@query("""
with w as (select p_partkey k, string_split(p_name, ' ') w from part), u as (select k, upper(w[1]) a, upper(w[2]) b, lower(w[1]) la, lower(w[2]) lb from w)
select k p_partkey, case k % 3 when 0 then 'AVENUE DE ' || a || ' SAINT ' || b when 1 then a || ' CHE ' || b else 'PLACE ' || a end street, 'SAINTE ' || a || ' ' || b place,
 ['LES ' || a || ' D ' || b, a || ' D ' || b] toponyms, la || ' ' || lb || ' saint' duplicate, 'ete d ' || la || ' ' || lb matched, 'b&b d ' || la || ' ' || lb category, 'ete d''' || la nature from u""")
def name_keys(spark, d):
    k, w = F.col("p_partkey"), F.split("p_name", " ")
    a, b = F.get(w, F.lit(0)), F.get(w, F.lit(1))
    street = F.when(k % 3 == 0, F.concat(F.lit("Av. de "), a, F.lit(" st "), b)).when(k % 3 == 1, F.concat(F.lit("Lieu-dit "), a, F.lit(" Che "), b)).otherwise(F.concat(F.lit("ld pl "), a))
    return table(spark, d, "part").select(
        "p_partkey", names.street_key(street).alias("street"), names.place_key(F.concat(F.lit("Ste-"), a, F.lit(" "), b)).alias("place"),
        names.toponym_keys(F.concat(F.lit("Lieu-dit Les "), a, F.lit(" d'"), b)).alias("toponyms"), names.duplicate_key(F.concat(F.lit("Le "), a, F.lit(" et "), b, F.lit(" St"))).alias("duplicate"),
        names.match_key(F.concat(F.lit("Été d’"), a, F.lit("--"), b)).alias("matched"), names.category_text(F.concat(F.lit("B&B d’"), a, F.lit(" "), b)).alias("category"),
        names.nature_key(F.concat(F.lit(" Été  d’"), a)).alias("nature"),
    )


@query("""
with s as (select s_suppkey k, ['Yes', ' non ', '1', 'perhaps', 'vrai'][(s_suppkey % 5 + 1)::int] f, s_suppkey % 9 n, s_acctbal b from supplier)
select k s_suppkey, case lower(trim(f)) when 'yes' then true when '1' then true when 'non' then false end as plain, case lower(trim(f)) when 'yes' then true when '1' then true when 'vrai' then true when 'non' then false end as survey,
 case when n > 0 and k % 2 = 0 then (n + 0.5)::double end width, case when n > 0 then n::int end lanes, n::int speed, (n * 1000 + 5)::bigint people, case when n between 1 and 6 then n::int end importance,
 case when k % 4 > 0 then b end finite, floor(b * 10 + 0.5) / 10 rounded, case when k * 37 >= 10000 then (floor(k * 37 / 1000 + 0.5)::int) || ' km' else printf('%.1f km', k * 37 / 1000) end far from s""")
def coerced_values(spark, d):
    k = F.col("s_suppkey")
    n = (k % 9).cast("string")
    f = F.get(F.array(*[F.lit(x) for x in ("Yes", " non ", "1", "perhaps", "vrai")]), (k % 5).cast("int"))
    return table(spark, d, "supplier").select(
        "s_suppkey", coerce.flag(f).alias("plain"), coerce.flag(f, coerce.SURVEY_YES, coerce.SURVEY_NO).alias("survey"),
        coerce.width(F.concat(F.when(n == "0", "-").otherwise(""), n, F.when(k % 2 == 0, ".5 m").otherwise(" feet"))).alias("width"), coerce.lanes(F.concat(F.lit(" "), n, F.lit(";2"))).alias("lanes"),
        coerce.max_speed(F.concat(n, F.lit(".7 mph"))).alias("speed"), coerce.population(F.concat(n, F.lit(" 005 people"))).alias("people"), coerce.importance(n).alias("importance"),
        coerce.finite(F.when(k % 4 > 0, F.col("s_acctbal").cast("string")).otherwise("NaN")).alias("finite"), coerce.round_half_up(F.col("s_acctbal"), 1).alias("rounded"),
        coerce.kilometres((k * 37).cast("double")).alias("far"),
    )


NATURES = ("Sentier", "Escalier", "Piste cyclable", "Bac ou liaison maritime", "Type autoroutier", "Chemin", "Route empierrée", "Route à 2 chaussées", "Route à 1 chaussée")


@query(f"""
with o as (select o_orderkey k, {list(NATURES)!r}[(o_orderkey % 9 + 1)::int] n, case when o_orderkey % 8 < 7 then o_orderkey // 9 % 8 end r, case o_orderkey // 7 % 3 when 0 then 'Autoroute' when 1 then 'Nationale' else '' end a, o_orderkey // 5 % 2 = 0 u,
 case o_orderkey % 4 when 0 then null when 1 then 'NC' when 2 then 'D930/NC/ N124' else 'D' || o_custkey end ref, case o_orderkey % 3 when 0 then 'Double sens' when 1 then 'Sens direct' end dir from orders)
select k o_orderkey, case when n = 'Sentier' then 'path' when n = 'Escalier' then 'steps' when n = 'Piste cyclable' then 'cycleway' when n like 'Bac%' then 'ferry' when n = 'Type autoroutier' and (r = 1 or a = 'Autoroute') then 'motorway'
 when n in ('Chemin', 'Route empierrée') then case when r <= 4 then 'tertiary' else 'track' end when a = 'Nationale' or r = 1 then 'trunk' when r = 2 then 'primary' when r = 3 then 'secondary' when r = 4 then 'tertiary'
 when r = 5 then case when u then 'residential' else 'unclassified' end when r = 6 then 'service' when n = 'Type autoroutier' then 'motorway' when n = 'Route à 2 chaussées' then 'primary' else 'unclassified' end road_class,
 case k % 4 when 2 then 'D930 / N124' when 3 then ref end ref, case when dir = 'Sens direct' then true when dir = 'Double sens' then false end oneway, case when k % 2 = 0 then 'b' when k % 3 = 0 then 'c' end as "name" from o""")
def road_classes(spark, d):
    k = F.col("o_orderkey")
    pick = lambda values, i: F.get(F.array(*[F.lit(v) for v in values]), i.cast("int"))
    rank = F.when(k % 8 < 7, F.expr("o_orderkey div 9 % 8").cast("string"))
    ref = F.when(k % 4 == 1, "NC").when(k % 4 == 2, "D930/NC/ N124").when(k % 4 == 3, F.concat(F.lit("D"), F.col("o_custkey").cast("string")))
    admin = pick(("Autoroute", "Nationale", ""), F.expr("o_orderkey div 7 % 3"))
    blank, b, c = F.lit(" "), F.when(k % 2 == 0, " b"), F.when(k % 3 == 0, "c")
    return table(spark, d, "orders").select(
        "o_orderkey", survey.road_class(pick(NATURES, k % 9), rank, admin, F.expr("o_orderkey div 5 % 2 = 0")).alias("road_class"), survey.road_ref(ref).alias("ref"),
        survey.oneway(pick(("Double sens", "Sens direct", "?"), k % 3)).alias("oneway"), survey.road_name(blank, b, c).alias("name"),
    )


_TABLES = {"structure": survey.STRUCTURES, "landuse": survey.LAND_USES, "poi": survey.POINTS, "transport": survey.TRANSPORTS, "place": survey.PLACES}
_NATURE = ("Bois", "Pont", "Croix", "Source captée", "Rond-point", "Île", "Point d’eau", "Nothing")


@query(f"""
select n_nationkey, p_partkey, {", ".join(f"coalesce({_case('f', t)}, 'other') {k}" for k, t in _TABLES.items())}
from (select p_partkey, p_partkey % 25 n_nationkey, ['bois', 'pont', 'croix', 'source captee', 'rond-point', 'ile', 'point d''eau', 'nothing'][(p_partkey % 8 + 1)::int] f from part)""")
def survey_types(spark, d):
    k = F.col("p_partkey")
    nature = F.get(F.array(*[F.lit(v) for v in _NATURE]), (k % 8).cast("int"))
    return table(spark, d, "part").select((k % 25).alias("n_nationkey"), "p_partkey", *[survey.nature_type(nature, t).alias(name) for name, t in _TABLES.items()])


_KINDS = ("commune", "town", "hamlet", "farm", "elsewhere")
_PLACE_BOOST, _ROAD_BOOST = (" ".join(f"when '{k}' then {v}" for k, v in t.items()) for t in (survey.PLACE_BOOST, survey.ROAD_BOOST))


@query(f"""
with c as (select c_custkey k, {list(_KINDS)!r}[(c_custkey % 5 + 1)::int] t, case when c_custkey % 3 > 0 then c_custkey * 13 end pop, case when c_custkey % 4 > 0 then c_custkey % 6 + 1 end imp, ['primary', 'residential', 'ferry'][(c_custkey % 3 + 1)::int] r, c_custkey * 1.7 len from customer)
select k c_custkey, case when t = 'commune' then least(320, floor(150 + 35 * log10(coalesce(pop, 0) + 10) + 0.5))::bigint else greatest(0, case t {_PLACE_BOOST} else 40 end - greatest(0, coalesce(imp, 6) - 3) * 4)::bigint end place,
 (30 + case r {_ROAD_BOOST} else 0 end + least(20, floor(log2(greatest(1.0, len / 50)) * 3 + 0.5)))::bigint street from c""")
def record_boosts(spark, d):
    k = F.col("c_custkey")
    pick = lambda values, n: F.get(F.array(*[F.lit(v) for v in values]), (k % n).cast("int"))
    place = survey.place_boost(pick(_KINDS, 5), F.when(k % 3 > 0, k * 13), F.when(k % 4 > 0, k % 6 + 1))
    return table(spark, d, "customer").select("c_custkey", place.cast("long").alias("place"), survey.street_boost(pick(("primary", "residential", "ferry"), 3), k * F.lit(1.7)).alias("street"))

_LEVEL_KINDS = ("building", "road", "water", "poi", "landuse", "transport", "structure", "place", "boundary", "address")
_LEVEL_TYPES = ("motorway", "service", "track", "forest", "bus_stop", "rail", "commune", "river")
_TILE_RANK = " ".join(f"when '{k}' then {v}" for k, v in levels.TILE_RANK.items())
_LEVEL_SQL = f"""(select o_orderkey id, lod, {list(_LEVEL_KINDS)!r}[(o_orderkey % 10 + 1)::int] kind, {list(_LEVEL_TYPES)!r}[(o_orderkey // 10 % 8 + 1)::int] t, case when o_orderkey % 3 > 0 then 'n' end n, (o_orderkey * 7919 % 200003)::double area,
 (o_orderkey * 104729 % 3001)::double len, o_orderkey // 3 % 2 = 0 surface, case when o_orderkey % 7 > 0 then o_orderkey % 7 end imp, case when o_orderkey % 5 > 0 then (o_orderkey % 11)::double end w from orders, range(0, 3) l(lod))"""


@query(f"""
with f as (select *, case t {_TILE_RANK} else 10 end rk, coalesce(imp, 6) i from {_LEVEL_SQL})
select id, lod, coalesce(case when lod = 0 or kind = 'boundary' or kind = 'place' and t = 'commune' then true
 when lod = 1 then case kind when 'building' then area >= 1500 when 'road' then rk <= 7 when 'water' then case when surface then area >= 400 else len >= 150 end when 'poi' then n is not null when 'landuse' then area >= 2000 when 'transport' then t <> 'bus_stop' or n is not null when 'structure' then area >= 1000 when 'place' then i <= 5 else false end
 else case kind when 'road' then rk <= 4 when 'water' then case when surface then area >= 20000 else len >= 1500 and (n is not null or coalesce(w, 0) >= 5) end when 'landuse' then area >= 150000 and t = 'forest' when 'place' then i <= 3 when 'transport' then t = 'rail' else false end end, false) kept,
 case when kind in ('road', 'water') and w > 0 then w when kind = 'road' then case t when 'motorway' then 12 when 'service' then 3.5 when 'track' then 2.5 else 4 end when kind = 'water' then case t when 'river' then 10 else 3 end else 0 end::double width from f""")
def level_keeps(spark, d):
    k = F.col("o_orderkey")
    pick = lambda values, i: F.get(F.array(*[F.lit(v) for v in values]), i.cast("int"))
    f = table(spark, d, "orders").select(
        k.alias("id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("lod"), pick(_LEVEL_KINDS, k % 10).alias("kind"), pick(_LEVEL_TYPES, F.expr("o_orderkey div 10 % 8")).alias("subtype"),
        F.when(k % 3 > 0, "n").alias("name"), (k * 7919 % 200003).cast("double").alias("area"), (k * 104729 % 3001).cast("double").alias("length"), F.expr("o_orderkey div 3 % 2 = 0").alias("surface"),
        F.when(k % 7 > 0, k % 7).alias("importance"), F.when(k % 5 > 0, (k % 11).cast("double")).alias("width"),
    )
    return f.select("id", F.col("lod").cast("long").alias("lod"), levels.keep_at(F.col("lod"), F.col).alias("kept"), levels.width(F.col("kind"), F.col("width"), F.col("subtype")).alias("width"))


_CODES = sorted(taxonomy.ACTIVITIES)
_ACTIVITY = " ".join(f"when '{k}' then '{v}'" for k, v in taxonomy.ACTIVITIES.items())
_SECTION = " ".join(f"when v between {a} and {b} then '{c}'" for a, b, _, c in taxonomy.SECTIONS)


@query(f"""
with c as (select p_partkey, case when p_partkey % 2 = 0 then lpad((p_partkey % 99)::varchar, 2, '0') || '.' || lpad((p_partkey * 7 % 100)::varchar, 2, '0') || 'Z' else {_CODES!r}[(p_partkey // 2 % {len(_CODES)} + 1)::int] end code from part),
n as (select *, left(code, 2)::int v from c)
select p_partkey, coalesce(case code {_ACTIVITY} end, case when regexp_matches(code, '^0[123]\\.') then 'farm' when code like '46.%' then 'wholesale' {_SECTION} end) category,
 case p_partkey % 4 when 0 then 'bakery' when 1 then 'fuel' when 2 then 'other' else 'bank' end as shown from n""")
def activity_categories(spark, d):
    k = F.col("p_partkey")
    listed = F.get(F.array(*[F.lit(c) for c in _CODES]), F.expr(f"cast(p_partkey div 2 % {len(_CODES)} as int)"))
    code = F.when(k % 2 == 0, F.concat(F.lpad((k % 99).cast("string"), 2, "0"), F.lit("."), F.lpad((k * 7 % 100).cast("string"), 2, "0"), F.lit("z"))).otherwise(F.concat(F.lit(" "), listed))
    first = F.when(k % 4 == 0, "bakery").when(k % 4 == 2, "mystery")
    second = F.when(k % 4 == 1, "fuel").when(k % 4 == 3, "bank").when(k % 4 == 0, "bank")
    return table(spark, d, "part").select("p_partkey", taxonomy.activity_category(code).alias("category"), levels.shown_category([first, second], ("bakery", "restaurant")).alias("shown"))


@query("""
with t as (select p_partkey k, case p_partkey % 5 when 0 then null when 1 then '12.5' when 2 then '7 m' when 3 then 'tall' else '0' end h, case when p_partkey % 3 > 0 then (p_partkey % 7)::varchar end l, case p_partkey % 4 when 0 then 'yes' when 1 then 'no' end b, case p_partkey % 6 when 0 then 'yes' end tu,
 ['communes', 'vegetation', 'roads'][(p_partkey % 3 + 1)::int] layer, case when p_partkey % 2 = 0 then '32' else '31' end dep, ['Bois', 'Vigne', 'Haie'][(p_partkey // 3 % 3 + 1)::int] nature, p_size * 100.0 area from part)
select k p_partkey, case k % 5 when 1 then 12.5 when 2 then 7.0 else case when l::double > 0 then l::double * 3 else 3.0 end end::double metres, k % 5 not in (1, 2) inferred, case when tu = 'yes' then 'tunnel' when b = 'yes' then 'bridge' else 'ground' end stratum,
 case layer when 'communes' then dep = '32' when 'vegetation' then nature <> 'Haie' and area >= 2000 else true end read_it from t""")
def built_features(spark, d):
    k = F.col("p_partkey")
    pick = lambda values, i: F.get(F.array(*[F.lit(v) for v in values]), i.cast("int"))
    height = F.when(k % 5 == 1, "12.5").when(k % 5 == 2, "7 m").when(k % 5 == 3, "tall").when(k % 5 == 4, "0")
    tags = F.create_map(F.lit("height"), height, F.lit("building:levels"), F.when(k % 3 > 0, (k % 7).cast("string")), F.lit("bridge"), F.when(k % 4 == 0, "yes").when(k % 4 == 1, "no"), F.lit("tunnel"), F.when(k % 6 == 0, "yes"))
    p = table(spark, d, "part").select("p_partkey", "p_size", tags.alias("t"), osm_tags.building_height(tags).alias("h"))
    read = levels.read_at_all(pick(("communes", "vegetation", "roads"), k % 3), F.when(k % 2 == 0, "32").otherwise("31"), pick(("Bois", "Vigne", "Haie"), F.expr("p_partkey div 3 % 3")), F.col("p_size") * 100.0)
    return p.select("p_partkey", "h.metres", "h.inferred", osm_tags.stratum(F.col("t")).alias("stratum"), read.alias("read_it"))
