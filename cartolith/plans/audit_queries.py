"""Queries of quality rules and audit tables over orders, customers and events, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartolith.operators import ledger, rules

from .queries import A_SQL, points_a, query, table


@query("""
select c_custkey, list_filter([case when c_custkey % 17 = 0 or c_custkey % 19 = 0 then 'position' end, case when c_custkey % 23 = 0 then 'local_position' end, case when c_nationkey > 20 and c_custkey % 2 = 0 then 'outside' end,
 case when c_custkey % 3 = 0 and c_acctbal > 100 then 'inferred_height' end, case when c_custkey % 5 = 0 then 'no_source' end, case when c_custkey % 7 = 0 then 'no_provenance' end], lambda x: x is not null) issues from customer""")
def feature_rules(spark, d):
    k = F.col("c_custkey")
    lon = F.when(k % 17 == 0, float("nan")).when(k % 19 == 0, 200.0).otherwise(0.6)
    lists = lambda n: F.when(k % n == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a")))
    issues = rules.feature_issues(
        lon, F.lit(43.7), F.when(k % 23 > 0, 1.0), F.lit(2.0), F.col("c_nationkey") <= 20, k % 2 == 1, F.col("c_acctbal"), k % 3 == 0, lists(5), F.when(k % 7 > 0, lists(10**9)),
    )
    return table(spark, d, "customer").select("c_custkey", issues.alias("issues"))


@query("select unnest(['F', 'O', 'P', 'X', 'Y']) missing except select distinct o_orderstatus from orders")
def missing_kinds(spark, d):
    return rules.missing_values(table(spark, d, "orders"), "o_orderstatus", ("F", "O", "P", "X", "Y"))


@query("""
with f as (select o_custkey % 500 t, o_orderkey % 40 f from orders where o_custkey % 500 <> 7), t as (select distinct c_custkey % 510 t, (select count(*) from f where f.t = c_custkey % 510) + case when c_custkey % 510 % 9 = 0 then 1 else 0 end n from customer),
a as (select t, count(*) n, count(*) > count(distinct f) r from f group by 1)
select coalesce(t.t, a.t) tile_id, 'count' issue from t full join a on t.t = a.t where t.n is distinct from coalesce(a.n, case when t.n is not null then 0 end) union all select t, 'repeated' from a where r""")
def tile_rules(spark, d):
    f = table(spark, d, "orders").select((F.col("o_custkey") % 500).alias("tile_id"), (F.col("o_orderkey") % 40).alias("fragment_id")).where("tile_id <> 7")
    n = f.groupBy("tile_id").agg(F.count(F.lit(1)).alias("n"))
    t = table(spark, d, "customer").select((F.col("c_custkey") % 510).alias("tile_id")).distinct().join(n, "tile_id", "left")
    return rules.tile_issues(t.select("tile_id", (F.coalesce("n", F.lit(0)) + F.when(F.col("tile_id") % 9 == 0, 1).otherwise(0)).alias("count")), f)


@query("select l_orderkey, l_linenumber from lineitem where (l_returnflag = 'R') = (l_linestatus = 'F')")
def fictive_rules(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.struct("l_orderkey", "l_linenumber").alias("key"), (F.col("l_returnflag") == "R").alias("f"), (F.col("l_linestatus") == "F").alias("drawn"))
    return rules.fictive_issues(li, "key", F.col("f"), F.col("drawn")).select("key.*")


@query("select o_orderkey, o_custkey from orders where o_custkey not in (select c_custkey from customer where c_nationkey < 20)")
def records_rule(spark, d):
    records = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("tile_id"))
    return rules.records_without_tile(records, table(spark, d, "customer").where("c_nationkey < 20").select(F.col("c_custkey").alias("tile_id"))).select("o_orderkey", F.col("tile_id").alias("o_custkey"))


@query("""
with t as (select (p_size % 4)::int lod, sum(p_partkey * (p_size % 7))::bigint bytes from part group by 1)
select t.lod, t.bytes, coalesce(t.bytes < f.bytes, true) shrinks from t left join t f on f.lod = t.lod - 1""")
def lod_rule(spark, d):
    return rules.shrinking(table(spark, d, "part").select((F.col("p_size") % 4).cast("int").alias("lod"), (F.col("p_partkey") * (F.col("p_size") % 7)).alias("bytes")))


@query("select p_partkey, (p_size % 3)::int lod, (p_partkey * 40)::bigint bytes from part where p_partkey * 40 > case p_size % 3 when 0 then 1000 when 1 then 3000 else 6000 end")
def limit_rule(spark, d):
    return rules.over_limit(table(spark, d, "part").select("p_partkey", (F.col("p_size") % 3).cast("int").alias("lod"), (F.col("p_partkey") * 40).cast("long").alias("bytes")), {0: 1000, 1: 3000, 2: 6000})


@query("""
with g as (select o_orderkey, ['Point', 'LineString', 'Polygon', 'MultiPoint'][(o_orderkey % 4 + 1)::int] k, o_custkey % 6 n, o_orderkey % 11 > 0 f from orders)
select o_orderkey, f and n >= case when k like '%Point' then 1 when k = 'LineString' then 2 else 4 end usable from g""")
def usable_geometry(spark, d):
    k = F.col("o_orderkey")
    kind = F.get(F.array(*[F.lit(v) for v in ("Point", "LineString", "Polygon", "MultiPoint")]), (k % 4).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", rules.usable(kind, F.col("o_custkey") % 6, k % 11 > 0).alias("usable"))


@query("""
with c as (select c_nationkey * 3 + c_custkey % 3 cell, c_nationkey < 22 territory, case when c_nationkey % 6 = 0 then 0 else 1 end tiles, c_mktsegment kind, case when c_custkey % 2 = 0 then 0 else 1 end features, case when c_custkey % 5 = 0 then 0 else 1 end searchable from customer)
select distinct cell, case when tiles = 0 then 'no_tile' when features = 0 then 'missing:' || kind else 'unsearchable:' || kind end verdict from c where territory and (tiles = 0 or features = 0 or searchable = 0)""")
def coverage_verdicts(spark, d):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    one = lambda zero: F.when(zero, 0).otherwise(1)
    return rules.uncovered(table(spark, d, "customer").select((n * 3 + k % 3).alias("cell"), (n < 22).alias("territory"), one(n % 6 == 0).alias("tiles"), F.col("c_mktsegment").alias("kind"), one(k % 2 == 0).alias("features"), one(k % 5 == 0).alias("searchable")))


@query("select count(*) as \"rows\", count(*) filter (where trim(n) <> '') named, count(*) filter (where n is null or trim(n) = '') unnamed, count(distinct c) communes, count(distinct left(c, 4)) prefixes from (select case o_orderkey % 4 when 0 then null when 1 then ' ' else o_orderpriority end n, (10000 + o_custkey)::varchar c from orders)")
def name_prefixes(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select(F.when(k % 4 == 1, " ").when(k % 4 > 1, F.col("o_orderpriority")).alias("n"), (F.col("o_custkey") + 10000).cast("string").alias("c"))
    return ledger.name_counts(o, "n", "c")


@query("select o_orderpriority kind, count(*) features, count(*) filter (where o_orderstatus = 'F') searchable, count(*) filter (where o_orderstatus = 'F') / count(*) share, case when count(*) filter (where o_orderstatus = 'X') > 0 then 1.0 else 0.0 end::double none from orders group by 1")
def searchability(spark, d):
    g = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("kind")).agg(F.count(F.lit(1)).alias("features"), F.count_if(F.col("o_orderstatus") == "F").alias("searchable"), F.count_if(F.col("o_orderstatus") == "X").alias("x"))
    return g.select("kind", "features", "searchable", ledger.ratio(F.col("searchable"), F.col("features")).alias("share"), ledger.ratio(F.col("features"), F.col("x")).alias("none"))


@query("""
with l as (select l_returnflag kind, l_orderkey % 2 = 0 o, unnest([{'f': 'l_linestatus', 'v': l_linestatus}, {'f': 'l_linenumber', 'v': l_linenumber::varchar}]) p from lineitem)
select kind, p.f field, p.v as "value", count(*) filter (where o) ours, count(*) filter (where not o) theirs from l group by all""")
def value_tallies(spark, d):
    return ledger.tallies(table(spark, d, "lineitem").withColumn("kind", F.col("l_returnflag")), "kind", ["l_linestatus", "l_linenumber"], F.col("l_orderkey") % 2 == 0)


@query("select o_orderpriority, arg_max(o_orderkey, m * 1000000000 - o_orderkey) o_orderkey, max(m) metres, count(*) samples from (select o_orderpriority, o_orderkey, (o_orderkey * 7919) % 1009 m from orders) group by 1")
def worst_residuals(spark, d):
    o = table(spark, d, "orders").select("o_orderpriority", "o_orderkey", ((F.col("o_orderkey") * 7919) % 1009).alias("metres"))
    return ledger.worst(o, ["o_orderpriority"], "o_orderkey", "metres")


_LAYERS = "(select o_custkey % 7 family, o_custkey layer, count(*) input, count(*) filter (where o_orderstatus = 'F') accepted, case when o_custkey % 5 > 0 then count(*) filter (where o_orderstatus = 'O') end merged, count(*) filter (where o_orderkey % 3 = 0 and o_orderstatus = 'P') excluded, 0::bigint invalid, 0::bigint outside from orders group by o_custkey)"


@query(f"select family, count(*) layers, sum(case when merged is not null then input end)::bigint input, sum(case when merged is not null then accepted + merged + excluded end)::bigint explained, sum(input - accepted - merged - excluded)::bigint residual, count(*) filter (where merged is null) unknown from {_LAYERS} group by 1")
def family_residuals(spark, d):
    s, c = F.col("o_orderstatus"), F.col("o_custkey")
    g = table(spark, d, "orders").groupBy((c % 7).alias("family"), c.alias("layer")).agg(
        F.count(F.lit(1)).alias("input"), F.count_if(s == "F").alias("accepted"), F.count_if(s == "O").alias("m"), F.count_if((F.col("o_orderkey") % 3 == 0) & (s == "P")).alias("excluded"),
    )
    zero = F.lit(0).cast("long")
    return ledger.family_totals(g.withColumn("merged", F.when(F.col("layer") % 5 > 0, F.col("m"))).withColumn("invalid", zero).withColumn("outside", zero))


@query("""
with a as (select c_nationkey check_id, count(*) n from customer group by 1), b as (select s_nationkey check_id, count(*) + case when s_nationkey % 2 = 0 then (select count(*) from customer where c_nationkey = s_nationkey) - count(*) else 0 end n from supplier group by 1)
select coalesce(a.check_id, b.check_id) check_id, a.n declared, b.n measured, case when a.n = b.n then 'agree' when coalesce(a.check_id, b.check_id) % 3 = 0 then 'blocking' else 'advisory' end verdict from a full join b on a.check_id = b.check_id""")
def audit_checks(spark, d):
    count = lambda t, k: table(spark, d, t).groupBy(F.col(k).alias("check_id")).agg(F.count(F.lit(1)).alias("n"))
    a, b = count("customer", "c_nationkey"), count("supplier", "s_nationkey")
    b = b.join(a.select("check_id", F.col("n").alias("m")), "check_id", "left").select("check_id", F.when(F.col("check_id") % 2 == 0, F.coalesce("m", F.lit(0))).otherwise(F.col("n")).alias("n"))
    return ledger.cross_checks(a, b, F.col("check_id") % 3 == 0)


@query("""
with s as (select o_custkey as "name", max(o_orderdate) t from orders group by 1), b as (select o_custkey as "name", max(o_orderdate) built from orders where o_orderstatus = 'F' group by 1)
select "name", built is null never from s left join b using ("name") where built is null or t > built""")
def stale_sources(spark, d):
    o = table(spark, d, "orders")
    return ledger.stale(o.groupBy(F.col("o_custkey").alias("name")).agg(F.max("o_orderdate").alias("at")), o.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("name")).agg(F.max("o_orderdate").alias("built")))


@query("""
select event_type, count(*) raw, count(*) filter (where h) headers, count(*) filter (where b) blanks, count(*) filter (where not h and not b) data, count(*) filter (where not h and not b and not s) invalid, count(*) filter (where not h and not b and s and not i) outside,
 count(*) filter (where not h and not b and s and i) kept, count(distinct case when not h and not b and s and i then event_id // 2 end) distinct_keys, true closed
from (select *, event_id % 97 = 0 h, event_id % 31 = 0 and event_id % 97 <> 0 b, value is not null and value > 3 s, event_id % 10 > 0 i from events) group by 1""")
def line_funnel(spark, d):
    k = F.col("event_id")
    sound = F.coalesce(F.col("value") > 3, F.lit(False))
    return ledger.funnel(table(spark, d, "events"), ["event_type"], k % 97 == 0, (k % 31 == 0) & (k % 97 != 0), sound, k % 10 > 0, F.floor(k / 2))


@query("""
select o_orderpriority section, count(*) received, count(*) filter (where a and not r) accepted, count(*) filter (where a and r) repeated, count(*) filter (where a and not r and m = 'source') by_source, count(*) filter (where a and not r and m = 'street') by_street, count(*) filter (where a and not r and m is null) failed
from (select *, o_orderstatus <> 'P' a, o_orderkey % 6 = 0 r, case o_orderkey % 5 when 0 then 'source' when 1 then 'street' when 2 then 'source' when 3 then 'street' end m from orders) group by 1""")
def scan_result(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").withColumn("section", F.col("o_orderpriority"))
    return ledger.scan_accounts(o, "section", F.col("o_orderstatus") != "P", k % 6 == 0, F.when((k % 5).isin(0, 2), "source").when((k % 5).isin(1, 3), "street"), ("source", "street"))


@query("""
with r as (select o_custkey % 100 tile_id, case o_orderkey % 3 when 0 then 'road' else 'poi' end kind, o_orderkey % 5 = 0 minor, o_orderkey % 4 > 0 inside, o_orderkey % 977 away, row_number() over (partition by o_custkey % 100 order by o_orderkey) n from orders)
select tile_id, count(*) features, case when count(*) filter (where kind = 'road') > 0 then count(*) filter (where kind = 'road' and minor) / count(*) filter (where kind = 'road') else 0 end::double minor_share, count(*) filter (where n <= 40 and not inside) outside, max(away) filter (where n <= 40) farthest from r group by 1""")
def tile_strata(spark, d):
    k = F.col("o_orderkey")
    r = table(spark, d, "orders").select((F.col("o_custkey") % 100).alias("tile_id"), k.alias("id"), F.when(k % 3 == 0, "road").otherwise("poi").alias("kind"))
    i = F.col("id")
    return ledger.tile_observations(r, i % 5 == 0, i % 4 > 0, i % 977)


@query("""
with o as (select c_nationkey stratum, c_mktsegment kind, c_custkey % 1000 bytes, case when c_custkey % 50 = 0 then 1 else 0 end outside from customer where c_custkey % 3 > 0), e as (select n_nationkey stratum, unnest(['BUILDING', 'MACHINERY', 'AUTOMOBILE']) kind from nation),
m as (select stratum, list_sort(list(kind) filter (where not exists (select 1 from o where o.stratum = e.stratum and o.kind = e.kind))) missing from e group by 1), t as (select stratum, count(*) filter (where bytes > 900) oversize, sum(outside)::bigint outside from o group by 1)
select m.stratum, coalesce(missing, []) missing, coalesce(oversize, 0) oversize, coalesce(outside, 0) outside, missing is null and coalesce(oversize, 0) = 0 and coalesce(outside, 0) = 0 passed from m left join t using (stratum)""")
def stratum_verdicts(spark, d):
    k = F.col("c_custkey")
    o = table(spark, d, "customer").where("c_custkey % 3 > 0").select(F.col("c_nationkey").alias("stratum"), F.col("c_mktsegment").alias("kind"), (k % 1000).alias("bytes"), F.when(k % 50 == 0, 1).otherwise(0).alias("outside"))
    e = table(spark, d, "nation").select(F.col("n_nationkey").alias("stratum"), F.explode(F.array(F.lit("BUILDING"), F.lit("MACHINERY"), F.lit("AUTOMOBILE"))).alias("kind"))
    return ledger.stratum_verdicts(o, e, 900)


@query("""
with s as (select p_brand layer, count(*) input from part group by 1), c as (select p_brand layer, count(*) store from part where p_size <= 30 group by 1), l as (select p_brand layer, count(*) filter (where p_size > 45) clipped, count(*) filter (where p_size = 44) dropped from part where p_size > 40 group by 1)
select layer, input, coalesce(store, 0) store, coalesce(clipped, 0) clipped, coalesce(dropped, 0) dropped, greatest(coalesce(store, 0), input - coalesce(clipped, 0) - coalesce(dropped, 0)) accepted, case when layer like '%1' then 'partial' else 'whole' end as label from s left join c using (layer) left join l using (layer)""")
def layer_audit(spark, d):
    p = table(spark, d, "part").withColumn("layer", F.col("p_brand"))
    count = lambda df, n: df.groupBy("layer").agg(F.count(F.lit(1)).alias(n))
    drops = p.where("p_size > 40").groupBy("layer").agg(F.count_if(F.col("p_size") > 45).alias("clipped"), F.count_if(F.col("p_size") == 44).alias("dropped"))
    return ledger.layer_family(count(p, "input"), count(p.where("p_size <= 30"), "store"), drops, F.col("layer").endswith("1"))


@query("""
with f as (select o_custkey query, o_orderkey % 20 item_id, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) rank, (o_orderkey % 300)::double x, (o_orderkey % 200)::double z from orders),
b as (select query, item_id, min(rank) rank, arg_min(x, rank) x, arg_min(z, rank) z from f group by 1, 2)
select c_custkey entry_id, b.rank, coalesce(b.rank <= 3, false) hit, coalesce(b.rank <= 3 and sqrt(pow(b.x - c_custkey % 300, 2) + pow(b.z - c_custkey % 200, 2)) <= 150, false) near from customer left join b on query = c_custkey and item_id = c_custkey % 20""")
def benchmark_checks(spark, d):
    from pyspark.sql import Window

    k, c = F.col("o_orderkey"), F.col("c_custkey")
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("long")
    found = table(spark, d, "orders").select(F.col("o_custkey").alias("query"), (k % 20).alias("item_id"), rank.alias("rank"), (k % 300).cast("double").alias("x"), (k % 200).cast("double").alias("z"))
    wanted = table(spark, d, "customer").select(c.alias("entry_id"), c.alias("query"), (c % 20).alias("item_id"), (c % 300).cast("double").alias("x"), (c % 200).cast("double").alias("z"), F.lit(150.0).alias("tolerance"))
    return ledger.checklist(found, wanted)


@query("""
with c as (select c_custkey cell, (c_custkey % 50) * 10.0 x0, (c_nationkey * 8.0) z0 from customer)
select cell, 64::bigint samples, count(*) filter (where pow(x0 + (i + 0.5) * 1.25 - 250, 2) + pow(z0 + (j + 0.5) * 1.0 - 100, 2) <= 10000) inside from c, range(0, 8) a(i), range(0, 8) b(j) group by 1""")
def sampled_cells(spark, d):
    c = F.col("c_custkey")
    cells = table(spark, d, "customer").select(c.alias("cell"), ((c % 50) * F.lit(10.0)).alias("x0"), (F.col("c_nationkey") * F.lit(8.0)).alias("z0"), F.lit(10.0).alias("width"), F.lit(8.0).alias("depth"))
    return ledger.cell_samples(cells, 8, F.pow(F.col("x") - 250, 2) + F.pow(F.col("z") - 100, 2) <= 10000)


@query(f"""
with b as (select id, floor(x / 16384)::bigint || ':' || floor(z / 16384)::bigint bucket from {A_SQL})
select id, bucket, turn from (select id, bucket, row_number() over (partition by bucket order by id) turn from b) order by turn, bucket limit 60""")
def spread_sample(spark, d):
    return ledger.spread(points_a(spark, d).select("id", "x", "z"), 16384, F.col("id"), 60).select("id", "bucket", "turn")


@query("""
with r as (select o_orderkey, o_custkey % 11 g, row_number() over (partition by o_custkey % 11 order by o_orderkey) n, count(*) over (partition by o_custkey % 11) k from orders)
select o_orderkey, g from r where floor(n * least(25, k) / k) > floor((n - 1) * least(25, k) / k)""")
def even_sample(spark, d):
    return ledger.evenly(table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 11).alias("g")), "g", F.col("o_orderkey"), 25)


@query("select o_custkey % 200 id, min((o_orderkey % 3)::int) lod from orders group by 1")
def finest_level(spark, d):
    o = table(spark, d, "orders").select((F.col("o_custkey") % 200).alias("id"), (F.col("o_orderkey") % 3).cast("int").alias("lod"))
    return ledger.finest(o, "id")
