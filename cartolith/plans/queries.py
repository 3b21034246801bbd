"""The registered queries over the given tables, and the same in SQL.

Points, boxes and lines are derived from keys by integer arithmetic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.functions import geometry, hours, taxonomy, text
from cartolith.operators import audit, geocode, graph, joins, osm, resolve, search, tiles
from cartolith.plans.tables import spread
from cartolith.sources import readers, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

A_SQL = "(select c_custkey id, (c_custkey * 7919) % 100003 - 50000 x, (c_custkey * 104729) % 85009 - 42500 z, c_name name, c_mktsegment kind, c_nationkey nation, c_acctbal bal from customer)"
B_SQL = "(select o_orderkey id, (o_orderkey * 6151) % 100003 - 50000 x, (o_orderkey * 3079) % 85009 - 42500 z, o_orderpriority kind, o_custkey cust from orders)"
BOX_SQL = "(select n_nationkey box_id, (n_nationkey % 5) * 20000 - 50000 x0, (n_nationkey // 5) * 17000 - 42500 z0, (n_nationkey % 5) * 20000 - 28000 x1, (n_nationkey // 5) * 17000 - 24500 z1 from nation)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points_a(spark, d):
    x, z = (F.col("c_custkey") * 7919) % 100003 - 50000, (F.col("c_custkey") * 104729) % 85009 - 42500
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), x.alias("x"), z.alias("z"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("kind"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("bal"))


def points_b(spark, d):
    x, z = (F.col("o_orderkey") * 6151) % 100003 - 50000, (F.col("o_orderkey") * 3079) % 85009 - 42500
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), x.alias("x"), z.alias("z"), F.col("o_orderpriority").alias("kind"), F.col("o_custkey").alias("cust"))


def boxes(spark, d):
    k = F.col("n_nationkey")
    col, row = (k % 5).cast("long"), F.floor(k / 5)
    return table(spark, d, "nation").select(k.alias("box_id"), (col * 20000 - 50000).alias("x0"), (row * 17000 - 42500).alias("z0"), (col * 20000 - 28000).alias("x1"), (row * 17000 - 24500).alias("z1"))


# text

FOLD = "trim(regexp_replace(strip_accents(replace(replace(lower({0}), 'œ', 'oe'), 'æ', 'ae')), '[^a-z0-9&]+', ' ', 'g'))"


@query(f"select doc_id, {FOLD.format('text')} folded from documents")
def fold_text(spark, d):
    return table(spark, d, "documents").select("doc_id", text.fold_text(F.col("text")).alias("folded"))


@query(f"select lang, count(*) tokens, count(distinct t) words from (select lang, unnest(string_split({FOLD.format('text')}, ' ')) t from documents) where t <> '' group by lang")
def tokenize(spark, d):
    flat = table(spark, d, "documents").select("lang", F.explode(text.tokens(F.col("text"))).alias("t"))
    return flat.groupBy("lang").agg(F.count(F.lit(1)).alias("tokens"), F.count_distinct("t").alias("words"))


_SHORT = " ".join(f"when '{k}' then '{v}'" for k, v in text.ABBREVIATIONS.items())
_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


@query(f"""
with p as (select p_partkey, {FOLD.format("concat(p_name, case p_partkey % 4 when 0 then ' st rue' when 1 then ' rn 124' when 2 then ' de la' else ' av d 9' end)")} f from part),
j as (select p_partkey, regexp_replace(regexp_replace(' ' || f || ' ', ' (n|d|a|rn|rd|c|vc|cr|e) ([0-9]{{1,4}}[a-z]? )', ' \\1\\2', 'g'), ' r([nd])([0-9]{{1,4}}[a-z]? )', ' \\1\\2', 'g') f from p),
w as (select p_partkey, list_filter(string_split(f, ' '), lambda x: x <> '') w from j),
s as (select p_partkey, flatten(list_transform(w, lambda x: string_split(case x {_SHORT} else x end, ' '))) w from w)
select p_partkey, array_to_string(case when len(list_filter(w, lambda x: x not in ({_STOP}))) > 0 then list_filter(w, lambda x: x not in ({_STOP})) else w end, ' ') tokens from s""")
def search_tokens(spark, d):
    tail = F.when(F.col("p_partkey") % 4 == 0, " st rue").when(F.col("p_partkey") % 4 == 1, " rn 124").when(F.col("p_partkey") % 4 == 2, " de la").otherwise(" av d 9")
    return table(spark, d, "part").select("p_partkey", F.array_join(text.search_tokens(F.concat("p_name", tail)), " ").alias("tokens"))


@query("""
with v as (select distinct unnest(string_split(lower(p_name), ' ')) t from part)
select t, list_sort(list_distinct(list_filter([case when length(t) > 3 and right(t, 1) in ('s', 'x') then left(t, length(t) - 1) end,
 case when length(t) > 4 and t like '%aux' then left(t, length(t) - 3) || 'al' end,
 case when length(t) > 2 and right(t, 1) not in ('s', 'x') and not regexp_matches(t, '^[0-9]') then t || 's' end], lambda x: x is not null))) variants from v""")
def token_variants(spark, d):
    v = table(spark, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("t")).distinct()
    return v.select("t", F.array_sort(text.token_variants(F.col("t"))).alias("variants"))


@query("""
with v as (select distinct unnest(string_split(lower(p_name), ' ')) t from part)
select a.t a, b.t b, levenshtein(a.t, b.t) edits from v a join v b on a.t < b.t and left(a.t, 2) = left(b.t, 2)
where levenshtein(a.t, b.t) <= case when length(a.t) < 4 then 0 when length(a.t) < 7 then 1 else 2 end""")
def levenshtein_match(spark, d):
    v = table(spark, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("t")).distinct().withColumn("k", F.substring("t", 1, 2))
    pairs = v.select(F.col("t").alias("a"), "k").join(v.select(F.col("t").alias("b"), "k"), "k").where("a < b").withColumn("edits", text.bounded_edits(F.col("a"), F.col("b"), 2))
    return pairs.where(F.col("edits") <= text.allowed_edits(F.length("a"))).select("a", "b", F.col("edits").cast("long").alias("edits"))


_GENERIC = ", ".join(f"'{w}'" for w in text.GENERIC_WORDS)


@query(f"""
with t as (select p_partkey, p_brand, p_size, list_filter(string_split({FOLD.format('p_name')}, ' '), lambda w: w <> '' and w not in ({_GENERIC})) w from part),
j as (select a.p_partkey a, b.p_partkey b, a.w x, b.w y from t a join t b on a.p_brand = b.p_brand and a.p_size = b.p_size and a.p_partkey < b.p_partkey)
select a, b, round(case when len(x) = 0 or len(y) = 0 then 0.0 when len(x) <= len(y) then len(list_filter(x, lambda w: list_contains(y, w))) / len(x)
 else len(list_filter(y, lambda w: list_contains(x, w))) / len(y) end, 6) similarity from j""")
def name_similarity(spark, d):
    pairs = joins.scored_pairs(table(spark, d, "part"), "p_partkey", ["p_brand", "p_size"], "p_name", text.name_tokens, lambda x, y: F.round(text.similarity(x, y), 6))
    return pairs.select("a", "b", F.col("score").alias("similarity"))


@query("""
select c_custkey, (case when regexp_matches(n, '[à-ÿÀ-Þ]') then 2 else 0 end + case when regexp_matches(n, '[a-z]') and regexp_matches(n, '[A-Z]') then 1 else 0 end
 + case when regexp_matches(n, '[-''’]') then 1 else 0 end - case when regexp_matches(n, '[a-z]') then 0 else 2 end)::int quality
from (select c_custkey, case c_custkey % 3 when 0 then upper(c_name) when 1 then c_name || ' l''été' else c_name end n from customer)""")
def name_quality(spark, d):
    n = F.when(F.col("c_custkey") % 3 == 0, F.upper("c_name")).when(F.col("c_custkey") % 3 == 1, F.concat("c_name", F.lit(" l'été"))).otherwise(F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", n.alias("n")).select("c_custkey", text.name_quality(F.col("n")).alias("quality"))


@query("""
select page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) title,
 substr(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')), 1, 8000) body from pages""")
def html_extract(spark, d):
    return table(spark, d, "pages").select("page_id", readers.page_title(F.col("html")).alias("title"), readers.page_text(F.col("html")).alias("body"))


@query("select event_id, try_cast(json_extract_string(props, '$.k') as bigint) k from events where try_cast(json_extract_string(props, '$.k') as bigint) % 3 = 0")
def open_metadata(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, d, "events").select("event_id", k.alias("k")).where("k % 3 = 0")


# taxonomy

_SECTION = " ".join(f"when v between {a} and {b} then '{c}'" for a, b, _, c in taxonomy.SECTIONS)
_NON = ", ".join(f"'{c}'" for c in taxonomy.NON_PLACES)


@query(f"""
with c as (select p_partkey, lpad((p_partkey % 99)::varchar, 2, '0') || '.' || lpad((p_partkey * 7 % 100)::varchar, 2, '0') || case p_partkey % 3 when 0 then 'z' when 1 then 'A' else 'Z ' end code from part),
n as (select *, upper(trim(code)) n, left(upper(trim(code)), 2)::int v from c)
select p_partkey, case when regexp_matches(n, '^0[123]\\.') then 'farm' when n like '46.%' then 'wholesale' {_SECTION} end category, n not in ({_NON}) is_place from n""")
def range_lookup(spark, d):
    k = F.col("p_partkey")
    code = F.concat(F.lpad((k % 99).cast("string"), 2, "0"), F.lit("."), F.lpad((k * 7 % 100).cast("string"), 2, "0"), F.when(k % 3 == 0, "z").when(k % 3 == 1, "A").otherwise("Z "))
    c = table(spark, d, "part").select("p_partkey", code.alias("code"))
    return c.select("p_partkey", taxonomy.section_category(F.col("code")).alias("category"), taxonomy.is_place(F.col("code")).alias("is_place"))


CATEGORY_OF_SEGMENT = {"AUTOMOBILE": "fuel", "BUILDING": "hotel", "FURNITURE": "restaurant", "HOUSEHOLD": "supermarket", "MACHINERY": "doctor"}
_SEGMENT = " ".join(f"when '{k}' then '{v}'" for k, v in CATEGORY_OF_SEGMENT.items())
_FAMILY = " ".join(f"when '{k}' then {list(v)!r}" for k, v in taxonomy.FAMILIES.items())


def segment_category(c):
    return F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in CATEGORY_OF_SEGMENT.items()], F.lower(c))


@query(f"select f category, count(*) members from (select unnest(case c {_FAMILY} else [c] end) f from (select case c_mktsegment {_SEGMENT} else lower(c_mktsegment) end c from customer)) group by f")
def category_family(spark, d):
    c = table(spark, d, "customer").select(segment_category(F.col("c_mktsegment")).alias("c"))
    return c.select(F.explode(taxonomy.family(F.col("c"))).alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("members"))


# joins


@query(f"select a.id a, b.id b, (a.x - b.x) * (a.x - b.x) + (a.z - b.z) * (a.z - b.z) d2 from {A_SQL} a, {B_SQL} b where abs(a.x - b.x) <= 150 and abs(a.z - b.z) <= 150 and (a.x - b.x) * (a.x - b.x) + (a.z - b.z) * (a.z - b.z) <= 22500")
def blocked_pairs(spark, d):
    return joins.blocked_pairs(points_a(spark, d), points_b(spark, d), 150).select(F.col("l_id").alias("a"), F.col("r_id").alias("b"), "d2")


@query(f"""
with p as (select a.id a, b.id b, (a.x - b.x) * (a.x - b.x) + (a.z - b.z) * (a.z - b.z) d2 from {A_SQL} a, {B_SQL} b where abs(a.x - b.x) <= 400 and abs(a.z - b.z) <= 400)
select a, b, d2 from (select *, row_number() over (partition by a order by d2, b) n from p where d2 <= 160000) where n = 1""")
def best_match(spark, d):
    a, b = points_a(spark, d).withColumnRenamed("id", "a"), points_b(spark, d).withColumnRenamed("id", "b")
    return joins.nearest_within(a, b, "a", "b", 400)


@query(f"""
with recursive p as (select a.id a, b.id b, -((a.x - b.x) * (a.x - b.x) + (a.z - b.z) * (a.z - b.z)) score from {A_SQL} a, {B_SQL} b where abs(a.x - b.x) <= 400 and abs(a.z - b.z) <= 400 and (a.x - b.x) * (a.x - b.x) + (a.z - b.z) * (a.z - b.z) <= 160000),
o as materialized (select *, row_number() over (order by score desc, a, b) n from p),
r(n, l, r, a, b, score) as (select 0::bigint, []::bigint[], []::bigint[], null::bigint, null::bigint, null::bigint
 union all select o.n, case when list_contains(r.l, o.a) or list_contains(r.r, o.b) then r.l else list_append(r.l, o.a) end, case when list_contains(r.l, o.a) or list_contains(r.r, o.b) then r.r else list_append(r.r, o.b) end,
 case when not (list_contains(r.l, o.a) or list_contains(r.r, o.b)) then o.a end, o.b, o.score from r join o on o.n = r.n + 1)
select a, b, score from r where a is not null""")
def one_to_one(spark, d):
    a, b = points_a(spark, d).withColumnRenamed("id", "a"), points_b(spark, d).withColumnRenamed("id", "b")
    return joins.one_to_one_within(a, b, "a", "b", 400).select("a", "b", (-F.col("d2")).alias("score"))


@query(f"select a.id, min(box_id) box_id from {A_SQL} a, {BOX_SQL} b where a.x >= x0 and a.x < x1 and a.z >= z0 and a.z < z1 group by a.id")
def pip_join(spark, d):
    return joins.contained(points_a(spark, d).select("id", "x", "z"), boxes(spark, d), 10000).select("id", "box_id")


@query(f"""
with h as (select a.id, min(box_id) box_id from {A_SQL} a, {BOX_SQL} b where a.x >= x0 and a.x < x1 and a.z >= z0 and a.z < z1 and box_id % 2 = 0 group by a.id),
n as (select id, box_id, row_number() over (partition by id order by d2, box_id) k from (select a.id, box_id, (a.x - (x0 + x1) // 2) * (a.x - (x0 + x1) // 2) + (a.z - (z0 + z1) // 2) * (a.z - (z0 + z1) // 2) d2
 from {A_SQL} a, {BOX_SQL} b where a.id not in (select id from h) and box_id % 2 = 0) where d2 < 144000000)
select id, box_id, true inside from h union all select id, box_id, false from n where k = 1""")
def nearest_fallback(spark, d):
    p, b = points_a(spark, d).select("id", "x", "z"), boxes(spark, d).where("box_id % 2 = 0")
    inside = joins.contained(p, b, 10000).select("id", "box_id")
    rest = p.join(inside, "id", "left_anti")
    centres = b.select("box_id", F.expr("(x0 + x1) div 2").alias("x"), F.expr("(z0 + z1) div 2").alias("z"))
    near = joins.blocked_pairs(centres, rest, 12000).where("d2 < 144000000").select(F.col("r_id").alias("id"), F.col("l_box_id").alias("box_id"), "d2")
    near = joins.best_match(near, "id", F.col("d2"), F.col("box_id"))
    return inside.withColumn("inside", F.lit(True)).unionByName(near.select("id", "box_id", F.lit(False).alias("inside")))


@query("""
with w as (select l_orderkey k, l_linenumber n, l_suppkey % 100 v, l_shipdate from lineitem where l_linenumber = 1),
h as (select distinct c_nationkey k, c_custkey % 200 f from customer),
p as (select w.k, w.v number, w.k % 25 street, f, abs(w.v - f) + case when w.v % 2 = f % 2 then 0.0 else 0.5 end gap from w join h on h.k = w.k % 25)
select k orderkey, number, street, f found, gap::double gap from (select *, row_number() over (partition by k, number, street order by gap, f) r from p where gap <= 10) where r = 1""")
def nearest_number(spark, d):
    return _numbers(spark, d, table(spark, d, "lineitem").where("l_linenumber = 1"))


@query()
def nearest_number_whole(spark, d):
    """Over all lines, each of which is a wanted number."""
    return _numbers(spark, d, table(spark, d, "lineitem"), F.col("l_linenumber").alias("line"))


def _numbers(spark, d, lines, *more):
    w = lines.select(*more, F.col("l_orderkey").alias("orderkey"), (F.col("l_suppkey") % 100).alias("number"), (F.col("l_orderkey") % 25).alias("street"))
    k = table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("street"), (F.col("c_custkey") % 200).alias("number"))
    return joins.nearest_number(w, k, ["street"])


@query("select d.doc_id from documents d where d.doc_id not in (select doc_id from labels)")
def anti_consumed(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id")


@query("select c_nationkey from customer group by c_nationkey having count(distinct c_mktsegment) = (select count(distinct c_mktsegment) from customer)")
def relational_division(spark, d):
    c = table(spark, d, "customer")
    return joins.holds_all(c, c, "c_nationkey", "c_mktsegment")


# resolution

_RANK = "case o_orderpriority when '1-URGENT' then 5 when '2-HIGH' then 4 when '3-MEDIUM' then 3 when '4-NOT SPECIFIED' then 2 else 1 end"


def ranked_orders(spark, d):
    o = table(spark, d, "orders")
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 5).when(F.col("o_orderpriority") == "2-HIGH", 4).when(F.col("o_orderpriority") == "3-MEDIUM", 3).when(F.col("o_orderpriority") == "4-NOT SPECIFIED", 2).otherwise(1)
    phone = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.concat(F.lit("p"), (F.col("o_orderkey") % 7).cast("string")))
    return o.select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus", phone.alias("phone"), rank.alias("rank"))


_FIELDS = f"(select o_custkey, o_orderkey, o_orderpriority, o_orderstatus, case when o_orderkey % 3 = 0 then '' else 'p' || (o_orderkey % 7) end phone, {_RANK} rank from orders)"


@query(f"""
select o_custkey, (list(o_orderstatus order by rank desc, o_orderkey))[1] o_orderstatus, count(distinct o_orderstatus) > 1 disputed_o_orderstatus,
 (list(phone order by rank desc, o_orderkey) filter (where phone <> ''))[1] phone, count(distinct case when phone <> '' then phone end) > 1 disputed_phone from {_FIELDS} group by o_custkey""")
def priority_merge(spark, d):
    return resolve.priority_merge(ranked_orders(spark, d), "o_custkey", ["o_orderstatus", "phone"], F.col("rank"), F.col("o_orderkey"))


@query(f"""
with l as (select o_custkey, o_orderpriority s, rank, o_orderkey, 'phone' property, phone v from {_FIELDS} union all select o_custkey, o_orderpriority, rank, o_orderkey, 'o_orderstatus', o_orderstatus from {_FIELDS}),
g as (select o_custkey, property, (list(s order by rank desc, o_orderkey))[1] winner, list_sort(list(distinct s)) ss, count(distinct v) n from l where v <> '' group by o_custkey, property)
select o_custkey, property, winner, list_filter(ss, lambda x: x <> winner) contenders from g where n > 1""")
def merge_provenance(spark, d):
    return resolve.provenance(ranked_orders(spark, d), "o_custkey", ["phone", "o_orderstatus"], "o_orderpriority", F.col("rank"), F.col("o_orderkey"))


@query("select o_custkey, o_orderpriority, n votes from (select o_custkey, o_orderpriority, count(*) n, row_number() over (partition by o_custkey order by count(*) desc, o_orderpriority) r from orders group by 1, 2) where r = 1")
def modal_vote(spark, d):
    return resolve.modal(table(spark, d, "orders"), "o_custkey", "o_orderpriority")


@query("""
select l_suppkey % 50 street, l_returnflag commune, min(l_linenumber) best_class, sum(l_quantity) length, list_sort(list(distinct l_linestatus)) refs, min(l_partkey) x0, max(l_partkey) x1, count(*) members from lineitem
group by 1, 2 having sum(l_quantity) >= 300""")
def street_merge(spark, d):
    g = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 50).alias("street"), F.col("l_returnflag").alias("commune"))
    return g.agg(F.min("l_linenumber").alias("best_class"), F.sum("l_quantity").alias("length"), F.array_sort(F.collect_set("l_linestatus")).alias("refs"), F.min("l_partkey").alias("x0"), F.max("l_partkey").alias("x1"), F.count(F.lit(1)).alias("members")).where("length >= 300")


_FATE = "case when value is null then 'invalid' when value < 5 then 'outside' when event_id % 11 = 0 then 'merged' when event_id % 13 = 0 then 'excluded' else 'accepted' end"


@query(f"""
select event_type, count(*) input, count(*) filter (where f = 'accepted') accepted, count(*) filter (where f = 'merged') merged, count(*) filter (where f = 'excluded') excluded,
 count(*) filter (where f = 'invalid') invalid, count(*) filter (where f = 'outside') outside, 0::bigint unexplained from (select event_type, {_FATE} f from events) group by event_type""")
def accounting_balance(spark, d):
    e = table(spark, d, "events")
    v, k = F.col("value"), F.col("event_id")
    fate = F.when(v.isNull(), "invalid").when(v < 5, "outside").when(k % 11 == 0, "merged").when(k % 13 == 0, "excluded").otherwise("accepted")
    return resolve.accounts(e, ["event_type"], fate)


@query("""
with g as (select conv_id, count(*) n, count(distinct role) s from conversations group by 1 having count(*) > 1)
select count(*) as groups, sum(n - 1)::bigint dropped, count(*) filter (where s = 1) identical, count(*) filter (where s > 1) conflicting, max(n) largest from g""")
def duplicate_summary(spark, d):
    return resolve.duplicate_summary(table(spark, d, "conversations"), "conv_id", F.col("role"))


@query("select conv_id, turn, role from (select *, row_number() over (partition by conv_id order by turn, role, text) n from conversations) where n = 1")
def first_wins(spark, d):
    return joins.first_wins(table(spark, d, "conversations").select("conv_id", "turn", "role", "text"), ["conv_id"], F.col("turn"), F.col("role"), F.col("text")).drop("text")


# audits


@query("select event_type, quantile_cont(value, 0.25) p25, quantile_cont(value, 0.5) p50, quantile_cont(value, 0.75) p75 from events group by event_type")
def percentile_linear(spark, d):
    return audit.linear_percentiles(table(spark, d, "events"), ["event_type"], "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75})


@query("""
with o as (select l_returnflag, list_sort(list(l_extendedprice)) v from lineitem group by 1)
select l_returnflag, v[(floor((len(v) - 1) * 0.5) + 1)::int] median, v[(floor((len(v) - 1) * 0.95) + 1)::int] p95 from o""")
def percentile_floor(spark, d):
    return audit.floor_percentiles(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", {"median": 0.5, "p95": 0.95})


@query("""
with e as (select quantile_cont(c_acctbal, [0.2, 0.4, 0.6, 0.8]) q from customer)
select c_custkey, (case when c_acctbal > q[1] then 1 else 0 end + case when c_acctbal > q[2] then 1 else 0 end + case when c_acctbal > q[3] then 1 else 0 end + case when c_acctbal > q[4] then 1 else 0 end)::int bin from customer, e""")
def density_bins(spark, d):
    return audit.bins(table(spark, d, "customer"), "c_acctbal").select("c_custkey", "bin")


@query("""
select c_custkey, c_mktsegment, turn from (select c_custkey, c_mktsegment, row_number() over (partition by c_mktsegment order by (c_custkey * 7919) % 10007, c_custkey) turn from customer)
order by turn, c_mktsegment limit 40""")
def stratified_sample(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return audit.round_robin(c, "c_mktsegment", F.struct((F.col("c_custkey") * 7919) % 10007, F.col("c_custkey")), 40).select("c_custkey", "c_mktsegment", "turn")


@query(f"""
select least(7, greatest(0, floor((x + 50000) / 12500.5)))::int col, least(7, greatest(0, floor((z + 42500) / 10626.25)))::int "row", kind, count(distinct id) features from {A_SQL} group by 1, 2, 3""")
def coverage_grid(spark, d):
    return audit.grid(points_a(spark, d), "id", "kind", -50000, -42500, 100004, 85010)


@query("""
with l as (select o_orderpriority k, count(*) n from orders where o_orderkey % 2 = 0 group by 1), r as (select o_orderpriority k, count(*) n from orders where o_orderstatus = 'F' group by 1)
select coalesce(l.k, r.k) o_orderpriority, coalesce(l.n, 0) left_n, coalesce(r.n, 0) right_n, least(coalesce(l.n, 0), coalesce(r.n, 0)) matched, abs(coalesce(l.n, 0) - coalesce(r.n, 0)) unmatched from l full join r on l.k = r.k""")
def kind_reconciliation(spark, d):
    o = table(spark, d, "orders")
    count = lambda x: x.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return audit.reconcile(count(o.where("o_orderkey % 2 = 0")), count(o.where("o_orderstatus = 'F'")), "o_orderpriority")


@query("""
with s as (select p_brand, p_type, count(*) n from part group by 1, 2), c as (select p_brand, p_type, count(*) n from part where p_size <= 40 and p_retailprice > 920 group by 1, 2)
select p_brand, p_type, s.n source_n, coalesce(c.n, 0) canonical_n, coalesce(c.n, 0) / s.n ratio,
 case when coalesce(c.n, 0) = 0 then 'missing' when c.n / s.n < 0.5 then 'short' when c.n / s.n < 0.95 then 'partial' when c.n / s.n <= 1.05 then 'equal' else 'over' end verdict from s left join c using (p_brand, p_type)""")
def tag_parity(spark, d):
    p = table(spark, d, "part")
    count = lambda x: x.groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))
    return audit.parity(count(p), count(p.where("p_size <= 40 and p_retailprice > 920")), ["p_brand", "p_type"])


_SEGMENTS = sorted(CATEGORY_OF_SEGMENT)


@query("select c_nationkey, " + ", ".join(f"count(*) filter (where c_mktsegment = '{s}') {s.lower()}" for s in _SEGMENTS) + " from customer group by c_nationkey")
def category_matrix(spark, d):
    m = table(spark, d, "customer").groupBy("c_nationkey").pivot("c_mktsegment", _SEGMENTS).count()
    return m.select("c_nationkey", *[F.coalesce(s, F.lit(0)).alias(s.lower()) for s in _SEGMENTS])


@query("""
select c_custkey, unnest(list_filter([case when c_acctbal < 0 then 'balance' end, case when c_nationkey in (3, 7) then 'nation' end, case when length(c_name) % 2 = 1 and c_custkey % 5 = 0 then 'name' end], lambda x: x is not null)) as rule from customer""")
def rule_violations(spark, d):
    rules = {"balance": F.col("c_acctbal") >= 0, "nation": ~F.col("c_nationkey").isin(3, 7), "name": ~((F.length("c_name") % 2 == 1) & (F.col("c_custkey") % 5 == 0))}
    return audit.violations(table(spark, d, "customer"), "c_custkey", rules)


# search


def records(spark, d):
    c = table(spark, d, "customer").alias("c").join(table(spark, d, "nation").alias("n"), F.col("c_nationkey") == F.col("n_nationkey"))
    x, z = (F.col("c_custkey") * 7919) % 100003 - 50000, (F.col("c_custkey") * 104729) % 85009 - 42500
    return c.select(F.col("c_custkey").alias("record_id"), F.col("c_name").alias("name"), F.col("n_name").alias("commune"), segment_category(F.col("c_mktsegment")).alias("category"), x.alias("x"), z.alias("z"), (F.col("c_custkey") % 50).cast("double").alias("boost"))


@query(f"""
with r as (select c_custkey record_id, c_name name, case c_mktsegment {_SEGMENT} else lower(c_mktsegment) end category, sqrt(x * x + z * z) metres
 from (select *, ((c_custkey * 7919) % 100003 - 50000)::double x, ((c_custkey * 104729) % 85009 - 42500)::double z from customer)),
m as (select * from r where category in ('hotel', 'guest_house', 'campsite') and metres <= 30000),
k as (select count(*) n from m where metres <= 5000)
select record_id, floor(10000 - metres / 10 + 0.5) score, metres from m, k where metres <= 5000 or n < 3 order by metres, name, record_id limit 12""")
def browse_category(spark, d):
    r = records(spark, d)
    return search.browse_category(r, "hotel", (0.0, 0.0), 5000, 12)


@query(f"""
with r as (select c_custkey record_id, {FOLD.format('c_name')} name, {FOLD.format('n_name')} commune, (c_custkey % 50)::double boost from customer join nation on c_nationkey = n_nationkey),
p as (select record_id, unnest(string_split(name, ' ')) token, 1.0 w, 'name' field from r union all select record_id, unnest(string_split(commune, ' ')), 0.78, 'commune' from r),
h as (select record_id, 0 q, w * 1.0 w, token, field from p where token = 'customer' union all select record_id, 1, w * (0.68 + 0.22 * 8.0 / length(token)), token, field from p where token like '00000000%' and token <> '00000000'
 union all select record_id, 1, w, token, field from p where token = '00000000'),
b as (select record_id, q, max(w) w from h group by 1, 2),
s as (select record_id, sum(w) s, count(*) n from b group by 1 having count(*) = 2)
select record_id, s / 2 * 1000 + 300 + boost score from s join r using (record_id) order by score desc, r.name, record_id limit 20""")
def search_score(spark, d):
    r = records(spark, d)
    return search.search(r, search.postings(r, ["name", "commune"]), "customer 00000000", limit=20)


@query()
def search_typo(spark, d):
    r = records(spark, d)
    return search.search(r, search.postings(r, ["name", "commune"]), "custoner natiom", near=(0.0, 0.0), limit=20)


# tiles and geometry


@query(f"""
with b as (select id, x x0, z z0, x + (id % 7) * 1500 x1, z + (id % 5) * 1200 z1 from {A_SQL}),
c as (select id, unnest(range(floor(x0 / 8192)::bigint, floor(x1 / 8192)::bigint + 1)) col, floor(z0 / 8192)::bigint r0, floor(z1 / 8192)::bigint r1 from b),
t as (select id, col, unnest(range(r0, r1 + 1)) "row" from c)
select 'l1_' || col || '_' || "row" tile_id, count(*) features from t group by 1""")
def tile_cover(spark, d):
    b = points_a(spark, d).select("id", F.col("x").alias("x0"), F.col("z").alias("z0"), (F.col("x") + F.col("id") % 7 * 1500).alias("x1"), (F.col("z") + F.col("id") % 5 * 1200).alias("z1"))
    return tiles.cover(b, 1).groupBy("tile_id").agg(F.count(F.lit(1)).alias("features"))


@query(f"""
with b as (select id, x x0, z z0, x + 100 + (id % 7) * 1500 x1, z + 100 + (id % 5) * 1200 z1 from {A_SQL}),
c as (select *, unnest(range(floor(x0 / 2048)::bigint, floor(x1 / 2048)::bigint + 1)) col from b),
t as (select *, unnest(range(floor(z0 / 2048)::bigint, floor(z1 / 2048)::bigint + 1)) "row" from c),
a as (select id, greatest(0, least(x1, (col + 1) * 2048) - greatest(x0, col * 2048)) * greatest(0, least(z1, ("row" + 1) * 2048) - greatest(z0, "row" * 2048)) a from t)
select id, count(*) filter (where a > 0) fragments, sum(a)::double area from a group by id""")
def tile_fragments(spark, d):
    p = spread(points_a(spark, d).select("id", "x", "z"))
    w, h = F.col("id") % 7 * 1500 + 100, F.col("id") % 5 * 1200 + 100
    point = lambda dx, dz: F.struct((F.col("x") + dx).cast("double").alias("x"), (F.col("z") + dz).cast("double").alias("y"))
    rings = p.select("id", F.array(point(0, 0), point(w, 0), point(w, h), point(0, h), point(0, 0)).alias("ring"))
    f = tiles.fragments(rings, 2048).withColumn("area", geometry.signed_area(F.col("ring"))).where("area > 0")
    return f.groupBy("id").agg(F.count(F.lit(1)).alias("fragments"), F.round(F.sum("area"), 3).alias("area"))


@query(f"""
select lod, count(*) tiles, max(b) largest, sum(b)::bigint total, (list_sort(list(b)))[(floor((count(*) - 1) * 0.5) + 1)::int] median, (list_sort(list(b)))[(floor((count(*) - 1) * 0.95) + 1)::int] p95
from (select lod, floor(x / s) c, floor(z / s) r, sum(60 + length(name)) ::bigint b from {A_SQL}, (values (0, 2048), (1, 8192), (2, 32768)) v(lod, s) group by 1, 2, 3) group by lod""")
def tile_metrics(spark, d):
    lods = F.array(*[F.struct(F.lit(k).alias("lod"), F.lit(float(s)).alias("s")) for k, s in tiles.SIZES.items()])
    p = points_a(spark, d).select("x", "z", "name", F.explode(lods).alias("l"))
    sizes = p.groupBy(F.col("l.lod").alias("lod"), F.floor(F.col("x") / F.col("l.s")).alias("c"), F.floor(F.col("z") / F.col("l.s")).alias("r")).agg(F.sum(F.length("name") + 60).alias("bytes"))
    return tiles.metrics(sizes)


@query(f"""
with recursive t as (select id, x, z, 0 s, floor(x / 32768.0)::bigint c, floor(z / 32768.0)::bigint r from {B_SQL}),
lv as (select s, 32768.0 / pow(2, s) step from range(0, 7) v(s)),
n as (select s, floor(x / step)::bigint c, floor(z / step)::bigint r, count(*) n from {B_SQL}, lv group by 1, 2, 3),
a as (select b.id, lv.s, floor(x / step)::bigint c, floor(z / step)::bigint r from {B_SQL} b, lv),
k as (select id, min(s) s from (select a.id, a.s from a join n on n.s = a.s and n.c = a.c and n.r = a.r where n.n <= 300) group by id)
select coalesce(k.s, 6)::int s, a.c col, a.r "row", count(*) features from {B_SQL} b left join k using (id) join a on a.id = b.id and a.s = coalesce(k.s, 6) group by 1, 2, 3""")
def quad_split(spark, d):
    p = tiles.split(points_b(spark, d).select("id", "x", "z"), 32768, 300, deepest=6)
    return p.groupBy("s", "col", "row").agg(F.count(F.lit(1)).alias("features"))


@query("""
with v as (select l_orderkey, l_linenumber n, (l_partkey % 1000)::double x, (l_suppkey % 1000)::double y from lineitem),
e as (select l_orderkey, x, y, lag(x) over w px, lag(y) over w py from v window w as (partition by l_orderkey order by n, x, y))
select l_orderkey, round(coalesce(sum(sqrt((x - px) * (x - px) + (y - py) * (y - py))), 0), 4) length from e group by l_orderkey""")
def line_length(spark, d):
    v = table(spark, d, "lineitem").select("l_orderkey", F.struct(F.col("l_linenumber").alias("n"), (F.col("l_partkey") % 1000).cast("double").alias("x"), (F.col("l_suppkey") % 1000).cast("double").alias("y")).alias("p"))
    lines = v.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("p")).alias("line"))
    return lines.select("l_orderkey", F.round(geometry.length(F.col("line")), 4).alias("length"))


@query(f"""
with b as (select id, x x0, z y0, x + 3000 + (id % 7) * 500 x1, z + 2500 + (id % 5) * 400 y1 from {A_SQL} where id % 2 = 0), c as (select id, x x0, z y0, x + 3000 + (id % 7) * 500 x1, z + 2500 + (id % 5) * 400 y1 from {A_SQL} where id % 2 = 1),
p as (select b.id a, c.id b, greatest(0, least(b.x1, c.x1) - greatest(b.x0, c.x0)) * greatest(0, least(b.y1, c.y1) - greatest(b.y0, c.y0)) i, (b.x1 - b.x0) * (b.y1 - b.y0) + (c.x1 - c.x0) * (c.y1 - c.y0) u from b, c
 where abs(b.x0 - c.x0) <= 2000 and abs(b.y0 - c.y0) <= 2000 and (b.x0 - c.x0) * (b.x0 - c.x0) + (b.y0 - c.y0) * (b.y0 - c.y0) <= 4000000)
select a, b, round(i / (u - i), 6) iou from p where i / (u - i) >= 0.2""")
def bbox_iou(spark, d):
    x, z, k = F.col("x").cast("double"), F.col("z").cast("double"), F.col("id")
    box = lambda s: {"x0": F.col(f"{s}x"), "y0": F.col(f"{s}z"), "x1": F.col(f"{s}x1"), "y1": F.col(f"{s}y1")}
    p = points_a(spark, d).select("id", x.alias("x"), z.alias("z"), (x + 3000 + k % 7 * 500).alias("x1"), (z + 2500 + k % 5 * 400).alias("y1")).withColumn("area", geometry.bbox_area(box("")))
    pairs = joins.crowded_pairs(p.where("id % 2 = 0"), spread(p.where("id % 2 = 1")), 2000)
    # exploded, the shared area is computed once a pair, and the code of the loop stays small enough to be compiled
    both = F.explode(F.array(geometry.bbox_shared(box("l_"), box("r_"))))
    met = pairs.select(F.col("l_id").alias("a"), F.col("r_id").alias("b"), (F.col("l_area") + F.col("r_area")).alias("areas"), both.alias("both"))
    union = F.col("areas") - F.col("both")
    found = met.select("a", "b", F.when(union > 0, F.col("both") / union).otherwise(0.0).alias("iou")).where("iou >= 0.2")
    return found.withColumn("iou", geometry.rounded(F.col("iou"), 6))


@query()
def project(spark, d):
    """Degrees to metres and back; the residual is under a micrometre in degrees."""
    p = points_a(spark, d).select("id", (F.col("x") / 50000 + 0.586).alias("lon"), (F.col("z") / 85000 + 43.695).alias("lat"))
    m = p.withColumn("m", geometry.to_lambert(F.col("lon"), F.col("lat")))
    back = m.withColumn("b", geometry.from_lambert(F.col("m.x"), F.col("m.y")))
    return back.select("id", F.round("m.x", 3).alias("x"), F.round("m.y", 3).alias("y"), F.greatest(F.abs(F.col("b.lon") - F.col("lon")), F.abs(F.col("b.lat") - F.col("lat"))).alias("residual"))


@query(f"""
select kind, count(*) kept from (select kind, (id % 40) * 100 area, id % 12 rk from {A_SQL}) where case kind when 'BUILDING' then area >= 1500 when 'MACHINERY' then rk <= 7 when 'HOUSEHOLD' then area >= 2000 else true end group by kind""")
def lod_filter(spark, d):
    p = points_a(spark, d).select("kind", (F.col("id") % 40 * 100).alias("area"), (F.col("id") % 12).alias("rk"))
    keep = F.when(F.col("kind") == "BUILDING", F.col("area") >= 1500).when(F.col("kind") == "MACHINERY", F.col("rk") <= 7).when(F.col("kind") == "HOUSEHOLD", F.col("area") >= 2000).otherwise(True)
    return p.where(keep).groupBy("kind").agg(F.count(F.lit(1)).alias("kept"))


@query("select time_bucket(interval 1 hour, ts) band, event_type, count(*) n, round(sum(value), 4) total from events group by 1, 2")
def banded_counts(spark, d):
    from cartolith.streaming.banded import banded_counts as counts

    return counts(table(spark, d, "events"), "ts", "event_type", "1 hour", "10 minutes").withColumn("total", F.round("total", 4))


_UNION = "select 'customer' feed, c_custkey id, c_name name from customer union all select 'supplier', s_suppkey, s_name from supplier union all select 'part', p_partkey, p_name from part"


@query(f"select feed, id, name from ({_UNION}) where id <= 500")
def union_feeds(spark, d):
    return union_feeds_whole(spark, d).where("id <= 500")


@query()
def union_feeds_whole(spark, d):
    pick = lambda t, k, n: table(spark, d, t).select(F.lit(t).alias("feed"), F.col(k).alias("id"), F.col(n).alias("name"))
    return pick("customer", "c_custkey", "c_name").unionByName(pick("supplier", "s_suppkey", "s_name")).unionByName(pick("part", "p_partkey", "p_name"))


@query("""
with s as (select c_custkey k, c_custkey % 4 s, (c_custkey % 7)::int d, (c_custkey * 37) % 1440 m from customer)
select k c_custkey, case s when 0 then (d < 5 and (m >= 540 and m < 720 or m >= 840 and m < 1140)) or (d = 5 and m >= 600 and m < 780)
 when 1 then (d in (1, 3) and m >= 1200) or (d in (2, 4) and m < 120) when 2 then true end open from s""")
def opening_hours(spark, d):
    k = F.col("c_custkey")
    week = hours.opening_week(F.when(k % 4 == 0, "Mo-Fr 09:00-12:00,14:00-19:00; Sa 10:00-13:00").when(k % 4 == 1, "Tu,Th 20:00-02:00").when(k % 4 == 2, "24/7").otherwise("on request"))
    c = table(spark, d, "customer").select("c_custkey", week.alias("week"))
    return c.select("c_custkey", hours.is_open(F.col("week"), (k % 7).cast("int"), (k * 37) % 1440).alias("open"))


@query(f"""
with w as (select o_orderkey id, o_custkey % 40 postcode, o_custkey % 3 street, case when o_orderkey % 5 > 0 then o_orderkey % 90 end number from orders),
h as (select c_custkey % 40 postcode, c_custkey % 3 street, c_custkey % 70 number, min({{'x': x % 900, 'z': z % 900}}) p from (select id c_custkey, x, z from {A_SQL}) group by 1, 2, 3),
n as (select id, p, abs(w.number - h.number) + case when w.number % 2 = h.number % 2 then 0.0 else 0.5 end away, h.number found from w join h using (postcode, street) where w.number is not null),
b as (select id, p, away, row_number() over (partition by id order by away, found) r from n where away <= 10),
s as (select postcode, street, sqrt(pow(max(p.x) - min(p.x), 2) + pow(max(p.z) - min(p.z), 2)) width, (list(p order by number))[count(*) // 2 + 1] p from h group by 1, 2)
select id, p.x x, p.z z, case when away = 0 then 1.0 else 0.8 end::double score from b where r = 1
union all select id, s.p.x, s.p.z, 0.6::double from w join s using (postcode, street) where width <= 1200 and id not in (select id from b)""")
def geocode_street(spark, d):
    o = table(spark, d, "orders")
    wanted = o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 40).alias("postcode"), (F.col("o_custkey") % 3).alias("street"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderkey") % 90).alias("number"))
    known = points_a(spark, d).select((F.col("id") % 40).alias("postcode"), (F.col("id") % 3).alias("street"), (F.col("id") % 70).alias("number"), (F.col("x") % 900).alias("x"), (F.col("z") % 900).alias("z"))
    return geocode.by_street(wanted, known)


@query(f"""
with h as (select id % 40 postcode, id % 3 street, (x % 900)::double x, (z % 900)::double z from {A_SQL}),
n as (select *, row_number() over (partition by postcode, street order by x) rx, row_number() over (partition by postcode, street order by z) rz, count(*) over (partition by postcode, street) k from h)
select postcode, street, max(x) filter (where rx = k // 2 + 1) x, max(z) filter (where rz = k // 2 + 1) z from n group by 1, 2 having sqrt(pow(max(x) - min(x), 2) + pow(max(z) - min(z), 2)) <= 2300""")
def geocode_middle(spark, d):
    known = points_a(spark, d).select((F.col("id") % 40).alias("postcode"), (F.col("id") % 3).alias("street"), (F.col("x") % 900).cast("double").alias("x"), (F.col("z") % 900).cast("double").alias("z"))
    return geocode.in_the_middle(known, 2300)


@query(f"""
with p as (select id, nation commune, kind k, x // 40 x, z // 40 z from {A_SQL}),
f as (select commune, k, min({{'id': id, 'x': x, 'z': z}}) f from p group by 1, 2),
m as (select commune, k, any_value(f) f, max(sqrt(pow(x - f.x, 2) + pow(z - f.z, 2))) far from p join f using (commune, k) group by 1, 2)
select s_suppkey id, f.x x, f.z z, 0.5::double score from supplier join m on commune = s_nationkey and k = case s_suppkey % 2 when 0 then 'BUILDING' else 'MACHINERY' end where far <= 1900""")
def geocode_name(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("commune"), F.when(F.col("s_suppkey") % 2 == 0, "BUILDING").otherwise("MACHINERY").alias("key"))
    p = points_a(spark, d).select(F.col("id").alias("place_id"), F.col("nation").alias("commune"), F.col("kind").alias("key"), F.expr("x div 40").alias("x"), F.expr("z div 40").alias("z"))
    return geocode.by_name(s, p, 1900)


@query("""
with w as (select l_orderkey way_id, l_linenumber pos, l_partkey node from lineitem where l_orderkey % 50 = 0 or l_linenumber <= 2),
n as (select p_partkey node, p_size::double x from part where p_partkey % 9 <> 0),
g as (select way_id, count(*) n, count(n.node) k, (list(x order by pos, x))[1] first_x from w left join n using (node) group by way_id)
select way_id, n points from g where n = k""")
def way_lines(spark, d):
    """Ways are the lines of orders, nodes the parts; ways with an unknown node are dropped."""
    return _ways(spark, d, table(spark, d, "lineitem").where("l_orderkey % 50 = 0 or l_linenumber <= 2"))


@query()
def way_lines_whole(spark, d):
    """Every line of an order is a node of its way."""
    return _ways(spark, d, table(spark, d, "lineitem"))


def _ways(spark, d, li):
    ways = li.groupBy(F.col("l_orderkey").alias("way_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("n")).select("way_id", F.transform("n", lambda v: v["l_partkey"]).alias("nodes"))
    nodes = table(spark, d, "part").where("p_partkey % 9 <> 0").select(F.col("p_partkey").alias("node_id"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    return osm.way_lines(ways, nodes).select("way_id", F.size("line").cast("long").alias("points"))


@query("select p_partkey, case when p_partkey % 2 = 0 then array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') else p_name end shown from part")
def display_names(spark, d):
    name = F.when(F.col("p_partkey") % 2 == 0, text.display_case(F.upper("p_name"))).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", name.alias("shown"))


@query(f"""
with r as (select c_custkey record_id, case c_mktsegment {_SEGMENT} else lower(c_mktsegment) end category, (c_custkey % 50)::double boost, ((c_custkey * 7919) % 100003 - 50000)::double x, ((c_custkey * 104729) % 85009 - 42500)::double z from customer),
h as (select * from r where record_id % 17 = 0), m as (select * from r where category = 'hotel'),
k as (select (count(*) filter (where record_id % 17 = 0)) / count(*) < 0.3 brand from m)
select record_id, round(2000 + case when record_id % 17 = 0 and brand then 1500 else 0 end + boost * 0.2 - sqrt(x * x + z * z) / 1000 * 12, 6) score from m, k
union all select record_id, boost + 4000 from h where record_id % 51 = 0 and category <> 'hotel'""")
def category_merge(spark, d):
    r = records(spark, d)
    hits = r.where("record_id % 17 = 0").select("record_id", (F.col("record_id") % 51 == 0).alias("exact"), F.lit(True).alias("named"), "category", "boost")
    return search.merged_category(hits, r.where("category = 'hotel'"), (0.0, 0.0), 2).withColumn("score", F.round("score", 6))


@query(f"""
with recursive h as (select c_custkey record_id, case c_mktsegment {_SEGMENT} else lower(c_mktsegment) end as name, (c_custkey * 7919) % 100003 - 50000 x, (c_custkey * 104729) % 85009 - 42500 z, (c_custkey % 50) * 1000.0::double - c_custkey score from customer),
o as materialized (select *, row_number() over (order by score desc, name, record_id) n from h),
k(n, kept, id) as (select 0::bigint, []::struct(name varchar, x bigint, z bigint)[], null::bigint
 union all select o.n, case when len(list_filter(kept, lambda v: v.name = o.name and sqrt(pow(v.x - o.x, 2) + pow(v.z - o.z, 2)) < 20000)) = 0 then list_append(kept, {{'name': o.name, 'x': o.x, 'z': o.z}}) else kept end,
 case when len(list_filter(kept, lambda v: v.name = o.name and sqrt(pow(v.x - o.x, 2) + pow(v.z - o.z, 2)) < 20000)) = 0 then o.record_id end from k join o on o.n = k.n + 1 where len(kept) < 25)
select record_id, name, x, z, score from o where record_id in (select id from k where id is not null)""")
def distinct_hits(spark, d):
    r = records(spark, d).select("record_id", F.col("category").alias("name"), "x", "z", (F.col("boost") * 1000 - F.col("record_id")).alias("score"))
    return search.distinct_hits(r, 25, 20_000.0)


@query(f"""
with f as (select id, lod, 'l' || lod || '_' || floor(x / s)::bigint || '_' || floor(z / s)::bigint tile_id, x, z, 60 + length(name) bytes from {A_SQL}, (values (0, 2048), (1, 8192), (2, 32768)) v(lod, s))
select lod, tile_id, count(distinct id) features, count(*) fragments, sum(bytes)::bigint bytes, min(x) x0, min(z) z0, max(x) x1, max(z) z1 from f group by 1, 2""")
def tile_manifest(spark, d):
    lods = F.array(*[F.struct(F.lit(k).alias("lod"), F.lit(float(s)).alias("s")) for k, s in tiles.SIZES.items()])
    p = points_a(spark, d).select("id", "x", "z", "name", F.explode(lods).alias("l")).select("id", "x", "z", "name", "l.*")
    cell = lambda c: F.floor(F.col(c) / F.col("s")).cast("string")
    f = p.select("lod", F.concat_ws("_", F.concat(F.lit("l"), F.col("lod").cast("string")), cell("x"), cell("z")).alias("tile_id"), "id", F.col("id").alias("fragment_id"), F.col("x").alias("x0"), F.col("z").alias("z0"), F.col("x").alias("x1"), F.col("z").alias("z1"), (F.length("name") + 60).alias("bytes"))
    return sinks.manifest(f)


@query(f"""
with t as (select distinct floor(x / 8192)::bigint c, floor(z / 8192)::bigint r from {A_SQL} where id % 3 > 0), b as (select 'l1_' || c || '_' || r tile_id, c * 8192.0 x0, r * 8192.0 z0 from t)
select tile_id from b where x0 + 8192 > -9000 and x0 < 20000 and z0 + 8192 > -15000 and z0 < 5000 order by pow(x0 + 4096 - 5500, 2) + pow(z0 + 4096 + 5000, 2), tile_id limit 12""")
def tile_plan(spark, d):
    return _plan(points_a(spark, d).where("id % 3 > 0"))


@query()
def tile_plan_whole(spark, d):
    return _plan(points_a(spark, d))


def _plan(points):
    p = points.select(F.floor(F.col("x") / 8192).alias("col"), F.floor(F.col("z") / 8192).alias("row")).distinct()
    t = p.select(F.lit(1).alias("lod"), tiles.tile_id(1).alias("tile_id"), (F.col("col") * 8192.0).alias("x0"), (F.col("row") * 8192.0).alias("z0")).withColumn("x1", F.col("x0") + 8192).withColumn("z1", F.col("z0") + 8192)
    return tiles.planned(t, (-9000.0, -15000.0, 20000.0, 5000.0), 0, 12).select("tile_id")


@query(f"""
with recursive b as (select id, kind, x x0, z z0, x + (id % 7) * 150 x1, z + (id % 5) * 120 z1 from {A_SQL}),
e as (select a.id a, c.id b from b a join b c on a.kind = c.kind and a.id <> c.id
 where pow(greatest(0, c.x0 - a.x1, a.x0 - c.x1), 2) + pow(greatest(0, c.z0 - a.z1, a.z0 - c.z1), 2) < 2250000),
r(x, y) as (select a, b from e union select r.x, e.b from r join e on r.y = e.a)
select b.id box_id, least(b.id, coalesce(min(r.y), b.id)) as "cluster" from b left join r on r.x = b.id group by b.id""")
def name_clusters(spark, d):
    p = points_a(spark, d)
    b = p.select(F.col("id").alias("box_id"), F.col("kind").alias("name"), F.col("x").alias("x0"), F.col("z").alias("z0"), (F.col("x") + F.col("id") % 7 * 150).alias("x1"), (F.col("z") + F.col("id") % 5 * 120).alias("z1"))
    return graph.clusters(b, 1500)


# further queries, which register themselves
from . import audit_queries, feature_queries, index_queries, join_queries, line_queries, polygon_queries, ring_queries, schema_queries, search_queries, shape_queries, sql_queries  # noqa: E402, F401
