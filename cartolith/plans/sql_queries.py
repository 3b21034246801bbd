"""Queries written in SQL text alone, over the registered functions."""

from __future__ import annotations

from cartolith.functions import sql

from .queries import A_SQL, FOLD, ORACLES, query
from .tables import SPREAD

_TABLE = "parquet.`{d}/{name}.parquet`"


def asked(spark, d, statement, *names):
    """The statement over the named tables of a folder."""
    sql.register(spark)
    return spark.sql(statement.format(**{n: _TABLE.format(d=d, name=n) for n in names}))


@query(f"""
with c as (select c_custkey id, case c_custkey % 3 when 0 then upper(c_name) || ' SARL' when 1 then c_name || ' l''Été 32000 Auch' else c_name end n, c_name from customer),
t as (select *, list_filter(string_split({FOLD.format("n")}, ' '), lambda w: w <> '') w, list_filter(string_split({FOLD.format("c_name")}, ' '), lambda w: w <> '') v from c),
g as (select *, list_filter(w, lambda x: x not in ('sarl', 'l')) x from t)
select id, array_to_string(w, ' ') folded, len(w)::int words, case when len(x) <= len(v) then len(list_filter(x, lambda y: list_contains(v, y))) / len(x) else len(list_filter(v, lambda y: list_contains(x, y))) / len(v) end similarity,
 (case when regexp_matches(n, '[à-ÿÀ-Þ]') then 2 else 0 end + case when regexp_matches(n, '[a-z]') and regexp_matches(n, '[A-Z]') then 1 else 0 end + case when regexp_matches(n, '[-''’]') then 1 else 0 end - case when regexp_matches(n, '[a-z]') then 0 else 2 end)::int quality,
 nullif(regexp_extract(n, '\\b([0-9]{{5}})\\b', 1), '') postcode from g""")
def sql_text(spark, d):
    return asked(spark, d, """
        WITH c AS (SELECT c_custkey id, CASE c_custkey % 3 WHEN 0 THEN concat(upper(c_name), ' SARL') WHEN 1 THEN concat(c_name, ' l\\'Été 32000 Auch') ELSE c_name END n, c_name FROM {customer})
        SELECT id, fold_text(n) folded, size(text_tokens(n)) words, name_similarity(n, c_name) similarity, name_quality(n) quality, postcode_of(n) postcode FROM c""", "customer")  # fmt: skip


_BOXES = "SELECT c_custkey id, double(c_custkey * 7919 % 100003 - 50000) x0, double(c_custkey * 104729 % 85009 - 42500) z0, c_custkey % 7 * 1500 + double(c_custkey * 7919 % 100003 - 50000) x1, c_custkey % 5 * 1200 + double(c_custkey * 104729 % 85009 - 42500) z1 FROM {customer}"


@query(ORACLES["tile_cover"])
def sql_box_tiles(spark, d):
    """Tiles of all boxes by a lateral join with a SQL table function: no Python in the plan."""
    return asked(spark, d, f"SELECT tile_id, count(*) features FROM ({_BOXES}) b, LATERAL box_tiles(b.x0, b.z0, b.x1, b.z1, 1) GROUP BY tile_id", "customer")


@query(f"""
with b as (select id, x x0, z z0, x + (id % 7) * 1500 x1, z + (id % 5) * 1200 z1 from {A_SQL}),
c as (select *, unnest(range(floor(x0 / 2048)::bigint, floor(x1 / 2048)::bigint + 1)) col from b), t as (select *, unnest(range(floor(z0 / 2048)::bigint, floor(z1 / 2048)::bigint + 1)) "row" from c)
select tile_id, count(*) features, min(id) first_id, round(sum(area), 3) area from (select id, 'l0_' || col || '_' || "row" tile_id, ((x1 - x0) * (z1 - z0))::double area from t) group by tile_id""")
def sql_tile_cover(spark, d):
    """Tiles of all boxes by the polymorphic table function, which passes the table's own columns on.

    A scan reads customers in few tasks, and each runs the function in one process: they are spread over all cores first."""
    tasks = SPREAD * spark.sparkContext.defaultParallelism
    return asked(spark, d, f"""
        SELECT tile_id, count(*) features, min(id) first_id, round(sum(box_area(named_struct('x0', x0, 'y0', z0, 'x1', x1, 'y1', z1))), 3) area
        FROM tile_cover(TABLE(SELECT /*+ REPARTITION({tasks}) */ * FROM ({_BOXES})), lod => 0) GROUP BY tile_id""", "customer")  # fmt: skip
