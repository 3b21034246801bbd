"""Queries over the stored search index, and their SQL, which scores every query against every record."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cartolith.functions import text
from cartolith.operators.search_index import build_index, query_keys, search_many, word_keys
from cartolith.plans.tables import materialise, shared_dir, spread
from cartolith.sources import readers

from .queries import _SHORT, _STOP, FOLD, query, table

_HOUSE = ", ".join(f"'{s}'" for s in text.HOUSE_SUFFIXES)


def page_records(spark, d):
    """Pages by their title, the language in their path as place, with house numbers."""
    k = F.col("page_id")
    house = F.concat((k % 9 + 1).cast("string"), F.when(k % 5 == 0, "bis").otherwise(""))
    lang = F.regexp_extract("url", "^[a-z]+://[^/]*/([a-z]+)/", 1)
    return spread(table(spark, d, "pages").select("page_id", "url", "html")).select(k.alias("record_id"), readers.page_title(F.col("html")).alias("name"), lang.alias("commune"), house.alias("house"), (k % 50).cast("double").alias("boost"), (k * 7919 % 10007).alias("x"), (k * 6151 % 9973).alias("z"))


def page_queries(records):
    """A query of each record: its second word without the third letter and the beginning of its last; some have a number, some a word too many."""
    k, w = F.col("record_id"), text.tokens(F.col("name"))
    d = records.select("record_id", w.alias("w")).where("size(w) > 1")
    second, last = F.get("w", F.lit(1)), F.element_at("w", -1)
    typo = F.concat(F.substring(second, 1, 2), F.substring(second, F.lit(4), F.length(second)))
    q = F.concat(F.when(k % 2 == 0, F.concat((k % 9 + 1).cast("string"), F.lit(" "))).otherwise(""), F.when(k % 7 == 0, "zzqqx ").otherwise(""), typo, F.lit(" "), F.substring(last, 1, 4))
    near = lambda c: F.when(k % 3 == 0, c).cast("double")
    return d.select(k.alias("query_id"), q.alias("query"), near(k * 31 % 10007).alias("near_x"), near(k * 37 % 9973).alias("near_z"))


def _used(w):
    return f"case when len({w}) > 1 and regexp_matches({w}[1], '^[0-9]{{1,4}}$') then case when len({w}) > 2 and {w}[2] in ({_HOUSE}) then 2 when not regexp_matches({w}[2], '^[0-9]') then 1 else 0 end else 0 end"


_TITLE = "trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g'))"
_SPLIT = "list_filter(string_split({0}, ' '), lambda w: w <> '')"
SEARCH_SQL = f"""
with r as (select page_id record_id, {_TITLE} name, regexp_extract(url, '^[a-z]+://[^/]*/([a-z]+)/', 1) commune, (page_id % 9 + 1) || case when page_id % 5 = 0 then ' bis' else '' end house,
  (page_id % 50)::double boost, (page_id * 7919 % 10007)::double x, (page_id * 6151 % 9973)::double z from pages),
w as (select record_id, {_SPLIT.format(FOLD.format("name"))} w from r),
q0 as (select record_id query_id, case when record_id % 2 = 0 then (record_id % 9 + 1) || ' ' else '' end || case when record_id % 7 = 0 then 'zzqqx ' else '' end || left(w[2], 2) || substr(w[2], 4) || ' ' || left(w[-1], 4) query,
  case when record_id % 3 = 0 then (record_id * 31 % 10007)::double end near_x, case when record_id % 3 = 0 then (record_id * 37 % 9973)::double end near_z from w where len(w) > 1),
q1 as (select *, {_SPLIT.format("query")} w from q0),
q2 as (select *, {_used("w")} used from q1),
q3 as (select query_id, near_x, near_z, case when used > 0 then w[1:used] else []::varchar[] end num, w[used + 1:] rest from q2),
q4 as (select *, rest[({_used("rest")}) + 1:] rest2 from q3),
txt as (select 'name' k, record_id id, {FOLD.format("name")} f from r union all select 'commune', record_id, {FOLD.format("commune")} from r
  union all select 'q1', query_id, array_to_string(rest, ' ') from q4 union all select 'q2', query_id, array_to_string(rest2, ' ') from q4),
j as (select k, id, regexp_replace(regexp_replace(' ' || f || ' ', ' (n|d|a|rn|rd|c|vc|cr|e) ([0-9]{{1,4}}[a-z]? )', ' \\1\\2', 'g'), ' r([nd])([0-9]{{1,4}}[a-z]? )', ' \\1\\2', 'g') f from txt),
s as (select k, id, flatten(list_transform({_SPLIT.format("f")}, lambda x: string_split(case x {_SHORT} else x end, ' '))) w from j),
tok as (select k, id, case when len(list_filter(w, lambda x: x not in ({_STOP}))) > 0 then list_filter(w, lambda x: x not in ({_STOP})) else w end w from s),
bag0 as (select id record_id, unnest(w) token, case k when 'name' then 1.0 else 0.78 end weight, k field from tok where k in ('name', 'commune')
  union all select record_id, unnest(string_split(house, ' ')), 1.0, 'number' from r),
bag as (select record_id, token, max(weight) weight, max_by(field, (weight, field)) field from bag0 group by all),
stage as (select 1 st, 0 miss, query_id, t.w tokens, num from q4 join tok t on t.k = 'q1' and t.id = query_id where len(t.w) > 0
  union all select 2, 0, query_id, t.w, []::varchar[] from q4 join tok t on t.k = 'q2' and t.id = query_id where len(num) > 0 and len(t.w) > 0
  union all select 3, 1, query_id, t.w, num from q4 join tok t on t.k = 'q1' and t.id = query_id where len(t.w) > 1),
asked as (select st, miss, query_id, len(tokens) + len(num) n, array_to_string(tokens, ' ') folded, array_to_string(num, ' ') house, i q, case when i <= len(tokens) then tokens[i] else num[i - len(tokens)] end t, i = len(tokens) last, i > len(tokens) house_only
  from (select *, unnest(range(1, len(tokens) + len(num) + 1)) i from stage)),
vocab as (select token v, count(*) size from bag group by token),
ex as (select st, miss, query_id, n, folded, house, q, house_only, v token, size, case when v = t then 1.0 when house_only then null else greatest(
    case when (length(t) > 3 and right(t, 1) in ('s', 'x') and v = left(t, length(t) - 1)) or (length(t) > 4 and t like '%aux' and v = left(t, length(t) - 3) || 'al')
      or (length(t) > 2 and right(t, 1) not in ('s', 'x') and not regexp_matches(t, '^[0-9]') and v = t || 's') then 0.93 end,
    case when ((last and (not num or length(t) >= 3)) or (not num and length(t) >= 3)) and starts_with(v, t) then case when last then 0.68 + 0.22 * length(t) / length(v) else 0.5 + 0.2 * length(t) / length(v) end end,
    case when not num and (left(v, 1) = left(t, 1) or (left(v, 1) = t[2] and v[2] = left(t, 1))) then case when length(t) >= 4 and levenshtein(v, t) = 1 then 0.62 when length(t) >= 7 and levenshtein(v, t) = 2 then 0.45 end end,
    case when not num and last and length(t) >= 5 and length(v) > length(t) and left(v, 1) = left(t, 1) and levenshtein(left(v, length(t)), t) = 1 then 0.5 end) end quality
  from (select *, regexp_matches(t, '^[0-9]+$') num from asked), vocab),
good as (select * from ex where quality is not null),
sizes as (select st, miss, query_id, n, q, sum(size) size from good group by all),
seed as (select st, query_id, min_by(q, (size, q)) q from sizes group by st, miss, query_id, n having count(*) >= n - miss),
cand as (select distinct g.st, g.query_id, b.record_id from seed s join good g using (st, query_id, q) join bag b using (token)),
best as (select st, query_id, record_id, q, any_value(g.n) n, any_value(miss) miss, any_value(folded) folded, any_value(g.house) house, max(quality * weight) w, max_by(token, (quality * weight, token, field)) token, max_by(field, (quality * weight, token, field)) field
  from cand c join good g using (st, query_id) join bag b using (record_id, token) where not house_only or field = 'number' group by st, query_id, record_id, q),
sums as (select st, query_id, record_id, any_value(n) n, any_value(miss) miss, any_value(folded) folded, any_value(house) house, sum(w) w, count(*) hit, count(distinct token) filter (field = 'name') named from best group by all),
score as (select st, query_id, record_id, name, s.w / n * 1000 + case when len(t.w) > 0 then least(1.0, named / len(list_distinct(t.w))) else 0.0 end * 300 + case when folded <> '' and folded = array_to_string(t.w, ' ') then 220.0 else 0.0 end + boost
    + coalesce(exp(-sqrt(pow(x - near_x, 2) + pow(z - near_z, 2)) / 15000) * 180, 0.0) - (n - hit) * 380 + case when r.house = s.house then 80.0 else 0.0 end score
  from sums s join r using (record_id) join tok t on t.k = 'name' and t.id = record_id join q0 using (query_id) where hit >= n - miss),
turn as (select query_id, min(st) st from score group by query_id)
select query_id, record_id, place, round(score, 6) score from (select *, row_number() over (partition by query_id order by score desc, name, record_id) place from score join turn using (query_id, st)) where place <= 5"""


@query(SEARCH_SQL)
def search_index_queries(spark, d):
    """A query of every page against the stored index of all pages, five hits each."""
    records = materialise(page_records(spark, d), "search-pages")
    index = build_index(records, f"{shared_dir(spark)}/search-{uuid.uuid4().hex}", ("name", "commune"), "house")
    hits = search_many(index, page_queries(records), 5)
    return hits.select("query_id", "record_id", F.col("place").cast("long").alias("place"), F.round("score", 6).alias("score"))


@query(f"""
with v as (select distinct unnest({_SPLIT.format(FOLD.format(_TITLE))}) t from pages),
p as (select a.t asked, b.t word, levenshtein(a.t, b.t) edits from v a, v b where a.t <> b.t and not regexp_matches(a.t, '^[0-9]+$') and (left(a.t, 1) = left(b.t, 1) or (left(b.t, 1) = a.t[2] and b.t[2] = left(a.t, 1))))
select asked, word, edits from p where edits <= case when length(asked) < 4 then 0 when length(asked) < 7 then 1 else 2 end""")
def edit_pairs(spark, d):
    """Words of titles that each word of titles may be a mistyped form of: candidates share a string after deletions, the vocabulary is never scanned."""
    v = table(spark, d, "pages").select(F.explode(text.tokens(readers.page_title(F.col("html")))).alias("t")).distinct()
    asked, words = F.col("asked"), F.col("word")
    left = v.select(F.col("t").alias("asked"), F.explode(query_keys(F.col("t"), F.lit(False), F.lit(False))).alias("key")).where("not rlike(asked, '^[0-9]+$')")
    right = v.select(F.col("t").alias("word"), F.explode(word_keys(F.col("t"))).alias("key"))
    pairs = left.join(right, "key").where("asked <> word").select("asked", "word").distinct()
    swapped = (F.substring(words, 1, 1) == F.substring(asked, 2, 1)) & (F.substring(words, 2, 1) == F.substring(asked, 1, 1))
    near = pairs.where((F.substring(asked, 1, 1) == F.substring(words, 1, 1)) | swapped).withColumn("edits", text.bounded_edits(asked, words, 2))
    return near.where(F.col("edits") <= text.allowed_edits(F.length("asked"))).select("asked", "word", F.col("edits").cast("long").alias("edits"))
