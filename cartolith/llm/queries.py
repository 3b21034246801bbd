"""The registered queries of the pipeline operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontaminate import contaminated
from .fingerprints import edited_likeness
from .importance import importance_sample
from .jaccard_join import jaccard_components
from .mixing import mix
from .packing import Limits, packed
from .periodic_runs import periodic_runs, planted, run_digests
from .pii import pii
from .quality import judged
from .secret_scan import secret_scan
from .substring_dedup import substring_dedup
from .url_filter import url_filter
from .warc import round_trip


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), length=50)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number in a page's path is the id of the document that the page shows, whose first words its html holds; a page is good
    if that document's label says so."""
    pages = table(spark, sf_dir, "pages")
    labels = table(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int").alias("good"))
    made_from = pages.select("page_id", F.expr(r"try_cast(regexp_extract(url, '^[^?#]*/([0-9]+)', 1) as bigint)").alias("doc_id"))
    return url_filter(pages, made_from.join(labels, "doc_id").select("page_id", "good"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), size=4, percent=85).drop("row_key", "component_key")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), budget=1.5, cap=2).drop("row_key")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(periodic_runs(planted(table(spark, sf_dir, "documents"))))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain documents: no prompts, so every token bears loss."""
    import public_tokenizers

    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), Limits(tokens=1024, segments=64, loss=1024))


def op13_importance_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    sampled = importance_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), most=3, buckets=10_000, share=5, least_words=20, seed=42)
    return sampled.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_secret_scan": op2_secret_scan,
    "op3_fingerprints": op3_fingerprints,
    "op4_url_filter": op4_url_filter,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_pii": op6_pii,
    "op7_quality": op7_quality,
    "op8_mixing": op8_mixing,
    "op9_decontamination": op9_decontamination,
    "op10_warc": op10_warc,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_packing": op12_packing,
    "op13_importance_sample": op13_importance_sample,
}
#: DuckDB's \x20 and friends are read by RE2; a word is what WORD says.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES: dict[str, str] = {
    "op1_substring_dedup": f"""
with d as (select row_number() over () r, doc_id, {_WORDS} w from documents),
win as (select r, doc_id, unnest(range(1, len(w) - 48)) p, w from d where len(w) >= 50),
h as (select r, doc_id, p, md5(array_to_string(w[p:p+49], ' ')) k from win),
dup as (select r, p from (select r, p, doc_id, min(doc_id) over (partition by k) m from h) where m < doc_id),
gone as (select distinct r, p + i pos from dup, range(0, 50) t(i)),
g as (select r, list(pos) gl from gone group by r),
wrd as (select r, unnest(range(1, len(w) + 1)) pos, unnest(w) word from d),
kept as (select wrd.r, string_agg(word, ' ' order by wrd.pos) t, count(*) n from wrd anti join gone on wrd.r = gone.r and wrd.pos = gone.pos group by wrd.r)
select doc_id, len(w)::bigint n_words, (len(w) - coalesce(n, 0))::bigint n_removed, sha256(coalesce(t, '')) kept_sha256
from d left join kept using (r)
""",
    "op10_warc": """
with p as (select page_id, coalesce(html, '') h from pages),
q as (select page_id, strlen(h)::bigint payload_bytes, sha256(h) payload_digest, min(page_id) over (partition by h) f from p)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 100 and page_id > f then 'revisit' else 'response' end record_type,
  case when payload_bytes >= 100 and page_id > f then f end refers_to
from q
""",
    "op5_jaccard_join": rf"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as (select doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 2, 2)), lambda i: array_to_string(w[i:i+3], ' '))) sh from d where len(w) > 0),
f as (select doc_id, len(sh) n, unnest(sh) x from s),
c as (select a.doc_id a, b.doc_id b, count(*) k, any_value(a.n) na, any_value(b.n) nb from f a join f b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from c where 100 * k >= 85 * (na + nb - k)),
e as (select a x, b y from l union all select b, a from l),
r(x, y) as (select x, y from e union select r.x, e.y from r join e on r.y = e.x)
select d.doc_id, coalesce(len(s.sh), 0)::bigint n_shingles, least(d.doc_id, coalesce((select min(r.y) from r where r.x = d.doc_id), d.doc_id)) component_id
from d left join s using (doc_id)
""",
    "op13_importance_sample": r"""
with recursive crc(i, k, c) as (
  select range, 0, range::bigint from range(256)
  union all select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end from crc where k < 8),
steps as (select list(c order by i) t from crc where k = 8),
texts as (
  select 0 kind, row_number() over () r, doc_id, text from documents
  union all select 1, row_number() over (), null, text from benchmark),
w as (select kind, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from texts),
f as (
  select kind, r, array_to_string(w[i:i + k], ' ') x, count(*) n
  from w, unnest([0, 1, 2]) a(k), unnest(range(1, len(w) + 1 - k)) b(i) group by all),
codes as (
  select x, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, strlen(x) * 2, 2), lambda p: ('0x' || hex(x)[p:p + 1])::bigint)),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295::bigint) % 10000 b
  from (select distinct x from f), steps),
fb as (select kind, r, b, sum(n) n from f join codes using (x) group by all),
gains as (
  select b, floor(1000 * ln((t + 1) * (sum(s) over () + 10000) / ((s + 1) * (sum(t) over () + 10000)))) g
  from (select b, coalesce(sum(n) filter (kind = 0), 0)::double s, coalesce(sum(n) filter (kind = 1), 0)::double t from fb group by b)),
weights as (select r, sum(n)::bigint n_features, sum(n * g)::bigint weight from fb join gains using (b) where kind = 0 group by r),
scored as (
  select doc_id, len(w) n_words, coalesce(n_features, 0)::bigint n_features, coalesce(weight, 0)::bigint weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || doc_id)[1:8])::bigint + 0.5::double) / 4294967296::double))))::bigint score
  from w left join weights using (r) where kind = 0),
ranked as (select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id) k, sum((n_words >= 20)::int) over () able from scored)
select doc_id, n_features, weight, score, case when n_words >= 20 and k <= floor(5 * able / 100) then k end rank from ranked
""",
}
