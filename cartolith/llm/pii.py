"""Personal data: fixed patterns, and identifiers found by bootstrapped contexts.

The fixed patterns give the base spans. Words with four or more digits are candidates; a candidate
that overlaps a base span is a seed. A lexical pattern is the whole word before or after a candidate with the
candidate's shape (digits as 9, letters as a). Patterns and instances form a weighted graph that is
scored in turns: a pattern by the share of its weight that lies on instances believed in, an instance
by the chance that at least one of its patterns is right; seeds stay at 1. A pattern counts once it has enough
instances that are believed in, seeds or found ones, and a high score; so found identifiers induce
patterns in their turn. Scores only rise, and the turns end when they stand still. Candidates that such patterns
lead to, and that no base span touches, are added as ``found``.

The graph is held as tables of distinct pattern-instance edges; it is summed before it is shuffled
and never gathered. Instances are told apart by a digest of the whole word, patterns by one of both words.

Null texts count as empty; an empty table gives no rows; repeated rows are judged alike; very long texts and words are
read whole. Columns of redact() may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans as S
from .common import discard, materialise

KINDS = ("email", "ip", "card", "phone", "found")
# fixed values: the base patterns. \G lets a match begin where the last one ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

CANDIDATE = r"(?<!\S)(?=(?:[^\s0-9]*+[0-9]){4})\S++"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def small_parts(m: Column) -> Column:
    """Whether each dotted part of an address is at most 255; leading zeros count for nothing."""
    bare = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(bare, lambda p: (F.length(p) < 3) | (F.when(F.length(p) == 3, p.cast("int") <= 255).otherwise(F.lit(False))))


def luhn(m: Column) -> Column:
    """Whether 14 to 19 digits pass the Luhn check."""
    digits = F.transform(F.split(F.reverse(_digits(m)), ""), lambda c: c.cast("int"))
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2))
    total = F.aggregate(doubled, F.lit(0), lambda a, d: a + d)
    return F.when(F.length(_digits(m)).between(14, 19), total % 10 == 0).otherwise(F.lit(False))


def base_spans(documents: DataFrame) -> DataFrame:
    """The documents with base: array of (start, kind, stop), sorted; kind indexes KINDS."""
    checks = (
        (EMAIL, lambda m, i: F.lit(True)),
        (IP, lambda m, i: small_parts(m)),
        (CARD, lambda m, i: luhn(m)),
        (PHONE, lambda m, i: F.length(_digits(m)).between(10, 15)),
    )
    d, parts = documents.withColumn("_t", F.coalesce("text", F.lit(""))), []
    for k, (pattern, sound) in enumerate(checks):
        d = d.withColumn(f"_m{k}", S.found(F.col("_t"), pattern))
        d = d.withColumn(f"_s{k}", S.starts(F.col(f"_m{k}"), S.gaps(F.col("_t"), pattern, F.col(f"_m{k}"))))
        parts.append(S.spans(k, F.col(f"_m{k}"), F.col(f"_s{k}"), sound))
    return d.withColumn("base", F.array_sort(F.concat(*parts))).drop("_t", *[f"_{x}{k}" for x in "ms" for k in range(4)])


def candidates(documents: DataFrame) -> DataFrame:
    """The documents with cand: array of (start, stop, left, right, core, shape, seed); needs base."""
    d = documents.withColumn("_t", F.coalesce("text", F.lit(""))).withColumn("_m", S.found(F.col("_t"), CANDIDATE))
    d = d.withColumn("_g", S.gaps(F.col("_t"), CANDIDATE, F.col("_m"))).withColumn("_s", S.starts(F.col("_m"), F.col("_g")))
    last = lambda gap: F.lower(F.regexp_extract(gap, r"(?<!\S)(\S++)\s++$", 1))
    first = lambda gap: F.lower(F.regexp_extract(gap, r"^\s++(\S++)", 1))

    def one(m: Column, i: Column) -> Column:
        start = F.element_at(F.col("_s"), i + 1)
        stop = start + F.length(m)
        seed = F.exists("base", lambda b: (b["start"] < stop) & (b["stop"] > start))
        around = (last(F.element_at(F.col("_g"), i + 1)).alias("left"), first(F.element_at(F.col("_g"), i + 2)).alias("right"))
        return F.struct(start.alias("start"), stop.alias("stop"), *around, F.md5(F.lower(m)).alias("core"), shape(F.lower(m)).alias("shape"), seed.alias("seed"))

    return d.withColumn("cand", F.transform("_m", one)).drop("_t", "_m", "_g", "_s")


def shape(core: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(core, "[0-9]", "9"), r"\p{L}++", "a")


def bootstrap(cands: DataFrame, support: int = 3, least: float = 0.6, prior: float = 2.0) -> DataFrame:
    """Cores of the instances that high-confidence patterns lead to: core, score.

    cands: left, core, seed and, where known, right and shape, one row per occurrence. Patterns need ``support`` distinct
    instances of a score of ``least``, and such a score themselves; ``prior`` is weight against every pattern."""
    looks = F.col("shape") if "shape" in cands.columns else shape(F.col("core"))
    sides = [F.when(F.col(c) != "", F.md5(F.concat_ws(" ", F.lit(c), c, looks))) for c in ("left", "right") if c in cands.columns]
    each = cands.select("core", "seed", F.explode(F.array(*sides)).alias("pattern")).where("pattern is not null")
    edges = materialise(each.groupBy("pattern", "core").agg(F.log1p(F.count(F.lit(1)).cast("double")).alias("weight"), F.max("seed").alias("seed")), "op6-edges")
    # only patterns that can reach the support matter
    rich = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("k"), F.sum("weight").alias("total")).where(F.col("k") >= support).select("pattern", "total")
    graph = materialise(edges.join(materialise(rich, "op6-rich"), "pattern"), "op6-graph")
    discard(edges)
    believed = graph.where("seed").select("core").distinct().withColumn("score", F.lit(1.0))
    before, old = None, []
    while True:
        known = graph.join(believed, "core")
        patterns = known.groupBy("pattern").agg((F.sum(F.col("weight") * F.col("score")) / (F.first("total") + prior)).alias("p"), F.count_if(F.col("score") >= least).alias("k"))
        patterns = materialise(patterns.where((F.col("k") >= support) & (F.col("p") >= least)).select("pattern", "p"), "op6-patterns")
        reached = graph.join(patterns, "pattern").groupBy("core").agg(F.max(F.col("seed").cast("double")).alias("seed"), F.sum(F.log1p(-F.least("p", F.lit(0.999)))).alias("miss"))
        scores = materialise(reached.select("core", "seed", F.greatest("seed", 1 - F.exp("miss")).alias("score")), "op6-scores")
        discard(patterns, *old)
        old = [scores]
        count, total = scores.agg(F.count(F.lit(1)), F.coalesce(F.sum("score"), F.lit(0.0))).first()
        # scores never fall and are at most 1: they come to rest
        if before is not None and count == before[0] and total - before[1] <= 1e-4 * max(1, count):
            return scores.where(F.col("score") >= least).select("core", "score")
        before = count, total
        seeds = graph.where("seed").select("core", F.lit(1.0).alias("score"))
        believed = seeds.union(scores.select("core", "score")).groupBy("core").agg(F.max("score").alias("score"))


def pii_spans(documents: DataFrame) -> DataFrame:
    """doc_id, row_key (hash of the text), base, extra: the spans of each row."""
    d = documents.select("doc_id", "text", F.xxhash64("text").alias("row_key"))
    d = materialise(candidates(base_spans(d)).select("doc_id", "row_key", "base", "cand"), "op6-rows")
    cands = d.where("size(cand) > 0").select("doc_id", "row_key", F.explode("cand").alias("c")).select("doc_id", "row_key", "c.*")
    good = bootstrap(cands.select("left", "right", "shape", "core", "seed"))
    fresh = (
        cands.where("not seed").join(good.select("core"), "core").groupBy("doc_id", "row_key")
        .agg(F.array_sort(F.collect_set(F.struct(F.col("start"), F.lit(len(KINDS) - 1).alias("kind"), F.col("stop")))).alias("extra"))
    )
    joined = d.select("doc_id", "row_key", "base").alias("d").join(fresh.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.row_key") == F.col("f.row_key")), "left")
    return joined.select("d.doc_id", "d.row_key", "base", F.coalesce("extra", F.array().cast(S.NO_SPANS)).alias("extra"))


def pii(documents: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found."""
    return pii_spans(documents).select(
        "doc_id",
        *[S.count_kind(F.col("base"), k).alias(f"n_{KINDS[k]}") for k in range(4)],
        F.sha2(S.written(F.col("base"), KINDS), 256).alias("base_sha256"),
        S.written(F.array_sort(F.concat("base", "extra")), KINDS).alias("spans"),
        F.size("extra").cast("long").alias("n_found"),
    )


def redact(documents: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets; other columns as they are.

    Overlapping spans are replaced as one, by the kind that starts first."""
    found = pii_spans(documents).where("size(base) + size(extra) > 0").dropDuplicates(["doc_id", "row_key"])
    found = found.select(F.struct("doc_id", "row_key").alias("key"), F.array_sort(F.concat("base", "extra")).alias("spans"))
    # the row travels as one column, beside which any name is free; a struct as key lets null ids meet
    rows = documents.select(F.struct(*documents.columns).alias("row"), F.struct("doc_id", F.xxhash64("text").alias("row_key")).alias("key"))
    joined = rows.join(found, rows["key"].eqNullSafe(found["key"]), "left")
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.col("row.text")

    def step(s: Column, x: Column) -> Column:
        fresh = F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.element_at(names, x["kind"] + 1))
        return F.struct(F.greatest(s["at"], x["stop"]).alias("at"), F.when(x["start"] >= s["at"], fresh).otherwise(s["out"]).alias("out"))

    whole = F.aggregate(F.col("spans"), zero, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    clean = F.when(F.col("spans").isNull(), text).otherwise(whole)
    return joined.select(*[clean.alias(c) if c.lower() == "text" else F.col("row").getField(c).alias(c) for c in documents.columns])
