"""Place search: an inverted index as tables, typo-tolerant expansion, field-weighted scores, category browse."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from cartolith.functions import taxonomy, text

# fixed values: weight of the field a token was found in
FIELD_WEIGHT = {"name": 1.0, "alias": 0.9, "street": 0.72, "commune": 0.78, "code": 0.85, "category": 0.6, "number": 1.0}

# fixed values: qualities of a word that a query word may stand for
EXACT, VARIANT, ONE_EDIT, TWO_EDITS, TYPED_EDIT = 1.0, 0.93, 0.62, 0.45, 0.5
LAST_PREFIX, INNER_PREFIX = (0.68, 0.22), (0.5, 0.2)
# fixed values: parts of a score
TEXT, COVERAGE, WHOLE_NAME, MISS, NEARNESS, NEARNESS_METRES = 1000, 300, 220.0, 380, 180, 15000
CATEGORY_BONUS, STOP_PENALTY, BRAND_SHARE, SAME_PLACE_METRES = 240.0, 400.0, 0.3, 150.0


def postings(records: DataFrame, fields: list[str]) -> DataFrame:
    """record_id, token, field, weight: the best field of each token of a record. Spread or partition by token to serve."""
    weight = F.create_map(*[F.lit(x) for f in fields for x in (f, FIELD_WEIGHT[f])])
    bags = F.array(*[F.struct(F.lit(f).alias("field"), text.search_tokens(F.col(f)).alias("tokens")) for f in fields])
    flat = records.select("record_id", F.explode(bags).alias("b")).select("record_id", "b.field", F.explode("b.tokens").alias("token")).withColumn("weight", weight[F.col("field")])
    return flat.groupBy("record_id", "token").agg(F.max_by("field", F.struct("weight", "field")).alias("field"), F.max("weight").alias("weight"))


def expand(vocabulary: DataFrame, token: str, last: bool) -> DataFrame:
    """token, quality of every word of the vocabulary that a query token may stand for."""
    t, w = F.lit(token), F.col("token")
    numeric, n = token.isdigit(), len(token)
    edits = 0 if numeric else 0 if n < 4 else 1 if n < 7 else 2
    ratio = F.lit(float(n)) / F.length(w)
    options = [F.when(w == t, EXACT), F.when(F.array_contains(text.token_variants(t), w), VARIANT)]
    base, gain = LAST_PREFIX if last else INNER_PREFIX
    # the beginning of a number is only tried as the last word
    if (last and (not numeric or n >= 3)) or (not numeric and n >= 3):
        options.append(F.when(w.startswith(token) & (w != t), base + ratio * gain))
    if edits:
        gate = (F.substring(w, 1, 1) == token[0]) | ((F.substring(w, 1, 1) == token[1:2]) & (F.substring(w, 2, 1) == token[0]))
        d = text.bounded_edits(w, t, edits)
        options.append(F.when(F.length(w).between(n - edits, n + edits) & gate & (d > 0), F.when(d == 1, ONE_EDIT).when(d <= edits, TWO_EDITS)))
        if last and n >= 5:
            typed = F.substring(w, F.lit(1), F.lit(n))
            options.append(F.when((F.length(w) > n) & (F.substring(w, 1, 1) == token[0]) & (text.bounded_edits(typed, t, 1) == 1), TYPED_EDIT))
    quality = F.greatest(*options) if len(options) > 1 else options[0]
    return vocabulary.select("token", quality.alias("quality")).where("quality is not null")


def search(records: DataFrame, index: DataFrame, query: str, near: tuple[float, float] | None = None, limit: int = 10, misses: int = 0) -> DataFrame:
    """record_id, score of the best matches; records: record_id, name, boost, x, z; index: postings().

    A record must hold every word of the query but ``misses``; its score adds the mean weighted quality, the share of
    its name that is matched, a bonus for the whole name, its boost, and nearness."""
    words = query_tokens(query)
    if not words:
        return records.select("record_id", F.lit(0.0).alias("score")).limit(0)
    vocabulary = index.select("token").distinct()
    wanted = None
    for k, word in enumerate(words):
        part = expand(vocabulary, word, k == len(words) - 1).withColumn("q", F.lit(k))
        wanted = part if wanted is None else wanted.unionByName(part)
    hits = index.join(wanted, "token").withColumn("w", F.col("quality") * F.col("weight"))
    best = hits.groupBy("record_id", "q").agg(F.max(F.struct("w", "token", "field")).alias("b"))
    named = F.collect_set(F.when(F.col("b.field") == "name", F.col("b.token")))
    found = best.groupBy("record_id").agg(F.sum("b.w").alias("sum"), F.count(F.lit(1)).alias("n"), F.size(named).alias("named")).where(F.col("n") >= len(words) - misses)
    d = records.join(found, "record_id")
    mine = text.search_tokens(F.col("name"))
    size = F.size(F.array_distinct(mine))
    cover = F.when(size > 0, F.least(F.lit(1.0), F.col("named") / size)).otherwise(0.0)
    whole = F.when(F.array_join(mine, " ") == " ".join(words), WHOLE_NAME).otherwise(0.0)
    score = F.col("sum") / len(words) * TEXT + cover * COVERAGE + whole + F.col("boost") - (len(words) - F.col("n")) * MISS
    if near:
        score = score + F.exp(-F.hypot(F.col("x") - near[0], F.col("z") - near[1]) / NEARNESS_METRES) * NEARNESS
    return d.select("record_id", score.alias("score"), "name").orderBy(F.desc("score"), "name", "record_id").limit(limit).select("record_id", "score")


def query_tokens(query: str) -> list[str]:
    """Search tokens of a query, on the driver: queries are short literals."""
    import re
    import unicodedata

    plain = "".join(c for c in unicodedata.normalize("NFD", query.lower().replace("œ", "oe").replace("æ", "ae")) if not unicodedata.combining(c))
    raw = re.sub("[^a-z0-9&]+", " ", plain).split()
    out, k = [], 0
    while k < len(raw):
        road = re.fullmatch(r"(rn|rd)(\d{1,4}[a-z]?)", raw[k])
        if raw[k] in text.ROAD_PREFIXES and k + 1 < len(raw) and re.fullmatch(r"\d{1,4}[a-z]?", raw[k + 1]):
            out.append(raw[k].replace("rn", "n").replace("rd", "d") + raw[k + 1])
            k += 1
        elif road:
            out.append(road[1][1] + road[2])
        else:
            out += text.ABBREVIATIONS.get(raw[k], raw[k]).split()
        k += 1
    return [w for w in out if w not in text.STOP_WORDS] or out


def browse_category(records: DataFrame, category: str, near: tuple[float, float], radius: float, limit: int, least: int = 3, far: float = 30_000.0, few: int = 12) -> DataFrame:
    """record_id, score, metres of the category's family nearest to a point. With fewer than ``least`` in the
    radius, the nearest ``few`` within the larger of four radii and ``far`` are shown instead."""
    members = records.where(F.col("category").isin(*taxonomy.FAMILIES.get(category, (category,))))
    d = members.withColumn("metres", F.hypot(F.col("x") - near[0], F.col("z") - near[1])).where(F.col("metres") <= max(4 * radius, far))
    shown = d.where(F.col("metres") <= radius)
    if shown.limit(least).count() < least:
        shown, limit = d, min(limit, few)
    score: Column = F.floor(F.lit(10000) - F.col("metres") / 10 + 0.5)
    return shown.orderBy("metres", "name", "record_id").limit(limit).select("record_id", score.cast("double").alias("score"), F.col("metres"))


def distinct_hits(hits: DataFrame, limit: int, radius: float = SAME_PLACE_METRES) -> DataFrame:
    """The first limit hits (record_id, name, x, z, score, best first), leaving out any that is near a kept one of the
    same folded name. The driver looks at a few times limit rows at a time, the best ones that no kept hit rules out, until
    limit hits are kept or the rows are used up."""
    columns = ["record_id", "name", "x", "z", "score"]
    order = ["rank", "name", "record_id", "x", "z"]
    d = hits.select(*columns).withColumn("key", text.fold_text(F.col("name"))).withColumn("rank", F.coalesce(-F.col("score").cast("double"), F.lit(float("inf"))))
    types, kept, rest = {f.name: f.dataType for f in d.schema}, [], d
    while len(kept) < limit:
        top = rest.orderBy(*order).limit(8 * limit).collect()
        for hit in top:
            if len(kept) < limit and not any(_near(hit, k, radius) for k in kept):
                kept.append(hit)
        if len(top) < 8 * limit:
            break
        # what comes after, without what the kept hits rule out
        after = F.struct(*order) > F.struct(*[F.lit(top[-1][c]).cast(types[c]).alias(c) for c in order])
        ruled = hits.sparkSession.createDataFrame([(k["key"], k["x"], k["z"]) for k in kept], StructType([StructField(n, types[c]) for n, c in (("_key", "key"), ("_x", "x"), ("_z", "z"))]))
        near = (F.col("key") == F.col("_key")) & (F.hypot(F.col("x") - F.col("_x"), F.col("z") - F.col("_z")) < radius)
        rest = d.where(after).join(F.broadcast(ruled), near, "left_anti")
    return hits.sparkSession.createDataFrame([tuple(k[c] for c in columns) for k in kept], StructType([StructField(c, types[c]) for c in columns]))


def _near(a, b, radius: float) -> bool:
    if any(r[c] is None for r in (a, b) for c in ("key", "x", "z")):
        return False
    return a["key"] == b["key"] and math.hypot(a["x"] - b["x"], a["z"] - b["z"]) < radius


def with_category(hits: DataFrame, wanted: tuple[str, ...], bonus: float = CATEGORY_BONUS, stop_penalty: float = STOP_PENALTY) -> DataFrame:
    """Hits of a wanted category gain, stops that take the name of what they serve lose."""
    families = {c for w in wanted for c in taxonomy.FAMILIES.get(w, (w,))}
    change = F.when(F.col("category").isin(*families), bonus).when(F.col("category") == "bus_stop", -stop_penalty).otherwise(0.0)
    return hits.withColumn("score", F.col("score") + change)


def merged_category(hits: DataFrame, members: DataFrame, near: tuple[float, float] | None, words: int, share: float = BRAND_SHARE) -> DataFrame:
    """A category browse with the hits of the query's words: record_id, score.

    hits: record_id, exact, named, category, boost; members: record_id, boost, x, z of the category. Whole-name
    hits outside the category come first; members follow nearest first, those named like the query ahead if
    fewer than ``share`` of the category are (a brand rather than a generic word)."""
    named = hits.where("named").select("record_id", F.lit(True).alias("hit"))
    d = members.join(named, "record_id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    total, own = d.agg(F.count(F.lit(1)), F.count_if("hit")).first()
    brand = 1500.0 if total and own / total < share else 0.0
    far = F.hypot(F.col("x") - near[0], F.col("z") - near[1]) / 1000 * 12 if near else F.lit(0.0)
    listed = d.select("record_id", (F.when(F.col("hit"), brand).otherwise(0.0) + 2000 + F.col("boost") * 0.2 - far).alias("score"))
    whole = hits.where(F.col("named") & F.col("exact") & ((F.col("category") == "commune") | F.lit(words >= 2)))
    whole = whole.join(members.select("record_id"), "record_id", "left_anti").select("record_id", (F.col("boost") + 4000).alias("score"))
    return whole.unionByName(listed)
