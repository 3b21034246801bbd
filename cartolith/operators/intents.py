"""Category phrases in queries and labels: which categories words ask for, and which words they use up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolith.functions import names, text
from cartolith.plans.tables import sent

# fixed values: words after which a label says where a place is, not what it is
PLACE_PARTICLES = ("de", "du", "des", "d")


def phrase_table(phrases: DataFrame) -> DataFrame:
    """Phrases (phrase, category) as words, with their rank: more words first, then longer ones, then by phrase and category."""
    words = F.filter(F.split(names.category_text(F.col("phrase")), " "), lambda w: w != "")
    d = phrases.select(words.alias("words"), "category").where(F.size("words") > 0).distinct()
    d = d.withColumn("rank", F.struct((-F.size("words")).alias("n"), (-F.length(F.array_join("words", " "))).alias("l"), F.array_join("words", " ").alias("w"), F.col("category").alias("c")))
    return d


def _whole(token: Column, word: Column) -> Column:
    """Equal, or one the plural of the other."""
    return (token == word) | (token == F.concat(word, F.lit("s"))) | (F.concat(token, F.lit("s")) == word)


def matches(queries: DataFrame, phrases: DataFrame, prefix: bool = True, least: int = 4) -> DataFrame:
    """query_id, tokens, category, start, n, stage, rank: every place where a phrase stands in a query; stage 1 if its last word is only begun.

    queries: query_id, tokens. A phrase meets a query where its first word does: queries are dealt out by token (and its singular and plural),
    phrases by first word (and, of one-word phrases, by its beginnings), so both sides of the join are plain keys. Queries are never
    the side that passes through the driver."""
    p = phrase_table(phrases).withColumn("key", F.get("words", F.lit(0))).withColumn("begun", F.lit(False))
    if prefix:
        word = F.get("words", F.lit(0))
        starts = p.where((F.size("words") == 1) & (F.length(word) > least)).withColumn("key", F.explode(F.transform(F.sequence(F.lit(least), F.length(word) - 1), lambda i: F.substring(word, F.lit(1), i)))).withColumn("begun", F.lit(True))
        p = p.unionByName(starts)
    q = queries.select("query_id", "tokens", F.posexplode("tokens").alias("start", "token"))
    forms = F.array(F.struct("token", F.lit(False).alias("exact")), F.struct(F.concat("token", F.lit("s")).alias("token"), F.lit(False).alias("exact")), F.struct(F.when(F.col("token").endswith("s"), F.substring("token", F.lit(1), F.length("token") - 1)).alias("token"), F.lit(False).alias("exact")))
    q = q.withColumn("key", F.explode(F.array_distinct(F.transform(forms, lambda f: f["token"])))).where("key is not null")
    d = q.join(sent(p, "phrases"), "key").where(F.col("start") + F.size("words") <= F.size("tokens"))
    # the beginning of a word is what was typed, not its plural
    d = d.where(~F.col("begun") | (F.col("key") == F.col("token")) & (F.col("start") == F.size("tokens") - 1))
    part = F.slice("tokens", F.col("start") + 1, F.size("words"))
    last = F.size("words") - 1
    at_end = F.col("start") + F.size("words") == F.size("tokens")
    pairs = F.zip_with(part, F.col("words"), lambda t, w: _whole(t, w))
    begun_last = at_end & (F.length(F.get(part, last)) >= least) & F.get("words", last).startswith(F.get(part, last))
    but_last = F.forall(F.slice(pairs, F.lit(1), F.greatest(last, F.lit(0))), lambda x: x)
    whole, begun = F.forall(pairs, lambda x: x), but_last & begun_last
    stage = F.when(whole, 0).when(F.lit(prefix) & begun, 1)
    d = d.withColumn("stage", stage).where("stage is not null")
    # a whole word is read in both passes; the first counts
    return d.select("query_id", "tokens", "category", "start", F.size("words").alias("n"), "stage", "rank").distinct()


def intents(queries: DataFrame, phrases: DataFrame, prefix: bool = True) -> DataFrame:
    """query_id, tokens, found: array of (category, start, n) in the order in which phrases win: whole words before beginnings, long phrases before
    short ones, from the left. A phrase takes words that no other one has taken, unless it stands on just the same words. Each category comes once.

    Queries of the same tokens are answered once."""
    asked = queries.select("tokens").where(F.size("tokens") > 0).distinct()
    m = matches(asked.select(F.col("tokens").alias("query_id"), "tokens"), phrases, prefix)
    order = F.array_sort(F.collect_list(F.struct("stage", "rank", "start", "n", "category")))
    d = m.groupBy(F.col("query_id").alias("tokens")).agg(order.alias("m"))
    none = F.struct(
        F.array().cast("array<int>").alias("used"), F.array().cast("array<string>").alias("spans"), F.array().cast("array<struct<category:string,start:int,n:int>>").alias("found"),
    )

    def step(s: Column, x: Column) -> Column:
        mine = F.sequence(x["start"], x["start"] + x["n"] - 1)
        span = F.concat_ws(":", x["start"].cast("string"), x["n"].cast("string"))
        free = F.array_contains(s["spans"], span) | ~F.arrays_overlap(s["used"], mine)
        new = ~F.exists(s["found"], lambda f: f["category"] == x["category"])
        item = F.array(F.struct(x["category"].alias("category"), x["start"].alias("start"), x["n"].alias("n")))
        taken = F.struct(F.array_union(s["used"], mine).alias("used"), F.array_union(s["spans"], F.array(span)).alias("spans"), F.when(new, F.concat(s["found"], item)).otherwise(s["found"]).alias("found"))
        return F.when(free, taken).otherwise(s)

    found = d.select("tokens", F.aggregate("m", none, step, lambda s: s["found"]).alias("found"))
    return queries.join(sent(found, "intents"), "tokens", "left").select(*queries.columns, "found").withColumn("found", F.coalesce("found", F.array().cast("array<struct<category:string,start:int,n:int>>")))


def label_category(labels: DataFrame, phrases: DataFrame) -> DataFrame:
    """query_id, category: what a label says a place is: the first intent before the first particle, or of several words across it; null without."""
    found = intents(labels, phrases, prefix=False)
    particle = F.array_min(F.filter(F.transform("tokens", lambda t, i: F.when((i > 0) & t.isin(*PLACE_PARTICLES), i)), lambda i: i.isNotNull()))
    cut = F.coalesce(particle, F.size("tokens"))
    fits = F.filter("found", lambda f: (f["start"] + f["n"] - 1 < cut) | (f["start"] < cut) & (f["n"] > 1))
    return found.select("query_id", F.get(fits, F.lit(0))["category"].alias("category"))


def pure(found: Column, tokens: Column) -> Column:
    """Whether a query only names categories: every meaningful word is used up by an intent."""
    used = F.flatten(F.transform(found, lambda f: F.sequence(f["start"], f["start"] + f["n"] - 1)))
    rest = F.filter(F.transform(tokens, lambda t, i: F.when(~F.array_contains(used, i) & ~t.isin(*text.STOP_WORDS), t)), lambda t: t.isNotNull())
    return (F.size(found) > 0) & (F.size(rest) == 0)


def house_numbers(tokens: Column) -> Column:
    """Tokens of a query that are house numbers where a street follows: these only look in the number field."""
    number = r"^[0-9]{1,4}(bis|ter|[a-d])?$"
    return F.filter(F.transform(tokens, lambda t, i: F.when(t.rlike(number) & (i < F.size(tokens) - 1), t)), lambda t: t.isNotNull())


def nature_category(rows: DataFrame, known: DataFrame, phrases: DataFrame) -> DataFrame:
    """query_id, category: by the folded nature, else by the words of the free text, else by those of the nature itself.
    rows: query_id, nature, label; known: nature (folded), category."""
    words = lambda c: F.filter(F.split(names.category_text(F.coalesce(F.col(c), F.lit(""))), " "), lambda w: w != "")
    direct = rows.join(known.select(F.col("nature").alias("_n"), F.col("category").alias("_direct")), names.nature_key(F.col("nature")) == F.col("_n"), "left")
    by = lambda c, name: label_category(rows.select("query_id", words(c).alias("tokens")), phrases).withColumnRenamed("category", name)
    d = direct.join(by("label", "_label"), "query_id", "left").join(by("nature", "_nature"), "query_id", "left")
    return d.select("query_id", F.coalesce("_direct", "_label", "_nature").alias("category"))
