"""Audit tables: prefix counts, tallies, residuals, funnels, reconciliations, freshness, and strata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def name_counts(rows: DataFrame, name: str, commune: str, prefix: int = 4) -> DataFrame:
    """One row: rows, named, unnamed, communes, prefixes: how many distinct communes and commune prefixes there are."""
    has = F.coalesce(F.trim(name) != "", F.lit(False))
    return rows.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(has).alias("named"), F.count_if(~has).alias("unnamed"), F.count_distinct(commune).alias("communes"),
        F.count_distinct(F.substring(F.col(commune).cast("string"), 1, prefix)).alias("prefixes"),
    )


def ratio(part: Column, whole: Column) -> Column:
    """part of whole; 0 where there is no whole."""
    return F.when(whole > 0, part / whole).otherwise(0.0)


def tallies(rows: DataFrame, kind: str, fields: list[str], origin: Column) -> DataFrame:
    """kind, field, value, ours, theirs: rows by each field's value, split by whether origin holds."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    d = rows.select(F.col(kind), origin.alias("_o"), F.explode(pairs).alias("p")).where("p.value is not null")
    return d.groupBy(kind, F.col("p.field").alias("field"), F.col("p.value").alias("value")).agg(F.count_if(F.col("_o")).alias("ours"), F.count_if(~F.col("_o")).alias("theirs"))


def worst(rows: DataFrame, by: list[str], key: str, metres: str) -> DataFrame:
    """The largest residual of each group (of all for no column), where it is, and the number of samples."""
    return rows.groupBy(*by).agg(F.max_by(key, F.struct(metres, -F.col(key))).alias(key), F.max(metres).alias(metres), F.count(F.lit(1)).alias("samples"))


def residuals(rows: DataFrame) -> DataFrame:
    """Adds residual: input less accepted, merged, excluded, invalid and outside; null where any of them is unknown."""
    fates = ("accepted", "merged", "excluded", "invalid", "outside")
    return rows.withColumn("residual", F.col("input") - sum((F.col(n) for n in fates[1:]), F.col(fates[0])))


def family_totals(rows: DataFrame) -> DataFrame:
    """family, layers, input, explained, residual, unknown of residuals(): layers with unknown counts are counted, not summed."""
    known = F.col("residual").isNotNull()
    return residuals(rows).groupBy("family").agg(
        F.count(F.lit(1)).alias("layers"), F.sum(F.when(known, F.col("input"))).alias("input"), F.sum(F.when(known, F.col("input") - F.col("residual"))).alias("explained"),
        F.sum("residual").alias("residual"), F.count_if(~known).alias("unknown"),
    )


def cross_checks(declared: DataFrame, measured: DataFrame, blocking: Column) -> DataFrame:
    """check_id, declared, measured, verdict: agree, or blocking or advisory where the numbers differ or one side is missing."""
    d = declared.select("check_id", F.col("n").alias("declared")).join(measured.select("check_id", F.col("n").alias("measured")), "check_id", "full_outer")
    same = F.coalesce(F.col("declared") == F.col("measured"), F.lit(False))
    return d.withColumn("verdict", F.when(same, "agree").when(blocking, "blocking").otherwise("advisory"))


def stale(sources: DataFrame, store: DataFrame) -> DataFrame:
    """Sources that are newer than the store built from them, or never stored; sources: name, at; store: name, built."""
    return sources.join(store, "name", "left").where(F.col("built").isNull() | (F.col("at") > F.col("built"))).select("name", F.col("built").isNull().alias("never"))


def funnel(rows: DataFrame, by: list[str], header: Column, blank: Column, sound: Column, inside: Column, key: Column) -> DataFrame:
    """Raw lines by fate, and closed, whether they add up: raw, headers, blanks, data, invalid, outside, kept, distinct keys."""
    data = ~header & ~blank
    g = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("raw"), F.count_if(header).alias("headers"), F.count_if(blank).alias("blanks"), F.count_if(data).alias("data"),
        F.count_if(data & ~sound).alias("invalid"), F.count_if(data & sound & ~inside).alias("outside"), F.count_if(data & sound & inside).alias("kept"),
        F.count_distinct(F.when(data & sound & inside, key)).alias("distinct_keys"),
    )
    closed = (F.col("raw") == F.col("headers") + F.col("blanks") + F.col("data")) & (F.col("data") == F.col("invalid") + F.col("outside") + F.col("kept"))
    return g.withColumn("closed", closed)


def scan_accounts(rows: DataFrame, by: str, accepted: Column, repeated: Column, method: Column, methods: tuple[str, ...]) -> DataFrame:
    """Received, accepted, repeated and failed rows of each section, and how many each geocoding method placed."""
    return rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("received"), F.count_if(accepted & ~repeated).alias("accepted"), F.count_if(accepted & repeated).alias("repeated"),
        *[F.count_if(accepted & ~repeated & (method == m)).alias(f"by_{m}") for m in methods], F.count_if(accepted & ~repeated & method.isNull()).alias("failed"),
    )


def tile_observations(rows: DataFrame, minor: Column, inside: Column, away: Column, anchors: int = 40) -> DataFrame:
    """tile_id, features, minor_share of its roads, and of the first anchors by id (a stated number) how many lie outside and how far away the farthest is."""
    line = Window.partitionBy("tile_id").orderBy("id")
    d = rows.withColumn("_n", F.row_number().over(line))
    road, near = F.col("kind") == "road", F.col("_n") <= anchors
    return d.groupBy("tile_id").agg(
        F.count(F.lit(1)).alias("features"), ratio(F.count_if(road & minor), F.count_if(road)).alias("minor_share"),
        F.count_if(near & ~inside).alias("outside"), F.max(F.when(near, away)).alias("farthest"),
    )


def stratum_verdicts(observed: DataFrame, expected: DataFrame, most_bytes: int) -> DataFrame:
    """stratum, missing kinds (sorted), oversize tiles, outside anchors, and passed; observed: stratum, kind, bytes, outside; expected: stratum, kind."""
    o = observed.groupBy("stratum").agg(F.collect_set("kind").alias("have"), F.count_if(F.col("bytes") > most_bytes).alias("oversize"), F.sum("outside").alias("outside"))
    e = expected.groupBy("stratum").agg(F.collect_set("kind").alias("want"))
    none = F.array().cast("array<string>")
    d = e.join(o, "stratum", "left").select("stratum", F.array_sort(F.array_except("want", F.coalesce("have", none))).alias("missing"), F.coalesce("oversize", F.lit(0)).alias("oversize"), F.coalesce("outside", F.lit(0)).alias("outside"))
    return d.withColumn("passed", (F.size("missing") == 0) & (F.col("oversize") == 0) & (F.col("outside") == 0))


def layer_family(source: DataFrame, canonical: DataFrame, drops: DataFrame, partial: Column) -> DataFrame:
    """layer, input, store, clipped, dropped, accepted, label: each layer's own count against the store and the losses that the pipeline reports.

    Accepted is the larger of the store's count and what the losses leave; a partial dataset is labelled so."""
    d = source.join(canonical, "layer", "left").join(drops, "layer", "left").na.fill(0, ["store", "clipped", "dropped"])
    left = F.col("input") - F.col("clipped") - F.col("dropped")
    return d.select("layer", "input", "store", "clipped", "dropped", F.greatest("store", left).alias("accepted"), F.when(partial, "partial").otherwise("whole").alias("label"))


def checklist(found: DataFrame, wanted: DataFrame, top: int = 3) -> DataFrame:
    """entry_id, rank, hit, near: the rank at which a known item comes, whether that is within ``top`` (a stated list length) and within its tolerance.

    found: query, item_id, rank, x, z; wanted: entry_id, query, item_id, x, z, tolerance."""
    f = found.select("query", "item_id", "rank", F.col("x").alias("fx"), F.col("z").alias("fz")).groupBy("query", "item_id").agg(F.min_by(F.struct("rank", "fx", "fz"), "rank").alias("f"))
    d = wanted.join(f, ["query", "item_id"], "left")
    hit = F.coalesce(F.col("f.rank") <= top, F.lit(False))
    return d.select("entry_id", F.col("f.rank").alias("rank"), hit.alias("hit"), (hit & F.coalesce(F.hypot(F.col("f.fx") - F.col("x"), F.col("f.fz") - F.col("z")) <= F.col("tolerance"), F.lit(False))).alias("near"))


def cell_samples(cells: DataFrame, per_side: int, inside: Column) -> DataFrame:
    """cell, samples, inside: per_side x per_side points in the middle of equal parts of each cell, and how many lie inside; cells: cell, x0, z0, width, depth.
    inside reads the columns x and z."""
    step = F.sequence(F.lit(0), F.lit(per_side - 1))
    d = cells.withColumn("i", F.explode(step)).withColumn("j", F.explode(step))
    d = d.withColumn("x", F.col("x0") + (F.col("i") + 0.5) * F.col("width") / per_side).withColumn("z", F.col("z0") + (F.col("j") + 0.5) * F.col("depth") / per_side)
    return d.groupBy("cell").agg(F.count(F.lit(1)).alias("samples"), F.count_if(inside).alias("inside"))


def spread(rows: DataFrame, width: float, order: Column, target: int) -> DataFrame:
    """A sample of target rows that takes one row of each bucket of the plane in turn; rows: x and z. The bucket and turn come with it."""
    bucket = F.concat_ws(":", F.floor(F.col("x") / width).cast("long").cast("string"), F.floor(F.col("z") / width).cast("long").cast("string"))
    d = rows.withColumn("bucket", bucket)
    return d.withColumn("turn", F.row_number().over(Window.partitionBy("bucket").orderBy(order)).cast("long")).orderBy("turn", "bucket").limit(target)


def evenly(rows: DataFrame, by: str, order: Column, quota: int) -> DataFrame:
    """About quota rows of each group, evenly spaced in its order: those where the running share of the quota passes a whole number."""
    line = Window.partitionBy(by).orderBy(order)
    d = rows.withColumn("_n", F.row_number().over(line)).withColumn("_all", F.count(F.lit(1)).over(Window.partitionBy(by)))
    share = F.least(F.lit(quota), F.col("_all"))
    passed = F.floor(F.col("_n") * share / F.col("_all")) > F.floor((F.col("_n") - 1) * share / F.col("_all"))
    return d.where(passed).drop("_n", "_all")


def finest(rows: DataFrame, key: str, lod: str = "lod") -> DataFrame:
    """Each key's row of the finest level."""
    return rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), lod).alias("_r")).select("_r.*")
