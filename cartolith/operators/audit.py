"""Audits: percentiles, strata, samples, coverage grids, reconciliation, rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartolith.plans.tables import materialise


#: Bins of a histogram; rows of a bin that are sorted rather than binned again; targets that are broadcast.
BINS, LEAF, FEW = 4096, 1 << 14, 10_000


def selected(rows: DataFrame, key: str, value: str, ranks: DataFrame) -> DataFrame:
    """key, rank, picked: the value at each wanted rank (key, rank, from 0) of its group's values in order, nulls left out; NaN is the largest.
    Keys are never null; values are numbers that a double holds, so integers up to 2**53.

    Selection by refined histograms: rows are counted by bin of the interval that holds a rank, whose ends then become the least and the greatest value of
    the bin that the rank falls into, until that bin has one value or at most LEAF rows, which are sorted. Bins are counted by task before they are
    shuffled, so no task holds more than BINS counts or LEAF values of a target, whatever the size of its group. Each round reads the value
    column once; uniform values of a trillion rows take three."""
    d = rows.where(F.col(value).isNotNull()).select(key, F.col(value).cast("double").alias("_v"))
    ends = d.groupBy(key).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    rest = ranks.select(key, "rank").distinct().join(ends, key)
    rest, done = materialise(rest.withColumn("_below", F.lit(0).cast("long")), "ranks"), None
    keys = [key, "rank"]

    def met(targets: DataFrame) -> DataFrame:
        """The rows within a target's interval."""
        small = targets.limit(FEW + 1).count() <= FEW
        return d.join(F.broadcast(targets) if small else targets, key).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))

    def ended(targets: DataFrame) -> DataFrame:
        one = targets.where(F.col("_lo") == F.col("_hi")).select(*keys, F.col("_lo").alias("picked"))
        few = met(targets.where((F.col("_lo") != F.col("_hi")) & (F.col("_n") <= LEAF))).groupBy(*keys).agg(F.sort_array(F.collect_list("_v")).alias("_s"), F.first("_below").alias("_below"))
        return one.unionByName(few.select(*keys, F.get("_s", (F.col("rank") - F.col("_below")).cast("int")).alias("picked")))

    while True:
        finished = (F.col("_lo") == F.col("_hi")) | (F.col("_n") <= LEAF)
        part = materialise(ended(rest.where(finished)), "picked")
        done = part if done is None else done.unionByName(part)
        rest = rest.where(~finished)
        if not rest.limit(1).count():
            return done
        v, lo, hi = F.col("_v"), F.col("_lo"), F.col("_hi")
        far = (F.abs(lo) == float("inf")) | (hi == float("inf")) | F.isnan(hi)  # ends without a width: what lies between is one bin
        inner = F.when(far, F.lit(1.0)).otherwise(F.floor((v / 2 - lo / 2) / (hi / 2 - lo / 2) * BINS).cast("double"))
        bin_ = F.when(v == lo, F.lit(0.0)).when(v == hi, F.lit(float(BINS))).otherwise(inner)
        bins_ = met(rest).groupBy(*keys, bin_.alias("_bin")).agg(F.count(F.lit(1)).alias("_k"), F.min("_v").alias("_from"), F.max("_v").alias("_to"), F.first("_below").alias("_below"))
        upto = F.col("_below") + F.sum("_k").over(Window.partitionBy(*keys).orderBy("_bin"))
        held = bins_.withColumn("_upto", upto).where((F.col("_upto") > F.col("rank")) & (F.col("_upto") - F.col("_k") <= F.col("rank")))
        rest = materialise(held.select(*keys, F.col("_from").alias("_lo"), F.col("_to").alias("_hi"), F.col("_k").alias("_n"), (F.col("_upto") - F.col("_k")).alias("_below")), "ranks")


def _at_quantiles(rows: DataFrame, by: list[str], value: str, quantiles: dict[str, float], interpolate: bool) -> DataFrame:
    """by and a column for each quantile: the value at the place (n - 1) q in order, rounded down or interpolated."""
    # groups are told apart by a struct, which is never null and may have no column
    keyed = rows.where(F.col(value).isNotNull()).select(F.struct(F.lit(0).alias("_0"), *by).alias("_g"), F.col(value).alias("_value"))
    sizes = materialise(keyed.groupBy("_g").agg(F.count(F.lit(1)).alias("_n")), "sizes")
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), ((F.col("_n") - 1) * F.lit(q)).alias("place")) for name, q in quantiles.items()])
    places = sizes.select("_g", F.explode(wanted).alias("w")).select("_g", "w.name", "w.place", F.explode(F.array_distinct(F.array(F.floor("w.place"), F.ceil("w.place") if interpolate else F.floor("w.place")))).alias("rank"))
    found = places.join(selected(keyed, "_g", "_value", places), ["_g", "rank"])
    share = F.when(F.col("rank") == F.floor("place"), F.floor("place") + 1 - F.col("place")).otherwise(F.col("place") - F.floor("place")) if interpolate else F.lit(1.0)
    part = F.when(share == 1, F.col("picked")).otherwise(share * F.col("picked"))
    out = found.groupBy("_g").agg(*[F.sum(F.when(F.col("name") == name, part)).alias(name) for name in quantiles])
    return out.select(*[F.col("_g")[c].alias(c) for c in by], *quantiles)


def floor_percentiles(rows: DataFrame, by: str, value: str, quantiles: dict[str, float]) -> DataFrame:
    """For each group the values at position floor((n-1) q) in order, in the type of the column."""
    kind = rows.schema[value].dataType
    out = _at_quantiles(rows, [by], value, quantiles, False)
    return out.select(by, *[F.col(name).cast(kind).alias(name) for name in quantiles])


def linear_percentiles(rows: DataFrame, by: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Percentiles by linear interpolation."""
    return _at_quantiles(rows, by, value, quantiles, True)


def bins(rows: DataFrame, value: str, quantiles: tuple[float, ...] = (0.2, 0.4, 0.6, 0.8)) -> DataFrame:
    """Adds bin, the number of quantile edges below the value; equal values share a bin. The edges pass the driver."""
    edges = linear_percentiles(rows, [], value, {f"e{k}": q for k, q in enumerate(quantiles)}).first() or []
    return rows.withColumn("bin", sum(((F.col(value) > e).cast("int") for e in edges if e is not None), F.lit(0)))


def round_robin(rows: DataFrame, stratum: str, order: Column, target: int) -> DataFrame:
    """A sample of target rows: one of each stratum in turn, in the order of strata."""
    per = Window.partitionBy(stratum).orderBy(order)
    return rows.withColumn("turn", F.row_number().over(per).cast("long")).orderBy("turn", stratum).limit(target)


def grid(rows: DataFrame, key: str, kind: str, x0: float, z0: float, width: float, depth: float, n: int = 8) -> DataFrame:
    """Distinct keys by cell of an n by n grid and kind."""
    at = lambda c, o, w: F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor((F.col(c) - o) / (w / n)).cast("int")))
    return rows.groupBy(at("x", x0, width).alias("col"), at("z", z0, depth).alias("row"), kind).agg(F.count_distinct(key).alias("features"))


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Counts of two sides by key, with what is matched and what is not; both sides have key and n."""
    l, r = left.select(key, F.col("n").alias("left_n")), right.select(key, F.col("n").alias("right_n"))
    d = l.join(r, key, "full_outer").select(key, F.coalesce("left_n", F.lit(0)).alias("left_n"), F.coalesce("right_n", F.lit(0)).alias("right_n"))
    return d.withColumn("matched", F.least("left_n", "right_n")).withColumn("unmatched", F.abs(F.col("left_n") - F.col("right_n")))


def parity(source: DataFrame, canonical: DataFrame, key: list[str]) -> DataFrame:
    """Source tallies against canonical ones, with the ratio and a verdict; both have the key and n."""
    d = source.withColumnRenamed("n", "source_n").join(canonical.withColumnRenamed("n", "canonical_n"), key, "left").withColumn("canonical_n", F.coalesce("canonical_n", F.lit(0)))
    ratio = F.col("canonical_n") / F.col("source_n")
    verdict = F.when(F.col("canonical_n") == 0, "missing").when(ratio < 0.5, "short").when(ratio < 0.95, "partial").when(ratio <= 1.05, "equal").otherwise("over")
    return d.withColumn("ratio", ratio).withColumn("verdict", verdict)


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """key, rule of every rule that a row breaks, in one pass."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in rules.items()]))
    return rows.select(key, F.explode(broken).alias("rule"))
