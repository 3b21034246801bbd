"""Entity resolution: priority merges with provenance, votes, and balanced accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def priority_merge(rows: DataFrame, key: str, fields: list[str], priority: Column, arrival: Column) -> DataFrame:
    """One row a key: per field the non-empty value of the highest priority (earliest arrival among equals),
    and disputed_<field>, whether other values lost. One aggregation, whatever the number of fields."""
    d = rows.withColumn("_p", F.struct(priority.alias("p"), (-arrival).alias("a")))
    out = []
    for f in fields:
        value = F.when(F.col(f).cast("string") != "", F.col(f))
        out.append(F.max_by(value, F.when(value.isNotNull(), F.col("_p"))).alias(f))
        out.append((F.count_distinct(value) > 1).alias(f"disputed_{f}"))
    return d.groupBy(key).agg(*out)


def provenance(rows: DataFrame, key: str, fields: list[str], source: str, priority: Column, arrival: Column) -> DataFrame:
    """A row for each disputed field: key, property, winner (its source), contenders (the losing sources, sorted)."""
    long = rows.select(key, source, priority.alias("_p"), (-arrival).alias("_a"), F.explode(F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f).cast("string"))])).alias("property", "value"))
    long = long.where("value <> ''")
    merged = long.groupBy(key, "property").agg(F.max_by(source, F.struct("_p", "_a")).alias("winner"), F.array_sort(F.collect_set(source)).alias("sources"), F.count_distinct("value").alias("n"))
    return merged.where("n > 1").select(key, "property", "winner", F.filter("sources", lambda s: s != F.col("winner")).alias("contenders"))


def modal(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value of each key, the smallest of equals."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(key).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(value), F.max("n").alias("votes"))


def accounts(rows: DataFrame, by: list[str], fate: Column) -> DataFrame:
    """Rows in and rows by fate (accepted, merged, excluded, invalid, outside); what no fate explains is unexplained."""
    d = rows.withColumn("_f", fate)
    names = ("accepted", "merged", "excluded", "invalid", "outside")
    counted = d.groupBy(*by).agg(F.count(F.lit(1)).alias("input"), *[F.count_if(F.col("_f") == n).alias(n) for n in names])
    explained = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    return counted.withColumn("unexplained", F.greatest(F.lit(0), F.col("input") - explained))


def duplicate_summary(rows: DataFrame, key: str, signature: Column) -> DataFrame:
    """One row: groups of repeated keys, rows dropped, groups whose rows agree or conflict, the largest group."""
    g = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(signature).alias("s")).where("n > 1")
    return g.agg(
        F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("dropped"), F.count_if(F.col("s") == 1).alias("identical"),
        F.count_if(F.col("s") > 1).alias("conflicting"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"),
    )
