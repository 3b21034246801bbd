"""Geocoding: an address against known house numbers, and a place name against namesakes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_street(wanted: DataFrame, known: DataFrame, gap: int = 10, span: float = 1200.0) -> DataFrame:
    """id, x, z, score: the exact number (1.0), else the nearest number of the street within gap (0.8), else the
    median house of a street no wider than span (0.6). wanted: id, postcode, street, number; known: postcode,
    street, number, x, z."""
    key = ["postcode", "street"]
    houses = known.groupBy(*key, "number").agg(F.min(F.struct("x", "z")).alias("p"))
    near = (
        wanted.where("number is not null").alias("w").join(houses.alias("h"), [F.col(f"w.{k}") == F.col(f"h.{k}") for k in key])
        .select("id", F.col("w.number").alias("number"), F.col("h.number").alias("found"), "p").withColumn("away", F.abs(F.col("number") - F.col("found")) + F.when(F.col("number") % 2 == F.col("found") % 2, 0.0).otherwise(0.5))
        .where(F.col("away") <= gap).groupBy("id").agg(F.min(F.struct("away", "found", "p")).alias("b"))
        .select("id", F.col("b.p").alias("p"), F.when(F.col("b.away") == 0, 1.0).otherwise(0.8).alias("score"))
    )
    width = F.hypot(F.max("p.x") - F.min("p.x"), F.max("p.z") - F.min("p.z"))
    order = F.array_sort(F.collect_list(F.struct("number", "p")))
    streets = houses.groupBy(*key).agg(width.alias("width"), F.element_at(order, (F.floor(F.count(F.lit(1)) / 2) + 1).cast("int"))["p"].alias("p")).where(F.col("width") <= span)
    rest = wanted.join(near, "id", "left_anti").join(streets, key).select("id", "p", F.lit(0.6).alias("score"))
    return near.unionByName(rest).select("id", "p.x", "p.z", "score")


def in_the_middle(known: DataFrame, span: float = 1200.0) -> DataFrame:
    """postcode, street, x, z of streets no wider than span: the median of all positions along each axis by itself, the upper one of two.

    known: postcode, street, x, z, one row a house. Positions are counted before they are put in order."""
    key = ["postcode", "street"]
    wide = known.groupBy(*key).agg(F.hypot(F.max("x") - F.min("x"), F.max("z") - F.min("z")).alias("width")).where(F.col("width") <= span).drop("width")
    near = known.join(wide, key)

    def median(axis: str) -> DataFrame:
        line = Window.partitionBy(*key).orderBy(axis)
        counts = near.groupBy(*key, axis).agg(F.count(F.lit(1)).alias("k")).withColumn("upto", F.sum("k").over(line)).withColumn("n", F.sum("k").over(Window.partitionBy(*key)))
        return counts.groupBy(*key).agg(F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col(axis))).alias(axis))

    return median("x").join(median("z"), key)


def by_name(wanted: DataFrame, places: DataFrame, most: float = 600.0) -> DataFrame:
    """id, x, z, score 0.5 where all namesakes in the commune lie within most of the first one (by place_id).
    wanted: id, commune, key; places: place_id, commune, key, x, z."""
    firsts = places.groupBy("commune", "key").agg(F.min_by(F.struct("x", "z"), "place_id").alias("p"))
    far = places.join(firsts, ["commune", "key"]).groupBy("commune", "key").agg(F.max(F.hypot(F.col("x") - F.col("p.x"), F.col("z") - F.col("p.z"))).alias("far"), F.first("p").alias("p"))
    return wanted.join(far.where(F.col("far") <= most), ["commune", "key"]).select("id", "p.x", "p.z", F.lit(0.5).alias("score"))
