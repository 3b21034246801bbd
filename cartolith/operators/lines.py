"""Lines that run along each other: a join of all lines by their sampled distance.

A line's samples are its points and the middles of its segments; two lines are as far apart as the sample of either that is farthest from the
other one's segments. Segments are dealt to the grid cells that they pass within ``most``, column by column, so a long slanted one has as many cells as
it is long. Lines that are near throughout have boxes that differ by at most ``most`` on every side: such lines are found by the cells of one corner of their boxes, a row
or nine a line. Samples then meet the segments of
such a partner by (partner, cell), and the distance of a sample is the least of those within ``most``; a sample without one parts the lines.

Every join is on equal keys and no line is held by one task but as its own row. Copies of one line find each other, each pair once: that is the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolith.functions import geometry
from cartolith.functions.polygons import let, point
from cartolith.operators.joins import blocked_pairs, cell
from cartolith.plans.tables import materialise

Rule = Callable[[Callable[[str], Column], Callable[[str], Column]], Column]


def segment_distance(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point to a segment; to its end where it has no length."""
    dx, dy = bx - ax, by - ay
    along = ((x - ax) * dx + (y - ay) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
    u = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), along)), F.lit(0.0))
    return F.hypot(x - (ax + u * dx), y - (ay + u * dy))


def nearest_edge(x: Column, y: Column, lines: Column) -> Column:
    """Distance of a point to the nearest segment of an array of lines or rings; null without segments."""
    each = F.transform(F.flatten(F.transform(lines, geometry.edges)), lambda e: segment_distance(x, y, e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]))
    return F.array_min(each)


def samples(lines: DataFrame) -> DataFrame:
    """id, no, x, y: the points of all parts (id, parts) and the middles of their segments, numbered from 0."""
    both = lambda e: F.array(e["a"], point((e["a"]["x"] + e["b"]["x"]) / 2, (e["a"]["y"] + e["b"]["y"]) / 2))
    last = lambda part: F.slice(part, F.greatest(F.size(part), F.lit(1)), F.lit(1))
    of_part = lambda part: F.concat(F.flatten(F.transform(geometry.edges(part), both)), last(part))
    return lines.select("id", F.posexplode(F.flatten(F.transform("parts", of_part))).alias("no", "p")).select("id", "no", F.col("p.x").alias("x"), F.col("p.y").alias("y"))


def segments(lines: DataFrame) -> DataFrame:
    """id, ax, ay, bx, by: the segments of all parts."""
    e = lines.select("id", F.explode(F.flatten(F.transform("parts", geometry.edges))).alias("e"))
    return e.select("id", F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"), F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by"))


def passed_cells(width: float, reach: float) -> Column:
    """array<struct<cx, cy>>: the cells of points that may lie within reach of the segment ax, ay, bx, by."""
    ax, ay, bx, by = (F.col(c) for c in ("ax", "ay", "bx", "by"))
    slope = (by - ay) / F.nullif(bx - ax, F.lit(0.0))
    height = lambda x: F.coalesce(ay + (x - ax) * slope, ay)

    def column(cx: Column) -> Column:
        lo, hi = F.greatest(F.least(ax, bx), cx * width - reach), F.least(F.greatest(ax, bx), (cx + 1) * width + reach)
        ends = F.when(F.coalesce(F.abs(slope) <= 1e9, F.lit(False)), F.array(height(lo), height(hi))).otherwise(F.array(ay, by))
        rows = let(ends, lambda v: F.sequence(cell(F.array_min(v) - reach, width), cell(F.array_max(v) + reach, width)))
        return F.transform(rows, lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))

    return F.flatten(F.transform(F.sequence(cell(F.least(ax, bx) - reach, width), cell(F.greatest(ax, bx) + reach, width)), column))


def close_lines(lines: DataFrame, most: float, alike: Rule | None = None, width: float | None = None) -> DataFrame:
    """a, b, d of all pairs of lines (id, parts and more; ids are unique) whose sampled distance d is at most ``most``, a the smaller id.

    alike: what a pair's columns must fulfil beside; width: of the grid cells, ten times ``most`` unless given. Parts that are null, empty or hold one point have no
    segments, so lines of such parts alone are near nothing; coordinates must not be null."""
    width, reach = float(width or 10 * most), most * (1 + 1e-9) + 1e-9
    lines = materialise(lines, "lines")
    spots = materialise(samples(lines).withColumn("cx", cell("x", width)).withColumn("cy", cell("y", width)), "line-samples")
    dealt = segments(lines).withColumn("c", F.explode(passed_cells(width, reach))).select("id", "c.cx", "c.cy", "ax", "ay", "bx", "by")
    dealt = materialise(dealt, "line-segments").withColumnRenamed("id", "other")
    d = segment_distance(*(F.col(c) for c in ("x", "y", "ax", "ay", "bx", "by")))
    ends = lambda c, name: (F.min(F.least(f"a{c}", f"b{c}")).alias(f"{name}0"), F.max(F.greatest(f"a{c}", f"b{c}")).alias(f"{name}1"))
    boxes = segments(lines).groupBy("id").agg(*ends("x", "x"), *ends("y", "z"))
    boxes = materialise(boxes.select("id", F.col("x0").alias("x"), F.col("z0").alias("z"), "x1", "z1"), "line-boxes")
    alike_box = lambda c: F.abs(F.col(f"l_{c}") - F.col(f"r_{c}")) <= reach
    found = blocked_pairs(boxes, boxes, reach * 2**0.5).where("l_id < r_id").where(alike_box("x") & alike_box("z") & alike_box("x1") & alike_box("z1"))
    pairs = found.select(F.col("l_id").alias("id"), F.col("r_id").alias("other"))
    if alike is not None:
        side = lambda s, key: lines.drop("parts").select(F.col("id").alias(key), *[F.col(c).alias(f"{s}_{c}") for c in lines.columns if c != "parts"])
        pairs = pairs.join(side("l", "id"), "id").join(side("r", "other"), "other").where(alike(lambda c: F.col(f"l_{c}"), lambda c: F.col(f"r_{c}")))
    pairs = materialise(pairs.select("id", "other"), "line-pairs")
    both = pairs.unionByName(pairs.select(F.col("other").alias("id"), F.col("id").alias("other")))
    met = spots.join(both, "id").join(dealt, ["other", "cx", "cy"]).where(d <= most)
    least = met.groupBy("id", "other", "no").agg(F.min(d).alias("d"))
    sides = least.groupBy("id", "other").agg(F.max("d").alias("d"), F.count(F.lit(1)).alias("n")).join(spots.groupBy("id").agg(F.count(F.lit(1)).alias("n")), ["id", "n"])
    whole = sides.groupBy(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).agg(F.max("d").alias("d"), F.count(F.lit(1)).alias("sides"))
    return whole.where("sides = 2").select("a", "b", "d")
