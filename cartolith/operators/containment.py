"""Containment of points in polygons of any number of vertices, as joins.

A polygon's box is dealt to the grid cells that it touches, points meet the boxes of their cell. The polygon's height is cut into bins, about one for
EDGES_A_BIN edges, and each edge is dealt to the bins that it touches; a point then meets only the edges of its own bin. The parity of crossings
of a ray towards greater x, counted by one aggregation, tells inside from outside. Edges on which the point lies are counted apart,
so the caller may count the boundary in or out.

Long edges touch many bins, so a polygon has only as many bins as deal its edges to DEALT bins each on the mean. Where that leaves more than CROWDED edges a bin,
the points and edges of a bin meet in one task, in which a point finds its crossings by bisection (functions/crossed.py); points of a bin are cut into parts of
PART. A bin's edges are read whole by its task.

Every join is on equal keys, (cell) and (polygon, bin); edges of other bins are few, so a polygon or bin with a third of all points is split over tasks.
Polygons are arrays of rings, the exterior first; rings may be open or closed. Null or empty polygons hold nothing, null coordinates lie nowhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartolith.functions.crossed import crossed as _crossed
from cartolith.operators.joins import best_match, blocked_pairs, cell
from cartolith.plans.tables import SENT, materialise

#: fixed value: distance within which a point lies on an edge
EPSILON = 1e-10
EDGES_A_BIN, MOST_BINS = 8, 1 << 16
DEALT, CROWDED, PART = 3, 64, 1 << 20


def polygon_edges(polygons: DataFrame) -> DataFrame:
    """polygon_id, hole, ax, ay, bx, by: the edges of polygons (polygon_id, rings), the closing one too; edges without length are left out."""
    rings = polygons.select("polygon_id", F.posexplode("rings").alias("ring_no", "ring")).where("size(ring) > 0")
    after = F.concat(F.slice("ring", 2, F.greatest(F.size("ring") - 1, F.lit(0))), F.slice("ring", 1, 1))
    edges = rings.select("polygon_id", (F.col("ring_no") > 0).alias("hole"), F.explode(F.zip_with("ring", after, lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("e"))
    return edges.select("polygon_id", "hole", F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"), F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by")).where("ax <> bx or ay <> by")


def _bin(y: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.col("bins") - 1, F.floor((y - F.col("y0")) / F.col("height")).cast("int")))


def binned_boxes(edges: DataFrame) -> DataFrame:
    """polygon_id, x0, x1, y0, y1, bins, height, crowded: the box of each polygon's edges, the bins of its height and whether they hold many edges; one row a polygon."""
    low, high = (lambda a, b: F.min(F.least(a, b))), (lambda a, b: F.max(F.greatest(a, b)))
    boxes = edges.groupBy("polygon_id").agg(low("ax", "bx").alias("x0"), high("ax", "bx").alias("x1"), low("ay", "by").alias("y0"), high("ay", "by").alias("y1"), F.count(F.lit(1)).alias("edges"), F.sum(F.abs(F.col("by") - F.col("ay"))).alias("rise"))
    dealt = F.when(F.col("rise") > 0, F.floor(F.col("edges") * DEALT * ((F.col("y1") - F.col("y0")) / F.col("rise"))))
    bins = F.greatest(F.lit(1), F.least(F.lit(MOST_BINS), F.floor(F.col("edges") / EDGES_A_BIN), dealt)).cast("int")
    boxes = boxes.withColumn("bins", bins).withColumn("height", F.when(F.col("y1") > F.col("y0"), (F.col("y1") - F.col("y0")) / F.col("bins")).otherwise(F.lit(1.0)))
    return boxes.withColumn("crowded", F.col("edges") > F.col("bins") * CROWDED).drop("edges", "rise")


def in_box() -> Column:
    """Whether the point (x, z) of a row lies in its box."""
    return F.col("x").between(F.col("x0") - EPSILON, F.col("x1") + EPSILON) & F.col("z").between(F.col("y0") - EPSILON, F.col("y1") + EPSILON)


def crossings(points: DataFrame, polygons: DataFrame, size: float) -> DataFrame:
    """id, polygon_id, odd (the ray crosses an odd number of edges), on_edge and on_hole: a row for each point (id, x, z) in the box of a polygon whose
    bin has edges that matter to it. polygons: with their rings, or edges as polygon_edges() gives them; size: width of the grid cells of boxes."""
    edges = materialise(polygon_edges(polygons) if "rings" in polygons.columns else polygons, "polygon-edges")
    boxes = materialise(binned_boxes(edges), "polygon-boxes")
    touched = lambda a, b: F.explode(F.sequence(cell(F.col(a) - EPSILON, size), cell(F.col(b) + EPSILON, size)))
    cells = boxes.withColumn("cx", touched("x0", "x1")).withColumn("cy", touched("y0", "y1"))
    p = points.select("id", F.col("x").cast("double").alias("x"), F.col("z").cast("double").alias("z")).withColumn("cx", cell("x", size)).withColumn("cy", cell("z", size))
    return parity(p.join(cells, ["cx", "cy"]).where(in_box()), boxes, edges)


def parity(near: DataFrame, boxes: DataFrame, edges: DataFrame) -> DataFrame:
    """crossings() of pairs of points and polygons: near has id, x, z and the columns of boxes, which binned_boxes() made of edges."""
    x, y = F.col("x"), F.col("z")
    near = near.select("id", "polygon_id", "x", "z", _bin(y).alias("bin"), "crowded")
    ends = lambda pick, sign: _bin(pick("ay", "by") + sign * EPSILON)
    dealt = edges.join(boxes.select("polygon_id", "y0", "bins", "height", "crowded"), "polygon_id").withColumn("bin", F.explode(F.sequence(ends(F.least, -1), ends(F.greatest, 1))))
    dealt = dealt.select("polygon_id", "bin", "hole", "ax", "ay", "bx", "by", "crowded")
    few = _few(near.where("not crowded").drop("crowded"), dealt.where("not crowded").drop("crowded"))
    if not boxes.where("crowded").limit(1).count():
        return few
    near, dealt = materialise(near.where("crowded").drop("crowded"), "polygon-near"), dealt.where("crowded").drop("crowded")
    asked = materialise(near.select("polygon_id", "bin").distinct(), "polygon-asked")
    if asked.limit(SENT + 1).count() <= SENT:
        # edges of bins without points stay where they are
        dealt = dealt.join(F.broadcast(asked), ["polygon_id", "bin"], "left_semi")
    return few.unionByName(_many(near, dealt))


def _few(near: DataFrame, dealt: DataFrame) -> DataFrame:
    """parity() by testing all edges of a point's bin."""
    x, y = F.col("x"), F.col("z")
    ax, ay, bx, by = (F.col(c) for c in ("ax", "ay", "bx", "by"))
    cross = (y - ay) * (bx - ax) - (x - ax) * (by - ay)
    within = lambda v, a, b: v.between(F.least(a, b) - EPSILON, F.greatest(a, b) + EPSILON)
    on = (F.abs(cross) <= EPSILON) & within(x, ax, bx) & within(y, ay, by)
    crossed = ((ay > y) != (by > y)) & (x < ax + (y - ay) / (by - ay) * (bx - ax))
    met = near.join(dealt, ["polygon_id", "bin"]).where(F.greatest("ax", "bx") >= x - EPSILON)
    return met.groupBy("id", "polygon_id").agg((F.count_if(crossed) % 2 == 1).alias("odd"), F.coalesce(F.max(on & ~F.col("hole")), F.lit(False)).alias("on_edge"), F.coalesce(F.max(on & F.col("hole")), F.lit(False)).alias("on_hole"))


def _many(near: DataFrame, dealt: DataFrame) -> DataFrame:
    """parity() of crowded bins: the points and edges of a bin meet in a task."""
    key = ["polygon_id", "bin"]
    parts = F.broadcast(near.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts")))
    p = near.join(parts, key).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    e = dealt.join(parts, key).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    key = [*key, "part"]
    schema = T.StructType([near.schema["id"], near.schema["polygon_id"], *[T.StructField(c, T.BooleanType()) for c in ("odd", "on_edge", "on_hole")]])

    def meet(points: pa.Table, edges: pa.Table) -> pa.Table:
        of = lambda t, *names: [np.asarray(t.column(c).to_numpy()) for c in names]
        flags = _crossed(*of(points, "x", "z"), *of(edges, "ax", "ay", "bx", "by", "hole"), EPSILON)
        return pa.table([points.column("id"), points.column("polygon_id"), *flags], names=schema.names)

    p, e = p.select("id", "x", "z", *key), e.select(*key, "hole", "ax", "ay", "bx", "by")
    return p.groupBy(*key).cogroup(e.groupBy(*key)).applyInArrow(meet, schema)


def held(points: DataFrame, polygons: DataFrame, size: float, inclusive: bool = True) -> DataFrame:
    """id, polygon_id of all points in polygons (with rings, or as edges). The exterior's edges count as inside and holes' edges as outside; not inclusive: by parity alone."""
    met = crossings(points, polygons, size)
    inside = (F.col("odd") | F.col("on_edge")) & ~F.col("on_hole") if inclusive else F.col("odd")
    return met.where(inside).select("id", "polygon_id")


def first_or_nearest(points: DataFrame, polygons: DataFrame, anchors: DataFrame, size: float, reach: float) -> DataFrame:
    """id, polygon_id, inside: the first polygon (smallest id) that holds each point by parity, or else the one whose anchor (polygon_id, x, z) is nearest
    within reach (ties: smallest id), or else null."""
    inside = materialise(held(points, polygons, size, inclusive=False).groupBy("id").agg(F.min("polygon_id").alias("polygon_id")), "polygon-inside")
    rest = points.select("id", "x", "z").join(inside, "id", "left_anti")
    pairs = blocked_pairs(anchors.select("polygon_id", "x", "z"), rest, reach).where(F.col("d2") < float(reach) ** 2).select(F.col("r_id").alias("id"), F.col("l_polygon_id").alias("polygon_id"), "d2")
    near = best_match(pairs, "id", F.col("d2"), F.col("polygon_id")).select("id", "polygon_id")
    found = inside.withColumn("inside", F.lit(True)).unionByName(near.withColumn("inside", F.lit(False)))
    return points.select("id").join(found, "id", "left")
