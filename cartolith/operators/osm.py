"""Map elements: coordinates of ways, and polygons of relations from their ways."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.functions import geometry
from cartolith.plans.tables import materialise

from .rings import relation_rings, walked

#: fixed values: kinds whose closed ways are areas
AREA_KINDS = ("building", "water", "landuse", "poi")


def way_lines(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """way_id, line (points in order) of the ways all of whose nodes are known; ways: way_id, nodes; nodes: node_id, x, y."""
    flat = ways.select("way_id", F.size("nodes").alias("n"), F.posexplode("nodes").alias("pos", "node_id"))
    met = flat.join(nodes, "node_id").groupBy("way_id", "n").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))).alias("p"))
    return met.where(F.size("p") == F.col("n")).select("way_id", F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias("line"))


def way_shapes(ways: DataFrame, nodes: DataFrame, area_kinds: tuple[str, ...] = AREA_KINDS) -> DataFrame:
    """way_id, kind, line, rings of complete ways of two nodes or more (way_id, kind, nodes): a closed way of an area's kind
    is a polygon of one ring and has no line, any other is a line and has no rings."""
    d = way_lines(ways, nodes).where(F.size("line") >= 2).join(ways.select("way_id", "kind"), "way_id")
    closed = F.coalesce((F.get("line", F.lit(0)) == F.element_at("line", -1)) & F.col("kind").isin(*area_kinds), F.lit(False))
    return d.select("way_id", "kind", F.when(~closed, F.col("line")).alias("line"), F.when(closed, F.array("line")).alias("rings"))


def join_ends(lines: list[list]) -> list[list] | None:
    """Closed rings from lines that meet at their ends, either way round; None if one stays open."""
    walks = walked([(line[0], line[-1]) for line in lines])
    if walks is None:
        return None
    turned = [[lines[k][::-1] if back else lines[k] for k, back in walk] for walk in walks]
    return [[*ring[0], *(p for line in ring[1:] for p in line[1:])] for ring in turned]


def relation_polygons(members: DataFrame, lines: DataFrame) -> DataFrame:
    """relation_id, polygon, ring, line, problem: the rings that relation_rings() describes, as closed arrays of points."""
    pieces = materialise(relation_rings(members, lines), "relation-pieces")
    points = F.when(F.col("reversed"), F.reverse("line")).otherwise(F.col("line"))
    points = F.when(F.col("seq") > 0, F.slice(points, F.lit(2), F.size("line") - 1)).otherwise(points)
    met = pieces.where("problem is null").join(lines, "way_id").select("relation_id", "polygon", "ring", F.struct("seq", points.alias("p")).alias("piece"))
    whole = F.flatten(F.transform(F.array_sort(F.collect_list("piece")), lambda v: v["p"]))
    rings = met.groupBy("relation_id", "polygon", "ring").agg(whole.alias("line")).withColumn("problem", F.lit(None).cast("string"))
    return rings.unionByName(pieces.where("problem is not null").select("relation_id", "polygon", "ring", "problem"), allowMissingColumns=True)


def relation_sizes(members: DataFrame, lines: DataFrame) -> DataFrame:
    """relation_id, polygon, ring, points, area, problem: the rings of relation_polygons() with their points and signed areas, summed over their ways, so no ring
    is put together."""
    pieces = materialise(relation_rings(members, lines), "relation-pieces")
    sizes = lines.select("way_id", F.size("line").alias("n"), geometry.signed_area(F.col("line")).alias("area"))
    signed = F.when(F.col("reversed"), -F.col("area")).otherwise(F.col("area"))
    rings = pieces.where("problem is null").join(sizes, "way_id").groupBy("relation_id", "polygon", "ring").agg((F.sum(F.col("n") - 1) + 1).alias("points"), F.sum(signed).alias("area"))
    return rings.withColumn("problem", F.lit(None).cast("string")).unionByName(pieces.where("problem is not null").select("relation_id", "polygon", "ring", "problem"), allowMissingColumns=True)
