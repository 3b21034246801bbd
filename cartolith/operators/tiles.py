"""Level-of-detail tiles: cell cover, fragments, adaptive splits, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolith.functions import geometry, polygons
from cartolith.operators.audit import floor_percentiles

# fixed values: tile sizes in metres by level
SIZES = {0: 2048, 1: 8192, 2: 32768}


def tile_id(lod: int) -> Column:
    return F.concat_ws("_", F.lit(f"l{lod}"), F.col("col").cast("string"), F.col("row").cast("string"))


def cover(boxes: DataFrame, lod: int, origin: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """A row for each tile that a box (x0, z0, x1, z1) touches, with col, row and tile_id."""
    size = float(SIZES[lod])
    at = lambda c, o: F.floor((F.col(c) - o) / size).cast("long")
    d = boxes.withColumn("col", F.explode(F.sequence(at("x0", origin[0]), at("x1", origin[0])))).withColumn("row", F.explode(F.sequence(at("z0", origin[1]), at("z1", origin[1]))))
    return d.withColumn("tile_id", tile_id(lod))


def fragments(rings: DataFrame, size: float) -> DataFrame:
    """The parts of closed rings (id, ring) in each tile of a grid: id, col, row, ring, fragment_id, fragment_of (only
    where the ring was cut)."""
    d = rings.withColumn("b", geometry.bbox(F.col("ring")))
    at = lambda c: F.floor(F.col(c) / float(size)).cast("long")
    d = d.withColumn("col", F.explode(F.sequence(at("b.x0"), at("b.x1")))).withColumn("row", F.explode(F.sequence(at("b.y0"), at("b.y1"))))
    box = F.struct((F.col("col") * float(size)).alias("x0"), (F.col("row") * float(size)).alias("y0"), ((F.col("col") + 1) * float(size)).alias("x1"), ((F.col("row") + 1) * float(size)).alias("y1"))
    d = d.withColumn("box", box)
    whole = (F.col("b.x0") >= F.col("box.x0")) & (F.col("b.x1") <= F.col("box.x1")) & (F.col("b.y0") >= F.col("box.y0")) & (F.col("b.y1") <= F.col("box.y1"))
    # rings inside one tile stay as they are; the others are cut by expressions, side by side
    uncut = d.where(whole).withColumn("cut", F.lit(False))
    # an exploded list of one: the cut is made once, however often the ring is read afterwards
    parts = F.filter(F.array(polygons.clip_ring(F.col("ring"), F.col("box"))), lambda r: F.size(r) > 0)
    cut = d.where(~whole).withColumn("ring", F.explode(parts)).withColumn("cut", F.lit(True))
    name = F.concat(F.col("id").cast("string"), F.lit("@"), F.col("col").cast("string"), F.lit("_"), F.col("row").cast("string"))
    return uncut.unionByName(cut).select("id", "col", "row", "ring", F.when(F.col("cut"), name).otherwise(F.col("id").cast("string")).alias("fragment_id"), F.when(F.col("cut"), F.col("id")).alias("fragment_of"))


def split(points: DataFrame, size: float, most: int, deepest: int = 12) -> DataFrame:
    """Adaptive quad split: points (x, z) with the tile (col, row at level s, size / 2**s) in which at most ``most``
    points lie; identical points stay together at the deepest level. One aggregation a level, over counts only
    of the tiles still too large."""
    from cartolith.plans.tables import materialise

    done, rest = None, points
    for s in range(deepest + 1):
        step = size / 2**s
        d = rest.withColumn("s", F.lit(s)).withColumn("col", F.floor(F.col("x") / step).cast("long")).withColumn("row", F.floor(F.col("z") / step).cast("long"))
        large = d.groupBy("col", "row").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select("col", "row")
        large = materialise(large)
        last = s == deepest or not large.limit(1).count()
        fits = d if last else d.join(large, ["col", "row"], "left_anti")
        done = fits if done is None else done.unionByName(fits)
        if last:
            return done
        rest = d.join(large, ["col", "row"], "left_semi").drop("s", "col", "row")
    return done


def metrics(sizes: DataFrame) -> DataFrame:
    """lod, tiles, largest, total of bytes, and median and p95: the values at floor((n-1) q) in order."""
    q = floor_percentiles(sizes, "lod", "bytes", {"median": 0.5, "p95": 0.95})
    return sizes.groupBy("lod").agg(F.count(F.lit(1)).alias("tiles"), F.max("bytes").alias("largest"), F.sum("bytes").alias("total")).join(q, "lod")


def planned(tiles: DataFrame, view: tuple[float, float, float, float], lod: int, limit: int = 64) -> DataFrame:
    """Tiles that a view (x0, z0, x1, z1) needs, centre first: those of the level, or else of the nearest finer, or else
    coarser level that covers it. tiles: lod, tile_id, x0, z0, x1, z1."""
    x0, z0, x1, z1 = view
    seen = tiles.where((F.col("x1") > x0) & (F.col("x0") < x1) & (F.col("z1") > z0) & (F.col("z0") < z1))
    order = [lod, *range(lod - 1, -1, -1), *range(lod + 1, len(SIZES))]
    rank = F.array_position(F.array(*[F.lit(v) for v in order]), F.col("lod").cast("int"))
    best = seen.agg(F.min(rank)).first()[0]
    if best is None:
        return seen
    away = F.hypot((F.col("x0") + F.col("x1")) / 2 - (x0 + x1) / 2, (F.col("z0") + F.col("z1")) / 2 - (z0 + z1) / 2)
    return seen.where(F.col("lod") == order[best - 1]).withColumn("away", away).orderBy("away", "tile_id").limit(limit)
