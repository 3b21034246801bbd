"""Quality rules over features, tiles and search records; each gives the rows or totals that break it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def feature_issues(lon: Column, lat: Column, x: Column, z: Column, inside: Column, near_border: Column, height: Column, inferred: Column, references: Column, provenance: Column, most_height: float = 100) -> Column:
    """Names of what is wrong with a feature, in order: positions, territory, height that was inferred, sources, provenance."""
    finite = lambda c, low, high: F.coalesce(~F.isnan(c) & c.between(low, high), F.lit(False))
    local = finite(x, -1e9, 1e9) & finite(z, -1e9, 1e9)
    found = F.array(
        F.when(~(finite(lon, -180.0, 180.0) & finite(lat, -90.0, 90.0)), "position"), F.when(~local, "local_position"), F.when(~(inside | near_border), "outside"),
        F.when(inferred & (height > most_height), "inferred_height"), F.when(F.coalesce(F.size(references), F.lit(0)) < 1, "no_source"), F.when(F.coalesce(F.size(provenance), F.lit(0)) < 1, "no_provenance"),
    )
    return F.array_compact(found)


def missing_values(rows: DataFrame, column: str, wanted: tuple[str, ...]) -> DataFrame:
    """The wanted values (a list of the program) that no row has: missing."""
    have = rows.where(F.col(column).isin(*wanted)).agg(F.collect_set(column).alias("have"))
    return have.select(F.explode(F.array_except(F.array(*[F.lit(w) for w in wanted]), "have")).alias("missing"))


def tile_issues(tiles: DataFrame, fragments: DataFrame) -> DataFrame:
    """tile_id, issue: tiles whose count differs from their fragments, or that list a fragment twice; tiles: tile_id, count; fragments: tile_id, fragment_id."""
    each = fragments.groupBy("tile_id", "fragment_id").agg(F.count(F.lit(1)).alias("n")).groupBy("tile_id").agg(F.sum("n").alias("found"), F.max("n").alias("most"))
    d = tiles.join(each, "tile_id", "full_outer")
    found = F.array_compact(F.array(F.when(~F.col("count").eqNullSafe(F.coalesce("found", F.when(F.col("count").isNotNull(), F.lit(0).cast("long")))), "count"), F.when(F.col("most") > 1, "repeated")))
    return d.select("tile_id", F.explode(found).alias("issue"))


def fictive_issues(rows: DataFrame, key: str, fictive: Column, drawn: Column) -> DataFrame:
    """Keys of fictive axes that are drawn, and of real ones that are not."""
    return rows.where(F.coalesce(fictive, F.lit(False)) == F.coalesce(drawn, F.lit(False))).select(key)


def records_without_tile(records: DataFrame, tiles: DataFrame) -> DataFrame:
    """Search records that point to a tile which does not exist."""
    return records.join(tiles.select("tile_id").distinct(), "tile_id", "left_anti")


def shrinking(tiles: DataFrame) -> DataFrame:
    """lod, bytes, shrinks: whether each level is smaller in total than the finer one before it; tiles: lod, bytes."""
    totals = tiles.groupBy("lod").agg(F.sum("bytes").alias("bytes"))
    finer = totals.select((F.col("lod") + 1).alias("lod"), F.col("bytes").alias("finer"))
    return totals.join(finer, "lod", "left").select("lod", "bytes", F.coalesce(F.col("bytes") < F.col("finer"), F.lit(True)).alias("shrinks"))


def over_limit(tiles: DataFrame, limits: dict[int, int]) -> DataFrame:
    """Tiles above the bytes that their level may have; a build with any of them fails."""
    most = F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(v).cast("long"))])[F.col("lod")]
    return tiles.where(F.col("bytes") > most)


def require(rows: DataFrame, what: str) -> None:
    """Fails the run if there is any row; only one row is looked at."""
    first = rows.limit(1).collect()
    if first:
        raise ValueError(f"{what}: {first[0].asDict()}")


def usable(kind: Column, vertices: Column, finite: Column) -> Column:
    """Whether a geometry has enough finite vertices: one for a point, two for a line, four for a ring."""
    return finite & (vertices >= F.when(kind.isin("Point", "MultiPoint"), 1).when(kind.isin("LineString", "MultiLineString"), 2).otherwise(4))


def uncovered(cells: DataFrame) -> DataFrame:
    """cell, verdict of cells with territory: no_tile, missing:<kind>, unsearchable:<kind>; cells: cell, territory, tiles, kind, features, searchable."""
    verdict = F.when(F.col("tiles") == 0, F.array(F.lit("no_tile"))).when(F.col("features") == 0, F.array(F.concat(F.lit("missing:"), "kind"))).when(F.col("searchable") == 0, F.array(F.concat(F.lit("unsearchable:"), "kind")))
    return cells.where("territory").select("cell", F.explode(verdict).alias("verdict")).distinct()
