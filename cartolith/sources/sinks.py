"""Writers of the canonical tables and reports; each job's output appears as a whole or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_kind(rows: DataFrame, path: str, rows_per_file: int = 20_000) -> None:
    """Canonical rows, a folder per kind, files of bounded length."""
    rows.write.mode("overwrite").partitionBy("kind").option("maxRecordsPerFile", rows_per_file).parquet(path)


def json_lines(rows: DataFrame, path: str, gzip: bool = False) -> None:
    """One object a line; columns that are null are left out."""
    rows.write.mode("overwrite").option("compression", "gzip" if gzip else "none").json(path)


def provenance(rows: DataFrame, path: str) -> None:
    """The provenance array of each row as a table of its own."""
    rows.select(F.explode("provenance").alias("p")).select("p.*").write.mode("overwrite").parquet(path)


def manifest(fragments: DataFrame) -> DataFrame:
    """A row per tile: features, fragments and bounds; fragments: lod, tile_id, id, fragment_id, x0, z0, x1, z1, bytes."""
    return fragments.groupBy("lod", "tile_id").agg(
        F.count_distinct("id").alias("features"), F.count(F.lit(1)).alias("fragments"), F.sum("bytes").alias("bytes"),
        F.min("x0").alias("x0"), F.min("z0").alias("z0"), F.max("x1").alias("x1"), F.max("z1").alias("z1"),
    )


def sidecar(rows: DataFrame, path: str, *geometry: str) -> None:
    """The rows without their geometries, gzipped and line-wise."""
    json_lines(rows.drop(*geometry), path, gzip=True)


def source_manifest(shapes: list[DataFrame]) -> DataFrame:
    """source, url, license, acquired_at, records, sha256 of acquisition reports of differing shapes: what one calls otherwise or leaves out is filled in."""
    names = {"source": ("source", "name", "id"), "url": ("url", "uri", "href"), "license": ("license", "licence"), "acquired_at": ("acquiredAt", "timestamp", "fetchedAt"), "records": ("recordCount", "records", "count"), "sha256": ("sha256", "checksum")}
    out = None
    for d in shapes:
        pick = lambda options: F.coalesce(*[F.col(c).cast("string") for c in options if c in d.columns], F.lit(None).cast("string"))  # noqa: E731, B023
        part = d.select(*[pick(options).alias(name) for name, options in names.items()])
        out = part if out is None else out.unionByName(part)
    return out.withColumn("records", F.col("records").try_cast("long"))


def dataset_manifest(features: DataFrame, tiles: DataFrame, records: DataFrame) -> DataFrame:
    """part, name, n, bytes: how many features of each kind, tiles (with their bytes) of each level, and search records of each kind a dataset has."""
    none = F.lit(None).cast("long")
    count = lambda d, part, key, size: d.groupBy(F.lit(part).alias("part"), F.col(key).cast("string").alias("name")).agg(F.count(F.lit(1)).alias("n"), size.alias("bytes"))
    parts = count(features, "features", "kind", F.max(none)), count(tiles, "tiles", "lod", F.sum("bytes")), count(records, "records", "kind", F.max(none))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def coverage_manifest(cells: DataFrame, budget: int) -> DataFrame:
    """One row: cells with territory, those covered, bytes, and whether the bytes stay within the budget; cells: territory, tiles, bytes."""
    d = cells.where("territory")
    return d.agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col("tiles") > 0).alias("covered"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).withColumn("verdict", F.when(F.col("bytes") <= budget, "within").otherwise("over"))


def report(rows: DataFrame, path: str, title: str) -> None:
    """A report: its rows line by line, each with the title."""
    json_lines(rows.withColumn("report", F.lit(title)), path)


def outline_tile(manifest_rows: DataFrame, outline: DataFrame) -> DataFrame:
    """The manifest with a row for the territory's outline, a tile outside the grid; outline: x0, z0, x1, z1, bytes."""
    extra = outline.select(F.lit(-1).alias("lod"), F.lit("outline").alias("tile_id"), F.lit(1).cast("long").alias("features"), F.lit(1).cast("long").alias("fragments"), "bytes", "x0", "z0", "x1", "z1")
    return manifest_rows.unionByName(extra)


def minor_first(roads: DataFrame, by: str, rank: str, seq: str) -> DataFrame:
    """The roads of each tile in drawing order, minor ones (the greater rank) first and then as they came: by, roads (array)."""
    rest = [c for c in roads.columns if c not in (by, rank, seq)]
    order = F.array_sort(F.collect_list(F.struct((-F.col(rank)).alias("r"), F.col(seq).alias("s"), *rest)))
    return roads.groupBy(by).agg(order.alias("_r")).select(by, F.transform("_r", lambda v: F.struct(*[v[c].alias(c) for c in rest])).alias("roads"))
