"""Readers of the feeds: GeoJSON, line-wise GeoJSON, the address table, and web pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FEATURE = "struct<type:string,id:string,geometry:struct<type:string,coordinates:string>,properties:map<string,string>>"
# fixed values: the columns of the address table, in order
ADDRESS_COLUMNS = (
    "id", "id_fantoir", "numero", "rep", "nom_voie", "code_postal", "code_insee", "nom_commune", "code_insee_ancienne_commune", "nom_ancienne_commune", "x", "y",
    "lon", "lat", "type_position", "alias", "nom_ld", "libelle_acheminement", "nom_afnor", "source_position", "source_nom_voie", "certification_commune", "cad_parcelles",
)


def feature_collection(spark: SparkSession, path: str) -> DataFrame:
    """Features of GeoJSON collections, one row each; a truncated file fails."""
    d = spark.read.schema(f"features array<{FEATURE}>").option("mode", "FAILFAST").json(path, multiLine=True)
    return d.select(F.explode("features").alias("f")).select("f.*")


def feature_lines(spark: SparkSession, path: str) -> DataFrame:
    """Features of files with one feature a line (gzip too); lines that are no feature come with a null id and their text."""
    d = spark.read.text(path).select(F.regexp_replace(F.trim("value"), ",$", "").alias("line")).where(~F.col("line").isin("", "[", "]"))
    return d.select(F.from_json("line", FEATURE).alias("f"), "line").select("f.*", "line")


def addresses(spark: SparkSession, path: str) -> DataFrame:
    """The ;-separated address table; names and order of its columns must be as pinned. Bad rows go to _corrupt."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (*ADDRESS_COLUMNS, "_corrupt")])
    header = spark.read.text(path).limit(1).first()
    if header is None or header[0].lstrip("﻿").split(";") != list(ADDRESS_COLUMNS):
        raise ValueError("address table: the header differs from the pinned columns")
    return spark.read.schema(schema).csv(path, sep=";", header=True, enforceSchema=False, columnNameOfCorruptRecord="_corrupt")


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))


def page_text(html: Column, most: int = 8000) -> Column:
    """Visible text: without script, style and tags, in single spaces, cut at most characters."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"(?s)<[^>]*>", " ")
    return F.substring(F.trim(F.regexp_replace(bare, r"\s+", " ")), 1, most)


def json_array(spark: SparkSession, path: str, field: str, schema: str) -> DataFrame:
    """Items of a named array inside JSON objects, one row each; a truncated file fails."""
    d = spark.read.schema(f"`{field}` array<{schema}>").option("mode", "FAILFAST").json(path, multiLine=True)
    return d.select(F.explode(field).alias("item")).select("item.*")


def json_header(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """The scalar fields of the objects in files whose bulk is an array: only the named columns are read. path comes with them."""
    return spark.read.schema(columns).json(path, multiLine=True).withColumn("path", F.col("_metadata.file_path"))


def canonical_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of line-wise canonical files; a line that holds two glued records or half of one fails the read."""
    # a line is read as a list of one, in which a second record without a comma is an error
    one = F.from_json(F.concat(F.lit("["), "value", F.lit("]")), f"array<struct<{schema}>>", {"mode": "FAILFAST"})
    d = spark.read.text(path).where(F.trim("value") != "").select(one.alias("r"))
    return d.select(F.assert_true(F.size("r") == 1, "a line is not one record").alias("sound"), F.get("r", F.lit(0)).alias("r")).where("sound is null").select("r.*")


def survey_layer(spark: SparkSession, path: str, layer: str, where: str | None = None) -> DataFrame:
    """Attributes and geometry (bytes) of one layer of a survey package, a SQLite file that every task can open, read in ranges of its row ids.

    where is a condition on the layer's attributes and is run by the file itself."""
    from . import package

    return package.layer(spark, path, layer, where)


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    """The first of some candidate paths (a list of the program) that exists."""
    conf = spark._jsc.hadoopConfiguration()
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(conf).exists(p):
            return path
    return None


def sidecars(spark: SparkSession, path: str, schema: str, *sound: Column) -> DataFrame:
    """Rows of gzipped line-wise sidecars, with ok, whether all conditions hold; rows that are no JSON have ok false."""
    d = spark.read.schema(schema + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    ok = F.col("_corrupt").isNull()
    for condition in sound:
        ok = ok & F.coalesce(condition, F.lit(False))
    return d.withColumn("ok", ok)


def recount(spark: SparkSession, path: str, lon: int, lat: int, commune: int, sep: str = ";") -> DataFrame:
    """An independent count of a delimited file's lines by commune: lines, blanks, headers (the first line of a file), and positions that are no numbers."""
    d = spark.read.text(path).select("value", (F.col("_metadata.file_block_start") == 0).alias("top"), F.monotonically_increasing_id().alias("at"), F.col("_metadata.file_path").alias("path"))
    first = d.where("top").groupBy("path").agg(F.min("at").alias("at"), F.lit(True).alias("head"))
    d = d.join(first, ["path", "at"], "left").withColumn("head", F.coalesce("head", F.lit(False))).withColumn("blank", F.trim("value") == "")
    cells = F.split("value", F.lit(sep))
    number = lambda i: F.get(cells, F.lit(i)).try_cast("double")
    data = ~F.col("head") & ~F.col("blank")
    broken = F.coalesce(F.isnan(number(lon)) | F.isnan(number(lat)), F.lit(False)) | number(lon).isNull() | number(lat).isNull()
    return d.groupBy(F.when(data, F.get(cells, F.lit(commune))).alias("commune")).agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(F.col("head")).alias("headers"), F.count_if(F.col("blank") & ~F.col("head")).alias("blanks"), F.count_if(data & broken).alias("broken")
    )


def toponyms(layers: dict[str, tuple[DataFrame, str]], communes: DataFrame, size: float) -> DataFrame:
    """layer, name, key, commune_id, x, z: place names of several layers (each with its name column, x and z) in the commune whose box holds them."""
    from cartolith.functions.names import toponym_keys
    from cartolith.operators.joins import contained

    rows = None
    for layer, (d, name) in layers.items():
        part = d.where(F.col(name).isNotNull()).select(F.lit(layer).alias("layer"), F.col(name).alias("name"), "x", "z")
        rows = part if rows is None else rows.unionByName(part)
    found = contained(rows, communes, size).withColumnRenamed("box_id", "commune_id")
    return found.select("layer", "name", F.explode(toponym_keys(F.col("name"))).alias("key"), "commune_id", "x", "z")
