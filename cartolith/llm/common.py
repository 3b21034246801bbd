"""What the pipeline operators share: word counts, and values computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.plans.tables import discard, drop_folder, freed_shuffles, materialise, scratch, shared_dir

__all__ = ["WORD", "discard", "drop_folder", "freed_shuffles", "let", "materialise", "n_words", "scratch", "shared_dir", "table"]

#: One word: anything but space and 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, use) -> Column:
    """use(value) with value computed once: an expression inside a lambda would be computed at each call."""
    return F.element_at(F.transform(F.array(value), use), 1)


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
