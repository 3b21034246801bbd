"""The streaming twins of deduplication and banded counts. Rows that come after the watermark are dropped and counted; rows without a position go on apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_rows(stream: DataFrame, key: list[str], time: str, delay: str) -> DataFrame:
    """First row of each key within the delay; state goes with the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def banded_counts(stream: DataFrame, time: str, by: str, band: str, delay: str) -> DataFrame:
    """Rows and sum by tumbling band and group; also runs on a batch."""
    d = stream.withWatermark(time, delay) if stream.isStreaming else stream
    return d.groupBy(F.window(time, band).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("band"), by, "n", "total")


def late_rows(query) -> int:
    """Rows that a running query has dropped as late so far, by its progress reports."""
    return sum(int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"])


def placed(rows: DataFrame, x: str, z: str) -> tuple[DataFrame, DataFrame]:
    """Rows with an anchor, and those without one: these form a last band, which no distance ever merges."""
    known = F.col(x).isNotNull() & F.col(z).isNotNull()
    return rows.where(known), rows.where(~known)
