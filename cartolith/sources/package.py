"""Layers of survey packages: SQLite files, read by tasks in ranges of row ids."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_TYPES = {"INTEGER": "long", "MEDIUMINT": "long", "INT": "long", "REAL": "double", "DOUBLE": "double", "FLOAT": "double", "BOOLEAN": "long", "BLOB": "binary"}


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def columns(path: str, layer: str) -> list[tuple[str, str]]:
    """Names and Spark types of a layer's columns; geometries are bytes, what is not known is text."""
    with _open(path) as db:
        shapes = {r[0] for r in db.execute("select column_name from gpkg_geometry_columns where table_name = ?", (layer,))}
        return [(r[1], "binary" if r[1] in shapes else _TYPES.get(r[2].split("(")[0].upper(), "string")) for r in db.execute(f"pragma table_info({_quoted(layer)})")]


def layer(spark: SparkSession, path: str, name: str, where: str | None = None, rows: int = 50_000) -> DataFrame:
    """One row a feature. The driver only looks at the layer's columns and its smallest and largest row id."""
    fields = columns(path, name)
    schema = ", ".join(f"`{c}` {t}" for c, t in fields)
    with _open(path) as db:
        low, high = db.execute(f"select min(rowid), max(rowid) from {_quoted(name)}").fetchone()
    kinds = {"long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "string": pa.string()}
    query = f"select {', '.join(_quoted(c) for c, _ in fields)} from {_quoted(name)} where rowid >= ? and rowid < ?" + (f" and ({where})" if where else "")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db = _open(path)
        for batch in batches:
            for start in batch.column("id").to_pylist():
                cursor = db.execute(query, (start, start + rows))
                while found := cursor.fetchmany(10_000):
                    cells = list(zip(*found))
                    yield pa.RecordBatch.from_arrays([pa.array([v if v is None or t != "string" else str(v) for v in col], kinds[t]) for col, (_, t) in zip(cells, fields)], names=[c for c, _ in fields])
        db.close()

    if low is None:
        return spark.createDataFrame([], schema)
    starts = spark.range(low, high + 1, rows)
    return starts.repartition(max(1, min(1000, (high - low) // rows + 1))).mapInArrow(read, schema)
