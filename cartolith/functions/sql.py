"""The scalar and table functions of the library for SQL text: register(spark) makes temporary functions of the session.

All but one are SQL functions, whose bodies Spark inlines into the plan, so they cost what the same expressions cost in the DataFrame API, and
filters and columns are pushed through them. The exception is ``tile_cover``, a polymorphic Python table function over Arrow batches: it takes any
table with a box's four columns, and its result has the table's own columns beside the tile's. ``box_tiles`` gives the same tiles by LATERAL join
without Python.

Nulls in give null out; rings and lines are arrays of struct<x, y>.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from cartolith.functions import text

#: fixed values: tile sizes in metres by level
TILE_SIZES = {0: 2048, 1: 8192, 2: 32768}


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "\\'") + "'" for w in words)


_NAMES = ", ".join(f"'{k}', '{v}'" for k, v in text.ABBREVIATIONS.items())
_POINTS = "ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>"
_BOX = "STRUCT<x0: DOUBLE, y0: DOUBLE, x1: DOUBLE, y1: DOUBLE>"
_EDGES = "zip_with(slice(ring, 1, greatest(size(ring) - 1, 0)), slice(ring, 2, greatest(size(ring) - 1, 0)), (a, b) -> struct(a, b))"

_SIZE = f"map({', '.join(f'{k}, {v}.0D' for k, v in TILE_SIZES.items())})[lod]"

#: (signature, result, body), in an order in which bodies use earlier ones only
SCALARS = [
    ("normalize_text(t STRING)", "STRING", f"trim(regexp_replace(translate(replace(replace(lower(t), 'œ', 'oe'), 'æ', 'ae'), '{text._MARKED}’`', '{text._PLAIN}\\'\\''), '\\\\s+', ' '))"),
    ("fold_text(t STRING)", "STRING", "trim(regexp_replace(normalize_text(t), '[^a-z0-9&]+', ' '))"),
    ("text_tokens(t STRING)", "ARRAY<STRING>", "filter(split(fold_text(t), ' '), w -> w <> '')"),
    ("road_joined(t STRING)", "STRING", f"regexp_replace(regexp_replace(concat(' ', fold_text(t), ' '), '(?<= )({'|'.join(text.ROAD_PREFIXES)}) (?={text.ROAD_NUMBER} )', '$1'), '(?<= )r([nd])(?={text.ROAD_NUMBER} )', '$1')"),
    ("spelled_tokens(t STRING)", "ARRAY<STRING>", f"flatten(transform(filter(split(road_joined(t), ' '), w -> w <> ''), w -> split(coalesce(map({_NAMES})[w], w), ' ')))"),
    ("search_tokens(t STRING)", "ARRAY<STRING>", f"CASE WHEN exists(spelled_tokens(t), w -> w NOT IN ({_quoted(text.STOP_WORDS)})) THEN filter(spelled_tokens(t), w -> w NOT IN ({_quoted(text.STOP_WORDS)})) ELSE spelled_tokens(t) END"),
    ("house_number(t STRING)", "STRING", "array_join(text_tokens(regexp_replace(t, '(?i)^([0-9]+)([a-z]+)$', '$1 $2')), ' ')"),
    ("token_variants(t STRING)", "ARRAY<STRING>", """array_distinct(filter(array_compact(array(
        CASE WHEN length(t) > 3 AND right(t, 1) IN ('s', 'x') THEN substring(t, 1, length(t) - 1) END,
        CASE WHEN length(t) > 4 AND endswith(t, 'aux') THEN concat(substring(t, 1, length(t) - 3), 'al') END,
        CASE WHEN length(t) > 2 AND right(t, 1) NOT IN ('s', 'x') AND NOT rlike(t, '^[0-9]') THEN concat(t, 's') END)), v -> v <> t))"""),
    ("allowed_edits(n INT)", "INT", "CASE WHEN n < 4 THEN 0 WHEN n < 7 THEN 1 ELSE 2 END"),
    ("edits_within(a STRING, b STRING, most INT)", "INT", "CASE WHEN levenshtein(a, b, most) < 0 THEN most + 1 ELSE levenshtein(a, b, most) END"),
    ("name_quality(t STRING)", "INT", "int(rlike(t, '[à-ÿÀ-Þ]')) * 2 + int(rlike(t, '[a-z]') AND rlike(t, '[A-Z]')) + int(rlike(t, '[-\\'’]')) - int(NOT rlike(t, '[a-z]')) * 2"),
    ("name_tokens(t STRING)", "ARRAY<STRING>", f"filter(text_tokens(t), w -> w NOT IN ({_quoted(text.GENERIC_WORDS)}))"),
    ("share_found(a ARRAY<STRING>, b ARRAY<STRING>)", "DOUBLE", "size(filter(a, w -> array_contains(b, w))) / size(a)"),
    ("token_similarity(a ARRAY<STRING>, b ARRAY<STRING>)", "DOUBLE", "CASE WHEN size(a) = 0 OR size(b) = 0 THEN 0.0D WHEN size(a) <= size(b) THEN share_found(a, b) ELSE share_found(b, a) END"),
    ("name_similarity(a STRING, b STRING)", "DOUBLE", "token_similarity(name_tokens(a), name_tokens(b))"),
    ("postcode_of(t STRING)", "STRING", "nullif(regexp_extract(t, '\\\\b([0-9]{5})\\\\b', 1), '')"),
    ("fnv1a_32(t STRING)", "BIGINT", "aggregate(transform(filter(split(t, ''), c -> c <> ''), c -> CAST(ascii(c) AS BIGINT)), 2166136261L, (h, c) -> ((h ^ c) * 16777619L) & 4294967295L)"),
    (f"signed_area(ring {_POINTS})", "DOUBLE", f"aggregate({_EDGES}, 0.0D, (s, e) -> s + (e.a.x * e.b.y - e.b.x * e.a.y)) / 2"),
    (f"line_length(ring {_POINTS})", "DOUBLE", f"aggregate({_EDGES}, 0.0D, (s, e) -> s + hypot(e.b.x - e.a.x, e.b.y - e.a.y))"),
    (f"box_of(ring {_POINTS})", _BOX, "named_struct('x0', array_min(transform(ring, p -> p.x)), 'y0', array_min(transform(ring, p -> p.y)), 'x1', array_max(transform(ring, p -> p.x)), 'y1', array_max(transform(ring, p -> p.y)))"),
    (f"shared_area(a {_BOX}, b {_BOX})", "DOUBLE", "greatest(0.0D, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0.0D, least(a.y1, b.y1) - greatest(a.y0, b.y0))"),
    (f"box_area(a {_BOX})", "DOUBLE", "(a.x1 - a.x0) * (a.y1 - a.y0)"),
    (f"box_iou(a {_BOX}, b {_BOX})", "DOUBLE", "coalesce(shared_area(a, b) / nullif(box_area(a) + box_area(b) - shared_area(a, b), 0.0D), 0.0D)"),
    (f"in_ring(px DOUBLE, py DOUBLE, ring {_POINTS})", "BOOLEAN", f"size(filter({_EDGES}, e -> (e.a.y > py) <> (e.b.y > py) AND px < e.a.x + (py - e.a.y) / (e.b.y - e.a.y) * (e.b.x - e.a.x))) % 2 = 1"),
    ("tile_size(lod INT)", "DOUBLE", _SIZE),
    ("tile_name(lod INT, col BIGINT, row BIGINT)", "STRING", "concat('l', lod, '_', col, '_', row)"),
]
TABLES = [
    (
        "box_tiles(x0 DOUBLE, z0 DOUBLE, x1 DOUBLE, z1 DOUBLE, lod INT)",
        "col BIGINT, row BIGINT, tile_id STRING",
        # a generator takes no SQL function, so the size is spelled out
        f"""SELECT t.p.col, t.p.row, tile_name(lod, t.p.col, t.p.row) FROM explode(flatten(transform(
          sequence(CAST(floor(x0 / {_SIZE}) AS BIGINT), CAST(floor(x1 / {_SIZE}) AS BIGINT)), c -> transform(
          sequence(CAST(floor(z0 / {_SIZE}) AS BIGINT), CAST(floor(z1 / {_SIZE}) AS BIGINT)), r -> named_struct('col', c, 'row', r))))) t(p)""",
    ),
]


class TileCover:
    """Rows of any table with x0, z0, x1, z1, once for each tile of a level that the box touches: the table's columns, then col, row, tile_id."""

    @staticmethod
    def analyze(boxes: AnalyzeArgument, lod: AnalyzeArgument) -> AnalyzeResult:
        if not boxes.isTable:
            raise ValueError("the first argument is a table")
        names = [f.name for f in boxes.dataType.fields]
        if missing := [c for c in ("x0", "z0", "x1", "z1") if c not in names]:
            raise ValueError(f"the table has no column {', '.join(missing)}")
        if taken := [c for c in ("col", "row", "tile_id") if c in names]:
            raise ValueError(f"the table already has a column {', '.join(taken)}")
        if not lod.isConstantExpression or lod.value not in (0, 1, 2):
            raise ValueError("lod is a constant level: 0, 1 or 2")
        schema = T.StructType(list(boxes.dataType.fields))
        return AnalyzeResult(schema.add("col", T.LongType()).add("row", T.LongType()).add("tile_id", T.StringType()))

    def eval(self, box: T.Row, lod: int):
        from math import floor

        x0, z0, x1, z1 = box["x0"], box["z0"], box["x1"], box["z1"]
        if x0 is None or z0 is None or x1 is None or z1 is None:
            return
        size, own = (2048, 8192, 32768)[lod], tuple(box)
        rows = range(floor(z0 / size), floor(z1 / size) + 1)
        for col in range(floor(x0 / size), floor(x1 / size) + 1):
            for row in rows:
                yield own + (col, row, f"l{lod}_{col}_{row}")


def register(spark: SparkSession) -> list[str]:
    """Makes the functions, or makes them again; their names."""
    for signature, result, body in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {result} RETURN {body}")
    for signature, result, body in TABLES:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS TABLE ({result}) RETURN {body}")
    spark.udtf.register("tile_cover", udtf(TileCover, useArrow=True))
    return [s.split("(")[0] for s, *_ in SCALARS + TABLES] + ["tile_cover"]
