"""Features as JSON texts, held against their strict schemas; the SQL states the faults that the keys plant."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartolith.operators import schemas

from .queries import query, table

#: kind and the field that it requires
_KINDS = (
    ("boundary", "territoryCode"), ("building", None), ("road", None), ("water", None), ("landuse", "landuseType"), ("poi", "poiType"), ("business", "businessName"), ("address", "street"), ("transport", "transportType"), ("structure", "structureType"), ("place", "placeType"),
)
_HIGH = "c_custkey % 11 in (1, 9)"
_PLANTED = f"""(select c_custkey, 'note' path, 'unknown' problem from customer where c_custkey % 7 = 0
 union all select c_custkey, 'stableId', 'empty' from customer where c_custkey % 5 = 0
 union all select c_custkey, 'geometry.coordinates.0', 'open' from customer where c_custkey % 13 = 0
 union all select c_custkey, 'height', case when {_HIGH} then 'low' else 'unknown' end from customer where c_custkey % 17 = 0
 union all select c_custkey, 'lon', 'type' from customer where c_acctbal < 0
 union all select c_custkey, 'sourceRefs.1.timestamp', 'missing' from customer where c_custkey % 19 = 0
 union all select c_custkey, ['territoryCode', '', '', '', 'landuseType', 'poiType', 'businessName', 'street', 'transportType', 'structureType', 'placeType'][c_custkey % 11 + 1], 'missing' from customer where c_custkey % 23 = 0 and c_custkey % 11 not in (1, 2, 3))"""


def texts(spark, d):
    """c_custkey, json."""
    k = F.col("c_custkey")
    at = lambda values: F.get(F.array(*[F.lit(v) for v in values]), (k % 11).cast("int"))
    own = at([f', "{field}": "x"' if field else "" for _, field in _KINDS])
    corners = "[%1$d, 0], [%2$d, 0], [%2$d, 10.5], [%1$d, 10]"
    ring = F.format_string(corners, k, k + 10)
    ring = F.when(k % 13 == 0, ring).otherwise(F.concat(ring, F.format_string(", [%d, 0]", k)))
    when = lambda test, value: F.when(test, F.lit(value)).otherwise(F.lit(""))
    json = F.concat(
        F.lit('{"kind": "'), at([kind for kind, _ in _KINDS]), F.lit('", "stableId": "'), F.when(k % 5 == 0, "").otherwise(k.cast("string")), F.lit('", "geometry": {"type": "Polygon", "coordinates": [['), ring, F.lit("]]}"),
        F.when(k % 23 == 0, "").otherwise(own), when(k % 7 == 0, ', "note": 1'), when(k % 17 == 0, ', "height": -1'), when(F.col("c_acctbal") < 0, ', "lon": null'),
        when(k % 19 == 0, ', "sourceRefs": [{"source": "s", "timestamp": "t"}, {"source": "s"}]'), F.lit("}"),
    )
    return table(spark, d, "customer").select("c_custkey", json.alias("json"))


@query(f"select * from {_PLANTED}")
def schema_faults(spark, d):
    """Every fault of every feature, by path."""
    return schemas.parted(texts(spark, d))[1].select("c_custkey", F.explode("faults").alias("f")).select("c_custkey", "f.path", "f.problem")


@query(f"select ['boundary', 'building', 'road', 'water', 'landuse', 'poi', 'business', 'address', 'transport', 'structure', 'place'][c_custkey % 11 + 1] kind, count(*) features from customer where c_custkey not in (select c_custkey from {_PLANTED}) group by 1")
def schema_sound(spark, d):
    """Sound features of each kind."""
    return schemas.parted(texts(spark, d))[0].groupBy(F.get_json_object("json", "$.kind").alias("kind")).agg(F.count(F.lit(1)).alias("features"))
