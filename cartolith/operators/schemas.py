"""Strict schemas of features: what JSON texts may hold, as data, compiled to one expression that names every fault by its path.

Texts are parsed to variants once. A schema is a dictionary of fields, each with the check of its value; ``compiled`` turns it into a Column of the faults: keys that
are missing or unknown, values of another type, too small, too large, empty, or none of a choice. An optional field may be left out but not be null.
Coordinates are judged as a whole by the type of all their values, then by size; rings and holes by their index. Rows are split into sound and quarantined
ones by the same expression, so nothing is shuffled and nothing is lost.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolith.functions import geometry
from cartolith.functions.polygons import in_ring, let, point, rest

Check = Callable[[Column, Column], Column]
_FAULTS = "array<struct<path:string,problem:string>>"
_NUMBER = r"(BIGINT|DOUBLE|FLOAT|DECIMAL\(\d+,\d+\))"
#: fixed values: how far apart the ends of a closed ring may lie, and the area that a ring must exceed
CLOSED, LEAST_AREA = 1e-9, 1e-16


def fault(bad: Column, path: Column, problem: str) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), F.struct(path.alias("path"), F.lit(problem).alias("problem")))


def faults(*each: Column) -> Column:
    return F.array_compact(F.array(*each)).cast(_FAULTS)


def none() -> Column:
    return F.array().cast(_FAULTS)


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _get(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


def text(least: int = 0, pattern: str | None = None, choice: tuple[str, ...] | None = None) -> Check:
    def check(v: Column, path: Column) -> Column:
        s = _get(v, "string")
        found = [fault(F.length(s) < least, path, "empty")] if least else []
        found += [fault(~s.rlike(pattern), path, "pattern")] if pattern else []
        found += [fault(~s.isin(*choice), path, "choice")] if choice else []
        return F.when(_kind(v) != "STRING", faults(fault(F.lit(True), path, "type"))).otherwise(faults(*found) if found else none())

    return check


def number(low: float | None = None, high: float | None = None, whole: bool = False) -> Check:
    def check(v: Column, path: Column) -> Column:
        n = _get(v, "double")
        found = [fault(F.isnan(n) | (F.abs(n) == float("inf")), path, "finite")]
        found += [fault(n != F.floor(n), path, "whole")] if whole else []
        found += [fault(n < low, path, "low")] if low is not None else []
        found += [fault(n > high, path, "high")] if high is not None else []
        return F.when(~_kind(v).rlike(f"^{_NUMBER}$"), faults(fault(F.lit(True), path, "type"))).otherwise(faults(*found))

    return check


def truth() -> Check:
    return lambda v, path: faults(fault(_kind(v) != "BOOLEAN", path, "type"))


def _object(v: Column) -> Column:
    return F.when(_kind(v).startswith("OBJECT<"), v.try_cast("map<string,variant>"))


def record() -> Check:
    """An object of any keys."""
    return lambda v, path: faults(fault(_object(v).isNull(), path, "type"))


def items(check: Check, least: int = 0) -> Check:
    """An array whose items pass a check."""

    def whole(v: Column, path: Column) -> Column:
        def each(a: Column) -> Column:
            inner = F.flatten(F.transform(a, lambda x, i: check(x, F.concat(path, F.lit("."), i.cast("string")))))
            return F.concat(faults(fault(F.size(a) < least, path, "few")), inner)

        array = F.when(_kind(v).startswith("ARRAY<"), v.try_cast("array<variant>"))
        return let(array, lambda a: F.when(a.isNull(), faults(fault(F.lit(True), path, "type"))).otherwise(each(a)))

    return whole


@dataclass(frozen=True)
class Field:
    check: Check
    required: bool = False


def _at(path: Column, key: Column) -> Column:
    return F.when(path == "", key).otherwise(F.concat(path, F.lit("."), key))


def _fields(m: Column, path: Column, fields: dict[str, Field]) -> Column:
    """A key that is not there is null, a null of the text is a variant and fails as another type. Fields of one check share its expression."""
    alike: dict[tuple[int, bool], list[str]] = {}
    for name, field in fields.items():
        alike.setdefault((id(field.check), field.required), []).append(name)

    def each(check: Check, required: bool) -> Callable[[Column], Column]:
        gone = lambda n: faults(fault(F.lit(True), _at(path, n), "missing")) if required else none()
        return lambda n: let(m[n], lambda v: F.when(v.isNull(), gone(n)).otherwise(check(v, _at(path, n))))

    groups = [F.flatten(F.transform(F.array(*[F.lit(n) for n in names]), each(fields[names[0]].check, required))) for (_, required), names in alike.items()]
    return F.concat(none(), *groups)


def _unknown(m: Column, path: Column, names: tuple[str, ...]) -> Column:
    extra = F.array_sort(F.array_except(F.map_keys(m), F.array(*[F.lit(n) for n in names])))
    return F.transform(extra, lambda k: F.struct(F.when(path == "", k).otherwise(F.concat(path, F.lit("."), k)).alias("path"), F.lit("unknown").alias("problem")))


def strict(fields: dict[str, Field]) -> Check:
    """An object of these fields and no others."""

    def check(v: Column, path: Column) -> Column:
        each = lambda m: F.concat(_fields(m, path, fields), _unknown(m, path, tuple(fields)))
        return let(_object(v), lambda m: F.when(m.isNull(), faults(fault(F.lit(True), path, "type"))).otherwise(each(m)))

    return check


def _ring_faults(ring: Column, path: Column) -> Column:
    """ring: array<array<double>> of pairs."""

    def shape(p: Column) -> Column:
        a, b = F.get(p, F.lit(0)), F.get(p, F.size(p) - 1)
        twice = F.exists(geometry.edges(p), lambda e: (e["a"]["x"] == e["b"]["x"]) & (e["a"]["y"] == e["b"]["y"]))
        return faults(fault(F.hypot(a["x"] - b["x"], a["y"] - b["y"]) > CLOSED, path, "open"), fault(F.abs(geometry.signed_area(p)) <= LEAST_AREA, path, "no area"), fault(twice, path, "repeats a point"))

    return F.when(F.size(ring) < 4, faults(fault(F.lit(True), path, "few"))).otherwise(let(F.transform(ring, lambda c: point(c[0], c[1])), shape))


def _polygon_faults(rings: Column, path: Column) -> Column:
    """rings: array<array<array<double>>>; holes are held against the exterior where all rings have points."""
    at = lambda i: F.concat(path, F.lit("."), i.cast("string"))
    each = F.flatten(F.transform(rings, lambda r, i: _ring_faults(r, at(i))))

    def of_holes(p: Column) -> Column:
        outer = F.get(p, F.lit(0))
        size = lambda r: F.abs(geometry.signed_area(r))
        hole = lambda h, i: faults(fault(size(h) >= size(outer), at(i + 1), "not smaller"), fault(~in_ring(h[0]["x"], h[0]["y"], outer), at(i + 1), "outside"))
        return F.flatten(F.transform(rest(p), hole))

    points = F.transform(rings, lambda r: F.transform(r, lambda c: point(c[0], c[1])))
    holes = F.when(F.forall(rings, lambda r: F.size(r) > 0), let(points, of_holes)).otherwise(none())
    return F.when(F.size(rings) < 1, faults(fault(F.lit(True), path, "few"))).otherwise(F.concat(each, holes))


#: geometry types with the depth of their coordinates
DEPTH = {"Point": 1, "LineString": 2, "MultiLineString": 3, "Polygon": 3, "MultiPolygon": 4}


def _coordinates(kind: str, v: Column, path: Column) -> Column:
    depth = DEPTH[kind]
    typed = _kind(v).rlike("^" + "ARRAY<" * depth + f"({_NUMBER}|VOID)" + ">" * depth + "$") | (_kind(v).rlike("^(ARRAY<){1," + str(depth) + "}VOID>{1," + str(depth) + "}$"))
    values = v.try_cast("array<" * depth + "double" + ">" * depth)
    finite = lambda c: (F.size(c) == 2) & F.forall(c, lambda n: n.isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf")))
    sound = {1: finite, 2: lambda a: F.forall(a, finite), 3: lambda a: F.forall(a, lambda b: F.forall(b, finite)), 4: lambda a: F.forall(a, lambda b: F.forall(b, lambda c: F.forall(c, finite)))}[depth]

    def shape(a: Column) -> Column:
        at = lambda i: F.concat(path, F.lit("."), i.cast("string"))
        few = lambda c, n, p: faults(fault(F.size(c) < n, p, "few"))
        if kind == "Point":
            return none()
        if kind == "LineString":
            return few(a, 2, path)
        if kind == "MultiLineString":
            return F.concat(few(a, 1, path), F.flatten(F.transform(a, lambda line, i: few(line, 2, at(i)))))
        if kind == "Polygon":
            return _polygon_faults(a, path)
        return F.concat(few(a, 1, path), F.flatten(F.transform(a, lambda p, i: _polygon_faults(p, at(i)))))

    wrong = lambda problem: faults(fault(F.lit(True), path, problem))
    return F.when(~typed, wrong("type")).otherwise(let(values, lambda a: F.when(F.coalesce(sound(a), F.lit(False)), shape(a)).otherwise(wrong("pair"))))


def shape_of(*kinds: str) -> Check:
    """A geometry of one of these types, with type and coordinates and nothing else."""

    def check(v: Column, path: Column) -> Column:
        def whole(m: Column) -> Column:
            kind = F.when(_kind(m["type"]) == "STRING", _get(m["type"], "string"))
            of_kind = none()
            for k in kinds:
                of_kind = F.when(kind == k, _coordinates(k, m["coordinates"], _at(path, F.lit("coordinates")))).otherwise(of_kind)
            gone = faults(fault(F.lit(True), _at(path, F.lit("coordinates")), "missing"))
            body = F.concat(F.when(m["coordinates"].isNull(), gone).otherwise(of_kind), _unknown(m, path, ("type", "coordinates")))
            return F.when(F.coalesce(kind.isin(*kinds), F.lit(False)), body).otherwise(faults(fault(F.lit(True), _at(path, F.lit("type")), "choice")))

        return let(_object(v), lambda m: F.when(m.isNull(), faults(fault(F.lit(True), path, "type"))).otherwise(whole(m)))

    return check


def _optional(check: Check, *names: str) -> dict[str, Field]:
    return {n: Field(check) for n in names}


def _required(check: Check, *names: str) -> dict[str, Field]:
    return {n: Field(check, True) for n in names}


_WORD, _ANY = text(1), text()
_COUNT, _SIZE = number(0, whole=True), number(0)
_SHAPE = shape_of(*DEPTH)

# fixed values: the fields of features, which must equal the feeds' own
REFERENCE = _required(_WORD, "source", "timestamp") | _optional(_ANY, "url", "license") | _optional(text(pattern="^[a-fA-F0-9]{64}$"), "sha256") | _optional(_COUNT, "recordCount")
PROVENANCE = _required(_WORD, "featureId", "property", "winner", "timestamp") | _required(items(_WORD, 1), "contenders") | _required(number(1, whole=True), "priority")
BASE = (
    _required(_WORD, "stableId")
    | _required(_SHAPE, "geometry")
    | _optional(_SHAPE, "localGeometry", "sourceGeometry")
    | _optional(_ANY, "sourceId", "name", "displayName", "address")
    | _optional(number(), "lon", "lat", "x", "z")
    | _optional(items(_ANY), "names")
    | _optional(text(choice=("high", "medium", "low")), "confidence")
    | _optional(text(choice=("active", "uncertain", "inferred", "unresolved")), "status")
    | _optional(items(strict(PROVENANCE)), "provenance")
    | _optional(items(strict(REFERENCE)), "sourceRefs")
    | _optional(_WORD, "fragmentId", "parentStableId", "fragmentOf")
    | _optional(record(), "sourceMetadata")
)
_HEIGHT = _optional(_SIZE, "height") | _optional(text(choice=("explicit", "inferred_from_levels", "inferred_default")), "heightSource")
_CONTACT = _optional(_ANY, "category", "website", "phone", "openingHours", "wheelchair", "operator")
KINDS: dict[str, dict[str, Field]] = {
    "boundary": _required(_WORD, "territoryCode") | _required(shape_of("Polygon", "MultiPolygon"), "geometry"),
    "building": _HEIGHT | _optional(truth(), "heightInferred") | _optional(_COUNT, "levels", "buildingLevels") | _optional(_ANY, "buildingType", "roofType", "wallType", "buildingColour", "roofColour", "startDate") | _optional(number(whole=True), "yearConstructed"),
    "road": _optional(_ANY, "highway", "roadClass", "ref", "surface", "layer", "sidewalk") | _optional(_SIZE, "width") | _optional(truth(), "widthInferred", "bridge", "tunnel", "oneway", "lit")
    | _optional(text(choice=("explicit", "inferred_default")), "widthSource") | _optional(text(choice=("tunnel", "normal", "bridge")), "stratum") | _optional(_COUNT, "maxSpeed") | _optional(number(1, whole=True), "lanes"),
    "water": _optional(_ANY, "waterType") | _optional(truth(), "intermittent", "widthInferred", "tidal", "fictiveAxis", "isSurface") | _optional(_SIZE, "width") | _optional(text(choice=("yes", "no")), "salt"),
    "landuse": _required(_WORD, "landuseType") | _optional(_ANY, "category") | _optional(_SIZE, "area"),
    "poi": _required(_WORD, "poiType") | _CONTACT,
    "business": _required(_WORD, "businessName") | _CONTACT | _optional(_ANY, "poiType", "siret", "siren", "businessId", "brand", "legalName", "nafCode", "nafLabel", "administrativeStatus", "creationDate"),
    "address": _required(_WORD, "street") | _optional(_ANY, "housenumber", "postcode", "city", "source", "banId"),
    "transport": _required(_WORD, "transportType") | _optional(_ANY, "line", "route", "network", "operator", "ref", "publicTransport", "wheelchair"),
    "structure": _required(_WORD, "structureType") | _HEIGHT,
    "place": _required(_WORD, "placeType") | _optional(number(1, 6, whole=True), "importance") | _optional(_COUNT, "population"),
}


def compiled(kinds: dict[str, dict[str, Field]], base: dict[str, Field]) -> Callable[[Column], Column]:
    """Column of JSON text -> its faults (path, problem), sorted; a field of a kind replaces the base's of that name. Text that is null or no JSON has one fault, no path."""
    root = F.lit("")

    def of_object(m: Column) -> Column:
        kind = F.when(_kind(m["kind"]) == "STRING", _get(m["kind"], "string"))

        def of_kind(k: Column) -> Column:
            own = {name for fields in kinds.values() for name in fields} & set(base)
            common = [_fields(m, root, {n: f for n, f in base.items() if n not in own})]  # checked once, whatever the kind
            for name in own:
                common.append(F.when(k.isin(*[n for n, fields in kinds.items() if name in fields]), none()).otherwise(_fields(m, root, {name: base[name]})))
            special = none()
            for n, fields in kinds.items():
                special = F.when(k == n, F.concat(_fields(m, root, fields), _unknown(m, root, ("kind", *base, *fields)))).otherwise(special)
            return F.when(F.coalesce(k.isin(*kinds), F.lit(False)), F.concat(*common, special)).otherwise(faults(fault(F.lit(True), F.lit("kind"), "choice")))

        return let(kind, of_kind)

    def of_text(json: Column) -> Column:
        bad = lambda problem: faults(fault(F.lit(True), root, problem))
        parsed = lambda v: F.when(v.isNull(), bad("no JSON")).otherwise(let(_object(v), lambda m: F.when(m.isNull(), bad("type")).otherwise(F.array_sort(of_object(m)))))
        return let(F.try_parse_json(json), parsed)

    return of_text


def feature_faults(json: Column) -> Column:
    """Faults of features of the eleven kinds."""
    return compiled(KINDS, BASE)(json)


def parted(rows: DataFrame, json: str = "json", check: Callable[[Column], Column] = feature_faults) -> tuple[DataFrame, DataFrame]:
    """Sound rows as they came, and the others with their faults as ``faults``; that name must be free.

    A generator stands between the check and the filter, which would else be pushed down and evaluate the check again."""
    judged = rows.select("*", F.explode(F.array(check(F.col(json)))).alias("faults"))
    return judged.where(F.size("faults") == 0).select(*rows.columns), judged.where(F.size("faults") > 0)
