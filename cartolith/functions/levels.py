"""What each level of detail keeps, widths where a feature has none, and the category that a feature is shown by."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .osm_tags import TAG_CATEGORY, value_category
from .survey import mapped

# fixed values: ranks of roads on tiles, and widths in metres by class and type
TILE_RANK = {
    "motorway": 0, "trunk": 1, "primary": 2, "secondary": 3, "tertiary": 4, "residential": 5, "unclassified": 6, "service": 7, "track": 8, "path": 9, "footway": 9,
    "cycleway": 9, "steps": 9,
}
ROAD_WIDTHS = {"motorway": 12.0, "trunk": 9.0, "primary": 8.0, "secondary": 7.0, "tertiary": 6.0, "residential": 5.0, "service": 3.5, "track": 2.5, "path": 2.0, "footway": 2.0}
WATER_WIDTHS = {"river": 10.0, "canal": 6.0, "stream": 2.0, "brook": 2.0, "ditch": 1.5, "drain": 1.5}
# fixed values: land uses and transport that an overview shows; natures of vegetation that are read at all
OVERVIEW_LAND, OVERVIEW_TRANSPORT = ("forest", "wood", "vineyard", "orchard", "reserve", "industrial", "residential"), ("rail", "station", "aerodrome", "runway")
VEGETATION = (
    "Bois", "Forêt fermée de feuillus", "Forêt fermée mixte", "Forêt fermée de conifères", "Forêt ouverte", "Lande ligneuse", "Peupleraie", "Vigne", "Verger",
)


def road_rank(road: Column) -> Column:
    return mapped(road, TILE_RANK, 10)


def width(kind: Column, given: Column, subtype: Column) -> Column:
    """The given width if positive, else the default of a road's class or a water's type; 0 for other kinds."""
    default = F.when(kind == "road", mapped(subtype, ROAD_WIDTHS, 4.0)).when(kind == "water", mapped(subtype, WATER_WIDTHS, 3.0)).otherwise(0.0)
    return F.when(kind.isin("road", "water") & (given > 0), given).otherwise(default)


def keep_at(lod: Column, f) -> Column:
    """Whether a level keeps a feature; f gives the columns kind, subtype, name, area, length, surface, importance, width.

    The finest level keeps everything; the town level roads down to service, the larger buildings, waters and land, named places of interest and
    places but the least; the overview main roads, great waters and land of note, towns, rails and airfields. Communes stay everywhere."""
    kind, named, area, importance = f("kind"), f("name").isNotNull(), f("area"), F.coalesce(f("importance"), F.lit(6))
    surface = F.coalesce(f("surface"), F.lit(False))
    rank = road_rank(f("subtype"))
    town = (
        F.when(kind == "building", area >= 1500).when(kind == "road", rank <= 7).when(kind == "water", F.when(surface, area >= 400).otherwise(f("length") >= 150))
        .when(kind.isin("poi", "business"), named).when(kind == "landuse", area >= 2000).when(kind == "transport", (f("subtype") != "bus_stop") | named)
        .when(kind == "structure", area >= 1000).when(kind == "place", importance <= 5).otherwise(False)
    )
    great = F.when(surface, area >= 20_000).otherwise((f("length") >= 1500) & (named | (F.coalesce(f("width"), F.lit(0.0)) >= 5)))
    overview = (
        F.when(kind == "road", rank <= 4).when(kind == "water", great).when(kind == "landuse", (area >= 150_000) & f("subtype").isin(*OVERVIEW_LAND))
        .when(kind == "place", importance <= 3).when(kind == "transport", f("subtype").isin(*OVERVIEW_TRANSPORT)).otherwise(False)
    )
    always = (lod == 0) | (kind == "boundary") | (kind == "place") & (f("subtype") == "commune")
    return F.coalesce(F.when(always, True).when(lod == 1, town).otherwise(overview), F.lit(False))


def shown_category(candidates: list[Column], known: tuple[str, ...], table: dict[str, str] = TAG_CATEGORY) -> Column:
    """The first candidate that is a category or that the tag table maps to one, else other."""
    return F.coalesce(*[F.when(c.isin(*known), c).otherwise(value_category(c, table)) for c in candidates], F.lit("other"))


def read_at_all(layer: Column, department: Column, nature: Column, area: Column, wanted: str = "32") -> Column:
    """Layer filters: communes of the department, vegetation of the listed natures from 2,000 m² on, all of other layers."""
    return F.when(layer == "communes", F.coalesce(department == wanted, F.lit(False))).when(layer == "vegetation", F.coalesce(nature.isin(*VEGETATION) & (area >= 2000), F.lit(False))).otherwise(True)
