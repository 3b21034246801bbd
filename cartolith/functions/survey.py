"""Features of the national survey: road classes, types by nature, and the boosts of search records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import coerce
from .names import nature_key

# fixed values: types by folded nature; what is not listed is other
STRUCTURES = {
    "pont": "bridge", "tunnel": "tunnel", "barrage": "dam", "ecluse": "lock", "quai": "quay", "mur": "wall", "mur de soutenement": "retaining_wall",
    "mur anti-bruit": "noise_wall", "cloture": "fence", "ruines": "ruins", "fronton de pelote basque": "sports_wall", "autre ligne descriptive": "other",
}
LAND_USES = {
    "bois": "wood", "foret fermee de feuillus": "forest", "foret fermee mixte": "forest", "foret fermee de coniferes": "forest", "foret ouverte": "forest",
    "lande ligneuse": "heath", "peupleraie": "poplar", "vigne": "vineyard", "verger": "orchard", "reservoir d'eau ou chateau d'eau au sol": "reservoir",
    "chateau d'eau": "water_tower", "reservoir industriel": "industrial_reservoir", "civil": "cemetery", "militaire": "cemetery", "militaire etranger": "cemetery",
    "terrain de tennis": "sports", "grand terrain de sport": "sports", "petit terrain multi-sports": "sports", "carriere equestre": "sports", "bassin de natation": "sports",
    "piste de sport": "sports", "site natura 2000": "reserve", "site acquis ou assimile des conservatoires d'especes naturels": "reserve", "arrete de protection": "reserve",
}
POINTS = {
    "source": "spring", "source captee": "spring", "point d'eau": "water_point", "citerne": "cistern", "fontaine": "fountain", "lavoir": "washhouse", "perte": "sink",
    "resurgence": "resurgence", "marais": "marsh", "croix": "cross", "clocher": "bell_tower", "transformateur": "transformer", "antenne": "antenna",
    "autre construction elevee": "elevated_structure", "cheminee": "chimney", "calvaire": "calvary", "puits d'hydrocarbures": "well", "torchere": "torchere",
}
TRANSPORTS = {
    "parking": "parking", "carrefour": "roundabout", "rond-point": "roundabout", "peage": "toll", "port": "port", "arret voyageurs": "bus_stop", "gare routiere": "bus_stop",
    "gare voyageurs": "station", "gare voyageurs uniquement": "station", "gare voyageurs et fret": "station", "areogare": "station",
    "aire de repos ou de service": "parking", "aire de triage": "parking", "service dedie aux vehicules": "parking", "tour de controle aerien": "tower",
    "piste en herbe": "runway", "piste en dur": "runway",
}
PLACES = {
    "lieu-dit habite": "hamlet", "lieu-dit non habite": "locality", "bois": "wood", "arbre": "tree", "sommet": "peak", "versant": "slope", "vallee": "valley",
    "plaine": "plain", "crete": "ridge", "gouffre": "sinkhole", "grotte": "cave", "ile": "island", "depression": "depression", "col": "col",
    "autre foret publique": "forest", "foret domaniale": "forest",
}
WATER_WIDTHS = {"entre 0 et 5 m": 2.5, "entre 5 et 15 m": 10.0, "entre 15 et 50 m": 32.5, "plus de 50 m": 60.0}
# fixed values: boosts and ranks of search records
PLACE_BOOST = {
    "town": 120, "city": 130, "village": 100, "suburb": 80, "quarter": 70, "neighbourhood": 60, "hamlet": 70, "settlement": 70, "isolated_dwelling": 50, "farm": 50,
    "locality": 50, "named_area": 55, "water_body": 55, "watercourse": 55, "forest": 50, "wood": 45, "peak": 50, "col": 45,
}
ROAD_BOOST = {"motorway": 60, "trunk": 55, "primary": 45, "secondary": 35, "tertiary": 25, "residential": 15, "unclassified": 10, "pedestrian": 15, "living_street": 12}
ROAD_RANK = {
    "motorway": 0, "trunk": 1, "primary": 2, "secondary": 3, "tertiary": 4, "residential": 5, "unclassified": 6, "pedestrian": 6, "living_street": 6, "service": 7,
    "track": 8, "cycleway": 9, "path": 9, "steps": 9,
}
TRANSPORT_BOOST = {"station": 110, "halt": 90, "aerodrome": 110, "airport": 110, "bus_station": 80, "bus_stop": 25, "platform": 25, "runway": 20, "parking": 30}
# fixed values: what each source's word weighs in conflation; an unknown source weighs nothing
SOURCE_WEIGHT = {
    "IGN BD TOPO": 100, "IGN ADMIN EXPRESS COG": 100, "sirene": 80, "annuaire-entreprises": 75, "ban": 70, "osm-auch": 65, "osm": 60, "osm-bulk": 55, "pagesjaunes": 40,
}


def mapped(key: Column, table: dict, default=None) -> Column:
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]
    return known if default is None else F.coalesce(known, F.lit(default))


def nature_type(nature: Column, table: dict[str, str]) -> Column:
    """Type of a nature, whatever its accents and case; other if the table lacks it."""
    return mapped(nature_key(nature), table, "other")


def road_class(nature: Column, importance: Column, admin: Column, urban: Column) -> Column:
    """Class of a road by its nature, its importance from 1 (through traffic) to 6, and its administrative class."""
    n, a = F.coalesce(nature_key(nature), F.lit("")), F.coalesce(nature_key(admin), F.lit(""))
    rank = F.coalesce(F.regexp_extract(F.trim(importance), "^([0-9]+)", 1).try_cast("int"), F.lit(99))
    motorway = n == "type autoroutier"
    return (
        F.when(n == "sentier", "path").when(n == "escalier", "steps").when(n == "piste cyclable", "cycleway").when(n == "bac ou liaison maritime", "ferry")
        .when(motorway & ((rank == 1) | a.contains("autoroute")), "motorway")
        .when(n.isin("chemin", "route empierree"), F.when(rank <= 4, "tertiary").otherwise("track"))
        .when(a.contains("nationale") | (rank == 1), "trunk").when(rank == 2, "primary").when(rank == 3, "secondary").when(rank == 4, "tertiary")
        .when(rank == 5, F.when(F.coalesce(urban, F.lit(False)), "residential").otherwise("unclassified")).when(rank == 6, "service")
        .when(motorway, "motorway").when(n == "route a 2 chaussees", "primary").otherwise("unclassified")
    )


def road_name(*names: Column) -> Column:
    """The first name that is not blank: of the address base, of the collaborative base, of the named route."""
    return F.coalesce(*[coerce.text(c) for c in names])


def road_ref(number: Column) -> Column:
    """Road numbers of a list with slashes, without those not communicated."""
    parts = F.filter(F.transform(F.split(number, "/"), lambda p: F.trim(p)), lambda p: (p != "") & (F.upper(p) != "NC"))
    return F.nullif(F.array_join(parts, " / "), F.lit(""))


def oneway(direction: Column) -> Column:
    d = nature_key(direction)
    return F.when(d.isin("sens direct", "sens inverse"), True).when(d == "double sens", False)


def drawn(fictive: Column) -> Column:
    """Fictive road segments and water axes are not drawn."""
    return ~F.coalesce(fictive, F.lit(False))


def place_boost(kind: Column, population: Column, importance: Column) -> Column:
    """Communes by the logarithm of their people, other places by type less four for each step of importance below 3."""
    commune = F.least(F.lit(320), F.floor(150 + 35 * F.log10(F.coalesce(population, F.lit(0)) + 10) + 0.5).cast("int"))
    other = mapped(kind, PLACE_BOOST, 40) - F.greatest(F.lit(0), F.coalesce(importance, F.lit(6)) - 3) * 4
    return F.when(kind == "commune", commune).otherwise(F.greatest(F.lit(0), other))


def street_boost(road: Column, length: Column) -> Column:
    """30, more by class, and 3 for each doubling of the length over 50 m, up to 20."""
    far = F.floor(F.log2(F.greatest(F.lit(1.0), length / 50)) * 3 + 0.5)
    return (30 + mapped(road, ROAD_BOOST, 0) + F.least(F.lit(20), far)).cast("long")
