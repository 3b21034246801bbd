"""Kinds and categories of map elements by their tags, as one expression over a map<string, string> of tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: tag values by what they make of an element
ROADS = (
    "motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link", "unclassified",
    "residential", "living_street", "service", "road", "busway", "track", "path", "footway", "cycleway", "bridleway", "pedestrian", "steps", "corridor", "via_ferrata",
)
SURVEYED_ROADS = (
    "motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link", "unclassified",
    "residential", "living_street", "road", "busway",
)
ROAD_POINTS, BUS_STOPS, POLES = ("mini_roundabout", "motorway_junction"), ("bus_stop", "stop"), ("traffic_signals", "speed_camera")
NO_ROADS = (
    "construction", "proposed", "raceway", "rest_area", "bus_stop:condition", "platform", "crossing", "give_way", "street_lamp", "turning_circle", "turning_loop",
    "milestone", "elevator",
)
RAILS = ("rail", "light_rail", "subway", "tram", "narrow_gauge", "monorail", "funicular", "miniature", "preserved")
RAIL_STOPS = {"station": "station", "halt": "halt", "stop": "halt", "train_station_entrance": "station", "subway_entrance": "station"}
RAIL_POINTS = ("level_crossing", "crossing", "switch", "signal", "buffer_stop", "derail", "traverser", "turntable", "crane", "signal_box", "gantry", "radio", "siding", "spur", "yard")
NO_RAILS = ("abandoned", "disused", "razed", "proposed", "construction", "was", "removed", "demolished", "destroyed", "damaged", "unused", "closed", "obstructed")
STOPS = {"platform": "platform", "stop_position": "platform", "station": "station", "stop_area": "station"}
NO_STOPS = ("proposed", "construction", "disused", "abandoned")
AIRFIELDS = {"runway": "runway", "taxiway": "runway", "aerodrome": "aerodrome", "airport": "aerodrome", "heliport": "aerodrome"}
AIR_POINTS, NO_AIRFIELDS = ("gate",), ("apron", "terminal", "hangar", "windsock", "navigationaid", "beacon", "lighting")
WATERWAYS = ("river", "canal", "stream", "ditch", "drain", "riverbank")
WATER_POINTS = ("dam", "weir", "lock_gate", "waterfall", "spring", "drinking_water", "water_point", "wash")
WATER_AREAS, BASINS = ("water", "wetland"), ("reservoir", "basin")
NATURAL_AREAS = {"wood": "wood", "forest": "forest", "scrub": "scrub", "heath": "heath", "vineyard": "vineyard", "orchard": "orchard", "grassland": "grassland"}
NATURAL_POINTS = ("spring", "tree", "cave_entrance", "beach", "sand", "rock", "boulder")
LEISURE_AREAS = {"pitch": "sports", "sports_centre": "sports", "sports_hall": "sports", "stadium": "sports", "golf_course": "sports", "nature_reserve": "reserve"}
LEISURE_POINTS = ("horse_riding", "fishing", "fitness_station", "picnic_table", "outdoor_seating", "slipway", "swimming_pool", "bird_hide")
BUILT = ("bridge", "works", "windmill", "water_tower", "tower", "mast", "lighthouse", "chimney", "silo", "watermill", "wastewater_plant", "water_works", "observatory")
GATES = ("gate", "stile", "lift_gate", "swing_gate", "kissing_gate", "wicket_gate", "bump_gate")
POI_KEYS = ("shop", "amenity", "tourism", "historic", "office", "craft", "healthcare", "emergency", "information")
PLACE_IMPORTANCE = {
    "continent": 1, "country": 1, "state": 2, "region": 2, "province": 2, "county": 3, "municipality": 2, "city": 1, "town": 2, "borough": 3, "suburb": 4, "quarter": 5,
    "village": 3, "neighbourhood": 5, "city_block": 5, "locality": 5, "square": 5, "islet": 5, "hamlet": 6, "isolated_dwelling": 6, "farm": 6,
}
# fixed values: the order in which keys decide on a category, and the keys whose presence alone gives one
CATEGORY_KEYS = (
    "amenity", "healthcare", "emergency", "shop", "tourism", "historic", "railway", "public_transport", "aeroway", "highway", "leisure", "office", "craft", "man_made",
    "natural", "social_facility", "landuse", "building",
)
PRESENCE = {"shop": "shop", "office": "office", "craft": "contractor", "historic": "monument", "tourism": "attraction"}
# fixed values: tags and their categories
TAG_CATEGORY = {
    "amenity=restaurant": "restaurant", "amenity=fast_food": "fast_food", "amenity=food_court": "fast_food", "amenity=cafe": "cafe", "amenity=ice_cream": "cafe",
    "amenity=bar": "bar", "amenity=pub": "bar", "amenity=biergarten": "bar", "amenity=nightclub": "bar", "amenity=pharmacy": "pharmacy",
    "healthcare=pharmacy": "pharmacy", "amenity=doctors": "doctor", "healthcare=doctor": "doctor", "amenity=clinic": "hospital", "healthcare=clinic": "hospital",
    "amenity=hospital": "hospital", "healthcare=hospital": "hospital", "amenity=dentist": "dentist", "healthcare=dentist": "dentist", "healthcare=nurse": "nurse",
    "healthcare=physiotherapist": "nurse", "healthcare=alternative": "nurse", "healthcare=psychotherapist": "nurse", "healthcare=podiatrist": "nurse",
    "healthcare=speech_therapist": "nurse", "healthcare=midwife": "nurse", "healthcare=laboratory": "laboratory", "healthcare=centre": "doctor",
    "amenity=veterinary": "veterinary", "amenity=nursing_home": "nursing_home", "social_facility=nursing_home": "nursing_home",
    "amenity=social_facility": "nursing_home", "amenity=police": "police", "amenity=fire_station": "fire_station", "emergency=ambulance_station": "hospital",
    "emergency=defibrillator": "hospital", "tourism=hotel": "hotel", "tourism=motel": "hotel", "tourism=hostel": "hotel", "tourism=guest_house": "guest_house",
    "tourism=chalet": "guest_house", "tourism=apartment": "guest_house", "tourism=camp_site": "campsite", "tourism=caravan_site": "campsite", "amenity=fuel": "fuel",
    "amenity=charging_station": "charging", "amenity=parking": "parking", "amenity=bicycle_parking": "parking", "amenity=car_wash": "car_repair",
    "shop=car_repair": "car_repair", "shop=tyres": "car_repair", "shop=car": "car_dealer", "shop=car_parts": "car_dealer", "shop=motorcycle": "car_dealer",
    "railway=station": "train_station", "railway=halt": "train_station", "public_transport=station": "train_station", "highway=bus_stop": "bus_stop",
    "amenity=bus_station": "bus_stop", "aeroway=aerodrome": "airport", "amenity=taxi": "taxi", "amenity=bank": "bank", "amenity=atm": "atm",
    "amenity=bureau_de_change": "bank", "office=insurance": "insurance", "amenity=post_office": "post_office", "amenity=post_box": "post_office",
    "amenity=townhall": "town_hall", "office=government": "public_service", "amenity=courthouse": "public_service", "amenity=community_centre": "theatre",
    "amenity=social_centre": "public_service", "amenity=school": "school", "amenity=college": "university", "amenity=university": "university",
    "amenity=kindergarten": "kindergarten", "amenity=childcare": "kindergarten", "amenity=driving_school": "driving_school", "amenity=library": "library",
    "tourism=museum": "museum", "tourism=gallery": "museum", "amenity=arts_centre": "museum", "amenity=cinema": "cinema", "amenity=theatre": "theatre",
    "amenity=events_venue": "theatre", "amenity=place_of_worship": "place_of_worship", "building=church": "place_of_worship", "building=chapel": "place_of_worship",
    "building=cathedral": "place_of_worship", "historic=wayside_cross": "monument", "historic=wayside_shrine": "monument", "amenity=grave_yard": "cemetery",
    "landuse=cemetery": "cemetery", "tourism=attraction": "attraction", "tourism=viewpoint": "viewpoint", "tourism=artwork": "monument",
    "tourism=picnic_site": "park", "tourism=information": "tourist_info", "historic=castle": "castle", "historic=fort": "castle", "historic=tower": "castle",
    "historic=city_gate": "castle", "historic=monument": "monument", "historic=memorial": "monument", "historic=ruins": "monument",
    "historic=archaeological_site": "monument", "historic=manor": "castle", "historic=church": "place_of_worship", "historic=monastery": "place_of_worship",
    "man_made=windmill": "monument", "man_made=watermill": "monument", "man_made=water_tower": "water_tower", "man_made=tower": "water_tower",
    "man_made=wastewater_plant": "utility", "man_made=water_works": "utility", "amenity=recycling": "utility", "leisure=park": "park", "leisure=garden": "park",
    "leisure=nature_reserve": "park", "leisure=pitch": "sports", "leisure=sports_centre": "sports", "leisure=stadium": "sports", "leisure=golf_course": "sports",
    "leisure=horse_riding": "sports", "leisure=track": "sports", "leisure=swimming_pool": "swimming_pool", "leisure=water_park": "swimming_pool",
    "leisure=fitness_centre": "fitness", "amenity=spa": "fitness", "leisure=playground": "playground", "amenity=marketplace": "market", "amenity=toilets": "toilets",
    "amenity=drinking_water": "water_point", "amenity=fountain": "water_point", "natural=peak": "viewpoint", "natural=spring": "water_point",
    "shop=supermarket": "supermarket", "shop=convenience": "convenience", "shop=general": "convenience", "shop=greengrocer": "greengrocer", "shop=farm": "farm",
    "shop=bakery": "bakery", "shop=pastry": "bakery", "shop=butcher": "butcher", "shop=deli": "butcher", "shop=cheese": "greengrocer", "shop=seafood": "butcher",
    "shop=wine": "wine_shop", "shop=alcohol": "wine_shop", "craft=winery": "winery", "craft=distillery": "winery", "shop=hairdresser": "hairdresser",
    "shop=beauty": "beauty", "shop=cosmetics": "beauty", "shop=massage": "beauty", "shop=tattoo": "beauty", "shop=laundry": "laundry",
    "shop=dry_cleaning": "laundry", "shop=funeral_directors": "funeral", "office=estate_agent": "real_estate", "office=lawyer": "legal", "office=notary": "legal",
    "office=accountant": "accountant", "office=architect": "architect", "office=engineer": "architect", "shop=travel_agency": "travel_agency",
    "office=it": "it_media", "shop=clothes": "clothes", "shop=boutique": "clothes", "shop=fashion_accessories": "clothes", "shop=shoes": "shoes",
    "shop=florist": "florist", "shop=garden_centre": "florist", "shop=pet": "florist", "shop=hardware": "diy", "shop=doityourself": "diy", "shop=trade": "diy",
    "shop=furniture": "furniture", "shop=interior_decoration": "furniture", "shop=appliance": "furniture", "shop=kitchen": "furniture",
    "shop=electronics": "electronics", "shop=computer": "electronics", "shop=mobile_phone": "electronics", "shop=books": "books_news",
    "shop=newsagent": "books_news", "shop=stationery": "books_news", "shop=tobacco": "books_news", "shop=optician": "optician", "shop=hearing_aids": "optician",
    "shop=jewelry": "jewelry", "shop=sports": "sports_shop", "shop=bicycle": "sports_shop", "shop=outdoor": "sports_shop", "shop=gift": "gift_shop",
    "shop=toys": "gift_shop", "shop=antiques": "gift_shop", "shop=second_hand": "gift_shop", "shop=variety_store": "gift_shop",
}
# fixed values: the order in which keys are tried for a bare value
VALUE_KEYS = ("amenity", "shop", "healthcare", "tourism", "historic", "leisure", "office", "craft", "man_made", "natural", "railway", "highway", "emergency", "aeroway")


def tag(tags: Column, key: str) -> Column:
    """The trimmed value of a tag, null where it is missing or blank."""
    return F.nullif(F.trim(tags[key]), F.lit(""))


def _fate(kind: str | None, subtype: Column | None, mode: str | None, reason: str | None = None) -> Column:
    return F.struct(
        F.lit(kind).cast("string").alias("kind"), (subtype if subtype is not None else F.lit(None).cast("string")).alias("subtype"),
        F.lit(mode).cast("string").alias("mode"), F.lit(reason).cast("string").alias("reason"),
    )


def _among(value: Column, known) -> Column:
    return F.coalesce(value.isin(*known), F.lit(False))


def _mapped(value: Column, known: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in known.items() for x in pair])[value]


def _chain(*branches: tuple[Column, Column]) -> Column:
    """The first branch whose condition holds; the last one holds always."""
    out = F.when(*branches[0])
    for condition, value in branches[1:-1]:
        out = out.when(condition, value)
    return out.otherwise(branches[-1][1])


def classify(tags: Column) -> Column:
    """struct<kind, subtype, mode, reason> of an element: what it is and which geometry it needs, or why it is left out.

    One key after the other decides, from buildings to points of interest; mode is areal, linear, point or any."""
    excluded, unknown, always = _fate(None, None, None, "excluded_tag"), _fate(None, None, None, "unclassified_tags"), F.lit(True)
    t = lambda key: tag(tags, key)
    named = F.coalesce(*[F.when(t(k) != "no", t(k)) for k in POI_KEYS])
    building, place, highway, railway, stop, air = (t(k) for k in ("building", "place", "highway", "railway", "public_transport", "aeroway"))
    waterway, landuse, natural, leisure, built, barrier = (t(k) for k in ("waterway", "landuse", "natural", "leisure", "man_made", "barrier"))
    any_poi = F.coalesce(*[t(k) for k in POI_KEYS])
    house = _chain((named.isNotNull() & t("name").isNotNull(), _fate("poi", named, "any")), (always, _fate("building", F.coalesce(building, F.lit("part")), "areal")))
    rails = _chain(
        (_among(railway, RAILS), _fate("transport", F.lit("rail"), "linear")), (_among(railway, RAIL_STOPS), _fate("transport", _mapped(railway, RAIL_STOPS), "point")),
        (_among(railway, RAIL_POINTS), _fate("poi", railway, "point")), (_among(railway, NO_RAILS), excluded), (always, unknown),
    )
    stops = _chain((_among(stop, STOPS), _fate("transport", _mapped(stop, STOPS), "any")), (_among(stop, NO_STOPS), excluded), (always, unknown))
    airfields = _chain(
        (_among(air, AIRFIELDS), _fate("transport", _mapped(air, AIRFIELDS), "any")), (_among(air, AIR_POINTS), _fate("poi", air, "point")),
        (_among(air, NO_AIRFIELDS), excluded), (always, unknown),
    )
    waters = _chain((_among(waterway, WATERWAYS), _fate("water", waterway, "any")), (_among(waterway, WATER_POINTS), _fate("poi", waterway, "point")), (always, excluded))
    lands = _chain((_among(landuse, BASINS), _fate("water", landuse, "areal")), (always, _fate("landuse", landuse, "areal")))
    nature = _chain(
        (_among(natural, WATER_AREAS), _fate("water", natural, "areal")), (_among(natural, NATURAL_AREAS), _fate("landuse", _mapped(natural, NATURAL_AREAS), "areal")),
        (_among(natural, NATURAL_POINTS), _fate("poi", natural, "point")), (always, excluded),
    )
    grounds = _chain(
        (_among(leisure, LEISURE_AREAS), _fate("landuse", _mapped(leisure, LEISURE_AREAS), "areal")), (_among(leisure, LEISURE_POINTS), _fate("poi", leisure, "point")),
        (always, _fate("landuse", leisure, "any")),
    )
    roads = _chain(
        (_among(highway, ROADS), _fate("road", highway, "linear")), (_among(highway, ROAD_POINTS), _fate("road", highway, "point")),
        (_among(highway, POLES), _fate("poi", highway, "point")), (always, unknown),
    )
    return _chain(
        (building.isNotNull() | t("building:part").isNotNull(), house),
        (place.isNotNull(), F.when(_among(place, PLACE_IMPORTANCE), _fate("place", place, "any")).otherwise(excluded)),
        (t("boundary").isNotNull(), excluded),
        (_among(highway, BUS_STOPS), _fate("transport", F.lit("bus_stop"), "point")),
        (_among(highway, NO_ROADS), excluded),
        (railway.isNotNull(), rails), (stop.isNotNull(), stops), (air.isNotNull(), airfields), (waterway.isNotNull(), waters), (landuse.isNotNull(), lands),
        (natural.isNotNull(), nature), (leisure.isNotNull(), grounds),
        (built.isNotNull(), F.when(_among(built, BUILT), _fate("poi", built, "any")).otherwise(excluded)),
        (highway.isNotNull(), roads),
        (barrier.isNotNull(), F.when(_among(barrier, GATES), _fate("poi", barrier, "point")).otherwise(excluded)),
        (t("power").isNotNull(), excluded),
        (any_poi.isNotNull(), _fate("poi", any_poi, "point")),
        (always, unknown),
    )


def drop_reason(fate: Column, geometry_type: Column, closed: Column, source_id: Column, inside: Column, surveyed_roads: bool = True) -> Column:
    """Why an element is left out, or null: its tags, a road that the survey has, its geometry, a missing id, or its place."""
    survey = F.lit(surveyed_roads) & (fate["kind"] == "road") & _among(fate["subtype"], SURVEYED_ROADS)
    return (
        F.when(fate["reason"].isNotNull(), fate["reason"]).when(survey, "excluded_tag").when(~fits(fate["mode"], geometry_type, closed), "geometry_kind_mismatch")
        .when(source_id.isNull() | (F.trim(source_id) == ""), "missing_source_id").when(~inside, "outside_boundary")
    )


def fits(mode: Column, geometry_type: Column, closed: Column) -> Column:
    """Whether a geometry serves a mode; a closed line serves as an area."""
    area = geometry_type.isin("Polygon", "MultiPolygon") | (geometry_type == "LineString") & closed
    return F.when(mode.isin("point", "any"), F.lit(True)).when(mode == "linear", geometry_type.isin("LineString", "MultiLineString")).otherwise(area)


def category(tags: Column, table: dict[str, str] = TAG_CATEGORY) -> Column:
    """The category of the first decisive key that the table knows, else of the first key whose presence says enough."""
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    exact = [known[F.concat(F.lit(f"{k}="), tags[k])] for k in CATEGORY_KEYS]
    return F.coalesce(*exact, *[F.when(tags[k].isNotNull(), F.lit(v)) for k, v in PRESENCE.items()])


def value_category(value: Column, table: dict[str, str] = TAG_CATEGORY) -> Column:
    """The category of a bare tag value, tried under one key after the other."""
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(*[known[F.concat(F.lit(f"{k}="), value)] for k in VALUE_KEYS])


def has_any(tags: Column, *keys: str) -> Column:
    """Whether an element has one of the keys."""
    return F.exists(F.map_keys(tags), lambda k: k.isin(*keys))


def building_height(tags: Column, storey: float = 3.0) -> Column:
    """Metres: the height tag, else storeys, else one storey; the second field says whether it is inferred."""
    number = lambda key: F.regexp_extract(tags[key], r"^\s*([0-9]+(?:\.[0-9]+)?)\s*m?\s*$", 1).try_cast("double")
    height, levels = F.when(number("height") > 0, number("height")), F.when(number("building:levels") > 0, number("building:levels"))
    return F.struct(F.coalesce(height, levels * storey, F.lit(storey)).alias("metres"), height.isNull().alias("inferred"))


def stratum(tags: Column) -> Column:
    """bridge, tunnel or ground."""
    on = lambda key: F.coalesce(~F.lower(tags[key]).isin("no", "false", "0"), F.lit(False))
    return F.when(on("tunnel"), "tunnel").when(on("bridge"), "bridge").otherwise("ground")


def address(tags: Column) -> Column:
    """One line of the address tags, null without a street or place."""
    street = F.coalesce(tag(tags, "addr:street"), tag(tags, "addr:place"))
    town = F.concat_ws(" ", tag(tags, "addr:postcode"), tag(tags, "addr:city"))
    line = F.concat_ws(" ", tag(tags, "addr:housenumber"), street)
    return F.when(street.isNotNull(), F.when(town != "", F.concat_ws(", ", line, town)).otherwise(line))


def object_url(source_id: Column) -> Column:
    """The page of an element, from n1, w1, r1 or node/1, way/1, relation/1; null for another id."""
    short = F.lower(F.regexp_extract(source_id, "^([nwrNWR])[0-9]+$", 1))
    kind = F.when(short == "n", "node").when(short == "w", "way").when(short == "r", "relation")
    path = F.when(kind.isNotNull(), F.concat_ws("/", kind, F.substring(source_id, F.lit(2), F.length(source_id)))).when(source_id.rlike("^(node|way|relation)/[0-9]+$"), source_id)
    return F.concat(F.lit("https://www.openstreetmap.org/"), path)


def element_ids(source_id: Column) -> Column:
    """The canonical ids of an area id: a is a way or a relation, so both."""
    number = F.regexp_extract(source_id, "^[nwraNWRA]([0-9]+)$", 1)
    letter = F.lower(F.substring(source_id, 1, 1))
    return F.when(number == "", F.array(source_id)).when(letter == "a", F.array(F.concat(F.lit("way/"), number), F.concat(F.lit("relation/"), number))).otherwise(
        F.array(F.concat_ws("/", F.when(letter == "n", "node").when(letter == "w", "way").otherwise("relation"), number))
    )


def metadata(tags: Column) -> Column:
    """The tags without null and empty values."""
    return F.map_filter(tags, lambda _, v: v.isNotNull() & (v != ""))
