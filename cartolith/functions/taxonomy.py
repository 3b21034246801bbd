"""Categories: families, activity sections and road ranks, as literal tables and expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: categories that a browse for one of them also shows
FAMILIES = {
    "restaurant": ("restaurant", "fast_food"), "supermarket": ("supermarket", "convenience"), "doctor": ("doctor", "hospital", "dentist", "nurse", "laboratory"),
    "bank": ("bank", "atm"), "hotel": ("hotel", "guest_house", "campsite"), "fuel": ("fuel", "charging"),
    "attraction": ("attraction", "castle", "monument", "museum", "viewpoint", "tourist_info"), "castle": ("castle", "monument"), "winery": ("winery", "wine_shop"),
}
# fixed values: activity divisions by section, and the category of each section
SECTIONS = (
    (1, 3, "A", "farm"), (5, 9, "B", "industry"), (10, 33, "C", "industry"), (35, 35, "D", "utility"), (36, 39, "E", "utility"), (41, 43, "F", "contractor"),
    (45, 47, "G", "shop"), (49, 53, "H", "industry"), (55, 56, "I", "restaurant"), (58, 63, "J", "it_media"), (64, 66, "K", "bank"), (68, 68, "L", "real_estate"),
    (69, 75, "M", "office"), (77, 82, "N", "office"), (84, 84, "O", "public_service"), (85, 85, "P", "school"), (86, 88, "Q", "doctor"), (90, 93, "R", "attraction"), (94, 96, "S", "office"),
)
# fixed values: activity codes whose category is not that of their division; another table is a parameter of activity_category
ACTIVITIES = {
    "10.71A": "bakery", "10.71B": "bakery", "10.71C": "bakery", "10.71D": "bakery", "10.13B": "butcher", "10.11Z": "industry", "11.01Z": "winery", "11.02A": "winery",
    "11.02B": "winery", "01.21Z": "winery", "45.11Z": "car_dealer", "45.19Z": "car_dealer", "45.20A": "car_repair", "45.20B": "car_repair", "45.31Z": "car_dealer",
    "45.32Z": "car_dealer", "45.40Z": "car_dealer", "47.11A": "convenience", "47.11B": "convenience", "47.11C": "convenience", "47.11D": "supermarket",
    "47.11E": "supermarket", "47.11F": "supermarket", "47.21Z": "greengrocer", "47.22Z": "butcher", "47.23Z": "butcher", "47.24Z": "bakery", "47.25Z": "wine_shop",
    "47.26Z": "books_news", "47.29Z": "greengrocer", "47.30Z": "fuel", "47.41Z": "electronics", "47.42Z": "electronics", "47.43Z": "electronics", "47.51Z": "clothes",
    "47.52A": "diy", "47.52B": "diy", "47.53Z": "furniture", "47.54Z": "furniture", "47.59A": "furniture", "47.59B": "furniture", "47.61Z": "books_news",
    "47.62Z": "books_news", "47.63Z": "electronics", "47.64Z": "sports_shop", "47.65Z": "gift_shop", "47.71Z": "clothes", "47.72A": "shoes", "47.72B": "clothes",
    "47.73Z": "pharmacy", "47.74Z": "pharmacy", "47.75Z": "beauty", "47.76Z": "florist", "47.77Z": "jewelry", "47.78A": "optician", "47.78B": "electronics",
    "47.78C": "gift_shop", "47.79Z": "gift_shop", "47.81Z": "market", "47.82Z": "market", "47.89Z": "market", "49.10Z": "train_station", "49.31Z": "bus_stop",
    "49.32Z": "taxi", "49.39A": "bus_stop", "49.39B": "bus_stop", "52.21Z": "parking", "53.10Z": "post_office", "53.20Z": "post_office", "55.10Z": "hotel",
    "55.20Z": "guest_house", "55.30Z": "campsite", "55.90Z": "guest_house", "56.10C": "fast_food", "56.30Z": "bar", "59.14Z": "cinema", "65.11Z": "insurance",
    "65.12Z": "insurance", "66.22Z": "insurance", "69.10Z": "legal", "69.20Z": "accountant", "71.11Z": "architect", "71.12A": "architect", "71.12B": "architect",
    "71.20A": "car_repair", "71.20B": "laboratory", "73.11Z": "it_media", "73.12Z": "it_media", "74.20Z": "it_media", "75.00Z": "veterinary", "77.11A": "car_dealer",
    "77.11B": "car_dealer", "77.21Z": "sports_shop", "79.11Z": "travel_agency", "79.12Z": "travel_agency", "79.90Z": "tourist_info", "81.29A": "utility", "81.30Z": "florist",
    "84.11Z": "town_hall", "84.24Z": "police", "84.25Z": "fire_station", "85.41Z": "university", "85.42Z": "university", "85.51Z": "sports", "85.53Z": "driving_school",
    "85.59A": "university", "85.59B": "university", "85.60Z": "office", "86.10Z": "hospital", "86.23Z": "dentist", "86.90A": "taxi", "86.90B": "laboratory", "86.90C": "nurse",
    "86.90D": "nurse", "86.90E": "nurse", "86.90F": "nurse", "87.10A": "nursing_home", "87.10B": "nursing_home", "87.10C": "nursing_home", "87.20A": "nursing_home",
    "87.20B": "nursing_home", "87.30A": "nursing_home", "87.30B": "nursing_home", "87.90A": "nursing_home", "87.90B": "nursing_home", "88.91A": "kindergarten",
    "88.91B": "kindergarten", "88.10A": "public_service", "88.10B": "public_service", "88.10C": "public_service", "88.99A": "public_service", "88.99B": "public_service",
    "90.01Z": "theatre", "90.02Z": "theatre", "90.04Z": "theatre", "91.01Z": "library", "91.02Z": "museum", "91.03Z": "monument", "91.04Z": "park", "93.11Z": "sports",
    "93.12Z": "sports", "93.13Z": "fitness", "93.19Z": "sports", "95.11Z": "electronics", "95.12Z": "electronics", "95.21Z": "electronics", "95.22Z": "furniture",
    "95.23Z": "shoes", "95.24Z": "furniture", "95.25Z": "jewelry", "95.29Z": "gift_shop", "96.01A": "laundry", "96.01B": "laundry", "96.02A": "hairdresser",
    "96.02B": "beauty", "96.03Z": "funeral", "96.04Z": "fitness", "96.09Z": "beauty",
}
# fixed values: activities that are no place to visit
NON_PLACES = ("64.20Z", "68.20A", "68.20B", "70.10Z", "66.30Z", "64.30Z", "64.99Z", "94.99Z", "94.11Z", "94.12Z", "94.20Z", "94.92Z", "82.99Z", "99.00Z", "84.12Z", "84.13Z")


def family(category: Column) -> Column:
    """The categories that belong to a browse for category, as an array."""
    known = F.create_map(*[x for k, v in FAMILIES.items() for x in (F.lit(k), F.array(*[F.lit(c) for c in v]))])
    return F.coalesce(known[category], F.array(category))


def section_category(code: Column) -> Column:
    """Category of an activity code by its division; wholesale and farms come first."""
    normal = F.upper(F.trim(code))
    division = F.substring(normal, 1, 2).try_cast("int")
    out = F.when(normal.rlike(r"^0[123]\."), "farm").when(normal.startswith("46."), "wholesale")
    for low, high, _, category in SECTIONS:
        out = out.when(division.between(low, high), category)
    return out


def is_place(code: Column) -> Column:
    return F.coalesce(~F.upper(F.trim(code)).isin(*NON_PLACES), F.lit(True))


def activity_category(code: Column, table: dict[str, str] = ACTIVITIES) -> Column:
    """Category of an activity code: by the table, else by its division."""
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(known[F.upper(F.trim(code))], section_category(code))
