"""Search records: routes and streets from road segments, records told apart by name and place, their tiles, and how results are shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartolith.functions import coerce, names, survey, text
from cartolith.plans.tables import discard, materialise

from .joins import cell

#: records of a name that the first turn of distinct_records takes; each further turn ends at so many times as many
FIRST, TURN = 64, 4

# fixed values: numbers that roads carried before they were renumbered, and sources that are no places
FORMER_NUMBERS = {"D1124": ["N124"], "D1021": ["N21"]}
SKIPPED_SOURCES = ("ign-bdtopo:point_de_repere/",)
ROUTE = r"^(A|N|D|E)([0-9]{1,4}[A-Z]?)$"
# fixed values: places that people live in
SETTLEMENTS = ("commune", "city", "town", "village", "suburb", "quarter", "neighbourhood", "hamlet", "settlement", "isolated_dwelling", "farm", "locality")


def route_numbers(ref: Column) -> Column:
    """Road numbers of a list with ; , or /, as letter and number."""
    parts = F.transform(F.split(ref, "[;,/]"), lambda r: F.regexp_replace(F.upper(F.trim(r)), r"\s+", ""))
    return F.filter(parts, lambda r: r.rlike(ROUTE))


def best_spelling(rows: DataFrame, key: list[str], name: str) -> DataFrame:
    """key, name: the commonest spelling; half a vote more for one with lower case, ties by the spelling."""
    votes = rows.where(F.col(name).isNotNull()).groupBy(*key, name).agg(F.count(F.lit(1)).alias("_n"))
    score = F.col("_n") + F.col(name).rlike("[a-z]").cast("int") * 0.5
    return votes.groupBy(*key).agg(F.min_by(name, F.struct(-score, F.col(name))).alias(name))


def routes(segments: DataFrame, least: float = 300, most_names: int = 4) -> DataFrame:
    """One row a road number over the whole area: ref, road_class (the best), length, communes, names (the commonest, a stated few), former, boost.
    segments: ref, name, road_class, commune, length. Numbers of less than ``least`` metres are left out."""
    d = segments.select("*", F.explode(F.array_distinct(route_numbers(F.col("ref")))).alias("number"))
    rank = F.coalesce(survey.mapped(F.col("road_class"), survey.ROAD_RANK), F.lit(10))
    sums = d.groupBy("number").agg(F.min_by("road_class", F.struct(rank, F.col("road_class"))).alias("road_class"), F.sum("length").alias("length"), F.count_distinct("commune").alias("communes")).where(F.col("length") >= least)
    votes = d.where("name is not null").groupBy("number", "name").agg(F.count(F.lit(1)).alias("n"))
    # a number's spellings are ranked before they are listed, so no list grows beyond the few
    few = votes.withColumn("_r", F.row_number().over(Window.partitionBy("number").orderBy(F.desc("n"), "name"))).where(F.col("_r") <= most_names)
    listed = few.groupBy("number").agg(F.array_sort(F.collect_list(F.struct("_r", "name"))).alias("l")).select("number", F.transform("l", lambda v: text.display_case(v["name"])).alias("names"))
    none = F.array().cast("array<string>")
    former = F.coalesce(F.create_map(*[x for k, v in FORMER_NUMBERS.items() for x in (F.lit(k), F.array(*[F.lit(n) for n in v]))])[F.col("number")], none)
    letter = F.substring("number", 1, 1)
    network = F.when(letter == "A", 220).when((letter == "N") | F.exists(former, lambda v: v.startswith("N")), 200).when(letter == "E", 180).otherwise(130)
    boost = network + survey.mapped(F.col("road_class"), survey.ROAD_BOOST, 0)
    return sums.join(listed, "number", "left").select(F.col("number").alias("ref"), "road_class", "length", "communes", F.coalesce("names", none).alias("names"), former.alias("former"), boost.alias("boost"))


def streets(segments: DataFrame) -> DataFrame:
    """One row a street of a commune: key, commune, name (the commonest spelling), road_class (the best), length, segment_id of the member
    nearest the middle of the street's box, boost. segments: segment_id, name, road_class, commune, length, x, z."""
    d = segments.where("name is not null").withColumn("key", text.fold_text(F.col("name")))
    by = ["key", "commune"]
    rank = F.coalesce(survey.mapped(F.col("road_class"), survey.ROAD_RANK), F.lit(10))
    middle = lambda c: ((F.min(c) + F.max(c)) / 2)
    sums = d.groupBy(*by).agg(F.min_by("road_class", F.struct(rank, F.col("road_class"))).alias("road_class"), F.sum("length").alias("total"), middle("x").alias("mx"), middle("z").alias("mz"))
    away = F.hypot(F.col("x") - F.col("mx"), F.col("z") - F.col("mz")) - F.least(F.col("length"), F.lit(200.0)) * 0.05
    near = d.join(sums.select(*by, "mx", "mz"), by).groupBy(*by).agg(F.min_by("segment_id", F.struct(away, F.col("segment_id"))).alias("segment_id"))
    out = sums.join(best_spelling(d, by, "name"), by).join(near, by)
    return out.select(*by, names.street_name(F.col("name")).alias("name"), "road_class", F.col("total").alias("length"), "segment_id", survey.street_boost(F.col("road_class"), F.col("total")).alias("boost"))


def first_kept(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, twin: what a pass in order keeps (twin null), and the earliest kept neighbour that takes in each other row.

    pairs: earlier, later (neighbours by their place in the order), nodes: place. In each round the rows without an undecided earlier neighbour are
    kept and their later neighbours go; that is the result of one row after the other, in as many rounds as chains of neighbours are long."""
    state = materialise(nodes.select("place").join(pairs.select(F.col("later").alias("place")).distinct(), "place", "left_anti"), "kept")
    rest = materialise(pairs, "pairs")
    while True:
        # neighbours of kept rows are gone; a row whose earlier neighbours are all gone is kept
        gone = materialise(rest.join(state.select(F.col("place").alias("earlier")), "earlier").select(F.col("later").alias("place")).distinct(), "gone")
        left = rest.join(gone.select(F.col("place").alias("later")), "later", "left_anti")
        still = materialise(left.join(gone.select(F.col("place").alias("earlier")), "earlier", "left_anti"), "pairs")
        freed = left.select(F.col("later").alias("place")).distinct().join(still.select(F.col("later").alias("place")).distinct(), "place", "left_anti")
        fresh = materialise(freed, "kept")
        old, state = state, materialise(state.unionByName(fresh), "kept")
        done = not fresh.limit(1).count()
        discard(gone, rest, fresh, old)
        rest = still
        if done:
            break
    twin = pairs.join(state.select(F.col("place").alias("earlier")), "earlier").groupBy(F.col("later").alias("place")).agg(F.min("earlier").alias("twin"))
    return nodes.select("place").join(twin, "place", "left")


def distinct_records(records: DataFrame, near: float = 150, settled: float = 1500, widest: float = 3000) -> DataFrame:
    """Search records without those that repeat another of the same name nearby; the kept one has their best spelling, greatest boost and aliases.

    records: record_id, name, kind, category, x, z, reach (half the diagonal of its box), boost, richness. Records are taken by richness,
    boost and id. Places of one name are one within ``settled``, other records within ``near`` or their reach up to ``widest``; a settlement and a
    record that is no place stay apart. Of several kept ones in reach the first takes a record in."""
    free = records.where(F.col("kind").isin("address", "road", "boundary", "water"))
    d = records.where(~F.col("kind").isin("address", "road", "boundary", "water")).withColumn("key", names.duplicate_key(F.col("name")))
    # the order within a name is all that matters, so no task ranks all records
    d = d.withColumn("turn", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("richness"), F.desc("boost"), "record_id"))).withColumn("place", F.struct("key", "turn"))
    d = materialise(d.withColumn("cx", cell("x", widest)).withColumn("cz", cell("z", widest)), "distinct-records")
    around = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dz")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    columns = ("place", "kind", "category", "x", "z", "reach")
    place = lambda s: F.col(f"{s}_kind") == "place"
    lived = lambda s: place(s) & F.coalesce(F.col(f"{s}_category").isin(*SETTLEMENTS), F.lit(False))
    reach = lambda s: F.least(F.coalesce(f"{s}_reach", F.lit(0.0)), F.lit(float(widest)))
    radius = F.when(place("l") & place("r"), float(settled)).otherwise(F.greatest(F.lit(float(near)), reach("l"), reach("r")))
    met = ((place("l") == place("r")) | ~(lived("l") | lived("r"))) & (F.hypot(F.col("l_x") - F.col("r_x"), F.col("l_z") - F.col("r_z")) <= radius)

    def pairs(earlier: DataFrame, later: DataFrame) -> DataFrame:
        """The rows of two tables that repeat each other."""
        l, r = (t.select("key", "cx", "cz", *[F.col(c).alias(f"{s}_{c}") for c in columns]) for s, t in (("l", earlier), ("r", later)))
        l = l.withColumn("_n", F.explode(around)).withColumn("cx", F.col("cx") + F.col("_n.dx")).withColumn("cz", F.col("cz") + F.col("_n.dz")).drop("_n")
        return l.join(r, ["key", "cx", "cz"]).where((F.col("l_place") < F.col("r_place")) & met).select(F.col("l_place").alias("earlier"), F.col("r_place").alias("later"))

    # turns grow: what the kept ones of earlier turns take in leaves before its own pairs are made
    rest, kept, read = d, None, FIRST
    while True:
        now, rest = rest.where(F.col("turn") <= read), rest.where(F.col("turn") > read)
        decided = materialise(first_kept(materialise(pairs(now, now), "near"), now), "distinct-turn")
        taken = now.join(decided.where("twin is null").select("place"), "place", "left_semi")
        kept = decided if kept is None else kept.unionByName(decided)
        twins = materialise(pairs(taken, rest).groupBy(F.col("later").alias("place")).agg(F.min("earlier").alias("twin")), "distinct-twins")
        kept = kept.unionByName(twins)
        rest = materialise(rest.join(twins, "place", "left_anti"), "distinct-rest")
        if not rest.limit(1).count():
            break
        read *= TURN
    kept = kept.withColumn("home", F.coalesce("twin", "place"))
    joined = d.join(kept, "place")
    quality = F.struct((-text.name_quality(F.col("name"))).alias("q"), F.col("turn"))
    merged = joined.groupBy("home").agg(
        F.min_by(F.struct("record_id", "kind", "category", "x", "z"), "turn").alias("r"), F.min_by("name", quality).alias("name"), F.max("boost").alias("boost"), F.array_sort(F.collect_set("name")).alias("spellings"),
    )
    alias = F.filter("spellings", lambda n: n != F.col("name"))
    shown = merged.select("r.*", "name", "boost", alias.alias("aliases"))
    return shown.unionByName(free.select("record_id", "kind", "category", "x", "z", "name", "boost", F.array().cast("array<string>").alias("aliases")))


def tile_of(features: DataFrame, listed: DataFrame, tiles: DataFrame) -> DataFrame:
    """feature_id, tile_id: of the tiles that list a feature the one that holds its anchor, else the first by id; else the first tile that holds the anchor.
    features: feature_id, x, z; listed: tile_id, feature_id; tiles: tile_id, x0, z0, x1, z1 of one size."""
    holds = (F.col("x") >= F.col("x0")) & (F.col("x") <= F.col("x1")) & (F.col("z") >= F.col("z0")) & (F.col("z") <= F.col("z1"))
    known = features.join(listed, "feature_id").join(tiles, "tile_id").groupBy("feature_id").agg(F.min(F.struct((~holds).alias("out"), F.col("tile_id"))).alias("b")).select("feature_id", "b.tile_id")
    size = tiles.agg(F.max(F.col("x1") - F.col("x0"))).first()[0] or 1.0
    t = tiles.withColumn("cx", F.explode(F.sequence(cell("x0", size), cell("x1", size)))).withColumn("cz", F.explode(F.sequence(cell("z0", size), cell("z1", size))))
    rest = features.join(known.select("feature_id"), "feature_id", "left_anti").withColumn("cx", cell("x", size)).withColumn("cz", cell("z", size))
    found = rest.join(t, ["cx", "cz"]).where(holds).groupBy("feature_id").agg(F.min("tile_id").alias("tile_id"))
    return known.unionByName(found)


def host_tiles(communes: DataFrame, tiles: DataFrame, size: float, severity: Column) -> DataFrame:
    """tile_id, commune_id: the commune of the most severe settlement class in each tile; each commune counts in the first tile that holds it."""
    t = tiles.withColumn("cx", F.explode(F.sequence(cell("x0", size), cell("x1", size)))).withColumn("cz", F.explode(F.sequence(cell("z0", size), cell("z1", size))))
    c = communes.withColumn("cx", cell("x", size)).withColumn("cz", cell("z", size)).withColumn("_s", severity)
    holds = (F.col("x") >= F.col("x0")) & (F.col("x") <= F.col("x1")) & (F.col("z") >= F.col("z0")) & (F.col("z") <= F.col("z1"))
    hosts = c.join(t, ["cx", "cz"]).where(holds).groupBy("commune_id", "_s").agg(F.min("tile_id").alias("tile_id"))
    return hosts.groupBy("tile_id").agg(F.min_by("commune_id", F.struct(-F.col("_s"), F.col("commune_id"))).alias("commune_id"))


def anchored(communes: DataFrame, chief_places: DataFrame) -> DataFrame:
    """Communes with the position of their chief place, or their own."""
    c = chief_places.select("commune_id", F.col("x").alias("_x"), F.col("z").alias("_z"))
    return communes.join(c, "commune_id", "left").withColumn("x", F.coalesce("_x", "x")).withColumn("z", F.coalesce("_z", "z")).drop("_x", "_z")


def nearest(points: DataFrame, addresses: DataFrame, radius: float) -> DataFrame:
    """point_id, address_id, d: the nearest address within radius, the smallest id of equals."""
    from .joins import nearest_within

    found = nearest_within(points, addresses, "point_id", "address_id", radius)
    return found.select("point_id", "address_id", F.sqrt("d2").alias("d"))


def worth_a_record(source_id: Column, kind: Column, name: Column, commune: Column) -> Column:
    """No kilometre markers, and no settlement that only repeats its commune's name."""
    marker = F.lit(False)
    for prefix in SKIPPED_SOURCES:
        marker = marker | source_id.startswith(prefix)
    repeats = (kind == "settlement") & (text.fold_text(name) == text.fold_text(commune))
    return ~marker & ~F.coalesce(repeats, F.lit(False))


def shown_results(hits: DataFrame) -> DataFrame:
    """Scores to a tenth and metres to a hundredth, for display."""
    return hits.withColumn("score", coerce.round_half_up(F.col("score"), 1)).withColumn("metres", coerce.round_half_up(F.col("metres"), 2))


def in_index_order(records: DataFrame) -> DataFrame:
    """By name in the order of a dictionary, accents last, then by id."""
    return records.orderBy(F.expr("collate(name, 'UNICODE')"), "record_id")


def publishable(local: Column, company: Column) -> Column:
    """Whether an establishment belongs on a public map: active, open to diffusion, and not a sole trader (legal forms in 1) without sign or staff.

    local: status, diffusion, sign, trade_name, employer; company: diffusion, legal_form."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    open_ = F.coalesce(local["status"] == "A", F.lit(True)) & ~F.coalesce(local["diffusion"] == "P", F.lit(False)) & ~F.coalesce(company["diffusion"] == "P", F.lit(False))
    person = F.coalesce(company["legal_form"], F.lit("")).startswith("1")
    return open_ & (~person | ~blank(local["sign"]) | ~blank(local["trade_name"]) | F.coalesce(local["employer"] == "O", F.lit(False)))


def establishment(company: Column) -> Column:
    """The fields of a registry answer: of its first matching establishment, else of its seat; null without a registry number.

    company: siret, siren, name, naf, seat and matching (array), both of siret, naf, sign, trade_name, lon, lat (texts)."""
    local = F.coalesce(F.get(company["matching"], F.lit(0)), company["seat"])
    siret = F.coalesce(local["siret"], company["siret"])
    lon, lat = coerce.finite(local["lon"]), coerce.finite(local["lat"])
    both = lon.isNotNull() & lat.isNotNull()
    out = F.struct(
        F.concat(F.lit("sirene:"), siret).alias("source_id"), siret.alias("siret"), company["siren"].alias("siren"), coerce.text(company["name"]).alias("legal_name"),
        F.coalesce(names.business_name(F.coalesce(coerce.text(local["sign"]), coerce.text(local["trade_name"]))), names.business_name(coerce.text(company["name"]))).alias("trading_name"),
        F.coalesce(local["naf"], company["seat"]["naf"], company["naf"]).alias("naf"), F.when(both, lon).alias("lon"), F.when(both, lat).alias("lat"),
    )
    return F.when(local.isNotNull() & siret.isNotNull(), out)


def address_record(address_id: Column, number: Column, repetition: Column, street: Column, inside: Column) -> Column:
    """struct<label, street, reason>: the one-line label of an address with its displayed street, or why it is left out."""
    shown = F.coalesce(names.street_name(coerce.text(street)), F.lit("unknown street"))
    label = F.concat_ws(" ", F.concat_ws("", coerce.text(number), coerce.text(repetition)), shown)
    reason = F.when(coerce.text(address_id).isNull(), "missing_id").when(~inside, "outside_boundary")
    return F.struct(F.when(reason.isNull(), F.trim(label)).alias("label"), F.when(reason.isNull(), shown).alias("street"), reason.alias("reason"))


def applicable(layer: Column, keywords: Column, box: Column, territory: tuple[float, float, float, float]) -> Column:
    """Elevation layers whose box meets the territory; an unknown box passes."""
    about = F.concat_ws(" ", layer, keywords).rlike("(?i)elevation|altitude|altim|mnt|dem")
    x0, z0, x1, z1 = territory
    return about & F.coalesce((box["x0"] <= x1) & (box["x1"] >= x0) & (box["z0"] <= z1) & (box["z1"] >= z0), F.lit(True))


def by_cell(rows: DataFrame, width: float, seq: str) -> DataFrame:
    """Rows in the order of their cells, row by row, then of arrival: ranges of cells are dealt to tasks, each sorted by itself."""
    cx, cz = cell("x", width), cell("z", width)
    return rows.repartitionByRange(cz, cx).sortWithinPartitions(cz, cx, seq)
